"""Narratives: evidence in time order, cut into phases, with transitions, gaps and limitations."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import asdict, dataclass

from .. import constants as C
from ..functions import local as L
from . import evidence as E


@dataclass(frozen=True)
class Phase:
    """Neighbouring evidence on one topic."""

    label: str
    description: str
    evidence_ids: tuple[str, ...]
    date_range: str | None
    support: str


@dataclass(frozen=True)
class Transition:
    """What differs between neighbouring phases."""

    from_phase: str
    to_phase: str
    description: str
    evidence_ids: tuple[str, ...]
    support: str = "partially_supported"


@dataclass(frozen=True)
class Gap:
    """A time without evidence."""

    description: str
    reason: str = "Retrieval did not surface messages from this period"


@dataclass(frozen=True)
class Limitation:
    """A weakness of the evidence."""

    description: str
    kind: str


@dataclass(frozen=True)
class Narrative:
    """The account of one query."""

    query: str
    summary: str
    timeline: tuple[Phase, ...]
    transitions: tuple[Transition, ...]
    gaps: tuple[Gap, ...]
    limitations: tuple[Limitation, ...]
    evidence_count: int

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=True, indent=2, sort_keys=True) + "\n"


def _vocabulary(item: E.Evidence) -> set[str]:
    return L.content_terms(item.excerpt) | L.entity_terms(item.excerpt)


def chronological(items: tuple[E.Evidence, ...]) -> list[E.Evidence]:
    """By time, those without one last, then by rank."""
    return sorted(items, key=lambda i: (not i.created_at, i.created_at or "", i.rank))


def group(items: list[E.Evidence], query_terms, days: int = C.PHASE_DAYS) -> list[list[E.Evidence]]:
    """Phases: an item joins the last one if near its last item in time and alike its words so far."""
    skip, groups, words = {t.lower() for t in query_terms}, [], set()
    for item in items:
        own = _vocabulary(item) - skip
        if groups:
            last, now = L.date_of(groups[-1][-1].created_at), L.date_of(item.created_at)
            near = L.days_between(last, now) <= days if last and now else last == now
            if near and L.jaccard(own, words) >= C.PHASE_COHERENCE:
                groups[-1].append(item)
                words |= own
                continue
        groups.append([item])
        words = set(own)
    return groups


def date_span(dates: list[str]) -> str | None:
    """``first to last``, or the one date."""
    dates = sorted(dates)
    return None if not dates else dates[0] if dates[0] == dates[-1] else f"{dates[0]} to {dates[-1]}"


def make_phase(items: list[E.Evidence]) -> Phase:
    """A phase from its items; users' words lead."""
    ids = tuple(i.id for i in items)
    span = date_span([d for i in items if (d := L.date_of(i.created_at))])
    users = [i for i in items if i.role == "user"]
    counts = Counter(n for i in users for n in L.entity_terms(i.excerpt)) or Counter(n for i in items for n in L.entity_terms(i.excerpt))
    names = ", ".join(sorted(counts, key=lambda n: (-counts[n], n))[:2])
    label = ": ".join(x for x in (span, names) if x) or f"Phase (evidence {', '.join(ids)})"
    parts = []
    for i in users + [i for i in items if i.role != "user"]:
        date = L.date_of(i.created_at)
        parts.append(f'{f"({date}) " if date else ""}[{i.role or "unknown"}] "{L.cut(i.excerpt, 150)}"')
    return Phase(label, " | ".join(parts), ids, span, "supported" if len(items) == 1 else "partially_supported")


def stated_change(excerpts: list[str]) -> str | None:
    """The surroundings of the first word that states a change."""
    verb = re.compile(rf"\b({'|'.join(C.CHANGE_VERBS)})\b", re.IGNORECASE)
    for text in excerpts:
        found = verb.search(text)
        if found:
            a, b = max(0, found.start() - 30), min(len(text), found.end() + 50)
            return f'"{"..." * (a > 0)}{text[a:b].strip()}{"..." * (b < len(text))}"'
    return None


def tone_shift(before: list[str], after: list[str]) -> str | None:
    """Whether the balance of cue words turns."""
    balance = []
    for texts in (before, after):
        words = [set(t.lower().split()) for t in texts]
        balance.append(sum(len(w & C.TONE_UP) - len(w & C.TONE_DOWN) for w in words))
    if balance[0] > 0 > balance[1]:
        return "positive to negative"
    return "negative to positive" if balance[0] < 0 < balance[1] else None


def transition(a: Phase, b: Phase, left: list[E.Evidence], right: list[E.Evidence]) -> Transition:
    """The strongest signs of a turn between two phases."""
    names = [{n for i in side for n in L.entity_terms(i.excerpt)} for side in (left, right)]
    topics = [f"{what}: {', '.join(sorted(found)[:3])}" for what, found in (("new topics", names[1] - names[0]), ("prior topics absent", names[0] - names[1])) if found]
    signs = ["Topic shift: " + "; ".join(topics)] if topics else []
    change = stated_change([i.excerpt for i in right])
    if change:
        signs.append(f"Stated change: {change}")
    end = next((d for i in reversed(left) if (d := L.date_of(i.created_at))), None)
    start = next((d for i in right if (d := L.date_of(i.created_at))), None)
    if end and start and L.days_between(end, start) > 0:
        signs.append(f"Time: {L.days_between(end, start)}-day gap ({end} to {start})")
    if not signs:
        tone = tone_shift([i.excerpt for i in left], [i.excerpt for i in right])
        signs = [f"Tone shift: {tone}" if tone else "Sequential continuation"]
    return Transition(a.label, b.label, ". ".join(signs), a.evidence_ids[-1:] + b.evidence_ids[:1])


def first_date(span: str | None) -> str | None:
    return span[:10] if span and len(span) >= 10 else None


def last_date(span: str | None) -> str | None:
    return span.split(" to ")[-1][:10] if span and len(span) >= 10 else None


def gaps(phases: list[Phase], days: int = C.GAP_DAYS) -> list[Gap]:
    """Neighbouring phases that lie ``days`` or more apart."""
    out = []
    for a, b in zip(phases, phases[1:]):
        end, start = last_date(a.date_range), first_date(b.date_range)
        if end and start and L.days_between(end, start) >= days:
            out.append(Gap(f"No evidence between {end} and {start} ({L.days_between(end, start)} days)"))
    return out


def limitations(items: list[E.Evidence]) -> list[Limitation]:
    """Cut excerpts, and once each missing times and days that order nothing."""
    out, previous, kinds = [], None, set()

    def once(kind: str, text: str) -> None:
        if kind not in kinds:
            kinds.add(kind)
            out.append(Limitation(text, kind))

    for i in items:
        if len(i.excerpt) >= 195:
            out.append(Limitation(f"Evidence {i.id} excerpt is truncated at ~200 characters", "truncated_excerpt"))
        if len(i.created_at or "") < 10:
            once("null_timestamp", "One or more evidence items lack timestamps; chronological ordering may be unreliable")
            continue
        date = L.date_of(i.created_at)
        if date and date == previous:
            once("ambiguous_ordering", f"Multiple evidence items share the date {date}; " "intra-day ordering is based on timestamp precision")
        previous = date
    return out


def summarize(phases: list[Phase], found: list[Gap]) -> str:
    """A few sentences on span, grounding, phases and gaps."""
    n = len(phases)
    if not n:
        return "No evidence was retrieved for this query."
    spans = [p.date_range for p in phases if p.date_range]
    a, b = (first_date(spans[0]), last_date(spans[-1])) if spans else (None, None)
    if not spans:
        out = [f"The evidence covers {n} phase(s) without clear date markers."]
    elif a and b and a != b:
        out = [f"The evidence spans from {a} to {b} across {n} phase(s)."]
    else:
        out = [f"The evidence is concentrated around {a} across {n} phase(s)."] if a else []
    out.append(f"{sum('[user]' in p.description for p in phases)} of {n} phase(s) grounded in user content.")
    out += [f"{p.label}{f' ({p.date_range})' if p.date_range else ''}: {len(p.evidence_ids)} evidence item(s), {p.support}." for p in phases[:4]]
    if n > 4:
        out.append(f"({n - 4} additional phase(s) not shown in summary.)")
    if found:
        out.append("Notable gap(s): " + "; ".join(g.description for g in found[:2]) + ".")
    return " ".join(out)


def build(query: str, items: tuple[E.Evidence, ...], days: int = C.PHASE_DAYS, gap_days: int = C.GAP_DAYS) -> Narrative:
    """The narrative of a query's evidence."""
    ordered = chronological(items)
    groups = group(ordered, L.focus_terms(query), days)
    phases = [make_phase(g) for g in groups]
    turns = tuple(transition(phases[k], phases[k + 1], groups[k], groups[k + 1]) for k in range(len(groups) - 1))
    holes = gaps(phases, gap_days)
    return Narrative(query, summarize(phases, holes), tuple(phases), turns, tuple(holes), tuple(limitations(ordered)), len(items))


def render(n: Narrative, debug: bool = False) -> str:
    """The narrative as text."""
    lines = [f"Query: {n.query}", "", n.summary, "", "Timeline:"]
    for k, p in enumerate(n.timeline, 1):
        lines += [f"  {k}. {p.label} [{p.support}]", f"     {p.description}"]
    for title, rows in (("Transitions", [f"{t.from_phase} -> {t.to_phase}: {t.description}" for t in n.transitions]), ("Gaps", [g.description for g in n.gaps]), ("Limitations", [x.description for x in n.limitations])):
        lines += ["", f"{title}:", *(f"  - {r}" for r in rows)] if rows else []
    if debug:
        lines += ["", f"evidence_count: {n.evidence_count}", *(f"  {p.label}: {', '.join(p.evidence_ids)}" for p in n.timeline)]
    return "\n".join(lines)
