"""Deterministic answers: status, wording, and an optional writer whose text is checked."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .. import constants as C
from ..functions import local as L
from . import evidence as E

SUPPORTED, PARTIAL, AMBIGUOUS, INSUFFICIENT = "supported", "partially_supported", "ambiguous", "insufficient_evidence"

_FOUND = "Relevant retrieval candidates were found, "
_GAPS = {
    "none": "No relevant retrieval evidence was available for this question.",
    "weak": "The retrieved evidence was too weak or too indirect to support an answer.",
    "composed": "Support is distributed across multiple nearby excerpts within one retrieved conversation window.",
    "possessive": "The retrieved evidence does not support the combined query concept directly.",
    "single": "Only one strong evidence item was available for this question.",
    "thin": "The retrieved evidence is relevant but too thin for a fully supported answer.",
    "found_composed": _FOUND + "but the composed support stayed too weak to justify a grounded answer.",
    "found_combined": _FOUND + "but none directly supported the full combined query concept after evidence qualification.",
    "found": _FOUND + "but none met the evidence qualification rules for this question.",
}
_TEXTS = {
    INSUFFICIENT: "I did not find enough relevant evidence in this run to answer that question confidently.",
    "empty": "Based on the retrieved conversation evidence, the available support is limited but relevant.",
    AMBIGUOUS: "The retrieved evidence is mixed. Conflicting relevant excerpts include ",
    PARTIAL: "The retrieved evidence only partially answers the question. ",
    "one": 'The strongest relevant excerpt says "',
    "many": "The most relevant excerpts are:",
    SUPPORTED: "Based on the retrieved evidence",
}


@dataclass(frozen=True)
class Decision:
    """The status of an answer, with what is missing or in conflict."""

    status: str
    gaps: tuple[str, ...] = ()
    conflicts: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()


def conflicts(items, focus: tuple[str, ...]) -> tuple[str, ...]:
    """A sentence where topical excerpts hold good and bad news; one excerpt may hold both."""
    good, bad = [], []
    for i in items:
        own = set(L.tokens(i.excerpt))
        if focus and own.isdisjoint(focus):
            continue
        if own & C.POSITIVE_CUES:
            good.append(i.excerpt)
        if own & C.NEGATIVE_CUES:
            bad.append(i.excerpt)
    return (f'Positive and negative evidence both appear, including "{good[0]}" and "{bad[0]}".',) if good and bad else ()


def decide(query: str, kept: E.Qualified) -> Decision:
    """The status that the qualified excerpts allow."""
    focus = L.focus_terms(query)
    say = lambda status, *gaps, clash=(): Decision(status, tuple(gaps), clash, focus)
    if not kept.items:
        return say(INSUFFICIENT, _GAPS["none"])
    firm = tuple(i for i in kept.items if E.strong(i, focus))
    if not firm:
        return say(INSUFFICIENT, _GAPS["weak"])
    clash = conflicts(firm, focus)
    if clash:
        return say(AMBIGUOUS, clash=clash)
    if kept.composed:
        return say(PARTIAL, _GAPS["composed"])
    covered = {t for i in firm for t in i.terms}
    missing = [t for t in focus if t not in covered]
    narrow = len(focus) <= 1 and len(firm) == 1
    if len(focus) >= 2:
        whole = E.combined(firm, focus)
        if whole and not missing:
            return say(SUPPORTED)
        if not whole and E.needs_combined(query, focus):
            return say(INSUFFICIENT, _GAPS["possessive"])
    elif not missing:
        return say(SUPPORTED)
    gaps = [f"The retrieved evidence does not directly cover: {', '.join(missing)}."] if missing else []
    if len(firm) == 1 and not narrow:
        gaps.append(_GAPS["single"])
    return say(PARTIAL, *(gaps or [_GAPS["thin"]]))


def refine(decision: Decision, selected: int, kept: E.Qualified, rejected: list[dict]) -> Decision:
    """Tells evidence that was found but didn't qualify from none at all."""
    if decision.status != INSUFFICIENT or not selected or kept.items:
        return decision
    if kept.composed:
        gap = "found_composed"
    elif any("combined_concept_not_supported" in r["reasons"] for r in rejected):
        gap = "found_combined"
    else:
        gap = "found"
    return replace(decision, gaps=(_GAPS[gap],))


def synthesis_entries(items: tuple[E.Evidence, ...], most: int = 4) -> list[E.Evidence]:
    """Users' excerpts first, without those that begin like one taken before."""
    out, heads = [], set()
    for i in sorted(items, key=lambda i: i.role != "user"):
        head = i.excerpt[:60].lower().strip()
        if not i.excerpt or (len(head) >= 30 and head in heads):
            continue
        heads.add(head)
        out.append(i)
        if len(out) == most:
            break
    return out


def _listed(entries: list[E.Evidence]) -> list[str]:
    dates = {i.created_at[:10] for i in entries if len(i.created_at or "") >= 10}
    ordered = sorted(entries, key=lambda i: i.created_at or "") if len(dates) >= 2 else entries
    lines = []
    for i in ordered:
        date = i.created_at[:10] if len(i.created_at or "") >= 10 else ""
        lines.append(f'- {f"({date}) " if date else ""}"{L.cut(i.excerpt, C.SHORT_EXCERPT)}"')
    return lines


def write(decision: Decision, items: tuple[E.Evidence, ...]) -> str:
    """The wording of an answer."""
    if decision.status == INSUFFICIENT:
        return _TEXTS[INSUFFICIENT]
    entries = synthesis_entries(items)
    if not entries:
        return _TEXTS["empty"]
    if decision.status == AMBIGUOUS:
        return _TEXTS[AMBIGUOUS] + " and ".join(f'"{i.excerpt}"' for i in entries[:2]) + "."
    if decision.status == PARTIAL:
        if len(entries) == 1:
            return _TEXTS[PARTIAL] + _TEXTS["one"] + entries[0].excerpt + '".'
        return "\n".join([_TEXTS[PARTIAL] + _TEXTS["many"], *_listed(entries)])
    if len(entries) == 1:
        return f'{_TEXTS[SUPPORTED]}: "{entries[0].excerpt}".'
    return "\n".join([_TEXTS[SUPPORTED] + " across multiple conversations:", *_listed(entries)])


@dataclass(frozen=True)
class Answer:
    """An answer with everything it rests on."""

    query: str
    status: str
    text: str
    evidence: tuple[E.Evidence, ...]
    gaps: tuple[str, ...]
    conflicts: tuple[str, ...]
    citations: list[dict[str, object]]
    qualified: E.Qualified
    rejected: list[dict[str, object]]
    windows: int
    synthesis: str = "deterministic"
    notes: dict[str, object] = field(default_factory=dict)

    def to_json(self) -> str:
        """Stable JSON."""
        body = {
            "query": self.query, "answer_status": self.status, "answer": self.text, "gaps": self.gaps, "conflicts": self.conflicts, "citations": self.citations, "evidence_used": [E.as_dict(i) for i in self.evidence], "rejected": self.rejected,
            "synthesis_mode": self.synthesis, "support_basis": self.qualified.basis, "coverage_terms": self.qualified.coverage_terms, "coverage_ratio": self.qualified.coverage, "status_reason": self.qualified.reason,
            "retrieved_windows": self.windows, "evidence_used_count": len(self.evidence),
        }
        return json.dumps(body, ensure_ascii=True, indent=2, sort_keys=True) + "\n"

    def render(self) -> str:
        """A report for the terminal."""
        lines = [f"query: {self.query}", f"status: {self.status}", "", self.text]
        for title, rows in (("gaps", self.gaps), ("conflicts", self.conflicts)):
            lines += ["", f"{title}:", *(f"  - {r}" for r in rows)] if rows else []
        lines += ["", "citations:", *(f"  - [{c['provider']}] {c['message_id']} {c['created_at'] or ''}: {c['excerpt']}" for c in self.citations)]
        return "\n".join(lines)


Writer = Callable[[str, str], str]


def answer(query: str, windows: list[dict], cap: int = C.EVIDENCE_CAP, grounding: str = "strict", writer: Writer | None = None, hybrid: bool = False) -> Answer:
    """Answer a query from its ranked windows."""
    chosen = E.select(windows, query, cap)
    kept = E.qualify(query, chosen, grounding)
    rejected = E.rejections(query, chosen, kept)
    decision = refine(decide(query, kept), len(chosen), kept, rejected)
    out = Answer(query, decision.status, write(decision, kept.items), kept.items, decision.gaps, decision.conflicts, E.citations(kept.items), kept, rejected, len(windows))
    return rewrite(out, writer, hybrid) if writer else out


def capitalized(text: str) -> set[str]:
    """All capitalized words, also without a possessive ending."""
    found = set(re.findall(r"\b[A-Z][A-Za-z']+\b", text))
    return found | {w[:-2] for w in found if w.endswith("'s")}


def named(text: str) -> set[str]:
    """Capitalized words inside sentences, likely names."""
    found = re.findall(r"""(?<=[a-z,;:"')\]\d]\s)[A-Z][A-Za-z']+""", text)
    bare = {w.removesuffix("'s") for w in found if w not in C.NON_ENTITIES}
    return {w for w in bare if w and w not in C.NON_ENTITIES}


def _years(text: str) -> set[str]:
    return set(re.findall(r"\b(?:19|20)\d{2}\b", text))


def unseen_forms(text: str, query: str, items: tuple[E.Evidence, ...]) -> list[tuple[str, list[str]]]:
    """The first kind of name, year or month in a text that neither query nor evidence has."""
    source = " ".join([query, *(i.excerpt for i in items), *(i.created_at or "" for i in items)])
    months = lambda t: {m for m in C.MONTHS if m in t}
    for kind, own, known in (("new_entities", named(text), capitalized(source)), ("new_years", _years(text), _years(source)), ("new_months", months(text), months(source))):
        if own - known:
            return [(kind, sorted(own - known))]
    return []


def prompt(out: Answer, hybrid: bool) -> str:
    """The evidence as the writer gets it."""
    rows = [{"evidence_id": i.id, "provider": i.provider, "conversation_id": i.conversation_id, "created_at": i.created_at, "excerpt": i.excerpt} | ({"author_role": i.role or "unknown"} if hybrid else {}) for i in out.evidence]
    body = {"query": out.query, "answer_status": out.status, "gaps": out.gaps, "conflicts": out.conflicts, "evidence": rows, "required_output": {"answer_text": "string", "citation_ids": ["evidence_id"]}}
    return json.dumps(body, ensure_ascii=True, indent=2, sort_keys=True)


_RULES = (
    "Use nothing but the supplied excerpts.", "Add no outside knowledge and draw no conclusion of your own.", "Leave the answer_status as it is.", "Say so where evidence is incomplete, cut or mixed.",
    "Return JSON with just the keys answer_text and citation_ids.", "Cite supplied evidence_id values only.",
)
_HYBRID_RULES = ("Quote the user's own words rather than paraphrase.", "Give dates when evidence spans several.", "Spell names as the evidence does.", "Cite all that you use.")


def instructions(hybrid: bool) -> str:
    """The rules a writer is given."""
    task = "Order and condense the evidence into one account." if hybrid else "Rewrite the grounded answer."
    return "\n".join([task, *(f"- {r}" for r in (*_RULES, *(_HYBRID_RULES if hybrid else ())))])


def parse_written(raw: str) -> tuple[str, tuple[str, ...]]:
    """(text, citation ids) of a writer's JSON; raises ValueError on anything else."""
    body = json.loads(raw)
    if not isinstance(body, dict):
        raise ValueError("a writer must return a JSON object")
    text, ids = body.get("answer_text"), body.get("citation_ids")
    if not isinstance(text, str) or not text.strip():
        raise ValueError("answer_text is missing")
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        raise ValueError("citation_ids must be strings")
    return " ".join(text.split()), tuple(ids)


def rewrite(out: Answer, writer: Writer, hybrid: bool = False) -> Answer:
    """The answer in a writer's words, or as it was, marked as fallback, when the words don't pass the checks."""
    if not out.evidence:
        return out
    label = "hybrid" if hybrid else "llm"
    try:
        text, ids = parse_written(writer(instructions(hybrid), prompt(out, hybrid)))
        by_id = {i.id: i for i in out.evidence}
        if not set(ids) <= set(by_id):
            raise ValueError("unknown evidence is cited")
        if out.status != INSUFFICIENT and not ids:
            raise ValueError("nothing is cited")
        if unseen_forms(text, out.query, out.evidence):
            raise ValueError("names or dates are new")
    except Exception:  # noqa: BLE001 - any failure of an outside service falls back
        return replace(out, synthesis=f"{label}_fallback")
    cited = [by_id[i].citation() for i in ids]
    return replace(out, text=text, citations=cited or out.citations, synthesis=label)


_DEFINITE = ("you definitively concluded", "the evidence clearly shows", "the answer is clear", "fully supported by")


def check_written(text: str, ids: tuple[str, ...], query: str, items: tuple[E.Evidence, ...], status: str) -> tuple[str, list[str]]:
    """(valid, degraded or invalid; failures) of a written answer by five properties."""
    failures, hard, soft = [], False, False
    for kind, found in unseen_forms(text, query, items):
        failures.append(f"{kind}: {found}")
        hard = True
    dates = {i.created_at[:10] for i in items if len(i.created_at or "") >= 10}
    if len(dates) >= 2 and not _years(text) and not re.search(r"\d{4}-\d{2}-\d{2}", text):
        failures.append("dates_missing: evidence spans multiple dates but answer contains no date markers")
        soft = True
    known = {i.id for i in items}
    stray = [i for i in ids if i not in known]
    if stray or len(ids) > len(items):
        failures.append(f"invalid_citation: {stray[0]} not in {sorted(known)}" if stray else f"citation_overflow: {len(ids)} citations for {len(items)} evidence items")
        hard = True
    inflated = next((p for p in _DEFINITE if p in text.lower()), None) if status == PARTIAL else None
    if inflated:
        failures.append(f"status_inflation: '{inflated}' in partially_supported answer")
    words = [i.excerpt.lower().split() for i in items]
    lowered = text.lower()
    if items and not any(" ".join(w[k : k + 4]) in lowered for w in words for k in range(len(w) - 3)):
        failures.append("no_evidence_grounding: answer does not contain any 4-word sequence from evidence excerpts")
        soft = True
    return ("valid" if not failures else "degraded" if soft and not hard else "invalid"), failures
