"""The text functions for single strings, for stages that work on a handful of rows of one query."""

from __future__ import annotations

import re

from .. import constants as C


def tokens(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits, lowered."""
    return re.findall("[a-z0-9]+", (text or "").lower())


def cut(text: str, most: int) -> str:
    """At most ``most`` characters, ending in dots where cut."""
    return text if len(text) <= most else text[: most - 3] + "..."


def blank_to_none(value: object) -> str | None:
    """A stripped string, or nothing."""
    return (value.strip() or None) if isinstance(value, str) else None


def evidence_excerpt(text: object) -> str | None:
    """The collapsed text, cut; nothing for a blank one."""
    whole = " ".join(text.split()) if isinstance(text, str) else ""
    return cut(whole, C.EVIDENCE_EXCERPT) or None


def query_terms(query: str) -> tuple[str, ...]:
    """Distinct tokens in order."""
    return tuple(dict.fromkeys(tokens(query)))


def focus_terms(query: str) -> tuple[str, ...]:
    """Query terms that aren't question words; all of them if none is left."""
    terms = query_terms(query)
    return tuple(t for t in terms if len(t) > 1 and t not in C.QUESTION_STOPWORDS) or terms


def content_terms(text: str) -> set[str]:
    """Lowered words of four ASCII letters or more, without stopwords."""
    return {w.lower() for w in re.findall("[A-Za-z]{4,}", text)} - C.COHERENCE_STOPWORDS


def entity_terms(text: str) -> set[str]:
    """Capitalized words that may be names."""
    return set(re.findall(r"\b[A-Z][a-z]{2,}\b", text)) - C.NON_ENTITIES


def canonical(name: str) -> str:
    """The canonical spelling of a name."""
    return C.ALIASES.get(name, name)


def jaccard(a: set, b: set) -> float:
    """Shared over all; 0 if either is empty."""
    return len(a & b) / len(a | b) if a and b else 0.0


def date_of(stamp: str | None) -> str | None:
    """The date a stamp begins with."""
    found = re.match(r"\d{4}-\d{2}-\d{2}", stamp or "")
    return found[0] if found else None


def days_between(a: str, b: str) -> int:
    """The rough distance in days (365 a year, 30 a month); 999 if a date can't be read."""
    try:
        x, y = (int(d[:4]) * 365 + int(d[5:7]) * 30 + int(d[8:10]) for d in (a, b))
    except ValueError:
        return 999
    return abs(x - y)
