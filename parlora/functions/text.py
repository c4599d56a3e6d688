"""Column functions over texts: tokens, terms, excerpts, set measures. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def words_array(words: Iterable[str]) -> Column:
    """A literal array, in a fixed order."""
    return F.array(*[F.lit(w) for w in sorted(words)]) if words else F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """The text without white space at its ends, Unicode spaces and separators included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(text: Column) -> Column:
    """The stripped text; null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, _SPACE, " "))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lowered text, in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def normalized(text: Column) -> Column:
    """Tokens joined by one space."""
    return F.array_join(tokens(text), " ")


def searchable(text: Column, blocks: Column | None = None) -> Column:
    """The normalized text, or that of all blocks where the text is blank."""
    if blocks is None:
        return normalized(text)
    own = blank_to_null(text)
    parts = F.filter(F.transform(blocks, lambda b: blank_to_null(b["text"])), lambda t: t.isNotNull())
    return normalized(F.coalesce(own, F.array_join(parts, " ")))


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def evidence_excerpt(text: Column) -> Column:
    """The collapsed text, cut to the length of an evidence excerpt; null where blank."""
    return cut(F.nullif(collapse(text), F.lit("")), C.EVIDENCE_EXCERPT)


def content_tokens(text: Column) -> Column:
    """Distinct lowered words without ASCII punctuation and stopwords, for restatement tests."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    split = F.split(bare, _SPACE)
    return F.array_except(F.array_distinct(F.filter(split, lambda w: w != "")), words_array(C.RESTATEMENT_STOPWORDS))


def content_terms(text: Column) -> Column:
    """Distinct lowered words of four ASCII letters or more, without stopwords."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), words_array(C.COHERENCE_STOPWORDS))


def entity_terms(text: Column) -> Column:
    """Distinct capitalized words that may be names."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(found), words_array(C.NON_ENTITIES))


def canonical(entity: Column) -> Column:
    """The canonical spelling of a name."""
    table = F.create_map(*[F.lit(x) for pair in sorted(C.ALIASES.items()) for x in pair])
    return F.coalesce(table[entity], entity)


def alias_conflicts(entities: Column) -> Column:
    """Canonical names of which two spellings stand in an array of entities."""
    names = sorted(set(C.ALIASES.values()))
    spellings = {n: [n, *(k for k, v in C.ALIASES.items() if v == n)] for n in names}
    tests = [F.when(F.size(F.array_intersect(entities, words_array(spellings[n]))) >= 2, F.lit(n)) for n in names]
    return F.array_compact(F.array(*tests))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either array is empty."""
    either = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(either, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def coverage(terms: Column, focus: Column) -> Column:
    """The share of the distinct focus terms among ``terms``; 0 without focus terms."""
    return F.when(F.size(focus) > 0, F.size(F.array_intersect(terms, focus)) / F.size(F.array_distinct(focus))).otherwise(F.lit(0.0))


def meta_commentary(text: Column) -> Column:
    """Whether an assistant's text opens with one of the phrases that announce rather than say."""
    head = F.regexp_replace(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 80)), r"(?U)^[\s\x1c-\x1f]+", "")
    test = F.lit(False)
    for prefix in sorted(C.META_PREFIXES):
        test = test | F.startswith(head, F.lit(prefix))
    return test


def voice_factor(role: Column, text: Column | None = None, restates: Column | None = None) -> Column:
    """The factor of an author's role, lowered for an assistant's announcements and restatements."""
    factor = F.when(role == "user", F.lit(C.USER_VOICE)).otherwise(F.lit(C.OTHER_VOICE))
    assistant = F.coalesce(role == "assistant", F.lit(False))
    if text is not None:
        factor = factor * F.when(assistant & meta_commentary(text), F.lit(C.META_FACTOR)).otherwise(F.lit(1.0))
    if restates is not None:
        factor = factor * F.when(assistant & F.coalesce(restates, F.lit(False)), F.lit(C.RESTATEMENT_FACTOR)).otherwise(F.lit(1.0))
    return factor


def has_any(found: Column, cues: Iterable[str]) -> Column:
    """Whether an array holds one of the words."""
    return F.arrays_overlap(found, words_array(cues))


def possessive(query: Column) -> Column:
    """Whether a query joins two words by a possessive ``'s``."""
    return F.lower(query).rlike(r"\b[a-z0-9]+'s\s+[a-z0-9]+")
