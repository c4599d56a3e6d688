"""PII by bootstrapped contextual extraction.

Candidates are the spans of a text that hold a digit, ``@``, or ``=`` or ``:`` within a word, and all other strings of
the strict rule. Each induces lexical patterns: its shape (runs of letters and digits), its literal prefix with the shape
of the rest, and its shape beside the one or two words before it or the word after it. The same words with only a
coarse class of the string are patterns too, so a string of a shape that no seed has is found by its context; such a
pattern also needs the share ``trust`` of all its strings, labelled or not. Patterns and candidate strings form a graph.
Seed entities of each kind, and seeds that are no identifiers, label some strings; then iterations alternate in Spark: a
pattern is trusted for a kind when nearly all labelled weight on it is of that kind and enough distinct strings support
it, and a string takes the noisy-or of its trusted patterns. Accepted strings stay accepted and raise further patterns,
until a round accepts nothing new. Then the plain words that stand in trusted contexts are counted over all texts: a
context where they leave the accepted strings less than the share ``trust`` is dropped for good, and those of the others
join the candidates. The graph is scored again until no further context is trusted. Every occurrence of an accepted
string is a find.

The seeds are all strings that a strict rule accepts, so each of them is a find, and those that a caller gives, which
may be of other kinds; all documents, candidates and patterns take part in the graph.

Cases: null and empty texts hold nothing. A find names its row's ``doc_id``, null included; repeated rows give
repeated finds. A string accepted for several kinds gets the most certain one, ties by name. Neighbouring words of over
64 characters stand in patterns by their digest. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .ship import ship

KINDS = ("card", "email", "iban", "ip", "phone", "secret", "ssn")
NONE = "none"
#: Begins a pattern of the words around a span that doesn't hold its shape.
CONTEXT = "C"
#: Contexts that one pass over the texts looks for, about.
PASS = 100_000
_MARK = re.compile(r"[0-9@]|(?<=\w)[=:](?=[^\s/])|AKIA[A-Z]{16}|(?<![\w])[a-f]{40}(?!\w)")
#: Letters of the shortest mark that has nothing else.
_SHORTEST_MARK = 20
_LONG_WORD = 64
_WORD = re.compile(r"\S+")
_PHONE = re.compile(r"[+(][0-9(][0-9()+. -]*[0-9]")
_QUOTED = re.compile(r"""["'“‘(\[<{]+""")
_TAIL = re.compile(r"""[^\w=+/-]+$""")
_RUN = re.compile(r"[0-9]+|[A-Z]+|[^\W\d_A-Z]+")
_HEXLIKE = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|(?=[0-9A-Z]*[0-9])(?=[0-9A-Z]*[A-Z])[0-9A-Z]{12,}|(?=\w*[0-9])(?=\w*[a-z])(?=\w*[A-Z])\w{16,}")
_PREFIX = re.compile(r"[A-Za-z_]+[=:]|AKIA|(?:[A-Za-z]{2,8}[-_]){1,2}(?=\w{8})")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, string) of the spans that may identify someone."""
    out, done = [], 0
    for mark in _MARK.finditer(text):
        p = mark.start()
        if p < done:
            continue
        a, b = p, p
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        phone = next((m for q in (a, p - 1) if q >= 0 and (m := _PHONE.match(text, q)) and m.end() > p), None)
        if phone:
            a, b = phone.span()
        else:
            lead = _QUOTED.match(text, a, b)
            a = lead.end() if lead and lead.end() <= p else a
            tail = _TAIL.search(text, p, b)
            b = tail.start() if tail else b
        done = max(b, p + 1)
        if b > a:
            out.append((a, b, text[a:b]))
    return out


def _length(n: int) -> str:
    return str(n) if n <= 4 else "5-8" if n <= 8 else "9-12" if n <= 12 else "13-19" if n <= 19 else "20+"


def shape(value: str) -> str:
    """Runs of digits, capitals and letters by length class; a mixed token of letters and digits is one run."""
    if _HEXLIKE.fullmatch(value):
        return f"x{_length(len(value))}"
    if value.count("@") == 1:
        name, host = value.split("@")
        return f"{re.sub(r'[^\W_]+', 'w', name)}@{re.sub(r'[^\W_]+', 'w', host)}"
    return _RUN.sub(lambda m: ("9" if m[0][0].isdigit() else "A" if m[0].isupper() else "a") + (_length(len(m[0])) if m[0][0].isdigit() else ""), value)


def _coarse(value: str) -> str:
    """The class of a string: with ``@``, with letters, or digits, and whether it is as long as an identifier."""
    if value.isalpha():
        return "mixed" if len(value) < 8 else "MIXED"
    if "@" in value:
        return "@"
    digits = sum(c.isdigit() for c in value)
    if any(c.isalpha() for c in value):
        return "mixed" if len(value) < 8 else "MIXED"
    return "digits" if digits < 7 else "DIGITS"


def _named(word: str) -> str:
    low = word.lower()
    return low if len(low) <= _LONG_WORD else "#" + blake2b(low.encode("utf-8", "replace"), digest_size=16).hexdigest()


def neighbours(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    """The two words before a span, and the one after it; a part of a word that touches the span counts as one."""
    before: list[str] = []
    end = a
    while len(before) < 2 and end > 0:
        while end > 0 and text[end - 1].isspace():
            end -= 1
        begin = end
        while begin > 0 and not text[begin - 1].isspace():
            begin -= 1
        if begin < end:
            before.insert(0, _named(text[begin:end]))
        end = begin
    after = _WORD.search(text, b)
    return before, [_named(after[0])] if after else []


def contexts(before: list[str], after: list[str], kind: str) -> list[str]:
    """The patterns of the words around a span, with only the coarse class of its string."""
    out = []
    if before:
        out.append(f"{CONTEXT}L {before[-1]} {kind}")
    if len(before) == 2:
        out.append(f"{CONTEXT}M {before[0]} {before[1]} {kind}")
    if after:
        out.append(f"{CONTEXT}R {after[0]} {kind}")
    return out


def patterns(text: str, a: int, b: int, value: str) -> list[str]:
    """The lexical patterns of a span."""
    own = shape(value)
    before, after = neighbours(text, a, b)
    out = [f"S {own}"]
    prefix = _PREFIX.match(value)
    if prefix:
        out.append(f"P {prefix[0].lower()} {shape(value[prefix.end():])}")
    if before:
        out.append(f"L {before[-1]} {own}")
    if len(before) == 2:
        out.append(f"M {before[0]} {before[1]} {own}")
    if after:
        out.append(f"R {after[0]} {own}")
    return out + contexts(before, after, _coarse(value))


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def seed_kind(value: str) -> str | None:
    """The kind that a strict rule gives a string, ``none`` for harmless numbers, or null for neither."""
    if re.fullmatch(r"[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", value):
        return "email"
    if re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", value) and all(int(x) < 256 for x in value.split(".")) and int(value.split(".")[0]):
        return "ip"
    if re.fullmatch(r"[1-9]\d{12,18}", value) and luhn(value):
        return "card"
    if re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", value):
        return "ssn"
    if re.fullmatch(r"[A-Z]{2}\d{2}[0-9A-Z]{11,30}", value) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
        return "iban"
    if re.fullmatch(r"\+\d{1,3} ?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}", value):
        return "phone"
    if re.fullmatch(r"(?i:pass(?:word|wd)?|secret|token|api_?key)[=:]\S{8,}|AKIA[0-9A-Z]{16}|[0-9a-f]{40}", value):
        return "secret"
    if re.fullmatch(r"\d{1,4}(?:[.,:]\d{1,3}){0,2}%?|v?\d{1,2}(?:\.\d{1,3}){1,2}|\d{4}-\d{2}-\d{2}|https?://\S+", value):
        return NONE
    return None


_FOUND = "doc_id long, start int, end int, value string, seed string, patterns array<string>"


def _batch(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "end", "value", "seed", "patterns"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b, value in candidates(text):
                rows.append((doc_id, a, b, value, seed_kind(value), patterns(text, a, b, value)))
        if rows:
            yield _batch(rows)


class Wanted:
    """Contexts that texts are searched for, filed by what a text holds where one of them may be met.

    ``before`` and ``after`` are by the word next to the string. A part of the string's own word may be that too, so
    contexts of such parts are also in ``begins`` and ``ends``, by the first or last character of the whole word.
    """

    def __init__(self, patterns: Iterable[str]) -> None:
        self.patterns: set[str] = set(patterns)
        self.before: dict[str, set[str]] = {}
        self.after: dict[str, set[str]] = {}
        self.begins: dict[str, set[str]] = {}
        self.ends: dict[str, set[str]] = {}
        self.kinds: dict[str, set[str]] = {}
        for pattern in self.patterns:
            for table, key in self._filed(pattern):
                table.setdefault(key, set()).add(pattern)

    def _filed(self, pattern: str) -> list[tuple[dict[str, set[str]], str]]:
        side, *_, word, kind = pattern.split(" ")
        right = side == f"{CONTEXT}R"
        out = [(self.after if right else self.before, word), (self.kinds, kind)]
        if (_TAIL if right else _QUOTED).fullmatch(word):
            out.append((self.ends, word[-1]) if right else (self.begins, word[0]))
        return out

    def discard(self, pattern: str) -> None:
        self.patterns.discard(pattern)
        for table, key in self._filed(pattern):
            table[key].discard(pattern)
            if not table[key]:
                del table[key]


def _spots(low: str, wanted: Wanted) -> tuple[set[int], list[str]]:
    """The places of all words that may stand in a context, and the names of the words, of a text in lower case."""
    names, spots = low.split(), set()
    if wanted.begins and any(c in low for c in wanted.begins):
        spots.update(i for i, w in enumerate(names) if w[0] in wanted.begins)
    if wanted.ends and any(c in low for c in wanted.ends):
        spots.update(i for i, w in enumerate(names) if w[-1] in wanted.ends)
    if len(low) > _LONG_WORD and max(map(len, names), default=0) > _LONG_WORD:
        # A part of a long word may be named by its digest.
        spots.update(i for i, w in enumerate(names) if len(w) > _LONG_WORD)
        names = [w if len(w) <= _LONG_WORD else _named(w) for w in names]
    if not wanted.before.keys().isdisjoint(names):
        spots.update(i for i, w in enumerate(names, 1) if w in wanted.before)
    if not wanted.after.keys().isdisjoint(names):
        spots.update(i for i, w in enumerate(names, -1) if w in wanted.after)
    return spots, names


def plain_words(text: str, wanted: Wanted) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, word, contexts met) of the words without a mark of candidates that stand in one of the contexts."""
    spots, names = _spots(text.lower(), wanted)
    if not spots:
        return
    words, starts = text.split(), None
    for i in sorted(spots):
        if not 0 <= i < len(words):
            continue
        word = words[i]
        a, b = 0, len(word)
        if b >= _SHORTEST_MARK or not word.isalpha():
            if _MARK.search(word):
                continue
            lead, tail = _QUOTED.match(word), _TAIL.search(word)
            a, b = lead.end() if lead else a, tail.start() if tail else b
            if b <= a:
                continue
        value = word[a:b]
        kind = _coarse(value)
        if kind not in wanted.kinds:
            continue
        before = [*names[max(0, i - 1) : i], _named(word[:a])] if a else names[max(0, i - 2) : i]
        after = [_named(word[b:])] if b < len(word) else names[i + 1 : i + 2]
        met = [p for p in contexts(before, after, kind) if p in wanted.patterns]
        if met:
            if starts is None:
                starts = [m.start() for m in _WORD.finditer(text)]
            yield starts[i] + a, starts[i] + b, value, met


def _crowded(known: dict[str, int]):
    """(pattern, word): the distinct plain words of each context up to its allowance, and null where there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = Wanted(known), {}
        for batch in batches:
            for text in batch.column(1).to_pylist() if wanted.patterns else ():
                for _, _, value, met in plain_words(text, wanted):
                    for p in met:
                        own = seen.setdefault(p, set())
                        own.add(value)
                        if len(own) > known[p]:
                            seen[p] = None
                            wanted.discard(p)
        rows = [(p, v) for p, own in seen.items() for v in ([None] if own is None else own)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["pattern", "word"])

    return run


def _plain(known: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(known)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, a, b, value, None, patterns(text, a, b, value)) for a, b, value, _ in plain_words(text, wanted)]
            if rows:
                yield _batch(rows)

    return run


def score_graph(edges: DataFrame, seeds: DataFrame, support: int, trust: float, accept: float) -> tuple[DataFrame, DataFrame]:
    """(value, kind, score) of accepted strings and the trusted patterns, from ``edges(pattern, value)`` and ``seeds(value, kind)``.

    A pattern's weight for a kind is the sum of its strings' scores, and its trust the kind's share of that. A string that
    was accepted stays so with its best score, so the rounds come to an end.
    """
    edges = materialize(edges.distinct(), "edges")
    seeds = materialize(seeds.distinct(), "seeds")
    first = seeds.withColumn("score", F.lit(1.0))
    known, before, held = first, seeds.count(), None
    while True:
        weight = edges.join(known, "value", "left").groupBy("pattern", "kind").agg(F.sum("score").alias("w"), F.count("*").alias("n"))
        by = Window.partitionBy("pattern")
        share, of_all = F.col("w") / F.sum("w").over(by), F.col("n") / F.sum("n").over(by)
        certain = ~F.col("pattern").startswith(CONTEXT) | (F.col("of_all") >= trust)
        trusted = weight.withColumn("trust", share).withColumn("of_all", of_all).where(certain & (F.col("trust") >= trust) & (F.col("n") >= support) & (F.col("kind") != NONE))
        confidence = F.col("trust") * F.col("n") / (F.col("n") + 0.5)
        trusted = materialize(trusted.select("pattern", "kind", "n", confidence.alias("c")), "trusted")
        reached = edges.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.999)))))).alias("score"))
        fresh = reached.where(F.col("score") >= accept).join(seeds.select("value"), "value", "left_anti").select("value", "kind", "score")
        last, held = held, materialize(known.union(fresh).groupBy("value", "kind").agg(F.max("score").alias("score")), "known")
        if last is not None:
            discard(last)
        known, now = held, held.count()
        if now == before:
            break
        before = now
        discard(trusted)
    best = Window.partitionBy("value").orderBy(F.desc("score"), "kind")
    return known.where(F.col("kind") != NONE).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r"), trusted


def find_pii(docs: DataFrame, seeds: int | None = None, support: int = 5, trust: float = 0.9, accept: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, start, end, identifier, score): every occurrence of an identifier, by character offsets.

    Every string of the strict rule starts the bootstrap, and those of ``known`` (value, kind), whose kind goes before the
    rule's; a number of ``seeds`` leaves only that many of each kind, those with the least hash. A pattern needs
    ``support`` distinct labelled strings and the share ``trust`` of their weight in one kind; a string is accepted from
    the score ``accept`` on.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = materialize(source.mapInArrow(_extract, _FOUND), "candidates")
    chosen = found.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    if known is not None:
        given = known.select(F.col("value").cast("string").alias("value"), F.col("kind").cast("string").alias("kind")).where("value is not null and kind is not null")
        chosen = chosen.join(given.select("value"), "value", "left_anti").union(given)
    if seeds is not None:
        pick = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
        chosen = chosen.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= seeds).drop("r")
    chosen = materialize(chosen, "seeds")
    searched, dropped, words, every = None, None, None, found
    while True:
        edges = every.select(F.explode("patterns").alias("pattern"), "value")
        scored, trusted = score_graph(edges if dropped is None else edges.join(dropped, "pattern", "left_anti"), chosen, support, trust, accept)
        # No plain word holds the mark ``@``, so none stands in a context of that class.
        open_to_words = F.col("pattern").startswith(CONTEXT) & ~F.col("pattern").endswith(" @")
        fresh = trusted.where(open_to_words).groupBy("pattern").agg(F.floor(F.max("n") / F.lit(trust) - F.max("n") + 1e-9).cast("long").alias("allowed"))
        if searched is not None:
            fresh = fresh.join(searched, "pattern", "left_anti")
        fresh = materialize(fresh, "contexts")
        passes = -(-fresh.count() // PASS)
        if not passes:
            break
        of_pass = lambda k: fresh.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)  # noqa: B023, E731
        met = [source.mapInArrow(_crowded({r[0]: r[1] for r in of_pass(k).collect()}), "pattern string, word string") for k in range(passes)]
        counted = reduce(DataFrame.union, met).groupBy("pattern").agg(F.count_distinct("word").alias("n"), F.max(F.col("word").isNull()).alias("more"))
        counted = materialize(fresh.join(counted, "pattern"), "counted")
        over = F.col("more") | (F.col("n") > F.col("allowed"))
        gone, open_ = counted.where(over).select("pattern"), counted.where(~over).select("pattern")
        dropped = gone if dropped is None else dropped.union(gone)
        searched = fresh.select("pattern") if searched is None else searched.union(fresh.select("pattern"))
        if counted.isEmpty():
            break
        rounds = -(-open_.count() // PASS)
        for k in range(rounds):
            part = [r[0] for r in open_.where(F.pmod(F.xxhash64("pattern"), F.lit(rounds)) == k).collect()]
            # A word may stand in contexts of several passes; n tells repeated rows from that.
            rows = source.mapInArrow(_plain(part), _FOUND).groupBy(*found.columns).agg(F.count("*").alias("n"))
            words = materialize(rows if words is None else words.union(rows).groupBy(*found.columns).agg(F.max("n").alias("n")), "words")
        if words is not None:
            every = found.union(words.select(*found.columns, F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col"))
    return every.join(scored, "value").select("doc_id", "kind", "start", "end", F.col("value").alias("identifier"), "score")
