"""Language ID by rank-order n-gram profiles (out-of-place distance).

A text is lowered, its letters are kept and every other run becomes one ``_``. Its n-grams are all 1- to 3-grams of
that string, except ``_`` alone and those with ``_`` inside. The ``size`` most frequent ones (ties by code point
order) form a profile. A language's profile comes from all documents that carry its label. The distance of a document
to a language is the sum over the document's profile of the difference of ranks, or ``size`` for an n-gram that the
language's profile lacks; the least distance wins, ties by name. A document is accepted up to a limit that the
distances of all labelled documents set, for each language and number of n-grams.

Cases: null texts and texts without letters have no n-grams, no language, and are rejected. Documents without a
label (null or empty) train nothing but are identified. With no labelled document nothing is identified. Rows are
judged one by one, so repeated rows and null or repeated ``doc_id`` are kept as they are, and the filter carries extra
columns whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .ship import give_back, ship

#: N-grams in a profile.
SIZE = 300
#: A document whose distance is more than this share of the largest possible one is in none of the languages, whatever
#: the labelled documents' limits.
MOST = 0.9
#: Words in the beginnings of labelled documents that are judged for the limits.
CUTS = (1, 3, 8, 20, 50)
#: Evidence that a limit needs; distances beyond the median by more than FENCE times that of the 99th percentile don't
#: raise it; its factor for documents yet unseen.
ENOUGH, FENCE, SLACK = 20, 2.5, 1.02
#: (language or null, power of two of the n-grams): largest accepted share.
Limits = dict[tuple[str | None, int], float]
_CHUNK = 1 << 19
_BOUND = ord("_")


def normalized(text: Column) -> Column:
    """The letters of a text, lowered, with ``_`` for any other run and at both ends."""
    return F.regexp_replace(F.concat(F.lit("_"), F.lower(text.cast("string")), F.lit("_")), r"[^\p{L}]+", "_")


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > _CHUNK:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-32-le") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint32), np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))


def _positions(codes: np.ndarray) -> list[np.ndarray]:
    """Where a 1-, 2- and 3-gram begins. Every text begins and ends with ``_``, so none of these spans two texts."""
    letter = codes != _BOUND
    return [
        np.flatnonzero(letter),
        np.flatnonzero(letter[:-1] | letter[1:]) if len(codes) > 1 else np.empty(0, np.int64),
        np.flatnonzero(letter[1:-1]) if len(codes) > 2 else np.empty(0, np.int64),
    ]


def _packed(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers to the base, positions); integers are ordered as the strings."""
    c, at = codes.astype(np.int64), _positions(codes)
    two = c[at[1]] * base * base + c[at[1] + 1] * base if len(at[1]) else at[1]
    three = (c[at[2]] * base + c[at[2] + 1]) * base + c[at[2] + 2] if len(at[2]) else at[2]
    return np.concatenate((c[at[0]] * base * base, two, three)), np.concatenate(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for a, b in _chunks(texts):
            codes, sizes = _codes(texts[a:b])
            names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
            owner = np.repeat(which, sizes)
            for k, name in enumerate(names):
                grams, n = np.unique(_packed(codes[owner == k], 1 << 21)[0], return_counts=True)
                parts = totals.setdefault(str(name), [])
                parts.append((grams, n))
                if len(parts) > 50:
                    totals[str(name)] = [merged(parts)]
    for name, parts in totals.items():
        grams, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
    give_back()


def train_profiles(docs: DataFrame, size: int = SIZE) -> dict[str, list[int]]:
    """The profile of each label in ``lang``: packed n-grams, the most frequent first. At most ``size`` a language."""
    ship(docs.sparkSession)
    labelled = docs.where("text is not null and lang is not null and lang <> ''").select(F.col("lang").cast("string").alias("lang"), normalized(F.col("text")).alias("text"))
    counts = labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in best.select("lang", "rank", "gram").orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Language profiles ready for lookups."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(profiles), size
        vocabulary = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.chars = np.stack((vocabulary >> 42, (vocabulary >> 21) & 0x1FFFFF, vocabulary & 0x1FFFFF), axis=1) if len(vocabulary) else np.empty((0, 3), np.int64)
        self.ranks = np.full((len(self.names), len(vocabulary) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(vocabulary, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language or -1, its distance, n-grams in the profile) of normalized texts."""
        codes, sizes = _codes(texts)
        alphabet, small = np.unique(codes, return_inverse=True)
        base, n = len(alphabet) + 1, len(texts)
        if base**3 * n >= 1 << 62 and n > 1:
            parts = [self.score([t]) for t in texts]
            return tuple(np.concatenate(x) for x in zip(*parts))
        grams, at = _packed_small(codes, small + 1, base)
        owner = np.repeat(np.arange(n), sizes)[at]
        keys, counts = np.unique(owner * base**3 + grams, return_counts=True)
        owner, grams = keys // base**3, keys % base**3
        order = np.argsort(owner * (int(counts.max(initial=0)) + 1) - counts, kind="stable")
        begin = np.searchsorted(owner, np.arange(n + 1))
        rank = np.arange(len(order)) - np.repeat(begin[:-1], np.diff(begin))
        top = rank < self.size
        owner, grams, rank = owner[order][top], grams[order][top], rank[top]
        used = np.bincount(owner, minlength=n)
        if not self.names:
            return np.full(n, -1), np.zeros(n, np.int64), used
        ids = np.zeros(self.chars.shape, np.int64)
        known = np.ones(len(self.chars), bool)
        for j in range(3):
            c = self.chars[:, j]
            p = np.minimum(np.searchsorted(alphabet, c), max(len(alphabet) - 1, 0))
            there = (alphabet[p] == c) if len(alphabet) else np.zeros(len(c), bool)
            ids[:, j] = np.where(c == 0, 0, p + 1)
            known &= there | (c == 0)
        own = np.where(known, (ids[:, 0] * base + ids[:, 1]) * base + ids[:, 2], -1)
        by = np.argsort(own, kind="stable")
        p = np.minimum(np.searchsorted(own[by], grams), len(own) - 1)
        slot = np.where(own[by][p] == grams, by[p], len(own))
        distances = np.empty((len(self.names), n), np.int64)
        for k in range(len(self.names)):
            r = self.ranks[k][slot]
            out = np.where(r < 0, self.size, np.abs(r - rank))
            distances[k] = np.bincount(owner, out, n).astype(np.int64)
        best = distances.argmin(axis=0)
        return np.where(used > 0, best, -1), np.where(used > 0, distances[best, np.arange(n)], 0), used


def _packed_small(codes: np.ndarray, ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    c, at = ids.astype(np.int64), _positions(codes)
    two = c[at[1]] * base * base + c[at[1] + 1] * base if len(at[1]) else at[1]
    three = (c[at[2]] * base + c[at[2] + 1]) * base + c[at[2] + 2] if len(at[2]) else at[2]
    return np.concatenate((c[at[0]] * base * base, two, three)), np.concatenate(at)


def _judge(known: Profiles, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [known.score(texts[a:b]) for a, b in _chunks(texts)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3


def _cuts(known: Profiles, texts: list[str | None], labelled: np.ndarray) -> list[list[dict]]:
    """For each labelled text, how its beginnings of so many words are judged."""
    out: list[list[dict]] = [[] for _ in texts]
    owner, cuts = [], []
    for i in np.flatnonzero(labelled):
        words = (texts[i] or "")[: 20 * CUTS[-1]].split("_", CUTS[-1] + 2)[1:-1]
        for n in CUTS:
            if n < len(words):
                owner.append(i)
                cuts.append("_".join(("", *words[:n], "")))
    for i, k, distance, n in zip(owner, *_judge(known, cuts)):
        if k >= 0:
            out[i].append({"detected": known.names[k], "distance": int(distance), "n_grams": int(n)})
    return out


def _verdict(profiles: dict[str, list[int]], size: int):
    known = Profiles(profiles, size)

    @F.pandas_udf("detected string, distance long, n_grams int, cuts array<struct<detected: string, distance: long, n_grams: int>>")
    def verdict(texts: pd.Series, labelled: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else None for t in texts]
        best, distance, used = _judge(known, values)
        names = np.array([*known.names, None], object)
        out = pd.DataFrame({"detected": names[best], "distance": distance, "n_grams": used.astype(np.int32), "cuts": _cuts(known, values, labelled.to_numpy(bool))})
        give_back()
        return out

    return verdict


def _judged(docs: DataFrame, profiles: dict[str, list[int]], size: int, carried: Column, cut: bool) -> DataFrame:
    """(__row, __v, __labelled) of every row."""
    ship(docs.sparkSession)
    labelled = F.coalesce(F.col("lang").cast("string") != "", F.lit(False)) if cut else F.lit(False)
    return docs.select(carried.alias("__row"), _verdict(profiles, size)(normalized(F.col("text")), labelled).alias("__v"), labelled.alias("__labelled"))


def _bucket(n_grams: Column) -> Column:
    return F.floor(F.log2(n_grams)).cast("int")


def _limits(judged: DataFrame, size: int, most: float) -> Limits:
    """Limits from the labelled rows of ``_judged``; quantiles are exact, over shares rounded up to thousandths."""
    own = judged.where("__labelled")
    whole = own.select("__v.detected", "__v.distance", "__v.n_grams", F.lit(True).alias("whole")).where("n_grams > 0")
    cuts = own.select(F.explode("__v.cuts").alias("c")).select("c.*", F.lit(False).alias("whole"))
    every = whole.union(cuts).select("detected", _bucket(F.col("n_grams")).alias("bucket"), "whole", (F.ceil(1000 * F.col("distance") / (size * F.col("n_grams"))) / 1000).alias("share"))
    shares = every.groupBy("detected", "bucket", "whole", "share").agg(F.count("*").alias("n"))
    pooled = shares.groupBy("bucket", "whole", "share").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("detected"), "bucket", "whole", "share", "n")
    by = Window.partitionBy("detected", "bucket")
    full = F.when(F.col("whole"), F.col("share"))
    at = lambda c, p: F.percentile(c, p, F.col("n")).over(by)
    spread = shares.union(pooled).select("*", at(full, 0.5).alias("mid"), at(full, 0.99).alias("high"), at(F.col("share"), 0.99).alias("usual"))
    within = F.when(full <= F.col("mid") + FENCE * (F.col("high") - F.col("mid")) + 1e-9, full)
    rows = spread.groupBy("detected", "bucket").agg(F.sum("n").alias("n"), F.max(within).alias("most"), F.max("usual").alias("usual"))
    rows = rows.where(F.col("n") >= ENOUGH).select("detected", "bucket", (F.greatest("most", "usual") * SLACK).alias("limit")).collect()
    return {(r["detected"], r["bucket"]): min(most, r["limit"]) for r in rows}


def train_limits(docs: DataFrame, profiles: dict[str, list[int]], size: int = SIZE, most: float = MOST) -> Limits:
    """The largest accepted share of a language and a number of n-grams (as a power of two), from all labelled documents.

    Evidence are the distances of the documents and of their beginnings, so short texts have limits of their own. A
    limit is the farthest document that isn't far out (``FENCE``), or the 99th percentile with beginnings, and some
    ``SLACK``. Where a language has less than ``ENOUGH`` evidence all languages count together (language null), and
    where these have too little, ``most`` stays.
    """
    return _limits(materialize(_judged(docs, profiles, size, F.lit(True), True), "judged"), size, most)


def _accepted(v: str, limits: Limits | None, size: int, most: float) -> Column:
    limit = F.lit(most)
    if limits:
        names = sorted({name for name, _ in limits if name is not None})
        bucket, known = _bucket(F.col(f"{v}.n_grams")), F.lit(None).cast("double")
        table = lambda of: F.create_map(*(F.lit(x) for b, m in sorted(of.items()) for x in (b, m)))
        of = {name: {b: m for (n, b), m in limits.items() if n == name} for name in [*names, None]}
        if names:
            known = F.element_at(F.element_at(F.create_map(*(x for n in names for x in (F.lit(n), table(of[n])))), F.col(f"{v}.detected")), bucket)
        limit = F.coalesce(known, F.element_at(table(of[None]), bucket) if of[None] else F.lit(None), limit)
    far = F.col(f"{v}.distance") <= limit * size * F.col(f"{v}.n_grams")
    return F.coalesce(F.col(f"{v}.detected").isNotNull() & far, F.lit(False))


def _decided(docs: DataFrame, carried: Column, profiles: dict[str, list[int]] | None, size: int, most: float, limits: Limits | None) -> DataFrame:
    if profiles is not None:
        judged = _judged(docs, profiles, size, carried, False)
    else:
        judged = materialize(_judged(docs, train_profiles(docs, size), size, carried, limits is None), "judged")
        limits = _limits(judged, size, most) if limits is None else limits
    return judged.select("__row", "__v", _accepted("__v", limits, size, most).alias("__accepted"))


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]] | None = None, size: int = SIZE, most: float = MOST, limits: Limits | None = None) -> DataFrame:
    """(doc_id, detected, distance, n_grams, accepted) of every row of ``docs``.

    ``profiles`` and ``limits`` default to those of the labels in ``docs`` itself; with given profiles and no limits
    only ``most`` holds. ``accepted`` is false for a row without n-grams or farther from its best language than that
    share of the largest possible distance.
    """
    out = _decided(docs, F.col("doc_id"), profiles, size, most, limits)
    return out.select(F.col("__row").alias("doc_id"), "__v.detected", "__v.distance", "__v.n_grams", F.col("__accepted").alias("accepted"))


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]] | None = None, size: int = SIZE, most: float = MOST, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is identified, unchanged."""
    return _decided(docs, F.struct("*"), profiles, size, most, limits).where("__accepted").select("__row.*")
