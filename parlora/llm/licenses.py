"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by a stretch length m, a power of two with room for a fifth of a template more; a text is cut
into windows of 2m token bigrams, each m after the last, so every stretch of m tokens lies whole in some window. Each
MinHash value is a band of one row, and a group has as many bands as retrieve a window that holds the share
``containment`` of a template's bigrams with the probability ``GUARANTEE``. Windows with fewer bigrams of the group's
templates than that share can't hold one and aren't hashed.

In the windows retrieved for a template its occurrences are read from left to right, exactly: a stretch of at most m
tokens that holds the share ``containment`` of the template's distinct bigrams or more. One ends where this share is reached,
begins without bigrams that it holds more often than the template, goes on up to the last of the template's bigrams
before one that would be too many, and the next begins after it, so every disjoint occurrence is a find.

Cases: null and empty texts hold no license; a text shorter than a window is one window. Repeated rows and null or
repeated ``doc_id`` are scanned row by row. Occurrences of one template don't overlap; those of different templates
may, and each is a find. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shingles import U64, chunks, gram_hashes, minhash, minhash_family, token_hashes
from .ship import ship

CONTAINMENT = 0.85
GUARANTEE = 0.9999
N = 2


class Group:
    """Templates that share a stretch length ``m``."""

    def __init__(self, m: int, members: list[int], sets: list[np.ndarray], needs: list[int], guarantee: float) -> None:
        self.m, self.members = m, members
        self.least = min(needs[i] for i in members)
        worst = min(needs[i] / (2 * m + len(sets[i]) - needs[i]) for i in members)
        self.bands = math.ceil(math.log(1 - guarantee) / math.log(1 - worst)) if worst < 1 else 1
        self.family = minhash_family(self.bands, 0x11CE)
        off = np.concatenate(([0], np.cumsum([len(sets[i]) for i in members])))
        self.signs = minhash(np.concatenate([sets[i] for i in members]), off, self.family)


class Scanner:
    """Templates ready for retrieval."""

    def __init__(self, templates: dict[str, str], containment: float, guarantee: float) -> None:
        self.names = sorted(templates)
        tokens, off = token_hashes([templates[n].lower().encode() for n in self.names])
        grams, goff = gram_hashes(tokens, off, N)
        self.sets = [np.unique(grams[a:b]) for a, b in zip(goff[:-1], goff[1:])]
        self.times = [Counter(grams[a:b].tolist()) for a, b in zip(goff[:-1], goff[1:])]
        self.needs = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        by: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(off)):
            if len(self.sets[i]):
                by.setdefault(1 << max(1, (math.ceil(1.2 * n) - 1).bit_length()), []).append(i)
        self.groups = [Group(m, by[m], self.sets, self.needs, guarantee) for m in sorted(by)]
        self.every = np.unique(np.concatenate(self.sets)) if by else np.empty(0, U64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.every >> U64(48)).astype(np.int64)] = True
        #: For each template bigram, a bit for each group that has it.
        self.of_group = np.zeros(len(self.every), np.int64)
        for k, group in enumerate(self.groups):
            for i in group.members:
                self.of_group[np.searchsorted(self.every, self.sets[i])] |= 1 << k

    def marks(self, grams: np.ndarray) -> np.ndarray:
        """For each bigram of a slice of texts, the bits of the groups that have it."""
        out = np.zeros(len(grams), np.int64)
        at = np.flatnonzero(self.filter[(grams >> U64(48)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.every, grams[at]), len(self.every) - 1)
            out[at] = np.where(self.every[place] == grams[at], self.of_group[place], 0)
        return out

    def scan(self, grams: np.ndarray, hits: np.ndarray, group: Group) -> list[tuple[int, float, int, int]]:
        """(template, containment, first token, token after the last) of a group's finds; ``hits`` counts its bigrams."""
        m, found = group.m, []
        begin = np.arange(0, max(len(grams) - m, 1), m)
        dense = np.flatnonzero(hits[np.minimum(begin + 2 * m, len(grams))] - hits[begin] >= group.least)
        if not len(dense):
            return []
        blocks, inverse = np.unique(np.concatenate((dense, dense + 1)), return_inverse=True)
        parts = [grams[b * m : (b + 1) * m] for b in blocks]
        signs = minhash(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))), group.family)
        signs = np.minimum(signs[inverse[: len(dense)]], signs[inverse[len(dense) :]])
        for i, sign in zip(group.members, group.signs):
            met = dense[(signs == sign).any(axis=1)]
            if len(met):
                for run in np.split(met, np.flatnonzero(np.diff(met) > 2) + 1):
                    a = int(begin[run[0]])
                    found += [(i, s, a + x, a + y) for s, x, y in self.occurrences(grams[a : int(begin[run[-1]]) + 2 * m], i, m)]
        return found

    def occurrences(self, own: np.ndarray, i: int, m: int) -> list[tuple[float, int, int]]:
        """(containment, first token, token after the last) of template ``i`` in consecutive bigrams."""
        at = np.flatnonzero(np.isin(own, self.sets[i]))
        values, out, left, r = own[at].tolist(), [], 0, 0
        at, longest = at.tolist(), max(1, m - 1)
        seen: dict[int, int] = {}
        while r < len(at):
            seen[values[r]] = seen.get(values[r], 0) + 1
            while at[r] - at[left] >= longest:
                left = self._without(seen, values, left)
            if len(seen) >= self.needs[i]:
                times = self.times[i]
                while seen[values[left]] > times[values[left]]:
                    left = self._without(seen, values, left)
                while r + 1 < len(at) and at[r + 1] - at[left] < longest and seen.get(values[r + 1], 0) < times[values[r + 1]]:
                    r += 1
                    seen[values[r]] = seen.get(values[r], 0) + 1
                out.append((len(seen) / len(self.sets[i]), at[left], at[r] + N))
                left, seen = r + 1, {}
            r += 1
        return out

    @staticmethod
    def _without(seen: dict[int, int], values: list[int], left: int) -> int:
        seen[values[left]] -= 1
        if not seen[values[left]]:
            del seen[values[left]]
        return left + 1


def _run(templates: dict[str, str], containment: float, guarantee: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, containment, guarantee)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, _, raws in chunks(texts):
                grams, goff = gram_hashes(*token_hashes(raws), N)
                marks = scanner.marks(grams)
                for k, group in enumerate(scanner.groups):
                    hits = np.concatenate(([0], np.cumsum((marks >> k) & 1)))
                    for d in np.flatnonzero(hits[goff[1:]] - hits[goff[:-1]] >= group.least):
                        x, y = goff[d], goff[d + 1]
                        for i, share, first, last in scanner.scan(grams[x:y], hits[x : y + 1], group):
                            rows.append((ids[a + d], scanner.names[i], share, first, last))
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "license", "containment", "start_token", "end_token"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, guarantee: float = GUARANTEE) -> DataFrame:
    """(doc_id, license, containment, start_token, end_token): every disjoint occurrence of a template in every text."""
    ship(docs.sparkSession)
    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_run(TEMPLATES if templates is None else templates, containment, guarantee), "doc_id long, license string, containment double, start_token int, end_token int")
