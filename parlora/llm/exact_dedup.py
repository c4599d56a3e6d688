"""Exact dedup against history by a minimal perfect hash.

The distinct SHA-256 digests of historical documents are cut into shards; each shard gets a minimal perfect hash
(levels of bit arrays, as in BBHash) whose slots hold the full digest and the locator of the winner, the least
``doc_id``. The distinct digests of new documents go to their shard, look up their slot and compare all 32 bytes: equal
ones repeat a historical document. The rest were grouped by digest among themselves. Shards hold a bounded number of
digests of either side, so their number grows with the larger one, however often a text stands there or how its ids lie;
nothing is broadcast.

Cases: a null text equals nothing and its row always stays; the empty text is a text. Among equal texts the least
``doc_id`` wins and a null ``doc_id`` comes last; where all are null, the winner is null too. Repeated rows (same ``doc_id``, same text) are copies, of which one
stays. Extra columns are carried by the filter whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .shingles import U64, mix
from .ship import ship

#: Digests in a shard of the perfect hash, about.
SHARD = 1 << 16
_GAMMA = 1.6
_NONE = np.iinfo(np.int64).max


def _positions(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(k1 ^ mix(k2 + U64(level + 1))) % U64(size)).astype(np.int64)


def build_mph(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (bool) of the levels of a minimal perfect hash over distinct digests (n x 4 uint64)."""
    k1, k2, levels = digests[:, 0], digests[:, 1] ^ digests[:, 2] ^ digests[:, 3], []
    while len(k1):
        if len(levels) > 60:
            raise ValueError("digests aren't distinct")
        size = max(8, int(len(k1) * _GAMMA))
        at = _positions(k1, k2, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = ~alone[at]
        k1, k2 = k1[rest], k2[rest]
    return levels


def mph_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 for some that are no members (others get a slot that isn't theirs)."""
    k1, k2 = digests[:, 0], digests[:, 1] ^ digests[:, 2] ^ digests[:, 3]
    slot, todo, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, alone in enumerate(levels):
        if not len(todo):
            break
        at = _positions(k1[todo], k2[todo], level, len(alone))
        rank = np.cumsum(alone) - 1
        hit = alone[at]
        slot[todo[hit]] = base + rank[at[hit]]
        base += int(alone.sum())
        todo = todo[~hit]
    return slot


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), U64).reshape(-1, 4)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    levels = build_mph(words)
    slot = mph_slots(levels, words)
    digests, winners = np.empty_like(words), np.empty(len(words), np.int64)
    digests[slot], winners[slot] = words, pdf["winner"].fillna(_NONE).astype(np.int64)
    sizes = np.array([len(x) for x in levels], np.int64)
    bits = b"".join(np.packbits(x).tobytes() for x in levels)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [sizes.tobytes()], "bits": [bits], "digests": [digests.tobytes()], "winners": [winners.tobytes()]})


def _look_up(new: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    winner = new["first"].astype("Int64").reset_index(drop=True)
    if len(new) and len(table):
        row = table.iloc[0]
        levels, at = [], 0
        for size in np.frombuffer(row["sizes"], np.int64):
            nbytes = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(row["bits"], np.uint8, nbytes, at), count=size).astype(bool))
            at += nbytes
        words = _words(new["digest"])
        slot = mph_slots(levels, words)
        digests, winners = np.frombuffer(row["digests"], U64).reshape(-1, 4), np.frombuffer(row["winners"], np.int64)
        member = slot >= 0
        member[member] = (digests[slot[member]] == words[member]).all(axis=1)
        at = np.flatnonzero(member)
        own = winners[slot[at]]
        winner[at] = pd.array(np.where(own == _NONE, 0, own), "Int64")
        winner[at[own == _NONE]] = pd.NA
    return pd.DataFrame({"digest": new["digest"].reset_index(drop=True), "winner": winner})


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256))


def assign_winners(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, n, winner): each distinct (doc_id, text) of ``docs``, its rows, and the ``doc_id`` that wins.

    ``history`` (doc_id, text) are documents taken in before. Without it the table is its own history: the documents
    up to about the median ``doc_id`` form it and the rest are looked up in it. Rows with null text are
    left out.
    """
    ship(docs.sparkSession)
    keyed = lambda df: df.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = materialize(keyed(docs), "digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        old, new = (rows.where(F.lit(False)), rows) if middle is None else (rows.where(F.col("doc_id") <= middle), rows.where((F.col("doc_id") > middle) | F.col("doc_id").isNull()))
    else:
        old, new = keyed(history), rows
    known = materialize(old.groupBy("digest").agg(F.min("doc_id").alias("winner")), "history")
    asked = materialize(new.groupBy("digest").agg(F.min("doc_id").alias("first")), "asked")
    shards = max(1, -(-max(known.count(), asked.count()) // SHARD))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards))
    tables = known.withColumn("shard", shard).groupBy("shard").applyInPandas(_build, "shard long, sizes binary, bits binary, digests binary, winners binary")
    found = asked.withColumn("shard", shard).groupBy("shard").cogroup(tables.groupBy("shard")).applyInPandas(_look_up, "digest binary, winner long")
    result = new.join(materialize(found, "probed"), "digest")
    if history is None:
        result = result.union(old.join(known, "digest").select(*result.columns))
    return result.select("doc_id", "digest", "n", "winner")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each document that stays: ``doc_id``, the number of ``copies`` that go, and their ids ``removed``.

    With ``history`` a text that it holds stays under its historical ``doc_id``, and all its rows in ``docs`` go.
    """
    each = assign_winners(docs, history)
    own = F.col("doc_id").eqNullSafe(F.col("winner"))
    kept = F.lit(0 if history is not None else 1)
    found = each.groupBy("digest").agg(
        F.first("winner").alias("doc_id"),
        (F.sum("n") - kept).alias("copies"),
        F.sort_array(F.collect_list(F.when(~own, F.col("doc_id")))).alias("removed"),
    ).select("doc_id", "copies", "removed")
    null = docs.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("copies"), F.array().cast("array<long>").alias("removed"))
    return found.unionByName(null)


def drop_exact_copies(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row for each distinct text, that of the least ``doc_id``; rows with null text all stay."""
    each = materialize(assign_winners(docs, history), "winners")
    loser = ~F.col("doc_id").eqNullSafe(F.col("winner"))
    gone = each.where(F.lit(True) if history is not None else loser).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"), F.col("text").isNull().alias("__null"), _digest().alias("__sha"))
    left = packed.join(gone, (F.col("__sha") == F.col("__digest")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_anti")
    twice = each.where((F.col("n") > 1) & ~loser).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    if history is None and twice.take(1):
        on = (F.col("__sha") == F.col("__digest")) & F.col("__doc").eqNullSafe(F.col("__id"))
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates(["__sha"]))
    return left.select("__row.*")
