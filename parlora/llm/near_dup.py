"""N-gram Jaccard join by MinHash banding.

Every document is compared with every other through bands of MinHash values; pairs that share a band are verified
on their full sets of word 3-gram hashes (64 bits). Documents with the same set are collapsed before that, so k copies
cost one comparison, not k*k. The sets of a bucket belong to its leader, the least of them; buckets with one leader are
verified together, once, because near copies meet in most of their bands. A large group is cut into blocks whose pairs
are verified apart, and no partner is dropped. The result is a row for each document with its class and its number of links,
so k copies are k rows; all pairs are given by ``ngram_jaccard_join``, whose rows grow with the square of a group.

Cases: a document whose text is null, empty or without tokens has no set and is in no pair; it is a class alone. Rows with a null
``doc_id`` can't be named in a result and are in no pair; the filter keeps them. Rows that share a ``doc_id`` are one
document, which stays or goes whole; one with several texts pairs by each of them, so a pair of it may come with
several values. Repeated rows aren't pairs. Ties at exactly the threshold count as pairs. Extra columns are carried by
the filter whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, only
from .shingles import U64, chunks, gram_hashes, minhash, minhash_family, mix, token_hashes, unique_sets
from .ship import give_back, ship

#: Distinct sets of one leader that are verified together at most; a larger group is cut into blocks.
BLOCK = 256


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands find a pair at the threshold with the wanted recall."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within most_hashes reaches this recall")
    return best


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    out = np.zeros((2, len(sets)), U64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        every = np.concatenate([sets[i] for i in filled])
        begin = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
        out[0, filled] = np.add.reduceat(mix(every), begin)
        out[1, filled] = np.add.reduceat(mix(every ^ U64(0xA5A5A5A5DEADBEEF)), begin)
    return out[0].view(np.int64), out[1].view(np.int64)


def _signatures(n: int, bands: int, rows: int):
    family = minhash_family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, bands * rows + 1, dtype=U64)).reshape(bands, rows) | U64(1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b, raws in chunks(texts):
                grams, goff = gram_hashes(*token_hashes(raws), n)
                filled = np.flatnonzero(np.diff(goff))
                if not len(filled):
                    continue
                k1, k2 = _set_keys(unique_sets(grams, goff))
                sig = minhash(grams, goff, family)[filled].astype(U64).reshape(-1, bands, rows)
                keys = mix((sig * weights).sum(axis=2, dtype=U64) + weights[:, 0])
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(filled)), pa.array(k1[filled]), pa.array(k2[filled]), lists], ["doc_id", "k1", "k2", "bands"])
        give_back()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist()
            w1, w2, tasks = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("tasks")
            for a, b, raws in chunks(texts):
                sets = unique_sets(*gram_hashes(*token_hashes(raws), n))
                k1, k2 = _set_keys(sets)
                own = np.flatnonzero((k1 == w1[a:b]) & (k2 == w2[a:b]))
                if not len(own):
                    continue
                part = tasks.slice(a, b - a).take(pa.array(own))
                counts, flat = np.diff(part.offsets.to_numpy()), part.flatten()
                which = np.repeat(own, counts)
                data = [sets[i].tobytes() for i in own]
                at = np.repeat(np.arange(len(own)), counts)
                for s in range(0, len(which), 2000):
                    t = slice(s, s + 2000)
                    cols = [flat.field(f).slice(s, 2000) for f in ("leader", "lo", "hi", "blk")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(doc_id[a + which[t]]), pa.array(k1[which[t]]), pa.array([data[i] for i in at[t]], pa.binary())], ["leader", "lo", "hi", "blk", "rep", "k1", "grams"])
        give_back()

    return run


def jaccard_block(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, Jaccard) of all pairs of sorted sets at or above the threshold; with ``side``, only of unlike sides."""
    m = len(sets)
    sizes = np.fromiter((len(s) for s in sets), np.int64, m)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        j = both / (sizes[0] + sizes[1] - both)
        return [(0, 1, float(j))] if j >= threshold and (side is None or side[0] != side[1]) else []
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1
    row, shared = np.repeat(np.arange(m), sizes), df[inverse] > 1
    row, col = row[shared], column[inverse[shared]]
    both = np.zeros((m, m), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    for c in range(0, width, 8192):
        x, y = np.searchsorted(col, (c, c + 8192))
        dense = np.zeros((m, min(8192, width - c)), np.float32)
        dense[row[x:y], col[x:y] - c] = 1
        both += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - both
    j = both / np.maximum(union, 1)
    hit = np.triu(j >= threshold, 1)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    return [(int(a), int(b), float(j[a, b])) for a, b in zip(*np.nonzero(hit))]


def _verify(threshold: float):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def flush(key, sets: dict, out: list) -> None:
        """Pairs of one block, or of two."""
        at = list(sets)
        if len(at) > 1:
            side = None if key[1] == key[2] else np.array([blk for _, _, blk in at])
            arrays = [np.frombuffer(sets[x], U64) for x in at]
            for x, y, j in jaccard_block(arrays, side, threshold):
                a, b = sorted((at[x][:2], at[y][:2]))
                out.append((*a, *b, j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, out = None, {}, []

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["a", "ka", "b", "kb", "jaccard"])
            out.clear()
            return batch

        for batch in batches:
            for *k, blk, rep, k1, grams in zip(*(batch.column(c).to_pylist() for c in ("leader", "lo", "hi", "blk", "rep", "k1", "grams"))):
                if k != key:
                    if key is not None:
                        flush(key, sets, out)
                    key, sets = k, {}
                sets[rep, k1, blk] = grams
            if out:
                yield sent()
        if key is not None:
            flush(key, sets, out)
        if out:
            yield sent()
        give_back()

    return run


def _pairs_of_sets(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the documents (``rep``, ``k1``, ``doc_id``) of the sets that several documents have; verified pairs of sets.

    A set is named by its least document ``rep`` and its key ``k1``.
    """
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    signed = materialize(source.mapInArrow(_signatures(n, bands, rows), "doc_id long, k1 long, k2 long, bands array<long>"), "signed")
    groups = materialize(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands")), "sets")
    of_band, of_leader = Window.partitionBy("band"), Window.partitionBy("leader")
    met = groups.select("rep", "k1", "k2", F.explode("bands").alias("band")).select("rep", "k1", "k2", F.min("rep").over(of_band).alias("leader"), F.count("*").over(of_band).alias("n"))
    links = materialize(met.where("n > 1").select("leader", "rep", "k1", "k2").distinct(), "links")
    placed = links.select("*", (F.row_number().over(of_leader.orderBy("rep", "k1")) - 1).alias("i"), (F.count("*").over(of_leader) - 1).alias("last"))
    own = F.expr(f"cast(i div {BLOCK} as int)")
    other: Column = F.explode(F.sequence(F.lit(0), F.expr(f"cast(last div {BLOCK} as int)")))
    wanted = (
        placed.where("last > 0").select("rep", "k1", "k2", "leader", own.alias("blk"), other.alias("to"))
        .select("rep", "k1", "k2", F.struct("leader", F.least("blk", "to").alias("lo"), F.greatest("blk", "to").alias("hi"), "blk").alias("task"))
        .groupBy("rep", "k1", "k2").agg(F.collect_list("task").alias("tasks"))
    )
    texts = only(source, links.select(F.col("rep").alias("doc_id")))
    sets = (
        texts.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")
        .select("doc_id", "text", "k1", "k2", "tasks")
        .mapInArrow(_sets(n), "leader long, lo int, hi int, blk int, rep long, k1 long, grams binary")
    )
    found = sets.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi").mapInArrow(_verify(threshold), "a long, ka long, b long, kb long, jaccard double")
    pairs = found.groupBy("a", "ka", "b", "kb").agg(F.max("jaccard").alias("jaccard"))
    several = groups.where("rep < last").select("rep", "k1", "k2")
    return signed.select("doc_id", "k1", "k2").join(several, ["k1", "k2"]).select("rep", "k1", "doc_id").distinct(), pairs


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.95) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): all pairs of documents whose word n-gram sets are at least ``threshold`` similar.

    One row a pair, the lesser ``doc_id`` first. ``recall`` is the probability that a pair exactly at the threshold
    shares a band; it rises quickly above it.
    """
    members, pairs = _pairs_of_sets(docs, n, threshold, recall)
    members = materialize(members, "members")
    side = lambda x: members.select(F.col("rep").alias(x), F.col("k1").alias(f"k{x}"), F.col("doc_id").alias(f"doc_{x}"))
    unlike = pairs.join(side("a"), ["a", "ka"], "left").join(side("b"), ["b", "kb"], "left").select(F.coalesce("doc_a", "a").alias("x"), F.coalesce("doc_b", "b").alias("y"), "jaccard")
    same = side("a").join(side("b").withColumnsRenamed({"b": "a", "kb": "ka"}), ["a", "ka"]).where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0))
    return unlike.where("x <> y").union(same).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges(u, v)`` is connected with.

    Alternates large-star and small-star steps until the edges stop changing; every step is written to the shared
    folder, so its lineage is one read. Nodes without an edge don't appear.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = seen


def _classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label): the least ``doc_id`` that pairs and common sets connect each document with."""
    return connected_components(members.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).union(pairs.select("a", "b")))


def ngram_jaccard_links(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.95) -> DataFrame:
    """(doc_id, class_id, n_links): every document, the least document that pairs connect it with, and its number of pairs.

    The pairs are those of ``ngram_jaccard_join``, but they are counted by sets: a document is linked with the others of
    its own set and with all of the sets paired with it. Documents in several such sets (several texts of one
    ``doc_id``) are counted one by one, so that none counts twice. A document without a pair is a class alone.
    """
    members, pairs = (materialize(df, name) for df, name in zip(_pairs_of_sets(docs, n, threshold, recall), ("members", "pairs")))
    of_set = ["rep", "k1"]
    back = pairs.select(F.col("b").alias("rep"), F.col("kb").alias("k1"), F.col("a").alias("b"), F.col("ka").alias("kb"))
    near = pairs.select(F.col("a").alias("rep"), F.col("ka").alias("k1"), "b", "kb").union(back)
    placed = members.union(near.select("rep", "k1", F.col("rep"))).distinct().select("*", F.count("*").over(Window.partitionBy("doc_id")).alias("sets"))
    placed = materialize(placed, "placed")
    near = near.union(placed.select("rep", "k1", "rep", "k1").distinct())
    once = placed.where("sets = 1")
    size = once.groupBy(*of_set).agg(F.count("*").alias("size")).withColumnsRenamed({"rep": "b", "k1": "kb"})
    around = near.join(size, ["b", "kb"]).groupBy(*of_set).agg(F.sum("size").alias("around"))
    by_set = once.join(around, of_set).select("doc_id", (F.col("around") - 1).alias("n"))
    of_several = placed.where("sets > 1").join(near, of_set).select(F.col("doc_id").alias("one"), F.col("b").alias("rep"), F.col("kb").alias("k1")).distinct()
    of_several = of_several.join(placed, of_set).where("one <> doc_id").select("one", "doc_id", "sets").distinct()
    by_one = of_several.select(F.col("one").alias("doc_id"), F.lit(1).alias("n")).union(of_several.where("sets = 1").select("doc_id", F.lit(1)))
    counts = by_set.union(by_one).groupBy("doc_id").agg(F.sum("n").alias("n"))
    labels = _classes(members, pairs).withColumnsRenamed({"node": "doc_id", "label": "class_id"})
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    out = every.join(counts, "doc_id", "left").join(labels, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.95) -> DataFrame:
    """``docs`` without near copies: of each group connected by pairs the document with the least ``doc_id`` stays.

    All columns and the remaining rows are returned as they are; documents without a pair always stay.
    """
    members, pairs = _pairs_of_sets(docs, n, threshold, recall)
    gone = _classes(members, pairs).where("node <> label").select(F.col("node").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
