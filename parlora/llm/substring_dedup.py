"""Substring dedup by de Bruijn compaction over sampled token k-mers.

The nodes of the graph are token k-mers chosen by minimizers (the least hash of every ``window`` consecutive k-mers),
so equal texts choose equal nodes and every span of at least k + window - 1 tokens holds one. A stretch of that length
in which a k-mer stands twice (a repeated line or token) takes no part in the graph: it is hashed whole and compared
itself, because neither one long edge nor a chain of periods tells how much of a loop two documents share. An edge
joins a chosen k-mer to the next one of its document and stands for all token k-mers between; its key hashes that whole
stretch, so equal edges are equal token sequences. Edges that occur in two or more documents form the repeated graph.
Its nonbranching paths compact by pointer doubling, a Spark join an iteration. A document's chosen k-mers fall into
segments, the stretches of paths that it walks, and a repeated edge from one path to another joins two segments to a run.

At the source coordinates of the runs the text is read again. Every edge and whole stretch is verified on a digest of
its tokens' bytes, which another document must hold too; where two stretches only share a hash, that edge goes and the
runs are made anew. The tokens beside the ends of runs are compared among all documents that hold the same end, which
gives the exact ends of the repeat.

Cases: tokens are those of ``shingles``; null, empty and short texts hold no repeat. A repeat needs two different
``doc_id``; a passage repeated within one document, repeated rows of one document, and rows with a null ``doc_id``
are no repeats. Of rows that share a ``doc_id`` but not the text, coordinates count in the row that holds the k-mer.
Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, only
from .shingles import U64, chunks, mix, token_hashes
from .ship import ship

K = 20
LEAST = 50
_A = 0xA0761D6478BD642F | 1
_AINV = pow(_A, -1, 1 << 64)
#: In the place of the next k-mer: the row is a whole stretch of ``least`` tokens.
_WHOLE = -2
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What a row of ``_reread`` holds: tokens before a k-mer, tokens after it, or the digest of an edge or whole stretch.
_BEFORE, _AFTER, _DIGEST = 0, 1, 2


def _prefix(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers) from which the hash of any stretch is read."""
    n = len(tokens)
    up, down = np.full(n + 1, _A, U64), np.full(n + 1, _AINV, U64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, U64)
    np.cumsum(tokens * np.multiply.accumulate(up)[:n], out=total[1:])
    return total, np.multiply.accumulate(down)


def kmers(tokens: np.ndarray, k: int, bits: int = 64) -> np.ndarray:
    """Hashes of all token k-mers."""
    total, down = _prefix(tokens)
    return _kmers(total, down, k, bits)


def _kmers(total: np.ndarray, down: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix((total[k:] - total[:-k]) * down[: len(total) - k]) >> U64(64 - bits)


def looped(keys: np.ndarray, window: int) -> np.ndarray:
    """Whether each ``window`` consecutive k-mers hold one k-mer twice, which depends on these k-mers alone."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero((keys[order[1:]] == keys[order[:-1]]) & (np.diff(order) < window))
    again = np.full(len(keys) + 1, len(keys) + window, np.int64)
    again[order[same]] = order[same + 1]
    nearest = np.minimum.accumulate(again[::-1])[::-1]
    begin = np.arange(max(len(keys) - window + 1, 0))
    return nearest[begin] < begin + window


def chosen(keys: np.ndarray, window: int, loops: np.ndarray) -> np.ndarray:
    """Positions of the minimizers of the windows without loops."""
    begin = np.flatnonzero(~loops)
    least = np.lib.stride_tricks.sliding_window_view(keys, window)[begin].argmin(axis=1) if len(begin) else begin
    return np.unique(least + begin)


def _seeds(k: int, window: int, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b, raws in chunks(texts):
                tokens, off = token_hashes(raws)
                parts = []
                for d in np.flatnonzero(np.diff(off) >= least):
                    own = tokens[off[d] : off[d + 1]]
                    total, down = _prefix(own)
                    keys = _kmers(total, down, k, bits)
                    loops = looped(keys, window)
                    at = chosen(keys, window, loops)
                    if len(at):
                        to = np.append(at[1:], at[-1])
                        edge = mix((total[to + k] - total[at]) * down[at] + (to - at).astype(U64)) >> U64(64 - bits)
                        to[-1] = -1
                        parts.append((keys[at], np.full(len(at), doc_id[a + d]), at, to, edge))
                    at = np.flatnonzero(loops)
                    if len(at):
                        whole = mix((total[at + least] - total[at]) * down[at] + U64(least)) >> U64(64 - bits)
                        parts.append((whole, np.full(len(at), doc_id[a + d]), at, np.full(len(at), _WHOLE), whole))
                if parts:
                    node, doc, at, to, edge = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(to.astype(np.int32)), pa.array(edge.view(np.int64))], ["node", "doc_id", "pos", "next", "edge"])

    return run


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _reread(k: int, least: int, reach: int, bits: int):
    """(kind, key, doc_id, pos, data, whole) for what is asked about each text.

    A context is keyed by the digest of its k-mer and holds the hashes of the tokens beside it; a digest is keyed by the
    hash of its edge or whole stretch.
    """
    types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, texts, asks = batch.column("doc_id").to_numpy(), batch.column("text").to_pylist(), batch.column("asks")
            for a, b, raws in chunks(texts):
                tokens, off = token_hashes(raws)
                big = tokens.astype(">u8")
                rows = []
                for d in range(b - a):
                    own, flat = tokens[off[d] : off[d + 1]], big[off[d] : off[d + 1]]
                    if len(own) < least:
                        continue
                    words = _TOKEN.findall(raws[d])
                    text = b" ".join(words)
                    at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
                    total, down = _prefix(own)
                    keys = _kmers(total, down, k, bits).view(np.int64)
                    for ask in asks[a + d].as_py():
                        p, to = ask["pos"], ask["next"]
                        if to == _WHOLE:
                            q = p + least
                            if q > len(own) or int(mix((total[p + least : p + least + 1] - total[p : p + 1]) * down[p : p + 1] + U64(least)).view(U64)[0] >> U64(64 - bits)) != ask["node"] % (1 << 64):
                                continue
                        elif p >= len(keys) or keys[p] != ask["node"] or to >= len(keys):
                            continue
                        if ask["left"] or ask["right"]:
                            name = _digest(text[at[p] : at[p + k] - 1])
                            if ask["left"]:
                                rows.append((_BEFORE, name, doc_id[a + d], p, flat[max(0, p - reach) : p][::-1].tobytes(), False))
                            if ask["right"]:
                                rows.append((_AFTER, name, doc_id[a + d], p, flat[p + k : p + k + reach].tobytes(), False))
                        if ask["edge"] is not None:
                            q = p + least if to == _WHOLE else to + k
                            rows.append((_DIGEST, ask["edge"].to_bytes(8, "big", signed=True), doc_id[a + d], p, _digest(text[at[p] : at[q] - 1]), to == _WHOLE))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "key", "doc_id", "pos", "data", "whole"])

    return run


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // 8
    a, b = np.frombuffer(x[:n], U64), np.frombuffer(y[:n], U64)
    return int((a != b).argmax())


def _extents(rows: list[tuple[int, bytes]]) -> list[int]:
    """For sorted (doc_id, context), the longest common beginning with a row of another document."""
    out = [0] * len(rows)
    for order in (range(len(rows)), range(len(rows) - 1, -1, -1)):
        last, other, shared_last, shared_other = None, None, 0, 0
        for i in order:
            if last is not None:
                step = _common(rows[last][1], rows[i][1])
                if rows[last][0] != rows[i][0]:
                    other, shared_other = last, step
                elif other is not None:
                    shared_other = min(shared_other, step)
                if other is not None:
                    out[i] = max(out[i], shared_other)
            last = i
    return out


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rows, held = None, [], []

    def flush():
        extents = _extents([(r[2], r[4]) for r in rows])
        held.extend((*r[:4], e) for r, e in zip(rows, extents))

    def sent():
        types = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["kind", "key", "doc_id", "pos", "extent"])
        held.clear()
        return batch

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:2] != key:
                if rows:
                    flush()
                key, rows = r[:2], []
            rows.append(r)
        if held:
            yield sent()
    if rows:
        flush()
    if held:
        yield sent()


def compact(edges: DataFrame) -> DataFrame:
    """(node, path, to_end) for every node of ``edges(u, v)``: its nonbranching path and the edges to the path's end.

    A path is named by its last node; a cycle by its least one. Pointer doubling joins the table with itself, and each
    iteration is written to the shared folder.
    """
    edges = materialize(edges.where("u is not null and v is not null").distinct(), "edges")
    ahead = edges.groupBy("u").agg(F.count("*").alias("n_out"), F.first("v").alias("v"))
    behind = edges.groupBy(F.col("v").alias("w")).agg(F.count("*").alias("n_in"))
    steps = ahead.where("n_out = 1").join(behind.where("n_in = 1"), F.col("v") == F.col("w")).where("u <> v").select("u", "v")
    now = materialize(steps.select(F.col("u").alias("node"), F.col("v").alias("ptr"), F.lit(1).cast("long").alias("far"), F.least("u", "v").alias("low")), "paths")
    size = now.count()
    table = now
    for _ in range(max(1, math.ceil(math.log2(size + 1)) + 1)):
        then = now.select(F.col("node").alias("n2"), F.col("ptr").alias("p2"), F.col("far").alias("f2"), F.col("low").alias("l2"))
        joined = now.join(then, F.col("ptr") == F.col("n2"), "left")
        last, table = table, materialize(
            joined.select("node", F.coalesce("p2", "ptr").alias("ptr"), (F.col("far") + F.coalesce("f2", F.lit(0))).alias("far"), F.least("low", "l2").alias("low"), F.col("n2").isNotNull().alias("moved")),
            "paths",
        )
        discard(last)
        now = table.drop("moved")
        if not table.where("moved").take(1):
            break
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    found = now.join(now.select(F.col("node").alias("n2")), F.col("ptr") == F.col("n2"), "left")
    found = found.select("node", F.when(F.col("n2").isNotNull(), F.col("low")).otherwise(F.col("ptr")).alias("path"), F.when(F.col("n2").isNull(), F.col("far")).otherwise(F.lit(0)).alias("to_end"))
    return ends.join(found, "node", "left").select("node", F.coalesce("path", "node").alias("path"), F.coalesce("to_end", F.lit(0).cast("long")).alias("to_end"))


def _islands(wholes: DataFrame, least: int) -> DataFrame:
    """Spans of repeated whole stretches that begin one token after the other."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    spans = wholes.select("doc_id", "pos").distinct().withColumn("island", island).groupBy("doc_id", "island")
    return spans.agg(F.min("pos").alias("start_token"), (F.max("pos") + least).alias("end_token")).drop("island")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch as one."""
    order = Window.partitionBy("doc_id").orderBy("start_token", F.desc("end_token"))
    apart = F.coalesce(F.col("start_token") > F.max("end_token").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = spans.withColumn("apart", apart.cast("int")).withColumn("n", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "n").agg(F.min("start_token").alias("start_token"), F.max("end_token").alias("end_token")).drop("n")


def segments(found: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, path, from, head, to, tail, linked): the stretches of compacted paths that each document walks.

    ``linked``: a repeated edge leads from the document's segment before to this one.
    """
    placed = found.join(paths, "node", "left").select("doc_id", "pos", "node", "next", "repeated", F.coalesce("path", "node").alias("path"), F.coalesce("to_end", F.lit(0)).alias("to_end"))
    order = Window.partitionBy("doc_id").orderBy("pos", "node")
    linked = F.coalesce(F.lag("repeated").over(order) & (F.lag("next").over(order) == F.col("pos")), F.lit(False))
    walked = F.coalesce(F.col("linked") & (F.lag("path").over(order) == F.col("path")) & (F.lag("to_end").over(order) == F.col("to_end") + 1), F.lit(False))
    marked = placed.withColumn("linked", linked).withColumn("begins", (~walked).cast("int"))
    marked = marked.withColumn("segment", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy("doc_id", "segment").agg(F.min(F.struct("pos", "node", "linked", "path")).alias("a"), F.max(F.struct("pos", "node")).alias("b"))
    return ends.select("doc_id", F.col("a.path").alias("path"), F.col("a.pos").alias("from"), F.col("a.node").alias("head"), F.col("b.pos").alias("to"), F.col("b.node").alias("tail"), F.col("a.linked").alias("linked"))


def _runs(pieces: DataFrame) -> DataFrame:
    """(doc_id, from, head, to, tail) of segments that follow each other by repeated edges."""
    order = Window.partitionBy("doc_id").orderBy("from")
    numbered = pieces.withColumn("run", F.sum((~F.col("linked")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = numbered.groupBy("doc_id", "run").agg(F.min(F.struct("from", "head")).alias("a"), F.max(F.struct("to", "tail")).alias("b"))
    return ends.select("doc_id", "a.from", "a.head", "b.to", "b.tail")


def repeated_spans(docs: DataFrame, k: int = K, least: int = LEAST, bits: int = 64) -> DataFrame:
    """(doc_id, start_token, end_token, n_tokens) of repeats of ``least`` tokens or more.

    One row for each maximal run of tokens of a document that all lie in stretches of ``least`` tokens which also stand in
    another document: tokens ``start_token`` to ``end_token`` (exclusive). ``bits`` is the length of the hashes; fewer bits give the same
    rows with more to verify.
    """
    window = least - k + 1
    if k < 2 or window < 2:
        raise ValueError("k must be from 2 to least - 1")
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seeds = source.mapInArrow(_seeds(k, window, least, bits), "node long, doc_id long, pos int, next int, edge long")
    by_node, by_edge = Window.partitionBy("node", "whole"), Window.partitionBy("edge", "whole")
    several = lambda by: F.min("doc_id").over(by) < F.max("doc_id").over(by)
    shared = seeds.withColumn("whole", F.col("next") == _WHOLE).withColumn("shared", several(by_node)).where("shared").drop("shared")
    found = materialize(shared.withColumn("repeated", (F.col("next") != -1) & several(by_edge)), "occurrences")
    while True:
        nodes, wholes = found.where("not whole"), found.where("whole and repeated")
        following = Window.partitionBy("doc_id").orderBy("pos", "node")
        edges = nodes.withColumn("v", F.when(F.col("repeated") & (F.lead("pos").over(following) == F.col("next")), F.lead("node").over(following)))
        paths = compact(edges.select(F.col("node").alias("u"), "v"))
        runs = materialize(_runs(segments(nodes, paths)), "runs")
        ends = runs.select(F.col("head").alias("node"), F.lit(True).alias("l"), F.lit(False).alias("r")).union(runs.select("tail", F.lit(False), F.lit(True))).groupBy("node").agg(F.max("l").alias("left"), F.max("r").alias("right"))
        asked = nodes.join(ends, "node", "left").unionByName(wholes.withColumn("left", F.lit(False)).withColumn("right", F.lit(False)))
        asked = asked.where("left or right or repeated").select("doc_id", "pos", "node", "next", F.when(F.col("repeated"), F.col("edge")).alias("edge"), F.coalesce("left", F.lit(False)).alias("left"), F.coalesce("right", F.lit(False)).alias("right"))
        asks = asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "node", "next", "edge", "left", "right")).alias("asks"))
        texts = only(source, found.select("doc_id").distinct())
        read = texts.join(asks, "doc_id").select("doc_id", "text", "asks").mapInArrow(_reread(k, least, 2 * window, bits), "kind int, key binary, doc_id long, pos int, data binary, whole boolean")
        read = materialize(read, "read")
        held = read.where(F.col("kind") == _DIGEST)
        same = Window.partitionBy("key", "whole", "data")
        false = held.withColumn("own", F.min("doc_id").over(same) == F.max("doc_id").over(same)).where("own").select("doc_id", "pos", "whole", F.lit(True).alias("false"))
        false = materialize(false.distinct(), "false")
        if not false.take(1):
            break
        told = found.join(false, ["doc_id", "pos", "whole"], "left").withColumn("repeated", F.col("repeated") & F.col("false").isNull()).drop("false")
        before, found = found, materialize(told, "occurrences")
        for table in (before, runs, read):
            discard(table)
    contexts = read.where(F.col("kind") != _DIGEST).select("kind", "key", "doc_id", "pos", "data")
    contexts = contexts.repartition("kind", "key").sortWithinPartitions("kind", "key", "data", "doc_id", "pos")
    extents = contexts.mapInArrow(_extend, "kind int, key binary, doc_id long, pos int, extent int").groupBy("doc_id", "pos")
    extents = materialize(extents.agg(F.max(F.when(F.col("kind") == _BEFORE, F.col("extent"))).alias("before"), F.max(F.when(F.col("kind") == _AFTER, F.col("extent"))).alias("after")), "extents")
    full = runs.join(extents.select("doc_id", F.col("pos").alias("from"), "before"), ["doc_id", "from"]).join(extents.select("doc_id", F.col("pos").alias("to"), "after"), ["doc_id", "to"])
    spans = full.select("doc_id", (F.col("from") - F.coalesce("before", F.lit(0))).alias("start_token"), (F.col("to") + k + F.coalesce("after", F.lit(0))).alias("end_token"))
    spans = _joined(spans.where(F.col("end_token") - F.col("start_token") >= least).union(_islands(wholes, least)))
    return spans.select("doc_id", "start_token", "end_token", (F.col("end_token") - F.col("start_token")).alias("n_tokens"))
