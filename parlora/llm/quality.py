"""Quality classifier by co-training.

Two views judge a document: its text content (character classes, token lengths, variety, repetition and line layout; no
words) and its metadata (source, language and declared size; nothing that is read off the text). Each view is a logistic
regression. They start from labelled documents; in each round each view scores all unlabelled documents, and its most
confident ones of either class become training rows of the other view. Of the labelled documents held out from training
one half calibrates each view (Platt), and on the other half a logistic regression on the two calibrated log odds is
fitted, which scores every document.

Only training is bounded: at most ``most_labelled`` labelled documents, chosen by a hash of ``doc_id``, and
``exchange`` pseudo-labels per view, class and round; scoring and the search for pseudo-labels cover all documents.

Cases: null and empty texts have a content view of zeros; a null source, language or size is a value of its own.
Labels with null ``doc_id`` or ``quality`` teach nothing; repeated or contradicting labels are rows like others. When
the labels lack a class, every document gets the share of the other one. Rows with a null ``doc_id`` are scored too;
repeated rows stay; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .shingles import U64, chunks, gram_hashes, mix, token_hashes
from .ship import ship

_CLASSES = ((97, 123), (65, 91), (48, 58), (128, 256))
_KIND = np.full(256, 7, np.int8)
for _k, (_a, _b) in enumerate(_CLASSES):
    _KIND[_a:_b] = _k
_KIND[[9, 13, 32]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 6
_N_KINDS, _SOURCES, _LANGS = 8, 64, 16
TEXT_FEATURES = _N_KINDS + 12
META_FEATURES = _SOURCES + _LANGS + 2


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    filled = np.flatnonzero(np.diff(off))
    if len(filled):
        out[filled] = np.add.reduceat(values, off[filled])
    return out


def _distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent one) of each text."""
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))) if len(values) else np.empty(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(values)))
    most = np.zeros(len(off) - 1)
    np.maximum.at(most, owner[at], runs)
    return np.bincount(owner[at], minlength=len(off) - 1).astype(float), most


def text_view(raw_texts: list[bytes], lowered: list[bytes]) -> np.ndarray:
    """Content features of a slice of texts (texts x TEXT_FEATURES)."""
    buf = np.frombuffer(b"".join(raw_texts), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw_texts])))
    kinds, size = _KIND[buf], np.maximum(np.diff(off), 1)
    shares = np.stack([_per_text((kinds == k).astype(np.int64), off) / size for k in range(_N_KINDS)], axis=1)
    tokens, toff = token_hashes(lowered)
    n = np.diff(toff)
    grams, goff = gram_hashes(tokens, toff, 3)
    unique, most = _distinct(tokens, toff)
    unique3, most3 = _distinct(grams, goff)
    n1, n3 = np.maximum(n, 1), np.maximum(np.diff(goff), 1)
    doubled = _per_text(np.concatenate((tokens[1:] == tokens[:-1], [False])).astype(np.int64) if len(tokens) else np.empty(0, np.int64), toff)
    letters = shares[:, 0] + shares[:, 1] + shares[:, 3]
    lines = np.array([r.count(b"\n") + 1 for r in raw_texts], float)
    length = np.array([len(r) for r in raw_texts], float)
    longest = np.array([max(map(len, r.split(b"\n"))) for r in raw_texts], float)
    layout = np.stack((np.log1p(lines), np.log1p(length / lines), np.log1p(longest), np.log1p(length)), axis=1)
    more = np.stack((np.log1p(n), letters * size / n1, unique / np.sqrt(n1), most / n1, unique3 / n3, most3 / n3, doubled / n1, shares[:, 7] / np.maximum(shares[:, 4], 1e-3)), axis=1)
    return np.concatenate((shares, more, layout), axis=1)


def _slots(values: list[str | None], size: int) -> np.ndarray:
    return np.array([0 if v is None else 1 + int(mix(np.array([hash_text(v)], U64))[0] % U64(size - 1)) for v in values], np.int64)


def hash_text(value: str) -> int:
    """A hash of a short string that is the same in every process."""
    h = 0xCBF29CE484222325
    for b in value.encode():
        h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def meta_view(sources: list, langs: list, sizes: np.ndarray) -> np.ndarray:
    """Metadata features of a slice of documents (documents x META_FEATURES)."""
    out = np.zeros((len(sources), META_FEATURES))
    known: dict = {}
    for k, (values, width) in enumerate(((sources, _SOURCES), (langs, _LANGS))):
        base = k * _SOURCES
        for i, v in enumerate(values):
            at = known.get((k, v))
            if at is None:
                at = known[k, v] = int(_slots([v], width)[0])
            out[i, base + at] = 1
    known_size = ~np.isnan(sizes)
    out[:, -2] = np.where(known_size, np.log1p(np.where(known_size, np.maximum(sizes, 0), 0)), 0)
    out[:, -1] = ~known_size
    return out


@dataclass
class View:
    """A calibrated logistic regression."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    platt: tuple[float, float] = field(default=(1.0, 0.0))

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.centre) / self.spread) @ self.weights + self.bias
        return self.platt[0] * np.clip(raw, -30, 30) + self.platt[1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by Newton steps; the bias isn't penalized."""
    design = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(design.shape[1]), np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(steps):
        p = _sigmoid(design @ w)
        gradient = design.T @ (p - y) + ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    """A view's classifier on standardized features."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1
    weights, bias = fit((x - centre) / spread, y)
    return View(centre, spread, weights, bias)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """The view with Platt's slope and offset from held-out rows."""
    view.platt = (1.0, 0.0)
    slope, offset = fit(view.logit(x)[:, None], y, 1e-3)
    view.platt = (float(slope[0]), offset)
    return view


@dataclass
class Model:
    """Two calibrated views and their combination."""

    text: View | None
    meta: View | None
    weights: np.ndarray
    bias: float
    pseudo: int = 0

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.meta is None:
            p = np.full(len(t), self.bias)
            return p, p, p
        a, b = self.text.logit(t), self.meta.logit(m)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.stack((a, b), axis=1) @ self.weights + self.bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, sources, langs = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sizes = np.array([np.nan if v is None else v for v in batch.column(4).to_pylist()], float)
        for a, b, lowered in chunks(texts):
            raw = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
            t, m = text_view(raw, lowered), meta_view(sources[a:b], langs[a:b], sizes[a:b])
            lists = [pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.reshape(-1).astype(np.float32)) for v in (t, m)]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *lists], ["doc_id", "content", "meta"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, meta): both views of every row."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))
    return source.mapInArrow(_features, "doc_id long, content array<float>, meta array<float>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(_matrix(batch.column(1)), _matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores)], ["doc_id", "p_content", "p_meta", "p_quality"])

    return run


def _collected(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["content"] for r in rows], float), np.array([r["meta"] for r in rows], float)


def co_train(table: DataFrame, labels: DataFrame, rounds: int = 3, exchange: int = 250, confidence: float = 0.97, most_labelled: int = 20_000) -> Model:
    """Train on ``table`` (as from ``features``) and ``labels`` (doc_id, quality 0/1)."""
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y"))
    order = F.xxhash64("doc_id")
    sample = known.orderBy(order, "doc_id", "y").limit(most_labelled)
    rows = sorted(table.join(sample, "doc_id").select("doc_id", "content", "meta", "y", order.alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"], r["y"]))
    y = np.array([r["y"] for r in rows], float)
    tenth = np.array([(r["h"] >> 7) % 10 for r in rows], int)
    held, last = tenth < 2, (tenth == 2) | (tenth == 3)
    train = ~held & ~last
    enough = len(rows) and all(len(np.unique(y[part])) == 2 for part in (train, held, last))
    if not enough:
        return Model(None, None, np.zeros(2), float(y.mean()) if len(y) else 0.5)
    t, m = _collected(rows)
    views = [(t[train], y[train]), (m[train], y[train])]
    pool = materialize(table.where("doc_id is not null").join(known.select("doc_id").distinct(), "doc_id", "left_anti"), "pool")
    taken: list[set] = [set(), set()]

    def trained() -> Model:
        text, meta = (calibrate(fit_view(*views[k]), x[held], y[held]) for k, x in ((0, t), (1, m)))
        weights, bias = fit(np.stack((text.logit(t[last]), meta.logit(m[last])), axis=1), y[last], 1e-2)
        return Model(text, meta, weights, bias, len(taken[0]) + len(taken[1]))

    model = trained()
    for _ in range(rounds):
        scored = pool.select("doc_id", "content", "meta").mapInArrow(_score(model), "doc_id long, p_content double, p_meta double, p_quality double")
        moved = 0
        for source, target, p in ((0, 1, "p_content"), (1, 0, "p_meta")):
            for label in (0.0, 1.0):
                sure = F.col(p) if label else 1 - F.col(p)
                best = scored.where(sure >= confidence).select("doc_id", sure.alias("sure")).orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id").limit(exchange + len(taken[target]))
                ids = [r["doc_id"] for r in best.collect() if r["doc_id"] not in taken[target]][:exchange]
                if not ids:
                    continue
                taken[target] |= set(ids)
                own = table.where(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
                x = _collected(own)[target]
                views[target] = (np.concatenate((views[target][0], x)), np.concatenate((views[target][1], np.full(len(x), label))))
                moved += len(x)
        if not moved:
            break
        model = trained()
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """(doc_id, p_content, p_meta, p_quality, keep) of every row of ``docs``."""
    table = materialize(features(docs), "features")
    model = co_train(table, labels, **training)
    scored = table.mapInArrow(_score(model), "doc_id long, p_content double, p_meta double, p_quality double")
    return scored.withColumn("keep", F.col("p_quality") >= threshold)
