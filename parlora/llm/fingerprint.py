"""Document fingerprints by one-permutation MinHash.

Each word n-gram is hashed once; the top bits of the hash choose one of ``bins`` bins, which keeps its least value. An
empty bin borrows from the bin that a random walk of its own, the same for all documents, meets first among the full
ones (optimal densification). Of each bin the ``bits`` low-order bits are packed into the fingerprint. The share of
equal positions of two fingerprints, corrected for the 2**-bits that agree by chance, estimates their Jaccard
similarity without bias.

Cases: null, empty and token-free texts have zero n-grams and a null fingerprint; an estimate with a null
fingerprint is null. Rows are hashed one by one: repeated rows and null or repeated ``doc_id`` stay, repeated n-grams
count once, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import U64, chunks, gram_hashes, mix, token_hashes
from .ship import ship


def bin_minima(grams: np.ndarray, goff: np.ndarray, bins: int) -> np.ndarray:
    """The least hash of each bin (texts x bins); the largest uint64 in empty bins."""
    n = len(goff) - 1
    out = np.full(n * bins, np.iinfo(np.uint64).max, U64)
    if len(grams):
        owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(goff))
        cell = owner * bins + (grams >> U64(64 - (bins - 1).bit_length())).astype(np.int64)
        np.minimum.at(out, cell, grams)
    return out.reshape(n, bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a full one."""
    out = minima.copy()
    bins = minima.shape[1]
    full = minima != np.iinfo(np.uint64).max
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix(col.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(bins)).astype(np.int64)
        hit = full[row, donor]
        out[row[hit], col[hit]] = minima[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    return out


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The ``bits`` low-order bits of each value, packed (texts x bytes)."""
    low = (values & U64((1 << bits) - 1)).astype(np.uint16)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint16)) & np.uint16(1)
    return np.packbits(planes.astype(np.uint8).reshape(len(values), -1), axis=1)


def unpack(raw: list[bytes], bins: int, bits: int) -> np.ndarray:
    """The packed values of fingerprints (texts x bins)."""
    flat = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)[:, : bins * bits]
    return (flat.reshape(len(raw), bins, bits).astype(np.uint16) << np.arange(bits, dtype=np.uint16)).sum(axis=2)


def corrected(equal: np.ndarray, bits: int) -> np.ndarray:
    """Jaccard similarity from the share of equal positions."""
    chance = 2.0**-bits
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _run(n: int, bins: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b, raws in chunks(texts):
                grams, goff = gram_hashes(*token_hashes(raws), n)
                packed = pack(densify(bin_minima(grams, goff, bins)), bits)
                counts = np.diff(goff)
                prints = [p.tobytes() if c else None for p, c in zip(packed, counts)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "n_grams", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, n: int = 3, bins: int = 128, bits: int = 8) -> DataFrame:
    """(doc_id, n_grams, fingerprint) of every row; ``bins`` is a power of two, ``bits`` 1 to 16."""
    if bins & (bins - 1) or bins < 2 or not 1 <= bits <= 16:
        raise ValueError("bins must be a power of two and bits from 1 to 16")
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_run(n, bins, bits), "doc_id long, n_grams long, fingerprint binary")


def estimated_jaccard(a: Column, b: Column, bins: int = 128, bits: int = 8) -> Column:
    """The estimate from two fingerprint columns; null where either is null."""

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, x.index, "float64")
        both = x.notna() & y.notna()
        if both.any():
            equal = (unpack(list(x[both]), bins, bits) == unpack(list(y[both]), bins, bits)).mean(axis=1)
            out[both] = corrected(equal, bits)
        return out

    return F.when(a.isNotNull() & b.isNotNull(), estimate(a, b))
