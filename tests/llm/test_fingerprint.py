import numpy as np
from parlora.llm.fingerprint import bin_minima, corrected, densify, estimated_jaccard, fingerprints, pack, unpack
from parlora.llm.shingles import gram_hashes, token_hashes
from pyspark.sql import functions as F

from .conftest import SCHEMA, row, words
from .test_near_dup import grams


def test_bins_hold_the_least_hash():
    g, off = gram_hashes(*token_hashes([words(300, 1).encode(), b"", words(5, 2).encode()]), 3)
    got = bin_minima(g, off, 64)
    for t in range(3):
        for b in range(64):
            own = [int(x) for x in g[off[t] : off[t + 1]] if int(x) >> 58 == b]
            assert int(got[t, b]) == (min(own) if own else 2**64 - 1)


def test_empty_bins_borrow_full_ones():
    g, off = gram_hashes(*token_hashes([words(5, 2).encode(), b""]), 3)
    before = bin_minima(g, off, 64)
    after = densify(before)
    assert set(after[0].tolist()) == set(before[0].tolist()) - {2**64 - 1}
    assert (after[1] == before[1]).all()


def test_packing_keeps_the_low_bits():
    v = np.random.default_rng(1).integers(0, 1 << 63, (5, 32)).astype(np.uint64)
    for bits in (1, 3, 8, 16):
        assert (unpack([x.tobytes() for x in pack(v, bits)], 32, bits) == (v & np.uint64((1 << bits) - 1))).all()


def test_estimates_follow_jaccard(spark):
    base = words(400, 9).split()
    rows, want = [], {}
    for i in range(60):
        changed = list(base)
        for k in range(0, 400, max(1, 60 - i)):
            changed[k] = f"new{i}x{k}"
        rows.append(row(i, " ".join(changed)))
        a, b = grams(" ".join(base)), grams(" ".join(changed))
        want[i] = len(a & b) / len(a | b)
    got = fingerprints(spark.createDataFrame([*rows, row(99, " ".join(base))], SCHEMA), bins=512, bits=4)
    other = got.where("doc_id = 99").select(F.col("fingerprint").alias("o"))
    est = {r["doc_id"]: r["e"] for r in got.crossJoin(other).select("doc_id", estimated_jaccard(F.col("fingerprint"), F.col("o"), 512, 4).alias("e")).collect()}
    assert est[99] == 1
    errors = [est[i] - want[i] for i in want]
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors) / len(errors)) < 0.02


def test_unlike_texts_are_corrected_to_zero():
    assert corrected(np.array([2.0**-4]), 4)[0] == 0 and corrected(np.array([1.0]), 4)[0] == 1


def test_odd_rows(odd, none, spark):
    rows = fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all((r["fingerprint"] is None) == (r["n_grams"] == 0) for r in rows)
    assert all(len(r["fingerprint"]) == 128 for r in rows if r["fingerprint"] is not None)
    assert fingerprints(none).count() == 0
    pair = spark.createDataFrame([(None, bytearray(128))], "a binary, b binary")
    assert pair.select(estimated_jaccard(F.col("a"), F.col("b"))).first()[0] is None
