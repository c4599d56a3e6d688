import hashlib
from collections import defaultdict

import numpy as np
import pytest
from parlora.llm import exact_dedup as module
from parlora.llm.exact_dedup import build_mph, drop_exact_copies, exact_dedup, mph_slots

from .conftest import SCHEMA, row


def digests(n):
    return np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint64).reshape(-1, 4)


def test_hash_is_minimal_and_perfect():
    for n in (1, 2, 1000, 50_000):
        d = digests(n)
        assert sorted(mph_slots(build_mph(d), d)) == list(range(n))
    assert build_mph(digests(0)) == []


def test_equals_grouping_by_text(docs, texts):
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    want = {min(g): sorted(g)[1:] for g in groups.values()}
    got = {r["doc_id"]: r["removed"] for r in exact_dedup(docs).collect()}
    assert got == want
    assert {r["doc_id"] for r in drop_exact_copies(docs).collect()} == set(want)


def test_history_wins(spark):
    old = spark.createDataFrame([row(50, "seen"), row(40, "seen"), row(60, "other")], SCHEMA)
    new = spark.createDataFrame([row(1, "seen"), row(2, "new"), row(3, "new"), row(4, "see n")], SCHEMA)
    got = {r["doc_id"]: (r["copies"], r["removed"]) for r in exact_dedup(new, old).collect()}
    assert got[40] == (1, [1])
    assert {r["doc_id"] for r in drop_exact_copies(new, old.where("doc_id > 0")).collect()} == set()


@pytest.mark.parametrize("ids", ["all null", "one far below", "one text, many ids", "one id, many texts"])
def test_any_ids_in_small_shards(spark, monkeypatch, ids):
    """No group of the perfect hash holds more than about a shard, whatever the ids."""
    monkeypatch.setattr(module, "SHARD", 64)
    sizes = spark.sparkContext.accumulator(0)
    looked = module._look_up

    def look_up(new, table):
        sizes.add(int(max(len(new), len(np.frombuffer(table["winners"].iloc[0], np.int64)) if len(table) else 0) > 200))
        return looked(new, table)

    monkeypatch.setattr(module, "_look_up", look_up)
    name = lambda i: {"all null": None, "one far below": i if i else -(10**15), "one text, many ids": i, "one id, many texts": 7}[ids]
    text = lambda i: "same" if ids == "one text, many ids" else f"text {i % 700}"
    rows = [row(name(i), text(i)) for i in range(1400)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[0])
    got = module.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    least = lambda g: min((x for x in g if x is not None), default=None)
    assert sorted((repr(r["doc_id"]), r["copies"]) for r in got) == sorted((repr(least(g)), len(g) - 1) for g in groups.values())
    assert sizes.value == 0
    assert drop_exact_copies(spark.createDataFrame(rows, SCHEMA)).count() == len(groups)


def test_odd_rows(odd, none):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert sum(r["text"] is None for r in rows) == 4
    assert ids.count(3) == 1 and 2 not in ids and 5 not in ids and ids.count(None) == 3
    got = {r["doc_id"]: r for r in exact_dedup(odd).collect() if r["doc_id"] is not None}
    assert got[1]["removed"] == [2] and got[4]["removed"] == [5] and got[3]["copies"] == 1 and got[3]["removed"] == []
    assert exact_dedup(none).count() == 0 and drop_exact_copies(none).count() == 0
