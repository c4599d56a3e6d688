import math
from collections import defaultdict

import numpy as np
import pytest
from parlora.llm.mixing import ALPHA, _kinds, mix_sources, mixing_rates, solve

from .conftest import SCHEMA, row, words


def shares(rows, key):
    out = defaultdict(float)
    for r in rows:
        out[r[key]] += r["tokens"] * r["rate"]
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_constraints_hold(docs):
    rows = mixing_rates(docs).collect()
    natural_s, natural_l = defaultdict(float), defaultdict(float)
    for r in rows:
        natural_s[r["source"]] += r["tokens"]
        natural_l[r["lang"]] += r["tokens"]
    total = sum(natural_s.values())
    wanted = {s: (v / total) ** ALPHA for s, v in natural_s.items()}
    norm = sum(wanted.values())
    got = shares(rows, "source")
    assert all(abs(got[s] - wanted[s] / norm) < 1e-6 for s in wanted)
    got = shares(rows, "lang")
    assert all(abs(got[x] - natural_l[x] / total) < 1e-6 for x in natural_l)
    assert min(r["rate"] for r in rows) >= 1 and all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in rows)


def test_equals_brute_force(docs):
    """The same dual solved by plain gradient descent over all documents."""
    rows = mixing_rates(docs, alpha=0.5).collect()
    t = np.array([r["tokens"] for r in rows], float)
    names = [sorted({r[k] for r in rows}) for k in ("source", "lang")]
    x = [[float(r["source"] == s) for s in names[0]] + [float(r["lang"] == v) for v in names[1]] for r in rows]
    z = np.log1p(t) - (t * np.log1p(t)).sum() / t.sum()
    x = np.column_stack((np.array(x), z))
    natural = (x * t[:, None]).sum(axis=0) / t.sum()
    b = natural.copy()
    n = len(names[0])
    b[:n] = natural[:n] ** 0.5 / (natural[:n] ** 0.5).sum()
    lam = np.zeros(len(b))
    for _ in range(200):
        p = t * np.exp(x @ lam)
        p /= p.sum()
        mean = p @ x
        lam -= np.linalg.lstsq((x * p[:, None]).T @ x - np.outer(mean, mean) + 1e-12 * np.eye(len(b)), mean - b, rcond=1e-10)[0]
    tilt = np.exp(x @ lam)
    got = np.array([r["rate"] for r in rows])
    assert np.abs(got / got.mean() - tilt / tilt.mean()).max() < 1e-4


def test_targets_and_rounding(spark):
    rows = [row(i, words(20, i), "en", "ab"[i % 2]) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing_rates(frame, {"a": 1.0, "b": 3.0}).collect()
    rates = {s: {round(r["rate"], 4) for r in got if r["source"] == s} for s in "ab"}
    assert rates == {"a": {1.0}, "b": {3.0}}
    third = mixing_rates(frame, {"a": 3.0, "b": 4.0}).collect()
    copies = sum(r["copies"] for r in third if r["source"] == "b") / 2000
    assert abs(copies - 4 / 3) < 0.05


def test_given_targets_with_a_default_hold(docs):
    rows = mixing_rates(docs, {"src0": 4.0}, default=1.0).collect()
    got, names = shares(rows, "source"), {r["source"] for r in rows}
    assert len(names) > 5 and all(abs(got[s] - (4 if s == "src0" else 1) / (len(names) + 3)) < 1e-6 for s in names)
    before = {x: sum(r["tokens"] for r in rows if r["lang"] == x) / sum(r["tokens"] for r in rows) for x in {r["lang"] for r in rows}}
    after = shares(rows, "lang")
    assert all(abs(after[x] - before[x]) < 1e-6 for x in before) and max(r["rate"] for r in rows) > 2


def test_targets_that_cannot_be_met(spark):
    """Each language stands in one source only, so the shares of sources can't change while those of languages stay."""
    rows = [row(i, words(20 + i, i), ("en", "fr")[i % 2], "ab"[i % 2]) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    with pytest.warns(UserWarning, match="no rates"):
        balance = solve(_kinds(frame), {"a": 1.0, "b": 3.0}, most=6)
    assert not balance.whole and balance.slope == 0
    offsets = {r["source"]: r["offset"] for r in balance.cells.collect()}
    tokens = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    assert abs(math.exp(offsets["=b"] - offsets["=a"]) * tokens["b"] / tokens["a"] - 3) < 1e-9
    for targets in ({"a": 1.0}, {"a": 1.0, "b": 0.0}):
        with pytest.raises(ValueError, match="above 0"):
            mixing_rates(frame, targets)


def test_many_sources(spark):
    rows = [row(i, words(5 + i % 37, i), ("en", "fr", "de")[i * 7 % 3], f"site{i % 400}") for i in range(2400)]
    got = mixing_rates(spark.createDataFrame(rows, SCHEMA), alpha=0.5).collect()
    natural = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in {r["source"] for r in got}}
    norm, have = sum(v**0.5 for v in natural.values()), shares(got, "source")
    assert len(natural) == 400 and all(abs(have[s] - v**0.5 / norm) < 1e-6 for s, v in natural.items())


def test_rows_repeat_and_none_goes(docs):
    rates = {r["doc_id"]: r["copies"] for r in mixing_rates(docs).collect()}
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == rates


def test_odd_rows(odd, none, spark):
    rows = mixing_rates(odd).collect()
    assert len(rows) == odd.count() and all(r["copies"] >= 1 for r in rows)
    mixed = mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() >= odd.count()
    assert mixing_rates(none).count() == 0 and mix_sources(none).count() == 0
    blank = spark.createDataFrame([row(1, None), row(2, "")], SCHEMA)
    assert [r["copies"] for r in mixing_rates(blank).collect()] == [1, 1]
