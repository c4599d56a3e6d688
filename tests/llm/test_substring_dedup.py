import re
from collections import defaultdict

import numpy as np
import pytest
from parlora.llm.substring_dedup import LEAST, compact, repeated_spans, segments

from .conftest import SCHEMA, row, words


def tokens(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def covered(texts, least=LEAST):
    by, own = defaultdict(set), {d: tokens(t) for d, t in texts.items()}
    for d, w in own.items():
        for i in range(len(w) - least + 1):
            by[tuple(w[i : i + least])].add(d)
    out = {}
    for d, w in own.items():
        mark = np.zeros(len(w), bool)
        for i in range(len(w) - least + 1):
            if len(by[tuple(w[i : i + least])]) > 1:
                mark[i : i + least] = True
        out[d] = mark
    return out


def marked(texts, rows):
    out = {d: np.zeros(len(tokens(t)), bool) for d, t in texts.items()}
    for r in rows:
        assert r["n_tokens"] == r["end_token"] - r["start_token"] >= LEAST
        a, b = r["start_token"], r["end_token"]
        assert not out[r["doc_id"]][max(0, a - 1) : b + 1].any(), "spans neither overlap nor touch"
        out[r["doc_id"]][a:b] = True
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want, got = covered(texts), marked(texts, repeated_spans(docs).collect())
    assert sum(m.sum() for m in want.values()) > 1000
    assert all((want[d] == got[d]).all() for d in texts)


def test_planted_passages(spark):
    passage, other = words(51, 1), words(50, 2)
    texts = {i: f"{words(40 + i, 10 + i)} {passage} {words(30, 50 + i)}" for i in range(1, 6)}
    texts |= {7: f"{other} {words(80, 7)}", 8: f"{words(90, 8)} {other}", 9: words(200, 9), 10: words(49, 3) + " x", 11: words(49, 3) + " y"}
    rows = repeated_spans(spark.createDataFrame([row(d, t) for d, t in texts.items()], SCHEMA)).collect()
    got = marked(texts, rows)
    assert all((covered(texts)[d] == got[d]).all() for d in texts)
    spans = {r["doc_id"]: (r["start_token"], r["end_token"]) for r in rows}
    assert spans == {i: (40 + i, 91 + i) for i in range(1, 6)} | {7: (0, 50), 8: (90, 140)}


def test_few_bits_give_the_same_spans(spark):
    passage, line = words(70, 1), words(9, 5)
    texts = {i: f"{words(40 + i, 10 + i)} {passage} {words(30, 50 + i)}" for i in range(1, 4)} | {5: words(150, 5), 6: f"{line} " * 20, 7: words(12, 6) + f" {line}" * 12}
    docs = spark.createDataFrame([row(d, t) for d, t in texts.items()], SCHEMA)
    want, few = covered(texts), marked(texts, repeated_spans(docs, bits=5).collect())
    assert want[1].sum() == 70 and want[7].sum() > 100
    assert {d: few[d].nonzero()[0].tolist() for d in texts} == {d: want[d].nonzero()[0].tolist() for d in texts}


def test_copies_of_a_passage_walk_one_path(spark):
    """Segments name the same path for all copies, and a document that leaves and joins a path has one each side."""
    paths = compact(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 4)], "u long, v long"))
    rows = [(1, 10, 1, 12), (1, 12, 2, 14), (1, 14, 3, 16), (1, 16, 4, 18), (1, 18, 5, -1), (2, 0, 9, 3), (2, 3, 4, 6), (2, 6, 5, -1), (3, 7, 2, 9), (3, 9, 3, -1), (3, 30, 1, 31)]
    found = spark.createDataFrame([(*r, r[3] >= 0 and r[:2] != (3, 30)) for r in rows], "doc_id long, pos int, node long, next int, repeated boolean")
    got = sorted((r["doc_id"], r["path"], r["from"], r["to"], r["linked"]) for r in segments(found, paths).collect())
    assert got == [(1, 3, 10, 14, False), (1, 5, 16, 18, True), (2, 5, 3, 6, True), (2, 9, 0, 0, False), (3, 3, 7, 9, False), (3, 3, 30, 30, False)]


def test_runs_of_one_token(spark):
    texts = {1: "of " * 300, 2: words(20, 1) + " of" * 120, 3: "a " * 40, 4: " of" * 49, 5: "of " * 300 + "end"}
    got, want = marked(texts, repeated_spans(spark.createDataFrame([row(d, t) for d, t in texts.items()], SCHEMA)).collect()), covered(texts)
    assert all((got[d] == want[d]).all() for d in texts) and want[1].all() and not want[4].any()


def test_periodic_stretches_are_covered_whole(spark):
    line, long = words(9, 5), words(31, 6)
    texts = {1: "of " * 300, 2: words(20, 1) + " of" * 120, 3: " of" * 150 + " off" + " of" * 170}
    texts |= {4: f"{line} " * 40 + words(30, 7), 5: words(25, 8) + f" {line}" * 15, 6: f"{line} " * 20 + "odd " + f"{line} " * 20}
    texts |= {7: f"{long} " * 12, 8: f"{words(40, 9)} " + f"{long} " * 5, 9: "ab cd " * 200, 10: "ab cd " * 30 + words(60, 10), 11: "zz " * 400}
    got = marked(texts, repeated_spans(spark.createDataFrame([row(d, t) for d, t in texts.items()], SCHEMA)).collect())
    want = covered(texts)
    assert want[1].all() and want[4].sum() == 360 and not want[11].any()
    assert {d: got[d].nonzero()[0].tolist() for d in texts} == {d: want[d].nonzero()[0].tolist() for d in texts}


def test_paths_and_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 3), (4, 5), (20, 21), (21, 22), (22, 20), (30, 30)]
    got = {r["node"]: (r["path"], r["to_end"]) for r in compact(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[1] == (2, 1) and got[2] == (2, 0) and got[3] == (5, 2) and got[4] == (5, 1) and got[5] == (5, 0) and got[10] == (10, 0)
    assert {got[n][0] for n in (20, 21, 22)} == {20} and got[30] == (30, 0)


def test_odd_rows(odd, none):
    rows = repeated_spans(odd).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 12}
    assert repeated_spans(none).count() == 0
