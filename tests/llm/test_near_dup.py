import re
from collections import defaultdict

from parlora.llm import near_dup
from parlora.llm.near_dup import BLOCK, choose_bands, connected_components, drop_near_duplicates, jaccard_block, ngram_jaccard_join, ngram_jaccard_links

from .conftest import SCHEMA, row, words


def grams(text, n=3):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def brute(texts, threshold):
    sets = {d: g for d, t in texts.items() if (g := grams(t))}
    by = defaultdict(set)
    for d, g in sets.items():
        for x in g:
            by[x].add(d)
    shared = defaultdict(int)
    for ds in by.values():
        for a in ds:
            for b in ds:
                if a < b:
                    shared[a, b] += 1
    return {p: j for p, n in shared.items() if (j := n / (len(sets[p[0]]) + len(sets[p[1]]) - n)) >= threshold}


def pairs(df):
    rows = df.collect()
    assert df.columns == ["doc_id_a", "doc_id_b", "jaccard"] and all(r[0] < r[1] for r in rows)
    out = {(r[0], r[1]): r[2] for r in rows}
    assert len(out) == len(rows)
    return out


def test_pairs_equal_brute_force(docs, texts):
    want, got = brute(texts, 0.5), pairs(ngram_jaccard_join(docs))
    assert len(want) > 10
    assert not set(got) - set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    sure = {p for p, j in want.items() if j >= 0.7}
    assert sure <= set(got)


def test_one_of_each_group_stays(docs, texts):
    kept = {r["doc_id"] for r in drop_near_duplicates(docs).collect()}
    found = pairs(ngram_jaccard_join(docs))
    parent = {d: d for d in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert kept == {d for d in texts if top(d) == d}


def test_large_groups_are_cut_into_blocks(spark):
    base = words(60, 7).split()
    rows = [row(i, " ".join([*base[:50], f"tail{i}", *base[50:]])) for i in range(BLOCK + 60)]
    rows += [row(1000 + i, rows[i][1]) for i in range(0, BLOCK + 60, 40)]
    got = pairs(ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)))
    n = len(rows)
    assert len(got) == n * (n - 1) // 2


def test_odd_rows(odd, none):
    got = pairs(ngram_jaccard_join(odd))
    assert set(got) == {(1, 2), (3, 12)}
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 4 and ids.count(3) == 2 and 2 not in ids and 12 not in ids and {1, 4, 5, 6, 7, 8, 9, 10, 11, 13} <= set(ids)
    assert ngram_jaccard_join(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_a_document_of_two_texts_pairs_by_each(spark):
    one, two, three = words(60, 1), words(60, 2), words(60, 3)
    rows = [row(3, one), row(3, two), row(5, one), row(6, two), row(7, two + " end"), row(1, three), row(1, three), row(2, three)]
    got = {(r[0], r[1]) for r in ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(3, 5), (3, 6), (3, 7), (6, 7), (1, 2)}


def test_the_filter_by_ids_drops_no_partner(docs, monkeypatch):
    want = pairs(ngram_jaccard_join(docs))
    monkeypatch.setattr(near_dup, "only", lambda source, ids: source)
    assert want and pairs(ngram_jaccard_join(docs)) == want


def test_bands_reach_the_recall():
    for t, recall in ((0.5, 0.95), (0.8, 0.99)):
        bands, rows = choose_bands(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall and bands * rows <= 256


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 13)} | dict.fromkeys((100, 101, 102), 100)


def test_block_of_sides():
    import numpy as np

    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 3, 4], [9], [1, 2, 3])]
    assert {(a, b) for a, b, _ in jaccard_block(sets, None, 0.7)} == {(0, 1), (0, 3), (1, 3)}
    assert {(a, b) for a, b, _ in jaccard_block(sets, np.array([0, 1, 1, 0]), 0.7)} == {(0, 1), (1, 3)}


def links_of(found, ids):
    """What ``ngram_jaccard_links`` must give for these pairs."""
    near = {d: {b for p in found for a, b in (p, p[::-1]) if a == d} for d in ids}
    out = {}
    for d in sorted(ids):
        seen, todo = {d}, [d]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[d] = (min(seen), len(near[d]))
    return out


def links(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "class_id", "n_links"] and len({r[0] for r in rows}) == len(rows)
    return {r[0]: (r[1], r[2]) for r in rows}


def test_a_row_for_each_document(spark, docs, texts, odd, none):
    assert links(ngram_jaccard_links(docs)) == links_of(pairs(ngram_jaccard_join(docs)), set(texts))
    ids = {r["doc_id"] for r in odd.collect()} - {None}
    assert links(ngram_jaccard_links(odd)) == links_of({(1, 2), (3, 12)}, ids)
    assert ngram_jaccard_links(none).count() == 0


def test_rows_of_the_query_follow_the_documents(spark, tmp_path):
    """Copies and near copies of one text: every link is counted, and rows don't grow with the square of the group."""
    from parlora.llm.registry import queries

    base = words(60, 7).split()
    rows = [row(i, " ".join([*base[:50], f"tail{i % 30}", *base[50:]])) for i in range(90)] + [row(200, words(60, 8))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert links(queries()["op2_ngram_jaccard_join"](spark, str(tmp_path))) == {**{i: (0, 89) for i in range(90)}, 200: (200, 0)}


def test_links_of_documents_of_several_texts(spark):
    one, two, three = words(60, 1), words(60, 2), words(60, 3)
    rows = [(3, one), (3, two), (5, one), (6, two), (7, two + " end"), (1, three), (1, three), (2, three), (8, one), (8, one + " end"), (8, two), (9, one + " tail"), (4, three + " x"), (4, words(60, 4))]
    df = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    assert links(ngram_jaccard_links(df)) == links_of(set(ngram_jaccard_join(df).select("doc_id_a", "doc_id_b").distinct().toPandas().itertuples(index=False, name=None)), {r[0] for r in rows})
