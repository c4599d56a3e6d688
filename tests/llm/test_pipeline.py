from collections import Counter

import corpus_pipeline
import pytest
from parlora.llm.registry import oracle_sql, queries
from parlora.llm.scratch import materialize

from .conftest import words
from .test_near_dup import brute


def test_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 11)]
    assert set(oracle_sql()) <= set(names)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "piece_encoding"]


def test_stages_equal_brute_force(spark, docs, data, texts):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, data), name)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        if name == "language_id":
            assert ids == set(texts)
        elif name == "exact_dedup":
            first = {}
            for d in sorted(texts):
                first.setdefault(texts[d], d)
            assert ids == set(first.values())
            before = {d: texts[d] for d in ids}
        elif name == "near_dedup":
            pairs = brute(before, 0.5)
            sure = {p for p, j in pairs.items() if j > 0.7}
            assert not [p for p in sure if set(p) <= ids]
            linked = {d for p in pairs for d in p}
            assert set(before) - linked <= ids
            final = ids
    assert ids == final
    copies = Counter(r["doc_id"] for r in kept.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, kept, data)
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == copies
    assert out.where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, out.collect()))


@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_rows(spark, request, which, data):
    kept = request.getfixturevalue(which)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, data), name)
        assert kept.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, kept, data).count() == kept.count()


def test_stages_keep_columns_of_the_names_used_inside(spark):
    names = ("__doc", "__sha", "__gone", "__source", "__tokens", "__copies", "__v", "__row", "__n", "rep", "k1", "leader", "kind", "n", "winner", "first")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    texts = {**{i: words(60, i) for i in range(1, 12)}, 40: words(60, 1), 41: words(60, 2) + " end", 42: None, 43: ""}
    docs = spark.createDataFrame([(d, t, "en", "s0", 1, *names) for d, t in texts.items()], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept[name] = {r["doc_id"] for r in out.collect()}
    assert kept["exact_dedup"] == set(texts) - {40} and kept["near_dedup"] == set(texts) - {40, 41} and kept["source_mixing"] == set(texts)
