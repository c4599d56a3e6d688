import pytest
from parlora.operators import index as I
from parlora.operators import retrieval as R
from parlora.operators import windows as W
from parlora.plans.api import Engine, answers_table, debug_windows
from parlora.sources.runs import Run
from pyspark.sql import functions as F

SCHEMA = "message_id string, conversation_id string, sequence_index int, provider string, author_role string, created_at string, text string"
LONG = "gardening notes " + "about soil and light and water for every single plant in the back yard " * 3
ROWS = [
    ("m0", "c1", 0, "chatgpt", "system", None, None),
    ("m1", "c1", 1, "chatgpt", "user", "2024-01-01T10:00:00Z", "I want to write a resume about leadership"),
    ("m2", "c1", 2, "chatgpt", "assistant", "2024-01-01T10:01:00Z", "Sure, let me write a resume about leadership"),
    ("m3", "c1", 3, "chatgpt", "user", "2024-01-01T10:02:00Z", "thanks"),
    ("m4", "c2", 0, "claude", "user", "2024-02-01T09:00:00Z", "a start in art school"),
    ("m5", "c2", 1, "claude", "assistant", None, "the resume summary comes first"),
    ("m6", "c3", 0, "chatgpt", "user", "2024-03-01T09:00:00Z", LONG),
    ("m7", "c4", 0, "claude", "user", "2024-03-02T09:00:00Z", LONG),
]
TITLES = [("c1", "Resume help"), ("c2", "School"), ("c3", None), ("c4", "Plants")]


@pytest.fixture(scope="module")
def engine(spark):
    messages = spark.createDataFrame(ROWS, SCHEMA).cache()
    return Engine(spark, Run("r", spark.createDataFrame(TITLES, "conversation_id string, title string"), messages, messages, {}))


def ids(windows):
    return [w["message_id"] for w in windows]


def test_query_parsing(spark):
    df = spark.createDataFrame([(0, 'The  "Big Plan" of the "!!" plan'), (1, "the of")], "query_id long, query string")
    rows = R.parse_queries(df).orderBy("query_id").collect()
    assert rows[0]["terms"] == ["the", "big", "plan", "of"] and rows[0]["phrases"] == ["big plan"]
    kept = R.parse_queries(df, True).orderBy("query_id").collect()
    assert kept[0]["terms"] == ["big", "plan"] and kept[1]["terms"] == ["the", "of"]


def test_user_voice_wins_and_windows_are_cut(engine):
    found = engine.windows("resume leadership")
    assert ids(found)[0] == "m1"
    assert (found[0]["window_start"], found[0]["window_end"]) == (0, 3) and found[0]["result_id"] == "r:m1:0:3"
    assert [m["message_id"] for m in found[0]["messages"]] == ["m0", "m1", "m2", "m3"]
    assert "m2" not in ids(found) and "m5" in ids(found)


def test_assistant_factors(engine, spark):
    rows = R.lexical_candidates(engine.index, engine.run.messages, R.one_query(spark, "resume leadership"))
    voice = {r["message_id"]: round(r["voice"], 6) for r in rows.collect()}
    assert voice["m1"] == 1.25 and voice["m2"] == round(0.8 * 0.6 * 0.5, 6) and voice["m5"] == 0.8


def test_phrases_match_inside_words_and_titles_only_raise(engine, spark):
    rows = {r["message_id"]: r for r in engine.candidates(R.one_query(spark, '"art" help resume')).collect()}
    assert rows["m4"]["phrase_boost"] == 1.5
    assert round(rows["m1"]["title_boost"], 6) == 0.7 and "m3" not in rows


def test_filters(engine, spark):
    q = R.one_query(spark, "resume art school gardening")
    of = lambda **f: {r["message_id"] for r in engine.candidates(q, filters=R.Filters(**f)).collect()}
    assert of(provider=" claude ") == {"m4", "m5", "m7"} and of(author_role="assistant") == {"m2", "m5"}
    assert of(date_from="2024-02-01", date_to="2024-03-01") == {"m4", "m6"} and of(conversation_id="") == {"m1", "m2", "m4", "m5", "m6", "m7"}


def test_repeats_across_providers_go(engine):
    assert ids(engine.windows("gardening soil")) == ["m6"]


def test_modes(engine, spark):
    cand = engine.candidates(R.one_query(spark, "resume school gardening")).cache()
    order = lambda mode: [r["message_id"] for r in R.apply_mode(cand, mode).orderBy("rank").collect()]
    assert order("newest") == ["m7", "m6", "m4", "m2", "m1", "m5"] and order("oldest")[-1] == "m5"
    boosts = {r["message_id"]: r["recency_boost"] for r in R.apply_mode(cand, "relevance_recency").collect()}
    assert boosts["m7"] == 0.35 and boosts["m1"] == 0 and boosts["m5"] == 0 and 0 < boosts["m4"] < 0.35
    with pytest.raises(ValueError):
        R.mode_order("best")
    with pytest.raises(ValueError):
        engine.search(R.one_query(spark, "x").select("query_id", "query"), "timeline")


def test_ties_put_missing_dates_first(spark):
    df = spark.createDataFrame([(0, "b", 1.0, None), (0, "a", 1.0, "2024"), (0, "c", 2.0, "2025")], "query_id long, message_id string, score double, created_at string").withColumn("base_score", F.col("score"))
    assert [r["message_id"] for r in R.apply_mode(df, "relevance").orderBy("rank").collect()] == ["c", "b", "a"]


def test_timeline(engine, spark):
    rows = engine.timeline(spark.createDataFrame([(0, "resume gardening")], "query_id long, query string"), 3).orderBy("rank").collect()
    assert [r["message_id"] for r in rows] == ["m1", "m2", "m6"] and rows[2]["excerpt"].endswith("...") and len(rows[2]["excerpt"]) == 160


def test_no_terms_no_hits(engine):
    assert engine.windows("!!!") == []
    assert len(engine.windows("resume school", limit=0)) == 1


def test_prefix_doubles_until_the_limit(spark):
    rows = [(f"m{i}", f"c{i}", 0, "p", "user", None, "word " + LONG) for i in range(200)] + [("z", "cz", 0, "p", "user", None, "word " + "x " * 150)]
    messages = spark.createDataFrame(rows, SCHEMA)
    own = Engine(spark, Run("r", messages.select("conversation_id", F.lit("t").alias("title")), messages, messages, {}))
    assert set(ids(own.windows("word", limit=2))) == {"m0", "z"}


def test_index_round_trip(engine, spark, tmp_path):
    engine.index.save(str(tmp_path / "i"))
    back = I.Index.load(spark, str(tmp_path / "i"))
    assert back.stats.first() == engine.index.stats.first() and back.postings.count() == engine.index.postings.count()
    plan = R.bm25_scores(back, R.one_query(spark, "resume"))._jdf.queryExecution().toString()
    assert "postings" in plan


def vectors(spark):
    rows = [(m[0], m[1], m[3], m[4], m[5], m[6] or "", "v1", v) for m, v in zip(ROWS, ([1.0, 0.0], [0.9, 0.1], [0.9, 0.2], [0.5, 0.5], [0.0, 1.0], [0.2, 0.8], [-1.0, 0.0], [0.0, 0.0]))]
    return spark.createDataFrame(rows, "message_id string, conversation_id string, provider string, author_role string, created_at string, text string, embedding_model string, embedding array<double>")


def test_semantic_and_hybrid(engine, spark):
    q = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vector array<double>")
    more = {"vectors": vectors(spark), "query_vectors": q, "model": "v1"}
    semantic = {r["message_id"]: r for r in engine.candidates(R.one_query(spark, "x"), "semantic", **more).collect()}
    assert set(semantic) == {"m1", "m2", "m4", "m5"} and semantic["m4"]["score"] == 1.25
    hybrid = {r["message_id"]: r for r in engine.candidates(R.one_query(spark, "school"), "hybrid", **more).collect()}
    assert hybrid["m4"]["sources"] == ["bm25", "semantic"] and hybrid["m4"]["score"] == 10 + max(hybrid["m4"]["bm25"], 1.0)
    assert hybrid["m5"]["sources"] == ["semantic"] and hybrid["m5"]["score"] < 10
    with pytest.raises(ValueError, match="v1"):
        engine.candidates(R.one_query(spark, "x"), "semantic", vectors=vectors(spark), query_vectors=q, model="other").collect()


def test_answers(engine, spark):
    one = engine.answer("resume leadership")
    assert one.status == "supported" and one.citations[0]["message_id"] == "m1"
    assert engine.answer("volcano").status == "insufficient_evidence"
    queries = spark.createDataFrame([(0, "resume leadership"), (1, "volcano")], "query_id long, query string")
    rows = {r["query_id"]: (r["status"], r["answer"]) for r in answers_table(engine, queries).collect()}
    assert rows[0] == (one.status, one.text) and rows[1][0] == "insufficient_evidence"
    assert debug_windows("resume leadership", engine.windows("resume leadership"))[0].strict


def test_greedy_walk():
    import pandas as pd

    base = {"query_id": 0, "conversation_id": "c", "window_start": 0, "window_end": 4, "dup_key": None}
    rows = [{**base, "message_id": "a", "rank": 1, "focal_sequence": 2}, {**base, "message_id": "b", "rank": 2, "focal_sequence": 4}, {**base, "message_id": "c", "rank": 3, "focal_sequence": 9, "window_start": 7, "window_end": 11, "dup_key": "k"}]
    rows += [{**base, "message_id": "d", "rank": 4, "focal_sequence": 30, "window_start": 28, "window_end": 32, "dup_key": "k"}, {**base, "message_id": "e", "rank": 5, "focal_sequence": 31, "window_start": 29, "window_end": 33}]
    assert list(W.accepted(pd.DataFrame(rows), 9)["message_id"]) == ["a", "c", "e"]
    assert list(W.accepted(pd.DataFrame(rows), 0)["message_id"]) == ["a"]


@pytest.mark.parametrize("repeated", [False, True])
def test_stored_index_sorts_ids_only(spark, tmp_path, repeated):
    rows = [("a", "c", 1, "b a, b"), ("a" if repeated else "x", "c", 0, "B c"), ("y", "c", 2, " "), ("z", "d", 0, None)]
    built = I.build_index(spark.createDataFrame(rows, "message_id string, conversation_id string, sequence_index int, text string"))
    assert "Window" not in built.docs._jdf.queryExecution().toString()
    built.save(str(tmp_path / "index"))
    back = I.Index.load(spark, str(tmp_path / "index"))
    for name in ("docs", "places", "postings", "terms", "stats"):
        assert sorted(map(repr, getattr(back, name).select(*getattr(built, name).columns).collect())) == sorted(map(repr, getattr(built, name).collect()))
    want = [("a", "a", 1), ("a", "b", 3), ("a", "c", 1)] if repeated else [("a", "a", 1), ("a", "b", 2), ("x", "b", 1), ("x", "c", 1)]
    assert sorted((r["message_id"], r["term"], r["tf"]) for r in back.postings.collect()) == want


def test_walk_beyond_the_prefix_is_no_new_search(spark, monkeypatch):
    texts = [f"{LONG} {k}" for k in range(300)] + ["soil alone"]
    messages = spark.createDataFrame([(f"m{k:03}", f"c{k}", 0, "p", "user", None, t) for k, t in enumerate(texts)], SCHEMA)
    ranked = messages.select(F.lit(0).cast("long").alias("query_id"), "message_id", "conversation_id", "text", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("message_id")).alias("rank"))
    stored, names = W.stored, []
    monkeypatch.setattr(W, "stored", lambda df, name: names.append(name) or stored(df, name))
    for pool, searches in ((4_096, 1), (64, 2)):
        names.clear()
        monkeypatch.setattr(W, "POOL", pool)
        got = W.greedy_accept(ranked, messages, 2).orderBy("result_rank").collect()
        assert [r["message_id"] for r in got] == ["m000", "m300"] and names == ["ranked"] * searches + ["accepted"]
