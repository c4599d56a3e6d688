from parlora import constants as C
from parlora.functions import dates as D
from parlora.functions import local as L
from parlora.functions import text as T
from parlora.functions import vectors as V
from parlora.sources.exports import canonical_time
from pyspark.sql import functions as F

TEXTS = ["", "  ", None, "\n a b \x1c", "Hello, World's end!", "Été à Paris; Anna met Bob and Anna.", "x" * 300, "The quick brown Fox-jumps over\tlazy dogs"]


def rows(spark, *columns):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_columns_equal_local_functions(spark):
    t = F.col("t")
    got = rows(spark, T.tokens(t), T.blank_to_null(t), T.evidence_excerpt(t), T.content_terms(t), T.entity_terms(t))
    for text, (tokens, blank, excerpt, terms, names) in zip(TEXTS, got):
        assert tokens == L.tokens(text)
        assert blank == L.blank_to_none(text)
        assert excerpt == L.evidence_excerpt(text)
        assert set(terms) == L.content_terms(text or "") and set(names) == L.entity_terms(text or "")


def test_searchable_falls_back_to_blocks(spark):
    df = spark.createDataFrame([(" ", [("image", "One, two"), ("text", " "), ("text", "THREE")]), ("Own text", []), (None, None)], "text string, blocks array<struct<type:string,text:string>>")
    assert [r[0] for r in df.select(T.searchable(F.col("text"), F.col("blocks"))).collect()] == ["one two three", "own text", ""]


def test_voice(spark):
    df = spark.createDataFrame([("user", "Sure, let me"), ("assistant", "Sure, let me"), ("assistant", "plain"), ("system", "Sure, let me"), (None, "x")], "role string, text string")
    got = [round(r[0], 6) for r in df.select(T.voice_factor(F.col("role"), F.col("text"), F.lit(True))).collect()]
    assert got == [1.25, round(0.8 * 0.6 * 0.5, 6), 0.4, 0.8, 0.8]


def test_jaccard_coverage_conflicts(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["Mark", "Marc"], [])], "x array<string>, y array<string>")
    got = df.select(T.jaccard(F.col("x"), F.col("y")), T.coverage(F.col("x"), F.col("y")), T.alias_conflicts(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 0.5, []), (0.0, 0.0, []), (0.0, 0.0, ["Marc"])]


def test_possessive(spark):
    df = spark.createDataFrame([("Anna's new job",), ("Anna’s new job",), ("annas job",)], "q string")
    assert [r[0] for r in df.select(T.possessive(F.col("q"))).collect()] == [True, False, False]


def test_rough_days(spark):
    pairs = [("2024-01-31", "2024-02-01"), ("2024-02-28", "2024-03-01"), ("2024-01-01", "2023-12-31"), ("bad", "2024-01-01")]
    df = spark.createDataFrame(pairs, "a string, b string")
    want = [0, 3, 5, 999]
    assert [r[0] for r in df.select(D.days_between(F.col("a"), F.col("b"))).collect()] == want
    assert [L.days_between(a, b) for a, b in pairs] == want


def test_times(spark):
    raw = ["0", "1700000000.1234567", "2024-03-01T10:00:00+02:00", "2024-03-01T10:00:00.5", "2024-03-01T10:00:00Z", " ", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(D.canonical_time(F.col("t"))).collect()] == [canonical_time(x) for x in raw]
    assert canonical_time(True) is None and canonical_time([]) is None and canonical_time(0) == "1970-01-01T00:00:00Z"


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0, 0, 0]


def test_word_lists():
    assert len(C.META_PREFIXES) == 35 and len(C.MARKER_STRENGTH) == 18 and len(C.CHANGE_VERBS) == 11 and len(C.ACKNOWLEDGMENTS) == 13
