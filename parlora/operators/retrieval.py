"""Ranking: parsing, filters, BM25, boosts, semantic and hybrid candidates, modes.

Every plan takes a table of queries; a single query is the case of one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..functions import vectors as V
from .index import Index, with_positions

WINDOW_MODES = ("relevance", "newest", "oldest", "relevance_recency")
CHANNELS = ("bm25", "semantic", "hybrid")


def parse_queries(queries: DataFrame, stopword_filter: bool = C.STOPWORD_FILTER) -> DataFrame:
    """Adds ``terms`` (distinct, in order) and ``phrases`` (normalized quotations) to ``queries(query_id, query)``.

    With the stopword filter a query made of stopwords alone keeps them.
    """
    query = T.collapse(F.col("query"))
    terms = F.array_distinct(T.tokens(query))
    if stopword_filter:
        kept = F.array_except(terms, T.words_array(C.STOPWORDS))
        terms = F.when(F.size(kept) > 0, kept).otherwise(terms)
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    phrases = F.filter(F.transform(quoted, T.normalized), lambda p: p != "")
    return queries.withColumn("terms", terms).withColumn("phrases", phrases)


def one_query(spark: SparkSession, query: str) -> DataFrame:
    """A table of one parsed query, with ``query_id`` 0."""
    return parse_queries(spark.createDataFrame([(0, query)], "query_id long, query string"))


@dataclass(frozen=True)
class Filters:
    """Equality filters, and inclusive bounds of ``created_at``; a bound leaves out messages without a time."""

    provider: str | None = None
    conversation_id: str | None = None
    author_role: str | None = None
    date_from: str | None = None
    date_to: str | None = None

    def condition(self) -> Column:
        test = F.lit(True)
        for name in ("provider", "conversation_id", "author_role"):
            value = (getattr(self, name) or "").strip()
            if value:
                test = test & (F.col(name) == value)
        stamp = F.to_timestamp("created_at") if self.date_from or self.date_to else None
        if self.date_from:
            test = test & (stamp >= F.to_timestamp(F.lit(D.bound(self.date_from, False))))
        if self.date_to:
            test = test & (stamp <= F.to_timestamp(F.lit(D.bound(self.date_to, True))))
        return test


#: Queries up to which their table goes to all executors, so that postings, texts and candidates stay where they are.
BROADCAST_QUERIES = 100_000


def few(queries: DataFrame) -> DataFrame:
    """A table of queries, hinted for broadcast unless it is large; joins with it are right either way."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def bm25_contribution(tf: Column, df: Column, n: Column, length: Column, avgdl: Column) -> Column:
    """What one term adds to a document's score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return idf * (tf * (C.BM25_K1 + 1)) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / mean))


def bm25_scores(index: Index, parsed: DataFrame) -> DataFrame:
    """(query_id, message_id, bm25, matched) of every document that holds a term of the query."""
    wanted = parsed.select("query_id", F.explode("terms").alias("term"))
    wanted = few(index.terms.join(few(wanted), "term"))
    hits = index.postings.join(wanted, "term").crossJoin(F.broadcast(index.stats))
    part = bm25_contribution(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("avgdl"))
    return hits.groupBy("query_id", "message_id").agg(F.sum(part).alias("bm25"), F.sort_array(F.collect_list(F.struct("term", F.round(part, 6).alias("contribution")))).alias("matched"))


def phrase_hits(index: Index, parsed: DataFrame) -> DataFrame:
    """(query_id, message_id, phrase_boost) of documents whose searchable text contains a quotation anywhere."""
    asked = parsed.where(F.size("phrases") > 0).select("query_id", "phrases")
    found = F.size(F.filter("phrases", lambda p: F.contains(F.col("searchable"), p)))
    both = index.docs.crossJoin(few(asked)).select("query_id", "message_id", (found * F.lit(C.PHRASE_BOOST)).alias("phrase_boost"))
    return both.where("phrase_boost > 0")


def nearby_user_texts(messages: DataFrame, radius: int = C.RESTATEMENT_RADIUS) -> DataFrame:
    """(message_id, nearby): content tokens of user messages within ``radius`` places, the message itself left out."""
    placed = with_positions(messages)
    frame = Window.partitionBy("conversation_id").orderBy("pos").rowsBetween(-radius, radius)
    spoken = F.when((F.col("author_role") == "user") & (F.coalesce("text", F.lit("")) != ""), F.struct("pos", T.content_tokens(F.col("text")).alias("words")))
    return placed.withColumn("around", F.collect_list(spoken).over(frame)).select("message_id", F.transform(F.filter("around", lambda x: x["pos"] != F.col("pos")), lambda x: x["words"]).alias("nearby"))


def restates(words: Column, nearby: Column) -> Column:
    """Whether a single nearby text holds the limit share of the words or more."""
    share = lambda u: F.size(F.array_intersect(words, u)) / F.size(words)
    return (F.size(words) > 0) & F.exists(nearby, lambda u: (F.size(u) > 0) & (share(u) >= C.RESTATEMENT_SHARE))


def lexical_candidates(index: Index, messages: DataFrame, parsed: DataFrame, filters: Filters | None = None, conversations: DataFrame | None = None, restatements: bool = True) -> DataFrame:
    """Scored messages of each query.

    Columns: query_id, message_id, conversation_id, provider, author_role, created_at, text, pos, bm25, phrase_boost,
    title_boost, voice, score, base_score, matched, sources. A title can raise a score but not make a hit.
    """
    scores = bm25_scores(index, parsed).join(phrase_hits(index, parsed), ["query_id", "message_id"], "full_outer")
    scores = scores.fillna({"bm25": 0.0, "phrase_boost": 0.0}).where("bm25 > 0 or phrase_boost > 0")
    voice = T.voice_factor(F.col("author_role"), F.col("text")).alias("voice")  # before the joins, so that a query which doesn't return texts doesn't move them
    kept = messages.where((filters or Filters()).condition()).select("message_id", "conversation_id", "provider", "author_role", "created_at", "text", voice)
    rows = scores.join(kept, "message_id").join(index.places, "message_id").join(few(parsed.select("query_id", "terms")), "query_id")
    if conversations is not None:
        titles = conversations.select("conversation_id", T.tokens(F.col("title")).alias("title_tokens"))
        rows = rows.join(titles, "conversation_id", "left")
        overlap = F.size(F.array_intersect("terms", F.coalesce("title_tokens", F.array().cast("array<string>"))))
        rows = rows.withColumn("title_boost", overlap * F.lit(C.TITLE_BOOST)).drop("title_tokens")
    else:
        rows = rows.withColumn("title_boost", F.lit(0.0))
    if restatements:
        spoken = rows.where("author_role = 'assistant'").select("conversation_id").distinct()
        nearby = nearby_user_texts(messages.join(spoken, "conversation_id", "left_semi"))
        again = F.when(F.col("author_role") == "assistant", restates(T.content_tokens(F.col("text")), F.col("nearby")))
        rows = rows.join(nearby, "message_id", "left").withColumn("voice", F.col("voice") * F.when(again, F.lit(C.RESTATEMENT_FACTOR)).otherwise(F.lit(1.0))).drop("nearby")
    score = (F.col("bm25") + F.col("phrase_boost") + F.col("title_boost")) * F.col("voice")
    rows = rows.withColumn("score", score).withColumn("base_score", F.col("score"))
    return rows.withColumn("semantic", F.lit(None).cast("double")).withColumn("sources", F.array(F.lit("bm25"))).drop("terms")


def semantic_candidates(vectors: DataFrame, messages: DataFrame, query_vectors: DataFrame, model: str, limit: int, filters: Filters | None = None, restatements: bool = True) -> DataFrame:
    """The ``limit`` best messages of each query vector by voiced cosine, with the columns of lexical candidates.

    ``vectors`` are embedding records (message_id, conversation_id, provider, author_role, created_at, text,
    embedding_model, embedding), ``query_vectors`` (query_id, vector). Role and text are those of the record.
    """
    records = vectors.where(F.col("embedding_model") == model)
    if not records.take(1):
        known = [r[0] for r in vectors.select("embedding_model").distinct().orderBy("embedding_model").collect()]
        if model not in known:
            raise ValueError(f"no embeddings of model {model!r}; there are {known or 'none'}")
    allowed = messages.where((filters or Filters()).condition()).select("message_id")
    rows = records.join(allowed, "message_id", "left_semi").where(F.size(T.tokens(F.col("text"))) >= C.SEMANTIC_MIN_TOKENS)
    placed = with_positions(messages).select("message_id", "pos")
    rows = rows.join(placed, "message_id").crossJoin(query_vectors).withColumn("semantic", V.cosine(F.col("vector"), F.col("embedding"))).where("semantic > 0")
    if restatements:
        rows = rows.join(nearby_user_texts(messages), "message_id", "left").withColumn("restates", restates(T.content_tokens(F.col("text")), F.col("nearby"))).drop("nearby")
    else:
        rows = rows.withColumn("restates", F.lit(False))
    rows = rows.withColumn("voice", T.voice_factor(F.col("author_role"), F.col("text"), F.col("restates")))
    rows = rows.withColumn("score", F.col("semantic") * F.col("voice")).withColumn("base_score", F.col("score"))
    best = Window.partitionBy("query_id").orderBy(*relevance_order())
    rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit)
    empty = F.array().cast("array<struct<term:string,contribution:double>>")
    return rows.select(
        "conversation_id", "message_id", "query_id", F.lit(None).cast("double").alias("bm25"), empty.alias("matched"), F.lit(0.0).alias("phrase_boost"), "provider", "author_role", "created_at", "text", "pos",
        F.lit(0.0).alias("title_boost"), "voice", "score", "base_score", F.round("semantic", 6).alias("semantic"), F.array(F.lit("semantic")).alias("sources"),
    )


def hybrid_merge(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both lists by message: one found by both scores the bonus plus the larger raw signal, others keep theirs."""
    a, b = lexical.alias("a"), semantic.alias("b")
    both = F.col("a.message_id").isNotNull() & F.col("b.message_id").isNotNull()
    joined = a.join(b, (F.col("a.message_id") == F.col("b.message_id")) & (F.col("a.query_id") == F.col("b.query_id")), "full_outer")
    score = F.when(both, C.HYBRID_BONUS + F.greatest(F.round("a.bm25", 6), F.col("b.semantic"))).otherwise(F.coalesce("a.score", "b.score"))
    one = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    plain = [one(c) for c in ("query_id", "message_id", "conversation_id", "provider", "author_role", "created_at", "text", "pos", "phrase_boost", "title_boost", "voice", "matched")]
    sources = F.array_compact(F.array(F.when(F.col("a.message_id").isNotNull(), F.lit("bm25")), F.when(F.col("b.message_id").isNotNull(), F.lit("semantic"))))
    return joined.select(*plain, F.round("a.bm25", 6).alias("bm25"), F.col("b.semantic").alias("semantic"), score.alias("score"), score.alias("base_score"), sources.alias("sources"))


def relevance_order() -> list[Column]:
    """Score downward; among equals the earlier string of the time first, a missing one before all, then the id."""
    return [F.desc("score"), F.asc(F.coalesce("created_at", F.lit(""))), F.asc("message_id")]


def mode_order(mode: str) -> list[Column]:
    """The order of a retrieval mode; both chronological ones put missing times last."""
    stamp = F.to_timestamp("created_at")
    if mode in ("relevance", "relevance_recency"):
        return relevance_order()
    if mode == "newest":
        return [stamp.desc_nulls_last(), F.desc("base_score"), F.asc("message_id")]
    if mode in ("oldest", "timeline"):
        return [stamp.asc_nulls_last(), F.desc("base_score"), F.asc("message_id")]
    raise ValueError(f"no retrieval mode {mode!r}")


def apply_mode(candidates: DataFrame, mode: str) -> DataFrame:
    """Candidates with their rank in ``rank``; ``relevance_recency`` first adds up to the boost by the pool's span."""
    if mode == "relevance_recency":
        stamp = F.to_timestamp("created_at").cast("double")
        span = candidates.groupBy("query_id").agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"))
        share = F.when(F.col("last") > F.col("first"), (stamp - F.col("first")) / (F.col("last") - F.col("first")))
        boost = F.coalesce(share, F.lit(0.0)) * C.RECENCY_MAX
        candidates = candidates.join(span, "query_id").withColumn("recency_boost", boost).withColumn("score", F.col("base_score") + boost).drop("first", "last")
    else:
        candidates = candidates.withColumn("recency_boost", F.lit(0.0))
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*mode_order(mode))))
