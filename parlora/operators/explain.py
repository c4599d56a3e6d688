"""Why a row was found: the payload of a hit, and where its window comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from .index import Index
from .retrieval import Filters

_BASIS = {"newest": "created_at_desc", "oldest": "created_at_asc", "relevance_recency": "relevance_score_desc_plus_recency_boost"}


def rank_basis(mode: str) -> str:
    """What a mode ranks by."""
    return _BASIS.get(mode, "relevance_score_desc")


def explained(rows: DataFrame, parsed: DataFrame, index: Index, mode: str, channel: str = "bm25", filters: Filters | None = None) -> DataFrame:
    """``rows`` (ranked candidates of ``parsed`` queries) with ``match_basis``: query, matches and every scoring feature."""
    asked = parsed.select("query_id", F.col("query").alias("__query"), F.col("terms").alias("__terms"), F.col("phrases").alias("__phrases"), F.array_distinct(T.tokens(F.col("query"))).alias("__all"))
    docs = index.docs.select("message_id", F.col("length").alias("__length"), F.col("searchable").alias("__searchable"))
    joined = rows.join(asked, "query_id").join(docs, "message_id").crossJoin(index.stats.select(F.col("avgdl").alias("__avgdl")))
    phrases = F.filter("__phrases", lambda p: F.contains(F.col("__searchable"), p))
    six = lambda c: F.round(c, 6)
    kept = {n: v for n in ("provider", "conversation_id", "date_from", "date_to", "author_role") if filters and (v := getattr(filters, n))}
    features = F.struct(
        F.col("__terms").alias("query_terms"), F.lit(C.BM25_K1).alias("bm25_k1"), F.lit(C.BM25_B).alias("bm25_b"), F.col("__length").alias("document_length"), six("__avgdl").alias("average_document_length"),
        F.map_from_entries("matched").alias("bm25_term_contributions"), six("bm25").alias("bm25_score"), (F.size(phrases) > 0).alias("exact_phrase_match"), F.size(phrases).alias("matched_phrase_count"),
        F.col("phrase_boost").alias("exact_phrase_boost"), F.round(F.col("title_boost") / C.TITLE_BOOST).cast("int").alias("title_overlap"), "title_boost", F.lit(mode).alias("retrieval_mode"), six("recency_boost").alias("recency_boost"),
        F.lit(rank_basis(mode)).alias("chronological_rank_basis"), six("base_score").alias("relevance_score"), six("score").alias("ranking_score"), six("score").alias("final_score"), F.col("semantic").alias("semantic_similarity"),
    )
    basis = F.struct(
        F.col("__query").alias("raw_query"), F.col("__all").alias("normalized_query_terms"), F.col("__terms").alias("scoring_terms"), F.col("__phrases").alias("normalized_phrase_targets"), F.lit(C.STOPWORD_FILTER).alias("stopword_filter_enabled"),
        F.array_except("__all", T.words_array(C.STOPWORDS)).alias("stopword_filtered_terms"), F.transform("matched", lambda m: m["term"]).alias("matched_text_terms"), phrases.alias("matched_phrase_targets"),
        F.create_map(*[F.lit(x) for pair in kept.items() for x in pair]).cast("map<string,string>").alias("matched_metadata_filters"), features.alias("scoring_features"), T.cut(T.blank_to_null(F.col("text")), 160).alias("focal_match_excerpt"),
        F.col("sources").alias("retrieval_sources"), F.lit(mode).alias("retrieval_mode"), F.lit("contextual_window").alias("result_view"), F.lit(channel).alias("retrieval_channel"),
    )
    return joined.withColumn("match_basis", basis).drop("__query", "__terms", "__phrases", "__all", "__length", "__searchable", "__avgdl")


def with_provenance(windows: DataFrame, conversations: DataFrame, run_path: str) -> DataFrame:
    """``windows`` with ``provenance``: the files of the run, and those of the export behind the conversation and messages."""
    artifact = lambda df, field: F.col(f"source_artifact.{field}") if "source_artifact" in df.columns else F.lit(None).cast("string")
    files = conversations.select("conversation_id", artifact(conversations, "conversation_file").alias("__file"))
    inner = windows.schema["messages"].dataType.elementType.fieldNames()
    paths = F.transform("messages", lambda m: m["source_artifact"]["raw_message_path"] if "source_artifact" in inner else F.lit(None).cast("string"))
    place = [F.lit(f"{run_path}/{n}").alias(k) for k, n in (("conversations_path", "conversations"), ("messages_path", "messages"), ("manifest_path", "manifest.json"))]
    return windows.join(files, "conversation_id", "left").withColumn("provenance", F.struct(*place, F.col("__file").alias("source_conversation_file"), paths.alias("source_message_paths"))).drop("__file")
