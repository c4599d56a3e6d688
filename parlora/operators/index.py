"""The lexical index of a run: positions, token counts, document frequencies, postings.

Statistics cover all messages, whatever a query filters later. They are built once a run and stored, each file of
postings sorted by term. Texts stay where they are read; only ids are sorted for positions, so that a conversation with
a large share of the messages isn't one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_positions(messages: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of a message in its conversation by (sequence_index, message_id)."""
    order = Window.partitionBy("conversation_id").orderBy(F.coalesce("sequence_index", F.lit(0)), "message_id")
    return messages.withColumn("pos", F.row_number().over(order) - 1)


@dataclass
class Index:
    """Tables of the lexical index.

    ``docs`` (message_id, conversation_id, searchable, length), ``places`` (message_id, pos), ``postings`` (term,
    message_id, tf, length), ``terms`` (term, df), ``stats`` (n, avgdl).
    """

    docs: DataFrame
    places: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Store the tables below ``path``, each read from the one before; fails where they exist."""
        spark = self.docs.sparkSession
        self.docs.write.parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        self.places.write.parquet(f"{path}/places")
        once = not docs.groupBy("message_id").count().where("count > 1").take(1)
        (_runs(docs).repartition("term", "message_id") if once else _postings(docs)).sortWithinPartitions("term", "message_id").write.parquet(f"{path}/postings")
        _terms(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        _stats(docs).coalesce(1).write.parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """The index stored below ``path``."""
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "places", "postings", "terms", "stats")))


def _postings(docs: DataFrame) -> DataFrame:
    terms = F.explode(F.filter(F.split("searchable", " "), lambda t: t != ""))
    return docs.select("message_id", "length", terms.alias("term")).groupBy("term", "message_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _runs(docs: DataFrame) -> DataFrame:
    """The postings of messages whose ids stand once: runs of equal tokens of each sorted text, no grouping over all."""
    toks = docs.select("message_id", "length", F.sort_array(F.filter(F.split("searchable", " "), lambda t: t != "")).alias("toks"))
    opens = F.filter(F.transform("toks", lambda t, i: F.when((i == 0) | (t != F.get("toks", i - 1)), i)), lambda i: i.isNotNull())
    runs = toks.select("message_id", "length", "toks", opens.alias("opens")).select("message_id", "length", F.explode(F.transform("opens", lambda i, k: F.struct(F.get("toks", i).alias("term"), (F.coalesce(F.get("opens", k + 1), F.col("length")) - i).cast("long").alias("tf")))).alias("run"))
    return runs.select("run.term", "message_id", "run.tf", "length")


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def build_index(messages: DataFrame) -> Index:
    """The index of ``messages`` (message_id, conversation_id, sequence_index, text, content_blocks optional)."""
    blocks = F.col("content_blocks") if "content_blocks" in messages.columns else None
    docs = messages.select("message_id", "conversation_id", T.searchable(F.col("text"), blocks).alias("searchable"))
    docs = docs.withColumn("length", F.size(F.filter(F.split("searchable", " "), lambda t: t != "")))
    places = with_positions(messages.select("message_id", "conversation_id", "sequence_index")).select("message_id", "pos")
    postings = _postings(docs)
    return Index(docs, places, postings, _terms(postings), _stats(docs))
