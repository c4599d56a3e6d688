"""Building vectors of messages: eligibility, selection, cutting, batches of an outside service."""

from __future__ import annotations

import random
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas as S
from ..session import ship_sources
from ..functions import text as T

Client = Callable[[list[str], str], list[list[float]]]


def filter_reason(searchable: Column, role: Column) -> Column:
    """Why a message gets no vector, the first that applies; null for eligible ones."""
    one = (F.size(T.tokens(searchable)) == 1) & (F.length(searchable) <= 2)
    return (
        F.when(searchable == "", "empty_text").when(T.blank_to_null(role) == "tool", "tool_role")
        .when(searchable.isin(*sorted(C.ACKNOWLEDGMENTS)), "low_information_ack").when(one, "trivially_short")
    )


def reason_counts(messages: DataFrame) -> DataFrame:
    """(reason, n), eligible messages under ``eligible``."""
    reason = filter_reason(F.col("searchable"), F.col("author_role"))
    return messages.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def targeted(messages: DataFrame, conversation_ids: tuple[str, ...] = (), message_ids: tuple[str, ...] = ()) -> DataFrame:
    """Messages of the conversations or with the ids asked for; all of them if nothing is."""
    if not (conversation_ids or message_ids):
        return messages
    return messages.where(F.col("conversation_id").isin(*filter(None, conversation_ids)) | F.col("message_id").isin(*filter(None, message_ids)))


def subset(messages: DataFrame, offset: int = 0, limit: int | None = None, sample: int | None = None, seed: int = 0, exact: bool = False) -> DataFrame:
    """Messages by (conversation_id, sequence_index, message_id) after ``offset``, at most ``limit``, of these a sample.

    The sample is by a hash of id and seed, in Spark. ``exact`` instead draws indices on the driver with Python's
    generator, for the same choice as a single-process build.
    """
    order = ["conversation_id", F.coalesce("sequence_index", F.lit(0)), "message_id"]
    out = messages.orderBy(*order).offset(max(offset, 0))
    out = out if limit is None else out.limit(max(limit, 0))
    if sample is None:
        return out
    if not exact:
        return out.orderBy(F.xxhash64("message_id", F.lit(seed)), "message_id").limit(max(sample, 0)).orderBy(*order)
    ids = [r[0] for r in out.select("message_id").collect()]
    drawn = sorted(random.Random(seed).sample(range(len(ids)), min(max(sample, 0), len(ids))))
    return out.where(F.col("message_id").isin(*[ids[k] for k in drawn])) if drawn else out.limit(0)


def cut_text(text: Column, most: int = C.EMBED_LIMIT) -> Column:
    """The first ``most`` characters."""
    return F.substring(text, 1, most)


def embed(messages: DataFrame, client: Client, model: str, run_id: str, most: int = C.EMBED_LIMIT, batch: int = C.EMBED_BATCH, built_at: str | None = None, total: int | None = None) -> DataFrame:
    """Embedding records of eligible messages (with ``searchable``); ``client`` must be picklable and return a vector
    for each text."""
    ready = messages.where(filter_reason(F.col("searchable"), F.col("author_role")).isNull()).withColumn("full", T.blank_to_null(F.col("text")))
    ready = ready.withColumn("full", F.coalesce("full", "searchable")).withColumn("stored", cut_text(F.col("full"), most))
    ready = ready.select("message_id", "conversation_id", F.coalesce("provider", F.lit("unknown")).alias("provider"), "author_role", "created_at", F.coalesce("sequence_index", F.lit(0)).alias("sequence_index"), F.length("full").alias("whole"), "stored")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                vectors = client(list(part["stored"]), model)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                rows = []
                for r, v in zip(part.itertuples(), vectors):
                    rows.append((run_id, r.message_id, r.conversation_id, r.provider, r.author_role, r.created_at, r.sequence_index, model, len(v), r.stored, r.whole, len(r.stored), len(r.stored) < r.whole, None, None, total, built_at, None, None, None, None, [float(x) for x in v]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _columns()])

    return ship_sources(ready).mapInPandas(run, S.EMBEDDING)


def with_defaults(records: DataFrame) -> DataFrame:
    """Embedding records with every column of the schema: missing or blank values take their defaults.

    A record without a vector fails the query. Dimensions default to the vector's length, text lengths to the text's.
    """
    kinds = dict(c.split() for c in _columns())
    have = lambda n: F.col(n) if n in records.columns else F.lit(None)
    text = lambda n: T.blank_to_null(have(n).cast("string"))
    vector = have("embedding").cast("array<double>")
    length = F.length(F.coalesce(text("text"), F.lit("")))
    of = {n: text(n) if k == "string" else have(n).cast(k) for n, k in kinds.items()}
    for n in ("run_id", "message_id", "conversation_id", "embedding_model", "text"):
        of[n] = F.coalesce(of[n], F.lit(""))
    of["provider"] = F.coalesce(of["provider"], F.lit("unknown"))
    of["sequence_index"] = F.coalesce(of["sequence_index"], F.lit(0))
    of["embedding_dimensions"] = F.coalesce(of["embedding_dimensions"], F.size(vector))
    for n in ("original_text_length", "stored_text_length"):
        of[n] = F.coalesce(of[n], length)
    of["truncation_occurred"] = F.coalesce(of["truncation_occurred"], F.lit(False))
    of["embedding"] = F.when(vector.isNull(), F.raise_error(F.concat(F.lit("no vector for message "), of["message_id"])).cast("array<double>")).otherwise(vector)
    return records.select(*[of[n].alias(n) for n in kinds])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The records stored at ``path``, Parquet or JSONL (a file whose name ends so), with defaults."""
    return with_defaults(spark.read.json(path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path))


def _columns() -> list[str]:
    return [c.strip() for c in S.EMBEDDING.split(",")]


def replace_artifact(records: DataFrame, path: str) -> None:
    """Write records beside ``path`` and put them in its place as a whole."""
    target, staged = Path(path), Path(f"{path}.staged")
    shutil.rmtree(staged, ignore_errors=True)
    records.write.parquet(str(staged))
    shutil.rmtree(target, ignore_errors=True)
    staged.rename(target)
