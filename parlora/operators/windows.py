"""Context windows round ranked messages, suppression of repeats, and the timeline view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..session import ship_sources, stored
from .index import with_positions


def _of_conversations(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """The messages of the conversations that ``rows`` name, so that no others are sorted."""
    return messages.join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi").select(*messages.columns)


def with_ranges(candidates: DataFrame, messages: DataFrame, radius: int = C.WINDOW_RADIUS) -> DataFrame:
    """Adds the focal ``sequence_index`` and the first and last one of the window, cut at the conversation's ends."""
    frame = Window.partitionBy("conversation_id").orderBy("pos").rowsBetween(-radius, radius)
    seq = F.coalesce("sequence_index", F.lit(0))
    ranges = with_positions(_of_conversations(messages, candidates)).select("message_id", seq.alias("focal_sequence"), F.first(seq).over(frame).alias("window_start"), F.last(seq).over(frame).alias("window_end"))
    return candidates.join(ranges, "message_id")


def duplicate_key(text: Column) -> Column:
    """The first characters of a normalized text that is long enough to be told apart; null for short ones."""
    own = T.normalized(text)
    return F.when(F.length(own) >= C.DUP_PREFIX, F.substring(own, 1, C.DUP_PREFIX))


def accepted(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Rows of one query that stay, walked by rank.

    A row goes whose focal message stands in an accepted window of its conversation, or whose long text begins like an
    accepted one; the latter doesn't register its window. One row is taken before the limit is looked at.
    """
    spans: dict[str, list[tuple[int, int]]] = {}
    texts, rows = set(), []
    for row in pdf.sort_values("rank").itertuples(index=False):
        own = spans.setdefault(row.conversation_id, [])
        if any(a <= row.focal_sequence <= b for a, b in own):
            continue
        if isinstance(row.dup_key, str):
            if row.dup_key in texts:
                continue
            texts.add(row.dup_key)
        own.append((row.window_start, row.window_end))
        rows.append((row.query_id, row.message_id, len(rows) + 1))
        if len(rows) >= limit:
            break
    return pd.DataFrame(rows, columns=["query_id", "message_id", "result_rank"])


#: Rows of each query's ranking that one search stores; a walk that goes beyond them searches again for 16 times as many.
POOL = 4_096


def greedy_accept(ranked: DataFrame, messages: DataFrame, limit: int, radius: int = C.WINDOW_RADIUS) -> DataFrame:
    """The first ``limit`` acceptable rows of each query, with their range and ``result_rank``.

    The rows are few and are stored, so what follows doesn't search again. The walk reads a prefix of each query's
    ranking; the prefix doubles for as long as some query has neither enough rows nor seen all of its candidates. The
    head of the ranking is stored too, so a longer prefix is no new search.
    """
    ship_sources(messages)
    columns = ["query_id", "message_id", "conversation_id", "rank", "focal_sequence", "window_start", "window_end", "dup_key"]
    take = max(64, 16 * limit)
    size = max(POOL, take)
    pool = stored(ranked.where(F.col("rank") <= size + 1), "ranked")
    while True:
        if take > size:
            size = max(take, 16 * size)
            pool = stored(ranked.where(F.col("rank") <= size + 1), "ranked")
        prefix = with_ranges(pool.where(F.col("rank") <= take), messages, radius).withColumn("dup_key", duplicate_key(F.col("text"))).persist()
        chosen = prefix.select(*columns).groupBy("query_id").applyInPandas(lambda pdf: accepted(pdf, limit), "query_id long, message_id string, result_rank int")
        # A query with a row beyond the prefix has more candidates; one with too few rows then needs them.
        short = prefix.groupBy("query_id").agg(F.max("rank").alias("last")).where(F.col("last") == take).join(chosen.groupBy("query_id").agg(F.count("*").alias("got")), "query_id").where(F.col("got") < max(1, limit))
        if not short.take(1) or not pool.where(F.col("rank") == take + 1).join(short, "query_id", "left_semi").take(1):
            break
        prefix.unpersist()
        take *= 2
    out = stored(prefix.join(chosen, ["query_id", "message_id"]).drop("dup_key"), "accepted")
    prefix.unpersist()
    return out


def context_windows(accepted_rows: DataFrame, messages: DataFrame, radius: int = C.WINDOW_RADIUS, run_id: str = "run", conversations: DataFrame | None = None) -> DataFrame:
    """Adds ``messages``, the ordered messages of the window, and ``result_id``; rows without a conversation go."""
    near = with_positions(_of_conversations(messages, accepted_rows)).select(F.col("conversation_id").alias("c"), F.col("pos").alias("p"), F.struct(*[c for c in messages.columns]).alias("m"))
    focal = accepted_rows.withColumn("at", F.explode(F.sequence(F.greatest(F.col("pos") - radius, F.lit(0)), F.col("pos") + radius)))
    joined = focal.join(near, (F.col("conversation_id") == F.col("c")) & (F.col("at") == F.col("p")))
    windows = joined.groupBy("query_id", "message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("messages"))
    out = accepted_rows.join(windows, ["query_id", "message_id"])
    out = out.withColumn("result_id", F.concat_ws(":", F.lit(run_id), "message_id", "window_start", "window_end"))
    if conversations is not None:
        out = out.join(conversations.select("conversation_id", F.col("title").alias("conversation_title")), "conversation_id")
    return out


def timeline(candidates: DataFrame, limit: int) -> DataFrame:
    """The oldest ``limit`` distinct messages of each query, flat, with an excerpt."""
    from .retrieval import mode_order

    once = candidates.dropDuplicates(["query_id", "message_id"])
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*mode_order("timeline"))))
    return ranked.where(F.col("rank") <= limit).withColumn("excerpt", T.cut(T.blank_to_null(F.col("text")), 160))
