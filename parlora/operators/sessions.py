"""Sessions, gaps and bursts of dated events, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..session import ship_sources


def phase_sessions(events: DataFrame, key: str, date: str, days: int = C.PHASE_DAYS) -> DataFrame:
    """(key, session, first_date, last_date, n): runs of dates at most ``days`` apart, by time alone."""
    order = Window.partitionBy(key).orderBy(date)
    previous = F.lag(date).over(order)
    opens = F.when(previous.isNotNull() & (D.days_between(previous, F.col(date)) > days), 1).otherwise(0)
    marked = events.withColumn("opens", opens).withColumn("session", F.sum("opens").over(order))
    return marked.groupBy(key, "session").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def session_gaps(sessions: DataFrame, key: str, days: int) -> DataFrame:
    """(key, gap_from, gap_to, days) of neighbouring sessions at least ``days`` apart."""
    order = Window.partitionBy(key).orderBy("session")
    following = sessions.withColumn("gap_to", F.lead("first_date").over(order)).where("gap_to is not null")
    apart = D.days_between(F.col("last_date"), F.col("gap_to"))
    return following.select(key, F.col("last_date").alias("gap_from"), "gap_to", apart.alias("days")).where(F.col("days") >= days)


def temporal_bursts(dated: DataFrame, key: str, date: str, days: int = C.BURST_DAYS, least: int = C.BURST_PHASES) -> DataFrame:
    """(key, first_date, last_date, n): windows anchored on their first date, without overlap; a scan by key."""
    from ..plans.patterns import burst_ranges

    kind = dated.schema[key].dataType.simpleString()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        dates = sorted(pdf[date])
        rows = [(pdf[key].iloc[0], dates[i], dates[j - 1], j - i) for i, j in burst_ranges(dates, days, least)]
        return pd.DataFrame(rows, columns=[key, "first_date", "last_date", "n"])

    return ship_sources(dated).select(key, date).where(F.col(date).isNotNull()).groupBy(key).applyInPandas(scan, f"{key} {kind}, first_date string, last_date string, n int")
