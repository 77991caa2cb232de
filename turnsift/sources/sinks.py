"""Log sinks: retention, the verbose / recent / clean split, session export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows kept per log.
RETENTION = {"clean": 100, "verbose": 100, "recent": 2, "diagnostic": 1000, "analytics": 2000}


def rolling_retention(rows: DataFrame, sink: list[str], newest: list[Column], limits: dict[str, int] | int) -> DataFrame:
    """The newest rows of each sink: the same number everywhere, or by the name in ``sink[0]``.

    The largest number is a constant in the filter on the rank, so every map task cuts its
    own rows to it before the shuffle and no task sees a whole sink.
    """
    rank = F.row_number().over(Window.partitionBy(*sink).orderBy(*newest))
    if isinstance(limits, int):
        return rows.withColumn("age_rank", rank).where(F.col("age_rank") <= limits)
    kept = rows.withColumn("age_rank", rank).where(F.col("age_rank") <= max(limits.values()))
    bounds = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return kept.where(F.col("age_rank") <= bounds[F.col(sink[0])])


def fan_out(decisions: DataFrame, folder: str) -> dict[str, str]:
    """Write the verbose and clean logs from one decision table, computed once.

    ``decisions`` has ``action``: ``keep`` rows reach both logs, ``verbose_only`` rows the
    verbose one.  One partitioned write serves both; readers pick partitions.
    """
    logged = decisions.where(F.col("action").isin("keep", "verbose_only"))
    logged.write.mode("append").partitionBy("action").parquet(f"{folder}/messages")
    return {"verbose": f"{folder}/messages", "clean": f"{folder}/messages/action=keep"}


def session_summary_documents(events: DataFrame) -> DataFrame:
    """Counts per session, one document each; the events stay rows of their own files."""
    kind = F.col("type")
    return events.groupBy("conversation_id").agg(
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("sessionDuration"),
        F.count_if(kind == "transmission").alias("totalTransmissions"),
        F.count_if(kind == "duplicate_detected").alias("totalDuplicates"),
        F.count_if(kind == "test_start").alias("totalTests"),
        F.count_if(kind == "conversation_event").alias("conversationEvents"),
    )


def export_session_summary(events: DataFrame, folder: str) -> None:
    """Session documents next to the events, both as JSON, events partitioned by type."""
    session_summary_documents(events).write.mode("overwrite").json(f"{folder}/summary")
    events.write.mode("overwrite").partitionBy("type").json(f"{folder}/events")
