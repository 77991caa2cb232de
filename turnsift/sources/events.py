"""Diagnostic and analytics events posted as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift import schemas
from turnsift.functions import text as tx


def ingest_diagnostic(lines: DataFrame, line: str = "value") -> DataFrame:
    """Raw transmission events with their element signature."""
    doc = F.from_json(line, schemas.DIAGNOSTIC)
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, doc.alias("d")).select(
        *kept,
        F.coalesce("d.type", F.lit("diagnostic")).alias("type"),
        F.timestamp_millis("d.timestamp").alias("ts"),
        F.col("d.transmissionType").alias("transmission_type"),
        F.col("d.elementSignature").alias("element"),
        F.col("d.conversationContext").alias("context"),
    )


def ingest_analytics(lines: DataFrame, line: str = "value") -> DataFrame:
    """Analytics events; ``data`` stays JSON because its shape depends on ``type``."""
    doc = F.from_json(line, schemas.ANALYTICS)
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, doc.alias("d")).select(
        *kept,
        F.timestamp_millis("d.timestamp").alias("ts"),
        F.col("d.sessionTime").alias("session_time"),
        F.col("d.type").alias("type"),
        F.col("d.testPhase").alias("test_phase"),
        F.col("d.url").alias("url"),
        F.col("d.conversationId").alias("conversation_id"),
        F.col("d.data").alias("data"),
    )


def analytics_flatten(events: DataFrame) -> DataFrame:
    """One row per event with the fields its type carries."""

    def field(path: str, kinds: list[str], default: Column) -> Column:
        value = F.get_json_object("data", f"$.{path}")
        return F.when(F.col("type").isin(kinds), F.coalesce(value, default))

    unknown = F.lit("unknown")
    zero = F.lit("0")
    return events.withColumns({
        "role": field("role", ["transmission"], unknown),
        "is_duplicate": field("isDuplicate", ["transmission"], F.lit("false")).cast("boolean"),
        "pattern": field("duplicateInfo.pattern", ["duplicate_detected"], unknown),
        "text_preview": tx.preview(field("text", ["transmission", "duplicate_detected"], F.lit("")), 50),
        "event_subtype": field("eventType", ["conversation_event"], unknown),
        "test_name": field("testName", ["test_start", "test_end"], unknown),
        "tx_count": field("transmissionCount", ["test_end"], zero).cast("bigint"),
        "dup_count": field("duplicateCount", ["test_end"], zero).cast("bigint"),
    }).drop("data")
