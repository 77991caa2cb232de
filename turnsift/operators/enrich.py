"""Message enrichment: one projection, plus role inference along a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.plans.timeline import Timeline

# Echo thresholds per model (model, leading characters, greetings exempt, window in ms).
MODEL_FILTERS = [("sonnet-4", 3, True, 5000), ("opus-4.1", 2, False, 3000), ("unknown", 2, True, 3000)]
ORDER = ["ts", "seq"]


def enrich_messages(messages: DataFrame) -> DataFrame:
    """All row-level attributes of a message in one projection."""
    content, platform = F.col("content"), F.col("platform")
    return messages.withColumns({
        "norm_content": tx.norm_text(content),
        "clean_content": F.when(F.col("role") == "assistant", tx.clean_assistant_prefix(content)).otherwise(content),
        "urls": tx.text_urls(content),
        "tools": tx.detect_tools(content, platform),
        "msg_id": tx.message_id(platform, F.col("role"), F.col("ts")),
        "message_length": tx.message_length(content),
        "model": tx.model_from_text(content),
        "pipeline": tx.pipeline_label(tx.model_from_text(content)),
        "content_key": F.xxhash64("role", "content"),
        "is_command": tx.is_musical_command(content, "capture"),
    })


def filter_config(spark: SparkSession) -> DataFrame:
    """The echo settings as a table of three rows."""
    rows = ", ".join(f"('{m}', {c}L, {str(g).lower()}, {w}L)" for m, c, g, w in MODEL_FILTERS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, echo_chars, allow_greetings, temporal_window)")


def with_filter_config(messages: DataFrame, model: str = "model") -> DataFrame:
    """Add the settings of each row's model; models without settings use ``unknown``."""
    config = filter_config(messages.sparkSession)
    known = [name for name, *_ in MODEL_FILTERS]
    config_model = F.when(F.col(model).isin(known), F.col(model)).otherwise("unknown")
    # Three rows by construction, so the broadcast is bounded.
    settings = F.broadcast(config.withColumnRenamed("model", "config_model"))
    return messages.withColumn("config_model", config_model).join(settings, "config_model")


def duplicate_recency(gap_ms: Column) -> Column:
    """How long ago a text was last seen; null for a first sight."""
    return (
        F.when(gap_ms < 1000, "immediate").when(gap_ms < 30000, "recent").when(gap_ms.isNotNull(), "historical")
    )


def with_duplicate_recency(messages: DataFrame, session: str = "convo_id") -> DataFrame:
    keyed = messages.withColumn("digest", tx.digest(tx.norm_text(F.col("content"))))
    seen = Timeline(keyed, [session, "digest"], ORDER).scan(prev={"last_seen": F.col("ts")})
    gap = F.unix_millis("ts") - F.unix_millis("last_seen")
    return seen.columns(gap_ms=gap).columns(recency=duplicate_recency(F.col("gap_ms"))).result()


def infer_role_flow(messages: DataFrame, session: str = "convo_id") -> DataFrame:
    """Role by explicit mark, typing, the time since the last user row, position, then text.

    Input columns: ``role_attr`` (explicit role or null), ``typed`` (recently typed) and
    ``structural`` (inside a message container).  The clock of user activity follows rows
    marked or typed as user.
    """
    text = F.col("content")
    shown_user = F.col("role_attr") == "user"
    rows = Timeline(messages, [session], ORDER).scan(prev={"user_ts": F.when(shown_user | F.col("typed"), F.col("ts"))})
    since = F.unix_millis("ts") - F.unix_millis("user_ts")
    explicit = F.when(F.col("role_attr").isin("user", "assistant"), F.col("role_attr"))
    rows = rows.columns(
        early=F.coalesce(
            explicit,
            F.when(F.col("typed") & (since < 5000), F.lit("user")),
            F.when((since < 30000) & (since > 1000), F.lit("assistant")),
        )
    )
    alternates = F.col("early").isNull() & F.col("structural")
    rows = rows.scan(total={"place": F.when(alternates, 1).otherwise(0)})
    confirms = (F.length(text) < 50) & (
        text.contains("_ok") | text.rlike(r"(?i)^(ok|yes|no|done|thanks|sure)\z") | text.rlike(r"^\w+_\w+\z")
    )
    asks = (F.length(text) > 20) & (
        text.contains("?") | text.rlike("(?i)^(can you|please|how|what|when|where|why)") | text.rlike("^[A-Z]")
    )
    role = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("structural") & (F.col("place") % 2 == 1), "user")
        .when(F.col("structural"), "assistant")
        .when(confirms, "assistant")
        .when(asks, "user")
        .otherwise("unknown")
    )
    return rows.columns(inferred_role=role).result().drop("early", "place", "user_ts")
