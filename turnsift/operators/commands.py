"""Media commands in assistant messages: extraction, address repair, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnsift.functions import media as md
from turnsift.functions import text as tx
from turnsift.operators.dedup import ID
from turnsift.plans.greedy import keep_if_quiet


def command_candidates(messages: DataFrame, newest: int = 20) -> DataFrame:
    """The newest command-bearing assistant row among the last ``newest`` rows of a conversation.

    Both cuts keep a bounded number of rows per conversation, which Spark applies before
    the shuffle.
    """
    last = Window.partitionBy("convo_id").orderBy(F.desc("ts"), F.desc("seq"))
    rows = messages.withColumn("age_rank", F.row_number().over(last)).where(F.col("age_rank") <= newest)
    bearing = rows.where((F.col("role") == "assistant") & md.has_command(F.col("content")))
    first = F.row_number().over(Window.partitionBy("convo_id").orderBy("age_rank"))
    return bearing.withColumn("pick", first).where(F.col("pick") == 1).drop("pick", "age_rank")


def split_command_rows(messages: DataFrame) -> DataFrame:
    """One row per command text of the command-bearing assistant rows."""
    content = tx.strip(F.col("content"))
    bearing = messages.where((F.col("role") == "assistant") & md.has_command(F.col("content")))
    return bearing.select(*ID, "ts", F.posexplode(md.split_commands(content)).alias("cmd_pos", "command_text"))


def extract_commands(messages: DataFrame) -> DataFrame:
    """Parsed commands: action, parameters and segments."""
    rows = split_command_rows(messages).withColumn("command", md.unwrap(F.col("command_text")))
    rows = rows.withColumn("action", md.command_action(F.col("command"))).where(F.col("action").isNotNull())
    command, action = F.col("command"), F.col("action")

    def rest(keyword: str):
        return tx.strip(F.substr(command, F.lit(len(keyword) + 1)))

    volume = F.when(action == "VOLUME", md.volume_value(command).cast("string"))
    label = F.when(action.isin("CAPTION", "OVERLAY"), rest("CAPTION:"))
    params = F.map_filter(
        F.create_map(F.lit("volume"), volume, F.lit("text"), label), lambda _, v: v.isNotNull()
    )
    none = F.array().cast(
        "array<struct<url:string,start:double,end:double,caption:string,volume:double,media_type:string>>"
    )
    segments = (
        F.when(action == "PLAY", md.play_segments(rest("PLAY:")))
        .when(action == "SEQUENCE", md.sequence_segments(rest("SEQUENCE:")))
        .otherwise(none)
    )
    return rows.select(*ID, "ts", "cmd_pos", "action", params.alias("params"), segments.alias("segments"))


def command_segments(commands: DataFrame) -> DataFrame:
    """One row per segment with its duration."""
    rows = commands.select(*ID, "ts", "cmd_pos", "action", F.posexplode("segments").alias("segment_pos", "segment"))
    flat = rows.select(*ID, "ts", "cmd_pos", "action", "segment_pos", "segment.*")
    return flat.withColumn("duration", md.segment_duration(F.col("start"), F.col("end")))


def play_url_findall(messages: DataFrame) -> DataFrame:
    """Addresses that directly follow a PLAY keyword in assistant rows."""
    found = F.regexp_extract_all("content", F.lit(r"PLAY:\s*(https?://[^\s\x{00A0}]+)"), F.lit(1))
    rows = messages.where(F.col("role") == "assistant")
    return rows.select(*ID, F.posexplode(found).alias("pos", "url"))


def repair_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Score of each address before and after repair, and the address to use."""
    original = F.col(url)
    scored = urls.withColumns({
        "clean": md.clean_url(original),
        "valid": md.is_valid_url(original),
        "confidence": md.url_confidence(original),
        "repaired": md.repair_url(original),
        "best": md.best_url(original),
        "media_type": md.media_type(original),
    })
    return scored.withColumn("repaired_confidence", md.url_confidence(F.col("repaired")))


def url_repair_audit(urls: DataFrame, url: str = "url") -> DataFrame:
    """Scores, repair and what a PLAY command with the address becomes."""
    scored = repair_urls(urls, url)
    sample = tx.contains_any(F.lower(md.unwrap(F.concat(F.lit("PLAY: "), F.col(url)))), md.SAMPLE_PHRASES)
    final = F.when(~sample, md.play_url(F.col(url)))
    return scored.withColumn("final_url", final).withColumn("final_media_type", md.media_type(F.col("final_url")))


def command_dedup(messages: DataFrame, seconds: int = 3) -> DataFrame:
    """Command-bearing rows; ``kept`` is false under ``seconds`` after a kept equal text."""
    content = tx.strip(F.col("content"))
    bearing = messages.where((F.col("role") == "assistant") & md.has_command(F.col("content")))
    rows = bearing.select(*ID, "ts", tx.digest(content).alias("digest"))
    return keep_if_quiet(rows, ["digest"], "ts", ID, F.lit(seconds), strict=True).drop("digest")


def url_replay_dedup(commands: DataFrame, seconds: int = 3) -> DataFrame:
    """PLAY commands; ``kept`` is false under ``seconds`` after the address was played, unless timed."""
    plays = commands.where((F.col("action") == "PLAY") & (F.size("segments") > 0))
    first = F.get("segments", 0)
    timed = (first["start"] > 0) | (first["end"] > 0)
    rows = plays.select(*ID, "ts", "cmd_pos", md.clean_url(first["url"]).alias("url"), timed.alias("timed"))
    rows = rows.withColumn("url_key", tx.digest(F.col("url")))
    kept = keep_if_quiet(rows, ["url_key"], "ts", [*ID, "cmd_pos"], F.lit(seconds), strict=True, forced=F.col("timed"))
    return kept.drop("url_key")
