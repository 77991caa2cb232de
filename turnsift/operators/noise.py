"""Noise classification of message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import noise as rules
from turnsift.functions import text as tx
from turnsift.plans.timeline import Timeline


def classify_noise(messages: DataFrame) -> DataFrame:
    """Add ``noise_rule`` (first matching content rule) and ``noise``."""
    ruled = messages.withColumn("noise_rule", rules.noise_rule(F.col("content"), F.col("urls")))
    return ruled.withColumn("noise", rules.is_noise(F.col("noise_rule")))


def platform_noise(messages: DataFrame) -> DataFrame:
    """The row-level checks of the two capture adapters, one flag each."""
    text = F.col("content")
    return messages.withColumns({
        "chatgpt_ui": rules.chatgpt_ui_noise(text),
        "thinking": rules.thinking_noise(text),
        "echo_phrase": rules.echo_phrase_noise(text),
        "feedback": rules.feedback_noise(text),
        "placeholder": rules.incomplete_placeholder(text),
        "claude_ui": rules.claude_ui_noise(text),
        "button": rules.ui_button_token(text),
        "sonnet_keep": rules.sonnet_preserve(text),
    })


def startup_grace(messages: DataFrame, session: str = "convo_id", seconds: int = 10) -> DataFrame:
    """Rows from ``seconds`` after the first row of their session on."""
    rows = Timeline(messages, [session], ["ts", "seq"]).scan(first={"session_start": F.col("ts")})
    age = F.unix_micros("ts") - F.unix_micros("session_start")
    return rows.where(age >= seconds * 1_000_000).result()


def signal_flag(metadata: str = "metadata") -> tuple[Column, Column]:
    """(is noise, reasons) as the capture side marked them; missing marks count as false."""
    signal = f"{metadata}.signalProcessing"
    flag = F.coalesce(F.col(f"{signal}.filtered"), F.lit(False)) | F.coalesce(
        F.col(f"{metadata}.isSignalNoise"), F.lit(False)
    )
    by = F.col(f"{signal}.filteredBy")
    reasons = F.coalesce(
        F.when(F.size(by) > 0, by), F.col(f"{metadata}.signalProcessingFilter"), F.array().cast("array<string>")
    )
    return flag, reasons


def final_noise(messages: DataFrame) -> DataFrame:
    """Content noise or a capture-side mark."""
    flag, reasons = signal_flag()
    return classify_noise(messages).withColumns({"signal_noise": flag, "signal_reasons": reasons}).withColumn(
        "final_noise", F.col("noise") | F.col("signal_noise")
    )


def baseline_exclude(messages: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows whose text was not on the page at the start.  The strategy is left to runtime sizes."""
    known = baseline.select(tx.digest(F.col("content")).alias("digest")).distinct()
    return messages.withColumn("digest", tx.digest(F.col("content"))).join(known, "digest", "left_anti").drop("digest")
