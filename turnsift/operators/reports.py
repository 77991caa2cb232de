"""Quality and activity reports over message and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators.dedup import CONVO_ORDER, ID, seconds_since
from turnsift.operators.enrich import with_duplicate_recency
from turnsift.plans.timeline import Timeline

# Texts of the noise audit.
AUDIT_PATTERNS = [
    "All chats", "retry", "share", "Claude can make mistakes", "Research Sonnet 4", "@keyframes",
    "test message confirmation",
]


def log_counts(ruled: DataFrame) -> DataFrame:
    """Rows of the clean and the verbose log and their difference, from one pass over the classified log."""
    total = ruled.agg(F.count_if(~F.col("noise")).alias("clean"), F.count(F.lit(1)).alias("verbose"))
    return total.withColumn("filtered", F.col("verbose") - F.col("clean"))


def _type_counts() -> dict[str, Column]:
    role, text = F.col("role"), F.col("content")
    okay = text.rlike(r"^okay\d+\z")
    test_user = (role == "user") & tx.contains_any(text, ["testmessage", "VERIFICATION_TEST"])
    return {
        "user_messages": role == "user",
        "assistant_responses": role == "assistant",
        "system_messages": role == "system",
        "test_messages": test_user | ((role == "assistant") & okay),
        "legitimate_content": (role == "assistant") & ~okay & ~text.contains("Extension loaded"),
    }


def content_types(messages: DataFrame, last: int | None = 20) -> DataFrame:
    """Authors and test texts among the newest rows, or all rows without ``last``."""
    newest = messages.select(*ID, "ts", "role", "content").orderBy(F.desc("ts"), F.desc("convo_id"), F.desc("seq"))
    rows = newest.limit(last) if last else messages
    return rows.agg(*[F.count_if(c).alias(name) for name, c in _type_counts().items()])


def noise_audit(messages: DataFrame) -> DataFrame:
    """Hits per audit pattern; a row counts once for every pattern it contains."""
    lowered = F.lower("content")
    hits = [F.when(lowered.contains(p.lower()), F.lit(p)) for p in AUDIT_PATTERNS]
    found = messages.select(F.explode(F.array_compact(F.array(*hits))).alias("pattern"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("hits"))


def filtered_out(ruled: DataFrame, seconds: float = 1) -> DataFrame:
    """Rows of the classified log without a clean row of the same text less than ``seconds`` apart.

    The nearest clean rows before and after come from one ordered scan per text, so a text
    that fills a third of the log is neither joined pairwise nor sent to one task.
    """
    rows = ruled.select(*ID, "ts", "role", tx.digest(F.col("content")).alias("digest"), "noise")
    clean_ts = F.when(~F.col("noise"), F.col("ts"))
    log = Timeline(rows, ["digest"], ["ts", "convo_id", "seq"])
    log = log.scan(prev={"before": clean_ts}).scan(prev={"after": clean_ts}, back=True)
    near = (seconds_since("before") < seconds) | (seconds_since("ts", "after") < seconds)
    return log.where(F.col("noise") & ~F.coalesce(near, F.lit(False))).result(*ID, "ts", "role", "digest")


def quality_score(ruled: DataFrame) -> DataFrame:
    """Balance, filter rate and a 0 to 100 score with its grade, from one pass over the whole classified log.

    ``content_types`` with its ``last`` rows is the report on the newest rows; the score never depends on them alone.
    """
    clean = ~F.col("noise")
    lowered = F.lower("content")
    hits = [F.count_if(clean & lowered.contains(p.lower())) for p in AUDIT_PATTERNS]
    types = {name: F.count_if(clean & c).alias(name) for name, c in _type_counts().items()}
    one = ruled.agg(
        F.count_if(clean).alias("clean"), F.count(F.lit(1)).alias("verbose"), sum(hits[1:], hits[0]).alias("noise_hits"),
        types["user_messages"], types["assistant_responses"], types["test_messages"],
    ).withColumn("filtered", F.col("verbose") - F.col("clean"))
    ratio = F.col("user_messages") / F.greatest(F.col("assistant_responses"), F.lit(1))
    rate = F.when(F.col("verbose") > 0, F.col("filtered") / F.col("verbose") * 100).otherwise(F.lit(0.0))
    scored = one.withColumns({"user_assistant_ratio": F.round(ratio, 4), "filter_rate": F.round(rate, 4)})

    def points(condition):
        return F.when(condition, 25).otherwise(0)

    score = (
        points(F.col("noise_hits") == 0)
        + points((F.col("user_assistant_ratio") > 0.5) & (F.col("user_assistant_ratio") < 2))
        + points(F.col("filter_rate") > 10)
        + points(F.col("test_messages") > 0)
    )
    grade = F.when(F.col("score") >= 75, "excellent").when(F.col("score") >= 50, "good").otherwise("needs work")
    scored = scored.withColumn("score", score.cast("bigint")).withColumn("grade", grade)
    return scored.select("clean", "verbose", "filtered", "noise_hits", "user_assistant_ratio", "filter_rate", "score", "grade")


def dup_rate(messages: DataFrame) -> DataFrame:
    """Share of repeats by role, with the repeats by how recent the last sight was."""
    rows = with_duplicate_recency(messages)
    recency = F.col("recency")
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(recency.isNotNull()).alias("duplicates"),
        F.count_if(recency == "immediate").alias("immediate"),
        F.count_if(recency == "recent").alias("recent"),
        F.count_if(recency == "historical").alias("historical"),
    ).withColumn("rate", F.round(F.col("duplicates") / F.col("total"), 6))


def phase_summary(events: DataFrame) -> DataFrame:
    """Transmissions, repeats, start, end and length of each test phase of a session.

    A phase begins with its last ``test_start`` and ends with the last ``test_end`` from there on; a phase that was not
    started or is still running has no end and no length.
    """
    kind = F.col("type")
    start, end = (F.unix_millis(F.max(F.when(kind == k, F.col("ts")))) for k in ("test_start", "test_end"))
    phases = events.where(F.col("test_phase").isNotNull()).groupBy("conversation_id", "test_phase").agg(
        F.count_if(kind == "transmission").alias("transmissions"),
        F.count_if(kind == "duplicate_detected").alias("duplicates"),
        start.alias("start_ms"),
        end.alias("end_ms"),
    )
    phases = phases.withColumn("end_ms", F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms")))
    return phases.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def session_totals(events: DataFrame) -> DataFrame:
    """Length and counts over all events, in one pass."""
    kind = F.col("type")
    return events.agg(
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("duration_ms"),
        F.count_if(kind == "transmission").alias("transmissions"),
        F.count_if(kind == "duplicate_detected").alias("duplicates"),
        F.count_if(kind == "test_start").alias("tests"),
        F.count(F.lit(1)).alias("events"),
    )


def detection_method_counts(messages: DataFrame) -> DataFrame:
    """Rows and genuine inputs per detection method; missing methods count as unknown."""
    method = F.coalesce("metadata.detectionMethod", F.lit("unknown")).alias("detection_method")
    genuine = F.coalesce("metadata.signalProcessing.isGenuineUserInput", F.lit(False))
    return messages.groupBy(method).agg(F.count(F.lit(1)).alias("rows"), F.count_if(genuine).alias("genuine_inputs"))


def history_stats(messages: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct texts, last user activity and span of each session."""
    text = tx.digest(tx.norm_text(F.col("content")))
    distinct = F.count_distinct(text) if exact else F.approx_count_distinct(text, 0.02)
    return messages.groupBy("convo_id").agg(
        distinct.alias("memory_entries"),
        F.unix_millis(F.max(F.when(F.col("role") == "user", F.col("ts")))).alias("last_user_ms"),
        (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("session_ms"),
    )


def history_sketches(messages: DataFrame, precision: int = 12) -> DataFrame:
    """Per session and day: a mergeable sketch of its distinct texts, last user activity, first and last row.

    A day is sketched once and never read again; ``merged_history`` unites any days.
    """
    text = tx.digest(tx.norm_text(F.col("content")))
    return messages.groupBy("convo_id", F.to_date("ts").alias("day")).agg(
        F.hll_sketch_agg(text, precision).alias("sketch"),
        F.max(F.when(F.col("role") == "user", F.col("ts"))).alias("last_user"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def merged_history(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``history_stats`` of the sessions or groups of sessions ``by``, from sketches of their days.

    The number of texts is an estimate, with a standard error of 1.04 / sqrt(2 ** precision): 1.6 % at a precision of 12.
    """
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("memory_entries"),
        F.unix_millis(F.max("last_user")).alias("last_user_ms"),
        (F.unix_millis(F.max("last")) - F.unix_millis(F.min("first"))).alias("session_ms"),
    )


def pass_rate(results: DataFrame, by: list[str]) -> DataFrame:
    """Passed tests per group, their share and the grade."""
    rate = F.round(F.col("passed_tests") / F.col("tests") * 100, 1)
    grade = F.when(F.col("rate") >= 80, "excellent").when(F.col("rate") >= 60, "good").otherwise("needs improvement")
    return (
        results.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed_tests"))
        .withColumn("rate", rate)
        .withColumn("grade", grade)
    )


def platform_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("platform").agg(F.count(F.lit(1)).alias("messages"))


def count_changes(messages: DataFrame, seconds: int = 60) -> DataFrame:
    """Log size after every interval with new rows, and the growth since the poll before."""
    slot = F.floor(F.unix_seconds("ts") / seconds) * seconds
    added = messages.groupBy("platform", slot.alias("slot")).agg(F.count(F.lit(1)).alias("added"))
    log = Timeline(added, ["platform"], ["slot"]).scan(total={"entries": F.col("added")})
    return log.result("platform", "slot", "added", "entries")


def newest_rows(messages: DataFrame, n: int = 3) -> DataFrame:
    """The rows a log monitor shows after a change."""
    newest = messages.select(*ID, "ts", "role", tx.preview(F.col("content"), 50).alias("preview"))
    return newest.orderBy(F.desc("ts"), F.desc("convo_id"), F.desc("seq")).limit(n)


def mutation_profile(events: DataFrame) -> DataFrame:
    """Page mutations by type and target with the nodes added and removed."""
    return events.groupBy("type", "target_tag").agg(
        F.count(F.lit(1)).alias("events"), F.sum("added").alias("added"), F.sum("removed").alias("removed")
    )


def bulk_bursts(messages: DataFrame, least: int = 5, gap: float = 1) -> DataFrame:
    """Bursts of at least ``least`` assistant rows, at most ``gap`` seconds apart, and the user row before."""
    rows = messages.select(*ID, "ts", "role")
    marked = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(
        prev={"user_ts": F.when(F.col("role") == "user", F.col("ts")), "prev_role": F.col("role"), "prev_ts": F.col("ts")}
    )
    joined = (F.col("prev_role") == "assistant") & (seconds_since("prev_ts") <= gap)
    marked = marked.columns(starts=F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).scan(
        total={"burst": F.col("starts")}
    )
    bursts = marked.where(F.col("role") == "assistant").result().groupBy("convo_id", "burst").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.unix_millis("ts")).alias("start_ms"),
        F.max(F.unix_millis("ts")).alias("end_ms"),
        F.max(F.unix_millis("user_ts")).alias("user_ms"),
    )
    return bursts.where(F.col("rows") >= least).withColumn("delay_ms", F.col("start_ms") - F.col("user_ms")).drop("burst")


def tool_usage(messages: DataFrame) -> DataFrame:
    """Rows by platform and mentioned tool."""
    tools = messages.select("platform", F.explode(tx.detect_tools(F.col("content"), F.col("platform"))).alias("tool"))
    return tools.groupBy("platform", "tool").agg(F.count(F.lit(1)).alias("rows"))
