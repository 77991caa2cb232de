"""Windowed anomaly filters over ordered conversations and the pipelines built from them.

Columns: ``convo_id, seq, ts, role, content``.  Unless said otherwise a filter adds one
column with its reason, null when the row passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnsift.functions import noise
from turnsift.functions import text as tx
from turnsift.operators.dedup import (
    CONVO_ORDER, ID, echo_rows, genuine_response_strict, leading_echo_ids, narrow, near_first_sight, seconds_since,
)
from turnsift.operators.noise import baseline_exclude
from turnsift.plans.timeline import Timeline, trailing_count
from turnsift.session import cut_lineage

# Fixed values of the filters: counts and seconds.
EXT = {"velocity": 25, "velocity_s": 1, "active_s": 120, "repeat_s": 30, "hashes": 20, "matches": 3}
LAB = {"velocity": 5, "velocity_s": 1, "conversation_s": 300, "active_s": 120, "musical_s": 60, "repeat_s": 30,
       "hashes": 20, "run": 3}


def user_ts() -> Column:
    return F.when(F.col("role") == "user", F.col("ts"))


def velocity_ext(
    messages: DataFrame, threshold: int = 25, seconds: float = 1, session: str = "convo_id"
) -> DataFrame:
    """``bulk``: more than ``threshold`` rows in the trailing window.

    That is the case exactly when the row ``threshold`` places back is still inside it.
    """
    log = Timeline(messages, [session], CONVO_ORDER).scan(lag={"nth": (F.col("ts"), threshold)})
    bulk = F.coalesce(seconds_since("nth") < seconds, F.lit(False))
    return log.columns(bulk=bulk).result().drop("nth")


def velocity_lab(messages: DataFrame, threshold: int = 5, seconds: float = 1) -> DataFrame:
    """``velocity_bulk_dump``: more than ``threshold`` rows in the window, at least that many of the role."""
    rows = messages.select(*ID, "ts", "role")
    log = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(lag={"nth": (F.col("ts"), threshold)}).result()
    roles = Timeline(log, ["convo_id", "role"], CONVO_ORDER)
    roles = roles.scan(lag={"nth_role": (F.col("ts"), threshold - 1)})
    dump = (seconds_since("nth") < seconds) & (seconds_since("nth_role") < seconds)
    return roles.columns(reason=F.when(dump, "velocity_bulk_dump")).result(*ID, "ts", "role", "reason")


def temporal_ext(messages: DataFrame, baseline: DataFrame, seconds: int = 120) -> DataFrame:
    """``stale``: the last user row is over ``seconds`` ago and the text was not on the page before."""
    rows = messages.select(*ID, "ts", "role", "content")
    idle = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(prev={"user_ts": user_ts()})
    idle = idle.columns(idle=F.coalesce(seconds_since("user_ts") > seconds, F.lit(False))).result(*ID, "ts", "role", "content", "idle")
    fresh = baseline_exclude(idle.where("idle"), baseline).select(*ID, F.lit(True).alias("stale"))
    return idle.select(*ID, "ts", "role").join(fresh, ID, "left").fillna(False, ["stale"])


def temporal_lab(messages: DataFrame) -> DataFrame:
    """``temporal_historical``: text last seen over five minutes ago, user idle over two."""
    rows = narrow(messages)
    seen = Timeline(rows, ["convo_id", "digest"], CONVO_ORDER).scan(prev={"seen": F.col("ts")}).result()
    log = Timeline(seen, ["convo_id"], CONVO_ORDER).scan(prev={"user_ts": user_ts()})
    idle = F.coalesce(seconds_since("user_ts") > LAB["active_s"], F.lit(True))
    old = (seconds_since("seen") > LAB["conversation_s"]) & idle
    return log.columns(reason=F.when(old, "temporal_historical")).result(*ID, "ts", "role", "reason")


def with_pattern(rows: DataFrame) -> DataFrame:
    """Add ``pattern``: the last three digests all occur in the older part of the last twenty."""
    log = Timeline(rows, ["convo_id"], CONVO_ORDER)
    log = log.scan(tail={"recent": (F.col("digest"), EXT["hashes"] - 1)})
    ring = F.concat("recent", F.array("digest"))
    older = F.slice(ring, 1, F.greatest(F.size(ring) - 3, F.lit(0)))
    last = F.slice(ring, F.greatest(F.size(ring) - 2, F.lit(1)), 3)
    log = log.columns(older=older, last=last)
    matches = F.size(F.filter("last", lambda h: F.array_contains("older", h)))
    return log.columns(pattern=matches >= EXT["matches"]).result().drop("recent", "older", "last")


def autocorr_ext(messages: DataFrame) -> DataFrame:
    """``pattern``: the last three texts all occur in the older part of the last twenty."""
    return with_pattern(narrow(messages)).select(*ID, "ts", "role", "pattern")


def autocorr_lab(messages: DataFrame) -> DataFrame:
    """``autocorrelation_pattern``: a seen text while a run of three seen texts is among the last twenty."""
    rows = narrow(messages)
    seen = Timeline(rows, ["convo_id", "digest"], CONVO_ORDER).scan(prev={"seen": F.col("ts")}).result()
    log = Timeline(seen, ["convo_id"], CONVO_ORDER)
    log = _with_historical_run(log.columns(historical=F.col("seen").isNotNull()))
    hit = F.col("historical") & (F.col("run") >= LAB["run"])
    return log.columns(reason=F.when(hit, "autocorrelation_pattern")).result(*ID, "ts", "role", "run", "reason")


def _with_historical_run(log: Timeline) -> Timeline:
    """``run``: longest run of historical rows among this row and the nineteen before."""
    mark = F.when(F.col("historical"), "1").otherwise("0")
    log = log.columns(mark=mark).scan(tail={"marks": (F.col("mark"), LAB["hashes"] - 1)})
    line = F.concat(F.array_join("marks", ""), F.col("mark"))
    return log.columns(run=F.array_max(F.transform(F.split(line, "0"), lambda p: F.length(p))).cast("bigint"))


def context_preserve_ext(messages: DataFrame) -> DataFrame:
    """``preserved``: a media command, or a reply within 30 s of a user row."""
    log = Timeline(messages.select(*ID, "ts", "role", "content"), ["convo_id"], CONVO_ORDER).scan(prev={"user_ts": user_ts()})
    reply = F.coalesce(seconds_since("user_ts") < EXT["repeat_s"], F.lit(False))
    preserved = tx.is_musical_command(F.col("content"), "capture") | reply
    return log.columns(preserved=preserved).result(*ID, "ts", "role", "preserved")


def is_new_ext(messages: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows off the baseline while the user was active within two minutes."""
    rows = messages.select(*ID, "ts", "role", "content")
    log = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(prev={"user_ts": user_ts()})
    active = log.where(seconds_since("user_ts") < EXT["active_s"]).result()
    return baseline_exclude(active, baseline).select(*ID, "ts", "role")


def lab_signals(messages: DataFrame) -> DataFrame:
    """The four lab filters on all rows: reasons, sizes and context of each row.

    The lab keeps its memory whether or not a row is filtered, so nothing here depends on
    earlier decisions and one timeline per key serves all filters.
    """
    rows = messages.select(
        *ID, "ts", "role",
        tx.digest(F.col("content")).alias("digest"),
        tx.digest(tx.strip(F.col("content"))).alias("stripped"),
        F.length("content").alias("size"),
        tx.is_musical_command(F.col("content"), "lab").alias("musical"),
    )
    seen = Timeline(rows, ["convo_id", "digest"], CONVO_ORDER).scan(prev={"seen": F.col("ts")}).result()
    roles = Timeline(seen, ["convo_id", "role"], CONVO_ORDER)
    roles = roles.scan(lag={"nth_role": (F.col("ts"), LAB["velocity"] - 1)}).result()
    log = Timeline(roles, ["convo_id"], CONVO_ORDER).columns(historical=F.col("seen").isNotNull())
    entry = F.struct("ts", "role", "stripped")
    log = log.scan(prev={"user_ts": user_ts()}, tail={"recent": (entry, 10)}, lag={"nth": (F.col("ts"), LAB["velocity"])})
    log = trailing_count(_with_historical_run(log), "velocity_size", "ts", LAB["velocity_s"], ID)
    dump = (seconds_since("nth") < LAB["velocity_s"]) & (seconds_since("nth_role") < LAB["velocity_s"])
    idle = F.coalesce(seconds_since("user_ts") > LAB["active_s"], F.lit(True))
    old = (seconds_since("seen") > LAB["conversation_s"]) & idle
    echo = (F.col("role") == "assistant") & F.exists(
        "recent",
        lambda e: (e["role"] == "user") & (e["stripped"] == F.col("stripped")) & (seconds_since(e["ts"]) < 10),
    )
    pattern = F.col("historical") & (F.col("run") >= LAB["run"])
    reasons = F.array_compact(F.array(
        F.when(dump, "velocity_bulk_dump"),
        F.when(old, "temporal_historical"),
        F.when(echo, "user_input_echo"),
        F.when(pattern, "autocorrelation_pattern"),
    ))
    log = log.columns(reasons=reasons)
    preserved = _preserved_by(F.size("reasons") > 0)
    kept = [*ID, "ts", "role", "digest", "historical", "velocity_size", "reasons", "preserved_by", "musical", "size", "user_ts"]
    return log.columns(preserved_by=preserved).result(*kept)


def _preserved_by(flagged: Column) -> Column:
    since_user = seconds_since("user_ts")
    # A user repeat is never preserved: an unseen text has no earlier sight to be close to.
    ladder = (
        F.when(F.col("musical") & (since_user < LAB["musical_s"]), "musical_command")
        .when(
            (F.col("size") < 50) & (since_user < LAB["repeat_s"]) & (F.col("velocity_size") < 3), "conversational_echo"
        )
    )
    return F.when(flagged & ~F.col("historical"), ladder)


def context_preserve_lab(messages: DataFrame) -> DataFrame:
    """Why a flagged row would be preserved, for every row (null: it would not)."""
    signals = lab_signals(messages)
    return signals.withColumn("preserved_by", _preserved_by(F.lit(True))).select(*ID, "ts", "role", "preserved_by")


def signal_pipeline_lab(messages: DataFrame) -> DataFrame:
    """Decision of the lab pipeline per row, in the shape of ``metadata.signalProcessing``."""
    signals = lab_signals(messages)
    filtered = (F.size("reasons") > 0) & F.col("preserved_by").isNull()
    return signals.select(
        *ID, "ts", "role", filtered.alias("filtered"), F.col("reasons").alias("filtered_by"),
        "preserved_by", F.col("velocity_size").alias("velocity_buffer_size"), F.col("historical").alias("is_historical"),
    )


def signal_pipeline_genuine(messages: DataFrame, events: DataFrame) -> DataFrame:
    """The lab pipeline where rows of a genuine exchange bypass every filter.

    ``events`` are the rows of ``messages`` plus the send events, as for
    ``genuine_response_strict``.
    """
    genuine = genuine_response_strict(events).where(F.col("genuine")).select(*ID, "genuine")
    decided = signal_pipeline_lab(messages).join(genuine, ID, "left").fillna(False, ["genuine"])
    return decided.withColumns({
        "filtered": F.col("filtered") & ~F.col("genuine"),
        "filtered_by": F.when(F.col("genuine"), F.array().cast("array<string>")).otherwise(F.col("filtered_by")),
        "is_genuine_user_input": F.col("genuine") & (F.col("role") == "user"),
    }).withColumnRenamed("genuine", "is_genuine_response")


def model_pipeline(messages: DataFrame, baseline: DataFrame, pipeline: str) -> DataFrame:
    """Assistant rows that pass the filters of one model's pipeline.

    The adapters stop at the first filter that fails, so the windows of a stage run on the
    survivors of the stage before; user rows stay in as the clock of user activity.  Texts
    are reduced to digests and flags once; the stages work on that narrow table.
    """
    stages = {
        "sonnet-4": ["velocity", "temporal", "echo"],
        "opus-4.1": ["velocity", "temporal", "autocorr", "echo"],
        "generic": ["velocity", "echo"],
    }[pipeline]
    text = F.col("content")
    shown = messages.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.length(text) >= 3)))
    rows = echo_rows(shown, {
        "musical": tx.is_musical_command(text, "capture"), "sonnet": noise.sonnet_preserve(text),
    })
    known = baseline.select(tx.digest(text).alias("digest"), F.lit(True).alias("in_baseline")).distinct()
    rows = cut_lineage(rows.join(known, "digest", "left").fillna(False, ["in_baseline"]))
    clocked = Timeline(rows, ["convo_id"], CONVO_ORDER).scan(prev={"user_ts": user_ts()})
    clocked = clocked.columns(idle=seconds_since("user_ts")).result()
    users = clocked.where(F.col("role") == "user")
    alive = clocked.where(F.col("role") == "assistant")
    for stage in stages:
        if stage == "velocity":
            alive = velocity_ext(alive, EXT["velocity"], EXT["velocity_s"]).where(~F.col("bulk")).drop("bulk")
        elif stage == "temporal":
            alive = alive.where(F.col("idle").isNull() | (F.col("idle") <= EXT["active_s"]) | F.col("in_baseline"))
        elif stage == "autocorr":
            alive = with_pattern(alive).where(~F.col("pattern")).drop("pattern")
        else:
            echoes = leading_echo_ids(alive.unionByName(users)).withColumn("echo", F.lit(True))
            own = alive.join(echoes, ID, "left").fillna(False, ["echo"])
            alive = near_first_sight(own, EXT["repeat_s"]).where(F.col("passes")).result()
    new = ~F.col("in_baseline") & F.coalesce(F.col("idle") < EXT["active_s"], F.lit(False))
    preserved = F.col("musical") | F.coalesce(F.col("idle") < EXT["repeat_s"], F.lit(False))
    accept = {
        "sonnet-4": preserved | F.col("sonnet") | new,
        "opus-4.1": preserved | new,
        "generic": new,
    }[pipeline]
    return alive.where(accept).select(*ID, "ts", "role", F.lit(pipeline).alias("pipeline"))


def filter_stats(decisions: DataFrame) -> DataFrame:
    """Counters of a lab pipeline run: per filter, preserved, clean and verbose rows."""
    def by(reason: str) -> Column:
        return F.count_if(F.array_contains("filtered_by", reason))

    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        by("velocity_bulk_dump").alias("by_velocity"),
        by("temporal_historical").alias("by_temporal"),
        by("user_input_echo").alias("by_echo"),
        by("autocorrelation_pattern").alias("by_autocorrelation"),
        F.count_if(F.col("preserved_by").isNotNull()).alias("preserved"),
        F.count_if(~F.col("filtered")).alias("clean"),
        F.count_if(F.col("filtered")).alias("verbose_only"),
    )


def history_ttl(messages: DataFrame, hours: float = 24) -> DataFrame:
    """Whether each row's text is still remembered: first sights expire after ``hours``.

    A text seen again after its entry expired counts as a first sight once more, so the
    entries follow the keep-if-quiet rule with the lifetime as window.
    """
    from turnsift.plans.greedy import keep_if_quiet

    fresh = keep_if_quiet(narrow(messages), ["convo_id", "digest"], "ts", ["seq"], F.lit(hours * 3600))
    return fresh.select(*ID, "ts", "role", F.col("kept").alias("first_occurrence"))
