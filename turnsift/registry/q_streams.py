"""Streaming jobs, run through the available input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators import replay as rp
from turnsift.registry import query
from turnsift.registry.base import LOG, message_log, turn
from turnsift.registry.q_dedup import _BURSTS, REPLAY, STRICT, exchange_events, greedy_sql
from turnsift.registry.q_noise import NOISE
from turnsift.registry.q_sources import ts_ms
from turnsift.session import cut_lineage, fresh_folder
from turnsift.sources import messages as ms
from turnsift.sources import sinks
from turnsift.streaming import jobs, state

ROW = ["convo_id", "seq"]


def log_stream(spark, sf_dir, closing=False):
    """The message log as a stream of files that arrive in event order, as three micro-batches.

    A third of the log's time is written in as many files as the log has, so a batch is as wide as the log.  ``closing`` adds a
    last row a day later, which lets the watermark pass everything before it.
    """
    folder = fresh_folder(spark, "arriving")
    log = cut_lineage(message_log(spark, sf_dir))
    files = max(1, len(log.inputFiles()))
    at = F.unix_millis("ts")
    low, high = log.agg(F.min(at), F.max(at)).first()
    third = F.expr(f"least(2, (unix_millis(ts) - {low or 0}) * 3 div {max(1, (high or 0) - (low or 0))})")
    for number in range(3):
        log.where(third == number).repartition(files).write.mode("append").parquet(folder)
    if closing:
        end = log.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).withColumn("convo_id", F.lit("end of input"))
        end.select(*[F.col(c) if c in end.columns else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns]).write.mode("append").parquet(folder)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(folder)


def keyed(spark, rows, name):
    """A stream with keyed state, run through its input; the closing row itself is left out."""
    before = spark.conf.get(state.PROVIDER)
    state.use_keyed_state(spark)
    try:
        return finish(spark, rows, name)
    finally:
        spark.conf.set(state.PROVIDER, before)


def finish(spark, rows, name, partition_by=None):
    folder = fresh_folder(spark, name)
    jobs.start_files(rows, folder, partition_by).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/data")


@query("tail_log_stream", f"{LOG} SELECT ms AS ts_ms, platform, role, content FROM log")
def tail_log_stream(spark, sf_dir):
    folder = fresh_folder(spark, "lines")
    message_log(spark, sf_dir).select("ts", "platform", "role", "content", "urls").write.json(folder)
    rows = ms.tail_log_stream(spark, folder).select("ts", "platform", "role", "content")
    return finish(spark, rows, "tail").select(ts_ms(), "platform", "role", "content")


@query("fan_out_stream", f"{LOG}, {NOISE} SELECT convo_id, seq, CASE WHEN noise THEN 'verbose_only' ELSE 'keep' END AS action FROM noise")
def fan_out_stream(spark, sf_dir):
    rows = jobs.fan_out_stream(log_stream(spark, sf_dir))
    return finish(spark, rows, "logs", ["action"]).select(*ROW, "action")


@query(
    "debounce_stream",
    f"{LOG}, {_BURSTS} SELECT convo_id, turn_no, role, content, emit_ms, updates FROM bursts",
)
def debounce_stream(spark, sf_dir):
    updates = log_stream(spark, sf_dir, closing=True).withColumn("turn_no", turn())
    rows = jobs.debounce_stream(updates, ["convo_id", "turn_no", "role"], "1 second", "2 seconds")
    out = finish(spark, rows, "debounced")
    return out.select("convo_id", "turn_no", "role", "content", F.unix_millis("emit_ts").alias("emit_ms"), "updates")


@query(
    "quiet_dedup_stream",
    f"{LOG}, " + greedy_sql("log", "(platform, role, content)", "(CASE WHEN r.role = 'assistant' THEN 2000 ELSE 5000 END)")
    + " SELECT convo_id, seq, kept FROM greedy",
)
def quiet_dedup_stream(spark, sf_dir):
    stream = log_stream(spark, sf_dir).withColumn("digest", tx.digest(F.col("content")))
    window = F.when(F.col("role") == "assistant", 2).otherwise(5)
    job = jobs.QuietDedup(fresh_folder(spark, "quiet"), ["platform", "role", "digest"], window, 5)
    job.start(stream).awaitTermination()
    return spark.read.parquet(f"{job.folder}/data").select(*ROW, "kept")


@query("first_seen_stream", f"{LOG} SELECT DISTINCT convo_id, role, content FROM log")
def first_seen_stream(spark, sf_dir):
    """No conversation of the log lasts a day, so a first sight is remembered to its end."""
    messages = log_stream(spark, sf_dir, closing=True).select(*ROW, "ts", "role", "content", tx.digest(F.col("content")).alias("digest"))
    rows = state.first_seen_stream(messages, ["convo_id", "role", "digest"], 86_400, "2 seconds")
    return keyed(spark, rows, "first").select("convo_id", "role", "content")


@query(
    "history_ttl_stream",
    f"{LOG}, " + greedy_sql("log", "(convo_id, content)", "30000") + " SELECT convo_id, seq, kept AS first_occurrence FROM greedy",
)
def history_ttl_stream(spark, sf_dir):
    """Entries expire exactly thirty seconds after they were made, in the state of a conversation's text."""
    messages = log_stream(spark, sf_dir, closing=True).select(*ROW, "ts", tx.digest(F.col("content")).alias("digest"))
    rows = state.remembered_stream(messages, ["convo_id", "digest"], 30, "2 seconds")
    return keyed(spark, rows, "remembered").select(*ROW, F.col("fresh").alias("first_occurrence"))


@query("exchange_stream", f"{LOG}, {STRICT} SELECT * FROM strict")
def exchange_stream(spark, sf_dir):
    """The send / reply state machine of ``genuine_response_strict`` on arriving events."""
    events = exchange_events(spark, sf_dir, log_stream(spark, sf_dir, closing=True))
    rows = state.exchange_stream(events, "2 seconds")
    return keyed(spark, rows, "exchanges").select(*ROW, "event", "genuine")


@query("replay_state_stream", f"{LOG}, {REPLAY} SELECT * FROM replayed")
def replay_state_stream(spark, sf_dir):
    """Strict replay with the ring of a conversation in its state, instead of a table per micro-batch."""
    rows = state.replay_stream(log_stream(spark, sf_dir, closing=True), "2 seconds")
    return rp.apply_removals(keyed(spark, rows, "replayed")).select(*ROW, "action", F.array_join("reasons", ",").alias("reasons"))


@query(
    "velocity_stream",
    f"{LOG}, slots AS (SELECT convo_id, (ms // 200) * 200 - 200 * s.i AS start_ms, ms FROM log, range(5) s(i)) "
    "SELECT convo_id, start_ms, count(*) AS rows FROM slots GROUP BY 1, 2 HAVING count(*) > 5",
)
def velocity_stream(spark, sf_dir):
    rows = jobs.velocity_stream(log_stream(spark, sf_dir, closing=True).select(*ROW, "ts"), 5, "2 seconds")
    return finish(spark, rows, "velocity").select("convo_id", F.unix_millis("start").alias("start_ms"), "rows")


@query("replay_stream", f"{LOG}, {REPLAY} SELECT * FROM replayed")
def replay_stream(spark, sf_dir):
    job = jobs.ReplayLog(fresh_folder(spark, "replay"))
    job.start(log_stream(spark, sf_dir)).awaitTermination()
    decided = spark.read.parquet(f"{job.folder}/data").drop("epoch")
    return rp.apply_removals(decided).select(*ROW, "action", F.array_join("reasons", ",").alias("reasons"))


@query(
    "growth_stream",
    f"{LOG} SELECT platform, count(*) AS added, count(*) AS entries, 3::BIGINT AS changes FROM log GROUP BY 1",
)
def growth_stream(spark, sf_dir):
    """The count after each of three micro-batches; what they add must give the last count."""
    job = jobs.GrowthMonitor(fresh_folder(spark, "growth"))
    job.start(log_stream(spark, sf_dir)).awaitTermination()
    return spark.read.parquet(f"{job.folder}/data").groupBy("platform").agg(
        F.sum(F.col("entries") - F.col("before")).alias("added"), F.max("entries").alias("entries"),
        F.count(F.lit(1)).alias("changes"),
    )


@query(
    "retention_stream",
    f"{LOG}, sinks AS (SELECT * FROM (VALUES ('clean', 100), ('recent', 2)) s(sink, n)), ranked AS (SELECT sink, n, "
    "platform, convo_id, seq, row_number() OVER (PARTITION BY sink, platform ORDER BY ms DESC, convo_id DESC, seq DESC) "
    "AS age_rank FROM log, sinks) SELECT sink, platform, convo_id, seq, age_rank FROM ranked WHERE age_rank <= n",
)
def retention_stream(spark, sf_dir):
    """The newest rows of each sink after three micro-batches."""
    sink = F.explode(F.array(F.lit("clean"), F.lit("recent"))).alias("sink")
    rows = log_stream(spark, sf_dir).select(*ROW, "ts", "platform", sink)
    newest = [F.desc("ts"), F.desc("convo_id"), F.desc("seq")]
    job = jobs.Retention(fresh_folder(spark, "retention"), ["sink", "platform"], newest, {n: sinks.RETENTION[n] for n in ("clean", "recent")})
    job.start(rows).awaitTermination()
    return job.current(spark).select("sink", "platform", *ROW, F.col("age_rank").cast("bigint").alias("age_rank"))
