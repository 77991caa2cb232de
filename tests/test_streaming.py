import pytest
from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators import dedup, replay
from turnsift.sources import sinks
from turnsift.streaming import jobs, state

ROWS = [(t, "user" if i % 3 else "assistant", f"text {i % 4}") for i, t in enumerate([0, 1, 3, 4, 6, 7, 9, 13, 14, 15, 18, 22, 23, 30, 31, 33])]


def write(df, folder):
    """One more input file; every call is a later arrival."""
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_quiet_dedup_over_batches_equals_table(spark, log, mode, tmp_path):
    rows = log(ROWS).withColumn("digest", tx.digest(F.col("content"))).drop("urls", "historical", "t")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for lo, hi in ((0, 5), (5, 6), (6, 16)):
        # A new run continues from the checkpoint of the last one.
        write(rows.where(F.col("seq").between(lo, hi - 1)), source)
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        window = F.when(F.col("role") == "assistant", 2).otherwise(5)
        jobs.QuietDedup(out, ["platform", "role", "digest"], window, 5).start(stream).awaitTermination()
    got = {r.seq: r.kept for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {r.seq: r.kept for r in dedup.dedup_window_role(rows).collect()}


def test_replay_stream_equals_batch_after_restart(spark, log, mode, tmp_path):
    rows = log(ROWS).drop("historical", "t")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for lo, hi in ((0, 6), (6, 16)):
        write(rows.where(F.col("seq").between(lo, hi - 1)), source)
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        jobs.ReplayLog(out).start(stream).awaitTermination()
    got = replay.apply_removals(spark.read.parquet(f"{out}/data").drop("epoch"))
    want = replay.replay_dedup(rows)
    assert {r.seq: r.action for r in got.collect()} == {r.seq: r.action for r in want.collect()}


def test_late_rows_and_rows_from_the_future(spark, log, tmp_path):
    rows = log([(0, "user", "a"), (2, "user", "a"), (4_000_000_000, "user", "z"), (9, "user", "a"), (3, "user", "a"), (11, "user", "a")])
    rows = rows.withColumn("digest", tx.digest(F.col("content"))).drop("urls", "historical", "t")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in ([0, 1, 2], [3, 4], [5]):
        write(rows.where(F.col("seq").isin(part)), source)
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        jobs.QuietDedup(out, ["platform", "role", "digest"], F.lit(5), 5, delay=5).start(stream).awaitTermination()
    # The row from the year 2150 moves the watermark to the time of processing at most, which is past all others.
    got = {r.seq: r.kept for r in spark.read.parquet(f"{out}/data").collect()}
    late = {r.seq for r in spark.read.parquet(f"{out}/late").collect()}
    assert got == {0: True, 1: False, 2: True} and late == {3, 4, 5}


def test_overlapping_batches_within_the_delay(spark, log, tmp_path):
    rows = log([(0, "user", "a"), (10, "user", "a"), (7, "user", "a"), (4, "user", "a"), (16, "user", "a"), (2, "user", "a")])
    rows = rows.withColumn("digest", tx.digest(F.col("content"))).drop("urls", "historical", "t")
    source, out = tmp_path / "in", str(tmp_path / "out")
    for part in ([0, 1], [2, 3], [4, 5]):
        write(rows.where(F.col("seq").isin(part)), source)
        stream = spark.readStream.schema(rows.schema).parquet(str(source))
        jobs.QuietDedup(out, ["platform", "role", "digest"], F.lit(5), 5, delay=7).start(stream).awaitTermination()
    # The row of second 2 comes when the watermark is at 3; that of second 7 stands behind 0 with 5 s of silence.
    assert {r.seq: r.kept for r in spark.read.parquet(f"{out}/data").collect()} == {0: True, 1: True, 2: True, 3: False, 4: True}
    assert {r.seq for r in spark.read.parquet(f"{out}/late").collect()} == {5}
    assert len(list((tmp_path / "out" / "state").iterdir())) == 2


@pytest.fixture
def keyed_state(spark):
    """State of few partitions in the store that keyed state needs."""
    before = {k: spark.conf.get(k) for k in (state.PROVIDER, "spark.sql.shuffle.partitions")}
    state.use_keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def arrivals(spark, rows, source, parts):
    """A stream per part, each continuing from the checkpoint of the one before."""
    for part in parts:
        write(rows.where(F.col("seq").isin(part)), source)
        yield spark.readStream.schema(rows.schema).parquet(str(source))


def run(rows, out):
    jobs.start_files(rows, out).awaitTermination()


def end(rows):
    """A last row that lets the watermark pass all others."""
    return rows.limit(1).select(*[F.lit("end").alias(c) if c == "convo_id" else F.timestamp_seconds(F.lit(1_900_000_000)).alias(c) if c == "ts" else F.lit(999).cast("long").alias(c) if c == "seq" else c for c in rows.columns])


def test_entries_expire_exactly(spark, keyed_state, log, tmp_path):
    """Sights at 0, 30 and 31 s with a life of 30 s, out of order, over restarts; a row behind the watermark is dropped."""
    rows = log([(0, "user", "a"), (31, "user", "a"), (30, "user", "a"), (40, "user", "b"), (61, "user", "a"), (100, "user", "z"), (3, "user", "a"), (62, "user", "a")])
    rows = rows.withColumn("digest", tx.digest(F.col("content"))).select("convo_id", "seq", "ts", "digest")
    rows = rows.unionByName(end(rows))
    source, out = tmp_path / "in", str(tmp_path / "out")
    # The watermark stands 10 s behind the newest row of the batches before.
    for stream in arrivals(spark, rows, source, ([0, 1], [2, 3], [4, 5], [6, 7], [999])):
        run(state.remembered_stream(stream, ["convo_id", "digest"], 30, "40 seconds"), out)
    got = {r.seq: r.fresh for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {0: True, 2: False, 1: True, 3: True, 4: False, 7: True, 5: True}


def test_keyed_states_equal_the_table_jobs(spark, keyed_state, log, tmp_path):
    rows = log(ROWS).drop("historical", "t")
    rows = rows.unionByName(end(rows))
    parts = ([1, 0, 4], [2, 3, 5, 6, 7], list(range(8, 16)), [999])
    out = str(tmp_path / "out")
    for stream in arrivals(spark, rows, tmp_path / "in", parts):
        run(state.replay_stream(stream, "30 seconds"), out)
    got = replay.apply_removals(spark.read.parquet(f"{out}/data"))
    want = replay.replay_dedup(rows.where("seq < 999"))
    assert {r.seq: r.action for r in got.collect()} == {r.seq: r.action for r in want.collect()}
    firsts = str(tmp_path / "first")
    keyed = rows.withColumn("digest", tx.digest(F.col("content"))).select("convo_id", "seq", "ts", "digest")
    for stream in arrivals(spark, keyed, tmp_path / "keyed", parts):
        run(state.first_seen_stream(stream, ["convo_id", "digest"], 86_400, "30 seconds"), firsts)
    assert {r.seq for r in spark.read.parquet(f"{firsts}/data").collect()} == {r[1] for r in keyed.where("seq < 999").groupBy("digest").agg(F.min("seq")).collect()}


def test_exchanges_in_state(spark, keyed_state, log, tmp_path):
    events = [(0, "send", "q"), (0.2, "user", "q"), (2, "assistant", "r"), (3, "assistant", "s"), (40, "send", "q2"), (41, "user", "q2"), (60, "assistant", "late"), (61, "send", "x"), (61.5, "send", "y"), (62, "user", "x"), (63, "assistant", "z")]
    rows = log(events).select("convo_id", "seq", "ts", F.col("role").alias("event"), "content", F.lit(None).cast("timestamp").alias("marked_ts"))
    want = {r.seq: r.genuine for r in dedup.genuine_response_strict(rows).collect()}
    rows = rows.unionByName(end(rows))
    out = str(tmp_path / "out")
    for stream in arrivals(spark, rows, tmp_path / "in", ([0, 2], [1, 3, 4], [6, 5], [7, 8, 9, 10], [999])):
        run(state.exchange_stream(stream, "30 seconds"), out)
    assert {r.seq: r.genuine for r in spark.read.parquet(f"{out}/data").collect()} == want
    assert True in want.values() and False in want.values()


def test_retention_of_a_stream(spark, log, tmp_path):
    rows = log([(i * 7 % 20, "user", str(i), {"platform": "claude" if i % 3 else "chatgpt"}) for i in range(20)]).select("convo_id", "seq", "ts", "platform")
    newest = [F.desc("ts"), F.desc("seq")]
    job = jobs.Retention(str(tmp_path / "out"), ["platform"], newest, {"claude": 4, "chatgpt": 2})
    for stream in arrivals(spark, rows, tmp_path / "in", (list(range(0, 9)), [9], list(range(10, 20)))):
        job.start(stream).awaitTermination()
    want = sinks.rolling_retention(rows, ["platform"], newest, {"claude": 4, "chatgpt": 2})
    kept = sorted((r.platform, r.age_rank, r.seq) for r in want.collect())
    assert sorted((r.platform, r.age_rank, r.seq) for r in job.current(spark).collect()) == kept
    # The last batch once more, as after a failure.
    job(rows.where("seq >= 10"), 2)
    assert sorted((r.platform, r.age_rank, r.seq) for r in job.current(spark).collect()) == kept
    assert len(list((tmp_path / "out" / "state").iterdir())) == 2
