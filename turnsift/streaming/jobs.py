"""Structured Streaming forms of the log jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnsift.operators.dedup import ID
from turnsift.operators.noise import classify_noise
from turnsift.operators.replay import FIELDS, prepare, replay_step
from turnsift.plans.greedy import keep_if_quiet
from turnsift.plans.relay import STATE, relay
from turnsift.session import cut_lineage
from turnsift.sources.sinks import rolling_retention


def start_files(rows: DataFrame, folder: str, partition_by: list[str] | None = None, continuous: str | None = None) -> StreamingQuery:
    """Append ``rows`` to parquet files in ``folder``, exactly once.

    Runs through the available input and stops, or keeps polling with ``continuous``
    (a processing-time interval).
    """
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", f"{folder}/_checkpoint").option("path", f"{folder}/data")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**({"processingTime": continuous} if continuous else {"availableNow": True})).start()


def fan_out_stream(messages: DataFrame) -> DataFrame:
    """Messages with the log they belong to; written partitioned by ``action`` it is both logs."""
    ruled = classify_noise(messages)
    return ruled.withColumn("action", F.when(F.col("noise"), "verbose_only").otherwise("keep"))


def debounce_stream(updates: DataFrame, key: list[str], quiet: str, delay: str) -> DataFrame:
    """Last text of each burst of updates, emitted once the key was quiet and the watermark passed."""
    place = F.struct("ts", "seq")
    session = F.session_window("ts", quiet)
    bursts = updates.withWatermark("ts", delay).groupBy(*key, session)
    return bursts.agg(
        F.max_by("content", place).alias("content"), F.count(F.lit(1)).alias("updates")
    ).select(*key, "content", "updates", F.col("session_window.end").alias("emit_ts"))


def velocity_stream(messages: DataFrame, threshold: int, delay: str, session: str = "convo_id") -> DataFrame:
    """One-second windows, sliding by 200 ms, with more rows of a session than the threshold."""
    window = F.window("ts", "1 second", "200 milliseconds")
    counts = messages.withWatermark("ts", delay).groupBy(session, window).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > threshold).select(session, F.col("window.start").alias("start"), "rows")


class BatchJob:
    """A job per micro-batch whose memory is a table, as a ``foreachBatch`` function.

    Every batch is decided with the same blocked job as a table, so a hot key is split here
    as well.  The memory a batch leaves is written under its number and read by the next
    one: a batch that runs again reads the same memory and overwrites its own output.  Memories
    that no batch can need again are removed.

    Batches may overlap by ``delay`` seconds of event time.  The watermark is the newest time seen, or the
    time of processing if that is earlier, less the delay: a row dated into the future cannot move it ahead.
    Rows older than the watermark that a batch finds are not decided; they go to the folder ``late``, unless the
    job ``admits_late`` rows because their order does not matter to it.
    """

    admits_late = False

    def __init__(self, folder: str, delay: float):
        self.folder, self.delay = folder, int(delay * 1_000_000)

    def memory(self, spark: SparkSession, epoch: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.folder}/state/epoch={epoch}") if epoch >= 0 else None

    def write(self, name: str, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def remove(self, spark: SparkSession, name: str, epoch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/epoch={epoch}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def watermark(self, spark: SparkSession, epoch: int) -> int | None:
        """Microseconds, as a batch left it; null as long as no row was seen."""
        return spark.read.parquet(f"{self.folder}/watermark/epoch={epoch}").first()[0] if epoch >= 0 else None

    def decide(self, batch: DataFrame, before: DataFrame | None, epoch: int) -> None:
        raise NotImplementedError

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch)
        mark, at = self.watermark(spark, epoch - 1), F.unix_micros("ts")
        if mark is not None and not self.admits_late:
            self.write("late", rows.where(at < mark), epoch)
            rows = rows.where(at >= mark)
        newest = F.least(F.max(at), F.unix_micros(F.current_timestamp())) - self.delay
        self.write("watermark", rows.agg(F.greatest(newest, F.lit(mark).cast("bigint")).alias("at")), epoch)
        self.decide(rows, self.memory(spark, epoch - 1), epoch)
        for name in ("state", "watermark"):
            self.remove(spark, name, epoch - 2)

    def recent(self, spark: SparkSession, epoch: int, ts: str, seconds: float) -> Column:
        """Rows that a row not yet late can still look back to."""
        mark = self.watermark(spark, epoch)
        return F.lit(True) if mark is None else F.unix_micros(ts) >= mark - int(seconds * 1_000_000)

    def start(self, stream: DataFrame) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/_checkpoint")
        return writer.trigger(availableNow=True).start()


class QuietDedup(BatchJob):
    """Keep-if-quiet over micro-batches.

    The memory is the kept rows that a later row may look back to, ``longest`` seconds at most; they are put in
    front of the next batch as forced rows.
    """

    def __init__(self, folder: str, keys: list[str], window: Column, longest: float, delay: float = 3600):
        super().__init__(folder, delay)
        self.keys, self.window, self.longest = keys, window, longest

    def decide(self, batch: DataFrame, before: DataFrame | None, epoch: int) -> None:
        columns = [*dict.fromkeys([*ID, "ts", *self.keys])]
        rows = batch.select(*columns).withColumn("carried", F.lit(False))
        if before is not None:
            rows = rows.unionByName(before.select(*columns).withColumn("carried", F.lit(True)))
        decided = keep_if_quiet(rows, self.keys, "ts", ID, self.window, forced=F.col("carried"))
        decided = cut_lineage(decided)
        self.write("data", decided.where(~F.col("carried")).drop("carried"), epoch)
        recent = self.recent(batch.sparkSession, epoch, "ts", self.longest)
        self.write("state", decided.where(F.col("kept") & recent).select(*columns), epoch)


class ReplayLog(BatchJob):
    """Strict replay decisions over micro-batches.

    The memory is the ring of clean rows of every conversation.  A conversation is forgotten once its last row is
    ``idle_seconds`` older than the watermark; batches must not overlap inside a conversation.
    """

    def __init__(self, folder: str, idle_seconds: float = 86_400, delay: float = 3600):
        super().__init__(folder, delay)
        self.idle = idle_seconds

    def decide(self, batch: DataFrame, before: DataFrame | None, epoch: int) -> None:
        rows = prepare(batch)
        decided = relay(rows, ["convo_id"], ["ts", "seq"], replay_step, FIELDS, initial=before, keep_state=True)
        decided = cut_lineage(decided.select(*ID, "ts", *FIELDS, STATE))
        self.write("data", decided.drop(STATE), epoch)
        last = decided.where(F.col(STATE).isNotNull()).groupBy("convo_id").agg(
            F.max_by(STATE, F.struct("ts", "seq")).alias(STATE), F.max("ts").alias("last_ts")
        )
        if before is not None:
            last = last.unionByName(before.join(last.select("convo_id"), "convo_id", "left_anti"))
        self.write("state", last.where(self.recent(batch.sparkSession, epoch, "last_ts", self.idle)), epoch)


class Retention(BatchJob):
    """The newest rows of each sink, kept up with every micro-batch.

    The memory is what is kept.  A batch is cut to its own newest rows first and merged with the memory, so the work follows the batch.
    What is kept after a batch is written as a table of its own and becomes current as a whole when it is complete; a batch that
    runs again merges with the memory before it and gives the same table.
    """

    admits_late = True

    def __init__(self, folder: str, sink: list[str], newest: list[Column], limits: dict[str, int] | int):
        super().__init__(folder, 0)
        self.sink, self.newest, self.limits = sink, newest, limits

    def decide(self, batch: DataFrame, before: DataFrame | None, epoch: int) -> None:
        rows = rolling_retention(batch, self.sink, self.newest, self.limits).drop("age_rank")
        if before is not None:
            rows = rolling_retention(rows.unionByName(before), self.sink, self.newest, self.limits).drop("age_rank")
        self.write("state", rows, epoch)

    def current(self, spark: SparkSession) -> DataFrame:
        """What is kept now, with ``age_rank``."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(
            spark._jvm.org.apache.hadoop.fs.Path(path, "epoch=*/_SUCCESS")
        )
        epochs = [int(str(f.getPath().getParent().getName()).removeprefix("epoch=")) for f in found]
        rows = self.memory(spark, max(epochs))
        return rolling_retention(rows, self.sink, self.newest, self.limits)


class GrowthMonitor(BatchJob):
    """Rows per platform after every micro-batch that brought some: ``platform, before, entries``."""

    admits_late = True

    def __init__(self, folder: str):
        super().__init__(folder, 0)

    def decide(self, batch: DataFrame, before: DataFrame | None, epoch: int) -> None:
        added = batch.select("platform", F.lit(0).cast("bigint").alias("before"), F.lit(1).cast("bigint").alias("added"))
        if before is not None:
            added = added.unionByName(before.select("platform", F.col("entries").alias("before"), F.lit(0).cast("bigint").alias("added")))
        sums = added.groupBy("platform").agg(F.sum("before").alias("before"), F.sum("added").alias("added"))
        sums = cut_lineage(sums.select("platform", "before", (F.col("before") + F.col("added")).alias("entries")))
        self.write("data", sums.where("entries > before"), epoch)
        self.write("state", sums.select("platform", "entries"), epoch)
