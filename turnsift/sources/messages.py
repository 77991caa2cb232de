"""Reading message logs: stored lines, posted documents, query strings, tables, test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift import schemas
from turnsift.functions import text as tx


def read_message_log(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON log lines; blank lines are skipped by the reader."""
    return upgrade_v1(spark.read.schema(schemas.STORED_MESSAGE).json(path))


def tail_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log lines as they arrive in a folder."""
    lines = spark.readStream.schema(schemas.STORED_MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
    return upgrade_v1(lines.json(path))


def parse_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Each line as ``doc`` with ``_corrupt_record`` set when it is no valid document."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.withColumn("doc", F.from_json(line, f"{schema}, _corrupt_record string", options))


def tolerant_split(lines: DataFrame, line: str = "value", schema: str = schemas.STORED_MESSAGE):
    """(good, quarantine): parsed lines and the malformed rest; blank lines vanish."""
    parsed = parse_lines(lines.where(~F.col(line).rlike(f"^{tx.SPACE}*\\z")), line, schema)
    bad = F.col("doc._corrupt_record").isNotNull() | F.col("doc").isNull()
    good = parsed.where(~bad).withColumn("doc", F.col("doc").dropFields("_corrupt_record"))
    return good, parsed.where(bad).drop("doc")


def read_quarantined(spark: SparkSession, path: str, schema: str = schemas.STORED_MESSAGE):
    """(good, quarantine) of the text files under ``path``, read by one scan.

    Both carry where a line stands: ``file`` and ``block``, the byte at which the part of the file begins that the line was read with.
    The quarantine has the ``line`` itself and ``reason``: ``not a document``, or ``wrong type`` for a document that the schema cannot hold.
    Blank lines vanish; a line of any length is one row.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    good, bad = tolerant_split(lines, "value", schema)
    kept = [c for c in good.columns if c not in ("value", "doc")]
    # Only a document gives a map of its fields.
    document = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    reason = F.when(document.isNull() | ~F.ltrim("value").startswith("{"), "not a document").otherwise("wrong type")
    return good.select(*kept, "doc.*"), bad.select("file", "block", F.col("value").alias("line"), reason.alias("reason"))


def ingest_post(posts: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Stored form of posted messages: defaults for missing fields, ``text`` becomes ``content``."""
    arrival = F.current_timestamp() if arrival is None else arrival
    return posts.withColumns({
        "arrival_ts": arrival,
        "platform": F.coalesce("platform", F.lit("unknown")),
        "role": F.coalesce("role", F.lit("assistant")),
        "content": F.coalesce("text", F.lit("")),
        "urls": F.coalesce("urls", F.array().cast("array<string>")),
    }).drop("text")


def ingest_query_string(requests: DataFrame, url: str = "url") -> DataFrame:
    """Messages sent as the query of an address; empty texts are skipped, nothing is filtered."""

    def param(name: str, default: str) -> Column:
        raw = F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(name))
        return F.coalesce(F.try_url_decode(raw), F.lit(default))

    return requests.withColumns({
        "platform": param("platform", "claude"),
        "role": param("role", "user"),
        "content": param("text", ""),
        "method": param("method", "get_bypass"),
        "client_time": param("timestamp", ""),
    }).where(F.col("content") != "")


def upgrade_v1(rows: DataFrame) -> DataFrame:
    """Rows without platform or urls read as current ones."""
    return rows.withColumns({
        "platform": F.coalesce("platform", F.lit("unknown")),
        "role": F.coalesce("role", F.lit("assistant")),
        "content": F.coalesce("content", F.lit("")),
        "urls": F.coalesce("urls", F.array().cast("array<string>")),
    })


def messages_from_conversations(conversations: DataFrame) -> DataFrame:
    """A (conv_id, turn, role, text) table as messages, twenty seconds per turn."""
    millis = F.lit(1704067200000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 20_000
    rows = conversations.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("convo_id"),
        F.col("turn").alias("seq"),
        F.timestamp_millis(millis).alias("ts"),
        F.when(F.col("conv_id") % 2 == 1, "claude").otherwise("chatgpt").alias("platform"),
        "role",
        F.col("text").alias("content"),
    )
    return rows.withColumns({
        "msg_id": tx.message_id(F.col("platform"), F.col("role"), F.col("ts")),
        "urls": tx.text_urls(F.col("content")),
    })


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TEST_REPORT).option("multiLine", True).json(path)


def report_messages(reports: DataFrame) -> DataFrame:
    """The embedded log lines of test reports, one message per row, tagged with their log."""

    def tagged(log: str) -> Column:
        return F.transform(F.col(f"logs.{log}"), lambda line: F.struct(F.lit(log).alias("log"), line.alias("line")))

    logs = [tagged(log) for log in ("chat", "verbose", "recent")]
    kept = [c for c in reports.columns if c != "logs"]
    rows = reports.select(*kept, F.explode(F.concat(*logs)).alias("entry"))
    parsed = rows.withColumn("doc", F.from_json("entry.line", schemas.STORED_MESSAGE))
    return parsed.select(*kept, F.col("entry.log").alias("log"), "doc.ts", "doc.platform", "doc.role", "doc.content")
