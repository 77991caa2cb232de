"""Sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from turnsift.operators import noise as noise_ops
from turnsift.registry import query
from turnsift.registry.base import LOG, conv_number, kind, message_log, read, sql_norm, sql_strip
from turnsift.registry.q_noise import DIAGNOSTIC, NOISE
from turnsift.session import fresh_folder, spread
from turnsift.sources import documents as dc
from turnsift.sources import events as ev
from turnsift.sources import messages as ms
from turnsift.sources import pages as pg
from turnsift.sources import sinks

def ts_ms():
    return F.unix_millis("ts").alias("ts_ms")


@query("read_message_log", f"{LOG} SELECT ms AS ts_ms, platform, role, content, len(urls)::BIGINT AS n_urls FROM log")
def read_message_log(spark, sf_dir):
    folder = fresh_folder(spark, "log")
    message_log(spark, sf_dir).select("ts", "platform", "role", "content", "urls").write.json(folder)
    rows = ms.read_message_log(spark, folder)
    return rows.select(ts_ms(), "platform", "role", "content", F.size("urls").cast("bigint").alias("n_urls"))


def _lines(spark, sf_dir):
    """Log lines as text: every fifth is cut off, every seventh of the rest blank."""
    log = message_log(spark, sf_dir)
    line = F.to_json(F.struct("ts", "platform", "role", "content", "urls"))
    broken = F.col("seq") % 5 == 0
    blank = F.col("seq") % 7 == 0
    text = F.when(broken, F.left(line, F.length(line) - 2)).when(blank, "  ").otherwise(line)
    return log.select("convo_id", "seq", text.alias("value"))


@query(
    "read_message_log_tolerant",
    f"{LOG} SELECT convo_id, seq, seq % 5 <> 0 AS good, CASE WHEN seq % 5 <> 0 THEN content END AS content "
    "FROM log WHERE seq % 5 = 0 OR seq % 7 <> 0",
)
def read_message_log_tolerant(spark, sf_dir):
    good, bad = ms.tolerant_split(_lines(spark, sf_dir))
    rows = good.select("convo_id", "seq", F.lit(True).alias("good"), F.col("doc.content").alias("content"))
    return rows.unionByName(
        bad.select("convo_id", "seq", F.lit(False).alias("good"), F.lit(None).cast("string").alias("content"))
    )


@query(
    "read_quarantined",
    f"{LOG} SELECT 'log-' || (conv_id % 3) AS file, convo_id, seq, CASE WHEN seq % 5 <> 0 THEN 'good' WHEN seq % 2 = 0 THEN 'not a document' "
    "ELSE 'wrong type' END AS found FROM log",
)
def read_quarantined(spark, sf_dir):
    """Log files with cut lines and lines with a text for a number, and which file each bad line came from."""
    name, of = F.concat(F.lit("log-"), (conv_number() % 3).cast("string")), F.concat_ws("/", "convo_id", "seq")
    whole = F.to_json(F.struct("ts", F.lit("claude").alias("platform"), "role", of.alias("content")))
    wrong = F.concat(F.lit('{"ts": "2024-01-01T00:00:00", "metadata": 5, "content": "'), of, F.lit('"}'))
    cut = F.concat(F.lit('{"content": "'), of)
    line = F.when(F.col("seq") % 5 != 0, whole).when(F.col("seq") % 2 == 0, cut).otherwise(wrong)
    folder = fresh_folder(spark, "lines")
    message_log(spark, sf_dir).select(name.alias("file"), line.alias("value")).write.partitionBy("file").text(folder)
    good, bad = ms.read_quarantined(spark, f"{folder}/file=*")
    rows = good.select("file", F.col("content").alias("of"), F.lit("good").alias("found"))
    rows = rows.unionByName(bad.select("file", F.regexp_extract("line", r"(conv-\d+/-?\d+)", 1).alias("of"), F.col("reason").alias("found")))
    return rows.select(
        F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), F.split_part("of", F.lit("/"), F.lit(1)).alias("convo_id"),
        F.split_part("of", F.lit("/"), F.lit(2)).cast("bigint").alias("seq"), "found",
    )


@query(
    "ingest_post",
    f"{LOG} SELECT convo_id, seq, CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE platform END AS platform, "
    "CASE WHEN seq % 4 = 0 THEN 'assistant' ELSE role END AS role, CASE WHEN seq % 5 = 0 THEN '' ELSE content END AS content, "
    "(CASE WHEN seq % 2 = 0 THEN 0 ELSE len(urls) END)::BIGINT AS n_urls, ms + 1000 AS arrival_ms FROM log",
)
def ingest_post(spark, sf_dir):
    def missing(column, every):
        return F.when(F.col("seq") % every != 0, F.col(column))

    posts = message_log(spark, sf_dir).select(
        "convo_id", "seq", "ts", missing("platform", 3).alias("platform"), missing("role", 4).alias("role"),
        missing("content", 5).alias("text"), missing("urls", 2).alias("urls"),
    )
    stored = ms.ingest_post(posts, F.timestamp_millis(F.unix_millis("ts") + 1000))
    return stored.select(
        "convo_id", "seq", "platform", "role", "content", F.size("urls").cast("bigint").alias("n_urls"),
        F.unix_millis("arrival_ts").alias("arrival_ms"),
    )


@query(
    "ingest_query_string",
    f"{LOG} SELECT convo_id, seq, CASE WHEN seq % 2 = 0 THEN 'claude' ELSE platform END AS platform, "
    "CASE WHEN seq % 3 = 0 THEN 'user' ELSE role END AS role, content, "
    "CASE WHEN seq % 4 = 0 THEN 'get_bypass' ELSE 'image' END AS method FROM log WHERE seq % 7 <> 0",
)
def ingest_query_string(spark, sf_dir):
    log = message_log(spark, sf_dir)

    def part(name, value, every):
        return F.when(F.col("seq") % every != 0, F.concat(F.lit(f"{name}="), F.url_encode(value)))

    parts = F.concat_ws(
        "&", part("platform", F.col("platform"), 2), part("role", F.col("role"), 3),
        part("text", F.col("content"), 7), part("method", F.lit("image"), 4), F.lit("v=1"),
    )
    requests = log.select("convo_id", "seq", F.concat(F.lit("http://127.0.0.1:8788/log?"), parts).alias("url"))
    return ms.ingest_query_string(requests).select("convo_id", "seq", "platform", "role", "content", "method")


@query(
    "upgrade_v1",
    f"{LOG} SELECT ms AS ts_ms, CASE WHEN seq % 2 = 0 THEN 'unknown' ELSE platform END AS platform, role, content, "
    "(CASE WHEN seq % 2 = 0 THEN 0 ELSE length(content) END)::BIGINT AS message_length FROM log",
)
def upgrade_v1(spark, sf_dir):
    log = message_log(spark, sf_dir)
    metadata = F.struct(F.length("content").alias("messageLength"))
    old = F.to_json(F.struct("ts", "role", "content", "urls"))
    new = F.to_json(F.struct("ts", "platform", "role", "content", "urls", metadata.alias("metadata")))
    lines = log.select(F.when(F.col("seq") % 2 == 0, old).otherwise(new).alias("value"))
    good, _ = ms.tolerant_split(lines)
    rows = ms.upgrade_v1(good.select("doc.*"))
    size = F.coalesce("metadata.messageLength", F.lit(0)).alias("message_length")
    return rows.select(ts_ms(), "platform", "role", "content", size)


@query(
    "rolling_retention",
    f"{LOG}, sinks AS (SELECT * FROM (VALUES ('clean', 100), ('recent', 2)) s(sink, n)), ranked AS (SELECT sink, n, "
    "platform, convo_id, seq, row_number() OVER (PARTITION BY sink, platform ORDER BY ms DESC, convo_id DESC, seq DESC) "
    "AS age_rank FROM log, sinks) SELECT sink, platform, convo_id, seq, age_rank FROM ranked WHERE age_rank <= n",
)
def rolling_retention(spark, sf_dir):
    sink = F.explode(F.array(F.lit("clean"), F.lit("recent"))).alias("sink")
    rows = message_log(spark, sf_dir).select("convo_id", "seq", "ts", "platform", sink)
    newest = [F.desc("ts"), F.desc("convo_id"), F.desc("seq")]
    limits = {name: sinks.RETENTION[name] for name in ("clean", "recent")}
    kept = sinks.rolling_retention(rows, ["sink", "platform"], newest, limits)
    return kept.select("sink", "platform", "convo_id", "seq", F.col("age_rank").cast("bigint").alias("age_rank"))


@query(
    "fan_out_sinks",
    f"{LOG}, {NOISE} SELECT s.sink, role, count(*) AS rows FROM noise, (VALUES ('verbose'), ('clean')) s(sink) "
    "WHERE s.sink = 'verbose' OR NOT noise GROUP BY 1, 2",
)
def fan_out_sinks(spark, sf_dir):
    ruled = noise_ops.classify_noise(message_log(spark, sf_dir))
    decisions = ruled.withColumn("action", F.when(F.col("noise"), "verbose_only").otherwise("keep"))
    folders = sinks.fan_out(decisions, fresh_folder(spark, "sinks"))
    logs = [spark.read.parquet(path).select(F.lit(name).alias("sink"), "role") for name, path in folders.items()]
    return logs[0].unionByName(logs[1]).groupBy("sink", "role").agg(F.count(F.lit(1)).alias("rows"))


EVENT_TYPES = {"click": "transmission", "view": "duplicate_detected", "error": "conversation_event",
               "signup": "test_start", "purchase": "test_end"}


def analytics_lines(spark, sf_dir):
    """The ``events`` table as posted analytics documents."""
    rows = read(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind_map = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    kind = kind_map[F.col("event_type")]
    text = F.concat(F.lit("reply "), k.cast("string"), F.lit(" of user "), F.col("user_id").cast("string"))
    name = F.concat(F.lit("test_"), (F.col("user_id") % 5).cast("string"))
    data = (
        F.when(
            kind == "transmission",
            F.to_json(F.struct(F.lit("assistant").alias("role"), (k % 2 == 0).alias("isDuplicate"), text.alias("text"))),
        )
        .when(
            kind == "duplicate_detected",
            F.to_json(F.struct(
                text.alias("text"),
                F.struct(F.when(k < 30, "immediate").when(k < 60, "recent").alias("pattern")).alias("duplicateInfo"),
            )),
        )
        .when(kind == "conversation_event", F.to_json(F.struct(F.lit("navigation").alias("eventType"))))
        .when(kind == "test_start", F.to_json(F.struct(name.alias("testName"))))
        .otherwise(F.to_json(F.struct(name.alias("testName"), k.alias("transmissionCount"), (k % 7).alias("duplicateCount"))))
    )
    phase = F.when(F.col("user_id") % 6 != 0, F.concat(F.lit("phase-"), (k % 4).cast("string")))
    doc = F.to_json(F.struct(
        F.col("at").alias("timestamp"), (F.col("at") % 100000).alias("sessionTime"), kind.alias("type"),
        phase.alias("testPhase"), F.lit("https://claude.ai/chat/1").alias("url"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("conversationId"), data.alias("data"),
    ))
    return rows.select("event_id", doc.alias("value"))


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_TYPES.items()) + " END"
ANALYTICS = (
    f"ana AS (SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ts_ms, user_id, {_KIND} AS type, "
    "(props::JSON->>'$.k')::BIGINT AS k FROM events), analytics AS (SELECT *, "
    "CASE WHEN user_id % 6 <> 0 THEN 'phase-' || (k % 4) END AS test_phase, 'user-' || user_id AS conversation_id FROM ana)"
)


def analytics_events(spark, sf_dir):
    return ev.ingest_analytics(analytics_lines(spark, sf_dir))


@query(
    "ingest_analytics",
    f"WITH {ANALYTICS} SELECT event_id, ts_ms, ts_ms % 100000 AS session_time, type, test_phase, conversation_id FROM analytics",
)
def ingest_analytics(spark, sf_dir):
    return analytics_events(spark, sf_dir).select(
        "event_id", ts_ms(), "session_time", "type", "test_phase", "conversation_id"
    )


@query(
    "analytics_flatten",
    f"WITH {ANALYTICS} SELECT event_id, type, CASE WHEN type = 'transmission' THEN 'assistant' END AS role, "
    "CASE WHEN type = 'transmission' THEN k % 2 = 0 END AS is_duplicate, "
    "CASE WHEN type = 'duplicate_detected' THEN CASE WHEN k < 30 THEN 'immediate' WHEN k < 60 THEN 'recent' ELSE 'unknown' END END AS pattern, "
    "CASE WHEN type IN ('transmission', 'duplicate_detected') THEN left('reply ' || k || ' of user ' || user_id, 50) END AS text_preview, "
    "CASE WHEN type = 'conversation_event' THEN 'navigation' END AS event_subtype, "
    "CASE WHEN type IN ('test_start', 'test_end') THEN 'test_' || (user_id % 5) END AS test_name, "
    "CASE WHEN type = 'test_end' THEN k END AS tx_count, CASE WHEN type = 'test_end' THEN k % 7 END AS dup_count FROM analytics",
)
def analytics_flatten(spark, sf_dir):
    return ev.analytics_flatten(analytics_events(spark, sf_dir)).select(
        "event_id", "type", "role", "is_duplicate", "pattern", "text_preview", "event_subtype", "test_name",
        "tx_count", "dup_count",
    )


TAGS = ["DIV", "P", "BUTTON", "NAV", "ARTICLE", "SPAN"]
CLASSES = ["markdown prose", "chat-message", "sidebar item", "font-claude-response", "toolbar", "conversation-turn"]


def diagnostic_lines(spark, sf_dir):
    """The message log as posted element events; ``content`` is the whole text of the element, which is not posted."""
    log = message_log(spark, sf_dir)
    number = F.col("seq") % 6
    element = F.struct(
        F.get(F.array(*map(F.lit, TAGS)), number.cast("int")).alias("tag"),
        F.get(F.array(*map(F.lit, CLASSES)), ((number + F.floor(F.col("seq") / 64)) % 6).cast("int")).alias("classes"),
        F.length("content").alias("textLength"),
        F.left("content", F.lit(100)).alias("textPreview"),
        F.when(F.col("seq") % 4 == 0, F.array(F.concat(F.lit('data-message-author-role="'), "role", F.lit('"')))).alias("dataAttrs"),
        F.struct(F.col("seq").alias("x"), F.lit(2).alias("y"), F.lit(300).alias("width"), F.lit(20).alias("height")).alias("position"),
    )
    doc = F.to_json(F.struct(
        F.when(F.col("seq") % 3 != 0, "raw_transmission").alias("type"), F.unix_millis("ts").alias("timestamp"),
        element.alias("elementSignature"), F.lit("{}").alias("conversationContext"),
        F.when(F.col("seq") % 2 == 0, "add").otherwise("mutation").alias("transmissionType"),
    ))
    return log.select("convo_id", "seq", "platform", "content", doc.alias("value"))


def diagnostic_events(spark, sf_dir):
    rows = ev.ingest_diagnostic(diagnostic_lines(spark, sf_dir))
    mark = F.get(F.filter("element.dataAttrs", lambda a: a.startswith("data-message-author-role=")), 0)
    return rows.withColumn("element_role", F.nullif(F.regexp_extract(mark, '="(.*)"', 1), F.lit("")))


@query(
    "ingest_diagnostic",
    f"{LOG}, {DIAGNOSTIC} SELECT convo_id, seq, ts_ms, type, transmission_type, tag, classes, text_length, seq AS x FROM diag",
)
def ingest_diagnostic(spark, sf_dir):
    return diagnostic_events(spark, sf_dir).select(
        "convo_id", "seq", ts_ms(), "type", "transmission_type", "element.tag", "element.classes",
        F.col("element.textLength").alias("text_length"), "element.position.x",
    )


def _as_arrays(batches):
    """The documents of a task as the lines of one JSON array."""
    opened = False
    for batch in batches:
        lines = [f"{',' if opened or i else '['}{document}" for i, document in enumerate(batch.column(0).to_pylist())]
        opened = opened or bool(lines)
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": pa.array(["]" if opened else "[]"], pa.string())})


@query(
    "read_test_report",
    f"{LOG} SELECT convo_id, (seq // 64)::BIGINT AS turn, x.log AS log, ms AS ts_ms, role, content FROM log, "
    "(VALUES ('chat'), ('verbose'), ('recent')) x(log) WHERE x.log = 'verbose' OR (x.log = 'chat' AND role <> 'system') "
    "OR (x.log = 'recent' AND seq % 64 < 2)",
)
def read_test_report(spark, sf_dir):
    """A file is an array of many reports, one per turn, of at most forty lines each by construction."""
    line = F.to_json(F.struct("ts", "platform", "role", "content"))
    lines = message_log(spark, sf_dir).select("convo_id", F.floor(F.col("seq") / 64).alias("turn"), "role", kind().alias("kind"), line.alias("line"))
    reports = lines.groupBy("convo_id", "turn").agg(
        F.to_json(F.struct(
            F.concat_ws("/", "convo_id", F.col("turn").cast("string")).alias("timestamp"),
            F.lit(True).alias("success"),
            F.struct(
                F.collect_list(F.when(F.col("role") != "system", F.col("line"))).alias("chat"),
                F.collect_list("line").alias("verbose"),
                F.collect_list(F.when(F.col("kind") < 2, F.col("line"))).alias("recent"),
            ).alias("logs"),
        )).alias("report")
    )
    folder = fresh_folder(spark, "reports")
    reports.select("report").mapInArrow(_as_arrays, "value string").write.text(folder)
    of = F.split("timestamp", "/")
    read_back = ms.read_test_report(spark, folder).withColumns({"convo_id": F.get(of, 0), "turn": F.get(of, 1).cast("bigint")})
    return ms.report_messages(read_back).select("convo_id", "turn", "log", ts_ms(), "role", "content")


@query(
    "export_session_summary",
    f"WITH {ANALYTICS} SELECT conversation_id, max(ts_ms) - min(ts_ms) AS duration_ms, "
    "count(*) FILTER (type = 'transmission') AS transmissions, count(*) FILTER (type = 'duplicate_detected') AS duplicates, "
    "count(*) FILTER (type = 'test_start') AS tests, count(*) FILTER (type = 'conversation_event') AS conversation_events "
    "FROM analytics GROUP BY 1",
)
def export_session_summary(spark, sf_dir):
    folder = fresh_folder(spark, "export")
    sinks.export_session_summary(analytics_events(spark, sf_dir), folder)
    docs = spark.read.schema(
        "conversation_id string, sessionDuration bigint, totalTransmissions bigint, totalDuplicates bigint, "
        "totalTests bigint, conversationEvents bigint"
    ).json(f"{folder}/summary")
    return docs.toDF("conversation_id", "duration_ms", "transmissions", "duplicates", "tests", "conversation_events")


@query(
    "export_sessions",
    f"WITH {ANALYTICS} SELECT conversation_id, max(ts_ms) - min(ts_ms) AS duration_ms, "
    "count(*) FILTER (type = 'transmission') AS transmissions, count(*) FILTER (type = 'duplicate_detected') AS duplicates, "
    "count(*) FILTER (type = 'test_start') AS tests, count(*) FILTER (type = 'conversation_event') AS conversation_events, "
    "count(*) AS events, count(*) FILTER (type IN ('test_start', 'test_end')) AS test_events, sum(ts_ms)::BIGINT AS times, true AS ordered "
    "FROM analytics GROUP BY 1",
)
def export_sessions(spark, sf_dir):
    """One nested document per session, read back: the counts of its summary and all its events."""
    folder = fresh_folder(spark, "sessions")
    dc.export_sessions(analytics_events(spark, sf_dir), folder)
    lists = F.array(*[F.coalesce(name, F.array().cast(f"array<{dc.EVENT}>")) for name in (*dc.LISTS, dc.OTHER)])
    times = F.transform(F.flatten(lists), lambda e: e["timestamp"])
    ordered = F.forall(lists, lambda one: F.transform(one, lambda e: e["timestamp"]) == F.array_sort(F.transform(one, lambda e: e["timestamp"])))
    return dc.read_sessions(spark, folder).select(
        F.col("conversationId").alias("conversation_id"), F.col("summary.sessionDuration").alias("duration_ms"),
        F.col("summary.totalTransmissions").alias("transmissions"), F.col("summary.totalDuplicates").alias("duplicates"),
        F.col("summary.totalTests").alias("tests"), F.col("summary.conversationEvents").alias("conversation_events"),
        F.size(times).cast("bigint").alias("events"), F.size("testResults").cast("bigint").alias("test_events"),
        F.aggregate(times, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("times"), ordered.alias("ordered"),
    )


@query(
    "messages_from_conversations",
    "WITH m AS (SELECT *, 1704067200000 + conv_id * 3600000 + turn * 20000 AS ts_ms, "
    "CASE WHEN conv_id % 2 = 1 THEN 'claude' ELSE 'chatgpt' END AS platform FROM conversations) "
    "SELECT 'conv-' || conv_id AS convo_id, turn AS seq, ts_ms, platform, role, text AS content, "
    "platform || '-' || role || '-' || ts_ms AS msg_id FROM m",
)
def messages_from_conversations(spark, sf_dir):
    rows = ms.messages_from_conversations(read(spark, sf_dir, "conversations"))
    return rows.select("convo_id", "seq", ts_ms(), "platform", "role", "content", "msg_id")


def _sql_page_body() -> str:
    """Markup without comments and unseen or skipped elements; the pages nest none of them."""
    body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for element in ("script", "style", "title", "nav", "header", "button", "svg"):
        body = rf"regexp_replace({body}, '(?is)<{element}(?:\s[^>]*)?>.*?</{element}>', '', 'g')"
    return body


def _sql_entities(e: str) -> str:
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
        e = f"replace({e}, '&{name};', chr({code}))"
    return e


_BUTTON = r"(?i)^(Write|Strategize|Create|Learn|From\s+Drive|Publish|Share|Copy|Edit|Delete)\z"
_NODES = f"string_split(regexp_replace({_sql_page_body()}, '<[^>]*>', chr(10) || '<>' || chr(10), 'g'), chr(10) || '<>' || chr(10))"
_SHOWN = f"array_to_string(list_filter({_NODES}, lambda n: NOT regexp_matches({sql_strip('n')}, '{_BUTTON}')), '')"


@query("page_text_extract", f"SELECT page_id, {sql_norm(_sql_entities(_SHOWN))} AS page_text FROM pages")
def page_text_extract(spark, sf_dir):
    return pg.page_text(spread(read(spark, sf_dir, "pages"))).select("page_id", "page_text")


_UNSEEN = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style|title)[\s>].*?</(script|style|title)\s*>', ' ', 'g')"
_LINKS = rf"""tags AS (SELECT page_id, url, unnest(string_split(html, '<')) AS tag FROM pages),
    quoted AS (SELECT page_id, url, trim(regexp_extract(tag, '(?is)^a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1)) AS q FROM tags
        WHERE regexp_matches(tag, '(?i)^a\s')),
    hrefs AS (SELECT page_id, url, {_sql_entities("CASE WHEN left(q, 1) IN (chr(34), chr(39)) THEN substr(q, 2, length(q) - 2) ELSE q END")} AS h FROM quoted WHERE q <> ''),
    links AS (SELECT DISTINCT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]+') || h END AS link FROM hrefs
    UNION SELECT page_id, rtrim(unnest(regexp_extract_all(regexp_replace({_UNSEEN}, '<[^>]*>', ' ', 'g'), 'https?://[^\s\x{{00A0}}]+')), '.,;!?)') FROM pages)"""


@query("page_link_extract", f"WITH {_LINKS} SELECT page_id, link FROM links WHERE link IS NOT NULL")
def page_link_extract(spark, sf_dir):
    return pg.page_links(spread(read(spark, sf_dir, "pages"))).select("page_id", "link")


@query(
    "page_contents",
    f"WITH {_LINKS}, counted AS (SELECT page_id, count(link) AS n_links FROM links GROUP BY 1), "
    r"""hits AS (SELECT page_id, count(*) AS n_hits FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(<div\s[^>]*class="ad"[^>]*>.*?)</div>', 1)) AS raw FROM pages)
    WHERE length(trim(regexp_replace(raw, '<[^>]*>', '', 'g'))) > 10 GROUP BY 1)"""
    f" SELECT page_id, {sql_norm(_sql_entities(_SHOWN))} AS page_text, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_hits, 0)::BIGINT AS n_artifacts "
    "FROM pages LEFT JOIN counted USING (page_id) LEFT JOIN hits USING (page_id)",
)
def page_contents(spark, sf_dir):
    """Text, links and artifacts of a page from one run over its markup."""
    found = pg.page_contents(spread(read(spark, sf_dir, "pages")), selectors=[".ad"])
    sizes = [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("links", "artifacts")]
    return found.select("page_id", "page_text", *sizes)


@query(
    "page_artifact_extract",
    r"""WITH hits AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)(<div\s[^>]*class="ad"[^>]*>.*?)</div>', 1)) AS raw FROM pages),
    texts AS (SELECT page_id, regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+\z', '', 'g') AS content FROM hits)
    SELECT page_id, content, 'unknown' AS language, s.selector FROM texts, (VALUES ('.ad'), ('[class*="ad"]')) s(selector) WHERE length(content) > 10""",
)
def page_artifact_extract(spark, sf_dir):
    rows = pg.page_artifacts(spread(read(spark, sf_dir, "pages")), selectors=[".ad", '[class*="ad"]'])
    return rows.select("page_id", "content", "language", "selector")
