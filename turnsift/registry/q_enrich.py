"""Message enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators import enrich as ops
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import LOG, message_log, read, sql_any, sql_match, sql_norm, sql_strip

ROW = ["convo_id", "seq"]


@query("norm_text", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.norm_text(F.col("text")).alias("norm"))


_NAV = sql_match("u", ex.NAVIGATION_LINKS)
_FOUND = rf"regexp_extract_all(content, 'https?://[^\s\x{{00A0}}]+')"


@query(
    "extract_urls_text",
    f"{LOG}, found AS (SELECT convo_id, seq, list_transform({_FOUND}, lambda u: regexp_replace(u, '[.,;!?)]+\\z', '')) AS all_urls FROM log), "
    f"kept AS (SELECT convo_id, seq, list_filter(all_urls, lambda u: NOT {_NAV}) AS urls FROM found), "
    "ranked AS (SELECT convo_id, seq, url, min(p) AS p FROM (SELECT convo_id, seq, unnest(urls) AS url, generate_subscripts(urls, 1) AS p FROM kept) GROUP BY 1, 2, 3) "
    "SELECT convo_id, seq, url, row_number() OVER (PARTITION BY convo_id, seq ORDER BY p) - 1 AS pos FROM ranked",
)
def extract_urls_text(spark, sf_dir):
    log = message_log(spark, sf_dir)
    rows = log.select(*ROW, F.posexplode(tx.text_urls(F.col("content"))).alias("pos", "url"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


# Addresses derived from the pages table: chat pages, navigation and the page itself.
_CHAT_URLS = (
    "urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://claude.ai/chat/' || page_id || '-abcdef' "
    "WHEN 1 THEN 'https://chatgpt.com/c/ab' || page_id WHEN 2 THEN 'https://chat.openai.com/' "
    "WHEN 3 THEN 'https://chatgpt.com/g/g-' || page_id WHEN 4 THEN 'https://claude.ai/project/' || page_id || '-0123456789' "
    "WHEN 5 THEN 'https://sora.chatgpt.com/' || page_id WHEN 6 THEN 'https://chatgpt.com/library' ELSE url END AS url FROM pages)"
)


def chat_urls(spark, sf_dir):
    p = F.col("page_id")
    n = p.cast("string")
    forms = [
        F.concat(F.lit("https://claude.ai/chat/"), n, F.lit("-abcdef")), F.concat(F.lit("https://chatgpt.com/c/ab"), n),
        F.lit("https://chat.openai.com/"), F.concat(F.lit("https://chatgpt.com/g/g-"), n),
        F.concat(F.lit("https://claude.ai/project/"), n, F.lit("-0123456789")),
        F.concat(F.lit("https://sora.chatgpt.com/"), n), F.lit("https://chatgpt.com/library"), F.col("url"),
    ]
    return read(spark, sf_dir, "pages").select("page_id", F.get(F.array(*forms), (p % 8).cast("int")).alias("url"))


@query("is_nav_url", f"WITH {_CHAT_URLS} SELECT page_id, url, {_NAV.replace('(u,', '(url,')} AS is_nav FROM urls")
def is_nav_url(spark, sf_dir):
    return chat_urls(spark, sf_dir).withColumn("is_nav", tx.is_nav_url(F.col("url")))


_PARTS = (
    f"{_CHAT_URLS}, parts AS (SELECT *, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '') AS ps, "
    "CASE WHEN url LIKE '%claude.ai%' THEN 'claude' WHEN url LIKE '%chatgpt.com%' OR url LIKE '%chat.openai.com%' THEN 'chatgpt' ELSE 'unknown' END AS platform FROM urls)"
)


def _after(marker: str) -> str:
    return f"CASE WHEN list_position(ps, '{marker}') > 0 THEN ps[list_position(ps, '{marker}') + 1] END"


_JOINED = "CASE WHEN len(ps) = 0 THEN '/' ELSE array_to_string(ps, '/') END"


@query(
    "convo_id_from_url",
    f"WITH {_PARTS} SELECT page_id, CASE platform WHEN 'chatgpt' THEN coalesce({_after('c')}, {_JOINED}) "
    f"WHEN 'claude' THEN coalesce({_after('chat')}, CASE WHEN length(ps[-1]) > 10 THEN ps[-1] END, {_JOINED}) ELSE {_JOINED} END AS convo FROM parts",
)
def convo_id_from_url(spark, sf_dir):
    url = F.col("url")
    return chat_urls(spark, sf_dir).select(
        "page_id", tx.convo_id_from_url(url, tx.platform_from_host(url)).alias("convo")
    )


@query("convo_id_lab", f"WITH {_PARTS} SELECT page_id, coalesce({_after('chat')}, ps[-1], 'unknown') AS convo FROM parts")
def convo_id_lab(spark, sf_dir):
    return chat_urls(spark, sf_dir).select("page_id", tx.convo_id_lab(F.col("url")).alias("convo"))


@query("platform_from_host", f"WITH {_PARTS} SELECT page_id, platform FROM parts")
def platform_from_host(spark, sf_dir):
    return chat_urls(spark, sf_dir).select("page_id", tx.platform_from_host(F.col("url")).alias("platform"))


def _sql_tools() -> str:
    named = [f"nullif(regexp_extract(content, '(?i){p.replace(chr(39), chr(39) * 2)}', 1), '')" for p in ex.TOOL_MENTIONS]
    for platform, tools in ex.PLATFORM_TOOLS.items():
        named += [f"CASE WHEN platform = '{platform}' AND contains(lower(content), '{t}') THEN '{t}' END" for t in tools]
    return "[" + ", ".join(named) + "]"


TOOLS = f"tools AS (SELECT DISTINCT convo_id, seq, platform, unnest({_sql_tools()}) AS tool FROM log)"


@query("detect_tools", f"{LOG}, {TOOLS} SELECT convo_id, seq, tool FROM tools WHERE tool IS NOT NULL")
def detect_tools(spark, sf_dir):
    tools = tx.detect_tools(F.col("content"), F.col("platform"))
    return message_log(spark, sf_dir).select(*ROW, F.explode(tools).alias("tool"))


@query("message_id", f"{LOG} SELECT convo_id, seq, platform || '-' || role || '-' || ms AS msg_id FROM log")
def message_id(spark, sf_dir):
    return ops.enrich_messages(message_log(spark, sf_dir)).select(*ROW, "msg_id")


@query("message_length", "SELECT doc_id, length(text)::BIGINT AS message_length FROM documents")
def message_length(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.message_length(F.col("text")).alias("message_length"))


_SAID = r"regexp_replace(content, '(?i)^ChatGPT said:\s*', '')"
CLEAN = sql_strip(rf"regexp_replace({_SAID}, '(?i)^(ChatGPT|GPT-\d+):\s*', '')")


@query("clean_assistant_prefix", f"{LOG} SELECT convo_id, seq, {CLEAN} AS clean FROM log")
def clean_assistant_prefix(spark, sf_dir):
    return message_log(spark, sf_dir).select(*ROW, tx.clean_assistant_prefix(F.col("content")).alias("clean"))


MODEL = (
    "CASE WHEN contains(content, 'Sonnet 4') THEN 'sonnet-4' WHEN contains(content, 'Opus 4.1') THEN 'opus-4.1' "
    "WHEN contains(content, 'Haiku') THEN 'haiku' ELSE 'unknown' END"
)


@query("model_from_text", f"{LOG} SELECT convo_id, seq, {MODEL} AS model FROM log")
def model_from_text(spark, sf_dir):
    return ops.enrich_messages(message_log(spark, sf_dir)).select(*ROW, "model")


@query(
    "processing_label",
    f"{LOG}, m AS (SELECT *, {MODEL} AS model FROM log) SELECT convo_id, seq, "
    "CASE WHEN model IN ('sonnet-4', 'opus-4.1') THEN model ELSE 'generic' END AS label FROM m",
)
def processing_label(spark, sf_dir):
    return ops.enrich_messages(message_log(spark, sf_dir)).select(*ROW, F.col("pipeline").alias("label"))


@query(
    "filter_config_join",
    f"{LOG}, m AS (SELECT *, {MODEL} AS model FROM log), c AS (SELECT * FROM (VALUES ('sonnet-4', 3, true, 5000), "
    "('opus-4.1', 2, false, 3000), ('unknown', 2, true, 3000)) c(name, echo_chars, allow_greetings, temporal_window)) "
    "SELECT convo_id, seq, model, echo_chars::BIGINT AS echo_chars, allow_greetings, temporal_window::BIGINT AS temporal_window "
    "FROM m JOIN c ON c.name = CASE WHEN model = 'haiku' THEN 'unknown' ELSE model END",
)
def filter_config_join(spark, sf_dir):
    rows = message_log(spark, sf_dir).withColumn("model", tx.model_from_text(F.col("content")))
    return ops.with_filter_config(rows).select(*ROW, "model", "echo_chars", "allow_greetings", "temporal_window")


_CODES = "list_prepend(0::BIGINT, list_transform(string_split(role || ':' || content, ''), lambda c: unicode(c)::BIGINT))"


@query(
    "content_hash",
    f"{LOG}, h AS (SELECT convo_id, seq, list_reduce({_CODES}, lambda h, c: (h * 31 + c) % 4294967296) AS h FROM log) "
    "SELECT convo_id, seq, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT AS hash FROM h",
)
def content_hash(spark, sf_dir):
    text = F.concat("role", F.lit(":"), "content")
    return message_log(spark, sf_dir).select(*ROW, tx.content_hash(text).alias("hash"))


RECENCY = (
    f"seen AS (SELECT *, ms - lag(ms) OVER (PARTITION BY convo_id, {sql_norm('content')} ORDER BY ms, seq) AS gap_ms FROM log), "
    "recency AS (SELECT *, CASE WHEN gap_ms < 1000 THEN 'immediate' WHEN gap_ms < 30000 THEN 'recent' "
    "WHEN gap_ms IS NOT NULL THEN 'historical' END AS recency FROM seen)"
)


@query("duplicate_recency_class", f"{LOG}, {RECENCY} SELECT convo_id, seq, recency FROM recency")
def duplicate_recency_class(spark, sf_dir):
    return ops.with_duplicate_recency(message_log(spark, sf_dir)).select(*ROW, "recency")


_FLOW_IN = (
    "f0 AS (SELECT *, CASE WHEN seq % 3 = 0 THEN role END AS role_attr, (role = 'user' AND seq % 2 = 0) AS typed, "
    "seq % 5 < 3 AS structural FROM log), f1 AS (SELECT *, last_value(CASE WHEN role_attr = 'user' OR typed THEN ms END IGNORE NULLS) "
    "OVER (PARTITION BY convo_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_ms FROM f0), "
    "f2 AS (SELECT *, coalesce(CASE WHEN role_attr IN ('user', 'assistant') THEN role_attr END, "
    "CASE WHEN typed AND ms - user_ms < 5000 THEN 'user' END, CASE WHEN ms - user_ms < 30000 AND ms - user_ms > 1000 THEN 'assistant' END) AS early FROM f1), "
    "f3 AS (SELECT *, sum(CASE WHEN early IS NULL AND structural THEN 1 ELSE 0 END) OVER (PARTITION BY convo_id ORDER BY ms, seq "
    "ROWS UNBOUNDED PRECEDING) AS place FROM f2)"
)


@query(
    "infer_role_flow",
    rf"""{LOG}, {_FLOW_IN} SELECT convo_id, seq, CASE WHEN early IS NOT NULL THEN early WHEN structural AND place % 2 = 1 THEN 'user'
    WHEN structural THEN 'assistant'
    WHEN length(content) < 50 AND (contains(content, '_ok') OR regexp_matches(content, '(?i)^(ok|yes|no|done|thanks|sure)\z') OR regexp_matches(content, '^\w+_\w+\z')) THEN 'assistant'
    WHEN length(content) > 20 AND (contains(content, '?') OR regexp_matches(content, '(?i)^(can you|please|how|what|when|where|why)') OR regexp_matches(content, '^[A-Z]')) THEN 'user'
    ELSE 'unknown' END AS inferred_role FROM f3""",
)
def infer_role_flow(spark, sf_dir):
    rows = message_log(spark, sf_dir).withColumns({
        "role_attr": F.when(F.col("seq") % 3 == 0, F.col("role")),
        "typed": (F.col("role") == "user") & (F.col("seq") % 2 == 0),
        "structural": F.col("seq") % 5 < 3,
    })
    return ops.infer_role_flow(rows).select(*ROW, "inferred_role")


_T, _N = sql_strip("content"), sql_norm("content")


def _role(user: str, assistant: str) -> str:
    return f"CASE WHEN {user} THEN 'user' WHEN {assistant} THEN 'assistant' ELSE 'unknown' END"


_DIRECT = _role(
    f"regexp_matches({_T}, '^J[A-Z]') OR {sql_any(_T, ['JSEQUENCE:', 'JPLAY:', 'JVOLUME:'])} OR (contains({_T}, 'testmessage') AND contains({_T}, 'respond'))",
    rf"regexp_matches({_T}, '^(seq_ok|play_ok|vol_ok|okay\d+)\z') OR contains({_T}, '_ok')",
)
_ANA = _role(
    f"(contains({_N}, 'test') AND contains({_N}, 'respond')) OR regexp_matches({_N}, '^(PLAY|SEQUENCE):')",
    rf"regexp_matches({_N}, '^okay\d+') OR contains({_N}, 'okay_')",
)
_LAB = _role(
    sql_any(_N, ["JSEQUENCE:", "JPLAY:", "testmessage"]),
    rf"regexp_matches({_N}, '(?i)(seq_ok|play_ok|vol_ok|okay\d+)') OR contains({_N}, '_ok')",
)


@query("infer_role_patterns", f"{LOG} SELECT convo_id, seq, {_DIRECT} AS direct, {_ANA} AS analytics, {_LAB} AS lab FROM log")
def infer_role_patterns(spark, sf_dir):
    forms = [tx.role_by_patterns(F.col("content"), form).alias(form) for form in ("direct", "analytics", "lab")]
    return message_log(spark, sf_dir).select(*ROW, *forms)


@query("preview", "SELECT doc_id, left(text, 60) AS preview FROM documents")
def preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text"), 60).alias("preview"))


@query(
    "is_musical_command",
    f"{LOG} SELECT convo_id, seq, "
    + ", ".join(f"{sql_any('upper(content)', words)} AS {name}_set" for name, words in ex.MUSICAL_SETS.items())
    + " FROM log",
)
def is_musical_command(spark, sf_dir):
    sets = [tx.is_musical_command(F.col("content"), name).alias(f"{name}_set") for name in ex.MUSICAL_SETS]
    return message_log(spark, sf_dir).select(*ROW, *sets)
