"""Reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators import noise as noise_ops
from turnsift.operators import reports as ops
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import LOG, conv_number, message_log, read, sql_norm
from turnsift.registry.q_dedup import plain
from turnsift.registry.q_enrich import RECENCY, TOOLS
from turnsift.registry.q_noise import NOISE, _marked
from turnsift.registry.q_sources import ANALYTICS, analytics_events
from turnsift.session import cut_lineage

ROW = ["convo_id", "seq"]


def classified(spark, sf_dir):
    return noise_ops.classify_noise(message_log(spark, sf_dir))


def clean_log(spark, sf_dir):
    return classified(spark, sf_dir).where(~F.col("noise"))


_CLEAN = f"{NOISE}, clean AS (SELECT * FROM noise WHERE NOT noise)"


@query("log_counts", f"{LOG}, {_CLEAN} SELECT (SELECT count(*) FROM clean) AS clean, count(*) AS verbose, count(*) - (SELECT count(*) FROM clean) AS filtered FROM noise")
def log_counts(spark, sf_dir):
    return ops.log_counts(classified(spark, sf_dir))


_OKAY = r"regexp_matches(content, '^okay\d+\z')"


def _types(source: str) -> str:
    return (
        "types AS (SELECT count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_responses, "
        "count(*) FILTER (role = 'system') AS system_messages, "
        f"count(*) FILTER ((role = 'user' AND (contains(content, 'testmessage') OR contains(content, 'VERIFICATION_TEST'))) OR (role = 'assistant' AND {_OKAY})) AS test_messages, "
        f"count(*) FILTER (role = 'assistant' AND NOT {_OKAY} AND NOT contains(content, 'Extension loaded')) AS legitimate_content FROM {source})"
    )


_LAST = "(SELECT * FROM clean ORDER BY ms DESC, convo_id DESC, seq DESC LIMIT 20)"


@query("content_type_breakdown", f"{LOG}, {_CLEAN}, {_types(_LAST)} SELECT * FROM types")
def content_type_breakdown(spark, sf_dir):
    return ops.content_types(clean_log(spark, sf_dir))


@query("content_type_breakdown_all", f"{LOG}, {_CLEAN}, {_types('clean')} SELECT * FROM types")
def content_type_breakdown_all(spark, sf_dir):
    return ops.content_types(clean_log(spark, sf_dir), last=None)


def _audit(source: str) -> str:
    values = ", ".join(f"('{p}')" for p in ex.AUDIT_PATTERNS)
    return f"audit AS (SELECT pattern, count(*) AS hits FROM {source}, (VALUES {values}) p(pattern) WHERE contains(lower(content), lower(pattern)) GROUP BY 1)"


@query("noise_audit", f"{LOG}, {_audit('log')} SELECT * FROM audit")
def noise_audit(spark, sf_dir):
    return ops.noise_audit(plain(spark, sf_dir))


@query(
    "filtered_out",
    f"{LOG}, {_CLEAN} SELECT v.convo_id, v.seq FROM noise v WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.content = v.content AND abs(c.ms - v.ms) < 1000)",
)
def filtered_out(spark, sf_dir):
    return ops.filtered_out(classified(spark, sf_dir)).select(*ROW)


@query(
    "quality_score",
    f"{LOG}, {_CLEAN}, {_types('clean')}, {_audit('clean')}, q AS (SELECT (SELECT count(*) FROM clean) AS clean, (SELECT count(*) FROM noise) AS verbose, "
    "(SELECT coalesce(sum(hits), 0) FROM audit)::BIGINT AS noise_hits, round(user_messages / greatest(assistant_responses, 1), 4) AS user_assistant_ratio, test_messages FROM types), "
    'r AS (SELECT *, "verbose" - clean AS filtered, round(("verbose" - clean) / "verbose" * 100, 4) AS filter_rate FROM q), '
    "s AS (SELECT *, (CASE WHEN noise_hits = 0 THEN 25 ELSE 0 END + CASE WHEN user_assistant_ratio > 0.5 AND user_assistant_ratio < 2 THEN 25 ELSE 0 END "
    "+ CASE WHEN filter_rate > 10 THEN 25 ELSE 0 END + CASE WHEN test_messages > 0 THEN 25 ELSE 0 END)::BIGINT AS score FROM r) "
    'SELECT clean, "verbose", filtered, noise_hits, user_assistant_ratio, filter_rate, score, '
    "CASE WHEN score >= 75 THEN 'excellent' WHEN score >= 50 THEN 'good' ELSE 'needs work' END AS grade FROM s",
)
def quality_score(spark, sf_dir):
    return ops.quality_score(classified(spark, sf_dir))


@query(
    "dup_rate",
    f"{LOG}, {RECENCY} SELECT role, count(*) AS total, count(recency) AS duplicates, count(*) FILTER (recency = 'immediate') AS immediate, "
    "count(*) FILTER (recency = 'recent') AS recent, count(*) FILTER (recency = 'historical') AS historical, round(count(recency) / count(*), 6) AS rate FROM recency GROUP BY 1",
)
def dup_rate(spark, sf_dir):
    return ops.dup_rate(plain(spark, sf_dir))


@query(
    "phase_summary",
    f"WITH {ANALYTICS}, p AS (SELECT conversation_id, test_phase, count(*) FILTER (type = 'transmission') AS transmissions, "
    "count(*) FILTER (type = 'duplicate_detected') AS duplicates, max(ts_ms) FILTER (type = 'test_start') AS start_ms, "
    "max(ts_ms) FILTER (type = 'test_end') AS last_end FROM analytics WHERE test_phase IS NOT NULL GROUP BY 1, 2) "
    "SELECT conversation_id, test_phase, transmissions, duplicates, start_ms, CASE WHEN last_end >= start_ms THEN last_end END AS end_ms, "
    "CASE WHEN last_end >= start_ms THEN last_end - start_ms END AS duration_ms FROM p",
)
def phase_summary(spark, sf_dir):
    return ops.phase_summary(analytics_events(spark, sf_dir))


@query(
    "session_summary",
    f"WITH {ANALYTICS} SELECT max(ts_ms) - min(ts_ms) AS duration_ms, count(*) FILTER (type = 'transmission') AS transmissions, "
    "count(*) FILTER (type = 'duplicate_detected') AS duplicates, count(*) FILTER (type = 'test_start') AS tests, count(*) AS events FROM analytics",
)
def session_summary(spark, sf_dir):
    return ops.session_totals(analytics_events(spark, sf_dir))


@query(
    "detection_method_counts",
    f"{LOG} SELECT CASE WHEN seq % 2 = 0 THEN 'keydown' ELSE 'unknown' END AS detection_method, count(*) AS rows, "
    "count(*) FILTER (seq % 3 = 0 AND seq % 4 = 0) AS genuine_inputs FROM log GROUP BY 1",
)
def detection_method_counts(spark, sf_dir):
    return ops.detection_method_counts(_marked(spark, sf_dir))


@query(
    "history_stats",
    f"{LOG} SELECT convo_id, count(DISTINCT {sql_norm('content')}) AS memory_entries, max(ms) FILTER (role = 'user') AS last_user_ms, max(ms) - min(ms) AS session_ms FROM log GROUP BY 1",
)
def history_stats(spark, sf_dir):
    return ops.history_stats(plain(spark, sf_dir))


@query(
    "history_sketches",
    f"{LOG} SELECT platform, count(DISTINCT {sql_norm('content')}) AS texts, max(ms) FILTER (role = 'user') AS last_user_ms, "
    "max(ms) - min(ms) AS session_ms, true AS within_error FROM log GROUP BY 1",
)
def history_sketches(spark, sf_dir):
    """Distinct texts of a platform, united from the sketches of its sessions' days, within three standard errors of the exact count."""
    log = plain(spark, sf_dir)
    days = cut_lineage(ops.history_sketches(log))
    platform = F.when(conv_number() % 2 == 1, "claude").otherwise("chatgpt")
    merged = ops.merged_history(days.withColumn("platform", platform), ["platform"])
    exact = log.groupBy("platform").agg(F.count_distinct(tx.norm_text(F.col("content"))).alias("texts"))
    near = F.abs(F.col("memory_entries") - F.col("texts")) <= F.ceil(3 * 1.04 / 64 * F.col("texts"))
    return merged.join(exact, "platform").select("platform", "texts", "last_user_ms", "session_ms", near.alias("within_error"))


@query(
    "test_pass_rate",
    "WITH t AS (SELECT source, quality = 1 AS passed FROM labels JOIN documents USING (doc_id)), r AS (SELECT source, count(*) AS tests, "
    "count(*) FILTER (passed) AS passed_tests, round(count(*) FILTER (passed) / count(*) * 100, 1) AS rate FROM t GROUP BY 1) "
    "SELECT *, CASE WHEN rate >= 80 THEN 'excellent' WHEN rate >= 60 THEN 'good' ELSE 'needs improvement' END AS grade FROM r",
)
def test_pass_rate(spark, sf_dir):
    """The quality labels of the documents, read as test results of their source."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    rows = labels.join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return ops.pass_rate(rows, ["source"])


@query("message_count_per_platform", f"{LOG} SELECT platform, count(*) AS messages FROM log GROUP BY 1")
def message_count_per_platform(spark, sf_dir):
    return ops.platform_counts(plain(spark, sf_dir))


@query(
    "count_change_monitor",
    f"{LOG}, a AS (SELECT platform, (ms // 60000) * 60 AS slot, count(*) AS added FROM log GROUP BY 1, 2) "
    "SELECT platform, slot::BIGINT AS slot, added, (sum(added) OVER (PARTITION BY platform ORDER BY slot ROWS UNBOUNDED PRECEDING))::BIGINT AS entries FROM a",
)
def count_change_monitor(spark, sf_dir):
    return ops.count_changes(plain(spark, sf_dir))


@query("newest_rows", f"{LOG} SELECT convo_id, seq, role, left(content, 50) AS preview FROM log ORDER BY ms DESC, convo_id DESC, seq DESC LIMIT 3")
def newest_rows(spark, sf_dir):
    return ops.newest_rows(plain(spark, sf_dir)).select(*ROW, "role", "preview")


_MUTATION = "CASE event_type WHEN 'error' THEN 'characterData' WHEN 'signup' THEN 'attributes' ELSE 'childList' END"


@query(
    "mutation_profile",
    f"SELECT {_MUTATION} AS type, (['DIV', 'P', 'SPAN'])[user_id % 3 + 1] AS target_tag, count(*) AS events, "
    "sum((props::JSON->>'$.k')::BIGINT % 4)::BIGINT AS added, sum((props::JSON->>'$.k')::BIGINT % 3)::BIGINT AS removed FROM events GROUP BY 1, 2",
)
def mutation_profile(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    tags = F.array(F.lit("DIV"), F.lit("P"), F.lit("SPAN"))
    rows = read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "characterData").when(F.col("event_type") == "signup", "attributes").otherwise("childList").alias("type"),
        F.get(tags, (F.col("user_id") % 3).cast("int")).alias("target_tag"), (k % 4).alias("added"), (k % 3).alias("removed"),
    )
    return ops.mutation_profile(rows)


@query(
    "bulk_burst_report",
    f"{LOG}, b0 AS (SELECT *, lag(role) OVER w AS pr, lag(ms) OVER w AS pm, last_value(CASE WHEN role = 'user' THEN ms END IGNORE NULLS) OVER "
    "(PARTITION BY convo_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_ms FROM log WINDOW w AS (PARTITION BY convo_id ORDER BY ms, seq)), "
    "b1 AS (SELECT *, sum(CASE WHEN coalesce(pr = 'assistant' AND ms - pm <= 1000, false) THEN 0 ELSE 1 END) OVER (PARTITION BY convo_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS burst FROM b0) "
    "SELECT convo_id, count(*) AS rows, min(ms) AS start_ms, max(ms) AS end_ms, max(user_ms) AS user_ms, min(ms) - max(user_ms) AS delay_ms FROM b1 "
    "WHERE role = 'assistant' GROUP BY convo_id, burst HAVING count(*) >= 5",
)
def bulk_burst_report(spark, sf_dir):
    return ops.bulk_bursts(plain(spark, sf_dir))


@query("tool_usage", f"{LOG}, {TOOLS} SELECT platform, tool, count(*) AS rows FROM tools WHERE tool IS NOT NULL GROUP BY 1, 2")
def tool_usage(spark, sf_dir):
    return ops.tool_usage(plain(spark, sf_dir))


@query(
    "artifact_usage",
    r"""WITH hits AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, '(?s)<div\s[^>]*class="ad"[^>]*>(.*?)</div>', 1)) AS raw FROM pages)
    SELECT host, count(*) AS artifacts FROM hits WHERE length(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+\z', '', 'g')) > 10 GROUP BY 1""",
)
def artifact_usage(spark, sf_dir):
    from turnsift.sources.pages import page_artifacts

    rows = page_artifacts(read(spark, sf_dir, "pages"), selectors=[".ad"])
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")
    return rows.groupBy(host).agg(F.count(F.lit(1)).alias("artifacts"))
