"""Windowed anomaly filters and their combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.operators import dedup as dd
from turnsift.operators import windows as ops
from turnsift.plans.greedy import keep_if_quiet
from turnsift.plans.timeline import BLOCKS, Timeline
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import BASELINE, LOG, baseline, conv_number, read, sql_any, sql_strip
from turnsift.registry.q_dedup import GENUINE, LEADING, STRICT, direct_sql, exchange_events, greedy_sql, plain, with_model

ROW = ["convo_id", "seq"]
_W = "(PARTITION BY convo_id ORDER BY ms, seq)"
_USER = (
    "u AS (SELECT *, ms - last_value(CASE WHEN role = 'user' THEN ms END IGNORE NULLS) OVER (PARTITION BY convo_id ORDER BY ms, seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS idle, ms - lag(ms) OVER (PARTITION BY convo_id, content ORDER BY ms, seq) AS age FROM log)"
)


@query(
    "velocity_ext",
    f"{LOG}, v AS (SELECT *, ms - lag(ms, 15) OVER {_W} AS d FROM log) SELECT convo_id, seq, coalesce(d < 1000, false) AS bulk FROM v",
)
def velocity_ext(spark, sf_dir):
    """The log's bursts have nineteen rows, so the threshold is set to fifteen here."""
    return ops.velocity_ext(plain(spark, sf_dir).select(*ROW, "ts"), 15, 1).select(*ROW, "bulk")


@query(
    "velocity_events",
    "WITH v AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), n AS (SELECT v.*, count(*) OVER (PARTITION BY user_id ORDER BY us "
    "RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n FROM v) SELECT event_id, n > 4 AS bulk FROM n",
)
def velocity_events(spark, sf_dir):
    """More than four events of a user within a day."""
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("seq"), "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    return ops.velocity_ext(rows, 4, 86400, session="user_id").select("event_id", "bulk")


@query(
    "velocity_lab",
    f"{LOG}, v AS (SELECT *, ms - lag(ms, 5) OVER {_W} AS d, ms - lag(ms, 4) OVER (PARTITION BY convo_id, role ORDER BY ms, seq) AS dr FROM log) "
    "SELECT convo_id, seq, CASE WHEN d < 1000 AND dr < 1000 THEN 'velocity_bulk_dump' END AS reason FROM v",
)
def velocity_lab(spark, sf_dir):
    return ops.velocity_lab(plain(spark, sf_dir)).select(*ROW, "reason")


@query(
    "temporal_ext",
    f"{LOG}, {BASELINE}, {_USER} SELECT convo_id, seq, coalesce(idle > 120000, false) AND content NOT IN (SELECT content FROM baseline) AS stale FROM u",
)
def temporal_ext(spark, sf_dir):
    return ops.temporal_ext(plain(spark, sf_dir), baseline(spark, sf_dir)).select(*ROW, "stale")


_OLD = "age > 300000 AND coalesce(idle > 120000, true)"


@query("temporal_lab", f"{LOG}, {_USER} SELECT convo_id, seq, CASE WHEN {_OLD} THEN 'temporal_historical' END AS reason FROM u")
def temporal_lab(spark, sf_dir):
    return ops.temporal_lab(plain(spark, sf_dir)).select(*ROW, "reason")


_RING = f"list(content) OVER (PARTITION BY convo_id ORDER BY ms, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_MATCHES = "len(list_filter(ring[-3:], lambda h: list_contains(ring[:greatest(len(ring) - 3, 0)], h)))"


@query("autocorr_ext", f"{LOG}, r AS (SELECT convo_id, seq, {_RING} AS ring FROM log) SELECT convo_id, seq, len(ring) > 3 AND {_MATCHES} >= 3 AS pattern FROM r")
def autocorr_ext(spark, sf_dir):
    return ops.autocorr_ext(plain(spark, sf_dir)).select(*ROW, "pattern")


_RUNS = (
    f"{_USER}, m AS (SELECT *, string_agg(CASE WHEN age IS NULL THEN '0' ELSE '1' END, '') OVER (PARTITION BY convo_id ORDER BY ms, seq "
    "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS line FROM u), "
    "runs AS (SELECT *, list_max(list_transform(string_split(line, '0'), lambda p: length(p)))::BIGINT AS run FROM m)"
)


@query(
    "autocorr_lab",
    f"{LOG}, {_RUNS} SELECT convo_id, seq, run, CASE WHEN age IS NOT NULL AND run >= 3 THEN 'autocorrelation_pattern' END AS reason FROM runs",
)
def autocorr_lab(spark, sf_dir):
    return ops.autocorr_lab(plain(spark, sf_dir)).select(*ROW, "run", "reason")


_MUSICAL = sql_any("upper(content)", ex.MUSICAL_SETS["capture"])


@query("context_preserve_ext", f"{LOG}, {_USER} SELECT convo_id, seq, {_MUSICAL} OR coalesce(idle < 30000, false) AS preserved FROM u")
def context_preserve_ext(spark, sf_dir):
    return ops.context_preserve_ext(plain(spark, sf_dir)).select(*ROW, "preserved")


@query("is_new_message_ext", f"{LOG}, {BASELINE}, {_USER} SELECT convo_id, seq FROM u WHERE idle < 120000 AND content NOT IN (SELECT content FROM baseline)")
def is_new_message_ext(spark, sf_dir):
    return ops.is_new_ext(plain(spark, sf_dir), baseline(spark, sf_dir)).select(*ROW)


_LAB_SET = sql_any("upper(content)", ex.MUSICAL_SETS["lab"])
_SIGNALS = (
    f"{_RUNS}, v AS (SELECT *, row_number() OVER w AS n, ms - lag(ms, 5) OVER w AS d, ms - lag(ms, 4) OVER (PARTITION BY convo_id, role ORDER BY ms, seq) AS dr "
    "FROM runs WINDOW w AS (PARTITION BY convo_id ORDER BY ms, seq)), "
    "vs AS (SELECT a.convo_id, a.seq, count(*) AS vsize, coalesce(bool_or(b.n < a.n AND b.n >= a.n - 10 AND b.role = 'user' AND a.role = 'assistant' "
    f"AND {sql_strip('b.content')} = {sql_strip('a.content')} AND a.ms - b.ms < 10000), false) AS near_echo FROM v a JOIN v b ON b.convo_id = a.convo_id AND b.n <= a.n "
    "AND a.ms - b.ms < 1000 GROUP BY 1, 2), "
    "ec AS (SELECT a.convo_id, a.seq, true AS echo FROM v a WHERE a.role = 'assistant' AND EXISTS (SELECT 1 FROM v b WHERE b.convo_id = a.convo_id AND b.n < a.n "
    f"AND b.n >= a.n - 10 AND b.role = 'user' AND a.ms - b.ms < 10000 AND {sql_strip('b.content')} = {sql_strip('a.content')})), "
    "f AS (SELECT v.*, vs.vsize, coalesce(d < 1000 AND dr < 1000, false) AS f1, coalesce(age > 300000 AND coalesce(idle > 120000, true), false) AS f2, "
    "coalesce(ec.echo, false) AS f3, age IS NOT NULL AND run >= 3 AS f4 FROM v JOIN vs USING (convo_id, seq) LEFT JOIN ec USING (convo_id, seq)), "
    f"pre AS (SELECT *, CASE WHEN age IS NULL THEN CASE WHEN {_LAB_SET} AND idle < 60000 THEN 'musical_command' "
    "WHEN length(content) < 50 AND idle < 30000 AND vsize < 3 THEN 'conversational_echo' END END AS ladder FROM f), "
    "sig AS (SELECT *, (f1 OR f2 OR f3 OR f4) AS flagged, CASE WHEN f1 OR f2 OR f3 OR f4 THEN ladder END AS preserved_by, "
    "array_to_string(list_filter([CASE WHEN f1 THEN 'velocity_bulk_dump' END, CASE WHEN f2 THEN 'temporal_historical' END, CASE WHEN f3 THEN 'user_input_echo' END, "
    "CASE WHEN f4 THEN 'autocorrelation_pattern' END], lambda x: x IS NOT NULL), ',') AS filtered_by FROM pre), "
    "lab AS (SELECT *, flagged AND preserved_by IS NULL AS filtered FROM sig)"
)


@query("context_preserve_lab", f"{LOG}, {_SIGNALS} SELECT convo_id, seq, ladder AS preserved_by FROM pre")
def context_preserve_lab(spark, sf_dir):
    return ops.context_preserve_lab(plain(spark, sf_dir)).select(*ROW, "preserved_by")


@query(
    "signal_decisions_lab",
    f"{LOG}, {_SIGNALS} SELECT convo_id, seq, filtered, filtered_by, preserved_by, vsize AS velocity_buffer_size, age IS NOT NULL AS is_historical FROM lab",
)
def signal_decisions_lab(spark, sf_dir):
    rows = ops.signal_pipeline_lab(plain(spark, sf_dir))
    return rows.select(
        *ROW, "filtered", F.array_join("filtered_by", ",").alias("filtered_by"), "preserved_by",
        F.col("velocity_buffer_size").cast("bigint").alias("velocity_buffer_size"), "is_historical",
    )


@query(
    "signal_decisions_genuine",
    f"{LOG}, {_SIGNALS}, {STRICT} SELECT lab.convo_id, lab.seq, lab.filtered AND NOT coalesce(s.genuine, false) AS filtered, "
    "CASE WHEN coalesce(s.genuine, false) THEN '' ELSE lab.filtered_by END AS filtered_by, coalesce(s.genuine, false) AS is_genuine_response, "
    "coalesce(s.genuine, false) AND lab.role = 'user' AS is_genuine_user_input FROM lab LEFT JOIN strict s USING (convo_id, seq)",
)
def signal_decisions_genuine(spark, sf_dir):
    rows = ops.signal_pipeline_genuine(plain(spark, sf_dir), exchange_events(spark, sf_dir))
    return rows.select(
        *ROW, "filtered", F.array_join("filtered_by", ",").alias("filtered_by"), "is_genuine_response", "is_genuine_user_input"
    )


@query(
    "filter_stats",
    f"{LOG}, {_SIGNALS} SELECT count(*) AS total, count(*) FILTER (f1) AS by_velocity, count(*) FILTER (f2) AS by_temporal, count(*) FILTER (f3) AS by_echo, "
    "count(*) FILTER (f4) AS by_autocorrelation, count(*) FILTER (preserved_by IS NOT NULL) AS preserved, count(*) FILTER (NOT filtered) AS clean, "
    "count(*) FILTER (filtered) AS verbose_only FROM lab",
)
def filter_stats(spark, sf_dir):
    return ops.filter_stats(ops.signal_pipeline_lab(plain(spark, sf_dir)))


def _model_sql(label: str) -> str:
    """The stages of one model in SQL, each on the survivors of the one before."""
    parts = [
        LOG, BASELINE, _USER,
        "s0 AS (SELECT *, content IN (SELECT content FROM baseline) AS based FROM u WHERE role = 'assistant' AND length(content) >= 3)",
        f"s1 AS (SELECT * FROM (SELECT *, ms - lag(ms, 25) OVER {_W} AS d FROM s0) WHERE NOT coalesce(d < 1000, false))",
    ]
    last = "s1"
    if label != "generic":
        parts.append(f"s2 AS (SELECT * FROM {last} WHERE idle IS NULL OR idle <= 120000 OR based)")
        last = "s2"
    if label == "opus-4.1":
        parts.append(f"s3a AS (SELECT *, {_RING} AS ring FROM {last})")
        parts.append(f"s3 AS (SELECT * FROM s3a WHERE NOT (len(ring) > 3 AND {_MATCHES} >= 3))")
        last = "s3"
    parts.append(LEADING)
    parts.append(
        f"s4a AS (SELECT s.*, e.echo FROM {last} s JOIN lead_echo e ON e.convo_id = s.convo_id AND e.seq = s.seq)"
    )
    parts.append(
        "s4 AS (SELECT * FROM s4a a WHERE a.ms - (SELECT min(b.ms) FROM s4a b WHERE b.convo_id = a.convo_id AND b.content = a.content "
        "AND NOT b.echo AND (b.ms, b.seq) <= (a.ms, a.seq)) < 30000)"
    )
    new = "(NOT based AND coalesce(idle < 120000, false))"
    kept = f"({_MUSICAL} OR coalesce(idle < 30000, false))"
    sonnet = f"({sql_any('lower(content)', ex.SONNET_PHRASES)} OR length(content) > 50)"
    accept = {"sonnet-4": f"{kept} OR {sonnet} OR {new}", "opus-4.1": f"{kept} OR {new}", "generic": new}[label]
    return ", ".join(parts) + f" SELECT convo_id, seq FROM s4 WHERE {accept}"


def _model_query(label: str, name: str) -> None:
    @query(name, _model_sql(label))
    def run(spark, sf_dir):
        return ops.model_pipeline(with_model(spark, sf_dir), baseline(spark, sf_dir), label).select(*ROW)


for _label, _name in {"sonnet-4": "model_filters_sonnet", "opus-4.1": "model_filters_opus", "generic": "model_filters_generic"}.items():
    _model_query(_label, _name)


@query("response_latency", f"{LOG}, {GENUINE} SELECT platform, count(*) AS replies, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, sum(latency_ms)::BIGINT AS total_ms FROM genuine WHERE nth = 1 GROUP BY 1")
def response_latency(spark, sf_dir):
    pairs = dd.genuine_response_fast(plain(spark, sf_dir))
    ms = F.col("latency_ms")
    return pairs.groupBy("platform").agg(
        F.count(F.lit(1)).alias("replies"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms")
    )


@query(
    "history_ttl",
    f"{LOG}, " + greedy_sql("log", "(convo_id, content)", "30000") + " SELECT convo_id, seq, kept AS first_occurrence FROM greedy",
)
def history_ttl(spark, sf_dir):
    """Entries expire after thirty seconds."""
    return ops.history_ttl(plain(spark, sf_dir), 30 / 3600).select(*ROW, "first_occurrence")


def _in_blocks(spark, blocks, job):
    """Run ``job`` with its input cut into ``blocks``, whatever its size."""
    spark.conf.set(BLOCKS, str(blocks))
    try:
        return job()
    finally:
        spark.conf.unset(BLOCKS)


@query(
    "hot_key_scan",
    f"{LOG} SELECT convo_id, seq, lag(role) OVER w AS role_before, sum(length(content)) OVER w AS characters, "
    "row_number() OVER w AS place FROM log WINDOW w AS (PARTITION BY platform ORDER BY ms, convo_id, seq)",
)
def hot_key_scan(spark, sf_dir):
    """Two platforms hold the whole log: each is several blocks."""
    rows = plain(spark, sf_dir).select(*ROW, "ts", "platform", "role", F.length("content").cast("bigint").alias("size"))
    log = _in_blocks(spark, 5, lambda: Timeline(rows, ["platform"], ["ts", "convo_id", "seq"]).scan(
        prev={"role_before": F.col("role")}, total={"characters": F.col("size"), "place": F.lit(1)}
    ))
    return log.result(*ROW, "role_before", "characters", "place")


@query("hot_key_quiet", f"{LOG}, " + greedy_sql("log", "platform", "60000") + " SELECT convo_id, seq, kept FROM greedy")
def hot_key_quiet(spark, sf_dir):
    rows = plain(spark, sf_dir).select(*ROW, "ts", "platform")
    kept = _in_blocks(spark, 5, lambda: keep_if_quiet(rows, ["platform"], "ts", ["convo_id", "seq"], F.lit(60)))
    return kept.select(*ROW, "kept")


@query("hot_key_relay", f"{LOG}, hot AS (SELECT platform AS convo_id, conv_id * 1000000 + seq AS seq, ms, role, content FROM log), "
       f"{direct_sql('hot')} SELECT convo_id, seq, is_new FROM w WHERE n > 0")
def hot_key_relay(spark, sf_dir):
    """Two platforms as one conversation each, over ten blocks; what was let through is remembered across all of them."""
    rows = plain(spark, sf_dir).select(
        F.col("platform").alias("convo_id"), (conv_number() * 1_000_000 + F.col("seq")).alias("seq"), "ts", "platform", "role", "content"
    )
    return _in_blocks(spark, 10, lambda: dd.is_new_direct(rows)).select(*ROW, "is_new")
