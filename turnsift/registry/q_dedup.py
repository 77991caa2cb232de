"""Duplicates, echoes and replaced fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.operators import dedup as ops
from turnsift.operators import replay as rp
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import LOG, conv_number, kind, message_log, sql_norm, sql_any, sql_strip, turn
from turnsift.registry.q_enrich import CLEAN
from turnsift.registry.q_noise import NOISE

ROW = ["convo_id", "seq"]


def greedy_sql(source: str, key: str, width: str, over: str = ">", forced: str = "false", name: str = "greedy") -> str:
    """Recursive CTE ``name``: ``kept`` by the keep-if-quiet rule, one row at a time per key."""
    return (
        f"{name}_r AS (SELECT *, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY ms, convo_id, seq) AS rn FROM {source}), "
        f"{name} AS (SELECT k, rn, convo_id, seq, ms AS last, true AS kept FROM {name}_r WHERE rn = 1 UNION ALL "
        f"SELECT r.k, r.rn, r.convo_id, r.seq, CASE WHEN {forced} OR r.ms - g.last {over} {width} THEN r.ms ELSE g.last END, "
        f"({forced} OR r.ms - g.last {over} {width}) FROM {name} g JOIN {name}_r r ON r.k = g.k AND r.rn = g.rn + 1)"
    )


def plain(spark, sf_dir):
    return message_log(spark, sf_dir)


def with_model(spark, sf_dir):
    names = F.array(F.lit("sonnet-4"), F.lit("opus-4.1"), F.lit("unknown"))
    return plain(spark, sf_dir).withColumn("model", F.get(names, (conv_number() % 3).cast("int")))


@query(
    "dedup_window_role",
    f"{LOG}, " + greedy_sql("log", "(platform, role, content)", "(CASE WHEN r.role = 'assistant' THEN 2000 ELSE 5000 END)")
    + " SELECT convo_id, seq, kept FROM greedy",
)
def dedup_window_role(spark, sf_dir):
    return ops.dedup_window_role(plain(spark, sf_dir)).select(*ROW, "kept")


@query(
    "dedup_assistant_30s",
    f"{LOG}, said AS (SELECT * FROM log WHERE role = 'assistant'), " + greedy_sql("said", "content", "30000")
    + " SELECT convo_id, seq, kept FROM greedy",
)
def dedup_assistant_30s(spark, sf_dir):
    return ops.dedup_assistant_30s(plain(spark, sf_dir)).select(*ROW, "kept")


_DEDUP = (
    "d0 AS (SELECT *, seq % 11 = 2 AS historical, CASE WHEN role = 'assistant' THEN '*' ELSE platform END AS place FROM log), "
    "d1 AS (SELECT *, lag(ms) OVER w AS prev FROM d0 WINDOW w AS (PARTITION BY place, role, content ORDER BY ms, convo_id, seq)), "
    "d2 AS (SELECT *, prev IS NULL OR ms - prev > 3600000 AS fresh FROM d1), "
    "d3 AS (SELECT *, max(CASE WHEN fresh THEN ms END) OVER (PARTITION BY place, role, content ORDER BY ms, convo_id, seq ROWS UNBOUNDED PRECEDING) AS run_ms FROM d2), "
    "d4 AS (SELECT * FROM d3 WHERE fresh OR NOT (historical OR (role <> 'assistant' AND ms - run_ms < 10000))), "
    + greedy_sql("d4", "(place, role, content)", "(CASE WHEN r.role = 'assistant' THEN 30000 ELSE 5000 END)", forced="r.fresh")
)


@query(
    "dedup_first_seen",
    f"{LOG}, {_DEDUP} SELECT convo_id, seq, coalesce(g.kept, false) AS kept FROM log LEFT JOIN greedy g USING (convo_id, seq)",
)
def dedup_first_seen(spark, sf_dir):
    log = plain(spark, sf_dir).withColumn("historical", F.col("seq") % 11 == 2)
    return ops.dedup_messages(log, historical="historical").select(*ROW, "kept")


@query(
    "j_prefix_block",
    f"{LOG} SELECT convo_id, seq, role = 'user' AND starts_with(content, 'J') AND length(content) > 10 AND "
    f"{sql_any('substr(content, 2)', ['testmessage', 'respond'])} AS blocked FROM log",
)
def j_prefix_block(spark, sf_dir):
    return plain(spark, sf_dir).select(*ROW, ops.prefix_block(F.col("role"), F.col("content")).alias("blocked"))


@query(
    "supersede_prefixed",
    f"{LOG}, n AS (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS next_content FROM log "
    "WINDOW w AS (PARTITION BY platform, convo_id ORDER BY ms, seq)) SELECT convo_id, seq, coalesce(role = 'user' AND next_role = 'user' "
    "AND starts_with(content, 'J') AND substr(content, 2) = next_content, false) AS superseded FROM n",
)
def supersede_prefixed(spark, sf_dir):
    return ops.supersede_prefixed(plain(spark, sf_dir)).select(*ROW, "superseded")


_RN = "rn AS (SELECT *, row_number() OVER (PARTITION BY platform, convo_id ORDER BY ms, seq) AS n FROM log)"
_EXACT = f"(a.ms - u.ms <= 10000 AND {sql_strip('u.content')} = {sql_strip('a.content')})"
_ECHO = (
    f"{_RN}, hits AS (SELECT a.convo_id, a.seq, arg_min(CASE WHEN {_EXACT} THEN 'exact' ELSE 'conversational' END, u.n) AS label "
    "FROM rn a JOIN rn u ON u.convo_id = a.convo_id AND u.n < a.n AND u.n >= a.n - 5 AND u.role = 'user' WHERE a.role = 'assistant' "
    f"AND ({_EXACT} OR (a.ms - u.ms <= 30000 AND contains(lower(a.content), lower(u.content)))) GROUP BY 1, 2), "
    "seen AS (SELECT *, lag(ms) OVER (PARTITION BY platform, convo_id, role, content ORDER BY ms, seq) AS seen_ms FROM log), "
    "echo AS (SELECT s.convo_id, s.seq, CASE WHEN s.seen_ms IS NULL OR s.seen_ms = s.ms THEN h.label END AS label "
    "FROM seen s LEFT JOIN hits h USING (convo_id, seq))"
)


@query("exact_user_echo", f"{LOG}, {_ECHO} SELECT convo_id, seq, coalesce(label = 'exact', false) AS user_input_echo FROM echo")
def exact_user_echo(spark, sf_dir):
    labels = ops.user_echo_label(plain(spark, sf_dir))
    return labels.select(*ROW, F.coalesce(F.col("label") == "exact", F.lit(False)).alias("user_input_echo"))


@query("conversational_echo_allow", f"{LOG}, {_ECHO} SELECT convo_id, seq, label FROM echo WHERE label IS NOT NULL")
def conversational_echo_allow(spark, sf_dir):
    return ops.user_echo_label(plain(spark, sf_dir)).where("label is not null").select(*ROW, "label")


_COLLAPSED = (
    f"{_RN}, pairs AS (SELECT b.convo_id, b.seq AS by_seq, arg_min(a.seq, a.n) AS seq FROM rn b JOIN rn a ON a.convo_id = b.convo_id "
    "AND a.n < b.n AND a.n >= b.n - 20 WHERE a.role = 'assistant' AND b.role = 'assistant' AND b.ms > a.ms AND b.ms - a.ms <= 5000 "
    "AND length(a.content) >= 3 AND length(b.content) > length(a.content) AND starts_with(b.content, a.content) GROUP BY 1, 2), "
    "gone AS (SELECT DISTINCT convo_id, seq FROM pairs)"
)


@query("stream_prefix_collapse", f"{LOG}, {_COLLAPSED} SELECT l.convo_id, l.seq FROM log l ANTI JOIN gone USING (convo_id, seq)")
def stream_prefix_collapse(spark, sf_dir):
    return ops.stream_prefix_collapse(plain(spark, sf_dir)).select(*ROW)


@query(
    "name_prefix_echo_block",
    f"{LOG}, {_RN} SELECT a.convo_id, a.seq, a.role = 'assistant' AND a.platform = 'claude' AND EXISTS (SELECT 1 FROM rn u "
    "WHERE u.convo_id = a.convo_id AND u.n < a.n AND u.n >= a.n - 10 AND u.role = 'user' AND a.ms - u.ms <= 30000 "
    "AND length(u.content) >= 10 AND substr(a.content, 2) = u.content) AS blocked FROM rn a",
)
def name_prefix_echo_block(spark, sf_dir):
    return ops.name_prefix_echo(plain(spark, sf_dir)).select(*ROW, "blocked")


# The strict replay, one row per step; ``ring`` holds the clean rows as structs.  A conversation
# has one platform, so platforms need not be compared.
_ITEM = "{'seq': r.seq, 'ms': r.ms, 'role': r.role, 'content': r.content}"
_SAME = "list_filter(g.ring[-50:], lambda x: x.role = r.role AND x.content = r.content)"
_EXACT_X = f"(r.ms - x.ms <= 10000 AND {sql_strip('x.content')} = {sql_strip('r.content')})"
_HITS = f"list_filter(g.ring[-50:][-5:], lambda x: x.role = 'user' AND ({_EXACT_X} OR (r.ms - x.ms <= 30000 AND contains(lower(r.content), lower(x.content)))))"
REPLAY = (
    f"{NOISE}, y AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms, seq) AS rn, (role = 'user' AND starts_with(content, 'J') AND length(content) > 10 "
    f"AND {sql_any('substr(content, 2)', ['testmessage', 'respond'])}) AS blocked FROM noise), "
    "steps AS (SELECT DISTINCT convo_id, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS action, '' AS reasons, []::BIGINT[] AS removed, "
    "[]::STRUCT(seq BIGINT, ms BIGINT, role VARCHAR, content VARCHAR)[] AS ring FROM y UNION ALL "
    "SELECT convo_id, rn, seq, action, CASE WHEN action = 'drop' THEN reason WHEN action = 'verbose_only' THEN concat_ws(',', CASE WHEN echo THEN 'user_input_echo' END, CASE WHEN noise THEN noise_rule END) ELSE '' END, "
    "removed, CASE WHEN action = 'keep' THEN list_append(ring2, item)[-100:] ELSE ring2 END FROM ("
    "SELECT *, CASE WHEN reason <> '' THEN 'drop' WHEN echo OR noise THEN 'verbose_only' ELSE 'keep' END AS action, "
    "list_concat(CASE WHEN sup THEN [ring0[-1].seq] ELSE [] END, CASE WHEN early = '' AND frag IS NOT NULL THEN list_transform(list_filter(ring1, lambda x: x.ms = frag.ms AND x.content = frag.content), lambda x: x.seq) ELSE [] END) AS removed FROM ("
    "SELECT *, CASE WHEN early <> '' THEN early WHEN role = 'assistant' AND platform = 'claude' AND len(list_filter(ring2[-10:], lambda x: x.role = 'user' AND item.ms - x.ms BETWEEN 0 AND 30000 "
    "AND length(x.content) >= 10 AND substr(item.content, 2) = x.content)) > 0 THEN 'name_prefix_echo' ELSE '' END AS reason FROM ("
    "SELECT *, CASE WHEN early = '' AND frag IS NOT NULL THEN list_filter(ring1, lambda x: NOT (x.ms = frag.ms AND x.content = frag.content)) ELSE ring1 END AS ring2 FROM ("
    "SELECT *, CASE WHEN role = 'assistant' THEN list_filter(ring1[-20:], lambda x: x.role = 'assistant' AND item.ms - x.ms > 0 AND item.ms - x.ms <= 5000 AND length(x.content) >= 3 "
    "AND length(x.content) < length(item.content) AND starts_with(item.content, x.content))[1] END AS frag, "
    "coalesce(role = 'assistant' AND NOT known AND hit_exact, false) AS echo FROM ("
    "SELECT *, CASE WHEN sup THEN ring0[:-2] ELSE ring0 END AS ring1, CASE WHEN first_drop <> '' THEN first_drop WHEN known AND item.ms - same[1].ms < 10000 THEN 'fast_repeat' ELSE '' END AS early FROM ("
    "SELECT *, first_drop = '' AND role = 'user' AND len(ring0) > 0 AND ring0[-1].role = 'user' AND starts_with(ring0[-1].content, 'J') AND substr(ring0[-1].content, 2) = item.content AS sup FROM ("
    "SELECT r.convo_id, r.rn, r.seq, r.role, r.platform, r.noise, r.noise_rule, g.ring AS ring0, "
    f"{_ITEM} AS item, {_SAME} AS same, len({_SAME}) > 0 AND {_SAME}[1].ms <> r.ms AS known, "
    f"CASE WHEN len({_HITS}) > 0 THEN r.ms - {_HITS}[1].ms <= 10000 AND {sql_strip(_HITS + '[1].content')} = {sql_strip('r.content')} END AS hit_exact, "
    f"CASE WHEN len(list_filter({_SAME}, lambda x: r.ms - x.ms <= CASE WHEN r.role = 'assistant' THEN 2000 ELSE 5000 END)) > 0 THEN 'duplicate_window' "
    f"WHEN r.role = 'assistant' AND len(list_filter({_SAME}, lambda x: r.ms - x.ms <= 30000)) > 0 THEN 'assistant_repeat' "
    "WHEN r.blocked AND len(g.ring) > 0 THEN 'prefix_block' ELSE '' END AS first_drop FROM steps g JOIN y r ON r.convo_id = g.convo_id AND r.rn = g.rn + 1)))))))), "
    "gone AS (SELECT DISTINCT convo_id, unnest(removed) AS seq FROM steps), "
    "replayed AS (SELECT s.convo_id, s.seq, CASE WHEN s.action = 'keep' AND gone.seq IS NOT NULL THEN 'superseded' ELSE s.action END AS action, s.reasons "
    "FROM steps s LEFT JOIN gone ON gone.convo_id = s.convo_id AND gone.seq = s.seq WHERE s.rn > 0)"
)


@query("replay_dedup", f"{LOG}, {REPLAY} SELECT * FROM replayed")
def replay_dedup(spark, sf_dir):
    return rp.replay_dedup(plain(spark, sf_dir)).select(*ROW, "action", F.array_join("reasons", ",").alias("reasons"))


@query(
    "recent_history_dedup",
    f"{LOG}, h0 AS (SELECT convo_id, seq, ms, {CLEAN} AS t FROM log WHERE role = 'assistant'), "
    "h1 AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms, seq) AS rn FROM h0), "
    "h2 AS (SELECT convo_id, rn, seq, true AS kept, [t] AS ring FROM h1 WHERE rn = 1 UNION ALL SELECT r.convo_id, r.rn, r.seq, "
    "NOT list_contains(g.ring, r.t), CASE WHEN list_contains(g.ring, r.t) THEN g.ring ELSE list_append(g.ring, r.t)[-20:] END "
    "FROM h2 g JOIN h1 r ON r.convo_id = g.convo_id AND r.rn = g.rn + 1) SELECT convo_id, seq, kept FROM h2",
)
def recent_history_dedup(spark, sf_dir):
    return ops.recent_history_dedup(plain(spark, sf_dir)).select(*ROW, "kept")


@query(
    "consecutive_dedup",
    f"{LOG}, u AS (SELECT *, lag(content) OVER (PARTITION BY convo_id ORDER BY ms, seq) AS p FROM log WHERE role = 'user' AND length(content) > 2) "
    "SELECT convo_id, seq FROM u WHERE p IS DISTINCT FROM content",
)
def consecutive_dedup(spark, sf_dir):
    return ops.consecutive_dedup(plain(spark, sf_dir)).select(*ROW)


LEADING = (
    "e0 AS (SELECT *, (['sonnet-4', 'opus-4.1', 'unknown'])[conv_id % 3 + 1] AS model FROM log WHERE role IN ('user', 'assistant')), "
    "e1 AS (SELECT *, CASE WHEN model = 'sonnet-4' THEN 3 ELSE 2 END AS k, model <> 'opus-4.1' AS greet, "
    "sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY convo_id ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) AS users FROM e0), "
    "lead_echo AS (SELECT a.convo_id, a.seq, a.ms, a.content, a.platform, EXISTS (SELECT 1 FROM e1 u WHERE u.convo_id = a.convo_id AND u.role = 'user' "
    "AND u.users <= a.users AND a.users - u.users < 20 AND (u.ms, u.seq) < (a.ms, a.seq) AND length(a.content) - length(u.content) BETWEEN 0 AND a.k "
    "AND ends_with(a.content, u.content)) AND NOT (a.greet AND (contains(lower(a.content), 'hello') OR contains(lower(a.content), 'hi there') "
    "OR contains(lower(a.content), 'how can i help'))) AS echo FROM e1 a WHERE a.role = 'assistant')"
)


@query("user_echo_leading_chars", f"{LOG}, {LEADING} SELECT convo_id, seq, echo FROM lead_echo")
def user_echo_leading_chars(spark, sf_dir):
    return ops.leading_char_echo(with_model(spark, sf_dir)).select(*ROW, "echo")


@query(
    "echo_filter_ext",
    f"{LOG}, {LEADING} SELECT a.convo_id, a.seq, coalesce(a.ms - (SELECT min(b.ms) FROM lead_echo b WHERE b.convo_id = a.convo_id "
    "AND b.content = a.content AND NOT b.echo AND (b.ms, b.seq) <= (a.ms, a.seq)) < 30000, false) AS passes FROM lead_echo a",
)
def echo_filter_ext(spark, sf_dir):
    return ops.first_sight_filter(with_model(spark, sf_dir)).select(*ROW, "passes")


@query(
    "echo_filter_lab",
    f"{LOG}, {_RN} SELECT a.convo_id, a.seq, CASE WHEN a.role = 'assistant' AND EXISTS (SELECT 1 FROM rn u WHERE u.convo_id = a.convo_id "
    f"AND u.n < a.n AND u.n >= a.n - 10 AND u.role = 'user' AND a.ms - u.ms < 10000 AND {sql_strip('u.content')} = {sql_strip('a.content')}) "
    "THEN 'user_input_echo' END AS reason FROM rn a",
)
def echo_filter_lab(spark, sf_dir):
    return ops.echo_filter_lab(plain(spark, sf_dir)).select(*ROW, "reason")


_GAPS = "gaps AS (SELECT *, ms - lag(ms) OVER (PARTITION BY convo_id, content{role} ORDER BY ms, seq) AS gap FROM log{where})"


def direct_sql(source: str) -> str:
    """Recursive CTE ``w``: one row at a time per conversation of ``source``, with the texts let through and when."""
    return (
        f"r AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms, seq) AS n FROM {source}), "
        "w AS (SELECT convo_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS user_ms, MAP([]::VARCHAR[], []::BIGINT[]) AS seen, NULL::BOOLEAN AS is_new "
        "FROM r WHERE n = 1 UNION ALL SELECT convo_id, n, seq, CASE WHEN new AND role = 'user' THEN ms ELSE user_ms END, "
        "CASE WHEN NOT new THEN seen WHEN cardinality(added) > 100 THEN map_from_entries(list_filter(map_entries(added), lambda e: e.value >= ms - 600000)) "
        "ELSE added END, new FROM (SELECT *, CASE WHEN gap < 30000 THEN true WHEN gap > 60000 THEN false "
        "ELSE role <> 'assistant' OR user_ms IS NULL OR ms - user_ms <= 120000 END AS new, map_concat(seen, MAP([content], [ms])) AS added "
        "FROM (SELECT r.convo_id, r.n, r.seq, r.role, r.ms, r.content, w.user_ms, w.seen, r.ms - w.seen[r.content] AS gap "
        "FROM w JOIN r ON r.convo_id = w.convo_id AND r.n = w.n + 1)))"
    )


@query("is_new_message_direct", f"{LOG}, {direct_sql('log')} SELECT convo_id, seq, is_new FROM w WHERE n > 0")
def is_new_message_direct(spark, sf_dir):
    return ops.is_new_direct(plain(spark, sf_dir)).select(*ROW, "is_new")


@query(
    "is_new_message_prod",
    f"{LOG}, {_GAPS.format(role='', where='')} SELECT convo_id, seq, sum(CASE WHEN gap > 300000 THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY convo_id, content ORDER BY ms, seq ROWS UNBOUNDED PRECEDING) = 0 AS is_new FROM gaps",
)
def is_new_message_prod(spark, sf_dir):
    return ops.is_new_production(plain(spark, sf_dir)).select(*ROW, "is_new")


_POLICY = (
    f"p0 AS (SELECT *, {sql_norm('content')} AS t FROM log), p1 AS (SELECT *, first_value(ms) OVER w AS first_ms, "
    "row_number() OVER w > 1 AS rep FROM p0 WINDOW w AS (PARTITION BY convo_id, t ORDER BY ms, seq)), "
    "p2 AS (SELECT *, ms - first_ms AS age, ms - last_value(CASE WHEN rep AND role = 'user' THEN ms END IGNORE NULLS) OVER (PARTITION BY convo_id ORDER BY ms, seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS idle FROM p1), "
    f"p3 AS (SELECT *, CASE WHEN NOT rep THEN 'first_occurrence' WHEN {sql_any('upper(t)', ex.MUSICAL_SETS['repeat'])} AND age < 60000 THEN 'legitimate_musical_repeat' "
    "WHEN age < 30000 AND coalesce(idle < 120000, false) THEN 'conversational_flow' "
    "WHEN age > 300000 AND NOT coalesce(idle < 120000, false) THEN 'historical_retransmission' "
    "WHEN role = 'assistant' AND coalesce(idle > 120000, true) THEN 'orphaned_assistant_response' "
    "WHEN age > 60000 AND age < 300000 THEN 'medium_term_duplicate' ELSE 'default_allow' END AS reason FROM p2), "
    "p4 AS (SELECT *, reason NOT IN ('historical_retransmission', 'orphaned_assistant_response', 'medium_term_duplicate') AS should_log FROM p3)"
)


@query(
    "repeat_policy",
    f"{LOG}, {_POLICY} SELECT convo_id, seq, should_log, reason, (sum(CASE WHEN should_log THEN 1 ELSE 0 END) OVER "
    "(PARTITION BY convo_id, t ORDER BY ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS repeat_count FROM p4",
)
def repeat_policy(spark, sf_dir):
    return ops.repeat_policy(plain(spark, sf_dir)).select(*ROW, "should_log", "reason", "repeat_count")


_SENDS = "sends AS (SELECT *, (content IS DISTINCT FROM lag(content) OVER (PARTITION BY convo_id ORDER BY ms, seq)) AS changed FROM log WHERE role = 'user')"


@query(
    "user_send_dedup",
    f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms, seq) AS n FROM log "
    f"WHERE role = 'assistant' OR (role = 'user' AND {sql_strip('content')} <> '')), "
    "w AS (SELECT convo_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS last, NULL::BIGINT AS last_ms, NULL::BIGINT AS sent_ms, "
    "false AS waits, NULL::BOOLEAN AS accepted FROM r WHERE n = 1 UNION ALL "
    "SELECT convo_id, n, seq, CASE WHEN fresh THEN content ELSE last END, CASE WHEN fresh THEN ms ELSE last_ms END, "
    "CASE WHEN counts THEN ms ELSE sent_ms END, CASE WHEN said THEN waits AND ms - sent_ms < 500 ELSE waits OR counts END, "
    "CASE WHEN NOT said THEN counts END FROM (SELECT *, fresh AND NOT (waits AND ms - sent_ms < 2000) AS counts "
    "FROM (SELECT r.convo_id, r.n, r.seq, r.ms, r.content, w.last, w.last_ms, w.sent_ms, w.waits, r.role = 'assistant' AS said, "
    "r.role = 'user' AND NOT coalesce(r.content = w.last AND r.ms - w.last_ms < 10000, false) AS fresh "
    "FROM w JOIN r ON r.convo_id = w.convo_id AND r.n = w.n + 1))) SELECT convo_id, seq, accepted FROM w WHERE accepted IS NOT NULL",
)
def user_send_dedup(spark, sf_dir):
    return ops.user_send_dedup(plain(spark, sf_dir)).select(*ROW, "accepted")


@query(
    "consecutive_window_dedup",
    f"{LOG}, runs AS (SELECT *, (content IS DISTINCT FROM lag(content) OVER (PARTITION BY convo_id ORDER BY ms, seq)) AS changed FROM log), "
    + greedy_sql("runs", "convo_id", "5000", ">=", "r.changed") + " SELECT convo_id, seq, kept FROM greedy",
)
def consecutive_window_dedup(spark, sf_dir):
    return ops.consecutive_window_dedup(plain(spark, sf_dir)).select(*ROW, "kept")


GENUINE = (
    "g0 AS (SELECT *, last_value(CASE WHEN role = 'user' THEN ms END IGNORE NULLS) OVER w AS user_ms, "
    "last_value(CASE WHEN role = 'user' THEN seq END IGNORE NULLS) OVER w AS user_seq FROM log "
    "WINDOW w AS (PARTITION BY convo_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "genuine AS (SELECT *, ms - user_ms AS latency_ms, row_number() OVER (PARTITION BY convo_id, user_ms, user_seq ORDER BY ms, seq) AS nth "
    "FROM g0 WHERE role = 'assistant' AND ms - user_ms BETWEEN 500 AND 15000)"
)


@query("genuine_response_match", f"{LOG}, {GENUINE} SELECT convo_id, seq, user_seq, latency_ms FROM genuine WHERE nth = 1")
def genuine_response_match(spark, sf_dir):
    return ops.genuine_response_fast(plain(spark, sf_dir)).select(*ROW, "user_seq", "latency_ms")


def exchange_events(spark, sf_dir, log=None):
    """The log as send, user and assistant events: original user turns are sent 300 ms earlier."""
    log = (plain(spark, sf_dir) if log is None else log).where(~F.col("role").eqNullSafe("system"))
    marked = F.when((F.col("role") == "user") & (F.col("seq") % 3 == 0), F.timestamp_millis(F.unix_millis("ts") - 20000))
    rows = log.select(*ROW, "ts", F.col("role").alias("event"), "content", marked.alias("marked_ts"))
    sends = log.where((F.col("role") == "user") & (kind() == 0)).select(
        "convo_id", (F.col("seq") - 64_000_000).alias("seq"),
        F.timestamp_millis(F.unix_millis("ts") - 300).alias("ts"), F.lit("send").alias("event"), "content",
        F.lit(None).cast("timestamp").alias("marked_ts"),
    )
    return rows.unionByName(sends)


# One row per event; a row number 0 per conversation holds the state at the start.
_OPEN = "g.open AND r.ms - g.sent <= 15000"
_X = (
    "x0 AS (SELECT convo_id, seq, ms, role AS event, content, CASE WHEN role = 'user' AND seq % 3 = 0 THEN ms - 20000 END AS marked FROM log WHERE role <> 'system' "
    "UNION ALL SELECT convo_id, seq - 64000000, ms - 300, 'send', content, NULL FROM log WHERE role = 'user' AND kind = 0), "
    "x1 AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms, seq) AS rn FROM x0), "
    "exchange AS (SELECT DISTINCT convo_id, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS event, false AS genuine, false AS open, '' AS said, 0::BIGINT AS sent, false AS seen, false AS done FROM x1 "
    "UNION ALL SELECT convo_id, rn, seq, event, (mark OR (uhit AND ms - sent0 <= 5000) OR ahit), "
    "CASE WHEN snd OR mark THEN true WHEN ahit THEN false ELSE open0 END, CASE WHEN snd OR mark THEN content ELSE said0 END, "
    "CASE WHEN snd OR mark THEN ms ELSE sent0 END, CASE WHEN snd THEN false WHEN mark OR uhit THEN true ELSE seen0 END, "
    "CASE WHEN snd OR mark THEN false WHEN ahit THEN true ELSE done0 END FROM ("
    "SELECT r.convo_id, r.rn, r.seq, r.event, r.ms, r.content, g.open AS open0, g.said AS said0, g.sent AS sent0, g.seen AS seen0, g.done AS done0, "
    "(r.event = 'send' AND NOT (g.open AND r.ms - g.sent < 1000)) AS snd, "
    "(r.event = 'user' AND r.marked IS NOT NULL AND r.ms - r.marked < 30000) AS mark, "
    f"(r.event = 'user' AND NOT (r.marked IS NOT NULL AND r.ms - r.marked < 30000) AND {_OPEN} AND r.content = g.said AND NOT g.seen) AS uhit, "
    f"(r.event = 'assistant' AND {_OPEN} AND g.seen AND NOT g.done AND r.ms - g.sent >= 500) AS ahit "
    "FROM exchange g JOIN x1 r ON r.convo_id = g.convo_id AND r.rn = g.rn + 1))"
)
STRICT = f"{_X}, strict AS (SELECT convo_id, seq, event, genuine FROM exchange WHERE rn > 0)"


@query("genuine_response_strict", f"{LOG}, {STRICT} SELECT * FROM strict")
def genuine_response_strict(spark, sf_dir):
    return ops.genuine_response_strict(exchange_events(spark, sf_dir)).select(*ROW, "event", "genuine")


_BURSTS = (
    "u0 AS (SELECT *, (seq // 64)::BIGINT AS turn_no, lag(ms) OVER (PARTITION BY convo_id, seq // 64, role ORDER BY ms, seq) AS p FROM log), "
    "u1 AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY convo_id, turn_no, role ORDER BY ms, seq "
    "ROWS UNBOUNDED PRECEDING) AS burst FROM u0), "
    "bursts AS (SELECT convo_id, turn_no, role, burst, arg_max(content, (ms, seq)) AS content, arg_min(content, (ms, seq)) AS first_content, "
    "max(ms) + 1000 AS emit_ms, count(*) AS updates FROM u1 GROUP BY ALL)"
)


def _bursts(spark, sf_dir):
    updates = plain(spark, sf_dir).withColumn("turn_no", turn())
    return ops.debounce_last(updates, ["convo_id", "turn_no", "role"], 1000)


@query(
    "debounce_last",
    f"{LOG}, {_BURSTS} SELECT convo_id, turn_no, role, content, emit_ms, updates, content <> first_content AS text_changed FROM bursts",
)
def debounce_last(spark, sf_dir):
    return _bursts(spark, sf_dir).select(
        "convo_id", "turn_no", "role", "content", F.unix_millis("emit_ts").alias("emit_ms"), "updates", "text_changed"
    )


@query(
    "debounce_final_shape",
    rf"{LOG}, {_BURSTS} SELECT convo_id, turn_no, content FROM bursts WHERE regexp_matches(content, '^okay\d+\z')",
)
def debounce_final_shape(spark, sf_dir):
    return ops.final_shape_filter(_bursts(spark, sf_dir)).select("convo_id", "turn_no", "content")


# Elements by user, added, removed and changed at the times of the events table.
@query(
    "persistence_filter",
    "WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) * 1000 AS us, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'textChange' ELSE 'add' END AS event FROM events), "
    "n AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_us FROM e) "
    "SELECT event_id, user_id FROM n WHERE event = 'add' AND (next_us IS NULL OR next_us - us >= 3600000000)",
)
def persistence_filter(spark, sf_dir):
    from turnsift.registry.base import read

    event = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "textChange").otherwise("add")
    ts = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").alias("seq"), "user_id", ts.alias("ts"), event.alias("event")
    )
    return ops.persistence_filter(rows, ["user_id"], 3_600_000).select("event_id", "user_id")


@query(
    "ghost_duplicate",
    f"{LOG}, e AS (SELECT *, {sql_norm('content')} AS t, seq % 64 = 0 AS established FROM log) SELECT convo_id, seq, EXISTS (SELECT 1 FROM e o "
    "WHERE o.convo_id = e.convo_id AND o.t = e.t AND o.established AND o.seq <> e.seq) AS ghost FROM e",
)
def ghost_duplicate(spark, sf_dir):
    return ops.ghost_duplicates(plain(spark, sf_dir).withColumn("established", kind() == 0)).select(*ROW, "ghost")


_SNAPS = (
    "snaps AS (SELECT convo_id, seq * 4 + s.i AS seq, ms - 3000 + 1000 * s.i AS ms, CASE s.i WHEN 0 THEN left(content, 2) WHEN 1 THEN left(content, length(content) // 2) "
    "WHEN 2 THEN CASE WHEN seq % 4 = 3 THEN '' ELSE content END ELSE '' END AS content FROM log, range(4) s(i) WHERE role = 'user')"
)


@query(
    "input_cleared_send",
    f"{LOG}, {_SNAPS}, h AS (SELECT *, last_value(CASE WHEN length(content) > 2 OR length(content) = 0 THEN content END IGNORE NULLS) OVER "
    "(PARTITION BY convo_id ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM snaps) "
    "SELECT convo_id, seq::BIGINT AS seq, held AS content FROM h WHERE length(content) = 0 AND length(held) > 2",
)
def input_cleared_send(spark, sf_dir):
    users = plain(spark, sf_dir).where(F.col("role") == "user")
    step = F.posexplode(F.array(
        F.left("content", F.lit(2)), F.left("content", F.floor(F.length("content") / 2).cast("int")),
        F.when(F.col("seq") % 4 == 3, "").otherwise(F.col("content")), F.lit(""),
    )).alias("i", "shown")
    rows = users.select("convo_id", "seq", "ts", step)
    snaps = rows.select(
        "convo_id", (F.col("seq") * 4 + F.col("i")).alias("seq"),
        F.timestamp_millis(F.unix_millis("ts") - 3000 + F.col("i") * 1000).alias("ts"), F.col("shown").alias("content"),
    )
    return ops.input_cleared_sends(snaps).select(*ROW, "content")


@query(
    "duplicate_audit",
    f"{LOG}, d AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY ms, convo_id, seq) AS occurrence, count(*) OVER (PARTITION BY content) AS n FROM log) "
    "SELECT convo_id, seq, occurrence FROM d WHERE n >= 2",
)
def duplicate_audit(spark, sf_dir):
    return ops.duplicate_audit(plain(spark, sf_dir)).select(*ROW, "occurrence")
