"""Media commands and address repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.functions import media as md
from turnsift.operators import commands as ops
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import LOG, S, read, sql_any, sql_match, sql_strip
from turnsift.registry.q_dedup import greedy_sql, plain

ROW = ["convo_id", "seq"]
_T = sql_strip("content")
_UP = f"upper({_T})"
_LEADS = " OR ".join(f"starts_with({_UP}, '{k}') OR contains({_UP}, ' {k}')" for k in ex.LEAD_KEYWORDS)
_BARE = f"(regexp_matches(x, '^https?://') AND {sql_any('x', ex.MEDIA_SITES)})"
HAS_COMMAND = (
    f"({_LEADS} OR contains({_UP}, 'PLAY:') OR (starts_with({_T}, ': https://') AND contains({_T}, 'youtube.com')) OR "
    f"(starts_with({_T}, ': http://') AND {sql_any(_T, ['youtube', 'vimeo', 'archive'])}) OR "
    f"(regexp_matches({_T}, '^https?://') AND {sql_any(_T, ex.MEDIA_SITES)}))"
)
_KEYS = "|".join(ex.CUT_KEYWORDS)
SPLIT = (
    f"c0 AS (SELECT convo_id, seq, ms, {_T} AS x FROM log WHERE role = 'assistant' AND {HAS_COMMAND}), "
    f"c1 AS (SELECT *, CASE WHEN regexp_matches(x, '^: https?://') THEN 'PLAY' || x WHEN {_BARE} THEN 'PLAY: ' || x ELSE x END AS w FROM c0), "
    f"c2 AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(w, '(?i)({_KEYS})', chr(1) || '\\1', 'g'), chr(1)), "
    f"lambda p: {sql_strip('p')}), lambda p: regexp_matches(p, '(?i)^({_KEYS})')) AS ps FROM c1), "
    "c3 AS (SELECT convo_id, seq, ms, CASE WHEN len(ps) > 0 THEN ps ELSE [w] END AS ps FROM c2), "
    "split AS (SELECT convo_id, seq, ms, generate_subscripts(ps, 1) - 1 AS cmd_pos, unnest(ps) AS command_text FROM c3)"
)


@query(
    "command_candidates",
    f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY ms DESC, seq DESC) AS n FROM log), "
    f"p AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY n) AS pick FROM r WHERE n <= 20 AND role = 'assistant' AND {HAS_COMMAND}) "
    "SELECT convo_id, seq, content FROM p WHERE pick = 1",
)
def command_candidates(spark, sf_dir):
    return ops.command_candidates(plain(spark, sf_dir)).select(*ROW, "content")


@query("has_command", f"{LOG} SELECT convo_id, seq, {HAS_COMMAND} AS has_command FROM log")
def has_command(spark, sf_dir):
    return plain(spark, sf_dir).select(*ROW, md.has_command(F.col("content")).alias("has_command"))


@query("split_commands", f"{LOG}, {SPLIT} SELECT convo_id, seq, cmd_pos, command_text FROM split")
def split_commands(spark, sf_dir):
    rows = ops.split_command_rows(plain(spark, sf_dir))
    return rows.select(*ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), "command_text")


def _unwrap(e: str) -> str:
    a = rf"regexp_replace({sql_strip(e)}, '(?i)^response\s*', '')"
    b = rf"regexp_replace({a}, '(?i)^ChatGPT\s*', '')"
    return sql_strip(rf"regexp_replace({b}, '^\d+\s*/\s*\d+\s*', '')")


_TOKEN = r"regexp_extract(cmd, '(?i)^VOLUME:\s*(\S+)', 1)"
_VALUE = rf"CASE WHEN regexp_matches({_TOKEN}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z') THEN try_cast({_TOKEN} AS DOUBLE) END"
_SHORT = f"len(list_filter(regexp_split_to_array(cmd, '{S}+'), lambda w: w <> '')) <= 2"


def _labelled(keyword: str, sample: str) -> str:
    rest = sql_strip(f"substr(lower(cmd), {len(keyword) + 1})")
    return f"(starts_with(upper(cmd), '{keyword}') AND {rest} <> '' AND NOT {sql_any(rest, ['example', sample])})"


_SKIP = (
    f"({sql_any('lower(cmd)', ex.SAMPLE_PHRASES)} OR (length(cmd) > 50 AND NOT {sql_any('upper(cmd)', ['PLAY:', 'SEQUENCE:', 'VOLUME:', 'PAUSE', 'STOP'])} "
    f"AND {sql_any('lower(cmd)', ex.WRAPPER_PHRASES)}))"
)
COMMANDS = (
    f"{SPLIT}, k0 AS (SELECT convo_id, seq, ms, cmd_pos, {_unwrap('command_text')} AS cmd FROM split), "
    f"k1 AS (SELECT *, {_VALUE} AS number FROM k0), "
    "k2 AS (SELECT *, CASE WHEN number BETWEEN 0 AND 1 THEN number END AS volume FROM k1), "
    f"k3 AS (SELECT *, CASE WHEN {_SKIP} THEN NULL WHEN starts_with(upper(cmd), 'PLAY:') THEN 'PLAY' WHEN starts_with(upper(cmd), 'PAUSE') AND {_SHORT} THEN 'PAUSE' "
    f"WHEN starts_with(upper(cmd), 'STOP ALL') THEN 'STOP_ALL' WHEN starts_with(upper(cmd), 'STOP') AND {_SHORT} THEN 'STOP' WHEN volume IS NOT NULL THEN 'VOLUME' "
    f"WHEN {_labelled('CAPTION:', 'your caption here')} THEN 'CAPTION' WHEN {_labelled('OVERLAY:', 'your overlay here')} THEN 'OVERLAY' "
    "WHEN starts_with(upper(cmd), 'SEQUENCE:') THEN 'SEQUENCE' END AS action FROM k2), "
    "cmds AS (SELECT * FROM k3 WHERE action IS NOT NULL)"
)


@query(
    "parse_command",
    f"{LOG}, {COMMANDS} SELECT convo_id, seq, cmd_pos, action, CASE WHEN action IN ('CAPTION', 'OVERLAY') THEN {sql_strip('substr(cmd, 9)')} END AS label FROM cmds",
)
def parse_command(spark, sf_dir):
    rows = ops.extract_commands(plain(spark, sf_dir))
    return rows.select(*ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), "action", F.col("params")["text"].alias("label"))


@query("parse_volume", f"{LOG}, {COMMANDS} SELECT convo_id, seq, cmd_pos, volume FROM k2 WHERE starts_with(upper(cmd), 'VOLUME:')")
def parse_volume(spark, sf_dir):
    rows = ops.split_command_rows(plain(spark, sf_dir)).withColumn("cmd", md.unwrap(F.col("command_text")))
    rows = rows.where(F.upper("cmd").startswith("VOLUME:"))
    return rows.select(*ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), md.volume_value(F.col("cmd")).alias("volume"))


def _clean(e: str) -> str:
    a = f"regexp_replace({sql_strip(e)}, '^[\"'']+|[\"'']+\\z', '', 'g')"
    b = f"replace(replace({a}, '\\\"', ''), '\\''', '')"
    return f"regexp_replace({b}, '[.,;!?)]+\\z', '')"


def _parse(u: str) -> str:
    return f"regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')"


def _lost(u: str) -> str:
    return f"(contains({u}, 'http') AND NOT contains({u}, '://') AND NOT contains({u}, '.'))"


def _score(u: str) -> str:
    low = f"lower({u})"
    points = (
        f"(CASE WHEN regexp_matches({u}, '^https?://') THEN 0.4::DOUBLE WHEN starts_with({u}, 'http') THEN 0.1 ELSE 0 END "
        f"+ CASE WHEN contains({u}, '.') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {sql_any(low, ex.KNOWN_SITES)} THEN 0.2::DOUBLE ELSE 0 END "
        f"+ CASE WHEN contains({low}, 'youtube') AND contains({u}, 'watch?v=') THEN 0.3::DOUBLE WHEN contains({low}, 'youtube') AND contains({u}, 'watchv') THEN 0.1 ELSE 0 END "
        f"+ CASE WHEN {sql_any(low, ex.MEDIA_ENDINGS)} THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN length({u}) > 500 THEN 0.2::DOUBLE ELSE 0 END "
        f"- CASE WHEN length({u}) - length(replace({u}, 'http', '')) > 4 THEN 0.3::DOUBLE ELSE 0 END)"
    )
    floored = f"CASE WHEN {_lost(u)} THEN greatest(0.1::DOUBLE, {points}) ELSE {points} END"
    return f"CASE WHEN {u} = '' THEN 0::DOUBLE ELSE round(least(1::DOUBLE, {floored} + CASE WHEN {_parse(u)} THEN 0.2::DOUBLE ELSE 0 END), 2) END"


def _ext(u: str) -> str:
    path = f"regexp_replace(regexp_replace({u}, '[?#].*', ''), '^[a-zA-Z]+://[^/]*', '')"
    return f"lower(regexp_extract({path}, '[^/](\\.[^./]+)\\z', 1))"


def _media(u: str) -> str:
    def among(kinds):
        return f"{_ext(u)} IN ({', '.join(repr(k) for k in kinds)})"

    return (
        f"CASE WHEN {sql_any(u, ['youtube.com/watch', 'youtu.be/'])} THEN 'youtube' WHEN {among(ex.VIDEO)} THEN 'video' WHEN {among(ex.AUDIO)} THEN 'audio' "
        f"WHEN {among(ex.IMAGE)} THEN 'image' WHEN starts_with({u}, 'file:') THEN 'file' WHEN {u} IS NOT NULL THEN 'web' ELSE 'web' END"
    )


def repair_ctes(source: str, url: str, out: str) -> str:
    """CTE ``out``: ``source`` with ``url`` scored, repaired (``repaired``) and chosen (``best``)."""
    prefix = "CASE " + " ".join(f"WHEN starts_with(lower(u), '{a}') THEN '{b}' || substr(u, {len(a) + 1})" for a, b in ex.LOST_PREFIXES) + " ELSE u END"
    dots = "r2"
    for a, b in ex.LOST_DOTS:
        dots = f"replace({dots}, '{a}', '{b}')"
    endings = sql_match("r7", [f"\\{e}\\z" for e in ex.WHOLE_ENDINGS])
    dotted = "CASE WHEN " + endings + " THEN r7 " + " ".join(f"WHEN contains(right(r7, 10), '{k}') THEN replace(r7, '{k}', '.{k}')" for k in ("jpg", "png", "gif")) + " ELSE r7 END"
    o = out
    return (
        f"{o}0 AS (SELECT *, {url} AS u FROM {source}), "
        f"{o}1 AS (SELECT *, {prefix} AS pre FROM {o}0), "
        f"{o}2 AS (SELECT *, CASE WHEN NOT {_lost('u')} THEN u WHEN regexp_matches(u, '^httpswwwyoutubecomwatchv') THEN 'https://www.youtube.com/watch?v=' || substr(u, 25) "
        f"WHEN regexp_matches(u, '^httpyoutubecomwatchv') THEN 'http://www.youtube.com/watch?v=' || substr(u, 21) "
        f"WHEN contains(pre, 'youtube') THEN replace(pre, 'watchv', 'watch?v=') ELSE pre END AS r1 FROM {o}1), "
        f"{o}3 AS (SELECT *, CASE WHEN starts_with(r1, 'http') AND NOT contains(r1, '://') THEN regexp_replace(r1, '^(https?)', '\\1://') ELSE r1 END AS r2 FROM {o}2), "
        f"{o}4 AS (SELECT *, {dots} AS r3 FROM {o}3), "
        f"{o}5 AS (SELECT *, CASE WHEN NOT contains(r3, '/wikipedia/commons') THEN replace(r3, 'wikimedia.orgwikipedia', 'wikimedia.org/wikipedia') ELSE r3 END AS r4 FROM {o}4), "
        f"{o}6 AS (SELECT *, CASE WHEN NOT contains(r4, '/commons/') THEN regexp_replace(r4, '/commons([0-9a])', '/commons/\\1', 'g') ELSE r4 END AS r5 FROM {o}5), "
        f"{o}7 AS (SELECT *, CASE WHEN NOT contains(r5, '/img/') THEN replace(r5, 'httpstatusdogs.comimg', 'httpstatusdogs.com/img/') ELSE r5 END AS r7 FROM {o}6), "
        f"{o}8 AS (SELECT *, {dotted} AS repaired FROM {o}7), "
        f"{o}9 AS (SELECT *, {_score('u')} AS confidence, {_score('repaired')} AS repaired_confidence FROM {o}8), "
        f"{o}a AS (SELECT *, CASE WHEN confidence < 0.6 AND repaired <> u AND repaired_confidence > confidence THEN repaired ELSE u END AS chosen FROM {o}9), "
        f"{o} AS (SELECT *, CASE WHEN chosen <> '' AND {_score('chosen')} >= 0.3 AND regexp_matches(chosen, '^(http://|https://|file://)') THEN chosen END AS best FROM {o}a)"
    )


# Addresses with typical damage, derived from the pages table.
_URLS = (
    "raw AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '[:/.?=#&-]', '', 'g') "
    "WHEN 2 THEN 'httpswwwyoutubecomwatchvQo' || page_id WHEN 3 THEN 'httpswwwgithubcomuser/repo' || page_id WHEN 4 THEN 'PLAY httpswwwyoutubecomwatchvQ' || page_id "
    "WHEN 5 THEN 'completely_broken_' || page_id WHEN 6 THEN ' \"' || url || '/clip.mp4\").' WHEN 7 THEN 'https://uploadwikimediaorgwikipediacommons4' || page_id || 'jpg' "
    "WHEN 8 THEN 'httpyoutubecomwatchvK' || page_id ELSE 'http://httpstatusdogscomimg' || page_id || 'png' END AS url FROM pages)"
)


def damaged_urls(spark, sf_dir):
    p, url = F.col("page_id"), F.col("url")
    n = p.cast("string")
    forms = [
        url, F.regexp_replace(url, "[:/.?=#&-]", ""), F.concat(F.lit("httpswwwyoutubecomwatchvQo"), n),
        F.concat(F.lit("httpswwwgithubcomuser/repo"), n), F.concat(F.lit("PLAY httpswwwyoutubecomwatchvQ"), n),
        F.concat(F.lit("completely_broken_"), n), F.concat(F.lit(' "'), url, F.lit('/clip.mp4").')),
        F.concat(F.lit("https://uploadwikimediaorgwikipediacommons4"), n, F.lit("jpg")),
        F.concat(F.lit("httpyoutubecomwatchvK"), n), F.concat(F.lit("http://httpstatusdogscomimg"), n, F.lit("png")),
    ]
    return read(spark, sf_dir, "pages").select("page_id", F.get(F.array(*forms), (p % 10).cast("int")).alias("url"))


_REPAIRED = f"WITH {_URLS}, {repair_ctes('raw', 'url', 'fixed')}"


def _url_query(name: str, column: str, sql: str, source: str = "fixed") -> None:
    @query(name, f"{_REPAIRED} SELECT page_id, {sql} AS {column} FROM {source}")
    def run(spark, sf_dir):
        return ops.repair_urls(damaged_urls(spark, sf_dir)).select("page_id", column)


_url_query("clean_url", "clean", _clean("url"))
_url_query("url_confidence", "confidence", "confidence")
_url_query("url_valid", "valid", f"url <> '' AND ({_parse('url')} OR confidence >= 0.3)")
_url_query("repair_url", "repaired", "repaired")
_url_query("best_url", "best", "best")
_url_query("media_type", "media_type", _media("url"))

_FINAL = _unwrap("'PLAY: ' || url")


@query(
    "url_repair_audit",
    f"WITH {_URLS}, {repair_ctes('raw', 'url', 'fixed')}, firsts AS (SELECT page_id, {_clean('list_filter(regexp_split_to_array(url, ' + chr(39) + S + '+' + chr(39) + '), lambda w: w <> ' + chr(39) * 2 + ')[1]')} AS first FROM raw), "
    f"{repair_ctes('firsts', 'first', 'final')} SELECT page_id, fixed.confidence, fixed.repaired, fixed.repaired_confidence, "
    f"CASE WHEN NOT {sql_any('lower(' + _FINAL.replace('url', 'fixed.url') + ')', ex.SAMPLE_PHRASES)} AND NOT {sql_any('lower(first)', ex.PLACEHOLDER_URLS)} THEN final.best END AS final_url "
    "FROM fixed JOIN final USING (page_id)",
)
def url_repair_audit(spark, sf_dir):
    rows = ops.url_repair_audit(damaged_urls(spark, sf_dir))
    return rows.select("page_id", "confidence", "repaired", "repaired_confidence", "final_url")


_NUM = ex.NUMBER
_SPAN = rf"\(({_NUM})\s*-\s*({_NUM})\s*s?\)"
_CLOCK = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?"
_CSV = rf",({_NUM}),({_NUM})"


def _num(e: str, pattern: str, group: int) -> str:
    return f"try_cast(nullif(regexp_extract({e}, '{pattern}', {group}), '') AS DOUBLE)"


def _start(e: str) -> str:
    t = f"regexp_extract({e}, '[?&]t=([^&#]+)', 1)"
    clock = " + ".join(
        f"coalesce({_num(t, _CLOCK, g)}, 0) * {f}" for g, f in ((1, 3600), (2, 60), (3, 1))
    )
    video = rf"CASE WHEN {sql_any(e, ['youtube.com', 'youtu.be'])} AND {t} <> '' THEN CASE WHEN regexp_matches({t}, '^\d+\z') THEN try_cast({t} AS DOUBLE) ELSE {clock} END END"
    return f"coalesce({_num(e, _SPAN, 1)}, {_num(e, _CSV, 1)}, {video}, 0::DOUBLE)"


def _end(e: str) -> str:
    return f"CASE WHEN {_num(e, _SPAN, 1)} IS NOT NULL THEN {_num(e, _SPAN, 2)} WHEN {_num(e, _CSV, 1)} IS NOT NULL THEN {_num(e, _CSV, 2)} ELSE 0::DOUBLE END"


_FIRST = f"list_filter(regexp_split_to_array(rest, '{S}+'), lambda w: w <> '')[1]"
_PLAY = (
    f"p0 AS (SELECT *, {sql_strip('substr(cmd, 6)')} AS rest FROM cmds WHERE action = 'PLAY'), p1 AS (SELECT *, {_clean(_FIRST)} AS first FROM p0), "
    + repair_ctes("p1", "first", "pu")
    + f", plays AS (SELECT * FROM pu WHERE best IS NOT NULL AND NOT {sql_any('lower(first)', ex.PLACEHOLDER_URLS)})"
)


@query(
    "parse_play",
    f"{LOG}, {COMMANDS}, {_PLAY} SELECT convo_id, seq, cmd_pos, best AS url, {_start('rest')} AS start_s, {_end('rest')} AS end_s, {_media('best')} AS media_type FROM plays",
)
def parse_play(spark, sf_dir):
    rows = ops.command_segments(ops.extract_commands(plain(spark, sf_dir))).where("action = 'PLAY'")
    return rows.select(
        *ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), "url", F.col("start").alias("start_s"),
        F.col("end").alias("end_s"), "media_type",
    )


_SEQ = (
    f"q0 AS (SELECT *, {sql_strip('substr(cmd, 10)')} AS rest FROM cmds WHERE action = 'SEQUENCE'), "
    f"q1 AS (SELECT *, list_filter(list_transform(string_split(rest, ' -> '), lambda i: {sql_strip('i')}), lambda i: NOT starts_with(i, 'pause(') AND contains(i, '(') AND ends_with(i, ')')) AS items FROM q0), "
    "q2 AS (SELECT convo_id, seq, cmd_pos, generate_subscripts(items, 1) - 1 AS segment_pos, unnest(items) AS item FROM q1), "
    f"seqs AS (SELECT *, {sql_strip('string_split(item, ' + chr(39) + '(' + chr(39) + ')[1]')} AS url, substr(item, instr(item, '(')) AS span FROM q2)"
)


@query(
    "parse_sequence",
    f"{LOG}, {COMMANDS}, {_SEQ} SELECT convo_id, seq, cmd_pos, segment_pos, url, {_start('span')} AS start_s, {_end('span')} AS end_s, {_media('url')} AS media_type FROM seqs",
)
def parse_sequence(spark, sf_dir):
    rows = ops.command_segments(ops.extract_commands(plain(spark, sf_dir))).where("action = 'SEQUENCE'")
    return rows.select(
        *ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), F.col("segment_pos").cast("bigint").alias("segment_pos"),
        "url", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "media_type",
    )


@query("segment_duration", f"{LOG}, {COMMANDS}, {_SEQ} SELECT convo_id, seq, segment_pos, greatest(0::DOUBLE, {_end('span')} - {_start('span')}) AS duration FROM seqs")
def segment_duration(spark, sf_dir):
    rows = ops.command_segments(ops.extract_commands(plain(spark, sf_dir))).where("action = 'SEQUENCE'")
    return rows.select(*ROW, F.col("segment_pos").cast("bigint").alias("segment_pos"), "duration")


@query("extract_timing", f"{LOG} SELECT convo_id, seq, {_start('content')} AS start_s, {_end('content')} AS end_s FROM log WHERE role = 'assistant'")
def extract_timing(spark, sf_dir):
    times = md.timing(F.col("content"))
    rows = plain(spark, sf_dir).where(F.col("role") == "assistant")
    return rows.select(*ROW, times["start"].alias("start_s"), times["end"].alias("end_s"))


_BEARING = f"b0 AS (SELECT convo_id, seq, ms, {_T} AS t FROM log WHERE role = 'assistant' AND {HAS_COMMAND})"


@query("command_dedup", f"{LOG}, {_BEARING}, " + greedy_sql("b0", "t", "3000", ">=") + " SELECT convo_id, seq, kept FROM greedy")
def command_dedup(spark, sf_dir):
    return ops.command_dedup(plain(spark, sf_dir)).select(*ROW, "kept")


_TIMED = f"timed AS (SELECT convo_id, seq, cmd_pos, ms, {_clean('best')} AS address, {_start('rest')} > 0 OR {_end('rest')} > 0 AS timed FROM plays)"


@query(
    "url_replay_dedup",
    f"{LOG}, {COMMANDS}, {_PLAY}, {_TIMED}, "
    + greedy_sql("timed", "address", "3000", ">=", "r.timed").replace("ms, convo_id, seq)", "ms, convo_id, seq, cmd_pos)").replace(
        "SELECT k, rn, convo_id, seq, ms AS last", "SELECT k, rn, convo_id, seq, cmd_pos, ms AS last").replace(
        "r.convo_id, r.seq, CASE", "r.convo_id, r.seq, r.cmd_pos, CASE")
    + " SELECT convo_id, seq, cmd_pos, kept FROM greedy",
)
def url_replay_dedup(spark, sf_dir):
    rows = ops.url_replay_dedup(ops.extract_commands(plain(spark, sf_dir)))
    return rows.select(*ROW, F.col("cmd_pos").cast("bigint").alias("cmd_pos"), "kept")


@query(
    "play_url_findall",
    f"{LOG}, f AS (SELECT convo_id, seq, regexp_extract_all(content, 'PLAY:\\s*(https?://[^\\s\\x{{00A0}}]+)', 1) AS urls FROM log WHERE role = 'assistant') "
    "SELECT convo_id, seq, generate_subscripts(urls, 1) - 1 AS pos, unnest(urls) AS url FROM f",
)
def play_url_findall(spark, sf_dir):
    return ops.play_url_findall(plain(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))
