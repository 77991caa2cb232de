"""The message log that most queries read, derived row by row from ``conversations``.

Every conversation turn becomes a message, and rules on (conv_id, turn) add what a capture
log holds besides: replays after 3, 12 and 400 s, half-written fragments, echoes of user
texts with and without a stray letter, interface labels, media commands, test exchanges
and a burst of old replies.  ``LOG`` is the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift.session import spread

# Label texts put into the log, {c} stands for the conversation number.
LABEL_TEXTS = [
    "All chats", "retry", "share", "Claude can make mistakes", "Research Sonnet 4",
    "@keyframes intercom-lightweight-app-launcher { from { opacity: 0", "test message confirmation", "J James",
    "Hello, how can I help you today?", "okay{c}", "okay", "a", "   ", "My chat title {c}", "Please Retry", "Copy",
    "{c}/10", "Thinking Skip", "Thought for {c}s Skip", "You said: number {c}", "Which response do you prefer?",
    "ChatGPT said:", "Gathering sources", "Feel free to ask", "analysis", "Publish", "I am using search tool now",
    "[Tool: bash] run {c}", "Sonnet 4 ready", "Opus 4.1 ready", "Haiku here", "seq_ok", "ChatGPT said: Thinking Skip",
    "JSEQUENCE: a -> b", "see https://a.org/x{c}. and (https://b.org/y) https://chatgpt.com/c/ab{c}-cd",
    "Yes {c}", "ChatGPT said: fine {c}", "Can you share", "Is the film number {c} on tonight?", "box-shadow: 1px;",
]
# Command texts put into the log.
COMMAND_TEXTS = [
    "PLAY: https://www.youtube.com/watch?v=Qx{c}H9",
    "httpswwwyoutubecomwatchvQx{c}H9",
    "PLAY: httpswwwyoutubecomwatchvQx{c}H9",
    "PLAY: https://youtube.com/watch?v=abc{c} (30-45s) CAPTION: Notice",
    'PLAY: https://archive.org/download/film{c}/ed_hd.mp4 (12.5-20s) CAPTION: "Look here"',
    "VOLUME: 0.5",
    "VOLUME: 75",
    "SEQUENCE: Jaws.mp4(45-60) -> pause(2) -> Aliens{c}.mp4(200-215) -> Jaws.mp3(61-75s)",
    "STOP ALL",
    "PAUSE",
    ": https://youtu.be/x{c} VOLUME: 0.4",
    "https://vimeo.com/{c}",
    "Sure. PLAY: https://youtu.be/z{c}?t=1h2m3s VOLUME: .25",
    "OVERLAY: scene {c} CAPTION: the night",
    "PLAY: httpsuploadwikimediaorgwikipediacommonsa{c}picjpg",
    "response PLAY: http://site.org/track{c}.mp3,10,20",
    "PLAY: https://youtu.be/hot STOP: now",
    "PLAY: see example {c}",
]
START_MS = 1704067200000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def picked(texts: list[str], index: Column, number: Column) -> Column:
    """Text number ``index`` with {c} filled in."""
    options = F.array(*[F.lit(t) for t in texts])
    return F.replace(F.get(options, index.cast("int")), F.lit("{c}"), number.cast("string"))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read(spark, sf_dir, "conversations"))
    c, t, role, x = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    user, assistant = role == "user", role == "assistant"

    def row(kind, offset_ms, who, content) -> Column:
        return F.struct(
            F.lit(kind).cast("bigint").alias("kind"), F.lit(offset_ms).cast("bigint").alias("offset"),
            who.alias("role"), content.alias("content"),
        )

    said = F.lit("assistant")
    replayed = (c * 7 + t) % 3 == 0
    opening = t == 0
    fixed = F.array(
        row(0, 0, role, x),
        F.when(replayed, row(1, 3000, role, x)),
        F.when(replayed, row(2, 12000, role, x)),
        F.when(replayed, row(3, 400000, role, x)),
        F.when(assistant, row(4, -2000, said, F.left(x, F.floor(F.length(x) / 2).cast("int")))),
        F.when(user & (c % 4 == 1), row(5, 1000, said, x)),
        F.when(user & (c % 4 == 3), row(6, 1500, said, F.concat(F.lit("J"), x))),
        F.when(user & (c % 4 == 2), row(7, -1000, F.lit("user"), F.concat(F.lit("J"), x))),
        F.when((c + t) % 2 == 0, row(8, 2500, said, picked(LABEL_TEXTS, (c * 5 + t) % len(LABEL_TEXTS), c))),
        F.when(assistant, row(9, 6000, said, picked(COMMAND_TEXTS, (c + t) % len(COMMAND_TEXTS), c))),
        F.when(opening, row(10, 8000, F.lit("user"), F.concat(F.lit("testmessage"), c, F.lit(", respond okay"), c))),
        F.when(opening, row(11, 9500, said, F.concat(F.lit("okay"), c.cast("string")))),
        F.when(
            opening & (c % 2 == 0),
            row(12, 8200, F.lit("user"), F.concat(F.lit("Jtestmessage"), c, F.lit(", respond okay"), c)),
        ),
        F.when(assistant & (c % 2 == 0) & (t % 4 == 1), row(13, 14000, said, F.concat(F.lit("ChatGPT said: "), x))),
        F.when(assistant & (c % 3 == 1), row(14, 7000, said, picked(COMMAND_TEXTS, (c + t) % len(COMMAND_TEXTS), c))),
    )
    burst = F.when(
        opening & (c % 5 == 0),
        F.transform(
            F.sequence(F.lit(0), F.lit(18)),
            lambda i: row(0, 0, said, F.concat(F.lit("ok"), i.cast("string"), F.lit("_seq")))
            .withField("kind", (i + 20).cast("bigint"))
            .withField("offset", (i * 50 + 10000).cast("bigint")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:bigint,offset:bigint,role:string,content:string>>"))
    variants = F.explode(F.concat(F.array_compact(fixed), burst)).alias("v")
    log = rows.select("conv_id", "turn", variants)
    chat = F.when((F.col("v.kind") == 8) & (c % 2 == 1), F.concat(F.lit("https://claude.ai/chat/"), c))
    sonnet = F.when((F.col("v.kind") == 8) & (c % 3 == 0), F.lit("https://models.org/Sonnet-4"))
    return log.select(
        F.concat(F.lit("conv-"), c.cast("string")).alias("convo_id"),
        (t * 64 + F.col("v.kind")).alias("seq"),
        F.timestamp_millis(F.lit(START_MS) + c * 3_600_000 + t * 20_000 + F.col("v.offset")).alias("ts"),
        F.when(c % 2 == 1, "claude").otherwise("chatgpt").alias("platform"),
        F.col("v.role").alias("role"),
        F.col("v.content").alias("content"),
        F.array_compact(F.array(chat, sonnet)).alias("urls"),
    )


def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def _sql_pick(texts: list[str], index: str) -> str:
    return f"replace(({_sql_list(texts)})[({index}) % {len(texts)} + 1], '{{c}}', conv_id::VARCHAR)"


def _branch(kind: str, offset: str, role: str, content: str, where: str, extra: str = "") -> str:
    return (
        f"SELECT conv_id, turn, {kind} AS kind, {offset} AS off, {role} AS role, {content} AS content "
        f"FROM conversations {extra} WHERE {where}"
    )


_U, _A, _S = "role = 'user'", "role = 'assistant'", "'assistant'"
_REPLAY = "(conv_id * 7 + turn) % 3 = 0"
_TEST = "'testmessage' || conv_id || ', respond okay' || conv_id"
_COMMAND = _sql_pick(COMMAND_TEXTS, "conv_id + turn")
_BRANCHES = [
    _branch("0", "0", "role", "text", "true"),
    _branch("1", "3000", "role", "text", _REPLAY),
    _branch("2", "12000", "role", "text", _REPLAY),
    _branch("3", "400000", "role", "text", _REPLAY),
    _branch("4", "-2000", _S, "left(text, length(text) // 2)", _A),
    _branch("5", "1000", _S, "text", f"{_U} AND conv_id % 4 = 1"),
    _branch("6", "1500", _S, "'J' || text", f"{_U} AND conv_id % 4 = 3"),
    _branch("7", "-1000", "'user'", "'J' || text", f"{_U} AND conv_id % 4 = 2"),
    _branch("8", "2500", _S, _sql_pick(LABEL_TEXTS, "conv_id * 5 + turn"), "(conv_id + turn) % 2 = 0"),
    _branch("9", "6000", _S, _COMMAND, _A),
    _branch("10", "8000", "'user'", _TEST, "turn = 0"),
    _branch("11", "9500", _S, "'okay' || conv_id", "turn = 0"),
    _branch("12", "8200", "'user'", f"'J' || {_TEST}", "turn = 0 AND conv_id % 2 = 0"),
    _branch("13", "14000", _S, "'ChatGPT said: ' || text", f"{_A} AND conv_id % 2 = 0 AND turn % 4 = 1"),
    _branch("14", "7000", _S, _COMMAND, f"{_A} AND conv_id % 3 = 1"),
    _branch("20 + i", "10000 + 50 * i", _S, "'ok' || i || '_seq'", "turn = 0 AND conv_id % 5 = 0", ", range(19) b(i)"),
]
LOG = (
    "WITH RECURSIVE parts AS (" + " UNION ALL ".join(_BRANCHES) + "), log AS (SELECT 'conv-' || conv_id AS convo_id, "
    "(turn * 64 + kind)::BIGINT AS seq, "
    f"({START_MS} + conv_id * 3600000 + turn * 20000 + off)::BIGINT AS ms, "
    "CASE WHEN conv_id % 2 = 1 THEN 'claude' ELSE 'chatgpt' END AS platform, role, content, "
    "list_filter([CASE WHEN kind = 8 AND conv_id % 2 = 1 THEN 'https://claude.ai/chat/' || conv_id END, "
    "CASE WHEN kind = 8 AND conv_id % 3 = 0 THEN 'https://models.org/Sonnet-4' END], lambda u: u IS NOT NULL) AS urls, "
    "conv_id, turn, kind FROM parts)"
)


def kind() -> Column:
    """Which rule added a row of the log."""
    return F.col("seq") % 64


def turn() -> Column:
    return F.floor(F.col("seq") / 64)


def conv_number() -> Column:
    return F.substr(F.col("convo_id"), F.lit(6)).cast("bigint")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were on the page before: the turns of every tenth conversation."""
    return read(spark, sf_dir, "conversations").where("conv_id % 10 = 3").select(F.col("text").alias("content"))


BASELINE = "baseline AS (SELECT DISTINCT text AS content FROM conversations WHERE conv_id % 10 = 3)"
S = r"[\s\x{00A0}]"


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{S}+|{S}+\z', '', 'g')"


def sql_norm(e: str) -> str:
    return f"trim(regexp_replace(replace({e}, chr(8203), ''), '{S}+', ' ', 'g'))"


def sql_any(e: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, '{p.replace(chr(39), chr(39) * 2)}')" for p in parts) + ")"


def sql_match(e: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({e}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"
