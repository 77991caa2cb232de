"""Noise rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnsift.functions import noise as rules
from turnsift.operators import noise as ops
from turnsift.registry import expected as ex
from turnsift.registry import query
from turnsift.registry.base import (
    BASELINE, LOG, S, baseline, message_log, sql_any, sql_match, sql_strip,
)


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_PLAIN = f"lower({sql_strip('content')})"
_WORDS = f"len(list_filter(regexp_split_to_array(content, '{S}+'), lambda w: w <> ''))"
_CHAT = "len(list_filter(urls, lambda u: contains(u, 'claude.ai/chat/'))) > 0"
_SONNET = "len(list_filter(urls, lambda u: contains(lower(u), 'sonnet'))) > 0"
CHECKS = {
    "N1": "length(content) < 3",
    "N2": sql_any("content", ex.STYLE_PARTS),
    "keep_sonnet": f"({sql_any(_PLAIN, ex.GREETINGS)} AND {_SONNET})",
    "N3": sql_any(_PLAIN, ex.GREETINGS),
    "N4": f"({_PLAIN} IN ({_quoted(ex.LABELS)}) OR {sql_any(_PLAIN, ex.LABEL_PARTS)})",
    "N5": f"({_CHAT} AND {_WORDS} <= 6)",
    "N6": f"({_WORDS} = 1 AND {_PLAIN} IN ({_quoted(ex.LABEL_WORDS)}))",
    "keep_okay": rf"regexp_matches({_PLAIN}, '^okay\d+\z')",
    "N8": sql_any(_PLAIN, ex.TITLE_PARTS),
    "N9": sql_match(_PLAIN, ex.BUTTON_ENDINGS),
}
_RULE = "CASE " + " ".join(f"WHEN {check} THEN '{name}'" for name, check in CHECKS.items()) + " END"
NOISE = (
    f"ruled AS (SELECT *, {_RULE} AS noise_rule FROM log), "
    "noise AS (SELECT *, coalesce(starts_with(noise_rule, 'N'), false) AS noise FROM ruled)"
)
ROW = ["convo_id", "seq"]


@query("classify_noise", f"{LOG}, {NOISE} SELECT convo_id, seq, noise_rule, noise FROM noise")
def classify_noise(spark, sf_dir):
    return ops.classify_noise(message_log(spark, sf_dir)).select(*ROW, "noise_rule", "noise")


NAMES = {
    "noise_short": "N1", "noise_css": "N2", "noise_greeting": "N3", "noise_ui_label": "N4", "noise_chat_title": "N5",
    "noise_single_word": "N6", "keep_okay_reply": "keep_okay", "noise_title_phrase": "N8", "noise_button_suffix": "N9",
}


def _single(name: str, rule: str) -> None:
    @query(name, f"{LOG} SELECT convo_id, seq, {CHECKS[rule]} AS hit FROM log")
    def run(spark, sf_dir):
        check = rules.noise_checks(F.col("content"), F.col("urls"))[rule]
        return message_log(spark, sf_dir).select(*ROW, check.alias("hit"))


for _name, _rule in NAMES.items():
    _single(_name, _rule)


@query(
    "keep_sonnet_greeting",
    f"{LOG} SELECT convo_id, seq, {CHECKS['keep_sonnet']} AS kept_greeting, starts_with({_PLAIN}, 'testmessage') AS is_test FROM log",
)
def keep_sonnet_greeting(spark, sf_dir):
    check = rules.noise_checks(F.col("content"), F.col("urls"))["keep_sonnet"]
    plain = F.lower(rules.strip(F.col("content")))
    return message_log(spark, sf_dir).select(
        *ROW, check.alias("kept_greeting"), plain.startswith("testmessage").alias("is_test")
    )


_TEXT = sql_strip("content")
_FLAGS = {
    "chatgpt_ui_noise": ("chatgpt_ui", sql_match("content", ex.CHATGPT_LABELS)),
    "thinking_noise": ("thinking", sql_match(_TEXT, ex.THINKING)),
    "echo_phrase_noise": ("echo_phrase", sql_match(_TEXT, ex.ECHO_PHRASES)),
    "feedback_noise": ("feedback", sql_match(_TEXT, ex.FEEDBACK)),
    "incomplete_placeholder": ("placeholder", f"ends_with({_TEXT}, 'ChatGPT said:')"),
    "claude_ui_noise": (
        "claude_ui",
        rf"(NOT (length(content) < 10 AND regexp_matches(content, '(?i)^okay\d+\z')) AND {sql_match('content', ex.CLAUDE_LABELS)})",
    ),
    "ui_button_token": ("button", sql_match(_TEXT, [ex.BUTTON_TOKEN])),
    "sonnet_preserve": ("sonnet_keep", f"({sql_any('lower(content)', ex.SONNET_PHRASES)} OR length(content) > 50)"),
}


def _flag(name: str, column: str, check: str) -> None:
    @query(name, f"{LOG} SELECT convo_id, seq, {check} AS {column} FROM log")
    def run(spark, sf_dir):
        return ops.platform_noise(message_log(spark, sf_dir)).select(*ROW, column)


for _name, (_column, _check) in _FLAGS.items():
    _flag(_name, _column, _check)


# The elements of ``q_sources.diagnostic_lines`` in SQL.
DIAGNOSTIC = (
    "diag AS (SELECT convo_id, seq, platform, ms AS ts_ms, CASE WHEN seq % 3 <> 0 THEN 'raw_transmission' ELSE 'diagnostic' END AS type, "
    "CASE WHEN seq % 2 = 0 THEN 'add' ELSE 'mutation' END AS transmission_type, "
    "(['DIV', 'P', 'BUTTON', 'NAV', 'ARTICLE', 'SPAN'])[seq % 6 + 1] AS tag, "
    "(['markdown prose', 'chat-message', 'sidebar item', 'font-claude-response', 'toolbar', 'conversation-turn'])[(seq % 6 + seq // 64) % 6 + 1] AS classes, "
    "length(content)::BIGINT AS text_length, content, CASE WHEN seq % 4 = 0 THEN role END AS element_role FROM log)"
)
_CONTENT_BOX = f"({sql_any('classes', ex.CONTENT_CLASSES)} AND platform = 'chatgpt')"
_CHROME = f"(lower(tag) IN ('button', 'nav', 'header') OR {sql_any('classes', ex.CHROME_CLASSES)})"


@query("container_noise", f"{LOG}, {DIAGNOSTIC} SELECT convo_id, seq, NOT {_CONTENT_BOX} AND {_CHROME} AS container_noise FROM diag")
def container_noise(spark, sf_dir):
    from turnsift.registry.q_sources import diagnostic_events

    rows = diagnostic_events(spark, sf_dir)
    flag = rules.container_noise(F.col("element.tag"), F.col("element.classes"), F.col("platform"))
    return rows.select(*ROW, flag.alias("container_noise"))


_SHOWN = sql_strip("content")


@query(
    "is_conversation_element",
    f"{LOG}, {DIAGNOSTIC} SELECT convo_id, seq, length({_SHOWN}) >= 3 AND (element_role IS NOT NULL OR (length({_SHOWN}) > 10 "
    f"AND ({sql_any(_SHOWN, ['okay', 'testmessage', 'respond'])} OR regexp_matches({_SHOWN}, '^[A-Z]')) "
    f"AND {sql_any('classes', ['chat', 'message', 'conversation'])})) AS is_conversation FROM diag",
)
def is_conversation_element(spark, sf_dir):
    from turnsift.registry.q_sources import diagnostic_events

    rows = diagnostic_events(spark, sf_dir)
    flag = rules.is_conversation_element(
        F.col("content"), F.col("element_role"), F.col("element.classes")
    )
    return rows.select(*ROW, flag.alias("is_conversation"))


@query(
    "startup_grace",
    f"{LOG}, s AS (SELECT *, first_value(ms) OVER (PARTITION BY convo_id ORDER BY ms, seq) AS t0 FROM log) "
    "SELECT convo_id, seq FROM s WHERE ms - t0 >= 10000",
)
def startup_grace(spark, sf_dir):
    return ops.startup_grace(message_log(spark, sf_dir).select(*ROW, "ts")).select(*ROW)


def _marked(spark, sf_dir):
    """The log with capture-side marks on some rows."""
    none = F.lit(None)
    by = F.when(F.col("seq") % 7 == 0, F.array(F.lit("velocity_bulk_dump")))
    signal = F.when(
        F.col("seq") % 3 == 0,
        F.struct((F.col("seq") % 7 == 0).alias("filtered"), by.alias("filteredBy"),
                 (F.col("seq") % 4 == 0).alias("isGenuineUserInput")),
    )
    metadata = F.struct(
        signal.alias("signalProcessing"),
        F.when(F.col("seq") % 5 == 0, True).otherwise(none).alias("isSignalNoise"),
        F.when(F.col("seq") % 5 == 0, F.array(F.lit("user_input_echo"))).alias("signalProcessingFilter"),
        F.when(F.col("seq") % 2 == 0, "keydown").alias("detectionMethod"),
    )
    return message_log(spark, sf_dir).withColumn("metadata", metadata)


_SIGNAL = "((seq % 3 = 0 AND seq % 7 = 0) OR seq % 5 = 0)"


@query(
    "signal_noise_flag",
    f"{LOG} SELECT convo_id, seq, {_SIGNAL} AS signal_noise, CASE WHEN seq % 3 = 0 AND seq % 7 = 0 THEN 'velocity_bulk_dump' "
    "WHEN seq % 5 = 0 THEN 'user_input_echo' ELSE '' END AS reasons FROM log",
)
def signal_noise_flag(spark, sf_dir):
    flag, reasons = ops.signal_flag()
    return _marked(spark, sf_dir).select(*ROW, flag.alias("signal_noise"), F.array_join(reasons, ",").alias("reasons"))


@query("final_noise", f"{LOG}, {NOISE} SELECT convo_id, seq, noise OR {_SIGNAL} AS final_noise FROM noise")
def final_noise(spark, sf_dir):
    return ops.final_noise(_marked(spark, sf_dir)).select(*ROW, "final_noise")


@query(
    "baseline_exclude",
    f"{LOG}, {BASELINE} SELECT convo_id, seq FROM log WHERE content NOT IN (SELECT content FROM baseline)",
)
def baseline_exclude(spark, sf_dir):
    return ops.baseline_exclude(message_log(spark, sf_dir), baseline(spark, sf_dir)).select(*ROW)
