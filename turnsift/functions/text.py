"""Column expressions for message text, links in text and identifiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{00A0}]"

# Keyword sets that mark a media command.
MUSICAL_SETS = {
    "capture": ["PLAY:", "STOP", "VOLUME:"],
    "lab": ["PLAY:", "SEQUENCE:", "VOLUME:", "PAUSE:", "STOP:"],
    "repeat": ["PLAY:", "SEQUENCE:", "VOLUME:", "PAUSE:", "STOP:", "NEXT:", "PREV:"],
}

# Links that lead around the chat site rather than to content.
NAVIGATION_LINKS = [
    r"^https://chatgpt\.com/c/[a-f0-9-]+\z",
    r"^https://chatgpt\.com/(library|gpts|codex)\z",
    r"^https://chatgpt\.com/g/g-[a-zA-Z0-9-]+",
    r"^https://chatgpt\.com/(#main)?\z",
    r"^https://sora\.chatgpt\.com",
]

# Mentions of tool use, common and per platform.
TOOL_MENTIONS = [
    r"(?:used|using|calling)\s+(\w+)\s+tool",
    r"\[Tool:\s*(\w+)\]",
    r"```(\w+)\s*\n",
    r"\*\*Tool Used:\*\*\s*(\w+)",
    r"tool_calls?[\"']?:\s*[\"']?(\w+)",
]
PLATFORM_TOOLS = {
    "claude": ["thinking", "computer_use", "bash", "python", "code_execution"],
    "chatgpt": ["web_search", "dall_e", "code_interpreter", "browser"],
}


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def contains_any(text: Column, parts) -> Column:
    return any_of([text.contains(p) for p in parts])


def matches_any(text: Column, patterns) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def mentions_any(text: Column, parts) -> Column:
    """Contains one of the parts in any case: one pass over the text instead of one per part."""
    return text.rlike("(?iu)" + "|".join(re.escape(p) for p in parts))


def is_any(text: Column, labels) -> Column:
    """Is one of the labels, apart from case and surrounding whitespace."""
    return text.rlike(f"(?iu)^{SPACE}*(?:" + "|".join(re.escape(p) for p in labels) + f"){SPACE}*\\z")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r\u00a0"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def norm_text(text: Column) -> Column:
    """Without zero-width spaces, runs of whitespace as one space, trimmed."""
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), "\u200b", "")
    return F.trim(F.regexp_replace(visible, f"{SPACE}+", " "))


def digest(text: Column) -> Column:
    """Fixed-width stand-in for a text where only equality matters."""
    return F.sha2(text, 256)


def is_nav_url(url: Column) -> Column:
    return matches_any(url, NAVIGATION_LINKS)


def trim_url_end(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,;!?)]+\z", "")


def text_urls(text: Column, keep_navigation: bool = False) -> Column:
    """Distinct links in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s\x{00A0}]+"), F.lit(0))
    urls = F.transform(found, trim_url_end)
    if not keep_navigation:
        urls = F.filter(urls, lambda u: ~is_nav_url(u))
    return F.array_distinct(urls)


def _path_parts(url: Column) -> Column:
    return F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")


def _part_after(parts: Column, marker: str) -> Column:
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.get(parts, at.cast("int")))


def convo_id_from_url(url: Column, platform: Column) -> Column:
    """The conversation named by an address; ``no-convo`` if it cannot be read."""
    parts = _path_parts(url)
    joined = F.when(F.size(parts) == 0, F.lit("/")).otherwise(F.array_join(parts, "/"))
    last = F.try_element_at(parts, F.lit(-1))
    long_last = F.when(F.length(last) > 10, last)
    return F.when(parts.isNull(), F.lit("no-convo")).otherwise(
        F.when(platform == "chatgpt", F.coalesce(_part_after(parts, "c"), joined))
        .when(platform == "claude", F.coalesce(_part_after(parts, "chat"), long_last, joined))
        .otherwise(joined)
    )


def convo_id_lab(url: Column) -> Column:
    parts = _path_parts(url)
    return F.coalesce(_part_after(parts, "chat"), F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))


def platform_from_host(url: Column) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return (
        F.when(host.contains("claude.ai"), "claude")
        .when(contains_any(host, ["chatgpt.com", "chat.openai.com"]), "chatgpt")
        .otherwise("unknown")
    )


def detect_tools(text: Column, platform: Column) -> Column:
    """Distinct tools mentioned, in rule order."""
    named = [F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in TOOL_MENTIONS]
    for name, tools in PLATFORM_TOOLS.items():
        lowered = F.lower(text)
        named += [F.when((platform == name) & lowered.contains(t), F.lit(t)) for t in tools]
    return F.array_distinct(F.array_compact(F.array(*named)))


def message_id(platform: Column, role: Column, ts: Column) -> Column:
    return F.concat_ws("-", platform, role, F.unix_millis(ts).cast("string"))


def message_length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def clean_assistant_prefix(text: Column) -> Column:
    said = F.regexp_replace(text, r"(?i)^ChatGPT said:\s*", "")
    return strip(F.regexp_replace(said, r"(?i)^(ChatGPT|GPT-\d+):\s*", ""))


def model_from_text(text: Column) -> Column:
    return (
        F.when(text.contains("Sonnet 4"), "sonnet-4")
        .when(text.contains("Opus 4.1"), "opus-4.1")
        .when(text.contains("Haiku"), "haiku")
        .otherwise("unknown")
    )


def pipeline_label(model: Column) -> Column:
    return F.when(model.isin("sonnet-4", "opus-4.1"), model).otherwise("generic")


def content_hash(text: Column) -> Column:
    """The 32-bit hash h = 31 h + c over the characters, as a signed number."""
    folded = F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(2**32)),
    )
    return F.when(folded >= 2**31, folded - 2**32).otherwise(folded)


def preview(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def is_musical_command(text: Column, keywords: str) -> Column:
    return contains_any(F.upper(text), MUSICAL_SETS[keywords])


def role_by_patterns(text: Column, form: str) -> Column:
    """The author role that the text alone suggests, in the three published forms."""
    if form == "direct":
        trimmed = strip(text)
        user = trimmed.rlike("^J[A-Z]") | contains_any(trimmed, ["JSEQUENCE:", "JPLAY:", "JVOLUME:"])
        user = user | (trimmed.contains("testmessage") & trimmed.contains("respond"))
        assistant = trimmed.rlike(r"^(seq_ok|play_ok|vol_ok|okay\d+)\z") | trimmed.contains("_ok")
    elif form == "analytics":
        normal = norm_text(text)
        user = (normal.contains("test") & normal.contains("respond")) | normal.rlike("^(PLAY|SEQUENCE):")
        assistant = normal.rlike(r"^okay\d+") | normal.contains("okay_")
    else:
        normal = norm_text(text)
        user = contains_any(normal, ["JSEQUENCE:", "JPLAY:", "testmessage"])
        assistant = normal.rlike(r"(?i)(seq_ok|play_ok|vol_ok|okay\d+)") | normal.contains("_ok")
    return F.when(user, "user").when(assistant, "assistant").otherwise("unknown")
