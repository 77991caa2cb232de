"""Column expressions for media commands and their addresses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnsift.functions.text import SPACE, contains_any, let, matches_any, strip, words

# Command keywords, media sites, phrases of samples and wrappers, file types.
CUT_KEYWORDS = ["VOLUME:", "PLAY:", "OVERLAY:", "CAPTION:", "PAUSE:", "STOP:", "STOP ALL:", "SEQUENCE:"]
LEAD_KEYWORDS = ["PLAY:", "PAUSE", "STOP", "VOLUME:", "OVERLAY:", "SEQUENCE:"]
MEDIA_SITES = ["youtube.com", "youtu.be", "vimeo.com", "archive.org"]
SAMPLE_PHRASES = [
    "example.mp4", "example.jpg", "cheatsheet", "format guide", "syntax rules", "use normalized values",
    "may be decimal", "chain items with", "file://path", "you said:", "chatgpt said:", "user:", "assistant:",
    "example", "placeholder",
]
WRAPPER_PHRASES = ["said:", "chatgpt", "user", "conversation"]
PLACEHOLDER_URLS = [
    "<url", "file://path", "example.mp4", "example.jpg", "abc", "def", "filename.mp4", "your_file",
]
KNOWN_SITES = ["youtube.com", "youtu.be", "github.com", "archive.org", "vimeo.com"]
MEDIA_ENDINGS = [".mp4", ".webm", ".mkv", ".mov", ".m4v", ".avi", ".mp3", ".wav", ".flac"]
VIDEO = [".mp4", ".webm", ".mkv", ".mov", ".m4v", ".avi"]
AUDIO = [".mp3", ".wav", ".flac", ".m4a", ".ogg"]
IMAGE = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif"]
WHOLE_ENDINGS = [".jpg", ".png", ".gif", ".webp", ".mp4", ".webm"]
# Words that make a long text a command, and texts of empty command templates.
COMMAND_WORDS = ["PLAY:", "SEQUENCE:", "VOLUME:", "PAUSE", "STOP"]
TEMPLATE_WORD, CAPTION_TEMPLATE, OVERLAY_TEMPLATE = "example", "your caption here", "your overlay here"
# Addresses of one media site, and what signs of a working address are worth.
YOUTUBE_ADDRESSES = ["youtube.com/watch", "youtu.be/"]
POINTS = {
    "scheme": 0.4, "http": 0.1, "dot": 0.3, "site": 0.2, "watch?v=": 0.3, "watchv": 0.1, "ending": 0.2, "long": 0.2, "repeated": 0.3,
    "lost punctuation": 0.1, "parseable": 0.2, "valid": 0.3,
}
LONG_ADDRESS = 500
# How the start of an address looks once its punctuation is lost.
LOST_PREFIXES = [
    ("httpswwwyoutubecom", "https://www.youtube.com/"),
    ("httpyoutubecom", "http://youtube.com/"),
    ("wwwyoutubecom", "www.youtube.com/"),
    ("httpswww", "https://www."),
    ("httpwww", "http://www."),
    ("httpsgithubcom", "https://github.com/"),
    ("httpgithubcom", "http://github.com/"),
    ("httpscom", "https://"),
    ("httpcom", "http://"),
]
LOST_DOTS = [
    ("wikimediaorg", "wikimedia.org"),
    ("wikipediacommons", "wikipedia/commons"),
    ("httpstatusdogscom", "httpstatusdogs.com"),
    ("youtubecom", "youtube.com"),
    ("wwwyoutube", "www.youtube"),
]
NUMBER = r"\d+(?:\.\d+)?"


def has_command(content: Column) -> Column:
    """A keyword at the start or after a space, PLAY: anywhere, or an address that lost its keyword."""
    leads = "|".join(k for k in LEAD_KEYWORDS if k != "PLAY:")
    sites = "|".join(re.escape(s) for s in MEDIA_SITES)
    return matches_any(content, [
        f"(?iu)PLAY:|(?:^{SPACE}*| )(?:{leads})",
        rf"(?s)^{SPACE}*: https://.*youtube\.com",
        rf"(?s)^{SPACE}*: http://.*(?:youtube|vimeo|archive)",
        rf"(?s)^{SPACE}*https?://.*(?:{sites})",
    ])


def split_commands(content: Column) -> Column:
    """The command texts of a message; the whole text if it has no keyword."""
    bare = content.rlike("^https?://") & contains_any(content, MEDIA_SITES)
    whole = (
        F.when(content.rlike("^: https?://"), F.concat(F.lit("PLAY"), content))
        .when(bare, F.concat(F.lit("PLAY: "), content))
        .otherwise(content)
    )
    keywords = "|".join(CUT_KEYWORDS)
    parts = F.transform(F.split(whole, f"(?i)(?={keywords})"), strip)
    commands = F.filter(parts, lambda p: p.rlike(f"(?i)^({keywords})"))
    return F.when(F.size(commands) > 0, commands).otherwise(F.array(whole))


def unwrap(text: Column) -> Column:
    bare = F.regexp_replace(strip(text), r"(?i)^response\s*", "")
    bare = F.regexp_replace(bare, r"(?i)^ChatGPT\s*", "")
    return strip(F.regexp_replace(bare, r"^\d+\s*/\s*\d+\s*", ""))


def volume_value(command: Column) -> Column:
    """0..1 after ``VOLUME:``, null otherwise."""
    token = F.regexp_extract(command, r"(?i)^VOLUME:\s*(\S+)", 1)
    number = F.when(token.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), token.try_cast("double"))
    return F.when(number.between(0.0, 1.0), number)


def command_action(command: Column) -> Column:
    """Action of an unwrapped command text, null if it is none."""
    upper, lower = F.upper(command), F.lower(command)
    sample = contains_any(lower, SAMPLE_PHRASES)
    worded = contains_any(upper, COMMAND_WORDS)
    wrapper = (F.length(command) > 50) & ~worded & contains_any(lower, WRAPPER_PHRASES)
    short = F.size(words(command)) <= 2

    def labelled(keyword: str, sample_text: str) -> Column:
        rest = strip(F.substr(lower, F.lit(len(keyword) + 1)))
        return upper.startswith(keyword) & (rest != "") & ~contains_any(rest, [TEMPLATE_WORD, sample_text])

    return (
        F.when(sample | wrapper, F.lit(None).cast("string"))
        .when(upper.startswith("PLAY:"), "PLAY")
        .when(upper.startswith("PAUSE") & short, "PAUSE")
        .when(upper.startswith("STOP ALL"), "STOP_ALL")
        .when(upper.startswith("STOP") & short, "STOP")
        .when(volume_value(command).isNotNull(), "VOLUME")
        .when(labelled("CAPTION:", CAPTION_TEMPLATE), "CAPTION")
        .when(labelled("OVERLAY:", OVERLAY_TEMPLATE), "OVERLAY")
        .when(upper.startswith("SEQUENCE:"), "SEQUENCE")
    )


def clean_url(url: Column) -> Column:
    unquoted = F.regexp_replace(strip(url), r"^[\"']+|[\"']+\z", "")
    unescaped = F.replace(F.replace(unquoted, F.lit('\\"'), F.lit("")), F.lit("\\'"), F.lit(""))
    return F.regexp_replace(unescaped, r"[.,;!?)]+\z", "")


def is_parseable(url: Column) -> Column:
    return url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")


def url_confidence(url: Column) -> Column:
    """How much a text looks like a working address, 0 to 1."""
    lower = F.lower(url)

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    occurrences = (F.length(url) - F.length(F.replace(url, F.lit("http"), F.lit("")))) / 4
    youtube = lower.contains("youtube")
    score = (
        F.when(url.rlike("^https?://"), POINTS["scheme"]).when(url.startswith("http"), POINTS["http"]).otherwise(0.0)
        + points(url.contains("."), POINTS["dot"])
        + points(contains_any(lower, KNOWN_SITES), POINTS["site"])
        + F.when(youtube & url.contains("watch?v="), POINTS["watch?v="]).when(youtube & url.contains("watchv"), POINTS["watchv"]).otherwise(0.0)
        + points(contains_any(lower, MEDIA_ENDINGS), POINTS["ending"])
        - points(F.length(url) > LONG_ADDRESS, POINTS["long"])
        - points(occurrences > 1, POINTS["repeated"])
    )
    score = F.when(lost_punctuation(url), F.greatest(F.lit(POINTS["lost punctuation"]), score)).otherwise(score)
    score = F.round(F.least(F.lit(1.0), score + points(is_parseable(url), POINTS["parseable"])), 2)
    return F.when(url == "", F.lit(0.0)).otherwise(score)


def is_valid_url(url: Column) -> Column:
    return (url != "") & (is_parseable(url) | (url_confidence(url) >= POINTS["valid"]))


def lost_punctuation(url: Column) -> Column:
    return url.contains("http") & ~url.contains("://") & ~url.contains(".")


def _restore_prefix(url: Column) -> Column:
    lower = F.lower(url)
    ladder = None
    for lost, whole in LOST_PREFIXES:
        fixed = F.concat(F.lit(whole), F.substr(url, F.lit(len(lost) + 1)))
        ladder = F.when(lower.startswith(lost), fixed) if ladder is None else ladder.when(lower.startswith(lost), fixed)

    def video(u: Column) -> Column:
        return F.when(u.contains("youtube"), F.replace(u, F.lit("watchv"), F.lit("watch?v="))).otherwise(u)

    return let(ladder.otherwise(url), video)


def _restore_mangled(url: Column) -> Column:
    video = F.regexp_extract(url, "^http(s?)(?:www)?youtubecomwatchv(.*)", 2)
    is_video = url.rlike("^(httpswwwyoutubecomwatchv|httpyoutubecomwatchv)")
    secure = F.when(url.startswith("https"), "https").otherwise("http")
    return F.when(is_video, F.concat(secure, F.lit("://www.youtube.com/watch?v="), video)).otherwise(
        _restore_prefix(url)
    )


def _unless(part: str, change) -> Callable[[Column], Column]:
    return lambda u: F.when(u.contains(part), u).otherwise(change(u))


def _restore_dots(url: Column) -> Column:
    for lost, whole in LOST_DOTS:
        url = F.replace(url, F.lit(lost), F.lit(whole))
    return url


def _restore_ending(url: Column) -> Column:
    tail = F.right(url, F.lit(10))
    dotted = F.when(matches_any(url, [f"\\{e}\\z" for e in WHOLE_ENDINGS]), url)
    for kind in ("jpg", "png", "gif"):
        dotted = dotted.when(tail.contains(kind), F.replace(url, F.lit(kind), F.lit(f".{kind}")))
    return dotted.otherwise(url)


REPAIRS = [
    lambda u: F.when(lost_punctuation(u), _restore_mangled(u)).otherwise(u),
    _unless("://", lambda u: F.regexp_replace(u, "^(https?)", "$1://")),
    _restore_dots,
    _unless(
        "/wikipedia/commons",
        lambda u: F.replace(u, F.lit("wikimedia.orgwikipedia"), F.lit("wikimedia.org/wikipedia")),
    ),
    _unless("/commons/", lambda u: F.regexp_replace(u, "/commons([0-9a])", "/commons/$1")),
    _unless("/img/", lambda u: F.replace(u, F.lit("httpstatusdogs.comimg"), F.lit("httpstatusdogs.com/img/"))),
    _restore_ending,
]


def repair_url(url: Column) -> Column:
    """Undo typical damage to an address that lost punctuation in text extraction."""
    for repair in REPAIRS:
        url = let(url, repair)
    return url


def best_url(url: Column) -> Column:
    """The address to use, repaired if that scores higher; null if none is good enough."""
    scored = F.struct(url.alias("url"), url_confidence(url).alias("score"), repair_url(url).alias("repaired"))

    def choose(s: Column) -> Column:
        better = (s["score"] < 0.6) & (s["repaired"] != s["url"]) & (url_confidence(s["repaired"]) > s["score"])
        return F.when(better, s["repaired"]).otherwise(s["url"])

    def usable(chosen: Column) -> Column:
        good = (chosen != "") & (url_confidence(chosen) >= 0.3) & chosen.rlike("^(http://|https://|file://)")
        return F.when(good, chosen)

    return let(let(scored, choose), usable)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def youtube_seconds(value: Column) -> Column:
    parts = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?"
    pieces = [F.coalesce(_number(value, parts, g), F.lit(0.0)) for g in (1, 2, 3)]
    clock = pieces[0] * 3600 + pieces[1] * 60 + pieces[2]
    return F.when(value.rlike(r"^\d+\z"), value.try_cast("double")).otherwise(clock)


def timing(text: Column) -> Column:
    """(start, end) in seconds: ``(a-b s)``, else ``,a,b``, else the ``t`` of a video address."""
    span = rf"\(({NUMBER})\s*-\s*({NUMBER})\s*s?\)"
    csv = rf",({NUMBER}),({NUMBER})"
    query_t = F.regexp_extract(text, r"[?&]t=([^&#]+)", 1)
    video = F.when(contains_any(text, ["youtube.com", "youtu.be"]) & (query_t != ""), youtube_seconds(query_t))
    spanned, listed = _number(text, span, 1), _number(text, csv, 1)
    start = F.coalesce(spanned, listed, video, F.lit(0.0))
    end = (
        F.when(spanned.isNotNull(), _number(text, span, 2))
        .when(listed.isNotNull(), _number(text, csv, 2))
        .otherwise(F.lit(0.0))
    )
    return F.struct(start.alias("start"), end.alias("end"))


def media_type(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*", ""), "^[a-zA-Z]+://[^/]*", "")
    ending = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))
    return (
        F.when(contains_any(url, YOUTUBE_ADDRESSES), "youtube")
        .when(ending.isin(VIDEO), "video")
        .when(ending.isin(AUDIO), "audio")
        .when(ending.isin(IMAGE), "image")
        .when(url.startswith("file:"), "file")
        .otherwise("web")
    )


def is_placeholder_url(url: Column) -> Column:
    return contains_any(F.lower(url), PLACEHOLDER_URLS)


def caption_of(text: Column) -> Column:
    caption = strip(F.regexp_extract(text, r"(?is)CAPTION:(.*)", 1))
    return F.when(caption.rlike('(?s)^".*"\\z') & (F.length(caption) > 1), F.regexp_replace(caption, '^"|"\\z', "")).otherwise(caption)


def segment(url: Column, times: Column, caption: Column) -> Column:
    return F.struct(
        url.alias("url"),
        times["start"].alias("start"),
        times["end"].alias("end"),
        caption.alias("caption"),
        F.lit(1.0).alias("volume"),
        media_type(url).alias("media_type"),
    )


def play_url(rest: Column) -> Column:
    """Usable address of a PLAY text, null for samples and addresses beyond repair."""
    first = clean_url(F.get(words(rest), 0))
    return let(first, lambda url: F.when(~is_placeholder_url(url), best_url(url)))


def play_segments(rest: Column) -> Column:
    found = F.filter(F.array(play_url(rest)), lambda url: url.isNotNull())
    return F.transform(found, lambda url: segment(url, timing(rest), caption_of(rest)))


def sequence_segments(rest: Column) -> Column:
    items = F.transform(F.split(rest, " -> "), strip)
    items = F.filter(items, lambda i: ~i.startswith("pause(") & i.contains("(") & i.endswith(")"))

    def as_segment(item: Column) -> Column:
        name = strip(F.substring_index(item, "(", 1))
        return segment(name, timing(F.substr(item, F.instr(item, "("))), F.lit(""))

    return F.transform(items, as_segment)


def segment_duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), end - start)
