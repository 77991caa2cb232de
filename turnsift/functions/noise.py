"""Rules that tell interface noise from conversation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnsift.functions.text import SPACE, contains_any, is_any, matches_any, mentions_any, strip, words

# Fragments of style sheets.
STYLE_PARTS = [
    "@keyframes", "position: fixed", "z-index:", "rgba(", "transform:", "animation:", "box-shadow:",
    "border-radius:", "opacity:", "background:", ".intercom-", "px;", "rem;", "vh;", "vw;", "%;",
]
# Assistant greetings.
GREETINGS = [
    "hi, i'm claude", "hello, i'm claude", "i'm claude", "how can i help you today",
    "what can i help you with today", "how may i assist you today", "hi there! how can i help",
]
# Labels of the interface, as a whole text and anywhere in one.
LABELS = [
    "all chats", "new chat", "retry", "share", "delete", "claude can make mistakes",
    "please double-check responses", "pending context request", "artifacts", "projects", "claude code",
    "starred", "chats projects artifacts", "recents", "test message confirmation share",
    "test message confirmation", "confirmation", "message confirmation",
]
LABEL_PARTS = [
    "chats projects artifacts", "claude can make mistakes", "retry", "confirmation share", "message confirmation",
]
# One-word labels, and parts of titles that the interface makes up.
LABEL_WORDS = ["research", "sonnet", "writing", "method", "analysis", "review", "request"]
TITLE_PARTS = ["research sonnet 4", "j james", "j test"]
BUTTON_ENDINGS = [r"^.*\s+retry\z", r"^.*\s+share\z", r"^test\s+message\s+confirmation"]
# Per-platform label, progress, echo and feedback patterns.
CHATGPT_LABELS = [
    r"(?i)^(copy|regenerate|share|edit|retry)\z", r"(?i)^(thumbs up|thumbs down)\z",
    r"(?i)^(stop generating|continue|show more)\z", r"^\d+/\d+\z", r"(?i)^(new chat|clear chat)\z",
    r"(?i)^(like|dislike)\z", r"(?i)^(read aloud)\z",
]
THINKING = [
    r"(?i)^ChatGPT said:\s*Thinking\s*Skip?\z", r"(?i)^ChatGPT said:\s*Thought for .* Skip?\z",
    r"(?i)^Thinking\s*Skip?\z", r"(?i)^Thought for .* Skip?\z",
]
ECHO_PHRASES = [r"(?i)^You said:", r"(?i)^ChatGPT said:\s*You said:"]
FEEDBACK = [
    r"(?i)response do you prefer\?", r"(?i)which response do you prefer",
    r"(?i)You're giving feedback on a new version", r"(?i)ChatGPT Response \d+",
    r"(?i)Responses may take a moment to load",
]
CLAUDE_LABELS = [
    r"(?i)\w+\s+(retry|share)\z", r"(?i)test message confirmation", r"(?i)message confirmation",
    r"(?i)^(yes|no|retry|share)\z", r"(?i)^Thinking", r"(?i)^Gathering", r"(?i)^ArtifactsArtifacts\z",
    r"(?i)^Artifacts\z",
]
# Texts of action buttons, phrases of a greeting that is kept, class names of content and of the interface.
BUTTON_TOKEN = r"(?i)^(Write|Strategize|Create|Learn|From\s+Drive|Publish|Share|Copy|Edit|Delete)\z"
SONNET_PHRASES = ["how can i help", "what would you like", "feel free to"]
CONTENT_CLASSES = ["markdown", "prose", "text-token-text-primary"]
CHROME_CLASSES = ["header", "nav", "sidebar", "toolbar"]
CHROME_ELEMENTS = ["button", "nav", "header"]
# Words that mark a text as conversation, and class names around conversation.
TALK_WORDS = ["okay", "testmessage", "respond"]
CHAT_CLASSES = ["chat", "message", "conversation"]


def has_sonnet_url(urls: Column) -> Column:
    return F.exists(urls, lambda u: F.lower(u).contains("sonnet"))


def ends_with_button(content: Column) -> Column:
    """The button-ending patterns; the cheap test of the last word comes first."""
    plain = F.lower(strip(content))
    button = plain.rlike(r"\s(retry|share)\z") & matches_any(plain, BUTTON_ENDINGS[:2])
    return button | content.rlike(f"(?iu)^{SPACE}*test\\s+message\\s+confirmation")


def noise_checks(content: Column, urls: Column) -> dict[str, Column]:
    """The content rules in order; the first that holds decides.  ``keep_*`` rules spare the row.

    Each rule reads the raw text with one pattern, so nothing is computed twice when
    Catalyst moves a filter on the rule below the projection.
    """
    greeting = mentions_any(content, GREETINGS)
    chat_url = F.exists(urls, lambda u: u.contains("claude.ai/chat/"))
    return {
        "N1": F.length(content) < 3,
        "N2": contains_any(content, STYLE_PARTS),
        "keep_sonnet": has_sonnet_url(urls) & greeting,
        "N3": greeting,
        "N4": is_any(content, LABELS) | mentions_any(content, LABEL_PARTS),
        "N5": chat_url & (F.size(words(content)) <= 6),
        "N6": is_any(content, LABEL_WORDS),
        "keep_okay": content.rlike(f"(?iu)^{SPACE}*okay\\d+{SPACE}*\\z"),
        "N8": mentions_any(content, TITLE_PARTS),
        "N9": ends_with_button(content),
    }


def noise_rule(content: Column, urls: Column) -> Column:
    """Name of the deciding rule, null if none holds."""
    ladder = None
    for name, check in noise_checks(content, urls).items():
        ladder = F.when(check, name) if ladder is None else ladder.when(check, name)
    return ladder


def is_noise(rule: Column) -> Column:
    return F.coalesce(rule.startswith("N"), F.lit(False))


def chatgpt_ui_noise(text: Column) -> Column:
    return matches_any(text, CHATGPT_LABELS)


def thinking_noise(text: Column) -> Column:
    return matches_any(strip(text), THINKING)


def echo_phrase_noise(text: Column) -> Column:
    return matches_any(strip(text), ECHO_PHRASES)


def feedback_noise(text: Column) -> Column:
    return matches_any(strip(text), FEEDBACK)


def incomplete_placeholder(text: Column) -> Column:
    return strip(text).endswith("ChatGPT said:")


def claude_ui_noise(text: Column) -> Column:
    short_reply = (F.length(text) < 10) & text.rlike(r"(?i)^okay\d+\z")
    return ~short_reply & matches_any(text, CLAUDE_LABELS)


def ui_button_token(text: Column) -> Column:
    return strip(text).rlike(BUTTON_TOKEN)


def sonnet_preserve(text: Column) -> Column:
    return contains_any(F.lower(text), SONNET_PHRASES) | (F.length(text) > 50)


def container_noise(tag: Column, classes: Column, platform: Column) -> Column:
    """Noise by the element a text came from; content containers win on the chatgpt side."""
    content = contains_any(classes, CONTENT_CLASSES) & (platform == "chatgpt")
    chrome = F.lower(tag).isin(CHROME_ELEMENTS) | contains_any(classes, CHROME_CLASSES)
    return F.coalesce(~content & chrome, F.lit(False))


def is_conversation_element(text: Column, role: Column, classes: Column) -> Column:
    shown = strip(text)
    marked = contains_any(shown, TALK_WORDS) | shown.rlike("^[A-Z]")
    in_chat = contains_any(classes, CHAT_CLASSES)
    talk = (F.length(shown) > 10) & marked & in_chat
    return (F.length(shown) >= 3) & (role.isNotNull() | F.coalesce(talk, F.lit(False)))
