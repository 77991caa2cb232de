import pytest

from turnsift.operators.noise import classify_noise, platform_noise, startup_grace

CASES = [
    ("All chats", [], "N4"),
    ("retry", [], "N4"),
    ("share", [], "N4"),
    ("Claude can make mistakes", [], "N4"),
    ("Research Sonnet 4", [], "N8"),
    ("@keyframes intercom-lightweight-app-launcher { from { opacity: 0", [], "N2"),
    ("test message confirmation", [], "N4"),
    ("J James", [], "N8"),
    ("Hello, how can I help you today?", [], "N3"),
    ("Hello, how can I help you today?", ["https://x/sonnet"], "keep_sonnet"),
    ("I understand you're looking for assistance with JavaScript.", [], None),
    ("Here's a simple example of how to use async/await:", [], None),
    ("testmessage 99, respond okay 99", [], None),
    ("okay99", [], "keep_okay"),
    ("okay", [], None),
    ("", [], "N1"),
    (" ", [], "N1"),
    ("\t\t", [], "N1"),
    ("a", [], "N1"),
    ("   ", [], None),
    ("\n\n\n", [], None),
    ("My chat title", ["https://claude.ai/chat/1"], "N5"),
    ("Please Retry", [], "N4"),
    ("I would like to share", [], "N9"),
    ("first line\nplease share", [], None),
    (" Analysis ", [], "N6"),
    ("A" * 5000 + " end", [], None),
    ("Special chars: 🚀 éñçödîñg", [], None),
]


def test_noise_rules(spark):
    df = spark.createDataFrame([(i, c, u) for i, (c, u, _) in enumerate(CASES)], "i int, content string, urls array<string>")
    got = {r.i: (r.noise_rule, r.noise) for r in classify_noise(df).collect()}
    for i, (content, _, rule) in enumerate(CASES):
        assert got[i] == (rule, bool(rule and rule.startswith("N"))), content[:40]


@pytest.mark.parametrize("text,flags", [
    ("Regenerate", {"chatgpt_ui"}), ("3/10", {"chatgpt_ui"}), ("Thought for 5s Skip", {"thinking"}),
    ("You said: hi", {"echo_phrase"}), ("Which response do you prefer?", {"feedback"}),
    ("x\nChatGPT said: ", {"placeholder"}), ("Gathering sources", {"claude_ui"}), ("okay12", set()),
    ("From  Drive", {"button"}), ("Feel free to ask", {"sonnet_keep"}),
])
def test_platform_flags(spark, text, flags):
    row = platform_noise(spark.createDataFrame([(text,)], "content string")).first().asDict()
    assert {name for name, value in row.items() if value is True} == flags


def test_startup_grace(spark, log, mode):
    rows = log([(0, "user", "a"), (9.9, "user", "b"), (10, "user", "c"), (30, "user", "d")])
    assert sorted(r.content for r in startup_grace(rows).collect()) == ["c", "d"]
