import pytest
from pyspark.sql import functions as F

from turnsift.functions import media as md
from turnsift.operators import commands


def parsed(log, text):
    rows = commands.extract_commands(log([(0, "assistant", text)])).orderBy("cmd_pos").collect()
    return [(r.action, dict(r.params), [(s.url, s.start, s.end, s.media_type) for s in r.segments]) for r in rows]


# Published examples of commands and what they mean.
YT = "https://www.youtube.com/watch?v=QohH89Eu5iM"


@pytest.mark.parametrize("text,expected", [
    (f"PLAY: {YT}", [("PLAY", {}, [(YT, 0.0, 0.0, "youtube")])]),
    ("PLAY: httpswwwyoutubecomwatchvQohH89Eu5iM", [("PLAY", {}, [(YT, 0.0, 0.0, "youtube")])]),
    ("PLAY: https://youtube.com/watch?v=abc (30-45s) CAPTION: Notice", [("PLAY", {}, []), ("CAPTION", {"text": "Notice"}, [])]),
    ("PLAY: https://archive.org/download/ElephantsDream/ed_hd.mp4 (1.5-3s)",
     [("PLAY", {}, [("https://archive.org/download/ElephantsDream/ed_hd.mp4", 1.5, 3.0, "video")])]),
    ("VOLUME: 0.5", [("VOLUME", {"volume": "0.5"}, [])]),
    ("VOLUME: 75", []),
    ("SEQUENCE: Jaws.mp4(45-60) -> Aliens.mp4(200-215) -> Jaws.mp4(61-75)",
     [("SEQUENCE", {}, [("Jaws.mp4", 45.0, 60.0, "video"), ("Aliens.mp4", 200.0, 215.0, "video"), ("Jaws.mp4", 61.0, 75.0, "video")])]),
    ("STOP ALL", [("STOP_ALL", {}, [])]),
    ("PAUSE", [("PAUSE", {}, [])]),
    (": https://youtu.be/x1 VOLUME: 0.4", [("PLAY", {}, [("https://youtu.be/x1", 0.0, 0.0, "youtube")]), ("VOLUME", {"volume": "0.4"}, [])]),
    ("an example PLAY: https://youtu.be/x1 for example", []),
])
def test_extract(log, text, expected):
    if text.startswith("an example"):
        # The sample phrase only counts within the command's own text.
        assert parsed(log, text) == []
    else:
        assert parsed(log, text) == expected


@pytest.mark.parametrize("url,repaired", [
    ("httpswwwyoutubecomwatchvQohH89Eu5iM", YT),
    ("httpyoutubecomwatchvABC123", "http://www.youtube.com/watch?v=ABC123"),
    ("httpswwwgithubcomuser/repo", "https://www.githubcomuser/repo"),
    ("completely_broken_not_a_url", "completely_broken_not_a_url"),
    ("httpsgooglecom", "https://googlecom"),
    (YT, YT),
])
def test_repair(spark, url, repaired):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(md.repair_url(F.col("u"))).first()[0] == repaired


@pytest.mark.parametrize("url,score", [(YT, 1.0), ("httpswwwyoutubecomwatchvQ", 0.2), ("completely_broken", 0.0), ("", 0.0), ("http://a.org", 0.9)])
def test_confidence(spark, url, score):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(md.url_confidence(F.col("u"))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize("value,seconds", [("1h2m3s", 3723.0), ("90", 90.0), ("2m", 120.0)])
def test_clock(spark, value, seconds):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(md.youtube_seconds(F.col("v"))).first()[0] == seconds


def test_replay_of_an_address(log, mode):
    rows = log([(0, "assistant", f"PLAY: {YT}"), (2, "assistant", f"PLAY: {YT}"), (2.5, "assistant", f"PLAY: {YT} (1-2s)"),
                (4, "assistant", f"PLAY: {YT}"), (6, "assistant", f"PLAY: {YT}")])
    kept = commands.url_replay_dedup(commands.extract_commands(rows))
    assert {r.seq: r.kept for r in kept.collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_newest_candidate(log):
    rows = log([(0, "assistant", "PAUSE"), (1, "assistant", "STOP"), (2, "user", "PLAY: x"), (3, "assistant", "fine")])
    assert [r.content for r in commands.command_candidates(rows).collect()] == ["STOP"]
