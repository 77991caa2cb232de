import json

from pyspark.sql import functions as F

from turnsift.functions import text as tx
from turnsift.operators.noise import signal_flag
from turnsift.sources import messages, sinks


def test_report_file(spark, tmp_path):
    line = {"ts": "2025-09-13T20:03:44", "platform": "claude", "role": "user", "content": "hello"}
    report = {"timestamp": "x", "success": False, "server_healthy": True, "log_counts": {"chat": 2, "verbose": 1, "recent": 0},
              "logs": {"chat": [json.dumps(line), json.dumps(line)], "verbose": [json.dumps(line)], "recent": []}, "test_results": []}
    (tmp_path / "report.json").write_text(json.dumps(report, indent=2))
    rows = messages.report_messages(messages.read_test_report(spark, str(tmp_path))).collect()
    assert sorted(r.log for r in rows) == ["chat", "chat", "verbose"]
    assert {r.content for r in rows} == {"hello"}


def test_malformed_lines(spark):
    lines = ['{"role": "user", "content": "a"}', "{broken", "", "  ", '{"role": "assistant"}']
    good, bad = messages.tolerant_split(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["{broken"]


def test_old_lines_and_missing_marks(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"ts": "2024-01-01T12:00:00", "role": "user", "content": "x", "urls": []}\n')
    rows = messages.read_message_log(spark, str(tmp_path))
    flag, reasons = signal_flag()
    row = rows.select("platform", flag.alias("noise"), reasons.alias("reasons")).first()
    assert (row.platform, row.noise, row.reasons) == ("unknown", False, [])


def test_query_string(spark):
    urls = ["http://h/log?text=hi%20there+you&role=assistant&platform=chatgpt", "http://h/log?role=user", "http://h/log?text=a%26b"]
    rows = messages.ingest_query_string(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r.platform, r.role, r.content) for r in rows] == [("chatgpt", "assistant", "hi there you"), ("claude", "user", "a&b")]


def test_links_and_hosts(spark):
    df = spark.createDataFrame([("see https://a.org/x. and (https://b.org/y) https://chatgpt.com/c/ab12-cd https://a.org/x",)], "t string")
    assert df.select(tx.text_urls(F.col("t"))).first()[0] == ["https://a.org/x", "https://b.org/y"]
    hosts = ["https://claude.ai/x", "https://chatgpt.com", "https://chat.openai.com/c", "https://other.net", "no url at all"]
    df = spark.createDataFrame([(h,) for h in hosts], "u string")
    got = [r[0] for r in df.select(tx.platform_from_host(F.col("u"))).collect()]
    assert got == ["claude", "chatgpt", "chatgpt", "unknown", "unknown"]


def test_retention(log):
    rows = log([(i, "user", str(i)) for i in range(10)])
    kept = sinks.rolling_retention(rows, ["platform"], [F.desc("ts"), F.desc("seq")], 2)
    assert sorted(r.content for r in kept.collect()) == ["8", "9"]


def test_nested_and_hidden_page_parts():
    from turnsift.sources import pages

    page = """<html><head><title>t</title><style>p{}</style></head><body><nav>a<nav>b</nav>c</nav>
    <div>one <button>Send</button><span role="button">x<b>y</b></span><span class="icon">i</span><p style="display: none">gone</p>
    <div class="toolbar"><p>tools</p></div><i data-testid="message-actions"><u>act</u></i><p>Copy</p><p>two &amp; <br>three</p>
    <div style="visibility:hidden"><p>dark</p><p style="visibility:visible">light</p></div><a aria-label="a button">z</a>
    <script>if (a < b) { "</p>" }</script><div class="my-controls"><div>k</div></div>four</div></body></html>"""
    assert pages.shown_text(page).split() == ["one", "two", "&", "three", "light", "four"]


def test_artifacts_are_whole(spark):
    from turnsift.sources import pages

    page = """<div class="artifact-container" data-language="py">first <div>inner <div>deep</div></div> last words</div>
    <section data-testid="the-artifact-1"><pre class="code-block">print("hello, world")</pre></section><p class="artifact">short</p>"""
    rows = pages.page_artifacts(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")).collect()
    assert [(r.page_id, r.selector, " ".join(r.content.split()), r.language) for r in rows] == [
        (1, '[data-testid*="artifact"]', 'print("hello, world")', "unknown"),
        (1, ".artifact-container", "first inner deep last words", "py"),
        (1, '[class*="artifact"]', "first inner deep last words", "py"),
        (1, ".code-block", 'print("hello, world")', "unknown"),
    ]


def test_links_of_any_markup(spark):
    from turnsift.sources import pages

    page = """<a href='http://x.org/one'>1</a><a href=http://x.org/two>2</a><A HREF="http://x.org/?a=1&amp;b=2">3</A>
    <a data-href="http://x.org/no">4</a><script>var u="http://x.org/script"</script><!-- <a href="http://x.org/comment"> -->
    <base href="/sub/"><base href="/later/"><a href="rel?x">r</a><a href=" up/../here ">h</a><a name=x>n</a><a href="mailto:a@b">m</a>
    see http://y.org/z. (http://y.org/q) <p style="display:none">http://y.org/gone <b>http://y.org/inside</b></p>http://y.org/<b>bold</b>"""
    df = spark.createDataFrame([(1, "https://h.org/dir/page", page), (2, "u", None), (3, None, '<a href="http://z.org/">')], "page_id int, url string, html string")
    got = pages.page_links(df).orderBy("page_id", "pos").collect()
    assert [r.link for r in got if r.page_id == 1] == [
        "http://x.org/one", "http://x.org/two", "http://x.org/?a=1&b=2", "https://h.org/sub/rel?x", "https://h.org/sub/here",
        "http://y.org/z", "http://y.org/q", "http://y.org/bold",
    ]
    assert [r.link for r in got if r.page_id != 1] == ["http://z.org/"]


def test_one_run_gives_all_parts(spark):
    from turnsift.sources import pages

    page = '<div class="artifact">some <b>long</b> artifact</div><a href="/x">Copy</a><p>text http://a.org/b</p>'
    df = spark.createDataFrame([(1, "http://h.org/", page), (2, None, None), (3, "", "")], "page_id int, url string, html string")
    one, two, three = pages.page_contents(df).orderBy("page_id").collect()
    assert one.page_text == "some long artifacttext http://a.org/b" and one.links == ["http://h.org/x", "http://a.org/b"]
    assert [(a.selector, a.content) for a in one.artifacts] == [('[class*="artifact"]', "some long artifact")]
    alone = {r.page_id: r.page_text for r in pages.page_text(df).collect()}
    assert (two.page_text, two.links, two.artifacts) == (alone[2], [], []) and three.page_text == alone[3] == ""


def test_hostile_pages_take_time_in_proportion():
    import time

    from turnsift.sources import pages

    selectors = pages.Selectors(pages.ARTIFACT_SELECTORS)
    for part in ('<a b="c', "<div></span>", "<div ", "<div>", "<!-- x", "<script>", "</p>", "<a b=1 c='", "<", "<a =\"'", "< p><!x"):
        began = time.process_time()
        pages.Page(part * ((1 << 20) // len(part)), "http://h.org/", selectors, text=True, links=True).links
        assert time.process_time() - began < 6, part


def test_quarantine_names_the_file(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"role": "user", "content": "x"}\n{broken\n\n   \n')
    (tmp_path / "b.log").write_text('[1, 2]\n{"content": "y", "metadata": 7}\n"just text"\n{"content": "z"}')
    (tmp_path / "c.log").write_text("")
    good, bad = messages.read_quarantined(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[1], r.content, r.block) for r in good.collect()) == [("a.log", "x", 0), ("b.log", "z", 0)]
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in bad.collect()) == [
        ("a.log", "{broken", "not a document"), ("b.log", '"just text"', "not a document"), ("b.log", "[1, 2]", "not a document"),
        ("b.log", '{"content": "y", "metadata": 7}', "wrong type"),
    ]


def test_session_documents(spark, tmp_path):
    from turnsift.sources import documents

    kinds = ["transmission", "test_start", "conversation_event", "duplicate_detected", "test_end", "unheard"]
    rows = [(f"s{i % 3}" if i % 7 else None, 1000 * (97 * i % 50), kinds[i % 6], 'a "quoted" text é') for i in range(60)]
    events = spark.createDataFrame(rows, "conversation_id string, at long, type string, data string").select(
        "conversation_id", F.timestamp_millis("at").alias("ts"), F.col("at").alias("session_time"), "type",
        F.lit(None).cast("string").alias("test_phase"), F.lit("u").alias("url"), "data",
    )
    folder = str(tmp_path / "out")
    documents.export_sessions(events, folder, 5)
    docs = {d.conversationId: d for d in documents.read_sessions(spark, folder).collect()}
    assert set(docs) == {"s0", "s1", "s2", None} and not (tmp_path / "out" / "_pending").exists()
    for session, doc in docs.items():
        mine = [r for r in rows if r[0] == session]
        lists = [getattr(doc, name) for name in (*documents.LISTS, documents.OTHER)]
        assert sorted((e.type, e.timestamp, e.data) for x in lists for e in x) == sorted((k, at, d) for _, at, k, d in mine)
        assert all([e.timestamp for e in x] == sorted(e.timestamp for e in x) for x in lists)
        assert doc.summary.totalTests == sum(r[2] == "test_start" for r in mine) and doc.exportTimestamp == 5
        assert doc.summary.sessionDuration == max(r[1] for r in mine) - min(r[1] for r in mine)
    documents.export_sessions(events.limit(0), str(tmp_path / "none"))
    assert documents.read_sessions(spark, folder).where("size(otherEvents) > 0").count() > 0


def test_days_of_history_unite(log):
    from turnsift.operators import reports

    rows = log([(86_400 * (i % 3) + i, "user" if i % 2 else "assistant", f"text {i % 40}") for i in range(200)])
    days = reports.history_sketches(rows)
    assert days.count() == 3
    merged, exact = reports.merged_history(days, ["convo_id"]).first(), reports.history_stats(rows).first()
    assert abs(merged.memory_entries - 40) <= 2 and exact.memory_entries == 40
    assert (merged.last_user_ms, merged.session_ms) == (exact.last_user_ms, exact.session_ms)
