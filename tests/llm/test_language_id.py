import numpy as np
import pytest
from pyspark.sql import functions as F

from turnsift.llm import language_id as li

SAMPLE = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, lang string"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SAMPLE}/documents.parquet")


def test_held_out_accuracy(spark, labelled):
    """Documents as pages without any other evidence."""
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    pages = labelled.where(held & (F.length("text") > 200)).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h"), "doc_id", F.lit(".example.org/")).alias("url"),
        F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"), F.col("lang").alias("truth"),
    )
    got = li.identify(pages, labelled.where(~held)).join(pages.select("page_id", "truth"), "page_id").collect()
    assert len(got) > 30 and sum(r.lang == r.truth for r in got) >= 0.9 * len(got)


def test_evidence_decides_where_the_text_does_not(spark, labelled):
    text = {r.lang: r.text for r in labelled.where("length(text) between 800 and 3000").collect()}
    rows = [(k, f"https://www.ort.example.de/{k}", f"<html lang='de'><p>{text['de']}</p></html>", "x") for k in range(6)]
    rows += [(10 + k, f"https://town.example.com/{k}", f"<html lang='en'><p>{text['en']}</p></html>", "x") for k in range(6)]
    rows += [(20, "https://www.ort.example.de/q", "<html><body></body></html>", "x"), (21, "https://town.example.com/q", "<p>de</p>", None)]
    rows += [(30, None, None, None), (31, "http://[bad", "", ""), (20, "https://www.ort.example.de/q", "", "x"), (None, "", "<html lang=tlh>", "")]
    got = [(r.page_id, r.lang, r.posterior, r.declared) for r in li.identify(spark.createDataFrame(rows, PAGES), labelled).collect()]
    lang = {p: g for p, g, *_ in got}
    assert len(got) == len(rows)
    assert {lang[k] for k in range(6)} == {"de"} and {lang[10 + k] for k in range(6)} == {"en"}
    assert (lang[20], lang[21]) == ("de", "en")
    assert all(0 < p <= 1 for *_, p, _ in got) and (None, "other") in [(p, d) for p, _, _, d in got]


def test_fusion_by_hand():
    """Two languages, one page: every factor written out."""
    one = np.array([[1.0, 0.0]])
    got = li.fused(np.log([[0.6, 0.4]]), one, np.array([[5.0, 1.0]]), np.array([[3.0, 3.0]]), np.array([[2.0, 2.0]]), np.array([[2.0, 0.0]]), np.array([8.0, 6.0]), 3)
    everyone = (7, 6)
    shares = [(x + 1) / 15 for x in everyone]
    domain = [(1 + 4 * shares[0]) / 7, (2 + 4 * shares[1]) / 7]
    host = [(1 + 4 * domain[0]) / 5, (0 + 4 * domain[1]) / 5]
    odds = [
        0.6 * (4.5 / (7 + 2)) * (2.5 / (7 + 1.5)) * host[0],
        0.4 * (1.5 / (6 + 2)) * (3.5 / (6 + 1.5)) * host[1],
    ]
    assert got[0] == pytest.approx(np.array(odds) / sum(odds))


def test_reading_pages():
    page = "<html class=x lang='DE-at'><style>p{}</style><nav>menu</nav><p>a&amp;b</p><!-- c --><script>d</script></html>"
    assert li.visible_text(page).split() == ["a&b"]
    assert li.declared_language(page) == "de"
    assert li.declared_language("<meta http-equiv='content-language' content='fr'>") == "fr"
    assert li.declared_language("<p>") is None
    assert li.host_of("https://user@WWW.Example.org:80/x") == "www.example.org"


def test_empty_tables(spark, labelled):
    pages = spark.createDataFrame([(1, "http://a.b", "<p>x</p>", None)], PAGES)
    assert li.identify(pages.limit(0), labelled).count() == 0
    assert [r.lang for r in li.identify(pages, labelled.limit(0)).collect()] == [None]


def test_more_languages_than_one_table(spark):
    """The last languages have the fewest texts; each page is in one of them and says so."""
    n = li.LANGUAGES + 3
    text = [" ".join(chr(97 + k % 26) + chr(97 + k // 26) * 2 + x for x in "qwertyuiop") for k in range(n)]
    names = [f"l{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
    data = [(k, " ".join([text[k]] * (2 + n - k)), names[k]) for k in range(n)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    pages = [(k, f"http://h{k}.example/", f"<html lang={names[k]}><p>{text[k]}</p>") for k in range(n)]
    got = li.identify(spark.createDataFrame(pages, "page_id bigint, url string, html string"), docs).collect()
    assert sorted((r.page_id, r.text_lang, r.declared) for r in got) == [(k, names[k], names[k]) for k in range(n)]


def brute(pages, docs):
    """Trigram counts, votes and priors in plain Python."""
    from collections import Counter
    from math import exp, log

    def grams(text):
        data = " " + " ".join(text.encode().lower().decode().split()) + " "
        data = data.encode()
        return [((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1) % 2**32) >> 18 for i in range(len(data) - 2)]

    learned = {}
    for text, lang in docs:
        if lang is not None:
            learned.setdefault(lang, Counter()).update(grams(text or ""))
    names = sorted(learned)
    facts = []
    for page_id, url, page in pages:
        found = grams(li.visible_text(page or ""))
        found = found if len(found) > 0 else []
        text = [sum(log((learned[n][g] + 1) / (sum(learned[n].values()) + li.BUCKETS)) for g in found) / li.TEMPER for n in names]
        host = li.host_of(url)
        said = li.declared_language(page or "")
        vote = max(range(len(names)), key=lambda k: (text[k], -k)) if found else None
        facts.append((page_id, text, vote, said if said is None or said in names else "other", host.split(".")[-1], ".".join(host.split(".")[-2:]), host))
    out = []
    suffixes = len({f[4] for f in facts})
    for page_id, text, vote, *where in facts:
        def votes(k, at=None, value=None):
            held = sum(f[2] == k and (at is None or f[3 + at] == value) for f in facts)
            return held - (vote == k)

        total = sum(votes(k) + 1 for k in range(len(names)))
        logs = []
        for k in range(len(names)):
            share = (votes(k) + 1) / total
            said = (votes(k, 0, where[0]) + 0.5) / (votes(k) + 0.5 * (len(names) + 2))
            ending = (votes(k, 1, where[1]) + 0.5) / (votes(k) + 0.5 * suffixes)
            prior = (votes(k, 2, where[2]) + li.STRENGTH * share) / (sum(votes(j, 2, where[2]) for j in range(len(names))) + li.STRENGTH)
            prior = (votes(k, 3, where[3]) + li.STRENGTH * prior) / (sum(votes(j, 3, where[3]) for j in range(len(names))) + li.STRENGTH)
            logs.append(text[k] + log(said) + log(ending) + log(prior))
        odds = [exp(x - max(logs)) for x in logs]
        best = max(range(len(names)), key=lambda k: (odds[k], -k))
        out.append((page_id, where[3], names[best], odds[best] / sum(odds)))
    return out


def test_the_whole_against_plain_python(spark):
    """Pages of shared and own hosts, without text, with equal evidence for two languages, and a very long one."""
    docs = [("aaa bbb ccc ddd", "x"), ("eee fff ggg hhh", "y"), ("eee fff ggg hhh", "z"), (None, "x"), ("lost", None)]
    pages = [(k, f"http://{'abc'[k % 3]}.site{k % 2}.{'de' if k % 4 else 'fr'}/", f"<html lang={'xyq'[k % 3]}><p>{docs[k % 3][0]}</p>") for k in range(12)]
    pages += [(20, "http://a.site0.de/", ""), (21, None, None), (22, "http://a.site0.de/", "<p>" + "eee fff " * 40_000 + "</p>"), (22, "x", "<script>aaa")]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit(7) for c in ("host", "vote", "lang", "declared", "likelihoods", "n_grams")})
    got = li.identify(rows, spark.createDataFrame(docs, "text string, lang string")).collect()
    want = brute(pages, docs)
    assert sorted((r.page_id, r.host, r.lang) for r in got) == sorted(w[:3] for w in want)
    assert sorted(r.posterior for r in got) == pytest.approx(sorted(w[3] for w in want))


def test_hostile_pages_take_time_in_proportion():
    import time

    for part in ("<script ", "<!-- ", "<nav>", "<meta content-language ", "<html lang ", "<style></nav>"):
        began = time.process_time()
        page = part * (2_000_000 // len(part))
        li.visible_text(page), li.declared_language(page)
        assert time.process_time() - began < 5, part
    assert li.visible_text("a<nav>b<script>c</nav>d<!-- e").split() == ["a", "d<!--", "e"]
