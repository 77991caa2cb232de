"""Language identification of web pages by Bayesian fusion of evidence.

For each language the log posterior of a page is the sum of

* the **text likelihood**: byte trigrams of the visible text under a smoothed multinomial per language, learned from labelled
  documents; trigrams overlap, so their sum is divided by ``TEMPER``,
* the likelihood of the **declared language** (``<html lang>`` or a content-language meta tag; other values and none are
  two classes of their own),
* the likelihood of the **address suffix**, the last label of the host,
* the **host prior**, smoothed hierarchically: host towards its domain (the last two labels), domain towards all pages.

What is declared, which suffix and which host goes with which language is counted over all pages with the language of
their text alone, as grouped aggregates; a page's own vote is taken out before it is judged.  Trigrams are hashed into
``BUCKETS`` counts.  All languages present are told apart: ``LANGUAGES`` of them make one table, and the pages are read once per
table, so the driver and a task hold one table at a time.

Null or empty pages have no text evidence and follow their host, a null or broken address has the empty host.  Ties
go to the first language in alphabetical order.  Rows are judged one by one; without labelled documents the language is null.
Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm.words import byte_texts, map_arrow
from turnsift.session import cut_lineage

BUCKETS = 1 << 14
#: Languages of one table.
LANGUAGES = 64
TEMPER = 6.0
STRENGTH = 4.0
_HIDDEN = re.compile(r"(?i)<!--|<(script|style|nav|header|footer|aside|noscript|template)\b")
_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in "script style nav header footer aside noscript template".split()} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")
_HEADS = re.compile(r"(?i)<(html|meta)\b([^<>]*)")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?\s*([a-z]+)""")
_CONTENT = re.compile(r"""(?i)content\s*=\s*["']?\s*([a-z]+)""")


def without_hidden(page: str) -> str:
    """The page with a space for each comment and hidden element.  One pass: an end that is missing once is not looked for again."""
    out, at, done, missing = [], 0, 0, set()
    while found := _HIDDEN.search(page, at):
        at, name = found.end(), (found[1] or "").lower()
        end = None if name in missing else _ENDS[name].search(page, at)
        if end is None:
            missing.add(name)
            continue
        out.append(page[done : found.start()])
        at = done = end.end()
    return " ".join([*out, page[done:]])


def visible_text(page: str) -> str:
    return html.unescape(_TAG.sub(" ", without_hidden(page)))


def declared_language(page: str) -> str | None:
    """The language of the first ``html`` or ``meta`` element that names one."""
    for kind, inside in _HEADS.findall(page):
        if kind.lower() == "html":
            named = _LANG.findall(inside)[:1]
        else:
            place = inside.lower().find("content-language")
            named = _CONTENT.findall(inside, place + len("content-language"))[-1:] if place >= 0 else []
        if named:
            return named[0].lower()
    return None


def host_of(address: str | None) -> str:
    try:
        return (urlsplit(address or "").hostname or "").rstrip(".")
    except ValueError:
        return ""


def buckets(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram; white space counts as one space, A-Z as a-z."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


def trigram_counts(documents: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all documents with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def made() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"]
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), byte_texts(batch.column("text"))):
                if lang not in counts and len(counts) >= LANGUAGES:
                    yield from made()
                    counts.clear()
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(buckets(text), minlength=BUCKETS)
        yield from made()

    rows = documents.where("lang is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    partial = rows.mapInArrow(run, "lang string, bucket bigint, n bigint")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(counts: DataFrame) -> tuple[list[str], Iterator[np.ndarray]]:
    """All languages, and in tables of ``LANGUAGES`` their log probabilities of each bucket."""
    counts = cut_lineage(counts)
    names = sorted(row.lang for row in counts.select("lang").distinct().collect())

    def tables() -> Iterator[np.ndarray]:
        for at in range(0, len(names), LANGUAGES):
            place = {name: k for k, name in enumerate(names[at : at + LANGUAGES])}
            table = np.ones((len(place), BUCKETS))
            for row in counts.where(F.col("lang").isin(*place)).toLocalIterator():  # at most LANGUAGES times BUCKETS rows
                table[place[row.lang], row.bucket] += row.n
            yield np.log(table / table.sum(axis=1, keepdims=True))

    return names, tables()


def _with_likelihoods(pages: DataFrame, shared: Broadcast) -> DataFrame:
    """``pages`` whose ``likelihoods`` go on with the languages of one table."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place = batch.schema.get_field_index("likelihoods")
        out = []
        for page, before in zip(batch.column("html").to_pylist(), batch.column("likelihoods").to_pylist()):
            found = buckets(visible_text(page or "").encode("utf-8", "ignore"))
            out.append(before + (shared.value[:, found].sum(axis=1) / TEMPER).tolist())
        field = batch.schema.field(place)
        yield batch.set_column(place, field, pa.array(out, field.type))

    return map_arrow(pages, run, pages.schema)


def _evidence(pages: DataFrame, names: list[str], tables: Iterator[np.ndarray]) -> DataFrame:
    """Per page its host parts, declared language, and text likelihoods; ``vote`` is the language of the text alone."""
    rows = pages.select(
        "page_id", F.col("url").cast("string"), F.col("html").cast("string"), F.array().cast("array<double>").alias("likelihoods")
    )
    context = pages.sparkSession.sparkContext
    table, after = next(tables, np.ones((0, BUCKETS))), next(tables, None)
    while after is not None:
        passed = context.broadcast(table)
        rows = cut_lineage(_with_likelihoods(rows, passed))
        passed.destroy()
        table, after = after, next(tables, None)
    shared = context.broadcast(table)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        out = []
        columns = [batch.column(c).to_pylist() for c in ("html", "url", "likelihoods")]
        for page, address, before in zip(*columns):
            page = page or ""
            found = buckets(visible_text(page).encode("utf-8", "ignore"))
            text = np.append(before, model[:, found].sum(axis=1) / TEMPER)
            host = host_of(address)
            said = declared_language(page)
            out.append({
                "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1],
                "declared": said if said is None or said in names else "other", "n_grams": len(found),
                "likelihoods": (text - text.max()).tolist() if names else [],
                "vote": int(text.argmax()) if len(found) and names else None,
            })
        made = pa.RecordBatch.from_pylist(out, kinds)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *made.columns], ["page_id", *kinds.names])

    kinds = pa.schema([
        ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("n_grams", pa.int64()),
        ("likelihoods", pa.list_(pa.float64())), ("vote", pa.int32()),
    ])
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, run, (
        f"page_id {kind}, host string, domain string, suffix string, declared string, n_grams bigint, "
        "likelihoods array<double>, vote int"
    ))


def _votes(evidence: DataFrame, by: str, size: int) -> DataFrame:
    """Votes per value of ``by`` and language, as one array."""
    counts = F.array(*[F.count_if(F.col("vote") == k) for k in range(size)])
    return evidence.groupBy(by).agg(counts.alias(f"{by}_votes"))


def fused(
    likelihoods: np.ndarray, votes: np.ndarray, declared: np.ndarray, suffix: np.ndarray, domain: np.ndarray, host: np.ndarray,
    totals: np.ndarray, suffixes: int,
) -> np.ndarray:
    """Posterior of each language (columns) for each page (rows).

    ``votes`` marks the page's own vote; the other tables hold the votes that go with its declared language, suffix,
    domain and host, and ``totals`` those of all pages.
    """
    size = likelihoods.shape[1]
    everyone = totals - votes
    shares = (everyone + 1) / (everyone + 1).sum(axis=1, keepdims=True)
    said = (declared - votes + 0.5) / (everyone + 0.5 * (size + 2))
    ending = (suffix - votes + 0.5) / (everyone + 0.5 * suffixes)
    own_domain, own_host = domain - votes, host - votes
    prior = (own_domain + STRENGTH * shares) / (own_domain.sum(axis=1, keepdims=True) + STRENGTH)
    prior = (own_host + STRENGTH * prior) / (own_host.sum(axis=1, keepdims=True) + STRENGTH)
    log = likelihoods + np.log(said) + np.log(ending) + np.log(prior)
    odds = np.exp(log - log.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per page ``host, declared, n_grams, text_lang`` (by text alone), ``lang`` and its ``posterior``."""
    names, tables = likelihoods(trigram_counts(documents))
    evidence = cut_lineage(_evidence(pages, names, tables))
    size = len(names)
    rows = evidence
    for by in ("declared", "suffix", "domain", "host") if size else ():
        votes = _votes(evidence, by, size)
        match = F.col(by).eqNullSafe(F.col(f"_{by}"))
        rows = rows.join(votes.withColumnRenamed(by, f"_{by}"), match).drop(f"_{by}")
    totals = np.zeros(size)
    for row in evidence.where("vote is not null").groupBy("vote").count().collect():
        totals[row.vote] = row[1]
    suffixes = max(1, evidence.select("suffix").distinct().count())

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        own = batch.column("vote").to_pylist()
        kept = [batch.column(c) for c in ("page_id", "host", "declared", "n_grams")]
        lang: list[str | None] = [None] * n
        posterior: list[float | None] = [None] * n
        if size and n:
            def arrays(column: str) -> np.ndarray:
                return np.array(batch.column(column).to_pylist(), float).reshape(n, size)

            votes = np.zeros((n, size))
            cast = [k for k in range(n) if own[k] is not None]
            votes[cast, [own[k] for k in cast]] = 1
            tables = [arrays(f"{by}_votes") for by in ("declared", "suffix", "domain", "host")]
            share = fused(arrays("likelihoods"), votes, *tables, totals, suffixes)
            best = share.argmax(axis=1)
            lang = [names[k] for k in best]
            posterior = share.max(axis=1).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                *kept, pa.array([None if k is None else names[k] for k in own], pa.string()), pa.array(lang, pa.string()),
                pa.array(posterior, pa.float64()),
            ],
            ["page_id", "host", "declared", "n_grams", "text_lang", "lang", "posterior"],
        )

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, judge, (
        f"page_id {kind}, host string, declared string, n_grams bigint, text_lang string, lang string, posterior double"
    ))
