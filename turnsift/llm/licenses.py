"""License scans with ordered signature rules.

Texts are reduced to lower-cased words joined by single spaces.  A rule is a hand-written pattern over such words with
a label, a weight and keywords; it runs only on texts in which a word begins one of its keywords.  Rules are ordered: base phrases come
first, then statements, SPDX identifiers, names in a grant, signatures, and names in weaker phrases.  Detections of a rule that lie inside a
detection of an earlier rule are suppressed, equal spans included, so "gnu lesser general public license version 3" is
not also a "general public license".  Base phrases are never suppressed, and all their places are counted.

``score`` is the weight of the strongest detection left, 0 without any.  Null and empty texts have no words and no
detections.  Rows are judged one by one, so repeated ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.llm.license_signatures import SIGNATURES, SPDX
from turnsift.llm.words import alnum_words, byte_texts, map_arrow

#: Base phrases, whose places are reported.  Fixed values.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Label, pattern of the name over words, keywords of which a match has one at the start of a word.  Public license names, in the order in which they are tried.
NAMES = [
    ("agpl-3", r"(?:gnu )?affero (?:gnu )?general public licen[cs]e(?: (?:version|v) ?3)?|agpl ?v?3(?: 0)?", "affero,agpl"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public licen[cs]e (?:version|v) ?2 1|lgpl ?v?2 1", "lesser general,library general,lgpl"),
    ("lgpl-3", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version|v) ?3)?|lgpl ?v?3(?: 0)?", "lesser general,lgpl"),
    ("gpl-2", r"(?:gnu )?general public licen[cs]e (?:version|v) ?2|gpl ?v?2(?: 0)?", "general public,gpl"),
    ("gpl-3", r"(?:gnu )?general public licen[cs]e (?:version|v) ?3|gpl ?v?3(?: 0)?", "general public,gpl"),
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl", "general public,gpl"),
    ("apache-2", r"apache (?:software )?licen[cs]e(?: (?:version|v))? ?2(?: 0)?|apache 2(?: 0)?(?: licen[cs]e)?", "apache"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache"),
    ("mit", r"mit licen[cs]e|expat licen[cs]e|mit expat", "mit licen,mit expat,expat licen"),
    ("mit-0", r"mit no attribution|mit 0", "mit no,mit 0"),
    ("bsd-4", r"(?:original|old) bsd(?: licen[cs]e)?|(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause", "bsd"),
    ("bsd-3", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?|bsd 3 clause", "bsd"),
    ("bsd-2", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?|bsd 2 clause", "bsd,freebsd"),
    ("0bsd", r"zero clause bsd|0bsd|bsd zero clause", "0bsd,bsd"),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd"),
    ("isc", r"isc licen[cs]e", "isc licen"),
    ("mpl-2", r"mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?|mpl ?2(?: 0)?", "mozilla,mpl"),
    ("mpl-1.1", r"mozilla public licen[cs]e (?:version |v ?)?1 1|mpl 1 1", "mozilla,mpl"),
    ("epl-2", r"eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?|epl ?2(?: 0)?", "eclipse public,epl"),
    ("epl-1", r"eclipse public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?|epl ?1(?: 0)?", "eclipse public,epl"),
    ("cddl", r"common development and distribution licen[cs]e|cddl(?: 1 [01])?", "common development,cddl"),
    ("cpl-1", r"common public licen[cs]e(?: (?:version )?1(?: 0)?)?", "common public"),
    ("eupl", r"european union public licen[cs]e|eupl(?: 1 [12])?", "european union,eupl"),
    ("artistic-2", r"artistic licen[cs]e (?:version )?2(?: 0)?", "artistic licen"),
    ("artistic", r"artistic licen[cs]e", "artistic licen"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("bsl-1", r"boost software licen[cs]e", "boost software"),
    ("busl", r"business source licen[cs]e|busl 1 1", "business source,busl"),
    ("sspl", r"server side public licen[cs]e|sspl 1(?: 0)?", "server side,sspl"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "do what the,wtfpl"),
    ("unlicense", r"the unlicen[cs]e|unlicen[cs]e org", "the unlicen,unlicen"),
    ("cc0", r"creative commons zero|cc0(?: 1 0)?|cc zero", "creative commons,cc0,cc zero"),
    ("cc-by-nc-nd", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by,creative commons"),
    ("cc-by-nc-sa", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", "cc by,creative commons"),
    ("cc-by-nc", r"cc by nc|creative commons attribution non ?commercial", "cc by,creative commons"),
    ("cc-by-nd", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?", "cc by,creative commons"),
    ("cc-by-sa", r"cc by sa|creative commons attribution share ?alike", "cc by,creative commons"),
    ("cc-by", r"cc by|creative commons attribution", "cc by,creative commons"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e|gfdl", "free documentation,gfdl"),
    ("ofl", r"(?:sil )?open font licen[cs]e|ofl 1 1", "open font,ofl"),
    ("odbl", r"open database licen[cs]e|odbl", "open database,odbl"),
    ("openrail", r"(?:bigscience )?openrail(?: m)?(?: licen[cs]e)?", "openrail,bigscience"),
    ("psf", r"python software foundation licen[cs]e|psf licen[cs]e", "python software,psf"),
    ("php", r"php licen[cs]e(?: version)? 3(?: 0?1)?", "php"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ruby", r"ruby licen[cs]e|ruby s licen[cs]e", "ruby"),
    ("vim", r"vim licen[cs]e", "vim"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("curl", r"curl licen[cs]e", "curl"),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft public,ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "microsoft reciprocal,ms rl"),
]
#: Phrase families around a name: kind, pattern, weight.  Every name is tried in every family, in this order.
FAMILIES = [
    ("grant", r"(?:is|are|was|be|been)? ?(?:re)?(?:licensed|released|distributed|available|published|provided|redistributed) "
              r"(?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})", 1.0),
    ("terms", r"(?:under|subject to|governed by|accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})", 0.9),
    ("file", r"(?:see|read|copy of) (?:the )?(?:file )?(?:{name})", 0.7),
    ("name", r"(?:{name})", 0.6),
]
#: Statements without a license name: label, pattern, keywords, weight.
STATEMENTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and", 0.95),
    ("public-domain", r"(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain", "public domain", 0.8),
    ("all-rights-reserved", r"all rights reserved", "rights reserved", 0.5),
    ("proprietary", r"(?:proprietary and confidential|unauthorized copying of this (?:file|work))", "proprietary and,unauthorized copying", 0.8),
    ("no-derivatives", r"no derivative works(?: are)? (?:allowed|permitted)", "derivative works", 0.5),
    ("non-commercial", r"(?:for )?non ?commercial use only", "commercial use,noncommercial use", 0.5),
]


@dataclass(frozen=True)
class Rule:
    """``place`` is the rule's priority: lower is stronger."""

    place: int
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    weight: float
    base: bool = False


def _whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


def _identifiers() -> list[tuple[str, str]]:
    """Label and pattern of every SPDX identifier, the longest first, anywhere in an expression; its span is that of ``id``."""
    plain = [(label, b" ".join(alnum_words(name.encode())).decode()) for label, names in SPDX for name in names.split()]
    plain.sort(key=lambda x: (-len(x[1]), x[1]))
    after = "(?: only| or later)?"
    # What stands between two operators: an identifier of the list, an exception, or one that is not listed.
    other = rf"(?:(?:{'|'.join(name for _, name in plain)}){after}|(?:[a-z0-9]+ ){{0,4}}exception(?: [0-9]+){{0,3}}|licenseref(?: [a-z0-9]+){{1,4}}?)"
    return [
        (label, rf"spdx license identifier (?:{other} (?:or|and|with) )*(?P<id>{name}{after})") for label, name in plain
    ]


@cache
def rules() -> list[Rule]:
    """All rules: the hand-written ones, and each name in each phrase family, which adds weight but no label."""
    made: list[Rule] = []

    def add(label: str, pattern: str, keywords: str, weight: float, base: bool = False) -> None:
        gate = tuple(b" " + k.encode() for k in keywords.split(","))
        made.append(Rule(len(made), label, _whole_words(pattern), gate, weight, base))

    for phrase, label in BASE.items():
        add(label, phrase, phrase, 1.0, True)
    for label, pattern, keywords, weight in STATEMENTS:
        add(label, pattern, keywords, weight)
    def names(families: list[tuple[str, str, float]]) -> None:
        for _, family, weight in families:
            for label, name, keywords in NAMES:
                add(label, family.format(name=name), keywords, weight)

    for label, pattern in _identifiers():
        add(label, pattern, "spdx license", 1.0)
    names(FAMILIES[:1])
    for label, pattern, keywords, weight, _ in SIGNATURES:
        add(label, pattern, keywords, weight)
    names(FAMILIES[1:])
    return made


@cache
def _gates() -> dict[bytes, list[Rule]]:
    """Rules by keyword."""
    gates: dict[bytes, list[Rule]] = {}
    for rule in rules():
        for keyword in rule.keywords:
            gates.setdefault(keyword, []).append(rule)
    return gates


def _places(rule: Rule, text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of all matches; a base phrase is also found where it overlaps itself."""
    found = rule.pattern.search(text)
    while found:
        yield found.span("id") if "id" in rule.pattern.groupindex else found.span()
        found = rule.pattern.search(text, found.start() + 1 if rule.base else max(found.end(), found.start() + 1))


def detect(text: bytes) -> list[tuple[Rule, int, int]]:
    """Detections in normalised text that no earlier rule's detection contains, in order of priority."""
    kept: list[tuple[Rule, int, int]] = []
    padded = b" " + text
    tried = {rule.place: rule for keyword, gated in _gates().items() if keyword in padded for rule in gated}
    # Starts of the detections of earlier rules in order, and how far those up to each of them reach.
    starts: list[int] = []
    reach: list[int] = []
    for _, rule in sorted(tried.items()):
        if len(starts) < len(kept):
            spans = sorted((a, b) for _, a, b in kept)
            starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        for start, end in _places(rule, text):
            before = bisect_right(starts, start)
            if rule.base or not before or reach[before - 1] < end:
                kept.append((rule, start, end))
    return kept


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Per document its words, base places and the detections left as label, first word, words and weight."""

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in byte_texts(batch.column("text")):
            words = alnum_words(text)
            plain = b" ".join(words)
            detected = detect(plain)
            # Spaces before each end of a span.
            spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32) if detected else None
            first, last = (np.searchsorted(spaces, [x[k] for x in detected]).tolist() if detected else [] for k in (1, 2))
            found = [
                {"label": rule.label, "first_word": a, "words": b - a + 1, "weight": rule.weight, "base": rule.base}
                for (rule, *_), a, b in zip(detected, first, last)
            ]
            rows.append({"n_words": len(words), "detections": found})
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([r["detections"] for r in rows], pa.list_(pa.struct([
                    ("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("weight", pa.float64()),
                    ("base", pa.bool_()),
                ]))),
            ],
            ["doc_id", "n_words", "detections"],
        )

    rows = documents.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    detections = "array<struct<label:string,first_word:bigint,words:bigint,weight:double,base:boolean>>"
    return map_arrow(rows, scan, f"doc_id {kind}, n_words bigint, detections {detections}")
