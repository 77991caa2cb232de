import re

from turnsift.llm import licenses as lc
from turnsift.llm.license_signatures import SIGNATURES, SPDX


def phrase_places(text, phrase):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    want = phrase.split()
    return len(words), [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]


def labels(text):
    return [(r.label, r.base) for r, *_ in lc.detect(b" ".join(lc.alnum_words(text.encode())))]


def test_base_places(documents, odd_texts):
    rows = [*odd_texts, (20, "Under the MIT license, under the mit\nlicense; CC-BY-NC cc by nc"), (21, "xunder the mit license under the mit licenses")]
    got = sorted(
        ((r.doc_id, r.n_words, sorted((d.label, d.first_word) for d in r.detections if d.base)) for r in lc.scan_licenses(documents(rows, clashing=True)).collect()),
        key=repr,
    )
    want = sorted(
        ((d, phrase_places(t, "x")[0], sorted((label, p) for phrase, label in lc.BASE.items() for p in phrase_places(t, phrase)[1])) for d, t in rows),
        key=repr,
    )
    assert got == want
    assert lc.scan_licenses(documents([])).count() == 0


def test_contained_detections_are_suppressed():
    assert labels("released under the GNU Lesser General Public License version 3") == [("lgpl-3", False)]
    assert labels("GNU General Public License, version 2") == [("gpl-2", False)]
    assert labels("CC BY-NC-SA 4.0") == [("cc-by-nc", True), ("cc-by-nc-sa", False)]
    assert labels("SPDX-License-Identifier: Apache-2.0") == [("apache-2", False)]
    assert labels("a poem about the commons") == []


def test_rules_and_gates():
    assert len(lc.rules()) > 200
    for label, pattern, keywords in lc.NAMES:
        assert any(k in pattern.replace("[cs]", "c") or k.split()[0] in pattern for k in keywords.split(",")), label


def test_gates_lose_nothing():
    """Every rule finds the same with and without its keywords on sample sentences."""
    samples = [
        "licensed under the apache license version 2 0", "this is free software under the terms of the gnu affero general public license version 3",
        "zlib libpng license", "mozilla public license 2 0", "the new bsd license", "2 clause bsd", "creative commons zero",
        "do what the fuck you want to public license", "eclipse public license v 2 0", "artistic license 2 0", "ms pl", "cc zero",
        "redistribution and use in source and binary forms with or without modification", "all rights reserved", "expat license",
    ]
    for text in samples:
        kept = []
        for rule in lc.rules():
            for start, end in lc._places(rule, text.encode()):
                if rule.base or not any(a <= start and end <= b for other, a, b in kept if other.place < rule.place):
                    kept.append((rule, start, end))
        assert lc.detect(text.encode()) == kept and kept


def test_signatures_find_their_samples():
    for label, pattern, keywords, _, sample in SIGNATURES:
        plain = b" ".join(lc.alnum_words(sample.encode()))
        rule = next(r for r in lc.rules() if r.label == label and r.pattern == lc._whole_words(pattern))
        assert list(lc._places(rule, plain)), sample
        assert any(k in b" " + plain for k in rule.keywords), (keywords, sample)
        assert label in [found for found, _ in labels(sample)], (label, labels(sample), sample)


def test_spdx_identifiers():
    for label, names in SPDX:
        for name in names.split():
            for text in (f"SPDX-License-Identifier: {name}", f"// SPDX-License-Identifier: (Zlib OR {name}-or-later) */ int main"):
                assert {label, "zlib"} >= {found for found, base in labels(text) if not base} >= {label}, (text, labels(text))
    assert [found for found, _ in labels("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note-exception OR MIT")] == ["gpl-2", "mit"]
    assert labels("SPDX-License-Identifier: MIT-0") == [("mit-0", False)]


def test_bare_names_are_found():
    for name, label in [("MIT", "mit"), ("ISC", "isc"), ("zlib", "zlib"), ("Artistic 2.0", "artistic-2"), ("Ruby", "ruby"), ("PSF", "psf")]:
        assert labels(f"The code is licensed under {name}.") == [(label, False)]
    assert labels("ein Haus mit Garten, License mit Garten") == [] and labels("licensed under Ruby on Rails") == []
    assert labels("licensed under the GPL v2") == [("gpl-2", False)]


def test_hundreds_are_written_by_hand():
    """Not counted: what phrase families make of the names."""
    identifiers = sum(len(names.split()) for _, names in SPDX)
    assert len(lc.BASE) + len(lc.STATEMENTS) + len(lc.NAMES) + len(SIGNATURES) + identifiers > 300


def test_many_detections_in_one_long_text():
    """Two megabytes of one phrase: time in proportion, nothing suppressed, words counted from the start."""
    import time

    text = b" ".join([b"under the mit license"] * 90_000)
    began = time.process_time()
    found = lc.detect(text)
    assert time.process_time() - began < 10
    assert sum(rule.base for rule, *_ in found) == 90_000


def test_containment_in_any_earlier_detection():
    """Against the definition, on text in which names stand inside phrases."""
    text = b"licensed under the mit license or the apache license version 2 0 spdx license identifier mit or apache 2 0 the mit license"
    kept = []
    for rule in lc.rules():
        if any(k in b" " + text for k in rule.keywords):
            before = list(kept)
            kept += [(rule, a, b) for a, b in lc._places(rule, text) if rule.base or not any(x <= a and b <= y for _, x, y in before)]
    assert [(r.place, a, b) for r, a, b in lc.detect(text)] == [(r.place, a, b) for r, a, b in kept]
