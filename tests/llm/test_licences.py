"""Licence scans against a plain search of word lists, and expressions against their value."""

import re

import pytest

from souklens.llm import licences
from souklens.llm.queries import QUERIES


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = []
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(places), sorted({x for _, x in places})


TEXTS = ["Released under the MIT License.", "mit license mit license, GNU General\nPublic License; CC-BY cc by by", "éMIT License", "mit license", "", None,
         "GNU Lesser General Public License", "x " * 20_000 + "apache license"]


def test_base_places():
    scanner = licences.Scanner()
    for text in TEXTS:
        n, places, base, labels, *_ = scanner.scan(text)
        assert (n, sorted(places), sorted(base)) == plain(text)
        assert base <= labels


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("MIT", {"mit"}, 1.0), ("GPL-2.0-only", {"gpl"}, 0.2), ("MIT OR GPL-2.0", {"mit", "gpl"}, 1.0), ("MIT AND GPL-2.0", {"mit", "gpl"}, 0.2),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl"}, 0.6), ("MIT OR Apache-2.0 AND AGPL-3.0", {"mit", "apache", "agpl"}, 1.0),
    ("(MIT OR Apache-2.0) AND AGPL-3.0", {"mit", "apache", "agpl"}, 0.1), ("GPL-2.0 WITH x AND MIT */ more", {"gpl", "mit"}, 0.6), ("Odd-1.0", {"odd-1.0"}, 0.0),
])
def test_expressions(text, labels, score):
    assert licences.evaluate(text) == (labels, pytest.approx(score))


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND OR MIT"])
def test_not_expressions(text):
    with pytest.raises(licences.NotAnExpression):
        licences.evaluate(text)


def test_tags():
    n, places, base, labels, score, _ = licences.Scanner().scan("# SPDX-License-Identifier: (MIT OR GPL-2.0)\nspdx-license-identifier: AND\n\"license expression\": \"BSD-3-Clause\"")
    assert (base, labels, score) == (set(), {"mit", "gpl", "bsd"}, 1.0)


@pytest.mark.parametrize(("text", "labels", "unread"), [
    ("SPDX-License-Identifier: see the file", set(), {"see the file"}), ("License expression: unknown at this time", set(), {"unknown at this time"}),
    ("license-expression:\n\nThis text", set(), set()), ("SPDX-License-Identifier: Python code below", set(), {"Python code below"}),
    ("SPDX-License-Identifier: Python-2.0", {"python"}, set()), ("SPDX-License-Identifier: LicenseRef-Own.1", {"licenseref-own.1"}, set()),
    ("SPDX-License-Identifier: MIT OR see below", set(), {"MIT OR see below"}), ("SPDX-License-Identifier: MIT see below", {"mit"}, set()),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0 AND OFL-1.1", {"cc-by", "cc-by-nc", "ofl"}, set()), ("SPDX-License-Identifier: GPL-2.0+ WITH Odd-exception", {"gpl"}, set()),
    ("spdx license identifier = postgresql", set(), {"postgresql"}), ("Under the SIL Open Font License, Version 1.1", {"ofl"}, set()),
    ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: none", {"mit"}, {"none"}),
])
def test_labels_are_identifiers(text, labels, unread):
    found = licences.Scanner().scan(text)
    assert (found[3], found[5]) == (labels, unread)


def test_every_label_has_a_freedom():
    assert {*licences.BASE.values(), *licences.NOTICES.values(), *licences.FAMILIES.values()} == set(licences.FREEDOM)


def test_frames(spark):
    df = spark.createDataFrame([(1, TEXTS[0], "x"), (1, TEXTS[0], "x"), (None, None, None)], "doc_id long, text string, labels string")
    rows = licences.scan(df, keep=["doc_id"]).collect()
    assert [(r["n_words"], [tuple(p) for p in r["places"]], r["labels"], r["score"]) for r in rows] == [(5, [(3, "mit")], ["mit"], 1.0)] * 2 + [(0, [], [], 0.0)]
    assert licences.scan(df.limit(0), keep=["doc_id"]).collect() == []


def test_query(spark, con):
    got = {r["doc_id"]: r for r in QUERIES["op5_licence_scan"](spark, "/root/testdata/sf0.001").collect()}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        n, places, labels = plain(text)
        row, starts = got[doc], [w for w, _ in places]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (
            n, len(places), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert set(labels) <= set(row["labels"].split(",")) or not labels
