"""Licence scans: an Aho-Corasick automaton over words, and licence expressions by shunting yard.

One pass of the automaton over the words of a text finds notice phrases and identifier tags. What
follows a tag on its line is read as an expression of licence names with ``and``, ``or``, ``with`` and
brackets; ``with`` binds closest, then ``and``. The expression yields labels and a permissiveness:
the better side of ``or``, the worse of ``and``; an exception lifts a copyleft licence half way. A name is
a licence if it belongs to a known family or has the form of an identifier (a version, or ``LicenseRef-``);
what holds other words ("see the file") is no expression and is returned apart.

NULL is an empty text: no words, no labels, score 0. Rows are mapped independently, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from souklens.llm.common import map_texts

#: The base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl", "mozilla public license": "mpl", "eclipse public license": "epl", "european union public licence": "eupl",
    "common development and distribution license": "cddl", "common public license": "cpl", "academic free license": "afl", "open software license": "osl",
    "artistic license": "artistic", "microsoft public license": "ms-pl", "microsoft reciprocal license": "ms-rl", "server side public license": "sspl",
    "business source license": "busl", "elastic license": "elastic", "universal permissive license": "upl", "mulan permissive software license": "mulanpsl",
    "postgresql license": "postgresql", "python software foundation license": "python", "zlib license": "zlib", "zope public license": "zpl",
    "sil open font license": "ofl", "latex project public license": "lppl", "open database license": "odbl", "open data commons attribution license": "odc-by",
    "public domain dedication and license": "pddl", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense", "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "reserved", "creative commons zero": "cc0", "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution noderivs": "cc-by-nd",
}
#: Words of the tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")
#: Beginnings of identifiers with the label they stand for, longest match first.
FAMILIES = {
    "0bsd": "bsd", "afl": "afl", "agpl": "agpl", "apache": "apache", "artistic": "artistic", "bsd": "bsd", "bsl": "bsl", "busl": "busl", "bzip2": "bzip2",
    "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by-sa": "cc-by-sa", "cc0": "cc0", "cddl": "cddl", "cecill": "cecill", "cpl": "cpl",
    "ecl": "ecl", "elastic": "elastic", "epl": "epl", "eupl": "eupl", "gfdl": "gfdl", "gpl": "gpl", "hpnd": "hpnd", "icu": "icu", "ijg": "ijg", "ipl": "ipl",
    "isc": "isc", "lgpl": "lgpl", "libpng": "libpng", "lppl": "lppl", "mit": "mit", "mpl": "mpl", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "mulanpsl": "mulanpsl",
    "ncsa": "ncsa", "odbl": "odbl", "odc-by": "odc-by", "ofl": "ofl", "openssl": "openssl", "osl": "osl", "pddl": "pddl", "php": "php", "postgresql": "postgresql",
    "psf": "python", "python": "python", "qpl": "qpl", "sspl": "sspl", "unlicense": "unlicense", "upl": "upl", "w3c": "w3c", "wtfpl": "wtfpl", "x11": "x11",
    "zlib": "zlib", "zpl": "zpl",
}
#: Families whose names are ordinary words too, so that only a version makes them identifiers.
NEED_VERSION = {"artistic", "elastic", "openssl", "php", "postgresql", "python"}
#: How freely text under a label may be used; labels not named here count as 0.
FREEDOM = {
    "afl": 1.0, "apache": 1.0, "artistic": 1.0, "bsd": 1.0, "bsl": 1.0, "bzip2": 1.0, "cc0": 1.0, "ecl": 1.0, "hpnd": 1.0, "icu": 1.0, "ijg": 1.0, "isc": 1.0,
    "libpng": 1.0, "mit": 1.0, "ms-pl": 1.0, "mulanpsl": 1.0, "ncsa": 1.0, "openssl": 1.0, "pddl": 1.0, "php": 1.0, "postgresql": 1.0, "python": 1.0,
    "unlicense": 1.0, "upl": 1.0, "w3c": 1.0, "wtfpl": 1.0, "x11": 1.0, "zlib": 1.0, "zpl": 1.0, "cc-by": 0.8, "odc-by": 0.8, "lppl": 0.8, "ofl": 0.8,
    "mpl": 0.5, "cddl": 0.5, "cpl": 0.5, "epl": 0.5, "ipl": 0.5, "lgpl": 0.5, "ms-rl": 0.5, "cc-by-sa": 0.4, "gfdl": 0.4, "odbl": 0.4,
    "cecill": 0.2, "eupl": 0.2, "gpl": 0.2, "osl": 0.2, "qpl": 0.2, "agpl": 0.1, "busl": 0.1, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "elastic": 0.1, "sspl": 0.1, "reserved": 0.0,
}

#: Separators become blanks, A-Z lower case, the rest of the bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TAG_LINE = re.compile("(?:" + "|".join(t.replace(" ", r"[-_ ]") for t in TAGS) + r")[\"']?[ \t]*[:=][ \t]*[\"']?([^\n\"']*)", re.ASCII | re.IGNORECASE)
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*", re.ASCII)
#: A name of unknown family that has the form of an identifier: a version, or a reference of the document's own.
IDENTIFIER = re.compile(r"(?:[a-z][a-z0-9]*(?:-[a-z0-9.]+)*-v?[0-9]+(?:\.[0-9]+)*(?:-[a-z0-9.]+)*\+?|licenseref-[a-z0-9.-]+)", re.ASCII)
BINDS = {"or": 1, "and": 2, "with": 3}


class NotAnExpression(ValueError):
    """The text is not a licence expression."""


def family(name: str) -> str:
    """Label of a licence identifier; one of unknown family is its own label."""
    known = [f for f in FAMILIES if name == f or name.startswith((f + "-", f + "+", f + "."))]
    return FAMILIES[max(known, key=len)] if known else name


def is_licence(name: str) -> bool:
    """Whether a name (in lower case) belongs to a known family or has the form of an identifier."""
    return name in FAMILIES and name not in NEED_VERSION or IDENTIFIER.fullmatch(name) is not None or (
        family(name) != name and any(name.startswith(f + x) for f in FAMILIES if f not in NEED_VERSION for x in "-+."))


def postfix(text: str) -> list[str]:
    """The expression in postfix order, by shunting yard; text behind a complete expression is ignored.
    Names must be of licences, but for that of an exception."""
    out, held, operand, exception = [], [], True, False
    for token in TOKEN.findall(text):
        word = token.lower()
        if operand:
            if word == "(":
                held.append(word)
            elif word in BINDS or word == ")":
                raise NotAnExpression(text)
            elif exception or is_licence(word):
                out.append(word)
                operand = exception = False
            else:
                raise NotAnExpression(text)
        elif word in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand, exception = True, word == "with"
        elif word == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand or "(" in held:
        raise NotAnExpression(text)
    return out + held[::-1]


def evaluate(text: str) -> tuple[set[str], float]:
    """Labels and permissiveness of an expression. A name that nothing is known of has none."""
    values: list[tuple[set[str], float]] = []
    for token in postfix(text):
        if token in BINDS:
            (right, b), (left, a) = values.pop(), values.pop()
            if token == "with":  # the right side names an exception, not a licence
                values.append((left, (a + 1) / 2))
            else:
                values.append((left | right, max(a, b) if token == "or" else min(a, b)))
        else:
            label = family(token)
            values.append(({label}, FREEDOM.get(label, 0.0)))
    return values[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("tag", dict.fromkeys(TAGS, "")), ("notice", NOTICES), ("base", BASE)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


class Scanner:
    """Scans single texts; one for each task."""

    def __init__(self):
        self.automaton = automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], set[str], set[str], float, set[str]]:
        """Number of words, base places (first word, label), base labels, all labels, score, and what stands behind tags but is no expression."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        line = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
        places, base, labels, unread, tagged = [], set(), set(), set(), False
        at, counted = 0, 0
        for end, (kind, label, size) in self.automaton.iter(line):
            if kind == "base":
                begin = end - size  # place of the blank before the first word
                counted, at = (counted + line.count(" ", at, begin), begin) if begin >= at else (line.count(" ", 0, begin), begin)
                places.append((counted, label))
                base.add(label)
            elif kind == "notice":
                labels.add(label)
            else:
                tagged = True
        values = [FREEDOM.get(x, 0.0) for x in base | labels]
        if tagged:
            for m in TAG_LINE.finditer(text or ""):
                try:
                    more, value = evaluate(m[1])
                except NotAnExpression:
                    unread.add(m[1].strip())
                    continue
                labels |= more
                values.append(value)
        return len(words), places, base, base | labels, min(values, default=0.0), unread - {""}


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` with ``n_words``, ``places`` (start in words, label) of the base phrases, ``base_labels``,
    ``labels``, ``score`` (the permissiveness of all that was found together, the least one; 0 if nothing) and
    ``unread``: what follows a tag on its line but is no expression of licences."""
    keep = df.columns if keep is None else keep

    def make() -> Callable:
        scanner = Scanner()

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            return [[f[0] for f in found], [[{"word": w, "label": x} for w, x in f[1]] for f in found],
                    [sorted(f[2]) for f in found], [sorted(f[3]) for f in found], [f[4] for f in found], [sorted(f[5]) for f in found]]
        return work

    place = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
    strings = (T.ArrayType(T.StringType()), pa.list_(pa.string()))
    return map_texts(df, text, keep, [
        ("n_words", T.LongType(), pa.int64()),
        ("places", T.ArrayType(place), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("base_labels", *strings), ("labels", *strings), ("score", T.DoubleType(), pa.float64()), ("unread", *strings)], make)
