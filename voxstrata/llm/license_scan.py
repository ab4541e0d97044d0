"""Licences named in texts, by Aho-Corasick over words and identifier tags, and their expressions.

One automaton runs over a text's words, joined by single spaces, and finds all notice
phrases, overlapping ones too; another runs over the lower-cased text and finds
identifier tags, whose rest of the line is a licence expression.  A shunting-yard
parser evaluates it: ``with`` binds closest and lets an exception weaken a copyleft,
``and`` binds next and takes the stricter kind, ``or`` takes the one that's easier to
meet.  An expression that isn't well formed, or holds an unknown identifier, is kept
as found with no labels.

Score: 1 with an evaluated tag, else w / (w + 1) for the longest found phrase of w
words, else 0.

Defined cases: a null or empty text has no words, places or tags and scores 0; ids may
be null or repeat, each row gives one row; other columns are ignored, whatever their
names; an empty table gives no rows; a phrase inside a longer one that is found at the
same place counts only if it is a base phrase.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the contract, and notices and identifiers as licences and their identifier list print them.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit": "mit",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "boost software license": "bsl",
    "free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
}
TAGS = ("spdx-license-identifier:", "spdx-licence-identifier:")
#: Kinds, from free use to restricted use.
KINDS = ("permissive", "weak copyleft", "copyleft", "restricted")
_KIND = dict.fromkeys(("mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc0", "cc-by", "0bsd"), 0)
_KIND |= dict.fromkeys(("lgpl", "mpl", "epl", "cddl"), 1) | dict.fromkeys(("gpl", "agpl", "cc-by-sa"), 2) | dict.fromkeys(("cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"), 3)

_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKENS = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*|\S")
_VERSION = re.compile(r"-v?\d.*|\+$")
_CLOSERS = re.compile(r"\s*(\*/|-->|\*\)|#\}|[\"'])\s*$")
#: Every byte that separates words is turned to a space.
_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def family(identifier: str) -> str:
    """The licence without its version: gpl of gpl-2.0-or-later."""
    return identifier if identifier in _KIND else _VERSION.sub("", identifier, count=1).rstrip("+")


def evaluate(expression: str) -> tuple[frozenset[str], int] | None:
    """(labels, kind) of a licence expression in lower case, None if it can't be evaluated."""
    values: list[tuple[frozenset[str], int] | str] = []
    held: list[str] = []

    def apply() -> bool:
        b, a, op = values.pop(), values.pop(), held.pop()
        if op == "with":
            if isinstance(a, str) or not isinstance(b, str):
                return False
            values.append((a[0], 1 if a[1] == 2 else a[1]))
        else:
            if isinstance(a, str) or isinstance(b, str):
                return False
            values.append((a[0] | b[0], max(a[1], b[1]) if op == "and" else min(a[1], b[1])))
        return True

    operand = True  # what must come next
    for t in _TOKENS.findall(expression):
        if operand:
            if t == "(":
                held.append(t)
                continue
            if t in _BINDS or t == ")" or not t[0].isalnum():
                return None
            if "exception" in t:
                values.append(t)
            elif family(t) in _KIND:
                values.append((frozenset([family(t)]), _KIND[family(t)]))
            else:
                return None
            operand = False
        elif t == ")":
            while held and held[-1] != "(":
                if not apply():
                    return None
            if not held or isinstance(values[-1], str):
                return None
            held.pop()
        elif t in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                if not apply():
                    return None
            held.append(t)
            operand = True
        else:
            return None
    if operand:
        return None
    while held:
        if held[-1] == "(" or not apply():
            return None
    return None if isinstance(values[0], str) else values[0]


class Scanner:
    """Both automata; made once a task."""

    def __init__(self, notices: dict[str, str], tags: tuple[str, ...]):
        import ahocorasick

        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (notices | BASE).items():
            self.words.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase.encode()) + 1, len(phrase.split()), label, phrase in BASE))
        for tag in tags:
            self.tags.add_word(tag, None)
        self.words.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, bool]], list[tuple[str, tuple[frozenset[str], int] | None]]]:
        """n_words, places (word, words, label, base) and tags (expression, value) of a text."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        joined = b" " + b" ".join(raw.translate(_SPACES).split()) + b" "
        n = joined.count(b" ") - 1 if len(joined) > 2 else 0
        found = [(end - size, k, label, base) for end, (size, k, label, base) in self.words.iter(joined.decode("latin-1"))]
        places = []
        if found:
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
            at = np.searchsorted(spaces, [f[0] for f in found]).tolist()
            reach = 0
            for w, k, label, base in sorted(((w, k, label, base) for w, (_, k, label, base) in zip(at, found)), key=lambda p: (p[0], -p[1])):
                if base or w + k > reach:
                    places.append((w, k, label, base))
                reach = max(reach, w + k)
        tags = []
        plain = raw.decode("latin-1")
        for end, _ in self.tags.iter(plain):
            stop = plain.find("\n", end)
            expression = _CLOSERS.sub("", plain[end + 1 : stop if stop >= 0 else len(plain)]).strip()
            tags.append((expression.encode("latin-1").decode("utf-8", "replace"), evaluate(expression)))
        return n, places, tags


SCHEMA = "n_words long, places array<struct<word:long,words:int,label:string,base:boolean>>, tags array<struct<expression:string,labels:array<string>,kind:string>>, kind string, score double"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """doc_id, n_words, places (word, words, label, base), tags (expression, labels, kind), kind, score of each row.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case, numbered from 0.  kind is the
    strictest of what the text names: one of KINDS, null if it names nothing."""
    kind = docs.schema[doc_id].dataType.simpleString()
    types = [pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())])), pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("kind", pa.string())])), pa.string(), pa.float64()]

    def row(n, places, tagged):
        strict = [_KIND[p[2]] for p in places if p[2] in _KIND] + [v[1] for _, v in tagged if v]
        score = 1.0 if any(v for _, v in tagged) else max((k / (k + 1) for _, k, _, _ in places), default=0.0)
        told = [{"expression": e, "labels": sorted(v[0]) if v else [], "kind": KINDS[v[1]] if v else None} for e, v in tagged]
        return n, [dict(zip(("word", "words", "label", "base"), p)) for p in places], told, KINDS[max(strict)] if strict else None, score

    def run(batches):
        scanner = Scanner(notices, tags)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                rows = [row(*scanner.scan(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), types)]], ["doc_id", "n_words", "places", "tags", "kind", "score"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def report(found: DataFrame) -> DataFrame:
    """One row per document: places of base phrases, their first and last word, labels of both sorts."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    labels = lambda places: F.transform(places, lambda p: p["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(labels(base)).alias("base_labels"),
        joined(F.concat(labels("places"), F.flatten(F.transform("tags", lambda t: t["labels"])))).alias("labels"),
        "score",
        "kind",
    )
