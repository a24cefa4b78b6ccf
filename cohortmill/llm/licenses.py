"""License scans: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

Texts are read as words (letters, digits and anything beyond ASCII, A-Z in lower
case). One automaton holds all phrases and the identifier tag. After a tag the
expression up to the end of its line is parsed by operator precedence: ``with``
binds before ``and``, ``and`` before ``or``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortmill.llm import base
from cohortmill.llm.words import PUNCTUATION

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: More notices that give a label. The first four words or so of each usual text.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: Identifier prefixes by label; the longest that fits decides.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd",
    "0bsd": "bsd", "isc": "isc", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd", "unlicense": "unlicense", "zlib": "zlib",
}
#: How freely a text under the license may be used, 0 to 1; unknown ones count as closed.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "reserved": 0.0,
}
#: An exception takes away part of what the license asks for.
EXCEPTION_GAIN = 0.2
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
TAG_TEXT = re.compile(r"spdx[^a-z0-9]*license[^a-z0-9]*identifier[\x20\t]*:?([^\r\n]*)", re.IGNORECASE)

_READ = bytes(0x20 if b in PUNCTUATION else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Found(NamedTuple):
    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    freedom: float | None


def family(identifier: str) -> str:
    """Label of an identifier; itself, in lower case, if no family is known."""
    low = identifier.lower()
    fits = [p for p in FAMILIES if low == p or low.startswith((p + "-", p + "+"))]
    return FAMILIES[max(fits, key=len)] if fits else low.rstrip("+")


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard; None if the expression isn't well formed."""
    out, held, operand = [], [], True
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand:
                # Words after a complete expression are a remark, unless a bracket is open.
                if "(" in held:
                    return None
                break
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(labels, freedom): ``and`` takes the stricter side, ``or`` the freer, ``with`` relaxes."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(({family(token)}, FREEDOM.get(family(token), 0.0)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], min(1.0, left[1] + EXCEPTION_GAIN)))
        else:
            stack.append((left[0] | right[0], (min if token == "and" else max)(left[1], right[1])))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE_PHRASES, TAG: ""}:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def judge(text: str | None, machine: ahocorasick.Automaton) -> Found:
    """All findings of one text; a null text is empty.

    score is the strength of evidence: 1 for a tag with a valid expression, .9
    for a base phrase, .6 for another notice, .3 for a tag that can't be read, 0
    without any. freedom is the strictest of all licenses found, null if none.
    """
    words = (text or "").encode("utf-8", "replace").translate(_READ).split()
    joined = " " + b" ".join(words).decode("utf-8") + " "
    labels, base_labels, places, notices, score, freedom, tagged = set(), set(), [], [], 0.0, [], False
    at, counted = 0, -1
    for end, phrase in machine.iter(joined):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE_PHRASES:
            start = end - len(phrase) - 1
            counted += joined.count(" ", at, start + 1)
            at = start + 1
            places.append(counted)
            base_labels.add(BASE_PHRASES[phrase])
            freedom.append(FREEDOM[BASE_PHRASES[phrase]])
            score = max(score, 0.9)
        else:
            notices.append((end - len(phrase), end, NOTICES[phrase]))
            score = max(score, 0.6)
    reach, leads = {}, {}
    for start, end, _ in notices:
        reach[start] = max(end, reach.get(start, 0))
        leads[end] = min(start, leads.get(end, start))
    for start, end, label in notices:
        # Of notices that begin or end at the same place the longest counts.
        if end < reach.get(start, 0) or start > leads.get(end, start):
            continue
        labels.add(label)
        freedom.append(FREEDOM[label])
    if tagged:
        for match in TAG_TEXT.finditer(text):
            value = evaluate(match[1])
            score = max(score, 0.3 if value is None else 1.0)
            if value:
                labels |= value[0]
                freedom.append(value[1])
    return Found(len(words), len(places), min(places, default=None), max(places, default=None),
                 ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), score, min(freedom, default=None))


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, " \
         "score double, freedom double"
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and the fields of ``Found``; input columns with those names are replaced."""
    carried = [c for c in base.beside(docs, list(Found._fields)) if c != text]
    narrow = docs.select(F.struct(*[base.named(c) for c in carried]).alias("_row"), base.named(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            found = [judge(t.as_py(), machine) for t in batch.column("_text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(TYPES)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", *Found._fields])

    schema = narrow.drop("_text").schema
    for field in docs.sparkSession.createDataFrame([], SCHEMA).schema.fields:
        schema = schema.add(field)
    return narrow.mapInArrow(run, schema).select("_row.*", *Found._fields)
