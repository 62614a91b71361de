"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags,
a shunting-yard parser evaluates the tags' and/or/with expressions.

Texts are lower-cased (A-Z) and seen as words of ASCII letters, digits and non-ASCII
characters, joined by single blanks; a phrase matches where its words stand
consecutively, overlapping places included.  `score` grows with the evidence: it is
1 - 2**-(places of phrases + tags).  `allowed` is null without a tag, else whether every
tagged expression can be met with `accepted` licences (an OR needs one side, an AND
both; WITH keeps the licence's answer; a malformed expression isn't allowed).

Nulls: a null text is empty (no words, no labels, score 0); a null doc_id is carried;
repeated rows are scanned as often as they occur.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywood.llm.common import bounded_batches, table

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3",
    "bsd 2 clause": "bsd-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0-1",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "eclipse public license": "epl",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "cc0-1.0", "unlicense", "bsl-1.0", "0bsd"})
TAG = "spdx license identifier"
_TAGGED = re.compile(r"SPDX-License-Identifier\s*:[ \t]*(?=[^\r\n])", re.I)
_REST = re.compile(r"[^\r\n]*")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


def expressions(text: str) -> list[str]:
    """What follows each tag up to the end of its line or the next tag."""
    tags = list(_TAGGED.finditer(text))
    ends = [m.start() for m in tags[1:]] + [len(text)]
    return [_REST.match(text, m.end(), end)[0] for m, end in zip(tags, ends)]


def parse(expression: str) -> list[str] | None:
    """Postfix form of a licence expression by the shunting-yard rule; None where it is malformed."""
    out, stack, operand = [], [], False
    for m in _TOKEN.finditer(expression):
        token = m[0]
        op = token.upper()
        if op in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                break  # prose after the expression
            out.append(token.lower())
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], accepted=ACCEPTED) -> bool:
    stack: list[bool] = []
    for token in postfix:
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "WITH" else (a and b) if token == "AND" else (a or b))
        else:
            stack.append(token.rstrip("+") in accepted)
    return stack[-1]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], accepted):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                self.machine.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
        self.machine.make_automaton()
        self.accepted = accepted

    def __call__(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
        plain = f" {b' '.join(words).decode('latin-1')} "
        places, base, labels, evidence, tagged = [], set(), set(), 0, False
        for end, (kind, label, back) in self.machine.iter(plain):
            evidence += kind != "tag"
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            if kind == "base":
                base.add(label)
                places.append(end - back)
        allowed = None
        if tagged:
            for expression in expressions(text):
                postfix = parse(expression)
                evidence += 1
                allowed = (allowed is not False) and postfix is not None and evaluate(postfix, self.accepted)
                labels.update(f"spdx:{t}" for t in postfix or () if t not in _RANK)
        first = plain.count(" ", 0, min(places)) if places else None
        last = plain.count(" ", 0, max(places)) if places else None
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5 ** min(evidence, 50), allowed


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, allowed boolean"


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, accepted=ACCEPTED) -> DataFrame:
    """doc_id and what was found in each row's whole text."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf(SCAN)
    def found(text: pd.Series) -> pd.DataFrame:
        f = Scanner(base, notices, accepted)
        out = pd.DataFrame([f(t) for t in text], columns=[c.split()[0] for c in SCAN.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64", "allowed": "boolean"})

    return docs.select(F.col("doc_id").cast("long"), found(F.col("text").cast("string")).alias("f")).select("doc_id", "f.*")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

