"""Licence scans: notice phrases and identifier tags, found by Aho-Corasick.

Phrases are sequences of words (see ``words_of``); a second automaton finds
identifier tags in the text as it stands. The expression after a tag, up to the
end of its line, is parsed by the shunting-yard method: ``with`` binds closer
than ``and``, ``and`` closer than ``or``. The longest leading part of the line
that is a whole expression counts, and in it the licences whose names are
known. Of two licences joined by ``or`` the
freer counts, of ``and`` the stricter; an exception after ``with`` frees a
little. The score of a text is the freedom of its strictest finding, 0.5 if
there is none.

Missing and empty texts have no word and no finding. All places count,
overlapping ones too. Repeated rows are scanned each. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from grainmill.llm.common import map_batches, words_of

BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, by their usual wording.
PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license:", "licence:", "@license", "@licence")
# How free a use is: 1 without duties, 0 none.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "boost": 0.95,
    "zlib": 0.95, "apache-2": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6, "lgpl": 0.55, "cc-by-sa": 0.5,
    "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.0,
}
UNKNOWN = 0.5
EXCEPTION = 0.1
PREFIXES = {
    "mit": "mit", "apache": "apache-2", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib", "bsl": "boost",
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "cc0": "cc0", "unlicense": "unlicense",
}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
BINDING = {"with": 3, "and": 2, "or": 1}


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier, None if it is not known."""
    name = identifier.lower()
    if name.startswith("cc-by"):
        kinds = name.split("-")
        return next((f"cc-by-{k}" for k in ("nc", "nd", "sa") if k in kinds), "cc-by")
    return PREFIXES.get(name.split("-")[0])


@dataclass
class Licence:
    """The value of an expression: its labels and its freedom."""

    labels: frozenset[str]
    freedom: float


def parse(expression: str, strict: bool = True) -> Licence | None:
    """Value of an expression; None if it is malformed or names a licence that is not known.

    If not strict, names that are not known are left out.
    """
    output: list[tuple[str, str]] = []
    waiting: list[str] = []
    operand = True  # whether one must come next
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word in BINDING:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and BINDING[waiting[-1]] >= BINDING[word]:
                output.append(("operator", waiting.pop()))
            waiting.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(("operator", waiting.pop()))
            if not waiting or operand:
                return None
            waiting.pop()
        else:
            if not operand:
                return None
            output.append(("name", token))
            operand = False
    if operand or "(" in waiting:
        return None
    output += [("operator", w) for w in reversed(waiting)]
    return _evaluate(output, strict)


def _evaluate(postfix: list[tuple[str, str]], strict: bool) -> Licence | None:
    stack: list[Licence | str | None] = []
    for kind, value in postfix:
        if kind == "name":
            stack.append(value)
            continue
        right, left = stack.pop(), stack.pop()
        left = _licence(left)
        if left is None and strict:
            return None
        if value == "with":  # the right side names an exception, not a licence
            if not isinstance(right, str) or label_of(right):
                return None
            stack.append(left and Licence(left.labels, min(1.0, left.freedom + EXCEPTION)))
            continue
        right = _licence(right)
        if left is None or right is None:
            if strict:
                return None
            stack.append(left or right)
            continue
        choose = min if value == "and" else max
        stack.append(Licence(left.labels | right.labels, choose(left.freedom, right.freedom)))
    return _licence(stack.pop())


def _licence(value: Licence | str | None) -> Licence | None:
    if value is None or isinstance(value, Licence):
        return value
    label = label_of(value)
    return None if label is None else Licence(frozenset([label]), FREEDOM[label])


def leading(line: str) -> Licence | None:
    """Value of the longest leading part of a line that is a whole expression.

    Names that are not known are left out of it; None if none is known.
    """
    tokens: list[str] = []
    whole = depth = 0
    operand = True
    before = ""
    for found in TOKEN.finditer(line):
        token = found.group()
        word = token.lower()
        if word in BINDING or token == ")":
            if operand or (token == ")" and not depth):
                break
            depth -= token == ")"
            operand = token != ")"
        elif not operand or (before == "with" and (token == "(" or label_of(token.rstrip(".:")))):
            break
        elif token == "(":
            depth += 1
        else:
            token = token.rstrip(".:")  # of the sentence
            operand = False
        tokens.append(token)
        before = word
        if not operand and not depth:
            whole = len(tokens)
    return parse(" ".join(tokens[:whole]), strict=False)


@functools.cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | PHRASES).items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE_PHRASES))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> tuple[int, list[tuple[int, str]], frozenset[str], float]:
    """Number of words, base findings (first word, label), the method's labels, score."""
    phrases, tags = _automata()
    words = words_of(text)
    plain = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    base, labels, freedom = [], set(), []
    for end, (width, label, is_base) in phrases.iter(plain):
        start = end - width
        if is_base:
            base.append((plain.count(" ", 0, start + 1) - 1, label))
        labels.add(label)
        freedom.append(FREEDOM[label])
    if text and (":" in text or "@" in text):
        # A-Z only, so that places in both texts agree.
        lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for end, _ in tags.iter(lower):
            line = text[end + 1 :].split("\n", 1)[0] if end + 1 < len(text) else ""
            value = leading(line)
            if value is not None:
                labels |= value.labels
                freedom.append(value.freedom)
    return len(words), base, frozenset(labels), min(freedom, default=UNKNOWN)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, base (array of word, label), labels (sorted array), score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pd.DataFrame) -> pd.DataFrame:
        found = [scan(t) for t in batch["text"]]
        return pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "n_words": [f[0] for f in found],
                "base": [[{"word": w, "label": label} for w, label in f[1]] for f in found],
                "labels": [sorted(f[2]) for f in found],
                "score": [f[3] for f in found],
            }
        )

    schema = f"doc_id {kind}, n_words long, base array<struct<word:long,label:string>>, labels array<string>, score double"
    return map_batches(docs.select("doc_id", "text"), each, schema)
