"""Licence scans: identifier tags and notice phrases by one Aho-Corasick automaton, expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import islice
from math import prod

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import Out, rows

# --- fixed values: phrases as words, with their labels -----------------------------
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit", "apache license": "apache",
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 2": "lgpl-2", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2", "eclipse public license": "epl", "boost software license": "bsl",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "zlib license": "zlib", "the unlicense": "unlicense", "cc0": "cc0", "creative commons zero": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}
TAG = "spdx license identifier"
PERMISSIVE = ("mit", "apache", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0", "cc-by", "bsl", "bsl-1")
RANK = {"or": 1, "and": 2, "with": 3}
# --- end of fixed values -------------------------------------------------------------

FOUND = "array<struct<word: bigint, kind: string, text: string, labels: array<string>, permitted: boolean>>"
SCANNED = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, found {FOUND}, permitted boolean, score double"
_FOUND = pa.list_(pa.struct([("word", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("labels", pa.list_(pa.string())), ("permitted", pa.bool_())]))
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("found", _FOUND), ("permitted", pa.bool_()), ("score", pa.float64()),
])

# bytes of a text to its words: ASCII other than letters and digits becomes a space, A-Z become a-z
_WORDS = bytes(b if b > 127 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LINE = re.compile(r"[ \t]*:([^\r\n]*)")
_PART = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_VERSION = re.compile(r"(.+?)-(\d+)(?:\.0)*(?:-only)?")
_CC = re.compile(r"(cc(?:-[a-z]+)+)-\d.*")


def label_of(identifier: str) -> str:
    """A licence identifier as a label: lower case, ``-2.0`` as ``-2``, ``-only`` and a CC licence's version left out."""
    name = identifier.lower().strip(".-")
    if m := _CC.fullmatch(name):
        return m[1]
    m = _VERSION.fullmatch(name)
    return f"{m[1]}-{m[2]}" if m else name


def to_postfix(text: str) -> list[str]:
    """A licence expression as postfix, by shunting-yard: WITH binds before AND before OR, equal ones to the left.

    The longest well-formed beginning counts: reading ends at a character or word that cannot follow, an
    operator without a right side and an open parenthesis without content are left out, parentheses
    still open are closed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next, at = True, 0
    while m := _PART.match(text, at):
        part, at = m[1], m.end()
        word = part.lower()
        if word in RANK:
            if operand_next:
                break
            while stack and RANK.get(stack[-1], 0) >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif part == "(":
            if not operand_next or (stack and stack[-1] == "with"):
                break
            stack.append(part)
        elif part == ")":
            if operand_next or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if not operand_next:
                break
            out.append(part)
            operand_next = False
    if operand_next:  # what waits for a right side: operators and parentheses down to the last one in use
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(postfix: Sequence[str], allowed: Iterable[str]) -> tuple[list[str], bool]:
    """(labels named, whether ``allowed`` licences suffice): AND needs both sides, OR one; an exception (WITH) only adds rights."""
    allowed, labels, stack = frozenset(allowed), set(), []
    for i, part in enumerate(postfix):
        if part in RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left if part == "with" else left and right if part == "and" else left or right)
        elif i + 1 < len(postfix) and postfix[i + 1] == "with":
            stack.append(True)
        else:
            labels.add(label_of(part))
            stack.append(label_of(part) in allowed)
    return sorted(labels), bool(stack and stack[-1])


class Scanner:
    """The automaton over words. Patterns and texts have a space on both sides of every word, so matches are whole words."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tag: str, allowed: Iterable[str]):
        self.kinds, self.allowed = [], frozenset(allowed)
        self.tag_words = len(tag.split())
        patterns: dict[str, list[tuple[str, str, str]]] = {}
        for kind, group in (("base", base), ("notice", notices), ("tag", {tag: ""} if tag else {})):
            for phrase, label in group.items():
                words = phrase.encode().translate(_WORDS).split()
                if words:
                    patterns.setdefault(b" ".join([b"", *words, b""]).decode("latin-1"), []).append((kind, phrase, label))
        self.automaton = ahocorasick.Automaton()
        for n, (pattern, meanings) in enumerate(patterns.items()):
            self.automaton.add_word(pattern, (n, len(pattern), meanings))
        self.automaton.make_automaton() if patterns else None
        self.any = bool(patterns)

    def scan(self, text: str | None):
        """(number of words, [(word, kind, phrase or expression, labels, permitted)] by place)."""
        words = text.encode().translate(_WORDS).split() if text else []
        if not words or not self.any:
            return len(words), []
        line = b" ".join([b"", *words, b""])
        found, tags, at, spaces = [], [], 0, 0
        for end, (_, length, meanings) in sorted(self.automaton.iter(line.decode("latin-1")), key=lambda x: x[0] - x[1][1]):
            start = end - length + 1  # of the space before the first word
            spaces, at = spaces + line.count(b" ", at, start), start
            for kind, phrase, label in meanings:
                if kind == "tag":
                    tags.append(spaces)
                else:
                    found.append((spaces, kind, phrase, [label], label in self.allowed))
        return len(words), sorted(outermost(found) + self.expressions(text, tags))

    def expressions(self, text: str, tags: list[int]):
        """Tags with the expression behind each, read from the text itself; those without one are left out."""
        out, places, done = [], _WORD.finditer(text), 0
        for word in tags:
            last = word + self.tag_words - 1
            end = next(islice(places, last - done, None)).end()
            done = last + 1
            line = _LINE.match(text, end)
            postfix = to_postfix(line[1]) if line else []
            if postfix:
                labels, permitted = evaluate(postfix, self.allowed)
                out.append((word, "tag", " ".join(postfix), labels, permitted))
        return out


def outermost(found: list[tuple]) -> list[tuple]:
    """Without the notices that lie inside another phrase; of equal stretches the base phrase stays. Base phrases all stay."""
    kept, reach = [], -1
    for x in sorted(found, key=lambda x: (x[0], -len(x[2].split()), x[1])):
        end = x[0] + len(x[2].split())
        if x[1] == "base" or end > reach:
            kept.append(x)
        reach = max(reach, end)
    return kept


def confidence(found) -> float:
    """1 - product of doubts, each distinct phrase or expression once: 0.05 for a tag, halved per word of a phrase."""
    doubts = {(kind, text): 0.05 if kind == "tag" else 0.5 ** len(text.split()) for _, kind, text, _, _ in found}
    return 1 - prod(doubts[k] for k in sorted(doubts))


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tag: str = TAG, allowed: Iterable[str] = PERMISSIVE) -> DataFrame:
    """Licences named in ``docs(doc_id, text)``: one row per row, see ``SCANNED``.

    ``found`` lists every place by its word (from 0): base phrases, notice phrases and tags. A tag's
    expression follows a colon on its line and is kept as postfix. ``permitted``: every tag's expression is
    satisfied by ``allowed``, and where there is no tag every phrase's label is in it; NULL where nothing
    is found. A notice phrase inside another phrase is not reported, a base phrase always. Texts are read whole, one at a
    time; there is no shuffle.

    NULL or empty text: no words, nothing found, empty lists, score 0. NULL or repeated doc_id: each row
    for itself. Extra columns are dropped. An empty table gives no rows.
    """
    base, notices, allowed = dict(base), dict(notices), tuple(allowed)

    def run(batches):
        scanner, out = Scanner(base, notices, tag, allowed), Out(_ARROW, 5000)
        for doc_id, text in rows(batches, "doc_id", "text"):
            n, found = scanner.scan(text)
            own = [x for x in found if x[1] == "base"]
            decisive = [x for x in found if x[1] == "tag"] or found
            out.add(
                doc_id, n, len(own), own[0][0] if own else None, own[-1][0] if own else None, sorted({x[3][0] for x in own}), sorted({y for x in found for y in x[3]}),
                [dict(zip(("word", "kind", "text", "labels", "permitted"), x, strict=True)) for x in found], all(x[4] for x in decisive) if found else None, confidence(found),
            )
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)
