"""Packing: documents into token windows by best-fit decreasing."""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonelytics.llm.common import Out, rows

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
# within these characters Unicode's NFC is the identity and lower-casing has no context
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
# under this pattern a word of letters alone is one piece
_LETTERS_WHOLE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode``.

    For a tokenizer that lower-cases, splits by one pattern and then runs byte-level BPE on each
    piece alone, a text's ids are its pieces' ids in order, and white space ends a piece. So each
    word and piece is encoded once and remembered, up to ``remembered`` of each, then anew. All other
    tokenizers and texts (other scripts, special tokens) go to ``encode``.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        self.whole = Tokenizer.from_file(path)
        self.remembered, self.words, self.pieces, self.split = remembered, {}, {}, None
        spec = json.loads(self.whole.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        names = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        fits = [x["type"] for x in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0]["pattern"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        if fits and names == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]:
            self.split = regex.compile(steps[0]["pattern"]["Regex"])
            self.letters_whole = steps[0]["pattern"]["Regex"] == _LETTERS_WHOLE
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.bare = Tokenizer(self.whole.model)
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def learn(self, new: set[str]) -> None:
        """Remember the ids of words not met yet."""
        cut = {w: [w] if self.letters_whole and w.isalpha() else self.split.findall(w) for w in new}
        if len(self.pieces) + len(new) > self.remembered:
            self.pieces = {}
        missing = [p for p in {p for found in cut.values() for p in found} if p not in self.pieces]
        for at in range(0, len(missing), 1000):
            part = missing[at : at + 1000]
            got = self.bare.encode([p if p.isascii() else p.encode().decode("latin-1").translate(self.shown) for p in part], is_pretokenized=True, add_special_tokens=False)
            data, ends = np.array(got.ids, "<u4").tobytes(), (4 * np.searchsorted(got.word_ids, np.arange(len(part) + 1))).tolist()
            self.pieces |= {p: data[a:b] for p, a, b in zip(part, ends, ends[1:], strict=False)}
        if len(self.words) + len(new) > self.remembered:
            self.words = {}
        known = self.pieces
        self.words |= {w: known[found[0]] if len(found) == 1 else b"".join([known[p] for p in found]) for w, found in cut.items()}

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        found = [*map(self.words.get, words)]
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            self.learn({words[i] for i in missing})
            for i in missing:
                w = words[i]
                found[i] = self.words[w] if w in self.words else self.alone(w)
        return b"".join(found)

    def alone(self, word: str) -> bytes:
        self.learn({word})
        return self.words[word]

    @classmethod
    def kept(cls, path: str, remembered: int) -> Ids:
        """One encoder per Python worker: workers are reused between tasks, and with them its words."""
        kept = tokenizers.__dict__.setdefault("_ids_by_path", {})
        if path not in kept:
            kept[path] = cls(path)
        kept[path].remembered = remembered
        return kept[path]


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, remembered: int = 400_000) -> DataFrame:
    """Cut each document's ids (with ``end_id`` after them) into full windows and a rest: one row per piece."""

    def cut(batches):
        ids, out = Ids.kept(tokenizer, remembered), Out(_ARROW)
        end = np.array([end_id], "<u4").tobytes()
        for doc_id, text in rows(batches, "doc_id", "text"):
            data = ids.one(text) + end
            n = len(data) // 4
            for start in range(0, n, window):
                part = data[4 * start : 4 * (start + window)]
                out.add(doc_id, start, len(part) // 4, zlib.crc32(part), n)
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, given in falling order.

    A segment tree over remaining capacity counts the open windows below each node; the leftmost
    non-empty leaf at or right of a length is the tightest window that still takes it.
    """
    size = 1 << window.bit_length()
    tree, open_at = [0] * (2 * size), [[] for _ in range(window + 1)]
    where, offset, used = [], [], 0

    def count(leaf: int, by: int) -> None:
        while leaf:
            tree[leaf] += by
            leaf >>= 1

    for n in lengths:
        at = size + n
        while at and not tree[at]:
            while at & 1:  # a right child has nothing to its right below its parent
                at >>= 1
            at = at + 1 if at else 0
        if at:
            while at < size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
            room = at - size
            seq = open_at[room].pop()
            count(at, -1)
        else:
            room, seq, used = window, used, used + 1
        where.append(seq)
        offset.append(window - room)
        if room > n:
            open_at[room - n].append(seq)
            count(size + room - n, 1)
    return where, offset


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_docs: int = 8192, remembered: int = 400_000) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into windows of ``window`` tokens; one row per piece, see ``PACKED``.

    Overlong documents are cut into full windows first. Pieces are dealt evenly, whatever their ids,
    to shards of about ``shard_docs`` documents, and each shard is packed by best-fit decreasing in
    its own task, so memory does not grow with the corpus and the loss against one global packing is
    at most a part-filled window or two per shard. An encoder remembers ``remembered`` words and as many pieces of words. A window holding fewer than ``window`` tokens is
    padded to ``window`` unless its length is a power of two; padding has no rows.

    NULL or empty text: one piece, the end id alone. NULL or repeated doc_id: each row is a document
    of its own. Equal lengths are taken in the order of (doc_id, start, crc). Extra columns are
    dropped. An empty table gives no rows.
    """
    shards = max(1, math.ceil(docs.count() / shard_docs))
    dealt = pieces(docs, tokenizer, window, end_id, remembered).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, group["offset"] = best_fit(group["length"].tolist(), window)
        group["sequence_id"] = np.asarray(where, np.int64) + (group["shard"].to_numpy(np.int64) << 32)
        return group

    return dealt.groupBy("shard").applyInPandas(place, f"{PACKED}, shard long").drop("shard")
