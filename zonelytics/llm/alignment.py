"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids meet there over a corpus."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from zonelytics.llm.common import rows, written

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"
_ARROW = pa.schema([
    *((n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])
#: a pair of ids in one number: the first id above these bits, the second below
BITS = 32
_LOW = (1 << BITS) - 1
#: A's count of tokens stands above these bits, B's below: no text has 2^31 tokens
_A_AT = 31
_B = (1 << _A_AT) - 1
_LOOSE = re.compile(r"\A\s|\s\Z| \s|\s ")  # a run that begins or ends with white space, or is empty
_LATIN = re.compile("[\x00-\x0c\x0e-\x7e\xa0-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\u024f]*")  # but carriage returns, raised digits and fractions
_W, _O = r"[^\W_]", r"(?:[^\w\s]|_)"  # letters and numbers; all else but white space
# what no tokenizer reads across: a run with an apostrophe, one behind other white space, else letters and numbers or others
_SIMPLE = re.compile(rf" ?{_W}+| ?{_O}+|[^\S ]+\S+")  # of a text without apostrophes
_UNIT = re.compile(rf" [^\s']*'\S*|{_SIMPLE.pattern}")
_CROSSES = re.compile(rf"\S |{_W}{_O}|{_O}{_W}|\S[^\S ]")


def _shown() -> dict[str, int]:
    """The byte behind each character that byte-level BPE writes for it."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Byte:
    """A byte-level BPE of ``tokenizers``: ids and byte ends of space + text.

    Character offsets give the ends of all tokens that end with a character; those that end inside one
    share it with their successor and are placed by the decoded bytes.
    """

    def __init__(self, path: str):
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        shown, vocabulary = _shown(), self.encoder.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]

    def ends(self, text: str) -> tuple[list[int], np.ndarray] | None:
        """None where the tokens' bytes are not those of space + text."""
        whole = " " + text
        got = self.encoder.encode(whole, add_special_tokens=False)
        ids = got.ids
        if b"".join([self.bytes[i] for i in ids]) != whole.encode():
            return None
        spans = np.array(got.offsets, np.int64).reshape(-1, 2)
        ends = spans[:, 1]
        if not whole.isascii():
            widths = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            ends = np.concatenate([[0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))])[ends]
        return ids, refined(ends, np.append(spans[1:, 0] < spans[:-1, 1], False), self.lengths[ids])


class Piece:
    """A sentencepiece model with byte fallback: ids and byte ends of space + text (it adds the space).

    The spans of its proto (the installed release has the plain one in place of the immutable one, with the
    same fields) give the ends of all pieces but byte-fallback ones, which are placed by the decoded bytes.
    """

    def __init__(self, path: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.encoder.get_piece_size()
        self.single = np.array([self.encoder.is_byte(i) for i in range(n)], bool)
        names = [self.encoder.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(names, self.single, strict=True)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(len(self.bytes))]

    def ends(self, text: str) -> tuple[list[int], np.ndarray] | None:
        """None where the pieces' bytes are not those of space + text."""
        pieces = self.encoder.encode(text, return_type="proto").pieces
        ids, ends = zip(*[(p.id, p.end) for p in pieces], strict=True) if pieces else ((), ())
        if b"".join([self.bytes[i] for i in ids]) != b" " + text.encode():
            return None
        ids, ends = list(ids), np.array(ends, np.int64) + 1
        return ids, refined(ends, self.single[ids], self.lengths[ids])


def refined(coarse: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends: coarse ones, but where ``inside`` the lengths of the decoded bytes counted on from the coarse end before."""
    if not inside.any():
        return coarse
    upto = np.cumsum(lengths)
    fixed = np.maximum.accumulate(np.where(inside, -1, np.arange(len(coarse))))
    anchor = np.where(fixed >= 0, coarse[fixed] - upto[fixed], 0)
    return np.where(inside, anchor + upto, coarse)


class Aligner:
    """Groups and links of texts under two tokenizers.

    Both tokenizers treat a run between single spaces alike wherever it stands, if it neither begins nor ends
    with white space: the byte-level one cuts there by its pattern, and no piece of the other holds a space behind another
    character. In Latin text the same holds between letters or numbers and other characters, but for apostrophes (all
    of this is checked on the vocabulary). Such units of a text are aligned once each and remembered, ``remembered`` of
    them in each of two generations, so that frequent ones stay; all other texts are aligned whole. Either way it is the
    same function of the text.
    """

    def __init__(self, byte_path: str, piece_path: str, remembered: int = 240_000):
        self.a, self.b = Byte(byte_path), Piece(piece_path)
        self.remembered, self.known, self.old = remembered, {}, {}
        steps = json.loads(self.a.encoder.to_str())
        first = steps.get("pre_tokenizer") or {}
        cuts = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not steps.get("normalizer")
        names = [x.decode("utf-8", "replace") for i, x in enumerate(self.b.bytes) if not self.b.encoder.is_control(i) and not self.b.encoder.is_unknown(i)]
        self.by_run = bool(cuts) and not any(re.search(r"\S ", x) for x in names)
        self.by_unit = self.by_run and not any(_CROSSES.search(x) for x in names if _LATIN.fullmatch(x))

    def whole(self, text: str, parts: Sequence[str], first: int = 0, every: int = 1):
        """(group text, pair bytes, counts) of the ``parts`` that make up space + text, or of every so-manieth; None if bytes differ.

        The numbers of A's and B's tokens are one number, so that they add up together.
        """
        one, two = self.a.ends(text), self.b.ends(text)
        if one is None or two is None:
            return None
        (a, ends_a), (b, ends_b) = one, two
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        place = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        at_a = np.flatnonzero(ends_b[place] == ends_a)
        at_b, cut = place[at_a], ends_a[at_a]
        linked = (a[at_a] << BITS | b[at_b]).tobytes()
        to_a, to_b = np.append(0, at_a + 1), np.append(0, at_b + 1)
        upto = np.append(0, np.searchsorted(cut, np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts]), "right"))
        counts = (np.diff(to_a[upto]) << _A_AT) + np.diff(to_b[upto])
        names_a, names_b, to_a, to_b, upto = [self.a.names[i] for i in a.tolist()], [self.b.names[i] for i in b.tolist()], to_a.tolist(), to_b.tolist(), upto.tolist()
        groups = [
            f"{names_a[i] if j == i + 1 else ','.join(names_a[i:j])}|{names_b[k] if m == k + 1 else ','.join(names_b[k:m])}"
            for i, j, k, m in zip(to_a, to_a[1:], to_b, to_b[1:], strict=False)
        ]
        return [(";".join(groups[i:j]), linked[8 * i : 8 * j], n) for i, j, n in zip(upto[first::every], upto[first + 1 :: every], counts[first::every].tolist(), strict=False)]

    def learn(self, new: list[str]) -> None:
        """Align units by the hundreds; one that does not begin with white space stands behind one of the other kind."""
        for at in range(0, len(new), 500):
            part, chain = new[at : at + 500], [" a"]
            for unit in part:
                chain += "" if unit[0].isspace() else " ." if unit[0].isalnum() else " a", unit
            found = self.whole("".join(chain)[1:], chain, 2, 2)
            if found is None:  # some unit's bytes differ: each alone
                alone = [(" a" + before, unit) for before, unit in zip(chain[1::2], part, strict=True)]
                found = [(self.whole("".join(pair)[1:], pair, 1) or [None])[0] for pair in alone]
            self.known.update(zip(part, found, strict=True))

    def text(self, text: str | None):
        """(group text, pair bytes, n_a, n_b), or None for a text without tokens; a pair (8 bytes) per group."""
        if not text:
            return None
        if not self.by_run or _LOOSE.search(text):
            found = self.whole(text, [" " + text])
            return (*found[0][:2], found[0][2] >> _A_AT, found[0][2] & _B) if found else None
        units = (_UNIT if "'" in text else _SIMPLE).findall(" " + text) if self.by_unit and _LATIN.fullmatch(text) else [" " + r for r in text.split(" ")]
        missing = {u for u in units if u not in self.known}
        if missing:
            again = {u: self.old[u] for u in missing if u in self.old}
            if len(self.known) + len(missing) > self.remembered:
                self.old, self.known = self.known, {u: self.known[u] for u in units if u in self.known}
            self.known.update(again)
            self.learn(sorted(missing.difference(again)))
        found = [self.known[u] for u in units]
        if None in found:
            return None
        groups, links, counts = zip(*found, strict=True)
        both = sum(counts)
        return ";".join(groups), b"".join(links), both >> _A_AT, both & _B


def links(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs(row, doc_id, text)`` its counts, the digest of its groups and its linked id pairs with their times."""

    def run(batches):
        aligner, out = Aligner(byte_path, piece_path), []

        def batch():
            columns = list(zip(*out, strict=True)) or [[] for _ in _ARROW]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        held = 0
        for row, doc_id, text in rows(batches, "row", "doc_id", "text"):
            found = aligner.text(text)
            if found is None:
                out.append((row, doc_id, 0, 0, 0, 0, "", [], []))
            else:
                groups, linked, n_a, n_b = found
                n = len(linked) // 8  # one token of either ends at a cut, so a group has one link
                pairs, times = np.unique(np.frombuffer(linked, np.int64), return_counts=True)
                held += len(pairs)
                out.append((row, doc_id, n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest(), pairs, times))
            if len(out) >= 5000 or held > 1_000_000:
                yield batch()
                out, held = [], 0
        yield batch()

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair is linked in all rows, and whether no other pair of its second id is linked more often."""

    def summed(batches):
        for batch in batches:
            pairs, times = (np.asarray(batch.column(i).flatten()) for i in range(2))
            kept, at = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(np.bincount(at, times, len(kept)).astype(np.int64))], ["pair", "n"])

    counted = linked.select("pairs", "times").mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted, "pairs").withColumn("second", F.col("pair").bitwiseAND(F.lit(_LOW)))
    most = counted.groupBy("second").agg(F.max("n").alias("most"))
    return counted.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, in_memory: int = 1 << 18) -> DataFrame:
    """Align the tokens of ``docs(doc_id, text)`` under a byte-level BPE and a sentencepiece model; one row per row, see ``ALIGNED``.

    Groups lie between byte offsets of space + text at which tokens of both end. A link is a pair of tokens that
    end together; ``count_sum`` adds up over a row's links how often their ids are linked in all rows, and
    ``n_best`` counts the links whose ids are linked as often as any of their second id.

    Each text is tokenised once; pairs with their times per row are written. The counts of the most frequent
    pairs, at most ``in_memory`` of them, go to every task (their number is fixed, so it is no broadcast that
    grows); all other pairs meet their counts in a shuffle join, of which only the rare pairs' rows are part.

    NULL or empty text, or one that a tokenizer does not give back byte for byte (U+2581 for a space, say): zeros and an
    empty digest. NULL or repeated doc_id: each row for itself. Extra columns are dropped. An empty table gives no rows.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), "text")
    linked = written(links(own, byte_path, piece_path), "links")
    counts = written(pair_counts(linked), "pair-counts")
    sizes = counts.groupBy(F.floor(F.log2("n") * 64).alias("size")).agg(F.count("*").alias("pairs")).orderBy(F.desc("size")).collect()  # at most 64 x 63 rows
    room, least = in_memory, None
    for size, pairs in sizes:
        if pairs > room:
            break
        room, least = room - pairs, size
    top = counts.where(F.floor(F.log2("n") * 64) >= (least if least is not None else 1 << 20))
    got = top.toArrow()
    order = np.argsort(np.asarray(got.column("pair")))
    pair, n, best = (np.asarray(got.column(c))[order] for c in ("pair", "n", "best"))
    del got

    def known(batches):
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("row", "pairs", "times")]
            row, lists, times = np.asarray(batch.column(at[0])), batch.column(at[1]), np.asarray(batch.column(at[2]).flatten())
            flat = np.asarray(lists.flatten())
            owner = np.repeat(np.arange(len(row)), np.asarray(lists.value_lengths()))
            place = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[place] == flat if len(pair) else np.zeros(len(flat), bool)
            total, good = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(total, owner[hit], n[place[hit]] * times[hit])
            np.add.at(good, owner[hit], best[place[hit]] * times[hit])
            rest = np.bincount(owner[~hit], minlength=len(row))
            cuts = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
            left = [pa.ListArray.from_arrays(cuts, pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(good), pa.array(total), *left], ["row", "n_best", "count_sum", "pairs", "times"])

    seen = written(linked.select("row", "pairs", "times").mapInArrow(known, "row long, n_best long, count_sum long, pairs array<bigint>, times array<bigint>"), "known")
    rare = seen.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    joined = rare.join(counts, "pair").select("row", F.col("best").cast("long") * F.col("times"), F.col("n") * F.col("times"))
    both = seen.select("row", "n_best", "count_sum").union(joined).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return linked.drop("pairs", "times").join(both, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
