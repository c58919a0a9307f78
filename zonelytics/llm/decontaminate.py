"""Benchmark decontamination: spaced-seed hashing and substitution-tolerant overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import BitTable, Out, mix, plain_words, rows, seeded, word_keys, written

#: 1: the token counts, 0: it may differ. Any 9 tokens with one substitution, 12 with two or 16 with three hold a hit of one of them.
MASKS = ("111111", "11101011", "110110011", "1100101101")
LEAKS = "doc_id long, item_id long, doc_start long, item_start long, length long, matched long, item_tokens long"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash per start position over the tokens that ``mask`` counts."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            h += words[i : i + n] * seeded(f"{mask} {i}")
    return mix(h)


def fresh(h: np.ndarray) -> np.ndarray:
    """Positions whose seed differs from the one before: a run of one repeated token counts once."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


def best_overlap(a: np.ndarray, b: np.ndarray, share: float, least: int = 1) -> tuple[int, int, int]:
    """(start, length, matches) of the stretch of two aligned sequences whose matches exceed ``share`` by most; the first of equals.

    Only stretches of ``least`` or more count. (0, 0, 0) where none of them reaches ``share``.
    """
    if len(a) < least:
        return 0, 0, 0
    same = (a == b).astype(np.float64)
    total = np.round(np.append(0.0, np.cumsum(same - share)), 9)
    low = np.minimum.accumulate(total[: len(total) - least])
    excess = np.round(total[least:] - low, 9)
    end = int(np.argmax(excess)) + least
    if excess[end - least] < 0:
        return 0, 0, 0
    start = int(np.argmin(total[: end - least + 1]))
    return start, end - start, int(same[start:end].sum())


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = 13, share: float = 0.8, reach: int = 64, filter_bits: int = 1 << 26) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap; columns ``LEAKS``, the longest overlap of each pair.

    Tokens are lower-cased words without ASCII punctuation. A pair is reported when, on one alignment,
    a stretch of ``least`` tokens (the whole item, if that is shorter) agrees in ``share`` of them or more.

    Benchmark seeds fill a bit table of ``filter_bits`` (its size does not depend on the data). A
    document keeps the stretches within ``reach`` tokens of seeds that pass the table: one row per
    stretch, with its tokens and those seeds. Their seeds meet the benchmark's in a shuffle join,
    hits become alignments, and each alignment is compared once. A hot seed is split by AQE's skew
    join; equal items are compared once and joined to their ids at the end.

    NULL or empty texts, and items shorter than every mask, overlap with nothing. NULL and repeated
    ids are kept: every row of either table counts. Extra columns are dropped; empty tables give no rows.
    """
    def item_seeds(batches):
        out = Out(pa.schema([("item_id", pa.int64()), ("item", pa.int64()), ("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]), 500)
        for item_id, text in rows(batches, "item_id", "text"):
            words = word_keys(plain_words(text))
            found = [(h[at], at) for h in (seeds(words, m) for m in masks) for at in [fresh(h)]]
            h, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(h):
                out.add(item_id, int(mix(np.array([len(words), *words], np.uint64)).sum().astype(np.int64)), words.view(np.int64), h.view(np.int64), at.astype(np.int32))
            if out.full():
                yield out.batch()
        yield out.batch()

    known = written(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_seeds, "item_id long, item long, tokens array<long>, seeds array<long>, at array<int>"),
        "benchmark-seeds",
    )
    items = known.dropDuplicates(["item"])
    pairs = items.select("item", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at"))

    table = BitTable.of(items.select("seeds"), filter_bits)

    def stretches(batches):
        out = Out(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))]), 500)
        for doc_id, text in rows(batches, "doc_id", "text"):
            words = word_keys(plain_words(text))
            hs, ats = [], []
            for m in masks:
                h = seeds(words, m)
                at = fresh(h)
                at = at[table.hit(h[at])]
                hs.append(h[at])
                ats.append(at)
            at = np.concatenate(ats)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h = at[order], np.concatenate(hs)[order]
            cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
                start = max(0, int(at[a]) - reach)
                part = words[start : int(at[b - 1]) + 2 * reach]
                out.add(doc_id, start, part.view(np.int64), h[a:b].view(np.int64), (at[a:b] - start).astype(np.int32))
            if out.full():
                yield out.batch()
        yield out.batch()

    found = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(stretches, "doc_id long, start long, words array<long>, seeds array<long>, at array<int>")
        .withColumn("stretch", F.monotonically_increasing_id()),
        "benchmark-hits",
    )
    hits = (
        found.select("stretch", F.explode(F.arrays_zip("seeds", "at")).alias("s"))
        .select("stretch", F.col("s.seeds").alias("seed"), F.col("s.at").alias("doc_at"))
        .join(pairs, "seed")
        .select("stretch", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .distinct()
    )

    def compare(batches):
        out = Out(pa.schema([(n, pa.int64()) for n in ("doc_id", "item", "doc_start", "item_start", "length", "matched", "item_tokens")]))
        for doc_id, start, item, shift, words, tokens in rows(batches, "doc_id", "start", "item", "shift", "words", "tokens"):
            lo, hi = max(0, -shift), min(len(tokens), len(words) - shift)
            if hi <= lo:
                continue
            at, length, matched = best_overlap(np.array(words[lo + shift : hi + shift]), np.array(tokens[lo:hi]), share - 1e-9, min(least, len(tokens)))
            if length:
                out.add(doc_id, item, start + lo + shift + at, lo + at, length, matched, len(tokens))
            if out.full():
                yield out.batch()
        yield out.batch()

    compared = (
        hits.join(found.select("stretch", "doc_id", "start", "words"), "stretch")
        .join(items.select("item", "tokens"), "item")
        .mapInArrow(compare, "doc_id long, item long, doc_start long, item_start long, length long, matched long, item_tokens long")
    )
    first = F.struct(-F.col("matched"), "length", "doc_start", "item_start", "matched", "item_tokens")
    best = compared.groupBy("doc_id", "item").agg(F.min(first).alias("b")).select("doc_id", "item", "b.doc_start", "b.item_start", "b.length", "b.matched", "b.item_tokens")
    return best.join(known.select("item_id", "item"), "item").select("doc_id", "item_id", "doc_start", "item_start", "length", "matched", "item_tokens")
