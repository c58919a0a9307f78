"""Substring dedup: hashed runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import BitTable, Out, rows, signed, written

_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_WORD = re.compile(r"\S+\s*")


def sentences(text: str | None, longest: int = 20) -> list[str]:
    """Pieces of a text that joined give it back: sentences with the white space after them.

    A sentence ends after ``.``, ``!`` or ``?`` before white space, or at a line break. One of more
    than ``longest`` words is cut after every ``longest`` words. Only white space: one piece.
    """
    if not text:
        return []
    out, at = [], 0
    for end in [m.end() for m in _END.finditer(text)] + [len(text)]:
        part = text[at:end]
        if not part:
            continue
        if part.count(" ") < longest:
            out.append(part)
        else:
            words = [m.end() for m in _WORD.finditer(part)]
            cuts = [0, *words[longest - 1 : -1 : longest], len(part)]
            out += [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        at = end
    return out


def runs(parts: list[str], several: int, least_words: int) -> list[tuple[int, int, int]]:
    """(hash, start, length) of the run at each start: ``several`` sentences, and more until it has ``least_words`` words."""
    words = [p.split() for p in parts]
    digest = [xxhash.xxh3_64_intdigest(" ".join(w).lower()) for w in words]
    out, end, held = [], 0, 0
    for start in range(len(parts)):
        while end < len(parts) and (end - start < several or held < least_words):
            held += len(words[end])
            end += 1
        if end - start < several or held < least_words:
            break
        packed = b"".join(d.to_bytes(8, "little") for d in digest[start:end])
        out.append((signed(xxhash.xxh3_64_intdigest(packed)), start, end - start))
        held -= len(words[start])
    return out


def drop_repeats(docs: DataFrame, several: int = 3, least_words: int = 15) -> DataFrame:
    """Remove sentences that lie in a repeated run of sentences which is not the run's first occurrence.

    One row per row of ``docs(doc_id, text)``: doc_id, text (what is left, unchanged where nothing was
    removed), n_sentences, n_removed, n_chars (code points left), first_docs (documents that hold the
    first occurrence of removed runs, ascending). Runs are compared with white space as one space and
    without case; occurrences are ordered by (doc_id with NULL first, row, sentence). Runs inside
    one document count too.

    Counting is a group-by with partial sums; only runs in the repeated ones' bit table meet them again
    in a shuffle join, which AQE splits where one run is in very many documents.

    NULL, empty or blank text: nothing to remove, text kept as it is. Of repeated rows the first keeps
    its text. Extra columns are dropped; an empty table gives no rows.
    """

    def hashed(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int32()), ("run", pa.list_(pa.int64())), ("start", pa.list_(pa.int32())), ("length", pa.list_(pa.int32()))])
        out = Out(schema, 500)
        for doc_id, text in rows(batches, "doc_id", "text"):
            parts = sentences(text)
            found = runs(parts, several, least_words)
            out.add(doc_id, text, len(parts), *([f[i] for f in found] for i in range(3)))
            if out.full():
                yield out.batch()
        yield out.batch()

    held = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(hashed, "doc_id long, text string, n_sentences int, run array<long>, start array<int>, length array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
        "sentence-runs",
    )
    each = held.select("doc_id", "row", F.explode(F.arrays_zip("run", "start", "length")).alias("x")).select("doc_id", "row", "x.run", "x.start", "x.length")
    repeated = written(
        each.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("first")).where("n > 1").select("run", "first.doc_id", "first.row", "first.start"),
        "repeated-runs",
    ).toDF("run", "first_doc", "first_row", "first_start")
    table = BitTable.of(repeated.select("run"))

    def possible(batches):
        for batch in batches:
            yield batch.filter(pa.array(table.hit(batch.column("run").to_numpy().astype("int64").view("uint64"))))

    again = each.select("run", "row", "start", "length").mapInArrow(possible, "run long, row long, start int, length int").join(repeated, "run")
    covered = (
        again.where("row <> first_row or start <> first_start")
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", "length")).alias("gone"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
    )

    def cut(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("n_chars", pa.int64()), ("first_docs", pa.list_(pa.int64()))])
        out = Out(schema, 500)
        for doc_id, text, n, gone, first in rows(batches, "doc_id", "text", "n_sentences", "gone", "first_docs"):
            removed = {i for g in gone or () for i in range(g["start"], g["start"] + g["length"])}
            if removed:
                text = "".join(p for i, p in enumerate(sentences(text)) if i not in removed)
            out.add(doc_id, text, n, len(removed), len(text or ""), first or [])
            if out.full():
                yield out.batch()
        yield out.batch()

    left = held.select("row", "doc_id", "text", "n_sentences").join(covered, "row", "left")
    return left.select("doc_id", "text", "n_sentences", "gone", "first_docs").mapInArrow(cut, "doc_id long, text string, n_sentences int, n_removed int, n_chars long, first_docs array<long>")
