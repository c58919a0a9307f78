"""SpotSigs document fingerprints. Built-in functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common words of English, French, German and Spanish whose occurrences anchor a chain (fixed values).
ANCHORS = """
a an and are as at be been but by can for from had has have he her his how i if in into is it its more my no not of on one or our she so some than that the their them then there these
they this to up was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me mes moi ne nos nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
aber als am auch auf aus bei bin bis da das dass dem den der die dieser doch du durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur ob
oder sich sie sind so um und uns von vor war was wenn wer wie wir wird zu zum zur über
al algo ante como con contra cual cuando del desde donde e el ella ellos entre era ese eso esta este esto fue ha hasta hay la las lo los me mi mis muy más ni nos o otra para pero por porque
que quien se ser si sin sobre son soy su sus también te tiene todo tu un una uno y ya
""".split()  # fmt: skip


def with_spots(df: DataFrame, text: str, out: str, chain: int = 2, gap: int = 8, least: int = 8, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add ``out``: the sorted distinct signatures (32-bit hashes) of the text column ``text``.

    Words are lower-cased runs of letters and digits. A signature is an anchor word and the next
    ``chain`` content words (words that are no anchors); at the end of the text it may hold fewer,
    but at least one. Where two anchors (or an anchor and an end of the text) lie more than ``gap`` words
    apart, as in tables, each word between them is an anchor, too; a text with under ``least`` anchors
    counts every word as one. NULL or a text without letters and digits: an empty set.
    """
    w, at, content = (f"__{out}_{x}" for x in ("words", "anchors", "content"))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    df = df.withColumn(w, words)
    df = df.withColumn(at, F.filter(F.transform(F.col(w), lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull()))
    df = df.withColumn(content, F.filter(F.col(w), lambda x: ~x.isin(anchors)))

    def spot(anchor: Column, source: str, first: Column) -> Column:
        following = [F.coalesce(F.get(F.col(source), first + k), F.lit("")) for k in range(chain)]
        return F.when(F.get(F.col(source), first).isNotNull(), F.hash(anchor, *following))

    # the j-th anchor has (its position - j) content words before it
    by_anchor = F.transform(F.col(at), lambda i, j: spot(F.get(F.col(w), i), content, i - j))
    ends = F.concat(F.array(F.lit(-1)), F.col(at), F.array(F.size(w)))
    between = F.flatten(F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.when(b - a > gap, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<int>"))))
    by_gap = F.transform(between, lambda i: spot(F.get(F.col(w), i), w, i + 1))
    every = F.transform(F.col(w), lambda x, i: spot(x, w, i + 1))
    found = F.concat(by_anchor, F.when(F.size(at) < least, every).otherwise(by_gap))
    found = F.when((F.size(w) == 1), F.array(F.hash(F.get(F.col(w), F.lit(0))))).otherwise(found)
    return df.withColumn(out, F.sort_array(F.array_distinct(F.array_compact(found)))).drop(w, at, content)


def fingerprint(spots: Column) -> Column:
    """A set of signatures as text: sorted hexadecimal numbers."""
    return F.array_join(F.transform(spots, lambda h: F.lower(F.hex(F.pmod(h.cast("long"), F.lit(1 << 32))))), " ")


def length_partition(spots: Column, threshold: float) -> Column:
    """Number of the length partition: sets of Jaccard similarity ``threshold`` or more lie in the same or neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(spots), F.lit(1))) / math.log(1 / threshold)).cast("int")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sorted sets, 1 for two empty ones.

    Pruned: sets more than one length partition apart for ``threshold``, or whose ranges of hashes
    do not meet, are not intersected (the first get NULL, the others 0).
    """
    low, high = F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0))), F.least(F.element_at(a, -1), F.element_at(b, -1))
    common = F.size(F.array_intersect(a, b))
    exact = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (low > high), 0.0)
    exact = exact.when(a == b, 1.0).otherwise(F.transform(F.array(common), lambda c: c / (F.size(a) + F.size(b) - c))[0])
    return F.when(F.abs(length_partition(a, threshold) - length_partition(b, threshold)) <= 1, exact) if threshold > 0 else exact


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_spots, fingerprint of each row of ``docs(doc_id, text)``; NULL text counts as empty, extra columns are dropped."""
    out = with_spots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "spots")
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("spots").alias("n_spots"), fingerprint(F.col("spots")).alias("fingerprint"))


def _part(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above ``key``: a binary search."""
    if not bounds:
        return F.lit(0)
    array = F.array(*(F.lit(int(b)) for b in bounds)) if len(bounds) < 2 else F.lit(bounds)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(array, mid) <= key
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, columns: list[str], rows_each: int = 4000, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Add ``next_<column>`` of the next row by ascending doc_id (equal ids by text, NULL first); the last row's next is the first.

    ``prepare`` adds columns to the rows once they are chosen, before they are shuffled.

    Rows are dealt by ranges of doc_id (at most 16384 quantiles) and ordered within each; the first
    row of a range also stands as a guest at the end of the range before, so one shuffle is enough.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    count = docs.count()
    if not count:
        docs = prepare(docs)
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    parts = min(16384, -(-count // rows_each))
    steps = F.percentile_approx(key, [i / parts for i in range(1, parts)], parts * 20) if parts > 1 else F.array()
    bounds = sorted(set(docs.select(steps.alias("b")).first()["b"] or []))
    placed = docs.withColumn("__key", key).withColumn("__part", _part(F.col("__key"), bounds))
    heads = sorted((r["__part"], r["k"]) for r in docs.select(key.alias("__key")).withColumn("__part", _part(F.col("__key"), bounds)).groupBy("__part").agg(F.min("__key").alias("k")).collect())
    before = [0] * (len(bounds) + 1)  # the range that a range's first row follows; at most 16384 of both
    for i, (part, _) in enumerate(heads):
        before[part] = heads[i - 1][0]
    guests = placed.where(F.col("__key").isin([k for _, k in heads])).withColumn("__part", F.get(F.lit(before), F.col("__part")))
    both = prepare(placed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1))))
    order = Window.partitionBy("__part").orderBy("__guest", "__key", "text")
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("__guest = 0").drop("__key", "__part", "__guest")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, in which the next document's beginning stands for the last quarter.

    One row per row of ``docs(doc_id, text)``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. NULL text counts as empty: its edited text is empty, too.
    Extra columns are dropped; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(own, ["text", "spots"], prepare=lambda d: with_spots(d, "text", "spots"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), F.substr(F.col("next_text"), F.lit(1), quarter)))
    df = with_spots(df.drop("next_text"), "edited", "edited_spots")
    return df.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
