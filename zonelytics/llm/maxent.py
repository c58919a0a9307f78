"""Language-model scores from a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import ascii_words, mix, rows, seeded, shuffles_deleted, word_keys, written

END = b"\x00 end"  # white space keeps it apart from every word
BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 17  # rows of the weight table, by the words told apart
HEADS, GROUPS = 10, 14
CLASSES = HEADS + GROUPS
FEATURES = 4
#: a training task reads so many tokens on average, or all: however few, they change up to ``MOST_BUCKETS`` rows, which it sends
TASK_TOKENS = 1 << 21


#: a frequent word of at least this count has a feature number of its own, all others share that of their group
TOLD_APART = 2


@dataclass
class Words:
    """The bounded part of the word statistics that every task gets, and the class factors."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # frequent words, sorted
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # each a class of its own
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))  # of each group, without heads
    types: np.ndarray = field(default_factory=lambda: np.zeros(GROUPS))
    head_tokens: np.ndarray = field(default_factory=lambda: np.zeros(HEADS))
    discount: float = 0.5
    total: int = 0
    distinct: int = 0

    def inside(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of P(word | class): 1 for a head; in a group (c - D) / N, and D * V / N for its unseen word."""
        g = np.maximum(cls - HEADS, 0)
        n, v = self.tokens[g], self.types[g]
        p = np.where(count > 0, count - self.discount, self.discount * v) / np.maximum(n, 1)
        return np.log10(np.where((cls < HEADS) | (n == 0), 1.0, np.maximum(p, 1e-300)))

    def classes(self) -> np.ndarray:
        """Log frequencies of the classes, where training starts."""
        n = np.concatenate([self.head_tokens, self.tokens]) + 1.0
        return np.log(n / n.sum()).astype(np.float32)

    @property
    def buckets(self) -> int:
        """Rows of the weight table: four for each word told apart, within bounds, as a power of two."""
        return min(MOST_BUCKETS, max(BUCKETS, 1 << int(4 * (self.counts >= TOLD_APART).sum()).bit_length()))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


@cache
def _groups() -> np.ndarray:
    """Group of a word by its last two bytes as a number; by 2^16 and its byte, if it has one; last of the empty word."""
    ends = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)] + [b""]
    return np.array([xxhash.xxh32_intdigest(x) % GROUPS for x in ends], np.int64)


def groups_of(words: list[bytes]) -> np.ndarray:
    """Group of each word, by a hash of its last two bytes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters, ends = np.frombuffer(b"  " + b"".join(words), np.uint8), np.cumsum(sizes) + 2
    two = letters[ends - 1] + np.where(sizes > 1, letters[ends - 2].astype(np.int64) << 8, 1 << 16)
    return _groups()[np.where(sizes > 0, two, -1)]


class Lexicon:
    """Key, class, feature number and count (-1: not among the frequent) of words, for ``remembered`` words at a time."""

    def __init__(self, words: Words, remembered: int = 500_000):
        self.words, self.remembered = words, remembered
        bits = max(1, len(words.keys).bit_length())  # keys are hashes: hardly more than one begins with the same bits
        self.low = np.uint64(64 - bits)
        self.start = np.append(np.searchsorted(words.keys, np.arange(1 << bits, dtype=np.uint64) << self.low), len(words.keys))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out, w = np.full(len(keys), -1), self.words
        first = (keys >> self.low).astype(np.int64)
        at, end = self.start[first], self.start[first + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            hit = w.keys[at] == wanted
            out[left[hit]] = w.counts[at[hit]]
            more = ~hit & (at + 1 < end)
            left, at, end, wanted = left[more], at[more] + 1, end[more], wanted[more]
        return out

    def _look(self, words: list[bytes]) -> np.ndarray:
        keys, group = word_keys(words), groups_of(words)
        cls, count = group + HEADS, self.counts(keys)
        for i, head in enumerate(self.words.heads):
            cls[keys == head] = i
        return np.stack([keys.view(np.int64), cls, np.where(count >= TOLD_APART, keys.view(np.int64), group), count], axis=1)

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(words) <= self.remembered:
            return self._look(words)
        return np.concatenate([self._look(words[at : at + self.remembered]) for at in range(0, len(words), self.remembered)])


def features(number: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed features of each token from the three before it: previous word, bigram, and the words two and three back."""
    n = len(number)
    back = np.zeros((3, n), np.uint64)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    for k in (1, 2, 3):
        back[k - 1, k:] = number[:-k].astype(np.uint64) + np.uint64(1) if n > k else 0
        back[k - 1, since < k] = 0
    one, two, three = back
    raw = (one * seeded("one"), one * seeded("pair") + mix(two + seeded("of")), two * seeded("skip one"), three * seeded("skip two"))
    return np.stack([mix(x + np.uint64(i)) & np.uint64(buckets - 1) for i, x in enumerate(raw)], axis=1).astype(np.int32)


def raised(weights: np.ndarray, bias: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logarithms of what the classes' probabilities are in proportion to, the largest 0."""
    z = bias + weights.take(x[:, 0], axis=0)
    for i in range(1, FEATURES):
        z += weights.take(x[:, i], axis=0)
    most = z
    while most.shape[1] > 1:  # halves of the columns at once are cheaper than a maximum per row
        half = most.shape[1] // 2
        most = np.maximum(most[:, :half], most[:, half : 2 * half]) if most.shape[1] % 2 == 0 else np.maximum(most[:, : half + 1], most[:, half:])
    z -= most
    return z


def log_classes(weights: np.ndarray, bias: np.ndarray, x: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities of all classes, or of each row's class in ``cls``."""
    z = raised(weights, bias, x)
    total = np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z - total if cls is None else z[np.arange(len(cls)), cls] - total[:, 0]


def sums_of_runs(values: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(values[order], at, axis=0)``, to the bit, without its cost per run and column for runs of one to three rows."""
    n = np.diff(np.append(at, len(order)))
    out = values.take(order[at], axis=0)
    two = np.flatnonzero(n == 2)
    out[two] += values.take(order[at[two] + 1], axis=0)
    three = np.flatnonzero(n == 3)
    out[three] += values.take(order[at[three] + 1], axis=0) + values.take(order[at[three] + 2], axis=0)
    more = np.flatnonzero(n > 3)
    if len(more):
        m = n[more]
        starts = np.cumsum(m) - m
        out[more] = np.add.reduceat(values.take(order[np.repeat(at[more] - starts, m) + np.arange(m.sum())], axis=0), starts, axis=0)
    return out


def descend(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, x: np.ndarray, cls: np.ndarray, rate: float) -> None:
    """One mini-batch of gradient ascent on the log likelihood of the classes, with a step per feature (Adagrad)."""
    error = raised(weights, bias, x)
    np.exp(error, out=error)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(cls)), cls] -= 1.0
    bias -= rate * error.mean(axis=0)
    for i in range(FEATURES):
        low = np.argsort(x[:, i].astype(np.uint16), kind="stable")  # 16 bits are sorted by radix, then what is above them
        order = low[np.argsort((x[low, i] >> 16).astype(np.uint16), kind="stable")]
        ranked = x[order, i]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        rows_, grad = ranked[at], sums_of_runs(error, order, at)
        now = seen[rows_] + (grad * grad).mean(axis=1)
        seen[rows_] = now
        grad *= np.float32(rate)
        grad /= np.sqrt(now + 1.0)[:, None]
        weights[rows_] = weights.take(rows_, axis=0) - grad


def _slices(batches, lexicon: Lexicon, tokens: int = 100_000):
    """Documents of at least one, and then up to about ``tokens`` tokens, with their word tables as one: (ids, sizes, table)."""
    ids, sizes, words = [], [], []
    for doc_id, text in rows(batches, "doc_id", "text"):
        before = len(words)
        words += ascii_words(text)
        words.append(END)
        ids.append(doc_id)
        sizes.append(len(words) - before)
        if len(words) >= tokens:
            yield ids, sizes, lexicon.look(words)
            ids, sizes, words = [], [], []
    if ids:
        yield ids, sizes, lexicon.look(words)


def count_words(docs: DataFrame) -> DataFrame:
    """key, grp, n of every word of ``docs(text)``, the end token included, written once."""

    def count(batches):
        held: Counter = Counter()

        def batch():
            words = list(held)
            group = groups_of(words).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(word_keys(words).view(np.int64)), pa.array(group), pa.array(list(held.values()), pa.int64())], ["key", "grp", "n"])
            held.clear()
            return out

        for (text,) in rows(batches, "text"):
            held.update(ascii_words(text))
            held[END] += 1
            if len(held) > 800_000:
                yield batch()
        yield batch()

    return written(docs.select("text").mapInArrow(count, "key long, grp int, n long").groupBy("key").agg(F.first("grp").alias("grp"), F.sum("n").alias("n")), "word-counts")


def summarise(counts: DataFrame, frequent: int = 1 << 18) -> Words:
    """The bounded statistics. The frequent words are those above a count under which at most ``frequent`` words stay out."""
    total = counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    if not total[0]:
        return Words()
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()  # a few hundred rows
    room, least = frequent, None
    for r in levels:
        room -= r["k"]
        if room < 0:
            break
        least = r["level"]
    top = counts.where(level >= least).select("key", "n").toArrow() if least is not None else counts.select("key", "n").limit(0).toArrow()
    keys, n = np.asarray(top.column("key")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.int64)
    by_count = np.lexsort((keys, -n))
    order = np.argsort(keys)
    heads = keys[by_count[:HEADS]]
    groups = counts.where(~F.col("key").isin([int(k) for k in heads.view(np.int64)])).groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    out = Words(keys[order], n[order], heads, total=total[0], distinct=total[1])
    out.head_tokens[: len(heads)] = n[by_count[:HEADS]]
    out.discount = total[2] / (total[2] + 2 * total[3]) if total[2] and total[3] else 0.5
    for r in groups:
        out.tokens[r["grp"]], out.types[r["grp"]] = r["n"], r["v"]
    return out


def train(docs: DataFrame, words: Words, rounds: int = 1, rate: float = 0.2, batch: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Class weights by distributed gradient updates over all of ``docs(text)``.

    In a round every task makes one pass of mini-batch updates over its documents, starting from the
    current weights, and returns its changed rows with the tokens that touched each; per row the
    changes are averaged by those tokens. The model has ``words.buckets`` rows of ``CLASSES`` weights.
    Small partitions are read together, so that the rows sent grow with the tokens, not with the partitions.
    """
    buckets, docs = words.buckets, docs.coalesce(max(1, math.ceil(words.total / TASK_TOKENS)))
    weights, bias = np.zeros((buckets, CLASSES), np.float32), words.classes()

    def work(batches):
        w, b, seen, touched = weights.copy(), bias.copy(), np.zeros(buckets, np.float32), np.zeros(buckets, np.int64)
        tokens = 0
        for _, sizes, table in _slices(batches, Lexicon(words)):
            starts = np.append(0, np.cumsum(sizes)[:-1])
            x, cls = features(table[:, 2], starts, buckets), table[:, 1]
            for i in range(FEATURES):
                touched += np.bincount(x[:, i], minlength=buckets)
            for at in range(0, len(cls), batch):
                descend(w, b, seen, x[at : at + batch], cls[at : at + batch], rate)
            tokens += len(cls)
        at = np.flatnonzero(touched)
        change, n = np.concatenate([w[at] - weights[at], (b - bias)[None]]), np.append(touched[at], tokens)
        name = np.append(at, buckets)
        for lo in range(0, len(name), 8192):
            part = slice(lo, lo + 8192)
            scaled = (change[part] * n[part, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(name[part]), pa.array(n[part]), *(pa.array(scaled[:, c]) for c in range(CLASSES))], ["row", "n", *(f"c{c}" for c in range(CLASSES))])

    schema = "row long, n long, " + ", ".join(f"c{c} float" for c in range(CLASSES))
    for _ in range(rounds):
        with shuffles_deleted(docs.sparkSession):
            sums = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(work, schema).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(f"c{c}").alias(f"c{c}") for c in range(CLASSES)))
            got = sums.toArrow()  # at most MOST_BUCKETS + 1 rows
        at, n = np.asarray(got.column("row")), np.maximum(np.asarray(got.column("n")), 1)
        mean = (np.stack([np.asarray(got.column(f"c{c}")) for c in range(CLASSES)], axis=1) / n[:, None]).astype(np.float32) if len(at) else np.zeros((0, CLASSES), np.float32)
        inner = at < buckets
        weights[at[inner]] += mean[inner]
        bias += mean[~inner].sum(axis=0)
    return weights, bias


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Score each row of ``docs(doc_id, text)`` with a model learned from all of ``training(text)``.

    doc_id, n_tokens, n_known, train_tokens, base_score, score. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased, then one end token. The model is P(class | the two tokens before) * P(word | class): the
    ``HEADS`` most frequent words are classes of their own, all others fall into ``GROUPS`` classes by
    their last two bytes; the first factor is a softmax over hashed n-gram and skip features,
    the second an absolutely discounted frequency, whose discount is the class's one unseen word.

    Counts of the frequent words (a bounded table) are looked up in the task; all rarer words of a
    document meet the counts in a shuffle join and come back as three sums.

    NULL or empty text: the end token alone. NULL and repeated doc_id are kept row by row; extra
    columns are dropped. Without training rows all words are unseen.
    """
    counts = count_words(training)
    words = summarise(counts)
    weights, bias = train(training, words)
    log10e = 1 / math.log(10)

    def apply(batches):
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("part", pa.float64()), ("key", pa.list_(pa.int64())), ("cls", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]
        )
        for ids, sizes, table in _slices(batches, Lexicon(words), 30_000):
            starts = np.append(0, np.cumsum(sizes)[:-1])
            x, cls, count = features(table[:, 2], starts, words.buckets), table[:, 1], table[:, 3]
            logs = log_classes(weights, bias, x, cls) * log10e
            has = count >= 0
            safe = np.maximum(count, 0)
            part = np.add.reduceat(logs + np.where(has, words.inside(safe, cls), 0.0), starts)
            base = np.add.reduceat(np.where(has, words.base(safe), 0.0), starts)
            known = np.add.reduceat(has.astype(np.int64), starts)
            rare, doc = np.flatnonzero(~has), np.repeat(np.arange(len(ids)), sizes)
            rare = rare[np.lexsort((table[rare, 0], doc[rare]))]
            key, doc = table[rare, 0], doc[rare]
            first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(doc) != 0))[: len(rare)])  # each document's distinct rare words
            n = np.diff(np.append(first, len(rare)))
            lists = np.searchsorted(doc[first], np.arange(len(ids) + 1)).astype(np.int32)
            rare_words = (pa.ListArray.from_arrays(lists, v) for v in (key[first], cls[rare[first]].astype(np.int32), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, (known, base, part)), *rare_words], schema=schema)

    schema = "doc_id long, n_tokens long, n_known long, base double, part double, key array<long>, cls array<int>, n array<int>"
    done = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, schema).withColumn("row", F.monotonically_increasing_id()), "scored-parts")
    rare = done.select("row", F.explode(F.arrays_zip("key", "cls", "n")).alias("x")).select("row", "x.key", "x.cls", F.col("x.n").alias("times")).join(counts.select("key", F.col("n").alias("c")), "key", "left")
    c, group = F.coalesce("c", F.lit(0)), F.col("cls") - HEADS
    tokens, types = (F.get(F.lit([float(v) for v in values]), group) for values in (words.tokens, words.types))
    inside = F.when(tokens == 0, 0.0).otherwise(F.log10(F.when(c > 0, c - words.discount).otherwise(words.discount * types) / tokens))
    base = F.log10((c + 0.1) / (words.total + 0.1 * (words.distinct + 1)))
    sums = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(base * F.col("times")).alias("more_base"), F.sum(inside * F.col("times")).alias("more")
    )
    zero = F.lit(0.0)
    return done.select("row", "doc_id", "n_tokens", "n_known", "base", "part").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("part") + F.coalesce("more", zero)).alias("score"),
    )
