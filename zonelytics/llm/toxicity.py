"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import BitTable, Out, discard, plain_words, release, rows, written

SCORES = "doc_id long, score double, predicted int, neighbours array<long>, similarities array<double>, terms array<string>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()),
        ("neighbours", pa.list_(pa.int64())), ("similarities", pa.list_(pa.float64())), ("terms", pa.list_(pa.string())),
    ]
)
_PREFIXES = (4, 5, 6)


def words(text: str | None) -> list[str]:
    return b" ".join(plain_words(text)).decode().split(" ") if text else []


def word_terms(word: str) -> list[str]:
    """The word itself and its beginnings (``stem*``), which inflected forms share."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


def _counted(labelled: DataFrame, keep: frozenset[str] | None, schema: str = "term string, toxic int, n long") -> DataFrame:
    """Documents of either label that hold each term, counted per task and then summed."""

    def summed(found):
        for toxic, counts in found.items():
            items = list(counts.items())
            counts.clear()
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], ["term", "toxic", "n"]
                )

    def count(batches):
        release()
        found = {0: Counter(), 1: Counter()}
        known: dict[str, tuple[str, ...]] = {}
        for text, toxic in rows(batches, "text", "toxic"):
            terms: set[str] = set()
            for w in set(words(text)):
                got = known.get(w)
                if got is None:
                    if len(known) > 100_000:
                        known.clear()
                    got = known[w] = tuple(t for t in word_terms(w) if keep is None or t in keep)
                terms.update(got)
            found[toxic].update(terms)
            if len(found[0]) + len(found[1]) > 500_000:
                yield from summed(found)
        yield from summed(found)

    return labelled.select("text", "toxic").mapInArrow(count, schema).groupBy("term", "toxic").agg(F.sum("n").alias("n"))


class Index:
    """Exact top-k cosine. Examples lie in blocks of ``block``; each term keeps its largest weight per block.

    A block whose bound (query weight times block maximum, summed over the query's terms) is below
    the k-th similarity found so far cannot hold a nearer example and is skipped. The ``probe`` blocks
    of the highest bounds come one by one, what then remains together. Equal similarities are taken by
    smaller example number.
    """

    def __init__(self, vectors: list[list[tuple[int, float]]], terms: int, block: int = 64):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        by_term: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for i, v in enumerate(vectors):
            norm = math.sqrt(sum(w * w for _, w in v))
            for t, w in v:
                by_term[t].append((i, w / norm))
        self.docs = [np.array([i for i, _ in p], np.int64) for p in by_term]
        self.weights = [np.array([w for _, w in p]) for p in by_term]
        self.ends = [np.searchsorted(d, np.arange(self.blocks + 1) * block) for d in self.docs]
        self.most = [np.maximum.reduceat(np.append(w, 0.0), np.minimum(e[:-1], len(w))) * (np.diff(e) > 0) if len(w) else np.zeros(self.blocks) for w, e in zip(self.weights, self.ends, strict=True)]

    def nearest(self, query: list[tuple[int, float]], k: int, probe: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and similarities, nearest first; only similarities above 0."""
        norm = math.sqrt(sum(w * w for _, w in query)) or 1.0
        query = [(t, w / norm) for t, w in query if len(self.docs[t])]
        bound = sum((w * self.most[t] for t, w in query), np.zeros(self.blocks))
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        ids, sims, least, at = np.zeros(0, np.int64), np.zeros(0), 0.0, 0

        def best(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = np.lexsort((ids, -np.round(sims, 12)))[:k]
            return ids[top], sims[top]

        while at < len(order) and (len(ids) < k or bound[order[at]] >= least - 1e-12) and at < probe:
            b = order[at]
            got = np.zeros(self.block)
            for t, w in query:
                lo, hi = self.ends[t][b], self.ends[t][b + 1]
                got[self.docs[t][lo:hi] - b * self.block] += w * self.weights[t][lo:hi]
            hit = np.flatnonzero(got > 0)
            ids, sims = best(np.append(ids, hit + b * self.block), np.append(sims, got[hit]))
            least, at = (sims[-1] if len(sims) else 0.0), at + 1
        left = order[at:][bound[order[at:]] >= (least - 1e-12 if len(ids) >= k else 0.0)]
        if len(left):  # many blocks may still hold a nearer example: all of them at once, term by term
            got = np.zeros(self.blocks * self.block)
            for t, w in query:
                got[self.docs[t]] += w * self.weights[t]
            part = got.reshape(self.blocks, self.block)[left]
            row, col = np.nonzero(part)
            ids, sims = best(np.append(ids, left[row] * self.block + col), np.append(sims, part[row, col]))
        return ids, sims


class Model:
    """What scoring needs: selected terms, their weights, the index of examples and their votes. Bounded by ``fit``'s parameters."""

    def __init__(self, terms: dict[str, tuple[int, float]], examples: list[tuple[list[int], list[int], int, int, int]], empty: tuple[float, float], base: float, k: int, shrink: float):
        self.terms, self.k, self.shrink, self.base = terms, k, shrink, base
        self.idf = [w for _, w in sorted(terms.values())]
        self.names = [t for t, _ in sorted(terms.items(), key=lambda x: x[1][0])]
        self.toxic, self.total, self.doc = (np.array([e[i] for e in examples], np.float64 if i < 4 else np.int64) for i in (2, 3, 4))
        self.index = Index([self.weighted(e[0], e[1]) for e in examples], len(terms))
        self.bare = (empty[0] + shrink * base) / (empty[1] + shrink)
        self.position = {tuple(zip(e[0], e[1], strict=True)): i for i, e in enumerate(examples)}
        self.curve, self.learnt = ([0.0, 1.0], [0.0, 1.0]), 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.voted: dict[tuple, tuple] = {}

    def weighted(self, terms: list[int], counts: list[int]) -> list[tuple[int, float]]:
        return [(t, (1 + math.log(n)) * self.idf[t]) for t, n in zip(terms, counts, strict=True)]

    def vector(self, text: str | None) -> tuple[tuple[int, int], ...]:
        counts: Counter = Counter()
        for w in words(text):
            got = self.known.get(w)
            if got is None:
                if len(self.known) > 150_000:
                    self.known.clear()
                got = self.known[w] = tuple(self.terms[t][0] for t in word_terms(w) if t in self.terms)
            if got:
                counts.update(got)
        return tuple(sorted(counts.items()))

    def raw(self, vector: tuple[tuple[int, int], ...], without: int | None = None) -> tuple[float, list[int], list[float]]:
        """The vote and its evidence. ``without``: the label of one text with this very vector that must not vote."""
        ids, sims = self.index.nearest(self.weighted(*zip(*vector, strict=True)), self.k) if vector and self.index.n else (np.zeros(0, np.int64), np.zeros(0))
        toxic, total = self.toxic[ids], self.total[ids]
        if without is not None and len(ids) and sims[0] > 1 - 1e-9 and (at := self.position.get(vector)) in ids:
            here = np.flatnonzero(ids == at)[0]
            toxic[here] -= without
            total[here] -= 1
        weight = sims**4 * np.sqrt(total)
        share = np.divide(toxic, total, out=np.zeros(len(ids)), where=total > 0)
        score = (float(np.dot(weight, share)) + self.shrink * self.base) / (float(weight.sum()) + self.shrink)
        return score, self.doc[ids].tolist(), [round(float(s), 6) for s in sims]

    def vote(self, vector: tuple[tuple[int, int], ...]) -> tuple[float, list[int], list[float], list[str]]:
        if vector in self.voted:
            return self.voted[vector]
        names = [self.names[t] for t, _ in vector]
        raw, near, sims = self.raw(vector) if vector and self.index.n else (self.bare, [], [])
        out = (float(np.interp(raw, *self.curve)) if near else self.bare, near, sims, names)
        if len(self.voted) > 10_000:
            self.voted.clear()
        self.voted[vector] = out
        return out


def rising(toxic: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression: the non-decreasing shares nearest to ``toxic / total`` (pooled neighbours)."""
    pools: list[list[float]] = []
    for t, n in zip(toxic.tolist(), total.tolist(), strict=True):
        pools.append([t, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t1, n1, m1 = pools.pop()
            pools[-1] = [pools[-1][0] + t1, pools[-1][1] + n1, pools[-1][2] + m1]
    return np.repeat([t / n for t, n, _ in pools], [int(m) for *_, m in pools])


def fit(labelled: DataFrame, max_examples: int = 20_000, max_terms: int = 2048, candidates: int = 20_000, least: int = 5, chi2: float = 30.0, lift: float = 2.0, k: int = 15, shrink: float = 0.5) -> Model:
    """Learn from ``labelled(doc_id, text, toxic)``, rows with a toxic of 0 or 1.

    Terms are words and word beginnings. All labelled texts are counted; of the ``candidates`` terms
    in most toxic documents (``least`` at least), those are kept, ``max_terms`` at most, whose documents
    are toxic ``lift`` times as often as all and whose association is at least ``chi2``. Every labelled text becomes a TF-IDF vector over them;
    equal vectors are one example with vote counts. ``max_examples`` distinct vectors, in order of a
    hash, are indexed: the bound of the sample and, with ``max_terms``, of what reaches the driver.
    Texts without any kept term vote together. Every labelled text is then scored without its own
    vote, and an isotonic curve over those scores (101 bins) turns votes into shares of toxic texts.
    No rows: base rate 0.5 and no example.
    """
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    toxic = _counted(labelled.where("toxic = 1"), None).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(candidates).select("term", "n").toArrow().to_pydict() if pos and neg else {}
    in_toxic = dict(zip(*toxic.values(), strict=True)) if toxic else {}
    clean = _counted(labelled.where("toxic = 0"), frozenset(in_toxic)).select("term", "n").toArrow().to_pydict() if in_toxic else {}
    in_clean = dict(zip(*clean.values(), strict=True)) if clean else {}
    chosen = []
    for t, a in in_toxic.items():
        b = in_clean.get(t, 0)
        df = (a + b) / (pos + neg)
        gap = a / pos - b / neg
        score = gap * gap * pos * neg / (pos + neg) / max(df * (1 - df), 1e-12)
        if score >= chi2 and a / (a + b) >= lift * pos / (pos + neg):
            chosen.append((-score, t, a + b))
    chosen = sorted(chosen)[:max_terms]
    terms = {t: (i, math.log((1 + pos + neg) / (1 + df)) + 1) for i, (_, t, df) in enumerate(chosen)}
    shell = Model(terms, [], (0, 0), 0.5, k, shrink)

    def vectors(batches):
        release()
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
        out = Out(schema)
        for doc_id, text, label in rows(batches, "doc_id", "text", "toxic"):
            v = shell.vector(text)
            out.add(doc_id, label, [t for t, _ in v], [n for _, n in v])
            if out.full():
                yield out.batch()
        yield out.batch()

    grouped = written(
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>")
        .groupBy("terms", "counts")
        .agg(F.sum("toxic").alias("n_toxic"), F.count("*").alias("n"), F.min("doc_id").alias("doc_id")),
        "toxic-vectors",
    )
    bare = grouped.where(F.size("terms") == 0).agg(F.sum("n_toxic"), F.sum("n")).first()
    kept = grouped.where(F.size("terms") > 0).orderBy(F.xxhash64("terms", "counts"), "doc_id").limit(max_examples).collect()
    kept = sorted(((r["terms"], r["counts"], r["n_toxic"], r["n"], r["doc_id"]) for r in kept), key=lambda e: (e[0], e[1]))
    model = Model(terms, kept, (bare[0] or 0, bare[1] or 0), pos / (pos + neg) if pos + neg else 0.5, k, shrink)
    model.learnt = pos + neg

    def held_back(batches):
        bins = np.zeros((2, 101))
        for t, n, toxic, total in rows(batches, "terms", "counts", "n_toxic", "n"):
            for label, weight in ((1, toxic), (0, total - toxic)):
                if weight:
                    bins[:, round(100 * model.raw(tuple(zip(t, n, strict=True)), label)[0])] += (weight * label, weight)
        at = np.flatnonzero(bins[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins[0, at]), pa.array(bins[1, at])], ["bin", "toxic", "n"])

    tasks = max(1, -(-grouped.count() // 500))
    seen = grouped.where(F.size("terms") > 0).repartition(tasks).mapInArrow(held_back, "bin long, toxic double, n double").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).orderBy("bin").collect()
    if seen:
        total = np.array([r["n"] for r in seen])
        model.curve = ([r["bin"] / 100 for r in seen], rising(np.array([r["toxic"] for r in seen]) + model.base, total + 1).tolist())
    discard(grouped)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Score ``docs(doc_id, text)``: one row each, see ``SCORES``.

    ``score``: votes of the k nearest distinct examples, weighted by the fourth power of the cosine and
    the root of how many texts each stands for, shrunk towards the base rate, then calibrated. ``neighbours`` and ``similarities`` are the evidence, nearest first, ``terms``
    the kept terms met. NULL or empty text, or no kept term: the share of toxic texts among labelled
    ones without any. NULL and repeated doc_id are kept row by row; extra columns are dropped.
    """

    def apply(batches):
        out = Out(_ARROW)
        for doc_id, text in rows(batches, "doc_id", "text"):
            s, near, sims, names = model.vote(model.vector(text))
            out.add(doc_id, s, int(s >= threshold), near, sims, names)
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, SCORES)


def labelled(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """Texts with a label, written once. ``learn``: condition on doc_id of the rows to learn from.

    Texts without a label are dropped by a bit table of the labelled ids before the join.

    Several labels of one document count as their majority (a tie: 0); NULL labels and ids are left out.
    """
    one = labels.where(learn).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg(F.col("toxic").cast("double")) > 0.5).cast("int").alias("toxic"))
    one = written(one, "labels")
    texts = BitTable.of(one.select(F.xxhash64("doc_id"))).thin(docs.where(learn).select("doc_id", "text"), "doc_id")
    out = written(texts.join(one.hint("merge"), "doc_id"), "labelled")  # labels grow with the corpus: never broadcast
    discard(one)
    return out


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``; all rows if the model has seen no label."""
    if not model.learnt:
        return docs

    def keep(batches):
        release()
        for batch in batches:
            fine = [model.vote(model.vector(text))[0] < threshold for (text,) in rows([batch], "text")]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
