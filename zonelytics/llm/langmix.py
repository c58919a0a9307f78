"""Language identification as a mixture: EM over n-gram likelihoods, languages chosen by penalised likelihood."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonelytics.llm.common import Out, mix, rows, written

BUCKETS = 1 << 16
PREDICTIONS = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTER = re.compile(r"[\W\d_]+")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters of the texts: hashed trigram (the letter and its neighbours; a space at word ends), word number, text number."""
    spaced = [" " + _NO_LETTER.sub(" ", t.lower()).strip() + " " for t in texts]
    codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = codes != 32
    at = np.flatnonzero(letter)
    word = np.cumsum(letter[1:] & ~letter[:-1])[at - 1] if len(at) else at
    ends = np.cumsum([len(s) for s in spaced])
    gram = mix((codes[at - 1] << np.uint64(42)) + (codes[at] << np.uint64(21)) + codes[at + 1]) & np.uint64(BUCKETS - 1)
    return gram.astype(np.int64), word, np.searchsorted(ends, at, side="right")


class Model:
    """Log probabilities of hashed trigrams per language: ``len(langs)`` rows of ``BUCKETS``, whatever the corpus."""

    def __init__(self, langs: list[str], counts: np.ndarray, unit: int = 4, rounds: int = 12, penalty: float = 2.0):
        self.langs, self.unit, self.rounds, self.penalty = langs, unit, rounds, penalty
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32) if langs else counts

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit (``unit`` words in a row): log likelihood per language, and its text's number."""
        gram, word, text = trigrams(texts)
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        start = np.repeat(word[first], np.diff(np.append(first, len(text))))
        part = (word - start) // self.unit
        at = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (text[1:] != text[:-1])))
        return np.stack([np.add.reduceat(row[gram], at, dtype=np.float64) for row in self.logs], axis=1), text[at]

    def mixtures(self, like: np.ndarray, owner: np.ndarray, allowed: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """EM within each text's allowed languages: proportions and log likelihood. ``owner`` ascends and covers every text."""
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count = np.diff(np.append(first, len(owner)))[:, None]
        share = np.where(allowed, start + 1e-6, 0.0)
        share /= share.sum(axis=1, keepdims=True)
        top = like.max(axis=1, keepdims=True)
        weight = np.exp(like - top)
        for _ in range(rounds):
            part = weight * share[owner]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            share = np.where(allowed, np.add.reduceat(part, first, axis=0) / count, 0.0)
        total = np.log(np.maximum((weight * share[owner]).sum(axis=1), 1e-300)) + top[:, 0]
        return share, np.add.reduceat(total, first)

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[str], list[float]]]:
        """For texts that hold a letter."""
        like, owner = self.likelihoods(texts)
        d, n = len(texts), len(self.langs)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        units = np.diff(np.append(first, len(owner)))
        alone = np.add.reduceat(like, first, axis=0)
        every, _ = self.mixtures(like, owner, np.ones((d, n), bool), np.full((d, n), 1.0 / n), self.rounds)
        order = np.argsort(-every, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        single = alone.argmax(axis=1)
        best, share = alone.max(axis=1), np.zeros((d, n))
        share[np.arange(d), single] = 1.0
        cost = self.penalty * np.log1p(units) + 2.0
        for k in range(2, n + 1):  # the k languages of largest proportion
            got, total = self.mixtures(like, owner, rank < k, every, self.rounds // 2)
            total -= (k - 1) * cost
            better = total > best
            best = np.where(better, total, best)
            share[better] = got[better]
        odds = np.exp((alone - alone.max(axis=1, keepdims=True)) / 2)
        sure = (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
        out = []
        for i in range(d):
            found = [int(j) for j in np.argsort(-share[i], kind="stable") if share[i, j] >= 0.01]
            top = found[0]
            score = share[i, top] if len(found) > 1 else sure[i]
            out.append((self.langs[top], float(min(1.0, max(0.0, score))), [self.langs[j] for j in found], [round(float(share[i, j]), 4) for j in found]))
        return out


def fit(docs: DataFrame, max_langs: int = 256) -> Model:
    """Learn from every row of ``docs(text, lang)`` with a text and a lang: trigram counts, summed per task and then over tasks.

    What reaches the driver is a table of at most ``max_langs`` * ``BUCKETS`` counts; more languages are an error.
    """

    def count(batches):
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        waiting: dict[str, list[str]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def add(lang: str) -> None:
            held[lang] += np.bincount(trigrams(waiting.pop(lang))[0], minlength=BUCKETS)
            sizes[lang] = 0

        for text, lang in rows(batches, "text", "lang"):
            waiting[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] > 1_000_000:
                add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    found = written(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigram-counts")
    if found.select("lang").distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    got = found.toArrow()
    langs = sorted(set(got.column("lang").unique().to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        place = pa.compute.index_in(got.column("lang"), pa.array(langs, pa.string()))
        counts[np.asarray(place), np.asarray(got.column("bucket"))] = np.asarray(got.column("n"))
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Languages of each row of ``docs(doc_id, text)``, see ``PREDICTIONS``.

    A text is cut into units of four words; EM estimates the share of units in each language from
    their trigram likelihoods. Of the sets of the 1, 2, ... languages with the largest shares, that of
    the highest likelihood less a penalty of (penalty * log(1 + units) + 2) per further language is taken.
    ``lang_pred`` has the largest share (ties: first in the alphabet); ``score`` is that share or, with one
    language, its posterior against the others.

    NULL text or one without a letter, or a model without languages: ``und``, score 0, no languages.
    NULL and repeated doc_id are kept row by row; extra columns are dropped.
    """

    def apply(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])
        out, ids, texts, size = Out(schema), [], [], 0

        def flush() -> None:
            for i, got in zip(ids, model.predict(texts) if texts else [], strict=True):
                out.add(i, *got)
            ids.clear()
            texts.clear()

        for doc_id, text in rows(batches, "doc_id", "text"):
            if not text or not model.langs or not _LETTER.search(text):
                out.add(doc_id, "und", 0.0, [], [])
            else:
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
            if size > 1_000_000:
                flush()
                size = 0
            if out.full():
                yield out.batch()
        flush()
        yield out.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, PREDICTIONS)
