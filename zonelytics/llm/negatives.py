"""Hard negatives by angular triangle filtering: stored angles to reference directions bound every score before it is computed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonelytics.llm.common import written

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_STORED = "row long, id long, label string, anchor boolean, numbers binary, norm double, angles binary, cell int"
_ROW = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("label", pa.string()), ("anchor", pa.bool_()), ("numbers", pa.binary()), ("norm", pa.float64()),
    ("angles", pa.binary()), ("cell", pa.int32()),
])
_BEST = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
#: what single-precision angles, arc cosines and products can be off by, generously
_ANGLE, _RELATIVE = 4e-6, 1e-9
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_TILE = 32


def quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors and their floor(scale * x); components beyond 2^62 are held there."""
    places, out = [], []
    offsets, flat = vectors.offsets.to_numpy(), vectors.values
    lost = np.asarray(flat.is_null())
    values = np.asarray(flat.fill_null(0).cast(pa.float64()))
    null = np.asarray(vectors.is_null())
    for i in range(len(vectors)):
        a, b = offsets[i], offsets[i + 1]
        if not null[i] and not lost[a:b].any() and np.isfinite(values[a:b]).all():
            with np.errstate(over="ignore"):
                out.append(np.clip(np.floor(values[a:b] * scale), -(2.0**62), 2.0**62).astype(np.int64))
            places.append(i)
    return np.array(places, np.int64), out


def directions(sample: list[np.ndarray], many: int, rounds: int = 5) -> np.ndarray:
    """Unit reference directions: spherical k-means over a sample, started at the farthest ones one after another."""
    width = max((len(v) for v in sample), default=0)
    points = np.zeros((len(sample), width))
    for p, v in zip(points, sample, strict=True):
        p[: len(v)] = v
    norms = np.linalg.norm(points, axis=1)
    points = points[norms > 0] / norms[norms > 0, None]
    if not len(points):
        return np.zeros((0, width))
    chosen = [0]
    near = points @ points[0]
    while len(chosen) < min(many, len(points)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(rounds):
        at = (points @ centres.T).argmax(1)
        sums = np.array([points[at == c].sum(0) for c in range(len(centres))])
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def stored(vectors: DataFrame, centres: np.ndarray, scale: int) -> DataFrame:
    """The usable rows of ``vectors(id, label, anchor, vector)`` with whole numbers, norm, angles to the references and the nearest one."""
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            places, numbers = quantised(batch.column(4), scale)
            own = np.zeros((len(numbers), width))
            norms = np.array([np.linalg.norm(v.astype(float)) for v in numbers])
            for o, v, n in zip(own, numbers, norms, strict=True):
                if n > 0:
                    o[: min(width, len(v))] = v[:width] / n
            angles = np.arccos(np.clip(own @ centres.T, -1, 1)).astype(np.float32)
            cells = angles.argmin(1) if angles.shape[1] else np.zeros(len(numbers), np.int64)
            small = [v.astype(np.int16) if len(v) == 0 or np.abs(v).max() < 1 << 15 else v for v in numbers]
            made = [bytes([x.itemsize]) + x.tobytes() for x in small]
            kept = batch.select(range(4)).take(pa.array(places))
            columns = [*kept.columns, pa.array(made, pa.binary()), pa.array(norms, pa.float64()), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(cells, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)

    return vectors.select("row", "id", "label", "anchor", "vector").mapInArrow(run, _STORED)


class Side:
    """Rows of one side of a block: whole numbers (float64 where exact), norms and angles."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        self.row, self.id, self.label, self.norm, cell = (get(c) for c in ("row", "id", "label", "norm", "cell"))
        numbers = [np.frombuffer(x[1:], np.int16 if x[0] == 2 else np.int64) for x in get("numbers")]
        self.numbers = np.zeros((len(numbers), max((len(v) for v in numbers), default=0)), np.int64)
        for o, v in zip(self.numbers, numbers, strict=True):
            o[: len(v)] = v
        self.angles = np.array([np.frombuffer(x, np.float32) for x in get("angles")], float).reshape(len(numbers), -1)
        own = self.angles[np.arange(len(cell)), cell] if self.angles.shape[1] else np.zeros(len(cell))
        self.order = np.lexsort([self.id, own, cell])  # rows of like angles stand together


def bounds(angles: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds [anchor, tile]: tiles have angles ``low`` to ``high`` per reference and norms ``least`` to ``most``.

    By the triangle inequality on the sphere two vectors at angles s and t to a reference are between |s - t| and
    min(s + t, 2 pi - s - t) apart; the tightest of all references counts, widened by what rounding can do.
    """
    near, far = np.zeros((len(angles), len(low))), np.full((len(angles), len(low)), math.pi)
    for k in range(angles.shape[1]):
        a = angles[:, k, None]
        np.maximum(near, np.maximum(low[None, :, k] - a, a - high[None, :, k]), out=near)
        np.minimum(far, np.minimum(a + high[None, :, k], 2 * math.pi - a - low[None, :, k]), out=far)
    top, bottom = np.cos(np.maximum(near - _ANGLE, 0)), np.cos(np.minimum(far + _ANGLE, math.pi))
    size = norm[:, None]
    slack = 1 + _RELATIVE * size * most
    return size * np.where(bottom < 0, most, least) * bottom - slack, size * np.where(top < 0, least, most) * top + slack


def whole_scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products, held at the ends of 64 bits; by floating point where all are below 2^52."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if largest < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object) if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, _LOWEST, _HIGHEST).astype(np.int64)


def best_of_block(a: Side, x: Side, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[list[np.ndarray], list[int]]:
    """Per anchor and score window its first ``k`` rows (score falling, then id) of the same label, or of another.

    Tiles of rows with like angles are bounded first, rows of tiles that few anchors need one by one;
    only rows whose bounds overlap an anchor's window, raised to its k-th score so far, are scored.
    Also returns [pairs scored, all pairs].
    """
    many = low.shape[1]
    floor_, ceiling = low.astype(float), high.astype(float)  # a float is near enough: bounds have slack of 1 and more
    kept = [np.zeros(0, np.int64)] * 4
    fresh: list[list[np.ndarray]] = []
    scored = waiting = 0
    largest = float(a.norm.max(initial=0)) * float(x.norm.max(initial=0))

    def merge():
        nonlocal kept, fresh, waiting
        kept = [np.concatenate([o, *(f[i] for f in fresh)]) for i, o in enumerate(kept)]
        order = np.lexsort([kept[2], -kept[3].astype(float) if largest < 2**52 else ~kept[3], kept[1], kept[0]])
        kept = [c[order] for c in kept]
        group = kept[0] * many + kept[1]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(group)))
        rank = np.arange(len(group)) - np.repeat(start, size)
        full = start[size >= k] + k - 1
        floor_[kept[0][full], kept[1][full]] = np.maximum(floor_[kept[0][full], kept[1][full]], kept[3][full])
        kept, fresh, waiting = [c[rank < k] for c in kept], [], 0

    for at in range(0, len(x.order), _TILE):
        tile = x.order[at : at + _TILE]
        angles, norms = x.angles[tile], x.norm[tile]
        below, above = bounds(a.angles, a.norm, angles.min(0)[None], angles.max(0)[None], norms.min()[None], norms.max()[None])
        wanted = ((above >= floor_) & (below <= ceiling) & (floor_ <= ceiling)).any(1)
        who = np.flatnonzero(wanted)
        if not len(who):
            continue
        if len(who) < len(a.row) // 2:
            below, above = bounds(a.angles[who], a.norm[who], angles, angles, norms, norms)
            near = np.zeros(below.shape, bool)
            for w in range(many):
                near |= (above >= floor_[who, w, None]) & (below <= ceiling[who, w, None])
            who, tile = who[near.any(1)], tile[near.any(0)]
        scores = whole_scores(a.numbers[who], x.numbers[tile], largest)
        scored += scores.size
        fits = (a.label[who][:, None] == x.label[tile][None]) == same
        if same:
            fits &= a.row[who][:, None] != x.row[tile][None]
        for w in range(many):
            i, j = np.nonzero(fits & (scores >= np.maximum(low[who, w], floor_[who, w].astype(np.int64) if largest < 2**52 else low[who, w])[:, None]) & (scores <= high[who, w, None]))
            if len(i):
                fresh.append([who[i], np.full(len(i), w), x.id[tile[j]], scores[i, j]])
                waiting += len(i)
        if waiting > 8 * k * many * len(a.row) or waiting > 500_000:
            merge()
    merge()
    return kept, [scored, len(a.row) * len(x.row)]


def _searched(anchors: DataFrame, data: DataFrame, chunks: int, bins: int, k: int, same: bool) -> DataFrame:
    """(anchor row, window, id, score): the first ``k`` per anchor and window over all bins of the data.

    Anchors are dealt into chunks, rows into bins, both of bounded size and whatever their labels, and every
    chunk meets every bin once: a stated query set against all rows, in blocks.
    """

    def run(left, right):
        a, x = Side(left), Side(right)
        lows = left.column("lows").combine_chunks()
        many = max(len(lows.values) // max(len(lows), 1), 1)
        low, high = (np.asarray(left.column(c).combine_chunks().flatten()).reshape(len(a.row), many) for c in ("lows", "highs"))
        (who, window, ids, scores), _ = best_of_block(a, x, low, high, k, same)
        return pa.Table.from_arrays([pa.array(a.row[who]), pa.array(window.astype(np.int32)), pa.array(ids), pa.array(scores)], schema=_BEST)

    q = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    d = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    found = q.groupBy("chunk", "bin").cogroup(d.groupBy("chunk", "bin")).applyInArrow(run, "anchor long, window int, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
    references: int = 16, sample: int = 2048, chunk_rows: int = 8192, bin_rows: int = 16384,
) -> DataFrame:
    """Hard negatives of the rows marked ``anchor`` in ``vectors(id, label, anchor, vector)``; see ``MINED``.

    A row's score is the integer inner product of floor(``scale`` * component) with the anchor's. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other
    labels with low_percent * p <= 100 * score <= high_percent * p are returned (p: the positive's score); first: higher
    score, then smaller id. The result is exact: angles to ``references`` directions, fitted on the ``sample`` rows with
    the smallest hash of id, only rule out pairs. Two searches in blocks of ``chunk_rows`` anchors and ``bin_rows`` rows:
    for the positives, then for the negatives within each positive's window.

    A NULL id, label or vector, or a NULL or non-finite component: the row takes no part. Vectors of unlike length
    count as filled with zeros; an empty one is all zeros. Components are held at 2^62 after scaling, scores at the ends of
    64 bits. Rows that share an id are rows of their own (other than itself means another row), equal in order. No
    positive, or none with a negative in its window: no rows. Extra columns are dropped. An empty table gives no rows.
    """
    usable = vectors.where("id is not null and label is not null and vector is not null")
    keyed = usable.select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector",
    )
    picked = keyed.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    _, numbers = quantised(picked.column(0).combine_chunks(), scale)
    data = written(stored(keyed, directions(numbers, references), scale), "vectors")
    n, queries = data.agg(F.count("*"), F.count_if("anchor")).first()
    chunks, bins = max(1, math.ceil(queries / chunk_rows)), max(1, math.ceil(n / bin_rows))
    deal = lambda salt, parts: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    data = data.withColumn("bin", deal("bin", bins))
    anchors = written(data.where("anchor").drop("bin").withColumn("chunk", deal("chunk", chunks)), "anchors")
    every = anchors.withColumns({"lows": F.array(F.lit(_LOWEST)), "highs": F.array(F.lit(_HIGHEST))})
    found = written(_searched(every, data, chunks, bins, positives, True), "positives")
    # floor and ceiling of the window in whole numbers; a window nothing fits into ends before it begins
    p = F.col("score").cast("decimal(38,0)")
    low, high = F.ceil(p * low_percent / 100).cast("long"), F.floor(p * high_percent / 100).cast("long")
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", low.alias("low"), high.alias("high")))).alias("w"))
    padded = lambda name, fill: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(F.col("w"), i)[name], F.lit(fill)))
    windowed = anchors.join(windows.withColumnRenamed("anchor", "row"), "row").withColumns({"lows": padded("low", _HIGHEST), "highs": padded("high", _LOWEST)}).drop("w")
    negative = _searched(written(windowed, "windows"), data, chunks, bins, negatives, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    paired = found.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negative.join(paired, ["anchor", "window"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
