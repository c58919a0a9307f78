"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonelytics.llm.common import BitTable, Out, ascii_words, components, discard, mix, row_key, rows, seeded, set_key, shingle_keys, without, word_keys, written


class PartEnum:
    """Signatures such that different sets of Jaccard similarity ``percent / 100`` or more share one.

    Set sizes are cut into bands of ratio (100 / percent)^2. A pair is joined in the band of its
    smaller set: the smaller emits for its own band, the larger for that or the next lower one. In a
    band no such pair differs in more than k elements, k = floor((100 - percent) * top / percent).
    The element domain is hashed into n1 partitions of n2 parts each, and every subset of n2 - k2 parts
    of a partition is enumerated. One element touches C' of the C subsets of its partition, so at least
    C * n1 - k * C' subsets agree. n1 is chosen so that this is t + 1, t being about ``slack`` * k * C'.

    A set leaves out its t smallest subsets (by size, then number): of the t + 1 that agree, which have
    the same size in both, one stays in either set. So small or empty subsets, which many sets share,
    are rarely used. Sets under ``tiny`` elements have too few for that; pairs with one of them share one of
    the size - ceil(percent * size / 100) + 1 elements with the smallest hashes.
    """

    def __init__(self, percent: int, n2: int = 2, k2: int = 1, slack: float = 0.25, tiny: int = 32):
        self.percent, self.n2, self.k2, self.slack, self.tiny, self.starts = percent, n2, k2, slack, tiny, [1]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 10_000 // self.percent**2 + 1)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def signatures(self, keys: np.ndarray) -> np.ndarray:
        n, out = len(keys), []
        if 0 < n * self.percent < self.tiny * 100:
            h = mix(keys)
            out.append(np.sort(h)[: n - -(-self.percent * n // 100) + 1])
        if n >= self.tiny:
            band = self.band(n)
            out.append(self._of(keys, band))
            if (self.starts[band] - 1) * 100 >= self.percent * n:
                out.append(self._of(keys, band - 1))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def _of(self, keys: np.ndarray, band: int) -> np.ndarray:
        k = (100 - self.percent) * (self.starts[band + 1] - 1) // self.percent
        n2, j = self.n2, self.n2 - self.k2
        each, hit = math.comb(n2, j), math.comb(n2 - 1, j - 1)
        n1 = -(-(1 + k * hit + int(self.slack * k * hit)) // each)
        h = mix(keys ^ seeded(f"band {band}"))
        part = (h % np.uint64(n1 * n2)).astype(np.int64)
        h = mix(h)
        # sums of 32-bit halves are exact as doubles for up to 2^21 elements in a part
        low = np.bincount(part, (h & np.uint64(0xFFFFFFFF)).astype(np.float64), n1 * n2).astype(np.uint64)
        high = np.bincount(part, (h >> np.uint64(32)).astype(np.float64), n1 * n2).astype(np.uint64)
        sums = mix(low + (high << np.uint64(32)) + np.arange(n1 * n2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n1, n2)
        counts = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        subsets = [list(c) for c in combinations(range(n2), j)]
        size = np.concatenate([counts[:, c].sum(axis=1) for c in subsets])
        signature = mix(np.concatenate([sums[:, c].sum(axis=1, dtype=np.uint64) + np.uint64(i) for i, c in enumerate(subsets)]) ^ seeded(f"join {band}"))
        t = each * n1 - k * hit - 1
        return signature[np.argsort(size, kind="stable")[t:]]


def parities(keys: np.ndarray) -> bytes:
    """A sketch of a set: how many of its elements each of 2 to 4 bits an element counts, modulo 2.

    Two sketches differ in at most as many bits as their sets in elements, also once the longer is folded.
    """
    m = max(128, 1 << int(2 * len(keys) - 1).bit_length()) if len(keys) else 128
    return np.packbits(np.bincount((mix(keys) & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch as 64-bit words, and as if it had had only ``words`` of them."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), axis=0)


def may_link(sizes: np.ndarray, sketches: np.ndarray, size: int, sketch: np.ndarray, percent: int) -> np.ndarray:
    """False only where a set of this sketch (of as many words) is certainly less similar than ``percent / 100``."""
    apart = np.maximum(np.bitwise_count(sketches ^ sketch).sum(axis=1, dtype=np.int64), np.abs(sizes - size))
    return apart * (100 + percent) <= (100 - percent) * (sizes + size)


def near(sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link, as positions."""
    words = min(map(len, sketches)) // 8
    n, rest, table, out = np.array(sizes, np.int64), np.arange(len(sizes)), np.stack([folded(s, words) for s in sketches]), []
    left = table
    while len(rest) > 1:
        queue, rest, left = [rest[0]], rest[1:], left[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = may_link(n[rest], left, n[x], table[x], percent)
            if hit.any():
                found = rest[hit]
                out += [(int(x), y) for y in found.tolist()]
                queue += found.tolist()
                rest, left = rest[~hit], left[~hit]
    return out


def near_in_runs(batches, percent: int):
    """``near`` within each run of rows of one signature, rows sorted by it."""
    out, now, held = Out(pa.schema([("a", pa.int64()), ("b", pa.int64())])), None, {}

    def close():
        if len(held) > 1:
            keys = list(held)
            for x, y in near(*zip(*held.values(), strict=True), percent):
                out.add(keys[x], keys[y])

    for signature, key, n, sketch in rows(batches, "signature", "set_key", "n", "sketch"):
        if signature != now:
            close()
            now, held = signature, {}
            if out.full():
                yield out.batch()
        held[key] = n, sketch
    close()
    yield out.batch()


def near_pairs(batches, percent: int):
    """The rows (a, b) with whether the pair's sketches leave a link possible."""
    out = Out(pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_())]))
    for a, b, n, m, s, t in rows(batches, "a", "b", "n", "m", "s", "t"):
        words = min(len(s), len(t)) // 8
        out.add(a, b, bool(may_link(np.array([n]), folded(s, words)[None], m, folded(t, words), percent)[0]))
        if out.full():
            yield out.batch()
    yield out.batch()


def similar(sets: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * |a & b| >= percent * |a | b|, by exact overlap counts over an inverted index.

    ``left``: compare only pairs whose first set is one of the first ``left``.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")  # by value, then by owner
    ranked = values[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    run = np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    first, place = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    first[order], place[order] = run, np.arange(len(values))
    by_rank = owner[order]
    ends = np.append(0, np.cumsum(sizes))
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in range(1, m):
        a, b = first[ends[x] : ends[x + 1]], place[ends[x] : ends[x + 1]]
        n = b - a
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(a, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(by_rank[at], minlength=m)[: x if left is None else min(x, left)]
        for y in np.flatnonzero(common * (100 + percent) >= percent * (sizes[: len(common)] + sizes[x])).tolist():
            if common[y] and (u := root(x)) != (v := root(y)):
                parent[u] = v
                out.append((x, y))
    return out


def grouped(batches, percent: int):
    """Links within each run of rows of one (cluster, block), rows sorted by them; ``side`` 0 marks sets to compare with all."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    out, now, sets, asked = Out(schema), None, {}, {}

    def close():
        ids = [*asked, *(k for k in sets if k not in asked)]
        values = [asked[k] if k in asked else sets[k] for k in ids]
        if len(ids) > 1:
            for x, y in similar(values, percent, len(asked) if asked else None):
                out.add(ids[x], ids[y])

    for cluster, block, side, key, keys in rows(batches, "cluster", "block", "side", "set_key", "keys"):
        if (cluster, block) != now:
            close()
            now, sets, asked = (cluster, block), {}, {}
            if out.full():
                yield out.batch()
        (asked if side == 0 else sets)[key] = np.frombuffer(keys, np.uint64)
    close()
    yield out.batch()


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, block_sets: int = 1000, block_keys: int = 2_000_000, run_sets: int = 20_000) -> DataFrame:
    """Classes of documents whose n-word shingle sets have Jaccard similarity ``percent / 100`` or more.

    One row per row of ``docs(doc_id, text)``: doc_id, n_shingles (set size), component_id (smallest
    doc_id reachable by links, itself included). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    * Equal sets are one node, named by a 64-bit hash. Each task emits the signatures of a set once.
    * Signatures with several nodes connect those of them into clusters whose sketches leave a link possible: first
      each node and its signature's smallest, then, for signatures where such a pair is ruled out, all pairs
      of their nodes in one task (above ``run_sets`` nodes all are connected). Linked nodes are always in one cluster.
    * Each cluster's sets meet once, in tasks of at most about ``block_sets`` sets and ``block_keys``
      shingles, which compare exactly and return a spanning forest. Larger clusters are dealt into
      blocks twice, at random; what is then outside the cluster's largest component is compared with
      the whole cluster, block by block. No pairs are written, and none is left out.

    NULL, empty or blank text: set size 0, linked with nothing. Repeated rows are one node. A NULL
    doc_id takes part; it is never the smallest unless alone, where component_id is NULL. Extra
    columns are dropped. An empty table gives no rows.
    """
    scheme = PartEnum(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def emit(batches):
        out = Out(pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.int64()), ("signatures", pa.list_(pa.int64())), ("sketch", pa.binary())]), 1000)
        done: set[int] = set()
        for doc_id, text in rows(batches, "doc_id", "text"):
            keys = shingle_keys(word_keys(ascii_words(text)), n)
            name = set_key(keys) if len(keys) else None
            new = name is not None and name not in done
            if new:
                if len(done) > 500_000:
                    done.clear()
                done.add(name)
            out.add(doc_id, len(keys), name, scheme.signatures(keys).view(np.int64) if new else None, parities(keys) if new else None)
            if out.full():
                yield out.batch()
        yield out.batch()

    emitted = written(docs.mapInArrow(emit, "doc_id long, n_shingles long, set_key long, signatures array<long>, sketch binary"), "shingle-sets")
    members = written(emitted.select("doc_id", "n_shingles", "set_key"), "members")
    # a signature's sets are never gathered: its smallest set by partial aggregation, then a join of the few rows whose signature has several
    signed_sets = emitted.select("set_key", F.explode("signatures").alias("signature"))
    lows = written(signed_sets.groupBy("signature").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("signature", "low"), "signatures")
    met = BitTable.of(lows.select(F.xxhash64("signature"))).thin(signed_sets, "signature")
    shared = written(met.join(lows.hint("merge"), "signature").where("set_key <> low").distinct(), "shared")
    named = shared.select("set_key").union(shared.select("low")).distinct()
    sketches = emitted.where("sketch is not null").select("set_key", F.col("n_shingles").alias("n"), "sketch").join(named, "set_key")
    sketches = written(sketches.groupBy("set_key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    discard(emitted, lows)
    pairs = shared.select(F.col("set_key").alias("a"), F.col("low").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "n", "s").hint("merge"), "a").join(sketches.toDF("b", "m", "t").hint("merge"), "b")
    pairs = written(pairs.mapInArrow(lambda batches: near_pairs(batches, percent), "a long, b long, near boolean"), "pairs")
    # signatures whose smallest set is near all others connect them already; of those with the same sets one is enough
    far = pairs.where("not near").select(F.col("a").alias("set_key"), F.col("b").alias("low"))
    unsettled = shared.join(far.hint("merge"), ["set_key", "low"], "left_semi").select("signature").distinct()
    runs = shared.join(unsettled.hint("merge"), "signature").groupBy("signature").agg(F.first("low").alias("low"), F.count("*").alias("others"), F.bit_xor(F.xxhash64("set_key")).alias("all"))
    runs = written(runs.groupBy("low", "others", "all").agg(F.min("signature").alias("signature")), "runs")
    inner = runs.where(F.col("others") < run_sets)
    asked = shared.select("signature", "set_key").join(inner.select("signature").hint("merge"), "signature").union(inner.select("signature", "low"))
    asked = asked.join(sketches.hint("merge"), "set_key").select("signature", "set_key", "n", "sketch").repartition("signature").sortWithinPartitions("signature")
    found = asked.mapInArrow(lambda batches: near_in_runs(batches, percent), "a long, b long")
    whole = shared.join(runs.where(F.col("others") >= run_sets).select("signature").hint("merge"), "signature").select("set_key", "low")
    edges = written(pairs.where("near").select("a", "b").union(found).union(whole), "near")
    discard(shared, sketches, pairs, runs)
    clusters = components(edges).select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))

    nodes = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")).join(clusters, "set_key")
    total = nodes.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    blocks = F.ceil(F.greatest(F.col("sets") / block_sets, F.col("size") / block_keys)).cast("int")
    nodes = written(nodes.join(total, "cluster").select("set_key", "cluster", "doc_id", blocks.alias("blocks")), "clusters")
    wanted = BitTable.of(nodes.select(F.xxhash64("doc_id")))

    def shingled(batches):
        out, done = Out(pa.schema([("set_key", pa.int64()), ("keys", pa.binary())]), 500), set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted.hit(np.asarray(batch.column("h")).view(np.uint64))))
            for (text,) in rows([batch], "text"):
                keys = shingle_keys(word_keys(ascii_words(text)), n)
                if len(keys) and (name := set_key(keys)) not in done:
                    if len(done) > 500_000:
                        done.clear()
                    done.add(name)
                    out.add(name, keys.tobytes())
                if out.full():
                    yield out.batch()
        yield out.batch()

    sets = written(docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(shingled, "set_key long, keys binary").join(nodes.drop("doc_id"), "set_key"), "cluster-sets")

    def compared(placed: DataFrame) -> DataFrame:
        dealt = placed.select("cluster", "block", "side", "set_key", "keys").repartition("cluster", "block").sortWithinPartitions("cluster", "block")
        return dealt.mapInArrow(lambda batches: grouped(batches, percent), "a long, b long")

    def at_random(salt: str):
        return F.pmod(F.xxhash64("set_key", F.lit(salt)), F.col("blocks")).cast("string")

    links = written(compared(sets.select("*", at_random("first").alias("block"), F.lit(1).alias("side"))), "links")
    large = sets.where("blocks > 1")
    if not large.select("cluster").isEmpty():
        links = written(links.union(compared(large.select("*", at_random("second").alias("block"), F.lit(1).alias("side")))), "links")
        known = nodes.where("blocks > 1").join(components(links).withColumnRenamed("node", "set_key"), "set_key", "left")
        known = known.select("set_key", "cluster", "blocks", F.coalesce("component", "set_key").alias("component"))
        most = known.groupBy("cluster", "component").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "component"))["component"].alias("most"))
        outside = known.join(most, "cluster").where("component <> most")
        # a row of tiles per block of outsiders, a column per block of the cluster
        tiles = outside.groupBy("cluster").agg(F.count("*").alias("k"), F.first("blocks").alias("blocks")).select("cluster", F.ceil(F.col("k") / block_sets).cast("int").alias("high"))
        asked = large.join(outside.select("set_key"), "set_key").join(tiles, "cluster")
        asked = asked.select("*", F.pmod(F.xxhash64("set_key", F.lit("row")), F.col("high")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"), F.lit(0).alias("side"))
        every = large.join(tiles, "cluster").select("*", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("r"), F.pmod(F.xxhash64("set_key", F.lit("column")), F.col("blocks")).alias("c"), F.lit(1).alias("side"))
        tile = F.concat_ws(",", "r", "c").alias("block")
        links = written(links.union(compared(asked.select("*", tile).unionByName(every.select("*", tile)))), "links")

    discard(sets, nodes)
    # the class's smallest doc_id is found on sets; each document meets it once, by its set
    own = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    own = own.join(components(links).withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = own.join(own.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("set_key", "least")
    flat = members.select("doc_id", "n_shingles", "set_key").join(least, "set_key", "left")
    return flat.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (NULL last), and of rows alike in doc_id and text one.

    Rows that share a doc_id but not the text are told apart. All columns are kept. NULL, empty and blank texts resemble
    nothing: all such rows stay.
    """
    keyed = docs.select(row_key().alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text")
    groups = written(jaccard_groups(keyed, n, percent).where("n_shingles > 0").groupBy("component_id", "doc_id").agg(F.count("*").alias("copies")), "groups")
    several = groups.groupBy("component_id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("component_id")
    members = written(groups.join(several, "component_id").select("component_id", F.col("doc_id").alias("key")), "members")
    named = BitTable.of(members.select(F.xxhash64("key"))).thin(keyed.select(F.col("doc_id").alias("key"), "id"), "key").groupBy("key").agg(F.min("id").alias("id"))
    first = members.join(named, "key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("first"))
    worse = written(members.join(first, "component_id").where("key <> first").select("key"), "near-duplicates")
    # only sets with shingles are in groups: rows with a NULL, empty or blank text are never alike
    return without(docs, worse, groups.where("copies > 1").select(F.col("doc_id").alias("key")))
