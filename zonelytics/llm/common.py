"""Helpers the operators share: input columns, written intermediates, word hashes, linked components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests) one beside the warehouse."""
    name = "spark.checkpoint.dir"
    base = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    return (base or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted as soon as it has ended, not when the driver happens to collect its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that outlive executors.

    The files lie in one root per application, to be dropped when it has ended; see ``discard`` for earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/zonelytics-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["folder"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` returned. Only for those that no frame still to be computed reads."""
    for df in frames:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.__dict__["folder"])
        path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; NULL for NULL."""
    return F.crc32(F.col(column).cast("string")) % modulus


def seeded(text: str) -> np.uint64:
    """A fixed odd 64-bit constant named by ``text``."""
    return np.uint64(xxhash.xxh3_64_intdigest(text.encode()) | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: ASCII other than letters and digits separates words
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


def word_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence as one where it is shorter."""
    n = min(n, len(words))
    if n == 0:
        return words
    m = len(words) - n + 1
    h = np.full(m, seeded(f"{n} words"))
    for i in range(n):
        h += words[i : i + m] * seeded(f"word {i}")
    return np.unique(mix(h))


def set_key(keys: np.ndarray) -> int:
    """Signed 64-bit name of a set given as a sorted array."""
    return signed(xxhash.xxh3_64_intdigest(keys.tobytes()))


def signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, a slice at a time so that long texts are not all held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


class Out:
    """Collects rows column by column and cuts them into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 20_000):
        self.schema, self.limit, self.cols = schema, limit, [[] for _ in schema]

    def add(self, *values) -> None:
        for c, v in zip(self.cols, values, strict=True):
            c.append(v)

    def full(self) -> bool:
        return len(self.cols[0]) >= self.limit

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return out


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, component), component = smallest node reachable.

    Alternates hooking each node's larger neighbours and each node's smaller ones onto the smallest
    one (every pass is two group-bys, no adjacency list is built), until no row changes. Each pass is
    written to the shared folder; merge joins, and a collection after it, keep the driver free of the
    tables and plans of passes gone by. Rows with a NULL end are ignored; an empty input gives no rows.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, seen = written(pairs, "links"), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2.hint("merge"), "u").select("u", "v", "m")
        old, pairs = pairs, written(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links"
        )
        discard(old)
        pairs.sparkSession.sparkContext._jvm.System.gc()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return pairs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


class BitTable:
    """A set of 64-bit keys as a bit table of fixed size: no key is missed, some others pass.

    Its size does not grow with the data, so it may be sent to every task: it thins out rows before
    an exact shuffle join. ``of`` gathers it with a group-by, at most ``bits / 64`` rows of which reach
    the driver.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, np.uint64(bits)

    @classmethod
    def of(cls, keys: DataFrame, bits: int = 1 << 26) -> BitTable:
        """``keys``: one column of longs or of arrays of longs; NULLs are left out."""

        def places(batches):
            for batch in batches:
                column = batch.column(0)
                column = column.flatten() if pa.types.is_list(column.type) else column
                h = np.asarray(column.drop_null()).astype(np.int64).view(np.uint64)
                at = np.unique(np.concatenate(_places(h, np.uint64(bits))))
                bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit)], ["word", "bit"])

        with shuffles_deleted(keys.sparkSession):
            got = keys.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).astype(np.int64).view(np.uint64)
        return cls(words, bits)

    def thin(self, df: DataFrame, *key: str, inside: bool = True) -> DataFrame:
        """The rows of ``df`` whose ``xxhash64(*key)`` may be in the set, or those whose is not."""

        def keep(batches):
            for batch in batches:
                fine = self.hit(np.asarray(batch.column(batch.num_columns - 1)).view(np.uint64))
                yield batch.filter(pa.array(fine == inside)).select(list(range(batch.num_columns - 1)))

        return df.withColumn(unused(df, "thinned"), F.xxhash64(*key)).mapInArrow(keep, df.schema)

    def hit(self, h: np.ndarray) -> np.ndarray:
        """Which of the keys may be in the set."""
        out = np.ones(len(h), bool)
        for p in _places(h, self.bits):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return out


def _places(h: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(8)) % bits, (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)) % bits


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key():
    """Names a row by its doc_id and text: rows alike in both share it, and any decision on them. NULLs are values here."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def without(df: DataFrame, keys: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``df(doc_id, text, ...)`` without the rows whose ``row_key()`` is among ``keys(key)``, and with one row of each key in ``once(key)``.

    Only rows that a bit table of these keys lets through are shuffled, for the exact anti-join and the choice among rows alike.
    """
    name, number, whole = unused(df, "key"), unused(df, "copy"), [F.col(f"`{c}`") for c in df.columns]
    table = BitTable.of((keys if once is None else keys.union(once)).select(F.xxhash64("key")))
    keyed = df.withColumn(name, row_key())
    left = table.thin(keyed, name).join(keys.select(F.col("key").alias(name)).hint("merge"), name, "left_anti")
    if once is not None:
        left = left.join(once.select(F.col("key").alias(name), F.lit(True).alias(number)).hint("merge"), name, "left")
        alike = left.where(F.col(number)).groupBy(name).agg(F.first(F.struct(*whole)).alias("row")).select("row.*")
        left = left.where(F.col(number).isNull()).select(*whole).union(alike)
    return table.thin(keyed, name, inside=False).select(*whole).union(left.select(*whole))


def release() -> None:
    """Drop what an operator has parked in this Python worker, and hand the memory back.

    Workers are reused between tasks and stages; an operator that needs much memory calls this first.
    """
    import ctypes
    import gc
    import sys

    if "tokenizers" in sys.modules and sys.modules["tokenizers"].__dict__.pop("_ids_by_path", None):
        gc.collect()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
