"""A manifest: one small file that names the folders a table is made of, replaced in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_NAME = "_manifest.json"  # Spark's readers skip names that begin with an underscore


def _hadoop(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of ``root`` as of now; None where there is none yet."""
    jvm, fs, conf = _hadoop(spark)
    path = fs.Path(f"{root}/{_NAME}")
    system = path.getFileSystem(conf)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def replace_manifest(spark: SparkSession, root: str, content: dict) -> None:
    """Write the manifest beside the old one and rename it over that: a reader sees the one or the other.

    One writer at a time. A writer that dies before the rename leaves the old manifest valid, and folders nobody names.
    """
    jvm, fs, conf = _hadoop(spark)
    path, new = fs.Path(f"{root}/{_NAME}"), fs.Path(f"{root}/{_NAME}.{uuid.uuid4().hex}")
    system = path.getFileSystem(conf)
    stream = system.create(new)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(system.getUri(), conf).rename(new, path, overwrite)


def new_folder(root: str, name: str) -> str:
    """A folder of its own for every attempt, so that nothing named by a manifest is ever written again."""
    return f"{root}/{name}-{uuid.uuid4().hex}"
