"""What the corpus operators share: scratch tables in the cluster's shared folder, size-checked broadcasts, Arrow helpers.

Scratch tables are plain Parquet below ``spark.checkpoint.dir``: they cut lineage, every
executor can read them, and they outlive any executor.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A frame is broadcast only when a look at it has shown it to have no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Keys that hold more than one part in so many of all rows are joined apart from the others; there are fewer of them than that.
HOT_PARTS = 1000

#: A word, where a contract defines one: a run of anything but ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

#: Spark deletes a statement's shuffle files as soon as it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_sent: set[str] = set()
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Prepare the session for Python stages: send this package to the executors, and keep Arrow batches of whole texts small.

    Spark's file server hands the package out; batch sizes the user set stay.
    """
    if spark.sparkContext.applicationId not in _sent:
        _sent.add(spark.sparkContext.applicationId)
        root, path = Path(__file__).resolve().parents[1], os.path.join(tempfile.mkdtemp(), "sluice.zip")
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    for key, least, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "1b", "32m")):
        if spark.conf.get(key, least) == least:  # not set
            spark.conf.set(key, most)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's own part of the shared folder, which goes when the driver's JVM ends, or by ``drop``."""
    root, app = shared_dir(spark), spark.sparkContext.applicationId
    if _folders.get(app, "").rpartition("/")[0] != root:
        _folders[app] = f"{root}/sluice-{app}"
        fs, where = _place(spark, _folders[app])
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{_folders[app]}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage and shuffle files end here. With ``path`` add it to a table there."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    held = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            fs, where = _place(df.sparkSession, path)
            fs.delete(where, True)


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def _width(field: T.StructField):
    """A column's bytes in a row, about."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(16)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``most`` bytes. The look is a job of its own: give a saved or otherwise cheap frame."""
    size = functools.reduce(lambda a, b: a + b, map(_width, df.schema.fields))
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen["n"] <= limit and seen["bytes"] <= most


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``is_small``; otherwise the frame as it is, for a shuffle join."""
    return F.broadcast(df) if is_small(df, limit) else df


def join_on(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which holds each ``key`` once; keys that hold many of ``left``'s rows don't go to one task.

    Where ``right`` is small it is broadcast. Else the keys with more than one part in HOT_PARTS of
    all rows, fewer than HOT_PARTS by their definition, are joined by a broadcast of their rows of
    ``right``, and all others by a shuffle. ``counts``: (key, n) of ``left`` where known. Both frames are read
    more than once: give saved ones.
    """
    if is_small(right):
        return left.join(F.broadcast(right), key, how)
    counts = counts or left.groupBy(key).agg(F.count("*").alias("n"))
    counts = save(counts, "join-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_PARTS > total).select(key)  # fewer than HOT_PARTS rows
    if hot.isEmpty():
        return left.join(right, key, how)
    own = right.join(F.broadcast(hot), key, "left_semi")
    many = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(own), key, how)
    few = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return many.unionByName(few)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The column's values as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
