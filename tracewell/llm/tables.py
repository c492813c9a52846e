"""Shared-folder tables and small column helpers of the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the scratch blocks that are open, the innermost last.
_OPEN: list[str] = []
#: Buckets of the histogram from which a sample's threshold is read.
HASH_BUCKETS = 1 << 16
#: Bytes of text that a worker's function holds in other forms at a time, about.
PORTION = 500_000


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-tracewell-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only a local session without
    that setting (driver and executors are one process there) gets a folder of
    its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_own_dir(spark.sparkContext.applicationId)}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@lru_cache(maxsize=8)
def _application_dir(spark: SparkSession, base: str) -> str:
    """Folder of this application's tables; it goes when the driver's process ends with the session still up."""
    path = f"{base}/tracewell/{spark.sparkContext.applicationId}"

    def leave() -> None:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)

    atexit.register(leave)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_application_dir(spark, shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, but those that are kept."""
    path = new_path(spark, "scratch")
    _OPEN.append(path)
    try:
        yield
    finally:
        _OPEN.pop()
        remove(spark, path)


def stored(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage with files that outlive executors, so that a later pass
    neither repeats the work nor sees other values. ``keep``: the table outlives
    the innermost scratch block.
    """
    spark, around = df.sparkSession, _OPEN[:-1] if keep else _OPEN
    path = f"{around[-1]}/{name}-{uuid.uuid4().hex}" if around else new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` of ``rows``, whose ``key`` is distinct: those with the least hashes, the same in a rerun.

    The threshold comes from a histogram of hashes, of at most ``HASH_BUCKETS``
    rows, so nothing is sorted or gathered; where the buckets are all larger than
    ``most``, the first one is split by further hash bits.
    """
    seed, chosen = 0, rows
    while True:
        h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(HASH_BUCKETS))
        n = {r["h"]: r["n"] for r in chosen.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most HASH_BUCKETS rows
        if sum(n.values()) <= most:
            return chosen
        total, below = 0, 0
        for k in sorted(n):
            if total + n[k] > most:
                below = k
                break
            total += n[k]
        if total:
            return chosen.filter(h < below)
        chosen, seed = chosen.filter(h == below), seed + 1


def shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose columns that begin with an underscore have other names meanwhile: such names are the operators' own."""
    away = {c: f"kept{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    return work(docs.withColumnsRenamed(away)).withColumnsRenamed({v: k for k, v in away.items()})


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """All rows in their order, as slices that hold up to ``most`` bytes of the text in ``column``, or one longer text.

    A batch may hold tens of MB of text. What is made of it lies beside it, and a
    worker keeps the memory that it once took, so this is done by slices.
    """
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
