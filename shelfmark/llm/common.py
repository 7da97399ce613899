"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in most contracts.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local master gets a folder of this machine and any
    other master a folder beside the warehouse.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            conf = "file:///tmp/checkpoints"
        else:
            conf = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{conf.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on Arrow batches of this session hold BATCH_BYTES at most: a worker and its JVM each hold a few."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    instead_of is an earlier table of this function that nothing else reads; it is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if instead_of is not None:
        forget(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of materialise(), of which nothing is read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent_if_few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to all workers in a join if it has at most so many rows (of fixed size); df is read for that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_KEPT: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What this Python worker remembers for one operator; that of another operator is forgotten first."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def give_back() -> None:
    """Freed memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the worker, which lives on idle beside others, gives freed memory back."""
    yield from batches
    give_back()


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(words: Iterable[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def window_hashes(word_hashes: np.ndarray, width: int, seed: int = 17) -> np.ndarray:
    """64-bit hashes of all windows of `width` consecutive words."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = odd_multipliers(width, seed)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += word_hashes[k : k + n] * mult[k]
    return mix64(total)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in tidied(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Texts with copies that are sent to all workers; more are joined by shuffle.
MAX_SENT_COPIES = 500_000


def with_share(df: DataFrame, text_hash: Column) -> DataFrame:
    """df with a column share: one over the number of rows of the same text, so that each distinct text adds up to 1."""
    many = materialise(df.groupBy(text_hash.alias("_copied")).agg(F.count("*").alias("_n")).where("_n > 1"), "copies")
    small = many.limit(MAX_SENT_COPIES + 1).count() <= MAX_SENT_COPIES
    joined = df.join(F.broadcast(many) if small else many, text_hash == F.col("_copied"), "left")
    return joined.withColumn("share", 1 / F.coalesce("_n", F.lit(1))).drop("_copied", "_n")
