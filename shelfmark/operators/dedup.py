"""Duplicate files by staged hashing: size, then a prefix, then the whole content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PREFIX_BYTES = 65_536
MIN_SIZE = 1 << 20


def size_collisions(files: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """(size, n) of sizes that several files share."""
    return files.where(F.col("size") >= min_size).groupBy("size").agg(F.count("*").alias("n")).where("n > 1")


def staged(files: DataFrame, min_size: int = MIN_SIZE, prefix: int = PREFIX_BYTES) -> DataFrame:
    """(file_id, path, size, checksum) of files that share size and prefix hash with another.

    Sizes are counted without content. Only then are prefixes hashed, and only of
    those that still collide is the content read whole.
    """
    sized = files.where(F.col("size") >= min_size).join(size_collisions(files, min_size).select("size"), "size", "left_semi")
    data = F.encode("content", "UTF-8")
    keyed = sized.withColumn("prefix_hash", F.upper(F.sha2(F.substring(data, 1, prefix), 256)))
    shared = keyed.groupBy("size", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1").select("size", "prefix_hash")
    return keyed.join(shared, ["size", "prefix_hash"], "left_semi").select("file_id", "path", "size", F.upper(F.sha2(data, 256)).alias("checksum"))


def unhashed(files: DataFrame, hashed: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """The files that are large enough to be hashed and are not among hashed (file_id)."""
    return files.where(F.col("size") >= min_size).join(hashed.select("file_id"), "file_id", "left_anti")


def duplicate_sets(hashed: DataFrame) -> DataFrame:
    """(checksum, size, n, path): the files of sets of equal files, one row each, as a set may be of any size."""
    sets = hashed.groupBy("checksum", "size").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(sets, ["checksum", "size"]).select("checksum", "size", "n", "path")


def largest_sets(hashed: DataFrame, top: int) -> DataFrame:
    """(checksum, size, n, first_path) of the sets of most files, then of the largest; first_path is the first without case."""
    first = F.min_by("path", F.struct(F.lower("path"), F.col("path"))).alias("first_path")
    sets = hashed.groupBy("checksum", "size").agg(F.count("*").alias("n"), first).where("n > 1")
    return sets.orderBy(F.desc("n"), F.desc("size"), "checksum").limit(top)


def others_with_hash(hashed: DataFrame) -> DataFrame:
    """(file_id, others): how many other files share a file's checksum."""
    shared = hashed.groupBy("checksum").agg(F.count("*").alias("n"))
    return hashed.join(shared, "checksum").select("file_id", (F.col("n") - 1).alias("others"))


def integrity(files: DataFrame) -> DataFrame:
    """(file_id, checksum) of all files."""
    return files.where("content is not null").select("file_id", F.upper(F.sha2(F.encode("content", "UTF-8"), 256)).alias("checksum"))
