"""Overrides, incremental snapshots, archives, media roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import cleaned, internal_path

MAX_ENTRIES = 50_000
MAX_PATH = 4096


def changed_overrides(overrides: DataFrame, baseline: DataFrame, owner: str = "file_id") -> DataFrame:
    """overrides (owner, definition, value) of definitions whose set of values differs from the baseline's; owners are files or collections."""
    as_set = lambda df, name: df.groupBy(owner, "definition").agg(F.array_sort(F.collect_set("value")).alias(name))
    both = as_set(overrides, "mine").join(as_set(baseline, "theirs"), [owner, "definition"], "left").where(~F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)))
    return overrides.join(both.select(owner, "definition"), [owner, "definition"], "left_semi").distinct()


def apply_overrides(attributes: DataFrame, overrides: DataFrame, owner: str = "file_id") -> DataFrame:
    """attributes (owner, definition, value) with those of an overridden definition replaced."""
    keys = overrides.select(owner, "definition").distinct()
    return attributes.join(keys, [owner, "definition"], "left_anti").withColumn("source", F.lit("extracted")).unionByName(overrides.withColumn("source", F.lit("override")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between snapshots (path, size, modified): created, changed (size, or over a second later) or missing."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("in_old"))
    n = new.select("path", F.col("size").alias("new_size"), F.col("modified").alias("new_modified"), F.lit(True).alias("in_new"))
    moved = F.abs(F.unix_micros("new_modified") - F.unix_micros("old_modified")) > 1_000_000
    change = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNull(), "missing").when(~F.col("old_size").eqNullSafe(F.col("new_size")) | F.coalesce(moved, F.lit(False)), "changed").otherwise("same")
    return o.join(n, "path", "full").select("path", change.alias("change"))


def mark_missing(files: DataFrame, found: DataFrame) -> DataFrame:
    """files (path, exists, in_archive) with exists as found (path) on disk; entries of archives are not looked for there."""
    there = found.select("path").distinct().withColumn("there", F.lit(True))
    now = F.when(F.col("in_archive"), F.col("exists")).otherwise(F.coalesce("there", F.lit(False)))
    return files.join(there, "path", "left").withColumn("exists", now).drop("there")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def under(path: Column, root: str) -> Column:
    """The path itself or anything below it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def soft_delete(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("exists", F.col("exists") & ~under(F.col("path"), root))


def hard_delete(files: DataFrame, root: str) -> DataFrame:
    return files.where(~under(F.col("path"), root))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """The folder or file and all below it under the new name."""
    return files.withColumn("path", F.when(under(F.col("path"), old), F.concat(F.lit(new), F.substring("path", F.lit(len(old) + 1), F.length("path")))).otherwise(F.col("path")))


def expand_archives(entries: DataFrame, max_entries: int = MAX_ENTRIES, archives: DataFrame | None = None) -> DataFrame:
    """(archive_id, path, internal, size[, created, modified]) of virtual files; entries is (archive_id, archive_path, internal, size).

    Entries of one path become one, the largest. An archive of more entries than
    the limit stays opaque; paths too long are left out. Times are those of the
    archive, from archives (archive_id, created, modified).
    """
    inner = entries.withColumn("internal", internal_path(F.col("internal"))).where("internal <> ''")
    one = inner.groupBy("archive_id", "archive_path", "internal").agg(F.max("size").alias("size"))
    few = one.groupBy("archive_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_entries).select("archive_id")
    out = one.join(few, "archive_id", "left_semi").withColumn("path", F.concat("archive_path", F.lit("!/"), "internal"))
    out = out.where(F.length("path") <= MAX_PATH).select("archive_id", "path", "internal", "size")
    return out if archives is None else out.join(archives.select("archive_id", "created", "modified"), "archive_id", "left")


def stale_entries(known: DataFrame, expanded: DataFrame) -> DataFrame:
    """The known entries that their archive has no more."""
    return known.join(expanded.select("archive_id", "internal"), ["archive_id", "internal"], "left_anti")


def first_content(contents: DataFrame) -> DataFrame:
    """(file_id, content): the first content that is not blank, by provider order."""
    return contents.where(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy("file_id").agg(F.min_by("content", "provider").alias("content"))


#: Columns of streams besides file_id, stream (their order) and kind; those that a table lacks count as null.
STREAM_COLUMNS = {"bit_rate": "long", "duration": "double", "width": "long", "height": "long", "aspect_ratio": "double", "frame_rate": "double", "average_rate": "double", "frames": "long", "bits": "long", "channels": "long", "sample_rate": "long"}


def media_rollup(streams: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """One row for each file from its streams (file_id, stream, kind and STREAM_COLUMNS).

    The rate of containers (file_id, bit_rate) counts where it is not 0, else the sum
    over audio and video. These two give the duration; video alone the largest picture
    (of equal ones the first), frame rate (the average where there is no real one) and
    frames; audio alone bits, channels and sample rate. Other kinds are only counted.
    """
    s = streams.select("file_id", "stream", "kind", *[(F.col(c) if c in streams.columns else F.lit(None)).cast(k).alias(c) for c, k in STREAM_COLUMNS.items()])
    video, audio = F.col("kind") == "video", F.col("kind") == "audio"
    pixels = F.col("width") * F.col("height")
    picture = F.when(video & pixels.isNotNull(), F.struct("width", "height", pixels.alias("pixels"), "aspect_ratio"))
    rate = F.coalesce(F.nullif("frame_rate", F.lit(0.0)), F.col("average_rate"))
    of = lambda kind, c, f=F.max: f(F.when(kind, c if isinstance(c, Column) else F.col(c)))
    out = s.groupBy("file_id").agg(
        F.nullif(of(audio | video, "bit_rate", F.sum), F.lit(0)).alias("summed"), of(audio | video, "duration").alias("duration"), F.max_by(picture, F.when(picture.isNotNull(), F.struct(pixels, -F.col("stream")))).alias("best"),
        of(video, rate).alias("frame_rate"), of(video, "frames").alias("frames"), of(audio, "bits").alias("bits"), of(audio, "channels").alias("channels"), of(audio, "sample_rate").alias("sample_rate"), F.count("*").alias("n_streams"),
    )
    given = F.lit(None).cast("long")
    if containers is not None:
        out, given = out.join(containers.select("file_id", F.col("bit_rate").cast("long").alias("given")), "file_id", "left"), F.nullif("given", F.lit(0))
    aspect = F.coalesce("best.aspect_ratio", F.col("best.width") / F.nullif("best.height", F.lit(0)))
    return out.select("file_id", "n_streams", F.coalesce(given, "summed").alias("bit_rate"), "duration", "best.width", "best.height", "best.pixels", aspect.alias("aspect_ratio"), "frame_rate", "frames", "bits", "channels", "sample_rate")


def key_statistics(raw: DataFrame) -> DataFrame:
    """(namespace, key, n_files, n_values, sample): sample is the first value, by file and sequence, on one line."""
    return raw.groupBy("namespace", "key").agg(F.count_distinct("file_id").alias("n_files"), F.count("*").alias("n_values"), cleaned(F.min_by("value", F.struct("file_id", "seq"))).alias("sample"))


def file_status(files: DataFrame, raw: DataFrame) -> DataFrame:
    """(status, n): how many files gave raw metadata, and how many none."""
    has = raw.select("file_id").distinct().withColumn("has", F.lit(True))
    return files.select("file_id").join(has, "file_id", "left").groupBy(F.when(F.col("has"), "OK").otherwise("Empty").alias("status")).agg(F.count("*").alias("n"))
