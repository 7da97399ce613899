"""Listings of folders, the members of items, display groups and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.classify import AUDIO_EXTENSIONS, IMAGE_EXTENSIONS, is_image
from shelfmark.functions.paths import extension, name_of, natural_key, parent_dir

# Names of an item's cover in order of preference, and videos inside archives that are read again.
ITEM_COVERS = ["cover", "folder", "front", "poster", "albumart", "thumb", "logo"]
ARCHIVED_VIDEOS = ".mkv .mp4 .avi .mov .webm .wmv .flv .m4v .mpg .mpeg .ts .m2ts .ogv .3gp".split()
#: What separates an archive from what lies in it.
INSIDE = "!/"
#: What is derived from the disk and never edited.
FILE_GROUP = "File attributes"


def lookup(files: DataFrame, path: str) -> DataFrame:
    """The file of a path."""
    return files.where(F.col("path") == F.lit(path)).limit(1)


def folder(entries: DataFrame, sort: str = "name", show_hidden: bool = False) -> DataFrame:
    """entries (path, is_dir, size, mime, modified) of a folder, folders first, with keys that sort them.

    Files go by name, size, type or modified; folders by name, or by modified.
    Equal entries go by name and path. Names with a dot in front are hidden.
    """
    name = name_of(F.col("path"))
    shown = entries if show_hidden else entries.where(~name.startswith("."))
    number = {"size": F.when(~F.col("is_dir"), F.col("size")), "modified": F.unix_micros("modified")}.get(sort, F.lit(None)).cast("long")
    text = F.when(~F.col("is_dir"), F.lower("mime")) if sort == "type" else F.lit(None).cast("string")
    keyed = shown.select("*", name.alias("name"), number.alias("number_key"), text.alias("text_key"), natural_key(name).alias("name_key"))
    return keyed.orderBy(F.desc("is_dir"), F.asc_nulls_first("number_key"), F.asc_nulls_first("text_key"), "name_key", "path")


def entries_of(files: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive_path, path, internal) of the files that lie in archives; files has parent_id, archives file_id and path."""
    above = archives.select(F.col("file_id").alias("parent_id"), F.col("path").alias("archive_path"))
    return files.join(above, "parent_id").select("archive_path", "path", F.substring_index("path", INSIDE, -1).alias("internal"))


def read_again(internal: Column) -> Column:
    """Whether an archive's entry is audio, image or video, which path providers read again."""
    return extension(name_of(internal)).isin(*AUDIO_EXTENSIONS, *IMAGE_EXTENSIONS, *ARCHIVED_VIDEOS)


def item_members(associated: DataFrame) -> DataFrame:
    """(item_id, group, name, path, in_archive) of the files of items: content, sidecars and resources."""
    group = F.when(F.col("role") == "Primary", "content").when(F.col("role") == "Sidecar", "sidecars").otherwise("resources")
    own = associated.where("item_id is not null")
    return own.select("item_id", group.alias("group"), name_of(F.col("path")).alias("name"), "path", F.contains("path", F.lit(INSIDE)).alias("in_archive"))


def _cover_rank(path: Column) -> Column:
    base = F.lower(F.regexp_replace(name_of(path), r"\.[^./\\]*$", ""))
    place = F.array_position(F.array(*[F.lit(x) for x in ITEM_COVERS]), base)
    return F.struct(F.when(place == 0, len(ITEM_COVERS) + 1).otherwise(place), F.lower(path), path)


def item_covers(associated: DataFrame) -> DataFrame:
    """(item_id, cover) of items that have one: their primary file if it is an image, else the best image
    among their companions, else the best among the companions in the folder of the primary file."""
    image = is_image(name_of(F.col("path")), F.lit(None).cast("string"))
    best = lambda df, key: df.groupBy(key).agg(F.min_by("path", _cover_rank(F.col("path"))).alias("cover"))
    primary = associated.where("role = 'Primary' and item_id = file_id").select("item_id", "path", parent_dir(F.col("path")).alias("folder"))
    companions = associated.where((F.col("role") == "Companion") & image)
    own = best(companions.where("item_id is not null"), "item_id").withColumnRenamed("cover", "own_cover")
    near = best(companions.select("path", parent_dir(F.col("path")).alias("folder")), "folder").withColumnRenamed("cover", "near_cover")
    found = primary.join(own, "item_id", "left").join(near, "folder", "left")
    cover = F.coalesce(F.when(is_image(name_of(F.col("path")), F.lit(None).cast("string")), F.col("path")), "own_cover", "near_cover")
    return found.select("item_id", cover.alias("cover")).where("cover is not null")


def display_groups(attributes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file_id, group, name, value) of file-level attributes, each pair of name and value once, to be shown by group and name."""
    named = attributes.join(F.broadcast(definitions.select("definition", "group", "name")), "definition")
    return named.where("value is not null and value <> ''").select("file_id", "group", "name", "value").distinct()


def by_subresource(attributes: DataFrame) -> DataFrame:
    """(file_id, sub_resource, n): attributes of each part of a file; file-level ones are left out."""
    return attributes.where("sub_resource is not null").groupBy("file_id", "sub_resource").agg(F.count("*").alias("n"))


def addable(definitions: DataFrame) -> DataFrame:
    """(group, name) of the definitions that may be added to a file, in that order."""
    return definitions.where("not read_only and group is not null").select("group", "name").orderBy("group", "name")


def editable(edits: DataFrame, definitions: DataFrame) -> DataFrame:
    """edits (file_id, group, name, value) of known definitions that may be written, with definition; values trimmed, empty ones dropped."""
    may = definitions.where((~F.col("read_only")) & (F.col("group") != FILE_GROUP)).select("definition", "group", "name")
    trimmed = edits.withColumn("value", F.trim("value")).where("value <> ''")
    return trimmed.join(F.broadcast(may), ["group", "name"])


def jobs_summary(jobs: DataFrame) -> DataFrame:
    """(n_jobs, message, progress) of running jobs (name, status, progress): one by its name and status, several by their number."""
    own = F.concat(F.min("name"), F.when(F.min("status") != "", F.concat(F.lit(" ("), F.min("status"), F.lit(")"))).otherwise(""))
    n = F.count("*")
    message = F.when(n == 1, own).when(n > 1, F.concat(F.lit("Running "), n.cast("string"), F.lit(" jobs")))
    return jobs.agg(n.alias("n_jobs"), message.alias("message"), F.avg("progress").alias("progress"))


def incomplete(files: DataFrame) -> DataFrame:
    """The paths whose extraction failed for the time being and is to be repeated."""
    return files.where("incomplete and exists").select("path")
