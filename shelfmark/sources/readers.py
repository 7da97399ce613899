"""Readers of listings and of what extractors report."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import ancestor_dirs, extension, name_of, parent_dir

# Patterns of what is never indexed, the marker of a folder that is not, and keys that repeat the file system.
IGNORED = ["*.part", "*.crdownload", "*.download", "*.tmp", "*.temp", "*.partial", "~$*", ".~lock.*", "Thumbs.db", "desktop.ini", ".DS_Store", "@eaDir/"]
MARKER = ".noindex"
FILE_KEYS = ["SourceFile", "Directory", "FileName", "FilePath", "FilePermissions", "FileModifyDate", "FileAccessDate", "FileInodeChangeDate", "FileTypeExtension"]
# Elements of override files, by the kind of their value.
OVERRIDE_KINDS = ["text", "int", "float", "date", "timeSpan", "blob"]
# Content type by extension.
MIME_BY_EXTENSION = {
    ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".md": "text/markdown", ".csv": "text/csv", ".xml": "text/xml", ".json": "application/json", ".pdf": "application/pdf", ".epub": "application/epub+zip",
    ".doc": "application/msword", ".rtf": "application/rtf", ".zip": "application/zip", ".7z": "application/x-7z-compressed", ".rar": "application/x-rar-compressed", ".exe": "application/x-msdownload", ".dll": "application/x-msdownload",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".svg": "image/svg+xml",
    ".mp3": "audio/mpeg", ".flac": "audio/flac", ".ogg": "audio/ogg", ".m4a": "audio/mp4", ".wav": "audio/wav", ".opus": "audio/opus", ".mp4": "video/mp4", ".mkv": "video/x-matroska", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".webm": "video/webm", ".wmv": "video/x-ms-wmv",
}
DIRECTORY, UNKNOWN = "inode/directory", "application/octet-stream"


def listing(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(path, size, modified) of the files below root; contents are not read.

    Spark's listing passes over names that begin with a dot, and so over markers.
    With hidden the folder source lists them too, in tasks; nothing is ignored there.
    """
    if hidden:
        from shelfmark.sources import foldertree

        foldertree.register(spark)
        found = spark.read.format(foldertree.FolderTree.name()).options(usual="false", marker="").load(root).where("not is_dir")
        scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]+)?", root)
        return found.select(F.concat(F.lit(scheme[0] if scheme else "file:"), "path").alias("path"), "size", "modified")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_folders(files: DataFrame) -> DataFrame:
    """files (path, size, modified) and the folders they lie in (path, is_dir, size, modified, n_entries), folders without a size."""
    above = files.select(F.explode(ancestor_dirs(F.col("path"))).alias("path")).where("path <> ''").distinct()
    every = files.select("path").unionByName(above)
    inside = every.groupBy(parent_dir(F.col("path")).alias("path")).agg(F.count("*").alias("n_entries"))
    last = files.select("modified", F.explode(ancestor_dirs(F.col("path"))).alias("path")).groupBy("path").agg(F.max("modified").alias("modified"))
    folders = above.join(inside, "path").join(last, "path").select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"), "modified", "n_entries")
    return files.select("path", F.lit(False).alias("is_dir"), "size", "modified", F.lit(None).cast("long").alias("n_entries")).unionByName(folders)


def mime_of(name: Column, is_dir: Column | None = None) -> Column:
    """Content type by extension."""
    known = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    found = F.coalesce(F.try_element_at(known, extension(name)), F.lit(UNKNOWN))
    return found if is_dir is None else F.when(is_dir, DIRECTORY).otherwise(found)


def file_facts(files: DataFrame) -> DataFrame:
    """files (path, is_dir, ...) with name, full path's folder and content type."""
    name = name_of(F.col("path"))
    return files.select("*", name.alias("name"), parent_dir(F.col("path")).alias("folder"), mime_of(name, F.col("is_dir")).alias("mime"))


def collected(spark: SparkSession, root: str, recursive: bool = True, extensions: tuple[str, ...] = (), max_files: int | None = None) -> DataFrame:
    """(path, size, modified) of files below root (or right in it), of some extensions, the first by path where a number is given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if extensions:
        found = found.where(extension(name_of(F.col("path"))).isin(*["." + x.lower().lstrip(".") for x in extensions]))
    return found if max_files is None else found.orderBy("path").limit(max_files)


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(pattern of paths, whether it takes back) of a line of an ignore file; None for a blank line or a comment."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    only_folders = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    out, i = "", 0
    while i < len(body):
        for sign, means in (("**/", "(?:.*/)?"), ("/**", "/.*"), ("*", "[^/]*"), ("?", "[^/]")):
            if body.startswith(sign, i):
                out, i = out + means, i + len(sign)
                break
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if only_folders else "(?:/|$)"), back


def accepted(files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """files without ignored paths and without all below a folder that holds the marker file.

    more are further lines of an ignore file; of all lines that fit a path the last decides.
    """
    hit = F.lit(False)
    for line in (*IGNORED, *more):
        rule = ignore_rule(line)
        if rule:
            hit = F.when(F.col("path").rlike(rule[0]), F.lit(not rule[1])).otherwise(hit)
    marked = files.where(name_of(F.col("path")) == MARKER).select(F.regexp_replace("path", r"/[^/]*$", "").alias("up"))
    above = files.select("path", F.explode(ancestor_dirs(F.col("path"))).alias("up"))
    barred = above.join(marked, "up", "left_semi").select("path").distinct()
    return files.where(~hit).join(barred, "path", "left_anti")


def _entries(json: Column) -> Column:
    return F.map_entries(F.from_json(json, "map<string,string>"))


def grouped_json(reports: DataFrame) -> DataFrame:
    """(file_id, namespace, key, value) of (file_id, json): the first object's scalars, keys as "Group:Tag"."""
    first = F.get(F.from_json("json", "array<map<string,string>>", {"mode": "PERMISSIVE"}), 0)
    rows = reports.select("file_id", F.explode(F.map_entries(first)).alias("e")).select("file_id", "e.key", "e.value")
    # Keys without a group are the tool's own, like its group.
    grouped = rows.where(F.col("key").rlike("^[^:]+:.") & F.col("value").isNotNull())
    split = grouped.select("file_id", F.lower(F.substring_index("key", ":", 1)).alias("namespace"), F.regexp_replace("key", "^[^:]*:", "").alias("key"), "value")
    scalar = ~F.col("value").rlike(r"^[\[{]") & ~F.lower("value").startswith("(binary data")
    return split.where(scalar & (F.col("namespace") != "exiftool") & ~F.lower("key").isin(*[k.lower() for k in FILE_KEYS]))


def parser_json(reports: DataFrame) -> DataFrame:
    """(file_id, part, namespace, key, value) of (file_id, json), an array of objects: part 0 is the document, others are embedded."""
    parts = reports.select("file_id", F.posexplode(F.from_json("json", "array<map<string,string>>")).alias("part", "fields"))
    rows = parts.select("file_id", "part", F.explode(F.map_entries("fields")).alias("e")).where(~F.col("e.key").startswith("X-TIKA:") & (F.trim(F.coalesce("e.value", F.lit(""))) != ""))
    has_ns = F.contains("e.key", F.lit(":"))
    values = F.when(F.col("e.value").startswith("["), F.from_json("e.value", "array<string>")).otherwise(F.array("e.value"))
    out = rows.select("file_id", "part", F.when(has_ns, F.substring_index("e.key", ":", 1)).otherwise("tika").alias("namespace"), F.when(has_ns, F.regexp_replace("e.key", "^[^:]*:", "")).otherwise(F.col("e.key")).alias("key"), F.explode(values).alias("value"))
    return out


def info_json(reports: DataFrame) -> DataFrame:
    """(file_id, definition, value) of (file_id, json): title, description, page, uploader, date, up to 30 tags and 10 categories."""
    fields = "title string, description string, webpage_url string, uploader string, channel string, upload_date string, tags array<string>, categories array<string>"
    j = F.from_json("json", fields)
    text = lambda d, c: F.array(F.struct(F.lit(d).alias("definition"), c.alias("value")))
    many = lambda d, c, n: F.transform(F.coalesce(F.slice(c, 1, n), F.array().cast("array<string>")), lambda v: F.struct(F.lit(d).alias("definition"), v.alias("value")))
    day = F.date_format(F.try_to_timestamp("j.upload_date", F.lit("yyyyMMdd")), "yyyy-MM-dd")
    one = [text(73, F.col("j.title")), text(46, F.col("j.description")), text(67, F.col("j.webpage_url")), text(75, F.coalesce("j.uploader", "j.channel")), text(45, day)]
    rows = reports.select("file_id", j.alias("j")).select("file_id", F.explode(F.concat(*one, many(72, F.col("j.tags"), 30), many(36, F.col("j.categories"), 10))).alias("e"))
    return rows.select("file_id", "e.definition", "e.value").where(F.trim(F.coalesce("value", F.lit(""))) != "")


def probe_streams(reports: DataFrame) -> DataFrame:
    """(file_id, stream, kind, bit_rate, ...) of (file_id, json): the streams a media probe lists, as media_rollup() takes them."""
    schema = "streams array<struct<index:int,codec_type:string,bit_rate:string,duration:string,width:int,height:int,r_frame_rate:double,avg_frame_rate:double,channels:int,sample_rate:int>>"
    s = reports.select("file_id", F.explode(F.from_json("json", schema)["streams"]).alias("s"))
    return s.select(
        "file_id", F.col("s.index").alias("stream"), F.col("s.codec_type").alias("kind"), F.col("s.bit_rate").try_cast("bigint").alias("bit_rate"), F.col("s.duration").try_cast("double").alias("duration"), "s.width", "s.height",
        F.col("s.r_frame_rate").alias("frame_rate"), F.col("s.avg_frame_rate").alias("average_rate"), "s.channels", "s.sample_rate",
    )


def _owned(spark: SparkSession, path: str, scope: str, tag: str, owner: Column) -> DataFrame:
    """Override rows of each element tag, whose name is owner."""
    one = "array<struct<_group:string,_name:string,_kind:string,_VALUE:string>>"
    kinds = ",".join(f"{k}:{one}" for k in OVERRIDE_KINDS)
    schema = "_name string, " + ", ".join(f"{k} {one}" for k in OVERRIDE_KINDS) + f", subResources struct<subResource:array<struct<_id:bigint,_name:string,_kind:string,{kinds}>>>"
    found = spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).schema(schema).load(path)

    def values(of: Callable[[str], Column], sub_id: Column, sub_name: Column, sub_kind: Column) -> Column:
        none = F.array().cast("array<struct<sub_id:bigint,sub_name:string,sub_kind:string,group:string,name:string,kind:string,value:string>>")

        def rows(kind: str) -> Column:
            def row(v: Column) -> Column:
                said = F.when(F.lower(v["_kind"]).isin("big", "formatted"), F.concat(F.lower(v["_kind"]), F.lit("Text"))).otherwise(kind) if kind == "text" else F.lit(kind)
                named = [sub_id.alias("sub_id"), sub_name.alias("sub_name"), sub_kind.alias("sub_kind"), v["_group"].alias("group"), v["_name"].alias("name")]
                return F.struct(*named, said.alias("kind"), F.coalesce(v["_VALUE"], F.lit("")).alias("value"))

            return F.coalesce(F.transform(of(kind), row), none)

        return F.concat(*map(rows, OVERRIDE_KINDS))

    nothing = F.lit(None).cast("string")
    own = values(lambda k: F.col(k), F.lit(None).cast("bigint"), nothing, nothing)
    below = F.flatten(F.transform(F.col("subResources.subResource"), lambda r: values(lambda k: r[k], r["_id"], r["_name"], r["_kind"])))
    rows = found.select(F.col("_metadata.file_path").alias("sidecar"), owner.alias("owner"), F.explode(F.concat(own, F.coalesce(below, F.slice(own, 1, 0)))).alias("e"))
    return rows.select("sidecar", F.lit(scope).alias("scope"), "owner", "e.*")


def override_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sidecar, scope, owner, sub_id, sub_name, sub_kind, group, name, kind, value) of override files.

    An override file holds an element file or collection for each owner, by name, or, in
    the older form, one element metadata for the single file that it lies beside; its owner
    is null. Each has elements text, int, float, date, timeSpan and blob with group and
    name, and the same below subResources. Owners are meant without regard to case.
    """
    named = [_owned(spark, path, scope, scope, F.col("_name")) for scope in ("file", "collection")]
    return named[0].unionByName(named[1]).unionByName(_owned(spark, path, "file", "metadata", F.lit(None).cast("string")))


def write_overrides(overrides: DataFrame, path: str, scope: str = "file", root: str = "overrides") -> None:
    """Writes rows of one scope, as override_xml() reads them, one element for each owner; rows without a value are none."""
    rows = overrides.where((F.col("scope") == scope) & (F.col("value") != ""))
    big = F.when(F.col("kind") == "bigText", "big").when(F.col("kind") == "formattedText", "formatted")
    entry = F.struct(F.col("group").alias("_group"), F.col("name").alias("_name"), big.alias("_kind"), F.col("value").alias("_VALUE"))
    tag = F.when(big.isNotNull(), "text").otherwise(F.col("kind"))
    some = lambda k: F.array_sort(F.collect_list(F.when(tag == k, entry)))
    lists = [F.when(F.size(some(k)) > 0, some(k)).alias(k) for k in OVERRIDE_KINDS]
    by_part = rows.groupBy("owner", "sub_id", "sub_name", "sub_kind").agg(*lists)
    own = by_part.where("sub_name is null").select(F.col("owner").alias("_name"), *OVERRIDE_KINDS)
    part = F.struct(F.col("sub_id").alias("_id"), F.col("sub_name").alias("_name"), F.lower("sub_kind").alias("_kind"), *OVERRIDE_KINDS)
    parts = by_part.where("sub_name is not null").groupBy(F.col("owner").alias("_name")).agg(F.struct(F.sort_array(F.collect_list(part)).alias("subResource")).alias("subResources"))
    own.join(parts, "_name", "full").write.format("xml").option("rootTag", root).option("rowTag", scope).mode("overwrite").save(path)


def zip_entries(archives: DataFrame) -> DataFrame:
    """(archive_id, archive_path, internal, size) of (archive_id, archive_path, content); what is no archive has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for archive, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with zipfile.ZipFile(BytesIO(content or b"")) as z:
                        rows += [(archive, path, e.filename, e.file_size) for e in z.infolist() if not e.is_dir()]
                except zipfile.BadZipFile:
                    continue
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive_id", "archive_path", "internal", "size"])

    return archives.select(F.col("archive_id").cast("long"), "archive_path", "content").mapInArrow(run, "archive_id long, archive_path string, internal string, size long")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
