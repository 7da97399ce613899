"""The driver's tables in the shape of the catalogue: files, raw metadata, attributes.

Each Spark view stands beside the DuckDB text of the same view in
shelfmark.plans.oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.scratch import shared_dir, stored
from shelfmark.operators.textindex import TextIndex

#: Indexes that this session wrote, by application, table and its state.
_INDEXES: dict[tuple, TextIndex] = {}
#: Layers that this session wrote, alike.
_LAYERS: dict[tuple, DataFrame] = {}
PAGES, CHATS, MUSIC = 10_000_000, 20_000_000, 30_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(id_: Column, path: Column, size: Column, mime: str, content: Column) -> list[Column]:
    return [id_.cast("long").alias("file_id"), path.alias("path"), size.cast("long").alias("size"), F.lit(mime).alias("mime"), content.alias("content")]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.select(*_file(F.col("doc_id"), path, F.octet_length("text"), "text/plain", F.col("text")))


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What tells a table of this session from another or a later one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength()


def document_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of document_files(), written when it is first asked for and again when the table is another."""
    key = _state(spark, sf_dir, "documents")
    if key not in _INDEXES:
        index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}")
        index.refresh(document_files(spark, sf_dir).select("file_id", "content"))
        _INDEXES[key] = index
    return _INDEXES[key]


def kept(spark: SparkSession, sf_dir: str, table_name: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A layer that queries share: made from a table and written when it is first asked for, and again when the table is another."""
    key = (name, *_state(spark, sf_dir, table_name))
    if key not in _LAYERS:
        _LAYERS[key] = stored(make(), name)
    return _LAYERS[key]


def page_path() -> Column:
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://", "")
    return F.concat(F.lit("web/"), bare)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages")
    return t.select(*_file(F.col("page_id") + PAGES, page_path(), F.octet_length("html"), "text/html", F.col("html")))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return t.select(*_file(F.col("conv_id") * 1000 + F.col("turn") + CHATS, path, F.octet_length("text"), "text/plain", F.col("text")))


def music_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("music"), "p_brand", "p_type", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".flac")))
    return t.select(*_file(F.col("p_partkey") + MUSIC, path, F.floor(F.col("p_retailprice") * 1000), "audio/flac", F.lit(None).cast("string")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, size, mime, content) of everything."""
    parts = [f(spark, sf_dir) for f in (document_files, page_files, chat_files, music_files)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, role) of labelled documents."""
    role = F.when(F.col("toxic") == 1, "Companion").when(F.col("quality") == 0, "Sidecar").otherwise("Primary")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), role.alias("role"))


def _keyed(t: DataFrame, id_: Column, pairs: list[tuple[int, str, str, Column]]) -> DataFrame:
    """One row for each (sequence number, namespace, key, value) of each row of t, in a single scan.

    A small table lies in one or two tasks; its rows are dealt out first, before each becomes many.
    """
    entries = F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(ns).alias("namespace"), F.lit(key).alias("key"), value.cast("string").alias("value")) for seq, ns, key, value in pairs])
    return t.repartition(id_).select(id_.cast("long").alias("file_id"), F.explode(entries).alias("e")).select("file_id", "e.seq", "e.namespace", "e.key", "e.value")


def music_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    return _keyed(t, k + MUSIC, [
        (1, "vorbis", "artist", F.col("p_brand")), (2, "vorbis", "ALBUMARTIST ", F.col("p_brand")), (3, "vorbis", "album", F.col("p_type")), (4, "vorbis", "track", k),
        (5, "vorbis", "genre", F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit("; "), F.element_at(F.split("p_name", " "), 1))), (6, "vorbis", "year", 1950 + F.col("p_size")),
        (7, "tika", "samplerate", F.concat(size, F.lit(".5 kHz"))), (8, "tika", "bitrate", F.concat((F.lit(64) + k % 300).cast("string"), F.lit(" kbps"))),
        (9, "tika", "replaygain_track_gain", F.concat(F.lit("-"), size, F.lit(".25 dB"))), (10, "xmpdm", "duration", F.concat(size, F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))),
        (11, "tika", "tracktotal", F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))), (12, "xmpdm", "artist", F.col("p_brand")), (13, "tika", "comment-x", F.col("p_name")),
    ])


def text_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _keyed(table(spark, sf_dir, "documents"), F.col("doc_id"), [(1, "dc", "language", F.col("lang")), (2, "dc", "publisher", F.col("source")), (3, "tika", "content-type", F.lit("text/plain; charset=utf-8"))])
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    titled = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    pages = _keyed(titled, F.col("page_id") + PAGES, [(1, "dc", "title", F.col("title")), (2, "tika", "content-type", F.lit("text/html"))])
    return docs.unionByName(pages)


def event_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows that no rule knows."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.lit("watch").alias("namespace"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"))


def date_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _keyed(t, F.col("o_orderkey"), [(1, "dcterms", "created", day), (2, "exif", "datetimeoriginal", F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 01:02:03"))), (3, "vorbis", "date", F.when(F.col("o_orderkey") % 5 == 0, "0000-00-00").otherwise(day))])


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, seq, namespace, key, value) of files with raw metadata."""
    return music_raw(spark, sf_dir).unionByName(text_raw(spark, sf_dir))
