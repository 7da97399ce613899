"""Queries of what changes over time and of what lies in stores: snapshots, a watcher in batch and stream, folders, archives, reports."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import associate as assoc
from shelfmark.operators import collections as coll
from shelfmark.operators import collector, layers, normalize, snapshots
from shelfmark.operators.scratch import shared_dir
from shelfmark.operators.snapshots import Catalogue, Snapshot
from shelfmark.plans import adapters as a
from shelfmark.plans import oracle as o
from shelfmark.plans.browsing import _FOLDED
from shelfmark.plans.catalog import _associated, _folded, _snapshots, _tree, query
from shelfmark.sources.stores import opened
from shelfmark.sources import archives, foldertree
from shelfmark.streaming import watch


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_CHANGED = "(o_orderkey % 7 = 0 OR (o_orderkey % 11 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)))"
_THERE = "NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)"


@query("snapshot_upsert", f"""SELECT 'orders/' || o_orderkey AS path, (floor(o_totalprice) + CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, o_orderkey % 11 <> 0 AS "exists",
  CASE WHEN NOT {_CHANGED} THEN 'hash of ' || o_orderkey END AS prefix_hash, {_CHANGED} AS needs_update FROM orders WHERE {_THERE}""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot of the orders after a second listing: what is new or changed loses its hash and is due."""
    old, new = _snapshots(spark, sf_dir)
    files = Snapshot(spark, _place(spark, "files"), snapshots.FILES, buckets=8)
    first = old.withColumns({"exists": F.lit(True), "prefix_hash": F.concat(F.lit("hash of "), F.substring_index("path", "/", -1)), "needs_update": F.lit(False)})
    files.apply(first, lambda rows, changes: changes)
    files.apply(snapshots.changed_files(files.read(), new), snapshots.upsert_files)
    return files.read().drop("modified")


def _sizes(files: DataFrame) -> DataFrame:
    """An extractor: the size of a file, and for each even one its evenness."""
    each = F.array(F.struct(F.lit(1).alias("definition"), F.col("size").cast("string").alias("value")), F.when(F.col("size") % 2 == 0, F.struct(F.lit(2).alias("definition"), F.lit("even").alias("value"))))
    return files.select("path", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("path", "x.definition", "x.value", F.lit("sizes").alias("provider"))


@query("snapshot_attributes", f"""WITH f AS (SELECT 'orders/' || o_orderkey AS path, o_orderkey AS k, (floor(o_totalprice) + CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS size FROM orders WHERE {_THERE})
SELECT path, 1 AS definition, size::VARCHAR AS value, 'sizes' AS provider FROM f UNION ALL SELECT path, 2, 'even', 'sizes' FROM f WHERE size % 2 = 0 UNION ALL SELECT path, 38, 'kept', 'promotion' FROM f WHERE k % 7 <> 0 AND k % 20 = 1""")
def snapshot_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings are indexed in turn: attributes of changed files are extracted anew, promoted ones stay."""
    old, new = _snapshots(spark, sf_dir)
    catalogue = Catalogue(spark, _place(spark, "catalogue"), buckets=8)
    catalogue.index(old, _sizes)
    key = F.substring_index("path", "/", -1).cast("long")
    promoted = old.where(key % 20 == 1).select("path", F.lit(38).alias("definition"), F.lit("kept").alias("value"), F.lit("promotion").alias("provider"))
    catalogue.attributes.apply(promoted, DataFrame.unionByName)
    catalogue.index(new, _sizes)
    return catalogue.attributes.read()


_KINDS = {"signup": "created", "view": "changed", "error": "changed", "click": "deleted", "purchase": "renamed"}
_EVENTS = f"""e AS (SELECT 'user/' || user_id AS path, CASE WHEN event_type = 'purchase' THEN 'user/' || (user_id + 7) END AS target, epoch_us(ts) AS t,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())} END AS event, event_id AS seq FROM events),
w AS (SELECT *, min(CASE WHEN event <> 'renamed' THEN t END) OVER (PARTITION BY path ORDER BY t, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e),
act AS (SELECT path, target, t + CASE WHEN event IN ('created', 'changed') THEN 3600000000 ELSE 0 END AS moment, t, CASE WHEN event IN ('created', 'changed') THEN 'index' ELSE event END AS action, seq
  FROM w WHERE event NOT IN ('created', 'changed') OR nxt IS NULL OR nxt - t >= 3600000000)"""
#: Microseconds of quiet in these queries: an hour, as the events lie minutes apart.
_HOUR = 3_600_000_000


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.table(spark, sf_dir, "events")
    user = lambda n: F.concat(F.lit("user/"), n.cast("string"))
    event = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    return t.select(user(F.col("user_id")).alias("path"), F.when(F.col("event_type") == "purchase", user(F.col("user_id") + 7)).alias("target"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event"), F.col("event_id").alias("seq"))


@query("watch_actions", f"WITH {_EVENTS} SELECT path, target, make_timestamp(moment) AS \"at\", action, seq FROM act")
def watch_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher does about the events: files are indexed after an hour of quiet, deletes cancel that and act at once, renames are told."""
    return watch.actions(_watched(spark, sf_dir), _HOUR).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("stream_applied", f"""WITH {_EVENTS}, mark AS (SELECT (max(t) // 1000 - 3600000) AS ms FROM e), told AS (SELECT act.* FROM act, mark WHERE (t + 3600000000 + 999) // 1000 <= ms),
p AS (SELECT path, moment, seq, action = 'index' AS there FROM told UNION ALL SELECT target, moment, seq, true FROM told WHERE action = 'renamed')
SELECT path, arg_max(there, (moment, seq)) AS "exists", make_timestamp(max(moment) FILTER (WHERE there)) AS indexed, make_timestamp(max(moment)) AS "at", arg_max(seq, (moment, seq)) AS seq FROM p GROUP BY path""")
def stream_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, applied batch by batch to a stored state; what the watermark leaves undecided is not told."""
    where = _place(spark, "watch")
    events = _watched(spark, sf_dir)
    events.write.parquet(f"{where}/in")
    state = Snapshot(spark, f"{where}/state", watch.STATE, buckets=8)
    watch.run(spark.readStream.schema(events.schema).parquet(f"{where}/in"), state, f"{where}/checkpoint", "1 hour", _HOUR)
    return state.read().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("indexed", "at")})


@query("folder_walk", """WITH f AS (SELECT DISTINCT 'size=' || p_size AS a, 'k=' || p_partkey % 3 AS b FROM part) SELECT DISTINCT a AS path, (SELECT count(DISTINCT b) FROM f g WHERE g.a = f.a) AS n_folders, 0::BIGINT AS n_rows FROM f
UNION ALL SELECT 'size=' || p_size || '/k=' || p_partkey % 3, 0, count(*) FROM part GROUP BY 1""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written by size and key, and the tree of their folders walked: each with the folders in it, and the rows of its files."""
    where = _place(spark, "parts")
    parts = a.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), (F.col("p_partkey") % 3).alias("k"))
    parts.repartition("size").write.partitionBy("size", "k").parquet(where)
    foldertree.register(spark)
    walked = spark.read.format("folder_tree").option("partitions", 8).load(where)
    inside = F.regexp_extract("path", r"/parts-[0-9a-f]{12}/(.*)$", 1)
    up = F.regexp_extract(inside, "^(.*)/[^/]*$", 1)
    folders = walked.where("is_dir").select(inside.alias("path"))
    below = walked.where("is_dir").groupBy(up.alias("path")).agg(F.count("*").alias("n_folders"))
    files = walked.where("not is_dir and path like '%.parquet'").select("path", up.alias("folder"))
    rows = spark.read.parquet(where).select(F.col("_metadata.file_path").alias("read")).groupBy("read").agg(F.count("*").alias("n"))
    held = files.join(rows, F.endswith("read", F.regexp_extract("path", r"(/[^/]*)$", 1)) & (F.substring_index("read", "/", -3) == F.substring_index("path", "/", -3)))
    n_rows = held.groupBy(F.col("folder").alias("path")).agg(F.sum("n").alias("n_rows"))
    return folders.join(below, "path", "left").join(n_rows, "path", "left").fillna(0, ["n_folders", "n_rows"])


def _written_archives(docs: DataFrame, where: str, most: int = archives.MAX_ENTRIES) -> DataFrame:
    """(archive): each task writes its documents (doc_id, text) into archives below a shared folder, one entry after the other.

    An archive takes as many entries as a listing allows, then the next is begun.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(where)
        store.create_dir(folder)
        rows = ((doc_id, text) for batch in batches for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)))
        for first in rows:
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{folder}/{name}") as out, zipfile.ZipFile(io.BufferedWriter(out), "w", zipfile.ZIP_DEFLATED) as z:
                for doc_id, text in chain([first], islice(rows, most - 1)):
                    z.writestr(f"texts/Doc {doc_id}.TXT", text or "")
            yield pa.RecordBatch.from_pydict({"archive": [f"{where}/{name}"]})

    return docs.select("doc_id", "text").mapInArrow(run, "archive string")


@query("archive_contents", "SELECT 'texts/Doc ' || doc_id || '.TXT' AS internal, 'TEXTS/doc ' || doc_id || '.txt' AS asked, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents")
def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into ZIP archives, listed, asked for in other letters and read in place."""
    where = _place(spark, "zips")
    made = _written_archives(a.table(spark, sf_dir, "documents"), where).collect()
    listed = archives.archive_entries(spark.createDataFrame(made, "archive string"))
    asked = listed.select("archive", F.replace(F.lower("internal"), F.lit("texts"), F.lit("TEXTS")).alias("internal"))
    found = archives.found_entries(listed, asked)
    parts = archives.entry_parts(found)
    whole = parts.groupBy("archive", "internal").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("parts"), F.max("error").alias("error")).where("error is null")
    content = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, F.coalesce(p["content"], F.lit(b""))))
    return whole.select("archive", "internal", F.md5(content).alias("digest")).join(found.select("archive", "internal", "asked", "size"), ["archive", "internal"]).select("internal", "asked", "size", "digest")


# --- reports, names and comments ------------------------------------------------------------

_PROBE = "probe"
#: Raw values of parts by three providers: rules know some of the first's keys, aliases some of the probe's, one of which is ignored.
_COLLECTED = """r(file, provider, namespace, key, value, seq) AS (SELECT 'part/' || p_partkey, x.* FROM part, LATERAL (VALUES ('reader', 'vorbis', 'artist', p_brand, 1), ('reader', 'vorbis', 'no rule', '  ' || p_type || chr(10), 2),
  ('reader', 'VORBIS', 'No Rule ', p_name, 3), ('probe', 'format', ' TITLE', p_name, 4), ('probe', 'format', 'x-unknown', p_brand, 5), ('probe', 'format', 'TLEN', '12', 6), ('other', 'dc', 'nothing', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE 'odd' END, 7)) AS x WHERE p_partkey % 5 <> 0),
m AS (SELECT file, provider, namespace, key, trim(regexp_replace(value, '[\r\n\t]', ' ', 'g')) AS value, seq, key IN ('artist', ' TITLE') AS mapped, key = 'TLEN' AS ignored FROM r WHERE trim(value) <> '')"""


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = a.table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = [
        ("reader", "vorbis", "artist", F.col("p_brand")), ("reader", "vorbis", "no rule", F.concat(F.lit("  "), "p_type", F.lit("\n"))), ("reader", "VORBIS", "No Rule ", F.col("p_name")), (_PROBE, "format", " TITLE", F.col("p_name")),
        (_PROBE, "format", "x-unknown", F.col("p_brand")), (_PROBE, "format", "TLEN", F.lit("12")), ("other", "dc", "nothing", F.when(k % 2 == 0, " ").otherwise("odd")),
    ]
    each = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(n).alias("namespace"), F.lit(key).alias("key"), v.alias("value"), F.lit(i + 1).alias("seq")) for i, (p, n, key, v) in enumerate(rows)])
    return t.where("p_partkey % 5 <> 0").select(F.concat(F.lit("part/"), k.cast("string")).alias("file"), F.explode(each).alias("x")).select("file", "x.*", F.lit(None).cast("string").alias("sub_resource"))


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The raw and canonical reports and the summary of parts, every fifth of which gave nothing, every tenth by an error."""
    raw = collector.raw_report(_collected(spark, sf_dir), _PROBE)
    made = raw.where("mapped").select("file", F.when(F.col("provider") == _PROBE, 73).otherwise(7).alias("definition"), "value", "provider", "sub_resource")
    canonical = collector.canonical_report(made, normalize.definitions_table(spark))
    files = a.table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("k"))
    errors = files.where("k % 10 = 0 or k % 7 = 0").select("file", F.lit(1).alias("seq"), F.lit("reader: broken").alias("error"))
    return raw, canonical, collector.file_summary(files, raw, canonical, errors)


@query("collector_raw", f"WITH {_COLLECTED} SELECT file, provider, namespace, key, value, mapped, ignored FROM m")
def collector_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[0].drop("seq", "sub_resource")


@query("collector_unmapped", f"WITH {_COLLECTED} SELECT provider, lower(namespace) AS namespace, lower(trim(key)) AS key, count(DISTINCT file) AS files, count(*) AS occurrences, arg_min(value, (file, seq)) AS sample_value FROM m WHERE NOT mapped AND NOT ignored GROUP BY 1, 2, 3")
def collector_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collector.unmapped_report(_reports(spark, sf_dir)[0])


@query("collector_files", f"WITH {_COLLECTED}, c AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE NOT mapped AND NOT ignored) AS u, count(*) FILTER (WHERE mapped) AS k FROM m GROUP BY file) SELECT 'part/' || p_partkey AS file, CASE WHEN n > 0 THEN 'OK' WHEN p_partkey % 10 = 0 OR p_partkey % 7 = 0 THEN 'Error' ELSE 'Empty' END AS status, coalesce(n, 0) AS raw_items, coalesce(u, 0) AS unmapped_items, coalesce(k, 0) AS canonical_items, CASE WHEN p_partkey % 10 = 0 OR p_partkey % 7 = 0 THEN 'reader: broken' END AS error FROM part LEFT JOIN c ON c.file = 'part/' || p_partkey")
def collector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[2]


@query("collector_totals", f"WITH {_COLLECTED}, s AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN 'OK' WHEN p_partkey % 10 = 0 OR p_partkey % 7 = 0 THEN 'Error' ELSE 'Empty' END AS status FROM part) SELECT 'status' AS kind, status AS name, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'provider', provider, count(*) FROM m GROUP BY provider UNION ALL SELECT 'mapping', CASE WHEN mapped THEN 'mapped' WHEN ignored THEN 'ignored' ELSE 'unmapped' END, count(*) FROM m GROUP BY 2")
def collector_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _, summary = _reports(spark, sf_dir)
    return collector.totals(summary, raw)


@query("collector_canonical", f"WITH {_COLLECTED} SELECT file, CASE provider WHEN 'probe' THEN 'General' ELSE 'Audio' END AS \"group\", CASE provider WHEN 'probe' THEN 'Title' ELSE 'Artist' END AS attribute, value, provider AS source_provider FROM m WHERE mapped")
def collector_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)[1].select("file", "group", "attribute", "value", "source_provider")


_ALIASES = {x.alias for x in normalize.vocabulary.aliases()}
#: Of some types the first name that is no alias, and one that nothing has.
_NAMED = [next((d.name for d in normalize.vocabulary.definitions() if d.type == t and d.name.lower() not in _ALIASES), "no such name") for t in ("Integer", "Date", "TimeSpan", "BigText")] + ["Whatever"]
_VALUES = ["12", "twelve", "2020-01-31", "0:01:02", "1.5"]


@query("typed_names", """WITH d(name, type, definition) AS (VALUES {defs}), e AS (SELECT event_id, {names}[(event_id % 5 + 1)::INT] AS name, {values}[(event_id // 5 % 5 + 1)::INT] AS value FROM events),
f AS (SELECT e.*, d.definition, CASE d.type WHEN 'Integer' THEN value = '12' WHEN 'Float' THEN value IN ('12', '1.5') WHEN 'Date' THEN value = '2020-01-31' WHEN 'TimeSpan' THEN value IN ('12', '0:01:02', '1.5') ELSE true END AS fits FROM e LEFT JOIN d ON d.name = lower(e.name))
SELECT event_id, name, value, min(definition) FILTER (WHERE fits) AS definition FROM f GROUP BY ALL""".format(
    defs=", ".join(f"('{d.name.lower()}', '{d.type}', {d.id})" for d in normalize.vocabulary.definitions() if d.name.lower() in {n.lower() for n in _NAMED}), names=_NAMED, values=_VALUES))
def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no alias knows are taken by name where the value fits the type, and are new otherwise."""
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (n % 5 + 1).cast("int"))
    k = F.col("event_id")
    pairs = a.table(spark, sf_dir, "events").select("event_id", pick(_NAMED, k).alias("name"), pick(_VALUES, F.floor(k / 5)).alias("value"))
    return normalize.resolve_aliases(pairs, value="value")


@query("collection_comments", _FOLDED + "\nSELECT a.folder AS collection, 38 AS definition, 'about ' || min(a.path) AS value FROM associated a JOIN done d ON d.folder = a.folder AND (d.is_c OR d.st) WHERE a.kind = 'Nfo' AND a.folder NOT LIKE '%Show 3%' GROUP BY a.folder")
def collection_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of .nfo files in collections, some of which have a comment."""
    contents = _tree(spark, sf_dir).select("file_id", F.concat(F.lit(" \n about "), "path", F.lit("\t")).alias("content"))
    folded = _folded(spark, sf_dir)
    known = folded.where("folder like '%Show 3%'").select(F.col("folder").alias("collection"), F.lit(38).alias("definition"))
    return coll.comments(folded, _associated(spark, sf_dir), contents, known)


@query("archive_times", "SELECT conv_id AS archive_id, 'chat/' || conv_id || '.zip!/' || turn || '.txt' AS path, TIMESTAMP '2020-01-01' + to_seconds(conv_id) AS created, TIMESTAMP '2021-01-01' + to_seconds(conv_id) AS modified FROM conversations")
def archive_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in an archive has its times."""
    t = a.table(spark, sf_dir, "conversations")
    archive = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".zip"))
    at = lambda start: F.timestamp_seconds(F.lit(start) + F.col("conv_id"))
    times = t.select("conv_id").distinct().select(F.col("conv_id").alias("archive_id"), at(1_577_836_800).alias("created"), at(1_609_459_200).alias("modified"))
    entries = t.select(F.col("conv_id").alias("archive_id"), archive.alias("archive_path"), F.concat(F.col("turn").cast("string"), F.lit(".txt")).alias("internal"), F.lit(1).cast("long").alias("size"))
    found = layers.expand_archives(entries, archives=times)
    return found.select("archive_id", "path", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created", "modified")])


@query("association_totals", f"WITH {o.TREE}, {o.ASSOCIATED} SELECT count(DISTINCT item_id) AS items, count(*) FILTER (WHERE role = 'Sidecar') AS sidecars, count(*) FILTER (WHERE role = 'Companion') AS companions, (SELECT count(*) FROM (SELECT DISTINCT item_id, kind FROM associated WHERE role = 'Sidecar' AND item_id IS NOT NULL AND kind IN ('Lrc', 'Nfo'))) AS promotions FROM associated")
def association_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, sidecars, companions and what is promoted from texts alone."""
    own = _associated(spark, sf_dir)
    none = spark.createDataFrame([], "file_id long, definition int, value_text string, value_date timestamp")
    return assoc.counters(own, assoc.promotions(own, own.select("file_id", F.col("path").alias("content")), none))
