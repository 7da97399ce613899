"""Queries of the catalogue over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import classify, coerce, paths
from shelfmark.operators import associate as assoc
from shelfmark.operators import collections as coll
from shelfmark.operators import dedup, facets, layers, normalize, search
from shelfmark.operators.scratch import numbered, shared_dir
from shelfmark.plans import adapters as a
from shelfmark.plans import oracle as o
from shelfmark.plans import vocabulary
from shelfmark.sources import readers
from shelfmark.streaming import debounce as quiet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Definitions that a rule gives text values.
TEXT_DEFINITIONS = tuple(sorted({r.definition for r in vocabulary.rules() if r.coercer in coerce.TEXT_COERCERS}))


def _music(spark: SparkSession, sf_dir: str, definitions: tuple[int, ...] | None = None) -> DataFrame:
    return normalize.normalize(a.music_raw(spark, sf_dir), definitions)


# --- facets ---------------------------------------------------------------


def _folders(spark: SparkSession, sf_dir: str, definition: int, chosen: tuple[tuple[int, str], ...] = ()) -> DataFrame:
    attributes = _music(spark, sf_dir, (definition, *(d for d, _ in chosen)))
    ids = facets.with_mime(a.music_files(spark, sf_dir), ("audio/",))
    ids = facets.drill(ids, attributes, tuple(d for d, _ in chosen), tuple(v for _, v in chosen))
    return facets.folders(ids, attributes, definition).select("folder", "n_files", paths.natural_key(F.col("folder")).alias("natural"))


@query("facet_by_artist", f"SELECT p_brand AS folder, count(*) AS n_files, {o.natural('p_brand')} AS \"natural\" FROM part GROUP BY p_brand")
def facet_by_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part → raw rows → rules → album artists → folders with counts."""
    return _folders(spark, sf_dir, 3)


@query("facet_by_album", f"SELECT p_type AS folder, count(*) AS n_files, {o.natural('p_type')} AS \"natural\" FROM part GROUP BY p_type")
def facet_by_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir, 2)


@query("facet_by_genre", f"SELECT g AS folder, count(DISTINCT p_partkey) AS n_files, {o.natural('g')} AS \"natural\" FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS g FROM part) WHERE g <> '' GROUP BY g")
def facet_by_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir, 92)


@query("facet_by_year", f"SELECT (1950 + p_size)::VARCHAR AS folder, count(*) AS n_files, {o.natural('(1950 + p_size)::VARCHAR')} AS \"natural\" FROM part GROUP BY 1, 3")
def facet_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir, 77)


@query("facet_drill", f"SELECT p_type AS folder, count(*) AS n_files, {o.natural('p_type')} AS \"natural\" FROM part WHERE p_brand = 'Brand#11' AND list_contains(string_split(p_name, ' '), (SELECT min(split_part(p_name, ' ', 1)) FROM part)) GROUP BY p_type")
def facet_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chosen levels, the first from a table, then the albums below."""
    attributes = _music(spark, sf_dir, (2, 3, 92))
    ids = facets.with_mime(a.music_files(spark, sf_dir), ("audio/",))
    first = a.table(spark, sf_dir, "part").agg(F.min(F.element_at(F.split("p_name", " "), 1)).alias("genre"))
    genre = attributes.where("definition = 92").join(F.broadcast(first), F.col("value_text") == F.col("genre"), "left_semi").select("file_id")
    ids = facets.drill(ids.join(genre, "file_id", "left_semi"), attributes, (3,), ("Brand#11",))
    return facets.folders(ids, attributes, 2).select("folder", "n_files", paths.natural_key(F.col("folder")).alias("natural"))


@query("facet_by_type", f"WITH {o.FILES} SELECT CASE mime WHEN 'text/plain' THEN 'Text document' WHEN 'text/html' THEN 'HTML document' ELSE 'FLAC audio' END AS label, CASE WHEN mime = 'audio/flac' THEN 'Audio' ELSE 'Document' END AS class, count(*) AS n_files FROM files GROUP BY 1, 2")
def facet_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = classify.best_mime(F.col("mime"), F.lit(None).cast("string"))
    return a.files(spark, sf_dir).select(classify.media_label(best).alias("label"), classify.media_class(best).alias("class")).groupBy("label", "class").agg(F.count("*").alias("n_files"))


@query("facet_by_date", "SELECT year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, monthname(o_orderdate) AS month_name, count(*) AS n_files FROM orders GROUP BY ALL")
def facet_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = normalize.normalize(a.date_raw(spark, sf_dir), (44,))
    return facets.date_folders(dates, by_month=True)


_LEAF_NAME = o.natural("(p_name || ' ' || p_partkey || '.flac')")


@query("facet_leaf_sorted", f"SELECT p_partkey + 30000000 AS file_id, p_name || ' ' || p_partkey || '.flac' AS name, p_partkey AS sort_number, {_LEAF_NAME} AS \"natural\" FROM part WHERE p_brand = 'Brand#11'")
def facet_leaf_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = _music(spark, sf_dir)
    ids = facets.drill(facets.with_mime(a.music_files(spark, sf_dir), ("audio/",)), attributes, (3,), ("Brand#11",))
    return facets.leaves(a.music_files(spark, sf_dir), ids, attributes, 20).drop("sort_text")


@query("facet_view_counts", "SELECT 'music/by-artist' AS view, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'music/by-album', count(DISTINCT p_type) FROM part UNION ALL SELECT 'music/by-year', count(DISTINCT p_size) FROM part UNION ALL SELECT 'music/by-genre', count(DISTINCT g) FROM (SELECT unnest(string_split(p_name, ' ')) AS g FROM part) WHERE g <> ''")
def facet_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders at the top of each view of the music category, in one pass over its attributes."""
    music = facets.CATEGORIES[0]
    top = spark.createDataFrame([(f"{music.key}/{v.key}", int(v.path[0])) for v in music.view], "view string, definition int")
    values = _music(spark, sf_dir).select("definition", facets.level_value().alias("value"))
    return values.join(F.broadcast(top), "definition").groupBy("view").agg(F.count_distinct("value").alias("n"))


@query("filter_mime_prefix", f"WITH {o.FILES} SELECT mime, count(*) AS n FROM files WHERE mime LIKE 'text/%' GROUP BY mime")
def filter_mime_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.files(spark, sf_dir)
    documents = next(c for c in facets.CATEGORIES if c.key == "documents")
    return facets.of_mime(found, documents.mime).groupBy("mime").agg(F.count("*").alias("n"))


@query("filter_has_attribute", "SELECT page_id + 10000000 AS file_id FROM pages WHERE (page_id + 10000000) % 3 <> 0")
def filter_has_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = a.text_raw(spark, sf_dir).where("key <> 'title' or file_id % 3 <> 0")
    return facets.with_attribute(normalize.normalize(raw, (73,)), 73)


@query("filter_has_group", "SELECT p_partkey + 30000000 AS file_id FROM part WHERE p_partkey % 4 = 0")
def filter_has_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with attributes of the group: the others keep their genre only, which belongs to another."""
    raw = a.raw(spark, sf_dir).where(f"file_id < {a.MUSIC} or (file_id - {a.MUSIC}) % 4 = 0 or key = 'genre'")
    return facets.with_group(normalize.normalize(raw), normalize.definitions_table(spark), "Audio")


@query("filter_roles", "SELECT CASE WHEN toxic = 1 THEN 'Companion' WHEN quality = 0 THEN 'Sidecar' ELSE 'Primary' END AS role, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def filter_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang")
    return docs.join(a.roles(spark, sf_dir), "file_id").groupBy("role", "lang").agg(F.count("*").alias("n"))


# --- duplicates -------------------------------------------------------------


@query("dedup_size_collisions", "SELECT octet_length(encode(text))::BIGINT AS size, count(*) AS n FROM documents WHERE octet_length(encode(text)) >= 1000 GROUP BY 1 HAVING count(*) > 1")
def dedup_size_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.size_collisions(a.document_files(spark, sf_dir), min_size=1000)


_STAGED = "WITH d AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, text, sha256(encode(text)[1:512]) AS p FROM documents), k AS (SELECT size, p FROM d GROUP BY ALL HAVING count(*) > 1)"


@query("dedup_staged", _STAGED + " SELECT doc_id AS file_id, size, upper(sha256(text)) AS checksum FROM d JOIN k USING (size, p)")
def dedup_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.staged(a.document_files(spark, sf_dir), min_size=0, prefix=512).select("file_id", "size", "checksum")


@query("dedup_sets", "SELECT * FROM (SELECT upper(sha256(text)) AS checksum, octet_length(encode(text))::BIGINT AS size, count(*) OVER (PARTITION BY text) AS n, 'docs/' || lang || '/' || source || '/doc ' || doc_id || '.txt' AS path FROM documents) WHERE n > 1")
def dedup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_sets(dedup.staged(a.document_files(spark, sf_dir), min_size=0))


@query("duplicates_report", "SELECT upper(sha256(text)) AS checksum, octet_length(encode(text))::BIGINT AS size, count(*) AS n, arg_min(p, (lower(p), p)) AS first_path FROM (SELECT text, 'docs/' || lang || '/' || source || '/doc ' || doc_id || '.txt' AS p FROM documents) GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, size DESC, checksum LIMIT 15")
def duplicates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 sets of most files."""
    return dedup.largest_sets(dedup.staged(a.document_files(spark, sf_dir), min_size=0), 15)


@query("duplicates_of_file", "SELECT doc_id AS file_id, count(*) OVER (PARTITION BY text) - 1 AS others FROM documents")
def duplicates_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.others_with_hash(dedup.integrity(a.document_files(spark, sf_dir)))


# --- normalisation ----------------------------------------------------------


@query("normalize_text", f"WITH {o.RAW}, {o.TEXTS} SELECT file_id, definition, value AS value_text FROM text_attributes WHERE definition <> 92")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(a.raw(spark, sf_dir), TEXT_DEFINITIONS).where("value_text is not null and definition <> 92").select("file_id", F.col("definition"), "value_text")


@query("normalize_integer", "SELECT p_partkey + 30000000 AS file_id, d AS definition, v AS value_int FROM part, LATERAL (VALUES (20, p_partkey), (77, 1950 + p_size), (18, CASE WHEN p_size * 1000 + 500 BETWEEN 8000 AND 192000 THEN p_size * 1000 + 500 END), (84, (64 + p_partkey % 300) * 1000), (19, 1000 + p_partkey % 1000)) AS x(d, v) WHERE v IS NOT NULL")
def normalize_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _music(spark, sf_dir).where("value_int is not null").select("file_id", "definition", "value_int")


@query("normalize_float", "SELECT p_partkey + 30000000 AS file_id, 22 AS definition, (-(p_size + 0.25))::DOUBLE AS value_float FROM part")
def normalize_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _music(spark, sf_dir).where("definition = 22").select("file_id", "definition", "value_float")


@query("normalize_duration", "SELECT p_partkey + 30000000 AS file_id, 88 AS definition, (p_size * 60 + p_partkey % 60)::DOUBLE AS value_float FROM part")
def normalize_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _music(spark, sf_dir).where("definition = 88").select("file_id", "definition", "value_float")


@query("normalize_date", "SELECT o_orderkey AS file_id, 44 AS definition, date_trunc('day', o_orderdate)::TIMESTAMP AS value_date FROM orders UNION ALL SELECT o_orderkey, 86, date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 3723 SECOND FROM orders UNION ALL SELECT o_orderkey, 45, date_trunc('day', o_orderdate)::TIMESTAMP FROM orders WHERE o_orderkey % 5 <> 0")
def normalize_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(a.date_raw(spark, sf_dir)).select("file_id", "definition", F.col("value_date").cast("timestamp_ntz").alias("value_date"))


@query("normalize_multi", f"WITH {o.RAW}, {o.TEXTS} SELECT file_id, definition, value AS value_text FROM text_attributes WHERE definition = 92")
def normalize_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _music(spark, sf_dir).where("definition = 92").select("file_id", "definition", "value_text")


@query("normalize_dedupe_first_wins", f"WITH {o.RAW}, {o.TEXTS} SELECT file_id, definition, value AS value_text, namespace FROM text_attributes QUALIFY row_number() OVER (PARTITION BY file_id, definition, value ORDER BY seq, namespace, key) = 1")
def normalize_dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.first_wins(normalize.normalize(a.raw(spark, sf_dir), TEXT_DEFINITIONS))
    return found.where("value_text is not null").select("file_id", "definition", "value_text", "namespace")


@query("renormalize_idempotent", "SELECT p_partkey + 30000000 AS file_id, d AS definition, v AS value_key, w AS provider FROM part, LATERAL (VALUES (2, p_type, 'reader'), (3, p_brand, 'reader'), (7, p_brand, 'reader'), (38, 'kept', 'promotion'), (7, 'by hand', 'editor')) AS x(d, v, w)")
def renormalize_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale attributes of the reader are rebuilt from the raw layer, twice; those of others stay."""
    raw = a.music_raw(spark, sf_dir).withColumn("provider", F.lit("reader"))
    files = a.music_files(spark, sf_dir).select("file_id")
    one = lambda definition, value, provider: files.select("file_id", F.lit(definition).alias("definition"), F.lit(value).alias("value_key"), F.lit(provider).alias("provider"))
    old = one(7, "stale", "reader").unionByName(one(38, "kept", "promotion")).unionByName(one(7, "by hand", "editor"))
    return normalize.renormalize(normalize.renormalize(old, raw, (2, 3, 7)), raw, (2, 3, 7))


@query("unmapped_keys", f"WITH {o.RAW}, every AS (SELECT namespace, key, value FROM raw UNION ALL SELECT 'watch', event_type, json_extract_string(props, '$.k') FROM events) SELECT namespace, key, count(*) AS n, max(value) AS sample FROM every WHERE namespace = 'watch' OR key = 'comment-x' GROUP BY ALL")
def unmapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.unmapped(a.raw(spark, sf_dir).unionByName(a.event_raw(spark, sf_dir)))


@query("collector_report", f"WITH {o.RAW} SELECT namespace, key, count(DISTINCT file_id) AS n_files, count(*) AS n_values, CASE WHEN length(s) > 500 THEN s[1:500] || '…' ELSE s END AS sample FROM (SELECT *, trim(regexp_replace(first_value(value) OVER (PARTITION BY namespace, key ORDER BY file_id, seq), '[\\r\\n\\t]', ' ', 'g')) AS s FROM raw) GROUP BY namespace, key, s")
def collector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.key_statistics(a.raw(spark, sf_dir))


@query("collector_status", f"WITH {o.FILES}, {o.RAW} SELECT CASE WHEN file_id IN (SELECT file_id FROM raw) THEN 'OK' ELSE 'Empty' END AS status, count(*) AS n FROM files GROUP BY 1")
def collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.file_status(a.files(spark, sf_dir), a.raw(spark, sf_dir))


_PROBED = ["TITLE", " artist", "TLEN", "Tag", "x-unknown"]


@query("alias_resolution", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TITLE' WHEN 1 THEN ' artist' WHEN 3 THEN 'Tag' ELSE 'x-unknown' END AS name, CASE event_id % 5 WHEN 0 THEN 73 WHEN 1 THEN 7 WHEN 3 THEN 72 END AS definition FROM events WHERE event_id % 5 <> 2")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in _PROBED]), (F.col("event_id") % 5 + 1).cast("int"))
    return normalize.resolve_aliases(a.table(spark, sf_dir, "events").select("event_id", name.alias("name")))


@query("alias_minting", "SELECT 'x-' || event_type AS name, 1000000 + row_number() OVER (ORDER BY 'x-' || event_type) - 1 AS definition FROM events GROUP BY event_type")
def alias_minting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.mint_definitions(normalize.resolve_aliases(a.table(spark, sf_dir, "events").select(F.concat(F.lit("x-"), "event_type").alias("name"))))


@query("coerce_quantities", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT || CASE l_linenumber % 4 WHEN 0 THEN ' KiB' WHEN 1 THEN 'MB' WHEN 2 THEN '' ELSE ' furlongs' END AS raw, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::BIGINT * 1024.0 WHEN 1 THEN l_quantity::BIGINT * 1e6 WHEN 2 THEN l_quantity::BIGINT END::DOUBLE AS bytes FROM lineitem")
def coerce_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(F.lit(" KiB"), F.lit("MB"), F.lit(""), F.lit(" furlongs")), F.col("l_linenumber") % 4 + 1)
    rows = a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("long").cast("string"), unit).alias("raw"))
    return rows.withColumn("bytes", coerce.in_unit(F.col("raw"), "DataSize"))


# --- media, names and classes -------------------------------------------------


@query("media_rollup", """WITH s AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS stream,
  ['video', 'audio', 'subtitle', 'data'][(l_partkey % 4 + 1)::INT] AS kind, CASE WHEN l_linenumber % 5 > 0 THEN (l_quantity * 1000)::BIGINT END AS bit_rate, l_extendedprice AS duration, l_partkey % 1920 + 1 AS width,
  CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 1080 + 1 END AS height, CASE WHEN l_partkey % 7 = 0 THEN 1.5::DOUBLE END AS aspect, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 0.0 END AS real_rate, l_tax * 100 AS average, l_orderkey % 9000 AS frames,
  8 * (l_partkey % 3 + 1) AS bits, l_linenumber::BIGINT AS channels, 8000 * (l_suppkey % 6 + 1) AS sample_rate FROM lineitem),
b AS (SELECT file_id, width, height, aspect FROM s WHERE kind = 'video' AND height IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY width * height DESC, stream) = 1),
c AS (SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey * 7 WHEN 1 THEN 0 END AS given FROM orders)
SELECT s.file_id, count(*) AS n_streams, coalesce(nullif(any_value(given), 0), nullif(sum(bit_rate) FILTER (WHERE kind IN ('audio', 'video')), 0))::BIGINT AS bit_rate, max(duration) FILTER (WHERE kind IN ('audio', 'video')) AS duration,
  any_value(b.width) AS width, any_value(b.height) AS height, any_value(b.width * b.height) AS pixels, any_value(coalesce(b.aspect, b.width::DOUBLE / b.height)) AS aspect_ratio, max(coalesce(nullif(real_rate, 0), average)) FILTER (WHERE kind = 'video') AS frame_rate,
  max(frames) FILTER (WHERE kind = 'video') AS frames, max(bits) FILTER (WHERE kind = 'audio') AS bits, max(channels) FILTER (WHERE kind = 'audio') AS channels, max(sample_rate) FILTER (WHERE kind = 'audio') AS sample_rate
FROM s LEFT JOIN b USING (file_id) LEFT JOIN c USING (file_id) GROUP BY s.file_id""")
def media_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as streams of four kinds, all with pictures, rates and channels: only those of the right kind count."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    line, part, supplier, order = (F.col(f"l_{c}") for c in ("linenumber", "partkey", "suppkey", "orderkey"))
    streams = a.table(spark, sf_dir, "lineitem").withColumn("stream", F.row_number().over(w)).select(
        order.alias("file_id"), "stream", F.element_at(F.array(*map(F.lit, ("video", "audio", "subtitle", "data"))), (part % 4 + 1).cast("int")).alias("kind"), F.when(line % 5 > 0, (F.col("l_quantity") * 1000).cast("long")).alias("bit_rate"),
        F.col("l_extendedprice").alias("duration"), (part % 1920 + 1).alias("width"), F.when(supplier % 3 > 0, supplier % 1080 + 1).alias("height"), F.when(part % 7 == 0, 1.5).alias("aspect_ratio"),
        F.when(line % 3 == 0, F.col("l_quantity")).when(line % 3 == 1, 0.0).alias("frame_rate"), (F.col("l_tax") * 100).alias("average_rate"), (order % 9000).alias("frames"), (8 * (part % 3 + 1)).alias("bits"),
        line.alias("channels"), (8000 * (supplier % 6 + 1)).alias("sample_rate"),
    )
    rate = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 7).when(F.col("o_orderkey") % 3 == 1, 0)
    return layers.media_rollup(streams, a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), rate.alias("bit_rate")))


@query("filename_tv_parse", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Star Show' ELSE 'Show ' || (o_custkey % 10) END AS series, CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 20 + 1)::INT END AS season, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 90 + 1)::INT END AS episode, CASE o_orderkey % 3 WHEN 1 THEN 'Part ' || o_orderstatus END AS title FROM orders WHERE o_orderkey % 3 < 2")
def filename_tv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    season, episode = F.col("o_custkey") % 20 + 1, F.col("o_orderkey") % 90 + 1
    name = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Star.Show.S"), two(season), F.lit("E"), two(episode), F.lit(" [1080p]")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(two(season), F.lit("x"), two(episode), F.lit(" - Part "), "o_orderstatus"))
        .otherwise(F.concat(F.lit("Holiday "), F.col("o_orderkey").cast("string")))
    )
    show = F.concat(F.lit("Show "), (F.col("o_custkey") % 10).cast("string"), F.lit(" (1999)"))
    parsed = a.table(spark, sf_dir, "orders").select("o_orderkey", classify.tv_episode(name, F.lit("Season 1"), show).alias("e"))
    # As a row of its own the struct is told once for all its fields.
    return parsed.select("o_orderkey", F.inline(F.array_compact(F.array("e"))))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder tree made of the orders: shows with seasons, extras, movies and applications."""
    k = F.col("o_orderkey")
    number = lambda text, m, end="": F.concat(F.lit(text), (k % m).cast("string"), F.lit(end))
    folder, name = k % 7, k % 11
    sub = F.when(folder == 0, "/Season 1").when(folder == 1, "/Season 2").when(folder == 2, "/extras").when(folder == 3, number("/Movie ", 100)).when(folder == 4, number("/App ", 60)).otherwise("")
    app = F.when(name < 4, number("app", 60, ".exe")).when(name < 6, "setup.exe").when(name < 9, "engine.dll").otherwise("readme.txt")
    other = (
        F.when(name == 2, number("track ", 500, ".lrc")).when(name == 3, "cover.jpg").when(name == 4, number("Movie ", 100, ".mkv")).when(name == 5, "show.nfo")
        .when(name.isin(7, 8), number("notes ", 50, ".txt")).when(name == 9, "book.opf").when(name == 10, number("Movie ", 100, ".srt")).otherwise(number("track ", 500, ".flac"))
    )
    path = F.concat(F.lit("tree/Show "), (k % 40).cast("string"), sub, F.lit("/"), F.when(folder == 4, app).otherwise(other))
    return a.table(spark, sf_dir, "orders").groupBy(path.alias("path")).agg(F.min(k).alias("file_id"), F.max(F.floor("o_totalprice")).alias("size")).withColumn("mime", F.lit(None).cast("string"))


def _associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tree with their items, stored once."""
    return a.kept(spark, sf_dir, "orders", "associated", lambda: assoc.associate(_tree(spark, sf_dir)))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of the tree as collections, stored once."""
    return a.kept(spark, sf_dir, "orders", "folded", lambda: coll.fold(_associated(spark, sf_dir)))


@query("classify_sidecars", f"WITH {o.TREE}, t AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name FROM tree) SELECT path, {o.KIND} AS kind, {o.PRIMARY} AS primary_media, {o.AUX} AS helper FROM t")
def classify_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.classified(_tree(spark, sf_dir)).select("path", "kind", "primary_media", F.col("aux").alias("helper"))


_MIMES = ["application/octet-stream", "application/x-msdownload", "text/plain; charset=utf-8", "application/vnd.oasis.opendocument.text", "video/x-matroska", "application/x-doom-wad", "application/zip", "inode/directory", "image/svg+xml", "model/vrml", "application/vnd.foo.bar"]


@query("classify_media_type", "WITH m AS (SELECT o_orderkey, (o_orderkey % 11)::INT AS i FROM orders) SELECT o_orderkey, ['Other','Software','Document','Document','Video','Other','Archive','Folder','Image','Other','Other'][i + 1] AS class, ['Unknown','Windows executable','Text document','Word document','Matroska video','Doom wad','Archive','Folder','SVG image','Vrml','Vnd foo bar'][i + 1] AS label FROM m")
def classify_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(*[F.lit(x) for x in _MIMES]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    best = classify.best_mime(F.lit("application/octet-stream"), mime)
    return a.table(spark, sf_dir, "orders").select("o_orderkey", classify.media_class(best).alias("class"), classify.media_label(best).alias("label"))


@query("classify_archive", "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2) AS archive FROM orders")
def classify_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".zip", ".tar.gz", ".CBR", ".jar", ".gz", ".pdf")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", classify.is_archive(F.concat(F.lit("a"), end)).alias("archive"))


@query("classify_structural", f"WITH {o.TREE}, t AS (SELECT DISTINCT regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS name FROM tree) SELECT name, regexp_matches(name, '{classify.STRUCTURAL_NAME}') AS structural, regexp_matches(name, '{classify.SEASON_NAME}') AS season FROM t")
def classify_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = paths.name_of(paths.parent_dir(F.col("path")))
    return _tree(spark, sf_dir).select(name.alias("name")).distinct().select("name", classify.is_structural_name(F.col("name")).alias("structural"), classify.is_season_name(F.col("name")).alias("season"))


@query("title_tokens", f"SELECT page_id, array_to_string(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND NOT list_contains({str(classify.NOISE_TOKENS)}, t) AND NOT regexp_matches(t, '^[0-9]{{4}}$')), ' ') AS tokens FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || ' (2009) 1080p' AS title FROM pages)")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(" (2009) 1080p"))
    return a.table(spark, sf_dir, "pages").select("page_id", F.array_join(classify.title_tokens(title), " ").alias("tokens"))


@query("humanize_size", "SELECT o_orderkey, CASE WHEN n <= 0 OR f = 0 THEN n::VARCHAR ELSE printf('%.2f', round(n / power(1024.0, f), 2)) || ' KMGTP'[f + 1] END AS size FROM (SELECT o_orderkey, n, ((length(n::VARCHAR) - 1) // 3)::INT AS f FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1000 END) AS n FROM orders))")
def humanize_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 0).when(F.col("o_orderkey") % 3 == 1, 1).otherwise(1000)
    return a.table(spark, sf_dir, "orders").select("o_orderkey", paths.humanize_size(n).alias("size"))


@query("natural_sort", f"SELECT c_custkey, c_name, {o.natural('c_name')} AS \"natural\" FROM customer")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "customer").select("c_custkey", "c_name", paths.natural_key(F.col("c_name")).alias("natural"))


@query("natural_long_numbers", "WITH n AS (SELECT s_suppkey, repeat(lpad((s_suppkey * 7919)::VARCHAR, 15, '0'), (1 + s_suppkey % 4)::INT) AS digits FROM supplier) SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 2, length(ltrim(digits, '0')), ltrim(digits, '0'), length(digits) DESC, s_suppkey)::INT AS place FROM n")
def natural_long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names around numbers of up to 60 digits, in order, with capitals that do not count."""
    k = F.col("s_suppkey")
    digits = F.expr("repeat(lpad(cast(s_suppkey * 7919 as string), 15, '0'), cast(1 + s_suppkey % 4 as int))")
    name = F.concat(F.when(k % 2 == 0, F.when(k % 3 == 0, "a ").otherwise("A ")).otherwise("b "), digits, F.lit(" end"))
    named = numbered(a.table(spark, sf_dir, "supplier").select("s_suppkey", paths.natural_key(name).alias("natural")), ["natural", "s_suppkey"], "place", 1)
    return named.select("s_suppkey", F.col("place").cast("int").alias("place"))


@query("value_keys", "WITH v AS (SELECT o_custkey AS file_id, o_orderdate::TIMESTAMP + to_microseconds((o_orderkey % 3 * 100001)::BIGINT) AS d, o_orderkey AS seq FROM orders), f AS (SELECT file_id, strftime(d, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS value_key, min(seq) AS seq FROM v GROUP BY ALL) SELECT * FROM f UNION ALL SELECT o_orderkey, base64(encode(o_orderstatus)), o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def value_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that differ below a second and bytes, each kept once."""
    t = a.table(spark, sf_dir, "orders")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("value_text", "string"), ("value_int", "long"), ("value_float", "double"))]
    late = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 3 * 100001)
    row = lambda df, id_, definition, date, blob: df.select(F.col(id_).alias("file_id"), F.lit(definition).alias("definition"), F.col("o_orderkey").alias("seq"), F.lit("n").alias("namespace"), F.lit("k").alias("key"), *none, date.cast("timestamp").alias("value_date"), blob.cast("binary").alias("value_blob"))
    both = row(t, "o_custkey", 45, late, F.lit(None)).unionByName(row(t.where("o_orderkey % 10 = 0"), "o_orderkey", 99, F.lit(None), F.col("o_orderstatus")))
    return normalize.first_wins(both).select("file_id", "value_key", "seq")


@query("folder_tree", f"WITH {o.FILES}, p AS (SELECT file_id, string_split(path, '/') AS s FROM files WHERE mime = 'text/html') SELECT array_to_string(s[1:i], '/') AS folder, count(*) AS n_below FROM p, unnest(range(1, len(s))) AS u(i) GROUP BY 1")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder above a page, and how many pages lie below."""
    up = a.page_files(spark, sf_dir).select(F.explode(paths.ancestor_dirs(F.col("path"))).alias("folder"))
    return up.groupBy("folder").agg(F.count("*").alias("n_below"))


# --- items and collections ------------------------------------------------------


@query("associate_items", f"WITH {o.TREE}, {o.ASSOCIATED} SELECT file_id, path, kind, role, item_id FROM associated")
def associate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _associated(spark, sf_dir).select("file_id", "path", "kind", "role", "item_id")


@query("association_counters", f"WITH {o.TREE}, {o.ASSOCIATED} SELECT count(DISTINCT item_id) AS items, count(*) FILTER (WHERE role = 'Sidecar') AS sidecars, count(*) FILTER (WHERE role = 'Companion') AS companions FROM associated")
def association_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assoc.counters(_associated(spark, sf_dir))


@query("promote_sidecars", f"""WITH {o.TREE}, {o.ASSOCIATED}, side AS (SELECT * FROM associated WHERE role = 'Sidecar' AND item_id IS NOT NULL),
g AS (SELECT item_id AS file_id, CASE kind WHEN 'Lrc' THEN 15 WHEN 'Nfo' THEN 38 END AS definition, arg_min('text of ' || path, path) AS value_text FROM side WHERE kind <> 'Opf' GROUP BY ALL),
x AS (SELECT file_id, d AS definition, v AS value_text FROM tree, LATERAL (VALUES (76, 'writer ' || file_id % 5), (59, CASE WHEN file_id % 2 = 0 THEN 'press' END), (41, 'not given')) AS y(d, v) WHERE path LIKE '%.opf'),
known AS (SELECT file_id, 76 AS definition, 'writer 1' AS value_text FROM tree WHERE file_id % 3 = 0 AND path NOT LIKE '%.opf'),
dates AS (SELECT item_id AS file_id, 45 AS definition, arg_min(TIMESTAMP '2001-01-01' + to_seconds(file_id), path) AS value_date FROM side WHERE kind = 'Opf' GROUP BY item_id)
SELECT *, NULL::TIMESTAMP AS value_date FROM g WHERE NOT (definition = 38 AND file_id % 2 = 0)
UNION ALL SELECT DISTINCT s.item_id, x.definition, x.value_text, NULL::TIMESTAMP FROM side s JOIN x USING (file_id) WHERE s.kind = 'Opf' AND x.value_text IS NOT NULL AND x.definition <> 41 AND (s.item_id, x.definition, x.value_text) NOT IN (SELECT (file_id, definition, value_text) FROM known)
UNION ALL SELECT file_id, definition, NULL, value_date FROM dates""")
def promote_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with blanks around them, and writers, publishers and dates of .opf files; some files have a comment or that writer already."""
    files = _tree(spark, sf_dir)
    contents = files.select("file_id", F.concat(F.lit(" \t\u2003text of "), "path", F.lit(" \r\n")).alias("content"))
    row = lambda df, definition, text=None, date=None: df.select("file_id", F.lit(definition).alias("definition"), F.lit(text).cast("string").alias("value_text"), F.lit(date).cast("timestamp").alias("value_date"))
    opf = files.where(F.col("path").endswith(".opf"))
    released = F.timestamp_seconds(F.lit(978307200) + F.col("file_id"))
    given = [(76, F.concat(F.lit("writer "), (F.col("file_id") % 5).cast("string")), None), (59, F.when(F.col("file_id") % 2 == 0, "press"), None), (41, "not given", None), (45, None, released)]
    known = row(files.where("file_id % 2 = 0"), 38).unionByName(row(files.where("file_id % 3 = 0 and path not like '%.opf'"), 76, "writer 1"))
    for definition, text, date in given:
        known = known.unionByName(row(opf, definition, text, date))
    return assoc.promotions(_associated(spark, sf_dir), contents, known).withColumn("value_date", F.col("value_date").cast("timestamp_ntz"))


def _region_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = a.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    nations = a.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    suppliers = a.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"), F.col("s_name").alias("name"))
    return regions.unionByName(nations).unionByName(suppliers)


_NODES = "nodes AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, s_name FROM supplier)"


@query("collection_tree", f"WITH RECURSIVE {_NODES}, w AS (SELECT id, id AS root, 0 AS depth, name AS trail FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, w.root, w.depth + 1, w.trail || ' / ' || n.name FROM w JOIN nodes n ON n.parent_id = w.id) SELECT * FROM w")
def collection_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coll.tree(_region_nodes(spark, sf_dir))


@query("collection_ancestors", f"WITH RECURSIVE {_NODES}, u AS (SELECT id, parent_id AS ancestor, 1 AS hops FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, n.parent_id, u.hops + 1 FROM u JOIN nodes n ON n.id = u.ancestor WHERE n.parent_id IS NOT NULL) SELECT * FROM u")
def collection_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coll.ancestors(_region_nodes(spark, sf_dir))


@query("collection_children", f"WITH {_NODES} SELECT id, name, (SELECT count(*) FROM nodes k WHERE k.parent_id = n.id) AS n_children, (SELECT count(*) FROM customer WHERE c_nationkey + 100 = n.id) AS n_items FROM nodes n")
def collection_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = a.table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("collection_id"))
    return coll.child_counts(_region_nodes(spark, sf_dir), items)


def _fold_level(depth: int, below: str | None) -> str:
    kids = f"(SELECT parent, count(*) FILTER (WHERE is_c OR n_b > 0) AS full_kids, bool_or(regexp_matches(name, '{classify.STRUCTURAL_NAME}')) AS sk, bool_or(regexp_matches(name, '{classify.SEASON_NAME}')) AS zk FROM {below} GROUP BY parent)" if below else "(SELECT NULL AS parent, 0 AS full_kids, false AS sk, false AS zk WHERE false)"
    tokens = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' AND NOT list_contains({str(classify.NOISE_TOKENS)}, t) AND NOT regexp_matches(t, '^[0-9]{{4}}$'))"
    base = "regexp_replace(pname, '\\.[^./]*$', '')"
    dedicated = f"(pname IS NULL OR regexp_matches(trim({base}), '{classify.GENERIC_NAME}') OR len({tokens(base)}) = 0 OR (len({tokens('f.name')}) > 0 AND len(list_filter({tokens('f.name')}, lambda t: list_contains({tokens(base)}, t))) >= ceil(0.6 * len({tokens(base)}))))"
    return f"""v{depth} AS (SELECT folder, f.parent, f.name, depth, coalesce(zk, false) AS zk, CASE WHEN coalesce(sk, false) THEN true WHEN coalesce(full_kids, 0) = 0 AND n_items = 1 THEN NOT {dedicated} ELSE coalesce(full_kids, 0) + n_items >= 1 END AS is_c, n_items FROM folders f LEFT JOIN {kids} k ON k.parent = f.folder WHERE depth = {depth}),
lev{depth} AS (SELECT *, CASE WHEN is_c THEN 0 ELSE n_items END AS n_b FROM v{depth})"""


_FOLD = f"""WITH {o.TREE}, {o.ASSOCIATED},
held AS (SELECT folder, count(*) FILTER (WHERE role = 'Primary' AND item_id IS NOT NULL) AS n_items, regexp_extract(min(path) FILTER (WHERE role = 'Primary' AND item_id IS NOT NULL), '([^/]*)$', 1) AS pname FROM associated GROUP BY folder),
paths AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:i], '/') AS folder FROM held, unnest(range(1, len(string_split(folder, '/')) + 1)) AS u(i)),
folders AS (SELECT p.folder, regexp_extract(p.folder, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(p.folder, '([^/]*)$', 1) AS name, len(string_split(p.folder, '/'))::INT AS depth, coalesce(n_items, 0) AS n_items, pname FROM paths p LEFT JOIN held USING (folder)),
{_fold_level(3, None)}, {_fold_level(2, 'lev3')}, {_fold_level(1, 'lev2')},
every AS (SELECT * FROM lev1 UNION ALL SELECT * FROM lev2 UNION ALL SELECT * FROM lev3),
done AS (SELECT e.*, e.n_b > 0 AND regexp_matches(e.name, '{classify.STRUCTURAL_NAME}') AND coalesce(p.is_c, false) AS st FROM every e LEFT JOIN every p ON p.folder = e.parent)
SELECT folder, depth, is_c OR st AS is_collection, CASE WHEN is_c THEN CASE WHEN zk THEN 'Show' ELSE 'Generic' END WHEN st THEN CASE WHEN regexp_matches(name, '{classify.SEASON_NAME}') THEN 'Season' ELSE 'Generic' END END AS kind, n_b::BIGINT AS n_bubbled FROM done"""


@query("collection_fold", _FOLD)
def collection_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).drop("parent")


@query("best_cover", "SELECT o_custkey, arg_min(path, (pr, lower(path), path)) AS cover FROM (SELECT o_custkey, 'a/' || o_custkey || '/' || n || '.jpg' AS path, CASE WHEN i < 3 THEN i + 1 ELSE 10 END AS pr FROM (SELECT o_custkey, o_orderkey % 4 AS i, ['cover', 'folder', 'poster', 'img' || (o_orderkey % 50)][(o_orderkey % 4 + 1)::INT] AS n FROM orders)) GROUP BY o_custkey")
def best_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "cover").when(k % 4 == 1, "folder").when(k % 4 == 2, "poster").otherwise(F.concat(F.lit("img"), (k % 50).cast("string")))
    images = a.table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("a/"), F.col("o_custkey").cast("string"), F.lit("/"), name, F.lit(".jpg")).alias("path"))
    return coll.best_cover(images, "o_custkey")


# --- layers ------------------------------------------------------------------------


@query("override_layer", f"WITH {o.MUSIC_RAW}, b AS (SELECT file_id, CASE trim(key) WHEN 'artist' THEN 7 WHEN 'album' THEN 2 END AS definition, value FROM music WHERE namespace = 'vorbis' AND trim(key) IN ('artist', 'album')), ov AS (SELECT p_partkey + 30000000 AS file_id, 7 AS definition, CASE WHEN p_partkey % 20 = 0 THEN 'Various' ELSE p_brand END AS value FROM part WHERE p_partkey % 10 = 0 AND p_partkey % 20 = 0) SELECT file_id, definition, value, 'extracted' AS source FROM b WHERE (file_id, definition) NOT IN (SELECT (file_id, definition) FROM ov) UNION ALL SELECT file_id, definition, value, 'override' FROM ov")
def override_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every tenth part's artist; those that say what was extracted are not kept."""
    base = _music(spark, sf_dir).where("namespace = 'vorbis' and definition in (2, 7)").select("file_id", "definition", F.col("value_text").alias("value"))
    part = a.table(spark, sf_dir, "part").where("p_partkey % 10 = 0")
    edits = part.select((F.col("p_partkey") + a.MUSIC).alias("file_id"), F.lit(7).alias("definition"), F.when(F.col("p_partkey") % 20 == 0, "Various").otherwise(F.col("p_brand")).alias("value"))
    return layers.apply_overrides(base, layers.changed_overrides(edits, base))


@query("archive_expand", "SELECT conv_id AS archive_id, 'chat/' || conv_id || '.zip!/' || role || '/' || turn // 2 || '.txt' AS path, role || '/' || turn // 2 || '.txt' AS internal, max(octet_length(encode(text)))::BIGINT AS size FROM conversations GROUP BY ALL")
def archive_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.table(spark, sf_dir, "conversations")
    internal = F.concat(F.lit("/"), "role", F.lit("\\"), F.floor(F.col("turn") / 2).cast("string"), F.lit(".txt"))
    archive = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".zip"))
    return layers.expand_archives(t.select(F.col("conv_id").alias("archive_id"), archive.alias("archive_path"), internal.alias("internal"), F.octet_length("text").cast("long").alias("size")))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t, k = a.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("orders/"), k.cast("string"))
    old = t.where(k % 7 != 0).select(path.alias("path"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    later = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.when(k % 3 == 0, 5).otherwise(0))
    new = t.where(k % 11 != 0).select(path.alias("path"), (F.floor("o_totalprice") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"), later.alias("modified"))
    return old, new


@query("incremental_diff", "SELECT 'orders/' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'created' WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.snapshot_diff(*_snapshots(spark, sf_dir))


@query("prune_missing", "SELECT 'orders/' || o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0")
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return old.select("path").join(new.select("path"), "path", "left_anti")


@query("incremental_upsert", "SELECT 'orders/' || o_orderkey AS path, (floor(o_totalprice) + CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS size FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0)")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return layers.upsert(old, new).select("path", "size")


@query("soft_delete_prefix", f"WITH {o.TREE} SELECT path, NOT (path = 'tree/Show 1' OR starts_with(path, 'tree/Show 1/')) AS \"exists\" FROM tree")
def soft_delete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.soft_delete(_tree(spark, sf_dir).select("path").withColumn("exists", F.lit(True)), "tree/Show 1")


@query("rename_prefix", f"WITH {o.TREE} SELECT file_id, CASE WHEN starts_with(path, 'tree/Show 1/') THEN 'tree/Renamed' || path[12:] ELSE path END AS path FROM tree")
def rename_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.rename(_tree(spark, sf_dir).select("file_id", "path"), "tree/Show 1", "tree/Renamed")


@query("dashboard_counts", f"WITH {o.FILES}, {o.RAW} SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(DISTINCT mime) FROM files) AS n_types, (SELECT sum(size)::BIGINT FROM files) AS bytes, (SELECT max(size) FROM files) AS largest, (SELECT count(*) FROM raw) AS n_raw")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = a.files(spark, sf_dir).agg(F.count("*").alias("n_files"), F.count_distinct("mime").alias("n_types"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return found.crossJoin(a.raw(spark, sf_dir).agg(F.count("*").alias("n_raw")))


# --- search --------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(strip_accents(replace(replace(replace(translate(lower({0}), 'øđłħŧıς', 'odlhtiσ'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda t: t <> '')"
_TF = "len(list_filter(toks, lambda t: starts_with(t, '{0}')))::DOUBLE"


def _rank(terms: list[str]) -> str:
    return " + ".join(f"{_TF.format(t)} / ({_TF.format(t)} + 1)" for t in terms)


def _all(terms: list[str]) -> str:
    return " AND ".join(f"{_TF.format(t)} > 0" for t in terms)


@query("search_simple_prefix", f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents) SELECT doc_id AS file_id, {_rank(['thesing', 'eron'])} AS rank FROM d WHERE {_all(['thesing', 'eron'])}")
def search_simple_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored index, as the following three; no text is read."""
    return a.document_index(spark, sf_dir).find("Thesing eron")


@query("search_negated", f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents) SELECT doc_id AS file_id FROM d WHERE ({_all(['thesing', 'thon'])}) OR (list_contains(toks, 'thesing') AND NOT list_contains(toks, 'thon'))")
def search_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negated word still matches through the prefix branch."""
    return a.document_index(spark, sf_dir).find("thesing -thon").select("file_id")


@query("search_phrase", f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents) SELECT doc_id AS file_id, contains(' ' || array_to_string(toks, ' ') || ' ', ' of the ') AS exact FROM d WHERE {_all(['of', 'the'])}")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold both words as prefixes, and whether the phrase is among the words as typed."""
    index = a.document_index(spark, sf_dir)
    # The last alternative can match by its phrase only: no word begins like its other term.
    exact = index.find('zzzzzz or "of the"').select("file_id", F.lit(True).alias("found"))
    return index.find("of the").select("file_id").join(exact, "file_id", "left").select("file_id", F.coalesce("found", F.lit(False)).alias("exact"))


@query("search_scan", f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents) SELECT doc_id AS file_id, {_rank(['thesing', 'thon'])} AS rank FROM d WHERE ({_all(['thesing', 'thon'])}) OR list_contains(toks, 'thesing') AND NOT list_contains(toks, 'thon') OR contains(' ' || array_to_string(toks, ' ') || ' ', ' of the ')".replace(_rank(["thesing", "thon"]), _rank(["thesing", "thon", "or", "of", "the"])).replace(_all(["thesing", "thon"]), _all(["thesing", "thon", "or", "of", "the"])))
def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kinds of terms over texts that have no index."""
    return search.hits(a.document_files(spark, sf_dir), 'thesing -thon or "of the"', "content").select("file_id", "rank")


#: Each letter as one of another script, with marks of its own: Cyrillic, Greek and Vietnamese.
_SCRIPTS = {"ru": "абвгдеёжзийклмнопрстуфхцчш", "el": "άβγδέζήθίκλμνξόπρσύτύφχψώάε", "vi": "ảbcđẽfghịjklmnờpqrstủvwxỹz"}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_IN_SCRIPTS = " UNION ALL ".join(f"SELECT doc_id * 3 + {i} AS file_id, translate(lower(text), '{_LATIN}', '{letters}') AS content FROM documents WHERE lang = 'en'" for i, letters in enumerate(_SCRIPTS.values()))


@query("search_scripts", f"WITH t AS ({_IN_SCRIPTS}), d AS (SELECT file_id, {_WORDS.format('content')} AS toks FROM t) SELECT file_id, {' + '.join(f'({_TF.format(w)} / ({_TF.format(w)} + 1)) * CAST({_TF.format(w)} > 0 AS INT)' for w in ('тхе', 'θηε', 'the'))} AS rank FROM d WHERE {' OR '.join(f'{_TF.format(w)} > 0' for w in ('тхе', 'θηε', 'the'))}")
def search_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents in the letters of three scripts with accents, searched with and without them."""
    docs = a.table(spark, sf_dir, "documents").where("lang = 'en'")
    parts = [docs.select((F.col("doc_id") * 3 + i).alias("file_id"), F.translate(F.lower("text"), _LATIN, letters).alias("content")) for i, letters in enumerate(_SCRIPTS.values())]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = search.merge_hits(*[search.hits(texts, word, "content") for word in ("ТХЕ", "θηε", "thẽ")])
    return found.select("file_id", "rank")


_BM25_TERMS = ["the", "thesing", "eron"]
_BM25 = f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
c AS (SELECT doc_id, len(toks) AS size, t, len(list_filter(toks, lambda x: x = t)) AS tf FROM d, (SELECT unnest({_BM25_TERMS}) AS t)), f AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM c GROUP BY t),
r AS (SELECT doc_id AS file_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / avg_len))) AS rank FROM c JOIN f USING (t), n WHERE tf > 0 GROUP BY doc_id)
SELECT file_id, rank FROM r ORDER BY round(rank, 9) DESC, file_id LIMIT 50"""


@query("search_bm25", _BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents by BM25, from stored frequencies, lengths and bounds of blocks."""
    return a.document_index(spark, sf_dir).top(" ".join(_BM25_TERMS), 50)


@query("index_postings", f"SELECT tok AS token, count(DISTINCT doc_id) AS n_files, count(*) AS n, min(pos - 1)::INT AS earliest FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents)) GROUP BY tok")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each token of the stored index its files, places and earliest place."""
    by_file = a.document_index(spark, sf_dir).postings()
    return by_file.groupBy("token").agg(F.count_distinct("file_id").alias("n_files"), F.sum("n").alias("n"), F.min(F.col("positions")[0]).alias("earliest"))


_UNION = f"""WITH {o.FILES}, d AS (SELECT file_id, 'content' AS source, {_WORDS.format('content')} AS toks FROM files WHERE mime LIKE 'text/%'
UNION ALL SELECT page_id + 10000000, 'metadata', {_WORDS.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} FROM pages),
h AS (SELECT file_id, source, {_rank(['thon'])} AS rank FROM d WHERE {_all(['thon'])}),
g AS (SELECT file_id, max(rank) AS rank, bool_or(source = 'content') AS in_content, bool_or(source = 'metadata') AS in_metadata FROM h GROUP BY file_id)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = a.files(spark, sf_dir).where(F.col("mime").startswith("text/"))
    titles = normalize.normalize(a.text_raw(spark, sf_dir)).where("definition = 73").select("file_id", F.col("value_text").alias("content"))
    return search.merge_hits(search.hits(contents, "thon", "content"), search.hits(titles, "thon", "metadata"))


@query("search_union_rank_page", _UNION + " SELECT file_id, path, rank, in_content, in_metadata FROM g JOIN files USING (file_id) ORDER BY rank DESC, path LIMIT 25 OFFSET 25")
def search_union_rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of hits in content and titles: by rank, then path."""
    return search.page(_merged(spark, sf_dir), a.files(spark, sf_dir), page_number=2).select("file_id", "path", "rank", "in_content", "in_metadata")


@query("search_total_count", _UNION + " SELECT count(*) AS total, count(*) FILTER (WHERE in_metadata) AS by_metadata FROM g")
def search_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("in_metadata").alias("by_metadata"))


@query("search_path_scope", f"WITH {o.FILES}, d AS (SELECT file_id, path, {_WORDS.format('content')} AS toks FROM files WHERE starts_with(path, 'docs/en/src1/')) SELECT file_id, path, {_rank(['the'])} AS rank FROM d WHERE {_all(['the'])}")
def search_path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = search.in_folder(a.document_files(spark, sf_dir), "docs/en/src1/")
    return search.hits(scoped, "the", "content").join(scoped.select("file_id", "path"), "file_id").select("file_id", "path", "rank")


_CLEAN = "strip_accents(replace(lower(regexp_replace(w, '[^\\p{L}\\p{N}\\p{M}]', '', 'g')), 'ß', 'ss'))"


@query("search_snippet", f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS toks, string_split_regex(text, '\\s+') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_position(list_transform(ws, lambda w: starts_with({_CLEAN}, 'thesing')), true) AS pos FROM d WHERE {_all(['thesing'])}),
s AS (SELECT doc_id, list_slice(ws, greatest(1, pos - 4), greatest(1, pos - 4) + 15) AS part FROM p)
SELECT doc_id AS file_id, replace(replace(replace(replace(replace(replace(replace(array_to_string(list_transform(part, lambda w: CASE WHEN starts_with({_CLEAN}, 'thesing') THEN chr(1) || w || chr(2) ELSE w END), ' '),
 '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(1), '<mark>'), chr(2), '</mark>') AS snippet FROM s""")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hits(a.document_files(spark, sf_dir), "thesing", "content", with_snippet=True)
    return found.select("file_id", paths.highlighted(F.col("snippet")).alias("snippet"))


@query("token_vectors", f"SELECT doc_id AS file_id, tok AS token, count(*) AS n, min(pos - 1) AS first FROM (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (SELECT doc_id, {_WORDS.format('text')} AS toks FROM documents)) GROUP BY ALL")
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_vectors(a.document_files(spark, sf_dir))


# --- events ---------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.table(spark, sf_dir, "events")
    return t.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.col("event_id").alias("seq"))


@query("debounce_sessions", """WITH e AS (SELECT 'user/' || user_id AS path, ts, event_type AS event, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 60 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM e)
SELECT path, min(ts) AS started, max(ts) AS ended, count(*) AS n, arg_max(event, (ts, event_id)) AS event FROM s GROUP BY path, burst""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quiet.debounce(_events(spark, sf_dir), "60 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("stream_debounce")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of the events table, driven to its end; the last bursts stay open."""
    import uuid

    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    events = _events(spark, sf_dir)
    events.write.parquet(f"{where}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{where}/in")
    quiet.run_stream(stream, f"{where}/out", f"{where}/state", "60 minutes", "1 hour")
    return spark.read.schema("path string, started timestamp, ended timestamp, n long, event string").parquet(f"{where}/out")


# --- sources ------------------------------------------------------------------------------


@query("source_grouped_json", "SELECT p_partkey AS file_id, ns AS namespace, k AS key, v AS value FROM part, LATERAL (VALUES ('exif', 'ImageWidth', p_size::VARCHAR), ('iptc', 'Keywords', p_name), ('file', 'FileType', 'JPEG'), ('file', 'FileSize', '9 kB')) AS x(ns, k, v)")
def source_grouped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct(F.col("p_size").alias("EXIF:ImageWidth"), F.col("p_name").alias("IPTC:Keywords"), F.lit("(binary data 9 bytes)").alias("EXIF:Thumb"), F.lit("a.jpg").alias("File:FileName"), F.lit("12").alias("ExifTool:Version"),
        F.lit("JPEG").alias("File:FileType"), F.lit("9 kB").alias("File:FileSize"), F.lit("/x").alias("EXIF:Directory"), F.lit("a.jpg").alias("SourceFile"), F.lit("x").alias("NoGroup"), F.lit("x").alias("System:FileInodeChangeDate"), F.lit("x").alias("XMP:filepermissions"))
    return readers.grouped_json(a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.to_json(F.array(fields)).alias("json")))


@query("source_parser_json", "SELECT p_partkey AS file_id, part, ns AS namespace, k AS key, v AS value FROM part, LATERAL (VALUES (0, 'dc', 'title', p_name), (0, 'tika', 'label', p_brand), (1, 'dc', 'subject', p_type), (1, 'dc', 'subject', p_brand)) AS x(part, ns, k, v)")
def source_parser_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.create_map(F.lit("dc:title"), F.col("p_name"), F.lit("label"), F.col("p_brand"), F.lit("X-TIKA:parsed"), F.lit("x"), F.lit("blank"), F.lit(" "))
    two = F.create_map(F.lit("dc:subject"), F.to_json(F.array("p_type", "p_brand")))
    return readers.parser_json(a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.to_json(F.array(one, two)).alias("json")))


@query("source_info_json", "SELECT p_partkey AS file_id, d AS definition, v AS value FROM part, LATERAL (VALUES (73, p_name), (75, p_brand), (45, '2024-01-27'), (72, p_type), (72, p_brand)) AS x(d, v)")
def source_info_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("channel"), F.lit("20240127").alias("upload_date"), F.array("p_type", "p_brand").alias("tags"), F.lit(" ").alias("description"))
    return readers.info_json(a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.to_json(fields).alias("json")))
