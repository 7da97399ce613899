"""Line de-duplication by site-relative frequency, in DataFrame functions only.

For each host, a line's boilerplate ratio is the number of the host's pages
that hold it, divided by the number of the host's pages. Lines whose ratio
exceeds a limit are dropped wherever they stand on that host.

Counting moves 64-bit hashes of lines, once for each page and line, added up
before they are shuffled; no line of text moves. A host can have no more
boilerplate lines than its mean number of lines a page divided by the ratio,
so the list a page is joined with is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, materialise

#: A line is boilerplate on more than this share of a host's pages ...
MAX_RATIO = 0.03
#: ... if it stands on so many of them at least.
MIN_PAGES = 5
#: Boilerplate lines (8 bytes each) that are sent to all workers; more are joined by shuffle.
MAX_SENT_LINES = 500_000
#: Parts into which the pages of one host are dealt when joined by shuffle.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _told(line: Column) -> Column:
    """Whether a line has more than ASCII white space."""
    return F.translate(line, SPACES, "") != ""


def boilerplate(pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, n_pages, host_pages): the lines of each host that exceed the ratio.

    Blank lines and null texts have no lines to count; pages count for their
    host all the same. Null hosts form one host.
    """
    rows = pages.select(host.alias("host"), text.alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _told), lambda x: F.xxhash64(x)))
    counts = rows.select("host", F.explode(hashes).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = totals.withColumnRenamed("host", "total_host")
    return counts.join(totals, counts["host"].eqNullSafe(totals["total_host"])).where(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages")).select("host", "line_hash", "n_pages", "host_pages")


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of pages, text_col without its host's boilerplate lines, and n_lines and n_dropped.

    Null texts stay null and empty ones empty, with no lines dropped; lines of
    white space only are always kept. Repeated pages count as often as they
    occur. Columns named n_lines or n_dropped are replaced; an empty table
    gives an empty one. Texts are read whole, however long. Lines are counted
    when this is called.
    """
    own = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*own).alias("page"), host.alias("site"), F.col(text_col).alias("body"))
    found = materialise(boilerplate(rows, F.col("site"), F.col("body"), max_ratio, min_pages).select("host", "line_hash"), "boilerplate")
    per_host = found.groupBy("host").agg(F.collect_set("line_hash").alias("drop"))
    if found.limit(MAX_SENT_LINES + 1).count() <= MAX_SENT_LINES:
        joined = rows.join(F.broadcast(per_host), rows["site"].eqNullSafe(per_host["host"]), "left")
    else:
        # A host may hold a third of all pages: its list is repeated for each part of them.
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)))
        lists = per_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = salted.join(lists, salted["site"].eqNullSafe(lists["host"]) & (salted["salt"] == lists["part"]), "left")
    lines = _lines(F.col("body"))
    # A page has few of its host's lines: those it has are found by hash, and then each line is held against them only.
    hit = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("drop"))
    out = joined.select("page", lines.alias("lines"), F.when(F.col("drop").isNotNull(), hit).alias("hit"))
    left = F.when(F.coalesce(F.size("hit"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("hit", F.xxhash64(x)) | ~_told(x)))
    out = out.select("page", "lines", left.alias("left"))
    return out.select(
        *[(F.array_join("left", "\n") if c == text_col else F.col("page")[c]).alias(c) for c in own], F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and text_sha256 (of the lines left) of every document; its source is its host."""
    done = drop_boilerplate(docs.select("doc_id", "source", "text"), F.col("source"), "text")
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


VERDICTS_SQL = f"""
WITH rows AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT r) AS n_pages FROM lines
  WHERE translate(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '' GROUP BY source, line),
boiler AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n_pages >= {MIN_PAGES} AND c.n_pages > CAST({MAX_RATIO} AS DOUBLE) * t.host_pages),
marked AS (SELECT l.r, l.pos, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS body FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(body, '')) AS text_sha256
FROM rows LEFT JOIN joined USING (r)
"""


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the boilerplate lines of each source dropped; its own columns, n_chars as of the text left."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    source, text = (f"c{names.index(c)}" for c in ("source", "text"))
    done = drop_boilerplate(plain, F.col(source), text).select(*plain.columns).toDF(*names)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return done
