"""URL filters: allow and block entries in a trie over reversed host labels, then path segments.

An entry is a host and the beginning of a path. It fits its host and all
subdomains, where the URL's path begins with its own. Of the entries that fit,
the longest decides.

The trie is built once on the driver and broadcast, if the entries' text stays
under MAX_TRIE_BYTES. A larger list is not sent: each host and path asks for its
own ending labels and beginning segments by an equality join, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import table

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of hosts and paths of all entries up to which their trie is broadcast.
MAX_TRIE_BYTES = 64 << 20

#: Entries of the registered query, as its contract states them.
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]


@dataclass
class Node:
    """One label or segment. ends: beginnings of the next segment at which an entry ends ("": at this node), with its verdict."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    ends: dict[str, str] = field(default_factory=dict)


def segments_of(path: str) -> list[str]:
    """Pieces of a path that end in a slash, and what follows the last one (maybe nothing)."""
    whole = path.split("/")
    return [f"{x}/" for x in whole[:-1]] + whole[-1:]


def build_trie(entries: Iterable[tuple[str, str, str]]) -> Node:
    """The trie of entries (host, path, verdict); of an entry told twice with both verdicts, block stays."""
    root = Node()
    for host, path, verdict in entries:
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, rest = segments_of(path)
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.ends[rest] = BLOCK if BLOCK in (verdict, node.ends.get(rest)) else verdict
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(entry as host and path, verdict) of the longest entry that fits; of equal length, the one with more of the host."""
    best: tuple[int, int, str, str] | None = None
    labels, pieces = host.split("."), segments_of(path)
    top: Node | None = root
    for known in range(1, len(labels) + 1):
        top = top.labels.get(labels[-known])
        if top is None:
            break
        own = ".".join(labels[-known:])
        node: Node | None = top
        passed = 0
        for piece in pieces:
            for rest, verdict in node.ends.items() if len(node.ends) <= len(piece) else ((piece[:n], node.ends.get(piece[:n])) for n in range(len(piece) + 1)):
                if verdict is not None and piece.startswith(rest):
                    size = len(own) + passed + len(rest)
                    if best is None or (size, known) > best[:2]:
                        best = (size, known, own + path[: passed + len(rest)], verdict)
            node = node.segments.get(piece)
            if node is None:
                break
            passed += len(piece)
    return best and (best[2], best[3])


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; "" without."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def clean_entries(rules: DataFrame) -> DataFrame:
    """Distinct entries (host, path, verdict), A-Z of hosts lower-cased, without those that lack a host; null paths count as ""."""
    own = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.when(F.col("verdict") == ALLOW, ALLOW).otherwise(BLOCK).alias("verdict"))
    # min: "allow" sorts before "block", so that max keeps block.
    return own.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def _by_trie(places: DataFrame, entries: list[tuple[str, str, str]]) -> Column:
    trie = places.sparkSession.sparkContext.broadcast(build_trie(entries))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([longest_match(trie.value, h, p) or (None, None) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return found("_h", "_p")


def _by_join(places: DataFrame, entries: DataFrame) -> DataFrame:
    """places (_h, _p) with the struct _found. An entry is met under its host and whole segments; each place asks for its own."""
    cut = F.length(F.regexp_extract("path", r"(?s)^(.*/)?", 1))
    known = entries.select(F.col("host").alias("_k"), F.substring("path", F.lit(1), cut).alias("_d"), "path", "verdict")
    labels = F.split("_h", r"\.", -1)
    asked = places.select("_h", "_p").distinct()
    asked = asked.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))))
    pieces = F.split("_p", "/", -1)
    begin = lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), n), "/"), F.lit("/"))).otherwise(F.lit(""))
    asked = asked.withColumn("_d", F.explode(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), begin)))
    fits = asked.join(known, ["_k", "_d"]).where(F.startswith("_p", "path"))
    rule = F.struct((F.length("_k") + F.length("path")).alias("size"), F.length("_k").alias("own"), F.concat("_k", "path").alias("rule"), "verdict")
    best = fits.groupBy("_h", "_p").agg(F.max(rule).alias("best")).select("_h", "_p", F.struct("best.rule", "best.verdict").alias("_found"))
    return places.join(best, ["_h", "_p"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """All columns of pages and host, path, rule (the deciding entry, or null) and verdict ("allow" or "block").

    rules has host, path and verdict; any verdict but "allow" blocks, and an entry
    told with both blocks. A URL that no entry fits gets the default. A null URL, or
    one without "://", has an empty host and path, which no entry fits. Hosts are
    taken as they stand, with user and port. Columns of pages with these four names
    are replaced; rows are judged one by one, so repeated ones too; an empty table of
    either kind is fine. URLs are read whole, however long.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    inner = {c: f"_{i}" for i, c in enumerate(names)}
    own = pages.select(*(F.col(f"`{c}`").alias(k) for c, k in inner.items()), host_of(F.col(f"`{url_col}`")).alias("_h"), path_of(F.col(f"`{url_col}`")).alias("_p"))
    entries = clean_entries(rules)
    weight = entries.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0
    judged = own.withColumn("_found", _by_trie(own, [tuple(r) for r in entries.collect()])) if weight <= MAX_TRIE_BYTES else _by_join(own, entries)
    back = [F.col(k).alias(c) for c, k in inner.items()]
    return judged.select(*back, F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))


def op13_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL, by RULES."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


URLFILTER_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT host, path, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(rv, length(rh) + length(rp)) AS rv
      FROM (SELECT DISTINCT host, path FROM h) JOIN r ON ends_with('.' || host, '.' || rh) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM h LEFT JOIN m USING (host, path)
"""
