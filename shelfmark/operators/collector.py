"""The four reports of a collector run: raw values, canonical values, keys without a rule, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import cleaned
from shelfmark.operators.normalize import aliases_table, rules_table


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def raw_report(raw: DataFrame, probe: str) -> DataFrame:
    """raw (file, provider, namespace, key, value, sub_resource, seq) on one line each, with mapped, whether a rule or an alias knows the key, and ignored.

    Keys of the probe are known by aliases, those of other providers by rules of their namespace. Blank values are none.
    """
    spark = raw.sparkSession
    rules = F.broadcast(rules_table(spark).select(F.col("namespace").alias("_ns"), F.col("key").alias("_key"), F.lit(True).alias("_ruled")).distinct())
    names = F.broadcast(aliases_table(spark).select("alias", (~F.col("ignored")).alias("_named")))
    rows = raw.withColumn("value", cleaned(F.coalesce(F.col("value"), F.lit("")))).where("value <> ''")
    met = rows.join(rules, (_key("namespace") == F.col("_ns")) & (_key("key") == F.col("_key")), "left").join(names, _key("key") == F.col("alias"), "left")
    by_probe = F.col("provider") == probe
    mapped = F.when(by_probe, F.coalesce("_named", F.lit(False))).otherwise(F.coalesce("_ruled", F.lit(False)))
    return met.select("file", "provider", "namespace", "key", "value", "sub_resource", "seq", mapped.alias("mapped"), (by_probe & ~F.coalesce("_named", F.lit(True))).alias("ignored"))


def canonical_report(attributes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, group, attribute, value, unit, source_provider, sub_resource) of attributes (file, definition, value, provider, sub_resource)."""
    own = attributes.join(F.broadcast(definitions.select("definition", "group", "name", "unit")), "definition")
    return own.select("file", F.coalesce("group", F.lit("")).alias("group"), F.col("name").alias("attribute"), cleaned(F.col("value")).alias("value"), "unit", F.col("provider").alias("source_provider"), "sub_resource")


def unmapped_report(report: DataFrame) -> DataFrame:
    """(provider, namespace, key, files, occurrences, sample_value) of raw_report(): keys to give a rule to, those of most files first."""
    lost = report.where("not mapped and not ignored")
    grouped = lost.groupBy("provider", F.lower("namespace").alias("namespace"), _key("key").alias("key"))
    found = grouped.agg(F.count_distinct("file").alias("files"), F.count("*").alias("occurrences"), F.min_by("value", F.struct("file", "seq", "value")).alias("sample_value"))
    return found.orderBy(F.desc("files"), F.desc("occurrences"), "provider", "namespace", "key")


def file_summary(files: DataFrame, report: DataFrame, canonical: DataFrame, errors: DataFrame) -> DataFrame:
    """(file, status, raw_items, unmapped_items, canonical_items, error) of files (file).

    A file without raw values is an Error if a provider failed on it (errors: file, seq, error, the first is told), else Empty; with any it is OK.
    """
    items = report.groupBy("file").agg(F.count("*").alias("raw_items"), F.count_if(~F.col("mapped") & ~F.col("ignored")).alias("unmapped_items"))
    made = canonical.groupBy("file").agg(F.count("*").alias("canonical_items"))
    wrong = errors.groupBy("file").agg(F.min_by("error", F.struct("seq", "error")).alias("error"))
    all_ = files.select("file").join(items, "file", "left").join(made, "file", "left").join(wrong, "file", "left").fillna(0, ["raw_items", "unmapped_items", "canonical_items"])
    status = F.when(F.col("raw_items") > 0, "OK").when(F.col("error").isNotNull(), "Error").otherwise("Empty")
    return all_.select("file", status.alias("status"), "raw_items", "unmapped_items", "canonical_items", "error")


def totals(summary: DataFrame, report: DataFrame) -> DataFrame:
    """(kind, name, n): files by status, raw values by provider, and values that are mapped and not."""
    by = lambda df, kind, c: df.groupBy(c.cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    known = F.when(F.col("mapped"), "mapped").when(F.col("ignored"), "ignored").otherwise("unmapped")
    return by(summary, "status", F.col("status")).unionByName(by(report, "provider", F.col("provider"))).unionByName(by(report, "mapping", known))


def write_reports(path: str, raw: DataFrame, canonical: DataFrame, unmapped: DataFrame, summary: DataFrame) -> None:
    """Writes the reports as CSV with a header below a folder, each in a folder of its own; the list of keys keeps its order in one file."""
    for name, df in (("raw-metadata", raw.drop("seq", "ignored")), ("canonical-metadata", canonical), ("unmapped-keys", unmapped.coalesce(1)), ("file-summary", summary)):
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")
