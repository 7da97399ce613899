"""Tables kept in buckets by the hash of a key: a change rewrites the buckets that it touches and no others.

Below a folder lie data/v<n>/bucket=<b>, written by version n, and manifest/v<n>: of
each bucket the version that holds it. A manifest makes its version valid, so a
version is seen whole or not at all, a failed one is written over, and the one
before stays readable while the next is written. The manifest also carries the
id of the batch it came from, so that a batch that is played again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Snapshot:
    """A table with the given schema below a folder that all executors share; empty before its first apply().

    The number of buckets stays as it was at first; with rows in the billions take some ten thousand.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "path", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _listed(self, folder: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Valid versions, ascending."""
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        found = []
        for name in self._listed("manifest"):
            done = made(f"{self.path}/manifest/{name}/_SUCCESS")
            if done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
                found.append(int(name.removeprefix("v")))
        return sorted(found)

    def manifest(self, version: int | None = None) -> tuple[dict[int, int], int]:
        """(version by bucket that has rows, id of the last batch or -1) of a version, by default the last: as many rows as buckets."""
        known = self.versions()
        if not known:
            return {}, -1
        rows = self.spark.read.parquet(f"{self.path}/manifest/v{known[-1] if version is None else version}").collect()
        return {r.bucket: r.version for r in rows if r.bucket >= 0}, next(r.version for r in rows if r.bucket == -1)

    def _read(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)[0])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, merge: Merge, batch: int | None = None) -> list[int]:
        """Replaces the rows of the touched buckets by merge(their rows, changes); gives these buckets.

        changes has the key; a null key has a bucket of its own hash like any other. merge sees
        only rows of those buckets and must give rows of them. A batch that is not newer than the
        last one does nothing. changes is read twice.
        """
        held, last = self.manifest()
        if batch is not None and batch <= last:
            return []
        touched = sorted(r.b for r in changes.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect())
        version = max(self.versions(), default=-1) + 1
        if touched:
            merged = merge(self._read({b: v for b, v in held.items() if b in set(touched)}), changes).select(*self.schema.names)
            to = merged.withColumn("bucket", self.bucket(F.col(self.key)))
            to.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
            full = {int(name.removeprefix("bucket=")) for name in self._listed(f"data/v{version}") if name.startswith("bucket=")}
            held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in full}
        elif batch is None:
            return []
        rows = [*held.items(), (-1, last if batch is None else batch)]
        self.spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        return touched

    def vacuum(self) -> None:
        """Deletes what the last version does not read."""
        keep = set(self.manifest()[0].values())
        last = self.versions()[-1:]
        made = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = [f"data/{n}" for n in self._listed("data") if int(n.removeprefix("v")) not in keep] + [f"manifest/{n}" for n in self._listed("manifest") if int(n.removeprefix("v")) not in last]
        for name in gone:
            where = made(f"{self.path}/{name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


#: Files of a catalogue: facts, the hash of the first bytes, and whether extraction is due.
FILES = "path string, size long, modified timestamp, exists boolean, prefix_hash string, needs_update boolean"
ATTRIBUTES = "path string, definition int, value string, provider string"


def changed_files(known: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """found (path, size, modified) that is new, has another size, is over a second later, was gone, or, with force, all; and what known has and found lacks, with null facts."""
    k = known.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), "exists")
    moved = F.abs(F.unix_micros("modified") - F.unix_micros("old_modified")) > 1_000_000
    both = k.join(found.select("path", "size", "modified", F.lit(True).alias("seen")), "path", "full")
    other = F.col("exists").isNull() | ~F.col("size").eqNullSafe(F.col("old_size")) | F.coalesce(moved, F.col("modified").isNull() != F.col("old_modified").isNull()) | ~F.col("exists") | F.lit(force)
    return both.where(F.when(F.col("seen"), other).otherwise(F.col("exists"))).select("path", "size", "modified", F.coalesce("seen", F.lit(False)).alias("seen"))


def upsert_files(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """FILES after changed_files(): new facts clear the hash and ask for extraction, files not seen stay without existing."""
    both = rows.join(changes.withColumnsRenamed({"size": "new_size", "modified": "new_modified"}), "path", "full")
    seen = F.coalesce("seen", F.lit(False))
    return both.select(
        "path", F.when(seen, F.col("new_size")).otherwise(F.col("size")).alias("size"), F.when(seen, F.col("new_modified")).otherwise(F.col("modified")).alias("modified"),
        F.coalesce("seen", "exists").alias("exists"), F.when(~seen, F.col("prefix_hash")).alias("prefix_hash"), F.when(seen, True).otherwise(F.col("needs_update")).alias("needs_update"),
    )


class Catalogue:
    """Files and their attributes as two snapshots, brought up to date by the files found."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.files = Snapshot(spark, f"{path}/files", FILES, buckets=buckets)
        self.attributes = Snapshot(spark, f"{path}/attributes", ATTRIBUTES, buckets=buckets)

    def index(self, found: DataFrame, extract: Callable[[DataFrame], DataFrame], force: bool = False, promotion: str = "promotion") -> tuple[list[int], list[int]]:
        """Takes in found (path, size, modified), then reindexes; gives the buckets of files that facts and that attributes touched."""
        facts = self.files.apply(changed_files(self.files.read(), found, force), upsert_files)
        return facts, self.reindex(extract, promotion)

    def reindex(self, extract: Callable[[DataFrame], DataFrame], promotion: str = "promotion") -> list[int]:
        """Extracts anew what is due: extract gives ATTRIBUTES of files (FILES). Promoted attributes stay; all others of such files are replaced.

        A run that fails before its last step leaves the files due, and doing it again gives the same.
        """
        due = self.files.read().where("needs_update and exists")
        fresh = extract(due)

        def replaced(rows: DataFrame, changes: DataFrame) -> DataFrame:
            kept = rows.join(changes.select("path").distinct().withColumn("due", F.lit(True)), "path", "left").where(F.col("due").isNull() | (F.col("provider") == promotion))
            return kept.select(*self.attributes.schema.names).unionByName(changes.where("definition is not null").select(*self.attributes.schema.names))

        # Files of which nothing is extracted any more are among the changes too, without a definition.
        nothing = due.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.attributes.schema.fields[1:]])
        touched = self.attributes.apply(fresh.select(*self.attributes.schema.names).unionByName(nothing), replaced)
        self.files.apply(due.select("path"), lambda rows, done: rows.join(done.withColumn("done", F.lit(True)), "path", "left").withColumn("needs_update", F.col("needs_update") & F.col("done").isNull()))
        return touched
