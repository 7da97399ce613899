"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of this machine and any
    other master one beside the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        base = "file:///tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its plan is run once and cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with a column name: whole numbers from first on in the order of columns that tell rows apart.

    Rows are dealt out by ranges of the order; each range counts its own, and
    only the sizes of ranges come together.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_before")
    own = Window.partitionBy("_range").orderBy(*order)
    out = dealt.withColumn(name, F.row_number().over(own)).join(F.broadcast(before), "_range")
    return out.withColumn(name, (F.col(name) + F.col("_before") + F.lit(first - 1)).cast("long")).drop("_range", "_before")
