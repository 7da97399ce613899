"""Change events of files, quieted: of a path's events the last one before a pause counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET = "750 milliseconds"


def debounce(events: DataFrame, quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """(path, started, ended, n, event) of bursts of events (path, ts, event, seq), batch or stream.

    A burst ends when a path has been quiet for the given time. event is its last
    one, the largest seq of those at the last time. A stream needs a watermark.
    """
    if watermark is not None:
        events = events.withWatermark("ts", watermark)
    burst = events.groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"), F.max_by("event", F.struct("ts", "seq")).alias("event"))
    return burst.drop("burst")


def run_stream(events: DataFrame, path: str, checkpoint: str, quiet: str, watermark: str) -> list[tuple[int, int]]:
    """Drives a stream of events to its end and appends closed bursts to Parquet at path; gives its progress, the rows of each batch."""
    out = debounce(events, quiet, watermark)
    query = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]


def apply_batch(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (path, exists) after a batch of debounced changes (path, event): deletes are soft, all else revives."""
    last = changes.groupBy("path").agg(F.max_by("event", "ended").alias("event")).select("path", (F.col("event") != "deleted").alias("now"))
    return state.join(last, "path", "full").select("path", F.coalesce("now", "exists").alias("exists"))
