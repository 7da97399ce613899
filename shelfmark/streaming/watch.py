"""What a watcher of folders does about its events, in a batch and in a stream.

A file that was created or changed is indexed once it has been quiet; any later event
of its path but a rename starts or cancels that wait. A delete and a rename act at once.
Events are (path, target, ts, event, seq): target is a rename's new path, seq orders
events of equal time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.snapshots import Snapshot

#: Microseconds of quiet after which a file is indexed.
QUIET = 750_000
WAITS, CANCELS = ("created", "changed"), ("created", "changed", "deleted")
ACTIONS = "path string, target string, at timestamp, action string, seq long"
#: Groups of paths by hash; a task decides the held events of one at a time, so take more where over some hundred million are held at once.
SHARDS = 1024


def actions(events: DataFrame, quiet: int = QUIET) -> DataFrame:
    """ACTIONS of a batch: index (at the end of the wait), deleted and renamed. Rows without a path or time are passed over."""
    waits, cancels = F.col("event").isin(*WAITS), F.col("event").isin(*CANCELS)
    own = events.where("path is not null and ts is not null and event is not null").withColumn("t", F.unix_micros("ts"))
    after = Window.partitionBy("path").orderBy("t", "seq").rowsBetween(1, Window.unboundedFollowing)
    ended = own.withColumn("next", F.first(F.when(cancels, F.col("t")), ignorenulls=True).over(after))
    left = ended.where(~waits | F.col("next").isNull() | (F.col("next") - F.col("t") >= quiet))
    return left.select("path", "target", F.timestamp_micros(F.when(waits, F.col("t") + quiet).otherwise(F.col("t"))).alias("at"), F.when(waits, "index").otherwise(F.col("event")).alias("action"), "seq")


class Debounce(StatefulProcessor):
    """Holds the events of a shard of paths until the watermark tells that all that could cancel them have come.

    What comes together is held together, as lists. A shard has one timer, for the first of its
    events: it decides all that are due by then and is set again for those that are not.
    """

    HELD = ["path", "target", "t", "event", "seq"]
    TOLD = "path string, target string, t long, action string, seq long"

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "path array<string>, target array<string>, t array<long>, event array<string>, seq array<long>")

    def _due(self, t: Any) -> Any:
        """The millisecond at which an event of microsecond t is decided."""
        return -(-(t + self.quiet) // 1000)

    def _lists(self, events: pd.DataFrame) -> tuple[list, ...]:
        target = events["target"].astype(object)
        return tuple(c.tolist() for c in (events["path"], target.where(target.notna(), None), events["t"], events["event"], events["seq"]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = []
        for frame in rows:
            self.held.appendValue(self._lists(frame))
            first.append(int(frame["t"].min()))
        due = self._due(min(first))
        set_ = list(self.handle.listTimers())
        if all(due < at for at in set_):
            for at in set_:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        columns = zip(*self.held.get())
        events = pd.DataFrame({name: list(chain.from_iterable(lists)) for name, lists in zip(self.HELD, columns)}).sort_values(["path", "t", "seq"])
        t, waits = events["t"], events["event"].isin(WAITS)
        open_ = self._due(t) > timerValues.getCurrentWatermarkInMs()
        cancels = t.astype("Int64").where(events["event"].isin(CANCELS))
        following = cancels.groupby(events["path"]).bfill().groupby(events["path"]).shift(-1)
        done = events[~open_ & (~waits | (following - t >= self.quiet).fillna(True))]
        if open_.any():
            self.held.put([self._lists(events[open_])])
            self.handle.registerTimer(self._due(int(t[open_].min())))
        else:
            self.held.clear()
        if len(done):
            index = done["event"].isin(WAITS)
            yield pd.DataFrame({"path": done["path"], "target": done["target"].mask(index, None), "t": done["t"] + self.quiet * index, "action": done["event"].mask(index, "index"), "seq": done["seq"]})


@contextmanager
def settings(spark: SparkSession, **own: str) -> Iterator[None]:
    """Settings of the session that hold for a while, dots written as two underscores."""
    names = {k.replace("__", "."): v for k, v in own.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def action_stream(events: DataFrame, watermark: str, quiet: int = QUIET, shards: int = SHARDS) -> DataFrame:
    """actions() of a stream, each told once the watermark has passed the end of its wait.

    Events that come twice (with the same path and seq) within the watermark count once; those that
    come later than it are passed over. What is not decided when the stream stops is told when it goes on.
    The stream keeps its state in RocksDB, which must be set when it starts, see settings() and run().
    The number of shards stays as it was when the stream first started.
    """
    own = events.where("path is not null and ts is not null and event is not null").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["path", "seq"])
    own = own.select(F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard"), "path", "target", "ts", F.unix_micros("ts").alias("t"), "event", "seq")
    told = own.groupBy("shard").transformWithStateInPandas(Debounce(quiet), Debounce.TOLD, "Append", "EventTime")
    return told.select("path", "target", F.timestamp_micros("t").alias("at"), "action", "seq")


#: State of a path: whether it exists, and when and by which event it last changed.
STATE = "path string, exists boolean, indexed timestamp, at timestamp, seq long"


def applied(rows: DataFrame, done: DataFrame) -> DataFrame:
    """STATE after ACTIONS of paths: indexing revives and is remembered, a delete is soft, of several the last counts. See told_paths()."""
    order = F.struct("at", "seq")
    last = done.groupBy("path").agg(F.max_by("action", order).alias("action"), F.max(order).alias("when"), F.max(F.when(F.col("action") == "index", F.col("at"))).alias("told"))
    both = rows.join(last, "path", "full")
    newer = F.col("action").isNotNull() & (F.col("at").isNull() | (F.col("when") > F.struct("at", "seq")))
    return both.select(
        "path", F.when(newer, F.col("action") == "index").otherwise(F.col("exists")).alias("exists"), F.greatest("indexed", "told").alias("indexed"),
        F.when(newer, F.col("when.at")).otherwise(F.col("at")).alias("at"), F.when(newer, F.col("when.seq")).otherwise(F.col("seq")).alias("seq"),
    )


def told_paths(done: DataFrame) -> DataFrame:
    """A rename as two actions: its path goes, and its target is indexed."""
    renamed = F.col("action") == "renamed"
    there = done.where(renamed & F.col("target").isNotNull()).select(F.col("target").alias("path"), F.lit(None).cast("string").alias("target"), "at", F.lit("index").alias("action"), "seq")
    return done.withColumn("action", F.when(renamed, "deleted").otherwise(F.col("action"))).unionByName(there)


def apply_once(state: Snapshot, batch: DataFrame, batch_id: int) -> list[int]:
    """Applies a batch of ACTIONS to a snapshot of STATE, once for each batch id; gives the buckets that it touched."""
    return state.apply(told_paths(batch), applied, batch_id)


def run(events: DataFrame, state: Snapshot, checkpoint: str, watermark: str, quiet: int = QUIET, trigger: dict[str, Any] | None = None, shards: int = SHARDS) -> list[dict]:
    """Applies a stream of events to a snapshot of STATE until it ends; gives its progress.

    By default the stream takes what there is and stops, so that a scheduler can start it in turns that do
    not overlap; trigger={"processingTime": ...} lets it go on. A batch that is played again after a failure
    finds its id in the snapshot and does nothing.
    """
    spark = events.sparkSession
    with settings(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        out = action_stream(events, watermark, quiet, shards).writeStream.foreachBatch(lambda batch, n: _noted(apply_once(state, batch.persist(), n), batch))
        query = out.option("checkpointLocation", checkpoint).outputMode("append").queryName(f"watch-{uuid.uuid4().hex[:8]}").trigger(**(trigger or {"availableNow": True})).start()
        query.awaitTermination()
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "watermark": p["eventTime"].get("watermark"), "state": sum(s["numRowsTotal"] for s in p["stateOperators"])} for p in query.recentProgress]


def _noted(_: list[int], batch: DataFrame) -> None:
    batch.unpersist()
