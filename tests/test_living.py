"""Snapshots in buckets and the watching stream."""

import datetime as dt
import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import snapshots
from shelfmark.operators.snapshots import Catalogue, Snapshot
from shelfmark.plans.living import _sizes
from shelfmark.streaming import watch

T0 = dt.datetime(2024, 1, 1)
FOUND = "path string, size long, modified timestamp"


def listing(spark, rows):
    return spark.createDataFrame([(p, s, T0 + dt.timedelta(seconds=t)) for p, s, t in rows], FOUND)


def written(place, version):
    return {p.parent.name for p in Path(place).glob(f"data/v{version}/bucket=*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rows = [(f"f{i}", i, 0) for i in range(600)]
    files = Snapshot(spark, f"file://{tmp_path}/files", snapshots.FILES, buckets=200)
    assert files.read().count() == 0 and files.manifest() == ({}, -1)
    files.apply(snapshots.changed_files(files.read(), listing(spark, rows)), snapshots.upsert_files)
    assert len(written(tmp_path / "files", 0)) > 150
    second = [(p, s + (s % 100 == 7), t) for p, s, t in rows if s != 300] + [("new", 1, 1)]
    touched = files.apply(snapshots.changed_files(files.read(), listing(spark, second)), snapshots.upsert_files)
    assert 0 < len(touched) <= 8 and written(tmp_path / "files", 1) == {f"bucket={b}" for b in touched}
    got = {r.path: (r.size, r.exists) for r in files.read().collect()}
    assert got == {p: (s, True) for p, s, _ in second} | {"f300": (300, False)}
    # The version before is there until it is cleared away.
    assert {r.path for r in files.read(0).collect()} == {p for p, _, _ in rows}
    files.vacuum()
    assert files.versions() == [1] and files.read().count() == 601
    assert files.apply(files.read().limit(0), snapshots.upsert_files) == []


def test_changes_are_told_and_flags_reset(spark, tmp_path):
    known = spark.createDataFrame([("same", 1, T0, True, "h", False), ("late", 1, T0, True, "h", False), ("big", 1, T0, True, "h", False), ("back", 1, T0, False, "h", False), ("gone", 1, T0, True, "h", True), ("lost", 1, T0, False, "h", False)], snapshots.FILES)
    found = listing(spark, [("same", 1, 1), ("late", 1, 2), ("big", 2, 0), ("back", 1, 0), ("new", 5, 0)])
    change = snapshots.changed_files(known, found)
    assert {(r.path, r.seen) for r in change.collect()} == {("late", True), ("big", True), ("back", True), ("new", True), ("gone", False)}
    rows = {r.path: (r.size, r.exists, r.prefix_hash, r.needs_update) for r in snapshots.upsert_files(known, change).collect()}
    assert rows == {"same": (1, True, "h", False), "late": (1, True, None, True), "big": (2, True, None, True), "back": (1, True, None, True), "new": (5, True, None, True), "gone": (1, False, "h", True), "lost": (1, False, "h", False)}
    assert {r.path for r in snapshots.changed_files(known, found, force=True).collect()} == {"same", "late", "big", "back", "new", "gone"}


def test_reindexing_replaces_what_is_due(spark, tmp_path):
    catalogue = Catalogue(spark, f"file://{tmp_path}/c", buckets=5)
    first = [("a", 2, 0), ("b", 4, 0), ("c", 5, 0)]
    catalogue.index(listing(spark, first), _sizes)
    catalogue.attributes.apply(spark.createDataFrame([("a", 38, "kept", "promotion")], snapshots.ATTRIBUTES), lambda rows, new: rows.unionByName(new))
    calls = []

    def extract(files):
        calls.append(sorted(r.path for r in files.collect()))
        return _sizes(files).where("path <> 'b'")

    catalogue.index(listing(spark, [("a", 3, 0), ("b", 6, 0), ("c", 5, 0)]), extract)
    assert calls == [["a", "b"]]
    want = {("a", 1, "3", "sizes"), ("a", 38, "kept", "promotion"), ("c", 1, "5", "sizes")}
    assert {tuple(r) for r in catalogue.attributes.read().collect()} == want
    assert catalogue.files.read().where("needs_update").count() == 0 and catalogue.reindex(extract) == []
    catalogue.index(listing(spark, [("a", 3, 0), ("b", 6, 0), ("c", 5, 0)]), extract, force=True)
    assert calls[-1] == ["a", "b", "c"] and {tuple(r) for r in catalogue.attributes.read().collect()} == want


EVENTS = "path string, target string, ts timestamp, event string, seq long"


def actions_of(rows, quiet=750_000):
    """Each event by itself, over all the others."""
    micro = lambda t: round((t - T0).total_seconds() * 1e6)
    out = []
    for p, target, t, e, s in rows:
        if p is None:
            continue
        later = [micro(u) for q, _, u, f, r in rows if q == p and f in watch.CANCELS and (u, r) > (t, s)]
        if e not in watch.WAITS:
            out.append((p, target, micro(t), e, s))
        elif not later or min(later) - micro(t) >= quiet:
            out.append((p, target, micro(t) + quiet, "index", s))
    return sorted(out, key=str)


def events(n=240):
    rnd, t, rows = random.Random(1), T0, []
    for i in range(n):
        t += dt.timedelta(microseconds=rnd.choice([0, 1000, 300_000, 749_999, 750_000, 2_000_000]))
        e = rnd.choice(["created", "changed", "changed", "deleted", "renamed"])
        rows.append((f"p{rnd.randint(0, 5)}", f"p{rnd.randint(0, 5)}" if e == "renamed" else None, t, e, i))
    return rows


def test_actions(spark):
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    plain = [("a", None, ms(0), "created", 1), ("a", None, ms(500), "changed", 2), ("b", None, ms(0), "changed", 3), ("b", None, ms(700), "deleted", 4), ("b", None, ms(710), "created", 5), ("c", None, ms(0), "changed", 6), ("c", None, ms(750), "deleted", 7), ("d", "e", ms(1), "renamed", 8), ("d", None, ms(0), "created", 9), (None, None, ms(0), "created", 10)]
    for rows in (plain, events()):
        got = watch.actions(spark.createDataFrame(rows, EVENTS)).select("path", "target", F.unix_micros("at") - F.lit(int(T0.replace(tzinfo=dt.UTC).timestamp() * 1e6)), "action", "seq")
        assert sorted((tuple(r) for r in got.collect()), key=str) == actions_of(rows)
    assert watch.actions(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = events()
    for k in range(6):
        part = rows[k * 40 : (k + 1) * 40]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part + part[:5], EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05)
    state = Snapshot(spark, f"file://{tmp_path}/state", watch.STATE, buckets=3)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    progress = watch.run(stream, state, f"file://{tmp_path}/checkpoint", "5 seconds")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert sum(p["rows"] for p in progress) == 270 and progress[-1]["state"] < 100
    told = watch.actions(spark.createDataFrame(rows, EVENTS))
    mark = int(max(r[2] for r in rows).replace(tzinfo=dt.UTC).timestamp() * 1000) - 5000
    told = told.where(F.unix_micros("at") + F.when(F.col("action") == "index", 0).otherwise(watch.QUIET) <= mark * 1000)
    empty = spark.createDataFrame([], watch.STATE)
    want = sorted(tuple(r) for r in watch.applied(empty, watch.told_paths(told)).collect())
    assert sorted(tuple(r) for r in state.read().collect()) == want
    # A batch that is played again changes nothing, and leaves no new version.
    versions = state.versions()
    assert watch.apply_once(state, told, 0) == [] and watch.apply_once(state, told, state.manifest()[1]) == []
    assert state.versions() == versions and sorted(tuple(r) for r in state.read().collect()) == want


def test_a_path_waits_by_one_timer(spark, tmp_path):
    """Timers grow with the paths, not with their events."""
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    rows = [(f"p{i % 3}", None, ms(100 * i), "changed", i) for i in range(150)] + [("last", None, ms(20_650), "deleted", 150)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = watch.action_stream(spark.readStream.schema(EVENTS).parquet(f"file://{tmp_path}/in"), "5 seconds").writeStream.format("memory").queryName("one_timer")
    with watch.settings(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        stream = out.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
    timers = sum(s["customMetrics"].get("numRegisteredTimers", 0) for p in stream.recentProgress for s in p["stateOperators"])
    assert 0 < timers <= 4
    # The watermark ends exactly with the wait of p2, which is told.
    assert sorted((r.path, r.action, r.seq) for r in spark.table("one_timer").collect()) == [("p0", "index", 147), ("p1", "index", 148), ("p2", "index", 149)]


class Held(list):
    """State of one shard and its timers, in place of Spark's."""

    def __init__(self):
        self.timers, self.most = set(), 0

    getListState = lambda self, *_: self
    exists = lambda self: bool(self)
    get = lambda self: iter(list(self))
    appendValue = list.append

    def put(self, values):
        self[:] = values

    def registerTimer(self, at):
        self.timers.add(at)
        self.most = max(self.most, len(self.timers))

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)


class Mark(int):
    def getCurrentWatermarkInMs(self):
        return int(self)


@pytest.mark.parametrize("size", [1, 17, 240])
def test_paths_of_a_shard_do_not_mix(size):
    """Many paths in one shard, in batches that come out of order, tell what each event tells over all others."""
    micro = lambda t: round((t - T0).total_seconds() * 1e6)
    rows = sorted(events(), key=lambda r: micro(r[2]) + random.Random(r[4]).randint(0, 4_000_000))
    held, step, got, mark = Held(), watch.Debounce(watch.QUIET), [], 0
    step.init(held)
    for at in range(0, len(rows) + size, size):
        part = rows[at : at + size]
        if part:
            frame = pd.DataFrame([(p, target, micro(t), e, s) for p, target, t, e, s in part], columns=["path", "target", "t", "event", "seq"])
            assert list(step.handleInputRows((0,), iter([f for f in (frame[:9], frame[9:]) if len(f)]), Mark(mark))) == []
        mark = max(mark, max((micro(r[2]) // 1000 - 5000 for r in part), default=10**9))
        for due in sorted(d for d in held.timers if d <= mark):
            got += [tuple(None if pd.isna(v) else v for v in r) for f in step.handleExpiredTimer((0,), Mark(mark), None) for r in f.itertuples(index=False)]
            held.deleteTimer(due)
    assert sorted(got, key=str) == actions_of(rows) and not held and held.most <= 2


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_state_does_not_go_back(spark, tmp_path, order):
    rows = [("a", None, T0, "index", 1), ("a", "b", T0 + dt.timedelta(seconds=1), "renamed", 2), ("a", None, T0 + dt.timedelta(seconds=2), "index", 3)]
    state = Snapshot(spark, f"file://{tmp_path}/s", watch.STATE, buckets=2)
    for n, i in enumerate(order):
        watch.apply_once(state, spark.createDataFrame(rows[i : i + 1], watch.ACTIONS), n)
    got = {r.path: (r.exists, r.seq) for r in state.read().collect()}
    assert got == {"a": (True, 3), "b": (True, 2)}
