"""Repeated passages, found over super-k-mers dealt out by their minimisers.

A window is `width` consecutive words. Its minimiser is the smallest hash of
the m-word grams in it, so equal windows have equal minimisers, and consecutive
windows mostly share theirs: such a run, a super-k-mer, travels as one packed
string to the bucket of its minimiser, where sorting brings equal windows
together, compared by their words.

A minimiser that only one document has cannot lead to a repeated window, so the
minimisers alone are counted first and only strings of the shared ones travel.
The bucket of a very frequent minimiser is not gathered: its windows go singly,
by a 128-bit digest, through an aggregation that adds up before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, materialise, small_batches, window_hashes
from shelfmark.llm.neardup import hashes_of

WIDTH = 50
#: Words of the grams among which a minimiser is chosen.
GRAM = 8
#: Documents from which a minimiser's windows are dealt out singly: its bucket would not fit one task.
HOT_DOCS = 4000
ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def super_kmers(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of windows that share a minimiser."""
    n = len(words) - width + 1
    if n <= 0:
        return []
    grams = window_hashes(hashes_of(words), gram).view(np.int64)
    within = width - gram + 1
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, within).argmin(1)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return list(zip(grams[place[starts]].tolist(), starts.tolist(), np.diff(np.append(starts, n)).tolist()))


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, merged ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _minimisers(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(mini, doc_id): each distinct minimiser of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            minis, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {m for m, _, _ in super_kmers(words_of(text), width, gram)}
                minis += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(minis, pa.int64()), pa.array(ids, pa.int64())], names=["mini", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "mini long, doc_id long")


def _packed(rows: DataFrame, hot: bool, width: int, gram: int) -> DataFrame:
    """The super-k-mers of shared minimisers; of hot ones, digests of their windows."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            out: list[tuple] = []
            for row, doc, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shared, words = set(shared), words_of(text)
                # A string that a text repeats travels once, with all its places.
                places: dict[tuple[int, bytes], list[int]] = {}
                for mini, at, windows in super_kmers(words, width, gram):
                    if mini in shared:
                        places.setdefault((mini, b" ".join(words[at : at + windows + width - 1])), []).append(at)
                out += [(mini, doc, row, at, packed) for (mini, packed), at in places.items()]
            columns = list(zip(*out)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["mini", "doc_id", "row", "at", "packed"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            out: list[tuple] = []
            for row, doc, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shared, words = set(shared), words_of(text)
                for mini, at, windows in super_kmers(words, width, gram):
                    if mini in shared:
                        for k in range(at, at + windows):
                            out.append((hashlib.blake2b(b" ".join(words[k : k + width]), digest_size=16).digest(), doc, row, k))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["window", "doc_id", "row", "at"])

    if hot:
        return rows.where(F.size("hot") > 0).select("row", "doc_id", "text", "hot").mapInArrow(single, "window binary, doc_id long, row long, at int")
    return rows.where(F.size("shared") > 0).select("row", "doc_id", "text", "shared").mapInArrow(normal, "mini long, doc_id long, row long, at array<int>, packed binary")


def _bucket_ranges(bucket: list[tuple[int, int, list[int], bytes]], width: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, row, first word, last word + 1) that the windows of one bucket remove; bucket holds (doc, row, at, packed)."""
    windows: list[tuple[bytes, int, int, int, list[int]]] = []
    for doc, row, at, packed in bucket:
        ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        for k in range(len(ends) - width + 1):
            windows.append((packed[starts[k] : ends[k + width - 1]], doc, row, k, at))
    windows.sort()
    before, first = None, 0
    for window, doc, row, k, places in windows:
        if window != before:
            before, first = window, doc
        if doc > first:
            for at in places:
                yield doc, row, at + k, at + k + width


def _bucket_scan(packed: DataFrame, width: int) -> DataFrame:
    """Removed ranges from buckets sorted by minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ranges: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            by_row: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for doc, row, a, b in ranges:
                by_row.setdefault((doc, row), []).append((a, b))
            flat = [(*row, a, b) for row, found in by_row.items() for a, b in _union(found)]
            columns = list(zip(*flat)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row", "start", "stop"])

        at_mini, bucket, ranges = None, [], []
        for batch in chunks(batches, 1024):
            for mini, doc, row, at, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if mini != at_mini:
                    if len(bucket) > 1:
                        ranges += _bucket_ranges(bucket, width)
                    at_mini, bucket = mini, []
                    if len(ranges) > 50_000:
                        yield out(ranges)
                        ranges = []
                bucket.append((doc, row, at, text))
        if len(bucket) > 1:
            ranges += _bucket_ranges(bucket, width)
        yield out(ranges)

    return packed.mapInArrow(run, "doc_id long, row long, start long, stop long")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(row, doc_id, text, ranges) of the rows from which something is removed.

    ranges are the words, (start, stop) with stop exclusive, covered by windows
    that also start in a document with a smaller id. row is a hash of id and
    text: rows alike in both share it and their verdict. Rows that share an id
    are one document to each other and never remove each other's words. Rows
    with a null id neither lose words nor make others lose any; null and short
    texts have no windows. Texts are judged whole, as they came in, however long;
    an empty table gives an empty result. Minimisers are counted when this is called.
    """
    small_batches(docs.sparkSession)
    gram = min(gram, width)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    minis = _minimisers(own, width, gram)
    shared = minis.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = materialise(shared.select("mini", (F.col("n") > hot_docs).alias("is_hot")), "shared")
    mine = minis.join(shared, "mini").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("is_hot"), F.col("mini"))).alias("shared"), F.collect_set(F.when(F.col("is_hot"), F.col("mini"))).alias("hot"))
    rows = own.withColumn("row", F.xxhash64("doc_id", "text")).join(mine, "doc_id").select("row", "doc_id", "text", "shared", "hot")
    rows = materialise(rows, "candidates")

    packed = _packed(rows, False, width, gram)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = packed.repartition(parts, "mini").sortWithinPartitions("mini", "doc_id")
    ranges = _bucket_scan(buckets, width)
    if shared.where("is_hot").take(1):
        single = materialise(_packed(rows, True, width, gram), "windows")
        # First documents are added up task by task and then written, so that the join may split the rows of one window.
        first = single.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("window", "first")
        again = single.join(materialise(first, "first"), "window").where("doc_id > first")
        ranges = ranges.unionByName(again.select("doc_id", "row", F.col("at").cast("long").alias("start"), (F.col("at") + width).cast("long").alias("stop")))
    # Ranges of a row are at most its words.
    per_row = ranges.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return rows.dropDuplicates(["doc_id", "row"]).join(per_row, ["doc_id", "row"]).select("row", "doc_id", "text", "ranges")


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, row, n_removed, kept): what is left of each text, its words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            removed, kept = [], []
            for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words, at, left = words_of(text), 0, []
                for a, b in _union([(r["start"], r["stop"]) for r in ranges]):
                    left += words[at:a]
                    at = b
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "row", "n_removed", "kept"])

    return rows.select("doc_id", "row", "text", "ranges").mapInArrow(run, "doc_id long, row long, n_removed long, kept binary")


def _whole(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, whole_sha256) of every row, as if nothing were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(digests, pa.string())], names=["row", "doc_id", "n_words", "whole_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, whole_sha256 string")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs; see repeated_ranges()."""
    cut = _cut(repeated_ranges(docs)).select(F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row"), "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    out = _whole(docs).join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("row") == F.col("cut_row")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with the repeated words removed; a text that loses some has its other words joined by one space."""
    names = docs.columns
    cut = _cut(repeated_ranges(docs, id_col, text_col, width)).select(F.col("doc_id").alias("cut_id"), "row", F.col("kept").cast("string").alias("kept"))
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    keyed = keyed.withColumn("own_row", F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))
    joined = keyed.join(cut, (F.col("own_row") == F.col("row")) & (F.col(key).cast("long") == F.col("cut_id")), "left")
    return joined.select(*[(F.coalesce("kept", text) if f"c{i}" == text else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))]).toDF(*names)
