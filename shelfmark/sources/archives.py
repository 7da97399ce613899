"""ZIP archives in place: the directory is read by seeks from the file's end, entries from where they lie.

Nothing is held whole, neither an archive nor its directory nor an entry. The listing
tells where each entry lies, so entries of one archive are read by as many tasks as
there are rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.layers import MAX_ENTRIES
from shelfmark.sources.stores import opened

# Fixed values of the ZIP format: signatures, and the sizes of records without their variable ends.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 56, 20, 46, 30
STORED, DEFLATED = 0, 8

#: Bytes read at a time, and of an entry's part.
CHUNK = 1 << 20
ENTRIES = "archive string, internal string, size long, packed long, method int, at long, crc long, modified timestamp"
PARTS = "archive string, internal string, part int, content binary, error string"


def _exactly(file: BinaryIO, at: int, n: int) -> bytes:
    file.seek(at)
    found = file.read(n)
    if len(found) < n:
        raise ValueError("archive ends early")
    return found


def directory(file: BinaryIO, size: int) -> tuple[int, int, int, int]:
    """(place, bytes, entries, lead) of the central directory of a file of so many bytes; lead is what stands before the archive, which moves all its offsets."""
    tail_at = max(0, size - END_SIZE - 0xFFFF)
    tail = _exactly(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_SIZE:
        raise ValueError("no archive")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if n == 0xFFFF or 0xFFFFFFFF in (length, offset):
        locator = _exactly(file, end - LOCATOR_SIZE, LOCATOR_SIZE)
        if locator[:4] == LOCATOR:
            n, length, offset = struct.unpack_from("<QQQ", _exactly(file, struct.unpack_from("<Q", locator, 8)[0], END64_SIZE), 32)
            end = struct.unpack_from("<Q", locator, 8)[0]
    if offset + length > end:
        raise ValueError("directory beyond its end")
    return end - length, length, n, end - length - offset


def entries(file: BinaryIO, size: int) -> Iterator[tuple[str, int, int, int, int, int, tuple]]:
    """(name, size, packed, method, offset, crc, time) of the entries, folders too; method is -1 if the entry is encrypted."""
    at, length, n, lead = directory(file, size)
    stop, held = at + length, b""
    for _ in range(n):
        while len(held) < ENTRY_SIZE or len(held) < ENTRY_SIZE + sum(struct.unpack_from("<HHH", held, 28)):
            if at >= stop:
                raise ValueError("directory ends early")
            more = _exactly(file, at, min(CHUNK, stop - at))
            held, at = held + more, at + len(more)
        if held[:4] != ENTRY:
            raise ValueError("no entry")
        flags, method, time, date, crc, packed, whole = struct.unpack_from("<HHHHIII", held, 8)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", held, 28)
        offset = struct.unpack_from("<I", held, 42)[0]
        name = held[ENTRY_SIZE : ENTRY_SIZE + n_name]
        extra = held[ENTRY_SIZE + n_name : ENTRY_SIZE + n_name + n_extra]
        held = held[ENTRY_SIZE + n_name + n_extra + n_comment :]
        while len(extra) >= 4:
            kind, bytes_ = struct.unpack_from("<HH", extra)
            if kind == 1:  # long sizes stand here, in this order, where the short one is full
                wide = extra[4 : 4 + bytes_]
                longs = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
                whole, packed, offset = (next(longs, v) if v == 0xFFFFFFFF else v for v in (whole, packed, offset))
            extra = extra[4 + bytes_ :]
        text = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        moment = ((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2)
        yield text, whole, packed, -1 if flags & 1 else method, offset + lead, crc, moment


def unpacked(file: BinaryIO, at: int, packed: int, method: int, crc: int) -> Iterator[bytes]:
    """The bytes of the entry whose local record lies at a place, in parts; their checksum is tested at the end."""
    if method not in (STORED, DEFLATED):
        raise ValueError("method not known")
    head = _exactly(file, at, LOCAL_SIZE)
    if head[:4] != LOCAL:
        raise ValueError("no entry")
    at += LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))
    tool, seen, left = zlib.decompressobj(-15) if method == DEFLATED else None, 0, packed
    while left:
        raw = _exactly(file, at, min(CHUNK, left))
        at, left = at + len(raw), left - len(raw)
        while raw:
            part = tool.decompress(raw, CHUNK) if tool else raw
            raw = tool.unconsumed_tail if tool else b""
            if part:
                seen = zlib.crc32(part, seen)
                yield part
    if tool and (part := tool.flush()):
        seen = zlib.crc32(part, seen)
        yield part
    if seen != crc:
        raise ValueError("checksum differs")


def archive_entries(archives: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """ENTRIES of the files (not folders) in the ZIP archives of a column archive (URIs or absolute paths).

    What is no archive, cannot be read or has more entries than the limit gives none; a null gives none.
    internal has forward slashes and none in front.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import UTC, datetime

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.timestamp("us", "UTC")]
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        for batch in batches:
            for archive in filter(None, batch.column(0).to_pylist()):
                rows: list[tuple] = []
                try:
                    store, path = opened(archive)
                    with store.open_input_file(path) as file:
                        if directory(file, file.size())[2] > max_entries:
                            continue
                        for name, size, packed, method, at, crc, moment in entries(file, file.size()):
                            inner = name.replace("\\", "/").lstrip("/")
                            if not inner or inner.endswith("/"):
                                continue
                            try:
                                when = datetime(*moment, tzinfo=UTC)
                            except ValueError:
                                when = None
                            rows.append((archive, inner, size, packed, method, at, crc, when))
                except (OSError, ValueError, struct.error):
                    continue
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 10_000]), kinds)], names=names)

    return archives.select(F.col("archive").cast("string")).mapInArrow(run, ENTRIES)


def found_entries(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """listed (ENTRIES) of what is wanted (archive, internal), with the wanted name as asked: the entry of that name, else one that differs in case, the first by place."""
    asked = wanted.select("archive", F.col("internal").alias("asked")).distinct()
    both = asked.join(listed.withColumn("low", F.lower("internal")), (asked["archive"] == listed["archive"]) & (F.lower("asked") == F.col("low"))).drop(asked["archive"], "low")
    one = both.groupBy("archive", "asked").agg(F.min_by(F.struct(*[c for c in both.columns if c not in ("archive", "asked")]), F.struct(F.col("internal") != F.col("asked"), "at")).alias("e"))
    return one.select("archive", "asked", "e.*")


def entry_parts(found: DataFrame) -> DataFrame:
    """PARTS of entries (archive, internal, packed, method, at, crc), of CHUNK bytes at most, numbered from 0.

    A part without content ends each entry: its error is null if the checksum held, else what went wrong;
    of an entry that failed earlier parts may stand before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in PARTS.split(", ")]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
        for batch in batches:
            for archive, internal, packed, method, at, crc in zip(*(c.to_pylist() for c in batch.columns)):
                n, error = 0, None
                try:
                    store, path = opened(archive)
                    with store.open_input_file(path) as file:
                        for part in unpacked(file, at, packed, method, crc):
                            yield row(archive, internal, n, part, None)
                            n += 1
                except (OSError, ValueError, struct.error, zlib.error) as wrong:
                    error = str(wrong)
                yield row(archive, internal, n, None, error)

    return found.select("archive", "internal", "packed", "method", "at", "crc").mapInArrow(run, PARTS)
