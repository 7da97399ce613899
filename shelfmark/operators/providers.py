"""Calls of metadata providers: retries, a circuit breaker, archive entries, and merged settings."""

from __future__ import annotations

import json
import time
import zipfile
from collections.abc import Callable, Iterable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Errors that may pass when a call is repeated.
PASSING = (OSError, TimeoutError, ConnectionError)
RETRIES, BASE_DELAY_S, FAILURES, RESET_S = 2, 0.5, 5, 300.0


class Executor:
    """Runs calls of one provider. A call that fails with a passing error is repeated after growing delays;
    after so many calls that failed for good in a row the provider is left alone for a while."""

    def __init__(self, retries: int = RETRIES, base_delay: float = BASE_DELAY_S, failures: int = FAILURES, reset: float = RESET_S, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.retries, self.base_delay, self.failures, self.reset = max(0, retries), max(0.0, base_delay), max(1, failures), max(1.0, reset)
        self.clock, self.sleep = clock, sleep
        self.failed, self.last = 0, 0.0

    def run(self, call: Callable[[], str | None]) -> tuple[str | None, bool, str | None]:
        """(result, incomplete, error): incomplete says that a later call may succeed."""
        if self.failed >= self.failures and self.clock() - self.last < self.reset:
            return None, True, "circuit open"
        for turn in range(self.retries + 1):
            try:
                result = call()
            except PASSING as error:
                if turn < self.retries:
                    self.sleep(self.base_delay * 2**turn)
                    continue
                self.failed += 1
                self.last = self.clock()
                return None, True, type(error).__name__
            except Exception as error:  # what is wrong with the file stays wrong
                return None, False, type(error).__name__
            self.failed = 0
            return result, False, None
        raise AssertionError("unreachable")


def extract(files: DataFrame, provider: Callable[[str], str | None], retries: int = RETRIES, base_delay: float = BASE_DELAY_S, failures: int = FAILURES, reset: float = RESET_S) -> DataFrame:
    """(file_id, result, incomplete, error): provider called with each path. Each task has a circuit of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        executor = Executor(retries, base_delay, failures, reset)
        for batch in batches:
            rows = [executor.run(lambda p=p: provider(p)) for p in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["file_id", "result", "incomplete", "error"])

    return files.select(F.col("file_id").cast("long"), "path").mapInArrow(run, "file_id long, result string, incomplete boolean, error string")


def extract_entries(archives: DataFrame, wanted: DataFrame, provider: Callable[[str, bytes], str | None]) -> DataFrame:
    """(archive_id, internal, result): provider called with the bytes of entries of ZIP archives.

    archives is (archive_id, content), wanted (archive_id, internal). A name is
    looked for as it is and then without case. What is no archive, no entry, or
    cannot be read gives null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, str | None]] = []
            for archive, content, names in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with zipfile.ZipFile(BytesIO(content or b"")) as z:
                        exact = set(z.namelist())
                        loose = {n.lower(): n for n in reversed(z.namelist())}
                        for name in names:
                            found = name if name in exact else loose.get(name.lower())
                            out.append((archive, name, provider(name, z.read(found)) if found else None))
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zipfile.zlib.error):
                    seen = {n for a, n, _ in out if a == archive}
                    out += [(archive, name, None) for name in names if name not in seen]
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive_id", "internal", "result"])

    asked = wanted.groupBy("archive_id").agg(F.array_sort(F.collect_set("internal")).alias("names"))
    own = archives.select(F.col("archive_id").cast("long"), "content").join(asked, "archive_id").select("archive_id", "content", "names")
    return own.mapInArrow(run, "archive_id long, internal string, result string")


def merged_settings(texts: Iterable[str]) -> dict:
    """JSON objects one over the other: objects merge, lists and other values replace; what is no object is passed over."""

    def over(target: dict, source: dict) -> None:
        for key, value in source.items():
            if isinstance(value, dict) and isinstance(target.get(key), dict):
                over(target[key], value)
            else:
                target[key] = value

    out: dict = {}
    for text in texts:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, dict):
            over(out, found)
    return out
