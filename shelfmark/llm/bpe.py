"""Byte-level BPE encoding and decoding as a monoid over text halves.

A text is halved down to leaves, leaves are encoded, and neighbours are joined
by encoding again a window around their border. The window grows until both
its ends stand where a non-space character is followed by white space. There
every scan of the split pattern has a border, whatever precedes or follows, so
no token outside the window can change: all alternatives of the pattern that
begin with white space hold white space at their front only, and none looks
back. Decoding concatenates the bytes of the leaves up the same kind of tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from shelfmark.llm.common import chunks, small_batches

#: Characters of a leaf that is encoded without being halved.
LEAF_CHARS = 1024
#: Tokens of a leaf that is decoded without being halved.
LEAF_TOKENS = 4096
#: Rows of one Arrow batch in Python.
ROWS = 512

_BORDER = re.compile(r"(?<=\S)[ \t\r\n]")


class TreeCodec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf_chars = max(2, leaf_chars)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a, b = self._border_before(text, lo, mid), self._border_after(text, mid, hi)
        if a == mid == b:
            return left + right
        window = self.encoding.encode_ordinary(text[a:b])
        keep = self._tokens_over(reversed(left), text[a:mid]) if a > lo else len(left)
        drop = self._tokens_over(right, text[mid:b]) if b < hi else len(right)
        return left[: len(left) - keep] + window + right[drop:]

    @staticmethod
    def _border_before(text: str, lo: int, mid: int) -> int:
        """The last sure border in (lo, mid], else lo."""
        step = 32
        while True:
            at = max(lo, mid - step)
            found = [m.start() for m in _BORDER.finditer(text, at, mid + 1) if m.start() > lo]
            if found or at == lo:
                return found[-1] if found else lo
            step *= 2

    @staticmethod
    def _border_after(text: str, mid: int, hi: int) -> int:
        """The first sure border in [mid, hi), else hi."""
        found = _BORDER.search(text, mid, hi)
        return found.start() if found else hi

    def _tokens_over(self, ids, span: str) -> int:
        """How many of the tokens cover the bytes of span, which ends on a token."""
        need, n = len(span.encode("utf-8")), 0
        for token in ids:
            if need <= 0:
                break
            need -= len(self.bytes_of[token])
            n += 1
        if need:
            raise AssertionError("a border must stand between tokens")
        return n

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """One codec for each Python worker."""
    return TreeCodec(path, pattern, leaf_chars)


def _with(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id_col, n_tokens, ids) for each row; ids are little-endian unsigned 32-bit integers.

    Null text counts as empty (no tokens). Rows are independent: repeated and
    null ids each get a row of their own, an empty table gives an empty table,
    and further columns of docs are left out, whatever their names. Nothing is
    shuffled and one text is held at a time, however long.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern, leaf_chars)
        for batch in chunks(batches, ROWS):
            ids = [np.array(tree.encode(t), "<u4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["key", "n_tokens", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of encoded, and decoded (binary): the bytes of ids_col. Null ids give null.

    A column named decoded is replaced, unless it holds the ids. Rows are independent, an empty table gives an empty one.
    """
    small_batches(encoded.sparkSession)
    if "decoded" in encoded.columns and ids_col != "decoded":
        encoded = encoded.drop("decoded")
    at = encoded.columns.index(ids_col)
    own = encoded.toDF(*[f"c{i}" for i in range(len(encoded.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        for batch in chunks(batches, ROWS):
            out = [None if x is None else tree.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield _with(batch, ["decoded"], [pa.array(out, pa.binary())])

    names = encoded.columns
    done = own.mapInArrow(run, StructType(own.schema.fields[:]).add("decoded", BinaryType()))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c != "decoded"], "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs; see encode()."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
