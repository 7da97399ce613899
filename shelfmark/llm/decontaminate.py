"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is half a million consecutive words, or more, of whole documents. Its words
become integers; every word that no test phrase contains, and every document
end, becomes a sentinel of its own that matches nothing and settles the order
of the suffixes it starts. The suffix array comes from prefix doubling, the
Burrows-Wheeler transform goes into a wavelet matrix, and all phrases of equal
length are searched backwards together. Rows that match are located by walking
back to sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, small_batches

#: Words of a document phrase that counts as an occurrence.
WINDOW = 10
#: Words of one shard; building its index takes some 100 bytes of memory a word.
SHARD_WORDS = 1 << 19
#: Benchmark items, and bytes of their texts, that are sent to the workers for one pass over the corpus.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4 << 20
#: Every position that is a multiple of this is sampled.
SAMPLE_RATE = 16
ROWS = 1024

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class BitRank:
    """A bit vector that counts the ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """rank(symbol, i): occurrences of symbol among the first i of a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[tuple[int, BitRank, int]] = []
        for level in reversed(range(self.depth)):
            bits = (sequence >> level) & 1
            self.levels.append((level, BitRank(bits), int(len(bits) - bits.sum())))
            ones = bits.astype(bool)
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        every = np.arange(1 << self.depth)
        self.first = self._follow(every, np.zeros(len(every), np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._follow(symbol, at) - self.first[symbol]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes; each 0 in text is smaller than all else, and zeros order by place. Ends with 0."""
    n = len(text)
    counts = np.bincount(text, minlength=symbols)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = starts[text].astype(np.int64)
    zeros = np.flatnonzero(text == 0)
    rank[zeros] = np.arange(len(zeros))
    active = np.flatnonzero((text != 0) & (counts[text] > 1))
    step = 1
    while len(active):
        key = (rank[active] << 32) | rank[active + step]
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = key >> 32
        index = np.arange(len(key))
        new_group = np.concatenate([[True], key[1:] != key[:-1]])
        old_group = np.concatenate([[True], old[1:] != old[:-1]])
        rank[active] = old + np.maximum.accumulate(np.where(new_group, index, 0)) - np.maximum.accumulate(np.where(old_group, index, 0))
        active = active[~(new_group & np.concatenate([new_group[1:], [True]]))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Full-text index of one shard; symbols are 1..symbols-1, 0 is a sentinel and also ends the text."""

    def __init__(self, text: np.ndarray, symbols: int, sample_rate: int = SAMPLE_RATE):
        self.n = len(text)
        order = suffix_array(text, symbols)
        self.bwt = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])
        self.tree = WaveletMatrix(self.bwt, symbols)
        # The walk back cannot pass a sentinel, so what follows one is sampled too.
        sampled = (order % sample_rate == 0) | (self.bwt == 0)
        self.marks, self.places, self.sampled = BitRank(sampled), order[sampled], sampled

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases (one row each, equal length): row numbers that occur, and their first and last + 1 suffix."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[live, column]
            low = self.below[symbol] + self.tree.rank(symbol, low)
            high = self.below[symbol] + self.tree.rank(symbol, high)
            found = high > low
            live, low, high = live[found], low[found], high[found]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of rows of the suffix order."""
        rows, steps, out = rows.copy(), 0, np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.sampled[here]
            out[open_[done]] = self.places[self.marks.rank(here[done])] + steps
            open_, here = open_[~done], here[~done]
            symbol = self.bwt[here]
            rows[open_] = self.below[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, as symbols."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.symbol: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        windows: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for at, (_, text) in enumerate(items):
            words = words_of(text)
            if words:
                ids = np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in words), np.int32, len(words))
                own = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                windows[own.shape[1]].append(own)
                owners[own.shape[1]].append(np.full(len(own), at))
        #: Of each length its phrases, and (first, owner): phrase p is in the items owner[first[p] : first[p + 1]].
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted(windows):
            phrases, phrase = np.unique(np.concatenate(windows[length]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([phrase.ravel(), np.concatenate(owners[length])], 1), axis=0)
            self.groups.append((length, phrases, np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1)), pairs[:, 1]))

    def items_of(self, first: np.ndarray, owner: np.ndarray, phrase: int) -> list[str]:
        return [self.names[i] for i in owner[first[phrase] : first[phrase + 1]].tolist()]


def _shard_hits(phrases: Phrases, docs: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged spans, as (first word, last word + 1), and items of each document of a shard."""
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(int(starts[-1]), np.int64)
    for at, d in zip(starts, docs):
        text[at : at + len(d)] = d
    if not phrases.groups or not text.any():
        return spans, items
    index = FMIndex(text, len(phrases.symbol) + 1)
    edge = np.zeros(len(text) + 1, np.int64)
    for length, rows, first, owner in phrases.groups:
        found, low, high = index.search(rows)
        if not len(found):
            continue
        many = high - low
        suffixes = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        places = index.locate(suffixes)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + length, -1)
        doc = np.searchsorted(starts, places, side="right") - 1
        for d, phrase in np.unique(np.stack([doc, np.repeat(found, many)], 1), axis=0).tolist():
            items[d].update(phrases.items_of(first, owner, phrase))
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    for a, b in turns.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans[d].append((a - int(starts[d]), b - int(starts[d])))
    return spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merge(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted([*one, *other]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    block: list[tuple[str, str]] = []
    n_bytes = 0
    for item, text in rows.toLocalIterator():
        n = len(text.encode("utf-8", "surrogatepass"))
        if block and n_bytes + n > BLOCK_BYTES:
            yield block
            block, n_bytes = [], 0
        block.append((item, text))
        n_bytes += n
        if len(block) == size:
            yield block
            block, n_bytes = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS, carry_text: bool = True
) -> DataFrame:
    """All columns of docs, and n_words (long), spans (merged word ranges that occur in a
    window of the benchmark, stop exclusive) and items (ids as sorted strings).

    Every row is judged by itself: null and empty texts have no words and no
    hits, repeated rows and ids each get their own result, and an empty table
    on either side gives no hits. Items with a null id or text, or no words,
    match nothing; items that share an id count as one. Columns of docs named
    n_words, spans or items are replaced. A benchmark of more than block_items
    rows or BLOCK_BYTES of text is searched block by block, each in a pass of its
    own; one block is all that is ever sent to the workers. Nothing is shuffled.
    Texts are read whole, however long. carry_text=False leaves the text column
    out of the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    out = docs.select(*own).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<start:bigint,stop:bigint>>"), "items": F.lit(None).cast("array<string>")})
    text_at = own.index(text_col)

    def one_pass(frame: DataFrame, items: list[tuple[str, str]], last: bool) -> DataFrame:
        kept = [i for i in range(len(own)) if i != text_at or carry_text or not last]
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)
            get = phrases.symbol.get
            held: list[pa.RecordBatch] = []
            words: list[np.ndarray] = []
            total = 0

            def flush() -> Iterator[pa.RecordBatch]:
                spans, items = _shard_hits(phrases, words)
                at = 0
                for batch in held:
                    n = batch.num_rows
                    old_spans, old_items = batch.column(len(own) + 1).to_pylist(), batch.column(len(own) + 2).to_pylist()
                    arrays = [batch.column(i) for i in kept]
                    arrays.append(pa.array([len(w) for w in words[at : at + n]], pa.int64()))
                    both = [_merge([(s["start"], s["stop"]) for s in x or ()], y) for x, y in zip(old_spans, spans[at : at + n])]
                    arrays.append(pa.array([[{"start": a, "stop": b} for a, b in x] for x in both], _SPANS))
                    arrays.append(pa.array([sorted({*(x or ()), *y}) for x, y in zip(old_items, items[at : at + n])], pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays(arrays, names=[own[i] for i in kept] + batch.schema.names[len(own) :])
                    at += n
                held.clear()
                words.clear()

            for batch in chunks(batches, ROWS):
                held.append(batch)
                for text in batch.column(text_at).to_pylist():
                    found = words_of(text)
                    words.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
                    total += len(found)
                if total >= shard_words:
                    yield from flush()
                    total = 0
            if held:
                yield from flush()

        return frame.mapInArrow(run, frame.select(*[own[i] for i in kept], "n_words", "spans", "items").schema)

    blocks = _blocks(benchmark, item_col, item_text_col, block_items)
    block = next(blocks, [])
    for following in blocks:
        out = one_pass(out, block, last=False)
        block = following
    return one_pass(out, block, last=True)


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, carry_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with their own columns."""
    names = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = find_contamination(renamed, benchmark, text_col=f"c{names.index('text')}")
    return found.where(F.size("spans") == 0).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
