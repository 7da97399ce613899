"""Language-model scoring with a probabilistic suffix tree.

A text is read as its words, each closed by a space, and an end. Every
character is one of 64 symbols and, given its symbol, a character; the tree
predicts symbols, a smoothed table predicts the character within its symbol.
The probability of a token is that of its characters, mixed with the smoothed
share of the token as a whole, by which base_score goes: a word that training
lacks counts as one unseen word there, so both scores are over the same events.

Every context of up to DEPTH symbols that the training documents hold is judged. Its
next-symbol distribution is smoothed towards that of the context one symbol
shorter, and it is retained if the two diverge enough, by position and in all, or
if a longer context below it is retained. A position is scored by the longest
retained suffix of what precedes it.

Contexts of up to TOP symbols, 64**TOP at most whatever the corpus, are all kept and
sent to the workers. What lies below them grows with the corpus and stays dealt out
by its last TOP symbols, each part with whole subtrees. Documents are dealt into
blocks; a block asks the parts for its own distinct strings of DEPTH + 1 symbols
and for the counts of its distinct words, which are dealt out by hash. A part adds up
what the tasks counted, and answers the blocks, some at a time (STEP of them), so that
no group grows with the corpus; a part's own strings are bounded by the alphabet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, give_back, hash_words, lower_ascii, materialise, small_batches
from shelfmark.llm.symbols import code_points, fine_table, ngram_codes

SYMBOLS, BITS = 64, 6
DEPTH = 6
#: Depth of the contexts that are sent to all workers.
TOP = 3
#: Bits a position that a context must save over its parent, and bits it must save in all.
MIN_DIVERGENCE, MIN_GAIN = 0.001, 20.0
#: Weight, in positions, of the parent in a context's distribution.
SMOOTHING = 4.0
#: Weight of a token's smoothed share beside what the tree says of its characters.
WORD_WEIGHT = 0.5
#: Of the remainders of crc32(doc_id as text) modulo FOLDS, the one that is held out.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block of documents that is scored together.
BLOCK_BYTES = 16 << 20
ROWS = 256
#: Blocks, or what is counted over as much text, that a group of one part meets at most, about.
STEP = 256
#: Strings that are counted at a time.
CODES = 1_000_000
#: Distinct strings, and distinct words, that a counting task holds before it passes them on.
MAX_HELD, MAX_HELD_WORDS = 3_000_000, 300_000
#: Parts of the tree at most, and what stands in their place for counts of code points and of ends.
MAX_PARTS, POINTS, ENDS = 1 << 16, -1, -2
#: Bits of a number beside a string of DEPTH + 1 symbols in one whole number.
SPARE_BITS = 63 - BITS * (DEPTH + 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def read_symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text, after DEPTH edges and with the end last, and its code points but for the end."""
    points = code_points((b" ".join(words) + b" ").decode("utf-8", "surrogatepass")) if words else np.empty(0, np.uint32)
    symbols = np.zeros(len(points) + DEPTH + 1, np.uint8)
    symbols[DEPTH:-1] = fine_table()[points]
    return symbols, points


def add_up(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of strings and the sums of their n. Sorts codes and counts as one number, which is fast."""
    if len(n) and int(n.max()) >> SPARE_BITS:
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
    else:
        both = np.sort(codes << SPARE_BITS | n)
        codes, n = both >> SPARE_BITS, both & ((1 << SPARE_BITS) - 1)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Counts codes of strings, some at a time."""

    def __init__(self) -> None:
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.size = self.in_runs = 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size > CODES:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.runs.append(np.unique(np.concatenate(self.waiting), return_counts=True))
            self.in_runs += len(self.runs[-1][0])
            self.waiting, self.size = [], 0
        if self.in_runs > len(self.codes) + CODES:
            self._fold()

    def _fold(self) -> None:
        codes, n = zip((self.codes, self.n), *self.runs)
        self.codes, self.n = add_up(np.concatenate(codes), np.concatenate(n))
        self.runs, self.in_runs = [], 0

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        self._fold()
        return self.codes, self.n


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    """Part of the tree, by the last TOP symbols of a context."""
    return ((context & (SYMBOLS**TOP - 1)) * 2654435761 >> 16 & 0xFFFF) % parts


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their places, which compresses well."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack(numbers: np.ndarray) -> bytes:
    """Sorted whole numbers as the planes of their differences."""
    return planes(np.diff(numbers, prepend=0))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(of_planes(data))


def _dealt(part: np.ndarray, *columns: np.ndarray) -> dict[int, list[np.ndarray]]:
    """columns, dealt out by part in their order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    pieces = [np.split(c[order], first[1:]) for c in columns]
    return {p: [c[i] for c in pieces] for i, p in enumerate(part[first].tolist())}


_COUNTED = ("codes", "n", "words", "word_n")


def _rows(parts: dict[int, list[bytes]], names: tuple[str, ...], **fixed: int) -> Iterator[pa.RecordBatch]:
    """A row for each part."""
    keys = sorted(parts)
    for at in range(0, len(keys), 1000):
        some = keys[at : at + 1000]
        columns = [pa.array([v] * len(some), pa.int32()) for v in fixed.values()] + [pa.array(some, pa.int32())]
        columns += [pa.array([parts[p][i] for p in some], pa.binary()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays(columns, names=[*fixed, "part", *names])


def tally(docs: DataFrame, parts: int) -> DataFrame:
    """(step, part, codes, n, words, word_n) as tasks count them: strings of DEPTH + 1 symbols by part, words by hash, packed; step is the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        step = context.partitionId() if context else 0
        words_seen: Counter[bytes] = Counter()
        grams = Sums()
        points_seen = np.zeros(0x110000, np.int64)
        ends = 0

        def strings() -> Iterator[pa.RecordBatch]:
            codes, n = grams.totals()
            found = _dealt(part_of(codes >> BITS, parts), codes, n)
            return _rows({p: [pack(c), planes(m), b"", b""] for p, (c, m) in found.items()}, _COUNTED, step=step)

        def whole_words() -> Iterator[pa.RecordBatch]:
            keys, n = hash_words(words_seen, len(words_seen)).view(np.int64), np.fromiter(words_seen.values(), np.int64, len(words_seen))
            order = np.argsort(keys)
            found = _dealt(np.mod(keys[order], parts), keys[order], n[order])
            words_seen.clear()
            return _rows({p: [b"", b"", pack(k), planes(m)] for p, (k, m) in found.items()}, _COUNTED, step=step)

        for batch in chunks(batches, ROWS):
            for text in batch.column(0).to_pylist():
                words = lower_ascii(text).split()
                words_seen.update(words)
                ends += 1
                symbols, points = read_symbols(words)
                grams.add(ngram_codes(symbols, DEPTH + 1, BITS))
                some = np.bincount(points) if len(points) else points
                points_seen[: len(some)] += some
            if len(words_seen) > MAX_HELD_WORDS:
                yield from whole_words()
            if len(grams.codes) > MAX_HELD:
                yield from strings()
                grams = Sums()
        if ends:
            yield from strings()
            yield from whole_words()
            found = np.flatnonzero(points_seen)
            yield from _rows({POINTS: [pack(found), planes(points_seen[found]), b"", b""], ENDS: [pack(np.zeros(1, np.int64)), planes(np.array([ends])), b"", b""]}, _COUNTED, step=step)

    return docs.select("text").mapInArrow(run, "step int, part int, codes binary, n binary, words binary, word_n binary")


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of one part, added up."""
    data = {c: group.column(c).to_pylist() for c in _COUNTED}
    codes, n = add_up(np.concatenate([*map(unpack, data["codes"])]), np.concatenate([*map(of_planes, data["n"])]))
    words, word_n = np.concatenate([*map(unpack, data["words"])]), np.concatenate([*map(of_planes, data["word_n"])])
    order = np.argsort(words)
    words, word_n = words[order], word_n[order]
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, np.int64)
    return codes, n, words[first], np.add.reduceat(word_n, first) if len(first) else word_n


def count_corpus(docs: DataFrame, parts: int, steps: int = 1, step: int = STEP) -> DataFrame:
    """One row for each part: tally() added up, short (strings of TOP + 1 symbols) with short_n, and totals.

    What the tasks counted is first added up in steps groups a part, each step of these in one, and so on.
    """

    def some(group: pa.Table) -> pa.Table:
        codes, n, words, word_n = _added(group)
        packed = [pack(codes), planes(n), pack(words), planes(word_n)]
        give_back()
        return pa.table([group.column("step").slice(0, 1), group.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in packed)], names=["step", "part", *_COUNTED])

    def merge(group: pa.Table) -> pa.Table:
        codes, n, words, word_n = _added(group)
        # The part of a string is that of its last TOP + 1 symbols, so they are counted nowhere else.
        short, short_n = add_up(codes & (SYMBOLS ** (TOP + 1) - 1), n)
        packed = [pack(codes), planes(n), pack(words), planes(word_n), pack(short), planes(short_n)]
        give_back()
        return pa.table(
            [group.column("part").slice(0, 1), *(pa.array([x], pa.binary()) for x in packed), *(pa.array([int(x)], pa.int64()) for x in (n.sum(), len(codes), word_n.sum(), len(words)))],
            names=["part", *_COUNTED, "short", "short_n", "total", "distinct", "total_words", "distinct_words"],
        )

    schema = "part int, codes binary, n binary, words binary, word_n binary, short binary, short_n binary, total long, distinct long, total_words long, distinct_words long"
    counted = tally(docs, parts)
    while steps > 1:
        counted = counted.withColumn("step", (F.col("step") % steps).cast("int")).groupBy("part", "step").applyInArrow(some, counted.schema)
        steps = -(-steps // step)
    return counted.groupBy("part").applyInArrow(merge, schema)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _found(keys: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The value of each code; keys are sorted and hold all codes. Looks them up in order, with their place beside them."""
    out = np.empty(len(codes), values.dtype)
    step = 1 << SPARE_BITS
    for at in range(0, len(codes), step):
        both = np.sort(codes[at : at + step] << SPARE_BITS | np.arange(min(step, len(codes) - at)))
        met = both >> SPARE_BITS
        first = np.diff(met, prepend=-1) != 0
        found = values[np.searchsorted(keys, met[first])]
        out[at + (both & (step - 1))] = found[np.cumsum(first) - 1]
    return out


@dataclass
class Top:
    """Contexts of up to TOP symbols: the row of each context of TOP symbols, that of its longest
    suffix seen where it was not, and next-symbol probabilities by row; log10 probabilities of characters."""

    row: np.ndarray
    prob: np.ndarray
    log_char: np.ndarray

    @classmethod
    def fit(cls, codes: np.ndarray, n: np.ndarray, points: np.ndarray, point_counts: np.ndarray) -> Top:
        """codes: TOP symbols and the next one."""
        row = np.zeros(1, np.int32)
        probs = np.full((1, SYMBOLS), 1 / SYMBOLS)
        for depth in range(TOP + 1):
            found, at = np.unique(codes >> BITS & (SYMBOLS**depth - 1), return_inverse=True)
            table = np.zeros((len(found), SYMBOLS))
            np.add.at(table, (at, codes & (SYMBOLS - 1)), n)
            row = np.tile(row, SYMBOLS) if depth else row
            weight = SMOOTHING if depth else SYMBOLS
            table = (table + weight * probs[row[found]]) / (table.sum(1, keepdims=True) + weight)
            row = row.copy()
            row[found] = len(probs) + np.arange(len(found))
            probs = np.concatenate([probs, table])
        own = fine_table()
        counts = np.zeros(0x110000)
        counts[points] = point_counts
        log_char = np.log10((counts + 1) / np.maximum(np.bincount(own, counts + 1, SYMBOLS), 1)[own])
        return cls(row, probs.astype(np.float32), log_char.astype(np.float32))

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the last symbol of each code after the TOP before it."""
        return self.prob[self.row[codes >> BITS & (SYMBOLS**TOP - 1)], codes & (SYMBOLS - 1)].astype(np.float64)


@dataclass
class Subtrees:
    """Retained contexts below the top, by depth: contexts with their log10 back-off weights,
    and codes (context, then the next symbol) with their log10 probabilities."""

    top: Top
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, top: Top, codes: np.ndarray, n: np.ndarray) -> Subtrees:
        """codes: all strings of DEPTH + 1 symbols of some subtrees."""
        above = np.unique(codes & (SYMBOLS ** (TOP + 1) - 1))
        parents = top.of(above)
        found = []
        for depth in range(TOP + 1, DEPTH + 1):
            grams, at = np.unique(codes & (SYMBOLS ** (depth + 1) - 1), return_inverse=True)
            many = np.bincount(at, n, len(grams))
            contexts, of = np.unique(grams >> BITS, return_inverse=True)
            total = np.bincount(of, many, len(contexts))
            parent = parents[np.searchsorted(above, grams & (SYMBOLS**depth - 1))]
            share = many / total[of]
            divergence = np.bincount(of, share * np.log2(share / parent), len(contexts))
            keep = (divergence >= MIN_DIVERGENCE) & (divergence * total >= MIN_GAIN)
            above, parents = grams, (many + SMOOTHING * parent) / (total[of] + SMOOTHING)
            found.append((contexts, total, keep, grams, of, parents))
        for deeper, shallower in zip(found[:0:-1], found[-2::-1]):
            bits = SYMBOLS ** (TOP + 1 + [x is shallower for x in found].index(True)) - 1
            shallower[2][np.searchsorted(shallower[0], deeper[0][deeper[2]] & bits)] = True
        return cls(top, [(c[k], np.log10(SMOOTHING / (t[k] + SMOOTHING)), g[k[of]], np.log10(p[k[of]])) for c, t, k, g, of, p in found])

    def log_next(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code, after the longest retained suffix before it."""
        out = np.log10(self.top.of(codes))
        for depth, (contexts, backoff, grams, log_prob) in enumerate(self.levels, TOP + 1):
            at, retained = _at(contexts, codes >> BITS & (SYMBOLS**depth - 1))
            out[retained] += backoff[at[retained]]
            at, seen = _at(grams, codes & (SYMBOLS ** (depth + 1) - 1))
            out[seen] = log_prob[at[seen]]
        return out


def fit_top(counts: DataFrame) -> Top:
    """The top of the tree from count_corpus(). The driver gets its counts, SYMBOLS ** (TOP + 1) at most."""

    def both(part: str, keys: str, n: str) -> tuple[np.ndarray, np.ndarray]:
        found = counts.where(part).select(keys, n).toArrow()
        return np.concatenate([np.empty(0, np.int64), *map(unpack, found.column(0).to_pylist())]), np.concatenate([np.empty(0, np.int64), *map(of_planes, found.column(1).to_pylist())])

    return Top.fit(*both("part >= 0", "short", "short_n"), *both(f"part = {POINTS}", "codes", "n"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, step: int = STEP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts are empty: one token, the end. A null id counts as an empty one.
    Repeated rows are rows of their own, in training as in scoring. Without any
    training document all counts are 0. Texts are read whole, however long. Other
    columns are not looked at, and an empty table gives an empty result. The
    corpus is counted when this is called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("id")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    parts = min(n_blocks, MAX_PARTS)
    slices = -(-n_blocks // step)
    counts = materialise(count_corpus(rows.where("not held_out"), parts, slices, step), "counts")
    n_words, n_distinct = counts.where("part >= 0").agg(F.coalesce(F.sum("total_words"), F.lit(0)), F.coalesce(F.sum("distinct_words"), F.lit(0))).first()
    ends = counts.where(f"part = {ENDS}").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    n_train, n_distinct = n_words + ends, n_distinct + (1 if ends else 0)
    sent = spark.sparkContext.broadcast(fit_top(counts))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text"), F.left("text", F.lit(64))), F.lit(n_blocks)).cast("int"))
    # Both readers of dealt take all its columns and so share one exchange.
    dealt = dealt.repartition(n_blocks, "block")

    def questions(block: int, codes: Sums, words: set[bytes]) -> Iterator[pa.RecordBatch]:
        asked, _ = codes.totals()
        hashes = np.unique(hash_words(words, len(words)).view(np.int64))
        strings, whole = _dealt(part_of(asked >> BITS, parts), asked), _dealt(np.mod(hashes, parts), hashes)
        yield from _rows({p: [pack(x[p][0]) if p in x else b"" for x in (strings, whole)] for p in {*strings, *whole}}, ("codes", "words"), block=block)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        codes, words = Sums(), set()
        for batch in chunks(batches, ROWS):
            for text, block in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if block != now and now is not None:
                    yield from questions(now, codes, words)
                    codes, words = Sums(), set()
                    give_back()
                now = block
                found = lower_ascii(text).split()
                words.update(found)
                codes.add(ngram_codes(read_symbols(found)[0], DEPTH + 1, BITS))
        if now is not None:
            yield from questions(now, codes, words)

    def answer(own: pa.Table, wanted: pa.Table) -> pa.Table:
        codes, n, known, many = (np.concatenate([np.empty(0, np.int64), *map(f, own.column(c).to_pylist())]) for c, f in zip(_COUNTED, (unpack, of_planes, unpack, of_planes)))
        tree = Subtrees.fit(sent.value, codes, n)
        logs, found = [], []
        for codes, words in zip(wanted.column("codes").to_pylist(), wanted.column("words").to_pylist()):
            logs.append(tree.log_next(unpack(codes)).astype(np.float32).tobytes())
            at, there = _at(known, unpack(words))
            found.append(np.where(there, many[at] if len(many) else 0, 0).astype(np.int64).tobytes())
        del tree, codes, n
        give_back()
        return pa.table([wanted.column("block"), wanted.column("codes"), pa.array(logs, pa.binary()), wanted.column("words"), pa.array(found, pa.binary())], names=["block", "codes", "logs", "words", "counts"])

    # Several blocks may fall into one task, which holds what it asks for one block at a time.
    asked = dealt.sortWithinPartitions("block").mapInArrow(ask, "block int, part int, codes binary, words binary")
    # A part answers the blocks of each slice in a group of its own.
    asked = asked.withColumn("slice", (F.col("block") % slices).cast("int"))
    told = counts.where("part >= 0").select("part", *_COUNTED).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    answers = told.groupBy("part", "slice").cogroup(asked.groupBy("part", "slice")).applyInArrow(answer, "block int, codes binary, logs binary, words binary, counts binary")

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        def joined(keys: str, values: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
            k = np.concatenate([np.empty(0, np.int64), *map(unpack, told.column(keys).to_pylist())])
            v = np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in told.column(values).to_pylist())])
            order = np.argsort(k)
            return k[order], v[order]

        codes, logs = joined("codes", "logs", np.float32)
        keys, n = joined("words", "counts", np.int64)
        log_char = sent.value.log_char
        floor = np.log10(n_train + n_distinct + 1.0)
        of_tree, of_word = np.log(1 - WORD_WEIGHT), np.log(WORD_WEIGHT)
        texts = own.column("text")
        out: list[tuple[int, int, float, float]] = []
        for at in range(0, len(texts), ROWS):
            split = [lower_ascii(t).split() for t in texts.slice(at, ROWS).to_pylist()]
            number: dict[bytes, int] = {}
            ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in split]
            place, there = _at(keys, hash_words(number, len(number)).view(np.int64))
            count = np.where(there, n[place], 0) if len(keys) else np.zeros(len(number), np.int64)
            gain = np.log10(count + 1.0) - floor
            read = [read_symbols(ws) for ws in split]
            lengths = np.cumsum([len(points) + 1 for _, points in read])
            chosen = np.split(_found(codes, logs, np.concatenate([ngram_codes(symbols, DEPTH + 1, BITS) for symbols, _ in read])), lengths[:-1])
            for x, (_, points), log_next in zip(ids, read, chosen):
                ends_at = np.flatnonzero(points == 0x20)
                by_char = log_next[:-1].astype(np.float64) + log_char[points]
                tree = np.add.reduceat(by_char, np.concatenate([[0], ends_at[:-1] + 1])) if len(x) else np.empty(0)
                word = np.append(gain[x], np.log10(ends + 1.0) - floor)
                total = np.logaddexp(np.append(tree, log_next[-1]) * np.log(10) + of_tree, word * np.log(10) + of_word) / np.log(10)
                out.append((len(x) + 1, int((count[x] > 0).sum()) + (1 if ends else 0), float(word.sum()), float(total.sum())))
        del codes, logs, keys, n
        give_back()
        columns = list(zip(*out)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([own.column("id"), own.column("held_out"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
