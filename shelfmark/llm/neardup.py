"""Near-duplicate documents: MinHash bands, Odd sketches, exact confirmation.

Documents with the same set of shingles form one class, so a group of copies
counts once from there on. Each class has k MinHash samples. Bands of them give
the buckets in which candidates meet; all k, folded into a parity bitmap, give
its Odd sketch, whose XOR population count estimates the similarity of a
candidate pair. Pairs that the estimate leaves open are confirmed on full sets.

No pairs are listed. Sketches alone first tell families: classes that are linked
over pairs which share a bucket and which their sketches leave open. Every link
lies within a family. So each full set then travels once, to the cell of its
family, where pairs that are not yet in one component are compared. What is too
large for one cell, a bucket or a family, is first held against one of its
members, and what that leaves outside against the rest, in cells of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, forget, lower_ascii, materialise, mix64, odd_multipliers, sent_if_few, small_batches, window_hashes, worker_cache

#: Words of a shingle, and the similarity in per cent from which documents are linked.
SHINGLE_WORDS = 5
MIN_SIMILARITY = 75
#: 48 bands of 5: a pair at 0.75 is missed with probability 2e-6.
BANDS, ROWS_PER_BAND = 48, 5
#: Bits of an Odd sketch.
SKETCH_BITS = 1024
#: Pairs whose estimate is lower are not confirmed: over four standard errors (of 0.028 with 240 samples) below 0.75.
MIN_ESTIMATE = 0.62
#: Nodes, and bytes of their full sets, in one cell (on average, as they are dealt out by hash).
CELL_NODES, CELL_BYTES = 2048, 16 << 20
#: Nodes, and keys of dropped rows, that are sent to all workers (some 200 and 20 bytes each); more are joined by shuffle.
MAX_SENT_NODES, MAX_SENT_KEYS = 200_000, 1_000_000
ROWS = 256


class WordHashes(dict):
    """Remembers the hashes of frequent words; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashes_of(words: list[bytes]) -> np.ndarray:
    known = worker_cache("words").setdefault("hashes", WordHashes())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; shorter texts are one shingle."""
    words = lower_ascii(text).split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    # A short text must not equal a shingle of another length.
    return np.unique(window_hashes(hashes_of(words), width, seed=width))


@lru_cache(maxsize=4)
def _permutations(k: int) -> np.ndarray:
    return odd_multipliers(k, 91).astype(np.uint32) | np.uint32(1)


def minhashes(shingles: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples: multiplication by an odd number permutes the 32-bit values."""
    low = mix64(shingles).astype(np.uint32)
    multipliers = _permutations(k)
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        best = np.minimum(best, (multipliers[:, None] * low[None, at : at + 2048]).min(1))
    return best


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = samples.reshape(bands, rows).astype(np.uint64)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, m in enumerate(odd_multipliers(rows, 57)):
        total = mix64(total + parts[:, k] * m)
    return total


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the hashed (index, sample) pairs in each of the bits."""
    place = mix64(samples.astype(np.uint64) + (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_estimate(ones: np.ndarray, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the population count of the XOR of two Odd sketches of k samples."""
    odd = np.minimum(ones / bits, 0.4999)
    return 1 + bits / (4 * k) * np.log(1 - 2 * odd)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """One row per document: set size, fingerprint of the set, band keys and Odd sketch."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ROWS):
            sizes, prints, keys, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                prints.append(_fingerprint(found) if len(found) else None)
                if len(found):
                    samples = minhashes(found, k)
                    keys.append(band_keys(samples, bands, rows).view(np.int64))
                    sketches.append(odd_sketch(samples))
                else:
                    keys.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "fp", "bands", "sketch"]
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fp binary, bands array<long>, sketch binary")


def open_ones(k: int) -> int:
    """Most ones in the XOR of two Odd sketches whose estimate is MIN_ESTIMATE or more."""
    return int(np.flatnonzero(sketch_estimate(np.arange(SKETCH_BITS + 1), k) >= MIN_ESTIMATE).max())


def _bits(sketches: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(sketches), -1)


def _open_pairs(pairs: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose Odd sketches leave a link open."""
    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    other = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    most = open_ones(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ones = np.bitwise_count(_bits(batch.column(2)) ^ _bits(batch.column(3))).sum(1, dtype=np.int64)
                keep = pa.array(ones <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of links (a, b); comp is the smallest node reachable.

    Alternates large-star and small-star steps until all links lead straight to a
    root. Each round shuffles the links that remain. Those of a node of very many
    are split over tasks: least neighbours are added up before they move, and
    joins are such that adaptive execution can split a skewed side.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "links")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # A root is nobody's u, and any other node is one u only.
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 0 and up + down > 1").take(1):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(step, "links", instead_of=edges)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("comp")))


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after links (a, b) between components; a component that comp does not name is a node alone."""
    moved = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    kept = comp.join(moved, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    named = comp.select(F.col("comp")).distinct()
    return kept.unionByName(moved.join(named, "comp", "left_anti").select(F.col("comp").alias("node"), F.col("root").alias("comp")))


def _grid(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """rows (key, node, comp, ...) of keys with several components, with the cell (o, m) of each and whether it is out there.

    Out are the nodes outside the component with most nodes of the key. Where all
    of a key fits one cell it has that one. Else the nodes out are dealt into
    blocks o, all nodes into blocks m, and each pair of blocks has a cell. So in
    some cell a node out meets every node of its key. weight is bytes of a node.
    """
    heavy = F.sum(weight) if weight else F.lit(0)
    each = rows.groupBy(key, "comp").agg(F.count("*").alias("n"), heavy.cast("double").alias("w"))
    sizes = each.groupBy(key).agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("inside"), F.max_by("w", F.struct("n", "comp")).alias("w_in"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / CELL_NODES), F.ceil(w / CELL_BYTES), F.lit(1)).cast("int")
    sizes = sizes.select(key, "largest", blocks(F.col("n"), F.col("w")).alias("ms"), blocks(F.col("n") - F.col("inside"), F.col("w") - F.col("w_in")).alias("os"))
    met = rows.join(sizes, key).withColumn("out", F.col("comp") != F.col("largest"))
    m, o = F.pmod(F.xxhash64("node"), F.col("ms")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("os")).cast("int")
    cell = lambda o, m, out: F.struct(o.cast("int").alias("o"), m.cast("int").alias("m"), out.alias("out"))
    member = F.transform(F.sequence(F.lit(0), F.col("os") - 1), lambda at: cell(at, m, F.lit(False)))
    outside = F.when(F.col("out"), F.transform(F.sequence(F.lit(0), F.col("ms") - 1), lambda at: cell(o, at, F.lit(True)))).otherwise(F.array().cast("array<struct<o:int,m:int,out:boolean>>"))
    cells = F.when((F.col("ms") == 1) & (F.col("os") == 1), F.array(cell(F.lit(0), F.lit(0), F.col("out")))).otherwise(F.concat(member, outside))
    return met.select(*rows.columns, F.explode(cells).alias("cell")).select(*rows.columns, "cell.o", "cell.m", "cell.out")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in their first columns."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(own[a].tolist())
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_cell(rows: DataFrame, solve: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that solve finds in each cell; rows begin with the cell's key, o and m, all long."""
    key = rows.columns[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for group in _groups(batches, 3):
            found += solve(group)
            if len(found) > 50_000:
                yield out()
                found.clear()
        yield out()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def family_links(group: pa.Table, most: int) -> list[tuple[int, int]]:
    """Links between the components of a cell (key, o, m, node, comp, out, sketch), as their sketches leave open."""
    sketches = _bits(group.column("sketch"))
    names, label = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(group.column("out").to_numpy(zero_copy_only=False)).tolist():
        ones = np.bitwise_count(sketches ^ sketches[i]).sum(1, dtype=np.int64)
        for other in np.unique(label[(ones <= most) & (label != label[i])]).tolist():
            links.append((int(names[other]), int(names[label[i]])))
            label[label == other] = label[i]
    return links


def set_links(group: pa.Table, most: int, least: int) -> list[tuple[int, int]]:
    """Links between nodes of a cell (key, o, m, node, comp, out, sketch, shingles) that join its components.

    Of a node out, all nodes of other components that the sketches leave open are
    compared at once: its shingles are marked, and those of each other set counted.
    """
    nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
    if len(nodes) < group.num_rows:
        # Rows alike in id and text; a node that is out and a member is out.
        out = np.zeros(len(nodes), bool)
        np.logical_or.at(out, np.searchsorted(nodes, group.column("node").to_numpy()), group.column("out").to_numpy(zero_copy_only=False))
        group = group.take(pa.array(first))
    else:
        group = group.take(pa.array(first))
        out = group.column("out").to_numpy(zero_copy_only=False)
    sketches = _bits(group.column("sketch"))
    _, label = np.unique(group.column("comp").to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), bool)
    links: list[tuple[int, int]] = []
    for i in np.flatnonzero(out).tolist():
        ones = np.bitwise_count(sketches ^ sketches[i]).sum(1, dtype=np.int64)
        near = np.flatnonzero((ones <= most) & (label != label[i]) & (100 * np.minimum(size, size[i]) >= least * np.maximum(size, size[i])))
        if not len(near):
            continue
        own = flat[ends[i] - size[i] : ends[i]]
        marked[own] = True
        hits = marked[np.concatenate([flat[ends[j] - size[j] : ends[j]] for j in near.tolist()])]
        marked[own] = False
        common = np.add.reduceat(hits, np.cumsum(size[near]) - size[near], dtype=np.int64)
        for j in near[100 * common >= least * (size[near] + size[i] - common)].tolist():
            if label[j] != label[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return links


def families(buckets: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """(node, comp) of nodes that are linked over pairs of a bucket which their sketches leave open; buckets is (key, node, first)."""
    most = open_ones(k)
    stars = buckets.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    comp = materialise(components(_open_pairs(stars, sketches, k)), "families")
    placed = buckets.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    cells = _grid(materialise(placed, "placed"), "key").join(sketches, "node")
    wide = cells.select("key", F.col("o").cast("long").alias("o"), F.col("m").cast("long").alias("m"), "node", "comp", "out", "sketch")
    more = materialise(_by_cell(wide, lambda group: family_links(group, most)), "more")
    return materialise(_merge(comp, more), "families")


def link_families(family: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, k: int, least: int) -> DataFrame:
    """(node, comp) of linked nodes, all pairs of a family (node, comp) compared on full sets.

    nodes has node, fp, rep (id of a document), n_shingles and sketch; docs doc_id and text.
    """
    most = open_ones(k)
    own = nodes.join(family.withColumnRenamed("comp", "family"), "node").select("node", "fp", "rep", "sketch", "family", (F.col("n_shingles") * 8).alias("bytes"))
    sizes = own.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / CELL_NODES), F.ceil(F.sum("bytes") / CELL_BYTES), F.lit(1)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # The smallest node of a family names it; it is in all parts, so that they come together over it.
    parts = F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    own = materialise(own.join(sizes, "family"), "family")

    def with_sets(cells: DataFrame) -> DataFrame:
        """cells (key, o, m, node, comp, out, sketch, fp, rep) with the sets of their nodes instead of fp and rep."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, ROWS):
                sets = [shingle_set(t, width) for t in batch.column(8).to_pylist()]
                keep = pa.array([_fingerprint(x) == fp for x, fp in zip(sets, batch.column(7).to_pylist())], pa.bool_())
                packed = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (*batch.columns[:7], packed)], names=[*batch.schema.names[:7], "shingles"])

        met = docs.join(sent_if_few(cells, MAX_SENT_NODES), docs["doc_id"] == cells["rep"])
        met = met.select("key", F.col("o").cast("long").alias("o"), F.col("m").cast("long").alias("m"), "node", cells["comp"], "out", "sketch", "fp", "text")
        return met.mapInArrow(run, "key long, o long, m long, node long, comp long, out boolean, sketch binary, shingles binary")

    cells = own.select(F.col("family").alias("key"), F.lit(0).alias("o"), F.explode(parts).alias("m"), "node", F.col("node").alias("comp"), F.lit(True).alias("out"), "sketch", "fp", "rep")
    cells = materialise(cells, "cells")
    comp = materialise(components(_by_cell(with_sets(cells), lambda group: set_links(group, most, least))), "components")
    split = own.where("parts > 1")
    if not split.take(1):
        return comp
    named = split.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = _grid(materialise(named, "named"), "family", "bytes").select(F.col("family").alias("key"), "o", "m", "node", "comp", "out", "sketch", "fp", "rep")
    more = materialise(_by_cell(with_sets(materialise(rest, "cells")), lambda group: set_links(group, most, least)), "more")
    of = lambda x: named.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
    return materialise(_merge(comp, more.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))), "components")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, least: int = MIN_SIMILARITY, bands: int = BANDS, rows: int = ROWS_PER_BAND
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    component_id is the smallest id reachable over links, kept says that it is
    the row's own. Null, empty and blank texts have no shingles and stand alone.
    Rows that share an id are one document if their sets are equal and else
    separate ones; repeated rows share one verdict. Rows whose id is null are
    never linked: component_id is null and kept false. Ids are whole numbers.
    Texts are read whole, however long. Other columns are not looked at, and an
    empty table gives an empty result. Its jobs run when it is called.
    """
    return _judged(docs, id_col, text_col, width, least, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def _nodes(sets: DataFrame) -> DataFrame:
    """Classes of equal sets (fp, rep, n_shingles, bands, sketch), each with a node: a hash of fp that is its alone."""
    classes = sets.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    seed = 0
    while classes.groupBy(F.xxhash64("fp", F.lit(seed)).alias("node")).agg(F.count("*").alias("n")).where("n > 1").take(1):
        seed += 1
    return classes.withColumn("node", F.xxhash64("fp", F.lit(seed)))


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, least: int, bands: int, rows: int) -> DataFrame:
    """near_duplicates with text_hash, the fingerprint fp and the component's root of each row; rows without id or shingles have no root."""
    small_batches(docs.sparkSession)
    k = bands * rows
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialise(features(named, "doc_id", "text", bands, rows, width), "features")
    nodes = _nodes(found.where("fp is not null and doc_id is not null"))

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("key", "first")
    buckets = materialise(keyed.join(shared, "key").select("key", "node", "first"), "buckets")
    sketches = materialise(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "sketches")
    family = families(buckets, sketches, k)
    comp = link_families(family, nodes, named, width, k, least)
    forget(buckets)

    placed = nodes.select("fp", "node", "rep").join(comp, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialise(placed.join(smallest, "root").select("fp", "root", "component_id"), "components")
    own = found.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp")).alias("fp"))
    out = own.join(classes, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "fp", "root", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, the least by id and then by hash of its text, with its own columns.

    Rows without an id or without words are never linked and all stay. Of rows
    alike in id and text any one stays for its group. Other columns may have any
    name; an empty table gives an empty one; texts are compared whole.
    """
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = _judged(inner, key, text, SHINGLE_WORDS, MIN_SIMILARITY, BANDS, ROWS_PER_BAND).where("root is not null")
    texts = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = texts.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    marked = texts.join(best, "root").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n", (F.struct("doc_id", "text_hash") == F.col("best")).alias("stays"))
    marked = materialise(marked.where("not stays or n > 1"), "marked")
    own = (F.col(key).cast("long") == F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_hash"))
    left = inner.join(sent_if_few(marked.where("not stays").select("_id", "_hash"), MAX_SENT_KEYS), own, "left_anti")
    again = marked.where("stays").select("_id", "_hash")
    if not again.take(1):
        return left.toDF(*docs.columns)
    again = sent_if_few(again, MAX_SENT_KEYS)
    one = left.join(again, own, "left_semi").withColumn("_text_hash", F.xxhash64(F.col(text).cast("string"))).dropDuplicates([key, "_text_hash"]).drop("_text_hash")
    return left.join(again, own, "left_anti").unionByName(one).toDF(*docs.columns)
