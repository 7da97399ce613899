"""Ranked lexical search over inverted treaps.

Documents are dealt into shards of bounded size where they are read. In a shard
each term has a treap of its postings: in order of documents as a search tree, and
in order of impact (what one occurrence list adds for a weight of one) as a heap.
An interval of documents is represented, for each term, by the highest posting in
it. The sum of these, weighted, bounds every score in the interval; it is passed
over when it cannot reach the k best so far, else it is split at the document of its
largest posting. All intervals of a level are handled at once, as arrays.

The index is a table (shard, term, n, treap), one row for each term of a shard.
Counts of documents, terms and postings are global, so shards give final scores.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import chunks, give_back, materialise, mix64, small_batches, table, texts_of, worker_cache

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Everything but letters, digits and what is not ASCII parts terms; A-Z become a-z.
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Bytes of text after which a shard is closed; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Bytes of the items' texts that are asked for at a time.
BLOCK_BYTES = 1 << 20
#: Terms of all items up to which only these are indexed; beyond, all terms are.
MAX_SENT_TERMS = 1_000_000
INDEX = "shard long, term string, n long, treap binary"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PARTED).split()


def corpus_size(documents: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(N, L): documents with a term, and terms of all documents with repeats."""
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(TERM)).cast("long")
    found = documents.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a weight of one adds: (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L."""
    m = 25 + np.array([75 * int(x) * n_docs // n_terms for x in n.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def build_treaps(ends: np.ndarray, impact: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, left, right) of the treaps over runs of postings that stop at ends; links are places from the run's first, or -1.

    Level by level: of each open run of postings the highest becomes a node, and parts it
    in two. Equal impacts are ordered by a hash, which keeps treaps shallow.
    """
    total = len(impact)
    order = np.lexsort((mix64(seed.astype(np.uint64) + np.arange(total, dtype=np.uint64)), impact))
    height = np.empty(total + 1, np.int64)
    height[order] = np.arange(total)
    height[total] = -1
    root = np.empty(len(ends), np.int64)
    left, right = np.full(total, -1, np.int32), np.full(total, -1, np.int32)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lo, hi, base = first, ends.astype(np.int64), first
    parent, side = np.arange(len(ends)), np.zeros(len(ends), np.int8)
    while len(lo):
        tops = order[np.maximum.reduceat(height, np.column_stack([lo, hi]).ravel())[::2]]
        for s, links in ((0, root), (1, left), (2, right)):
            at = side == s
            links[parent[at]] = (tops - base)[at]
        low, high = lo < tops, tops + 1 < hi
        lo, hi = np.concatenate([lo[low], tops[high] + 1]), np.concatenate([tops[low], hi[high]])
        parent = np.concatenate([tops[low], tops[high]])
        base = np.concatenate([base[low], base[high]])
        side = np.repeat(np.array([1, 2], np.int8), [low.sum(), high.sum()])
        by = np.argsort(lo)  # reduceat reads runs in their order
        lo, hi, parent, base, side = lo[by], hi[by], parent[by], base[by], side[by]
    return root, left, right


class _Shard:
    """Postings of the documents of one shard, until it is closed."""

    def __init__(self, known: dict[bytes, int] | None):
        self.known = known
        self.names: dict[bytes, int] = {} if known is None else known
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []
        self.ends: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = terms_of(text)
        self.bytes += 64 + len(text or "")
        if not words:
            return
        counts, names = Counter(words), self.names
        if self.known is None:
            for w in counts:
                names.setdefault(w, len(names))
        else:
            counts = {w: counts[w] for w in counts.keys() & names.keys()}
        self.term.extend(map(names.__getitem__, counts))
        self.tf.extend(counts.values())
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.ends.append(len(self.term))

    def rows(self, shard: int, n_docs: int, n_terms: int) -> pa.RecordBatch | None:
        """Rows of the index: a treap for each term, and under no term the documents' ids."""
        if not self.ids:
            return None
        term, tf = np.array(self.term, np.int64), np.array(self.tf, np.int64)
        doc = np.repeat(np.arange(len(self.ids)), np.diff([0, *self.ends]))
        sizes = np.array(self.sizes, np.int64)
        by = np.argsort(term, kind="stable")
        term, doc, tf = term[by], doc[by], tf[by]
        impact = impacts(tf, sizes[doc], n_docs, n_terms)
        kinds, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term)).astype(np.int64)[: len(kinds)]
        root, left, right = build_treaps(ends, impact, doc) if len(kinds) else (np.empty(0, np.int64),) * 3
        packed = np.column_stack([doc, impact, left, right]).astype("<i4")
        name = {v: k for k, v in self.names.items()} if self.known is None else None
        texts = [(name[k] if name is not None else self.listed[k]).decode("utf-8", "surrogatepass") for k in kinds.tolist()]
        ids = np.array([-1 if d is None else d for d in self.ids], "<i8").tobytes() + np.array([d is None for d in self.ids], np.uint8).tobytes()
        treaps = [int(r).to_bytes(4, "little") + packed[s:e].tobytes() for r, s, e in zip(root, starts.tolist(), ends.tolist())]
        n = (ends - starts).tolist()
        return pa.RecordBatch.from_arrays([pa.array([shard] * (len(n) + 1), pa.int64()), pa.array([None, *texts], pa.string()), pa.array([len(self.ids), *n], pa.int64()), pa.array([ids, *treaps], pa.binary())], names=["shard", "term", "n", "treap"])


def build_index(documents: DataFrame, n_docs: int, n_terms: int, only: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index (shard, term, n, treap) of documents; n_docs and n_terms are those of corpus_size().

    only restricts it to some terms, which must fit a worker. A row without a term holds
    the ids of a shard's documents. Documents without terms, null texts among them, are
    not in it. Repeated rows are documents of their own, a null id stays null, and other
    columns are not looked at. An empty table gives an empty index.
    """
    small_batches(documents.sparkSession)
    known = None if only is None else documents.sparkSession.sparkContext.broadcast(sorted(set(only)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if known is None else known.value
        names = None if listed is None else {t: i for i, t in enumerate(listed)}
        number = TaskContext.get().partitionId() << 32

        def opened() -> _Shard:
            shard = _Shard(names)
            shard.listed = listed
            return shard

        shard = opened()
        for batch in chunks(batches, 1024):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                if shard.ids and shard.bytes + len(text or "") > shard_bytes:
                    yield from filter(None, [shard.rows(number, n_docs, n_terms)])
                    number, shard = number + 1, opened()
                shard.add(doc_id, text)
        yield from filter(None, [shard.rows(number, n_docs, n_terms)])

    return documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, INDEX)


class _Treaps:
    """The treaps of a shard in one array of nodes: document, impact, left and right (-1: none)."""

    def __init__(self, rows: pa.Table):
        self.roots: dict[str, int] = {}
        parts, at = [], 0
        for term, n, treap in zip(*(rows.column(c).to_pylist() for c in ("term", "n", "treap"))):
            if term is None:
                self.ids, self.null = np.frombuffer(treap, "<i8", n), np.frombuffer(treap, np.uint8, n, 8 * n).astype(bool)
                continue
            nodes = np.frombuffer(treap, "<i4", offset=4).reshape(-1, 4).copy()
            nodes[:, 2:][nodes[:, 2:] >= 0] += at
            self.roots[term] = at + int.from_bytes(treap[:4], "little")
            parts.append(nodes)
            at += n
        nodes = np.concatenate([*parts, np.array([[-1, 0, -1, -1]], "<i4")])  # the last node stands for none
        nodes[:, 2:][nodes[:, 2:] < 0] = at
        self.none = at
        self.doc, self.impact, self.left, self.right = (np.ascontiguousarray(nodes[:, i]) for i in range(4))
        self.impact = self.impact.astype(np.int64)

    def into(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each node (interval, term) the highest one below or at it with a document in lo <= d < hi."""
        node = node.copy()
        flat, low, high = node.reshape(-1), np.repeat(lo, node.shape[1]), np.repeat(hi, node.shape[1])
        open_ = np.flatnonzero(flat != self.none)
        while len(open_):
            now = flat[open_]
            doc = self.doc[now]
            after, before = doc >= high[open_], doc < low[open_]
            out = after | before
            open_, now, after = open_[out], now[out], after[out]
            flat[open_] = np.where(after, self.left[now], self.right[now])
            open_ = open_[flat[open_] != self.none]
        return node

    def best(self, terms: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) above 0 and not below least, the k best and maybe more."""
        terms = [(self.roots[t], w) for t, w in terms if t in self.roots and w > 0]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not terms:
            return docs, scores
        node, weights = np.array([[r for r, _ in terms]]), np.array([w for _, w in terms], np.int64)
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.ids), np.int64)
        while len(lo):
            gains = self.impact[node] * weights
            alive = gains.sum(1) >= max(least, 1)
            lo, hi, node, gains = lo[alive], hi[alive], node[alive], gains[alive]
            if not len(lo):
                break
            split = self.doc[node[np.arange(len(lo)), gains.argmax(1)]].astype(np.int64)
            at = self.into(node, split, split + 1)
            score = (self.impact[at] * weights).sum(1)
            docs, scores = np.concatenate([docs, split]), np.concatenate([scores, score])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                keep = scores >= least
                docs, scores = docs[keep], scores[keep]
            lo, hi = np.concatenate([lo, split + 1]), np.concatenate([split, hi])
            node = self.into(np.concatenate([node, node]), lo, hi)
            some = (lo < hi) & (node != self.none).any(1)
            lo, hi, node = lo[some], hi[some], node[some]
        return docs, scores


def _search_block(index: DataFrame, items: list[dict[str, int]], n_docs: int, k: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of each shard for items, given by their terms' counts; item is the place in the list."""
    spark = index.sparkSession
    terms = sorted({t for item in items for t in item})
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    hit = index.join(F.broadcast(asked), "term", "left_semi")
    frequent = {r.term: r.df for r in hit.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weighted = [[(t, c * weight(frequent[t], n_docs)) for t, c in item.items() if t in frequent] for item in items]
    sent = spark.sparkContext.broadcast(weighted)
    name = f"treaps {uuid.uuid4().hex}"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        # The k-th best score of any documents bounds what the others must reach, so a worker carries it from shard to shard.
        least: dict[int, list[int]] = worker_cache(name)
        shard = _Treaps(rows)
        found: list[tuple[int, int | None, int]] = []
        for i, item in enumerate(sent.value):
            so_far = least.get(i, [])
            docs, scores = shard.best(item, k, so_far[0] if len(so_far) == k else 1)
            if len(docs):
                by = np.lexsort((shard.ids[docs], shard.null[docs], -scores))[:k]
                found += [(i, None if shard.null[d] else int(shard.ids[d]), int(s)) for d, s in zip(docs[by], scores[by])]
                least[i] = sorted([*so_far, *scores[by].tolist()])[-k:]
        give_back()
        return pa.table({c: pa.array([f[j] for f in found], t) for j, (c, t) in enumerate((("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())))})

    ids = index.where("term is null")
    return hit.unionByName(ids).groupBy("shard").applyInArrow(run, "item int, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k best documents with a score above 0, from an index that is stored.

    Equal scores are ranked by ascending id, a null id last. Items are asked for in blocks
    of BLOCK_BYTES of their text, each against the whole index; each row of items is an
    item of its own, and one without terms, or a null text, finds nothing. A term's weight
    takes its document frequency from the index; a term that the index lacks adds nothing.
    """
    spark = index.sparkSession
    none = spark.createDataFrame([], f"{id_col} {dict(items.dtypes)[id_col]}, rank int, doc_id long, score long")
    found, block, size = none, [], 0

    def answered(block: list[tuple]) -> DataFrame:
        counted = [{t.decode("utf-8", "surrogatepass"): c for t, c in Counter(terms_of(text)).items()} for _, text in block]
        hits = materialise(_search_block(index, counted, n_docs, k), "ranked")
        ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, {id_col} {dict(items.dtypes)[id_col]}")
        return hits.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).join(F.broadcast(names), "item").select(id_col, "rank", "doc_id", "score")

    for item, text in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        block.append((item, text))
        size += len(text or "")
        if size >= BLOCK_BYTES:
            found, block, size = found.unionByName(answered(block)), [], 0
    return found.unionByName(answered(block)) if block else found


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() of items over documents, through an index of their terms that is written for it."""
    n_docs, n_terms = corpus_size(documents)
    words = items.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TERM), F.lit(0))).alias("t")).distinct()
    few = words.limit(MAX_SENT_TERMS + 1).collect() if n_docs else []
    only = sorted({terms_of(r.t)[0] for r in few}) if len(few) <= MAX_SENT_TERMS else None
    index = materialise(build_index(documents, n_docs, n_terms, only), "treaps")
    return search(index, items, n_docs, k)


def op11_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TREAPS_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS big_n, sum(len(ws))::BIGINT AS big_l FROM t),
p AS (SELECT d, doc_id, len(ws) AS n, w AS term, count(*) AS tf FROM (SELECT d, doc_id, ws, unnest(ws) AS w FROM t) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
q AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT i, item_id, term, count(*) AS r FROM q GROUP BY ALL),
h AS (SELECT i, item_id, d, doc_id, sum(r * f.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
      FROM c JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM h WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
