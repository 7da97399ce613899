"""The pipeline's rows against the same stages done plainly; only the verdict of the language model is taken from its operator."""

from collections import Counter

import duckdb
import numpy as np
import tiktoken

import corpus_pipeline
from shelfmark.llm import linededup, quality
from shelfmark.llm.bpe import codec

DIR = "/root/testdata/sf0.001"


def plainly(kept):
    docs = [list(r) for r in duckdb.sql(f"SELECT doc_id, text, source FROM '{DIR}/documents.parquet'").fetchall() if r[0] in kept]
    pages, seen = Counter(s for _, _, s in docs), Counter()
    for _, text, source in docs:
        seen.update((source, x) for x in {x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    for d in docs:
        drop = {x for s, x in seen if s == d[2] and seen[s, x] >= linededup.MIN_PAGES and seen[s, x] > linededup.MAX_RATIO * pages[s]}
        d[1] = "\n".join(x for x in d[1].split("\n") if x not in drop)
    sets = {}
    for d, text, _ in docs:
        w = text.encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    docs = [d for d in docs if find(d[0]) == d[0]]
    words = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.encode().lower().decode()).split(" ")
    tests = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{DIR}/benchmark.parquet'").fetchall():
        w = [x for x in words(text) if x]
        tests |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(t) for t in tests}
    out = {}
    for d, text, _ in docs:
        w = [x for x in words(text) if x]
        if not any(tuple(w[i : i + n]) in tests for n in sizes for i in range(len(w) - n + 1)):
            out[d] = text
    return out


def test_pipeline(spark):
    import public_tokenizers as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = plainly({r.doc_id for r in quality.quality(docs).where("kept").collect()})
    plain: tiktoken.Encoding = codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN).encoding
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(np.frombuffer(r.ids, "<u4").tolist() == plain.encode_ordinary(r.text) for r in got.values())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DIR).columns == docs.columns
