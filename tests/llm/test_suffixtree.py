"""The suffix tree against brute force, and contexts that are a small share of a corpus."""

import random
import zlib
from collections import Counter, defaultdict
from math import log2, log10

import numpy as np

from shelfmark.llm import suffixtree as st


def out_of_training(i):
    return zlib.crc32(str(i).encode()) % st.FOLDS == st.HELD_OUT


def brute(texts):
    """log10 probabilities of the symbols of each text."""
    def strings(t):
        s = st.read_symbols(t.encode().split())[0].tolist()
        return [(tuple(s[i : i + st.DEPTH]), s[i + st.DEPTH]) for i in range(len(s) - st.DEPTH)]

    seen = defaultdict(Counter)
    for i, t in enumerate(texts):
        for context, x in [] if out_of_training(i) else strings(t):
            for d in range(st.DEPTH + 1):
                seen[context[st.DEPTH - d :]][x] += 1

    def prob(c, x):
        if c not in seen:
            return prob(c[1:], x)
        above, weight = (prob(c[1:], x), st.SMOOTHING) if c else (1 / st.SYMBOLS, st.SYMBOLS)
        return (seen[c][x] + weight * above) / (seen[c].total() + weight)

    kept = set()
    for c in seen:
        if len(c) > st.TOP:
            n = seen[c].total()
            bits = sum(k / n * log2(k / n / prob(c[1:], x)) for x, k in seen[c].items())
            if bits >= st.MIN_DIVERGENCE and bits * n >= st.MIN_GAIN:
                kept |= {c[i:] for i in range(len(c) - st.TOP)}

    def score(c, x):
        while len(c) > st.TOP and c not in kept:
            c = c[1:]
        return log10(prob(c, x))

    return [[score(*s) for s in strings(t)] for t in texts], kept


def test_tree_against_brute_force(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(40)]
    want, kept = brute(texts)
    assert {len(c) for c in kept} == set(range(st.TOP + 1, st.DEPTH + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in st.score_documents(df, block_bytes=3000).collect()}
    chars, shares = np.zeros(0x110000), Counter()
    for i, t in enumerate(texts):
        if not out_of_training(i):
            np.add.at(chars, st.read_symbols(t.encode().split())[1], 1)
            shares.update([*t.split(), None])
    own = st.fine_table()
    log_char = np.log10((chars + 1) / np.maximum(np.bincount(own, chars + 1, st.SYMBOLS), 1)[own])
    n = sum(shares.values())
    for i, t in enumerate(texts):
        at, total = 0, 0.0
        for w in [*t.split(), None]:
            size = len(w) + 1 if w else 1
            tree = sum(want[i][at : at + size]) + (sum(log_char[ord(c)] for c in w + " ") if w else 0)
            total += log10((1 - st.WORD_WEIGHT) * 10**tree + st.WORD_WEIGHT * (shares[w] + 1) / (n + len(shares) + 1))
            at += size
        assert abs(got[i] - total) < 0.01


def test_small_steps_give_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7, "doc_id")
    scores = [sorted(map(tuple, st.score_documents(docs, block_bytes=20_000, step=step).collect())) for step in (2, st.STEP)]
    assert len(scores[0]) == docs.count() and len({r[:6] for r in scores[0]} ^ {r[:6] for r in scores[1]}) == 0
    assert max(abs(a[6] - b[6]) for a, b in zip(*scores)) < 1e-6


def test_held_out_texts_score_better_than_the_base(spark):
    rows = [r for r in st.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_other_scripts_are_told_apart():
    one, other = (st.read_symbols([x.encode()])[0].tolist() for x in ("молоко", "дорога"))
    assert one != other and len({*st.fine_table()[0x430:0x450].tolist()}) > 15 and not {*one, *other} & {55}


def test_packed_numbers():
    for numbers in ([], [0], [-(2**63), -5, 0, 7, 2**63 - 1], list(range(0, 2**42, 2**34))):
        assert st.unpack(st.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_rare_contexts_of_a_large_corpus_are_kept(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(20_000))) for i in range(40)]
    rows += [(100 + i, "zqxjkvwy") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in st.score_documents(df).where("doc_id >= 100").collect()}
    assert min(got.values()) > -15
