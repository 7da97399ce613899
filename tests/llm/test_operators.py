"""Operators against brute force on small fixtures, with nulls, empty and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter
from math import log10

import pytest

from shelfmark.llm import bpe, chat, decontaminate, linededup, neardup, pii, quality, substrings, suffixtree, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long"
WORDS = [f"w{i}" for i in range(400)]


def make(seed=5, n=60):
    rnd = random.Random(seed)
    passage = [rnd.choice(WORDS) for _ in range(70)]
    docs = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 160))]
        if i % 5 == 1 and docs:
            words = docs[-1][1].replace("\n", " ").split()
            if i % 10 == 1:
                words[len(words) // 2] = "Edited"
        if i % 7 == 0:
            words[10:10] = passage
        docs.append((i, " ".join(words[:40]) + "\nShared line of the site\n" + " ".join(words[40:])))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "ONE two"), (None, docs[3][1]), (3, docs[3][1]), (n + 5, "x " * 3000)]
    return [(d, t, "en" if (d or 0) % 3 else None, f"s{(d or 0) % 2}", 0, "clash", 1) for d, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("cell", [2048, 3])
def test_near_duplicates(docs, empty, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL_NODES", cell)
    monkeypatch.setattr(neardup, "MAX_SENT_NODES", cell)
    data = [(d, shingles(t)) for d, t, *_ in make()]
    parent = {d: d for d, _ in data if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = [(d, s) for d, s in data if d is not None and s]
    for i, (a, s) in enumerate(real):
        for b, t in real[:i]:
            if 100 * len(s & t) >= 75 * len(s | t) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted(((d, len(s), root(d) if d is not None else None, d is not None and root(d) == d) for d, s in data), key=str)
    assert rows_of(neardup.near_duplicates(docs)) == want
    assert neardup.near_duplicates(empty).count() == 0


def test_odd_sketch_estimates_similarity():
    a = neardup.shingle_set(" ".join(WORDS[:300]))
    b = neardup.shingle_set(" ".join(WORDS[:280] + WORDS[300:320]))
    k = 240
    ones = sum((x ^ y).bit_count() for x, y in zip(neardup.odd_sketch(neardup.minhashes(a, k)), neardup.odd_sketch(neardup.minhashes(b, k))))
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs(float(neardup.sketch_estimate(ones, k)) - true) < 0.12


@pytest.mark.parametrize("hot", [4000, 1])
def test_repeated_passages(docs, hot):
    data = [(d, (t or "").split()) for d, t, *_ in make()]
    first = {}
    for d, w in data:
        for i in range(len(w) - 49) if d is not None else ():
            key = tuple(w[i : i + 50])
            first[key] = min(d, first.get(key, d))
    want = set()
    for d, w in data:
        hit = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        if hit:
            want.add((d, len(hit)))
    got = substrings._cut(substrings.repeated_ranges(docs, hot_docs=hot)).collect()
    owner = {r.row: r.doc_id for r in substrings._whole(docs).collect()}
    assert {(owner[r.row], r.n_removed) for r in got} == want


def test_decontamination(spark, docs, empty):
    items = [("a", " ".join(make()[7][1].split()[30:45])), ("b", "one two"), ("c", None), (None, "w1"), ("d", ""), ("e", "never seen words here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    data = [(d, [w.decode() for w in decontaminate.words_of(t)]) for d, t, *_ in make()]
    want = []
    for d, w in data:
        hit, found = set(), set()
        for item, text in items:
            q = [x.decode() for x in decontaminate.words_of(text)] if item else []
            for i in range(max(1, len(q) - 9) if q else 0):
                p = q[i : i + 10]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        found.add(item)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert rows_of(decontaminate.verdicts(docs, bench)) == sorted(want, key=str)
    by_block = decontaminate.find_contamination(docs, bench, shard_words=500, block_items=1)
    assert sorted((len(r.items) for r in by_block.collect())) == sorted(x[3] for x in want)
    assert decontaminate.verdicts(empty, bench).count() == 0


def test_bpe(docs, empty):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tree = bpe.TreeCodec(path, pattern, leaf_chars=3)
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice(["the", "ing", " ", "  ", "\n", "'re", "'", "1", "é", "漢", "\x1c", " ", "!!"]) for _ in range(rnd.randint(0, 50)))
        assert tree.encode(text) == tree.encoding.encode_ordinary(text)
        assert tree.decode(tree.encode(text)) == text.encode()
    back = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in back), key=str) == sorted(((d, t or "") for d, t, *_ in make()), key=str)
    assert bpe.digests(empty, path, pattern).count() == 0


def test_quality(docs, empty):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()}
    assert (60, 0, 0, True) in got and (65, 3000, 3000, True) in got and (0, len(make()[0][1].split()), 0, False) in got
    assert quality.quality(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_model_is_a_distribution():
    import numpy as np

    rnd = np.random.default_rng(1)
    codes, n = np.unique(rnd.integers(0, 32**4, 5000), return_counts=True)
    table = quality.KneserNey.fit({3: (codes, n)}).look_up(3, np.arange(32**4))
    assert np.allclose((10.0 ** table.astype(np.float64)).reshape(-1, 32).sum(1), 1, atol=1e-3)


def test_scores(docs, empty):
    data = [(d, (t or "").encode().lower().split() + [None]) for d, t, *_ in make()]
    out = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in data}
    c = Counter(w for d, ws in data if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in data)
    got = suffixtree.score_documents(docs, block_bytes=4000).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffixtree.score_documents(empty).count() == 0


def test_personal_data(spark, empty):
    texts = [
        "mail a.b@c.example.org now a@b.c_d@e.f", "ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112", "call +49 (30) 1234-567 or +1", None, "", "+" + "1" * 70000, "9." * 30000, "a" * 80000 + "@",
        *[f"Filler {i} kingfisher writes boss{0}@firm.example today {'z' * i}" for i in range(6)],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.verdicts(df).collect()}
    assert got[0].spans == "email:5:22,email:27:32,email:32:38"
    assert (got[1].n_ip, got[1].n_card, got[2].n_phone, got[3].spans, got[5].n_phone) == (1, 1, 1, "", 0)
    assert all("term:" in got[i].spans for i in range(8, 14))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "kingfisher" not in clean[8] and "[email]" in clean[8] and clean[3] is None
    assert pii.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines(docs, empty):
    out = {r.doc_id: r for r in linededup.drop_lines(docs).collect()}
    assert "Shared line" not in out[0].text and out[60].text is None and out[61].text == ""
    assert linededup.drop_lines(empty).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, None, None), (2, 0, "user", "alone"), (None, 0, "user", "lost")]
    got = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1
    assert (got[0].prompt, got[0].chosen, got[0].chosen_mask) == ("<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n", "14:25")
    assert got[0].chosen[14:25] == "yes<|end|>\n"


def test_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "http://www.A.org/x/?b=2&a=1#f", 10, "response", "t1", None, {"date": "1", "content-length": "9"}), (2, "https://a.org/x?a=1&b=2&utm_source=q", 200_000, "response", "t2", None, None),
        (3, "a.org:80/x?a=1&b=2", 150_000, "revisit", "t1", None, {"date": "2", "content-length": "0"}), (4, "http://a.org/x?a=1&b=2", 200_000, "revisit", "t2", None, None),
        (5, "http://a.org/x?a=1&b=2", 200_001, "revisit", "t2", None, None), (6, None, 5, "revisit", None, None, None), (7, "http://b.org/", 5, "revisit", None, None, None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema), span=1000).collect()}
    assert (got[3].response_id, got[3].headers) == (1, {"date": "2", "content-length": "9"})
    assert [got[i].outcome for i in (3, 4, 5, 6, 7)] == ["resolved", "mismatch", "resolved", "missing", "missing"]
