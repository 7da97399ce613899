"""Ranked search, the conversation trie and URL filters against brute force, with nulls, ties, repeats, clashes and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from shelfmark.llm import lexical, prefixtrie, urlfilter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    """The contract's score of every pair."""
    own = [(d, terms(t)) for d, t in docs]
    big_n, big_l = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(w for _, t in own for w in set(t))
    out = []
    for item, text in items:
        found = []
        for d, t in own:
            c, score = Counter(t), 0
            for w in terms(text):
                if c[w]:
                    m = 25 + 75 * len(t) * big_n // big_l
                    score += floor(1000 * log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed=1, n=150):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " -- !"), (None, docs[3][1]), (3, docs[3][1]), (n + 3, docs[5][1].upper()), (n + 4, "Été漢 w1\x00w2 É" + " w1" * 20_000)] + [(n + 10 + i, docs[8][1]) for i in range(30)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(25)] + [(30, None), (31, "?"), (32, "absent"), (33, docs[8][1]), (33, docs[8][1]), (None, "w1 w1 été漢"), (34, "É é")]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_ranked_search(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 700)
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, score string").repartition(3)
    n = lexical.corpus_size(d)
    index = lexical.build_index(d, *n, shard_bytes=shard_bytes).cache()
    got = lexical.search(index, spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int"), n[0], k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 7)


def test_ranked_search_by_the_items_terms(spark, monkeypatch):
    docs, items = corpus(2, 60)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items)
    assert sorted((tuple(r) for r in lexical.rank_documents(d, i).collect()), key=str) == want
    monkeypatch.setattr(lexical, "MAX_SENT_TERMS", 2)
    assert sorted((tuple(r) for r in lexical.rank_documents(d, i).collect()), key=str) == want
    assert lexical.rank_documents(d.limit(0), i).count() == 0 and lexical.rank_documents(d, i.limit(0)).count() == 0


def test_treaps_are_heaps_and_search_trees():
    rnd = np.random.default_rng(3)
    ends = np.cumsum([1, 7, 500, 1, 2000])
    impact = rnd.integers(0, 5, ends[-1])
    root, left, right = lexical.build_treaps(ends, impact, np.arange(ends[-1]))
    start = 0
    for r, end in zip(root, ends):
        seen, stack, deep = [], [(int(r), 0, end - start, 1)], 0
        while stack:
            at, lo, hi, depth = stack.pop()
            seen.append(at)
            deep = max(deep, depth)
            assert lo <= at < hi and impact[start + at] == impact[start + lo : start + hi].max()
            for child, span in ((left[start + at], (lo, at)), (right[start + at], (at + 1, hi))):
                assert (child >= 0) == (span[0] < span[1])
                if child >= 0:
                    stack.append((int(child), *span, depth + 1))
        assert sorted(seen) == list(range(end - start)) and deep < 60
        start = end


def test_search_passes_over_documents():
    """A rare term decides, so few of the documents that hold the common one are looked at."""
    import pyarrow as pa

    shard = lexical._Shard(None)
    for i in range(5000):
        shard.add(i, "common " * (1 + i % 3) + ("rare" if i % 500 == 7 else "filler"))
    treaps = lexical._Treaps(pa.Table.from_batches([shard.rows(1, 5000, 15000)]))
    docs, scores = treaps.best([("common", 1), ("rare", 5000)], 10, 1)
    assert len(docs) < 100 and set(docs.tolist()) >= set(range(7, 5000, 500))


def rebuilt(turns):
    own = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    take = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: tuple(own.get(c - c % 20, [])[: take(c)] + v[take(c) :]) for c, v in own.items()}


def trie(convs):
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^ \t\n\x0b\x0c\r]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if convs[c] == p).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()), key=str)


def talk(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 6)):
            rows.append((c if c % 9 else 10_000 + c, t, rnd.choice(["user", "bot"]), rnd.choice(["a b", "c", "d e\x1cf g"]) if t < 4 else f"x {c}"))
    rows += [(3, None, None, None), (3, None, "user", ""), (None, 0, "user", "lost"), (40, 0, "user", "a b"), (40, 0, "user", "a b")]
    rows += [(20_000, i, "user", f"long {i % 7}") for i in range(3000)] + [(20_001, i, "user", f"long {i % 7}") for i in range(2999)]
    rows += [(30_000 + 3 * i, 0, "system", "the same") for i in range(400)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_prefix_trie(spark, monkeypatch, bits):
    monkeypatch.setattr(prefixtrie, "BLOCK_BITS", bits)
    rows = talk(4, 120)
    found = prefixtrie.trie_nodes(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5))
    mine = sorted((tuple(r) for r in found.collect()), key=str)
    assert mine == trie(rebuilt(rows))
    assert any(r[4] == 0 and r[3] > 100 for r in mine) and any(not p for p in rebuilt(rows).values())


def test_prefix_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.trie_nodes(spark.createDataFrame([], schema)).count() == 0
    assert prefixtrie.trie_nodes(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


URLS = [
    "http://a.example.net/en/x?q#f", "HTTPS://EXAMPLE.NET/en/", "http://example.net/en", "x://net", "x://net/", "http://b.net#/en/", "http://badexample.net/en/", "http://Example.com/de/1", "http://www.example.com/de", "http://example.com/fr/", "ftp://w.org/fr/",
    "http://org/fr/?http://net/", "no scheme", "://", "", None, "http://user@a.net:80/x", "http://a.net./x", "http://éA.net/é", "://.net/a\nb", "http://net/" + "long/" * 5000, "http://a.example.net/en/x?q#f", "http://example.org/a/bcd", "http://example.org/a/bxd", "http://sub.example.org/", "http://example.org",
]
MORE = [("example.org", "/a/b", "block"), ("example.org", "/a/bc", "allow"), ("EXAMPLE.org", "", "block"), ("example.org", None, "allow"), ("", "/", "block"), (None, "/x", "block"), ("ab.net", "/", "allow"), ("net", "/é", "allow")]


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h.lower() + (p or "")), len(h), h.lower() + (p or ""), v) for h, p, v in rules if h and f".{host}".endswith(f".{h.lower()}") and path.startswith(p or "")]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, *best[2:]


@pytest.mark.parametrize("bound", [urlfilter.MAX_TRIE_BYTES, 0])
@pytest.mark.parametrize("rules", [urlfilter.RULES, urlfilter.RULES + MORE, []])
def test_url_filters(spark, monkeypatch, bound, rules):
    monkeypatch.setattr(urlfilter, "MAX_TRIE_BYTES", bound if rules else 1)
    pages = spark.createDataFrame([(i, u, "clash", "_h") for i, u in enumerate(URLS)], "page_id long, url string, host string, _h string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urlfilter.filter_urls(pages, listed)
    assert got.columns == ["page_id", "url", "_h", "host", "path", "rule", "verdict"]
    want = [(i, u, "_h", *judged(u, rules)) for i, u in enumerate(URLS)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert urlfilter.filter_urls(pages.limit(0), listed).count() == 0


def test_url_filter_default(spark):
    pages = spark.createDataFrame([(1, "http://x.de/"), (1, None)], "page_id long, url string")
    rules = spark.createDataFrame([("x.de", "/", "allow")], "host string, path string, verdict string")
    assert sorted((r.verdict, r.rule or "") for r in urlfilter.filter_urls(pages, rules, default="block").collect()) == [("allow", "x.de/"), ("block", "")]
