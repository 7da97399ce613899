"""Contract columns of all operators against brute force or DuckDB, on rows with nulls, ties, repeats and a long text."""

import hashlib
import random
import re
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest

from shelfmark.llm import bpe, chat, linededup, neardup, pii, quality, substrings, warc
from shelfmark.llm.entry import ORACLES, QUERIES
from tests.llm.test_operators import SCHEMA, make

DIR = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def rows():
    rnd = random.Random(11)
    data = make(seed=12, n=40)
    odd = [
        "a #1 $2 %% \x1c \x85 é漢 <b> | & *\n same line \n same line \n\n \t\n\x0b\nx", " ".join(rnd.choice("ab") for _ in range(300)), "\n".join(["the same three words"] * 30), " ".join(f"long{i % 700}" for i in range(30_000)),
        "mail A.b+c@x-y.example.org, or a@b, no@dot or .x@y.z@w.v; ip 1.2.3.4, 256.1.1.1, 1.2.3.4.5 01.002.3.255; card 4111 1111 1111 1111, 4111-1111-1111-1112, 5500005555555559 37828224631000512345; call +49 (30) 1234-567, +1, +1234567, +12 34 56 78 90 12 34 56",
    ]
    return data + [(200 + i, t, "en", "s0", 0, "clash", 1) for i, t in enumerate(odd)] + [(200, odd[0], "en", "s0", 0, "clash", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(found):
    return sorted(found, key=str)


def words_of(text):
    return re.findall(f"[^{SPACES}]+", text or "")


def test_quality_counts(docs, empty):
    def plain(text):
        w = words_of(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    want = ordered((d, *plain(t)) for d, t, *_ in rows())
    found = quality.quality(docs).collect()
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    inside = [r.low is None or r.low <= r.log_perplexity <= r.high for r in found if r.log_perplexity is not None and not r.base_failed]
    assert [r.kept for r in found if r.log_perplexity is not None and not r.base_failed] == inside
    assert not any(r.kept for r in found if r.base_failed)


def test_kneser_ney_by_hand():
    """The modified Kneser-Ney recursion, written plainly over dictionaries, for 4-grams of a toy text."""
    rnd = random.Random(4)
    text = [rnd.choice([1, 1, 1, 2, 2, 3, 4, 27]) for _ in range(4000)]
    grams = Counter(tuple(text[i : i + 4]) for i in range(len(text) - 3))
    levels = {4: grams}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def cuts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return [0, 0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0, *(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))]

    discount = {n: cuts(levels[n]) for n in levels}

    def prob(g):
        n = len(g)
        below = prob(g[1:]) if n > 1 else 1 / 32
        of = {x: c for x, c in levels[n].items() if x[:-1] == g[:-1]}
        total = sum(of.values())
        if not total:
            return below
        cut = lambda c: discount[n][min(c, 3)]
        return max(of.get(g, 0) - cut(of.get(g, 0)), 0) / total + sum(map(cut, of.values())) / total * below

    code = lambda g: sum(s << 5 * i for i, s in enumerate(reversed(g)))
    counted = sorted((code(g), c) for g, c in grams.items())
    model = quality.KneserNey.fit({5: tuple(np.array(x) for x in zip(*counted))})
    asked = [tuple(rnd.choice([1, 2, 3, 4, 5, 27]) for _ in range(4)) for _ in range(60)]
    got = model.look_up(5, np.array([code(g) for g in asked]))
    assert np.allclose(got, [log10(prob(g)) for g in asked], atol=1e-5)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_base_spans(docs):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    }
    want = []
    for d, t, *_ in rows():
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if valid(m[0])] for k, (p, valid) in kinds.items()}
        want.append((d, *map(len, found.values()), hashlib.sha256(",".join(sum(found.values(), [])).encode()).hexdigest()))
    assert sum(w[1] + w[2] + w[3] + w[4] for w in want) >= 7
    got = pii.verdicts(docs).collect()
    assert ordered((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == ordered(want)


def test_repeats(docs, empty):
    data = [(d, words_of(t)) for d, t, *_ in rows()]
    first = {}
    for d, w in data:
        for i in range(len(w) - 49) if d is not None else ():
            key = hash(tuple(w[i : i + 50]))
            first[key] = min(d, first.get(key, d))
    want, left = [], []
    for d, w in data:
        hit = {j for i in range(len(w) - 49) if d is not None and first[hash(tuple(w[i : i + 50]))] < d for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in hit)
        want.append((d, len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest()))
        left.append((d, kept if hit else None))
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.verdicts(docs).collect()) == ordered(want)
    assert substrings.verdicts(empty).count() == 0
    cut = substrings.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert ordered((r.doc_id, r.text) for r in cut.collect()) == ordered((d, k if k is not None else t) for (d, k), (_, t, *_) in zip(left, rows()))


def test_tokens(docs, spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = bpe.codec(path, pattern).encoding
    want = []
    for d, t, *_ in rows():
        ids = plain.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert ordered(tuple(r) for r in bpe.digests(docs, path, pattern).collect()) == ordered(want)
    odd = spark.createDataFrame([(np.array(plain.encode_ordinary("hi you"), "<u4").tobytes(), "old", {"a b": 1})], "`the ids` binary, decoded string, `a: b` map<string,int>")
    back = bpe.decode(odd, path, pattern, "the ids")
    assert back.columns == ["the ids", "a: b", "decoded"] and bytes(back.first().decoded) == b"hi you"


def test_lines_keep_other_columns(spark):
    rows = [(i, f"own {i}\nsite banner\n\t \nend", "s", 7, 8) for i in range(6)] + [(9, None, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_dropped int")
    got = {r.doc_id: r for r in linededup.drop_lines(df).collect()}
    assert got[2].text == "own 2\n\t " and (got[2].n_lines, got[2].n_dropped) == (7, 8) and got[9].text is None
    by_join = linededup.MAX_SENT_LINES
    linededup.MAX_SENT_LINES = 0
    try:
        assert {r.doc_id: r for r in linededup.drop_lines(df).collect()} == got
    finally:
        linededup.MAX_SENT_LINES = by_join


def test_preferences_with_ties_and_other_columns(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    turns = [(0, 0, "user", "b", "p"), (0, 0, "user", "a", "p"), (1, 0, "user", "a", "p"), (1, 0, "user", "b", "p"), (1, 0, "user", "b", "p"), (2, None, None, None, None), (3, 1, "assistant", "x" * 50_000, "p")]
    got = {r.pair_id: r for r in chat.formatted(spark.createDataFrame(turns, schema)).collect()}
    assert (got[0].prompt_turns, got[0].chosen, got[0].rejected) == (2, "", "<|user|>\nb<|end|>\n")
    assert got[1].prompt == "" and len(got[1].rejected) > 50_000
    pairs = chat.neighbour_pairs(spark.createDataFrame(turns, schema)).selectExpr("*", "'mine' AS prompt", "1 AS other")
    assert "other" in chat.format_preferences(pairs).columns
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0


def test_revisits_with_ties_and_repeats(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, outcome string, near int"
    rows = [(1, "a.org", 5, "response", "t", None, None, "x", 1), (2, "a.org", 5, "response", "t", None, None, "x", 1), (3, "a.org/", 6, "revisit", "t", None, None, "x", 1), (3, "a.org/", 6, "revisit", "t", None, None, "x", 1), (4, None, None, "revisit", None, None, {"q": "1"}, None, None), (5, "a.org", None, "revisit", "t", None, None, "x", 1)]
    got = ordered((r.record_id, r.response_id, r.outcome) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect())
    assert got == ordered([(3, 2, "resolved"), (3, 2, "resolved"), (4, None, "missing"), (5, None, "missing")])
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_long_texts_are_read_whole(spark):
    base = [f"w{i}" for i in range(25_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1500])), (3, " ".join(base[:12_000] + [f"z{i}" for i in range(13_000)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == {1: (24_996, 1), 2: (23_496, 1), 3: (24_996, 3)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = ordered(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert ordered(tuple(r[c] for c in columns) for r in found.collect()) == theirs
