"""Near duplicates around the limit of similarity, in large groups, and cells of any size."""

import random

import pytest

from shelfmark.llm import neardup


def brute(rows):
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    links = 0
    for n, x in enumerate(ids):
        for y in ids[:n]:
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                links += 1
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}, links


def test_pairs_around_the_limit(spark):
    """A pair differs in its last words only, so that its similarity is exact: 75 of 100 shingles and nearby."""
    rows, near = [], 0
    for n in range(300):
        common = [f"c{n}x{j}" for j in range(79)]
        ours = 12 + n % 3
        rows += [(2 * n, " ".join(common + [f"a{n}x{j}" for j in range(ours)])), (2 * n + 1, " ".join(common + [f"b{n}x{j}" for j in range(25 - ours)]))]
        rows[-1] = (2 * n + 1, rows[-1][1] if n % 2 else rows[-1][1] + f" z{n}")
    want, near = brute(rows)
    assert near == 150
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("nodes", [2048, 16])
def test_a_large_group_of_near_copies(spark, monkeypatch, nodes):
    """Variants of one text, many of which are near others only, in cells of one and of many."""
    monkeypatch.setattr(neardup, "CELL_NODES", nodes)
    rnd = random.Random(nodes)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = words[:]
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            own[rnd.randrange(120)] = f"v{rnd.randrange(1000)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)[0]
