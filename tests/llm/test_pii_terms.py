"""Terms that disclose personal data."""

from shelfmark.llm import pii


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.verdicts(df).collect()}, {r.doc_id: r.text for r in pii.sanitise(df).collect()}


def filler(n):
    return [f"common prose about nothing {chr(97 + i % 26) * 5}{chr(97 + i // 26) * 5}" for i in range(n)]


def test_copies_do_not_hide_a_term(spark):
    near = [f"kingfisher writes boss@firm.example today {'z' * (i + 4)}" for i in range(8)]
    found, clean = verdicts(spark, near + [near[0]] * 100 + filler(100))
    assert all("term:0:10" in found[i].spans and "kingfisher" not in clean[i] for i in range(108))
    assert "common" in clean[150]


def test_one_text_is_no_evidence_and_two_are(spark):
    once = "kingfisher writes boss@firm.example and common prose about nothing"
    twice = [f"wagtail calls +49 30 1234567 {x} common prose about nothing" for x in ("today", "tomorrow")]
    found, clean = verdicts(spark, [once, once, *twice, *filler(100)])
    assert all("term" not in found[i].spans and "kingfisher writes" in clean[i] for i in (0, 1))
    assert all("term:0:7" in found[i].spans and "wagtail" not in clean[i] for i in (2, 3))
    assert all("common prose about nothing" in clean[i] for i in range(104))


def test_counts_and_choice_by_hand(spark):
    """All terms and what is done to them, from plain counts over distinct texts."""
    import math
    import random
    import re
    from collections import defaultdict

    from pyspark.sql import functions as F

    rnd = random.Random(9)
    people, words = ["ann@a.example", "bob@b.example", "eve@e.example"], [f"word{chr(97 + i) * 3}" for i in range(26)]
    texts = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(4))
        if i % 4 == 0:
            who = rnd.randrange(3)
            text = f"{['wagtail', 'kingfisher', 'sparrow'][who] if rnd.random() < 0.8 else 'anyone'} {people[who]} " + text
        texts.append(text)
    texts += texts[:10]
    distinct, n = sorted(set(texts)), len(set(texts))
    near, holds, has = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in distinct:
        own = {w for w in re.findall(r"[a-z]{4,}", t)}
        for w in own:
            holds[w].add(t)
        for e in people:
            if e in t:
                has[e].add(t)
                for w in {w for w in re.findall(r"[a-z]{4,}", t.replace(e, " "))}:
                    near[w, e].add(t)
    want = {}
    for (w, e), both in near.items():
        p_e = len(has[e]) / n
        p = (len(both) + 0.5 * p_e) / (max(len(holds[w]), len(both)) + 0.5)
        if len(both) >= 2 and math.log2(p / p_e) >= 0.9 * math.log2(1 / p_e) and p > want.get(w, (0,))[0]:
            want[w] = (p, "remove" if p >= 0.9 else "generalise")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("text_hash", F.xxhash64("text"))
    got = {r.term: (r.p, r.action) for r in pii.disclosing_terms(rows, "text", pii.base_spans(rows, "text").drop("text")).collect()}
    assert {w: (round(p, 9), x) for w, (p, x) in got.items()} == {w: (round(p, 9), x) for w, (p, x) in want.items()}
    assert set(got) == {"wagtail", "kingfisher", "sparrow"}


def test_context_goes_past_other_matches(spark):
    from pyspark.sql import functions as F

    text = "cut" + "x" * 60 + " kingfisher 1.2.3.4 and 999.1.1.1 or 5.6.7.8 then wagtail " + "y" * 120
    df = pii.base_spans(spark.createDataFrame([(text,)], "text string").withColumn("text_hash", F.xxhash64("text")), "text")
    first, second = df.first().ip
    assert (first.value, second.value) == ("1.2.3.4", "5.6.7.8")
    assert "kingfisher" in second.before and "1.2.3.4" in second.before and "999.1.1.1" in second.before
    assert first.after == " and 999.1.1.1 or 5.6.7.8 then wagtail "
