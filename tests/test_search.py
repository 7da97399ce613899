"""Search: queries with alternatives, stems, fragments; stems against published examples."""

from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.stems import porter, romanian
from shelfmark.operators import search


def test_alternatives():
    assert search.alternatives('a b or "c d" -e') == [([["a"], ["b"]], []), ([["c", "d"]], [["e"]])]
    assert search.alternatives("or a OR or or b") == [([["or"], ["a"]], []), ([["or"]], []), ([["b"]], [])]
    assert search.alternatives('a or') == [([["a"], ["or"]], [])]
    assert search.alternatives('-"x y" -') == [([], [["x", "y"]])]
    assert search.alternatives(" ... ") == []


def test_stems():
    forms = {
        "caress": "caresses caress", "poni": "ponies", "cat": "cats", "agre": "agreed", "plaster": "plastered", "motor": "motoring", "conflat": "conflated", "size": "sized sizing", "hop": "hopping", "hope": "hoping hopeful hopefulness",
        "fall": "falling", "happi": "happy", "sky": "sky", "relat": "relational", "digit": "digitizer", "oper": "operator operating", "sensibl": "sensibility", "form": "formative", "electr": "electricity electrical", "adopt": "adoption",
        "gener": "generalizations", "oscil": "oscillators", "rate": "rate", "ceas": "cease", "control": "controlling", "feed": "feed", "sing": "sing", "as": "as", "naïves": "naïves", "x1s": "x1s",
    }
    assert {w: porter(w) for ws in forms.values() for w in ws.split()} == {w: stem for stem, ws in forms.items() for w in ws.split()}
    for word in (b + e for b in ("nation", "cap", "sens", "troub", "happ") for e in ("alization", "ability", "ibiliti", "ling", "ies", "y", "ating", "ized", "fulness", "ements")):
        assert word.startswith(porter(word)[:-1])


def test_romanian_stems():
    forms = {
        "abrupt": "abruptă", "absent": "absent absentă absente", "absenţ": "absenţa absenţă absenţii", "absol": "absolut absoluta absolută absolute absolutul absolutului",
        "ocean": "oceanul", "ocol": "ocol ocolea ocolind ocoli ocolire ocoleşti ocoleşti ocolit ocolul", "ocrot": "ocrotind ocrotit", "obos": "obosit",
    }
    assert {w: romanian(w) for ws in forms.values() for w in ws.split()} == {w: stem for stem, ws in forms.items() for w in ws.split()}
    assert romanian("") == "" and romanian("x1") == "x1"


def test_folding_is_the_same_on_both_sides(spark):
    texts = ["Việt đường", "мой Ёж", "Ελλάδα ΟΔΟΣ οδός", "Straße Æon Œuvre", "İstanbul ıssız", "हिन्दी", "e\u0301te\u0301", "Łódź Ħal", "ﬁn ①", "x\u0301\u0301y"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", paths.unaccent(F.lower("t")).alias("folded"), search.tokens(F.col("t")).alias("tokens")).collect()
    assert all(r.folded == paths.fold(r.t) and r.tokens == search.words(r.t) for r in found)
    assert [r.folded for r in found][:4] == ["viet duong", "мои еж", "ελλαδα οδοσ οδοσ", "strasse aeon oeuvre"]


def test_natural_order(spark):
    names = ["x2", "x10", "X010", "x0010", "x9999999999999999999999", "x10000000000000000000000", "x9999999999999999999998y", "a-b", "ab", "äb", "x٣"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    key = [r.n for r in rows.orderBy(paths.natural_key(F.col("n"))).collect()]
    assert [n for n in key if n.lower().startswith("x")] == ["x2", "x٣", "x0010", "X010", "x10", "x9999999999999999999998y", "x9999999999999999999999", "x10000000000000000000000"]
    culture = [r.n for r in rows.orderBy(paths.natural_order(F.col("n"))).collect()]
    assert culture.index("äb") == culture.index("ab") + 1 < culture.index("x2") and key.index("äb") > key.index("x2")
    assert [n for n in culture if n.lower().startswith("x")] == [n for n in key if n.lower().startswith("x")]


TEXTS = ["He operates the machines", "an Operator hopes", "operation of a machine", "the machine of operations", "ropes and machetes", "", None]


def _found(spark, query, **more):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "file_id long, content string")
    return {r.file_id: r for r in search.hits(texts, query, "content", **more).collect()}


def test_search_by_stems(spark):
    english = {"languages": ("english",)}
    assert set(_found(spark, "operating machine")) == set()
    by_stem = _found(spark, "operating machine", **english)
    assert set(by_stem) == {0, 2, 3} and by_stem[0].rank == 1.0
    assert set(_found(spark, '"operating the machining"', **english)) == {0}
    # As a stop word "the" is not looked for among stems.
    assert set(_found(spark, "hoping or machining -the", **english)) == {0, 1, 2, 3}
    assert set(_found(spark, "hoping or machining -a", **english)) == {0, 1, 2, 3}
    assert set(_found(spark, "the", **english)) == {0, 3}
    plain = [i for i, t in enumerate(TEXTS) if "oper" in {porter(w) for w in (t or "").lower().split()}]
    assert sorted(_found(spark, "operative", **english)) == plain
    assert not _found(spark, " ", **english)


def test_negation_alone_and_unknown_language(spark):
    assert set(_found(spark, "-machine")) == {0, 1, 2, 3, 4, 5}
    try:
        _found(spark, "x", languages=("klingon",))
    except ValueError:
        return
    raise AssertionError


def test_fragments(spark):
    text = " ".join(["hit" if i in (2, 10, 30, 60) else f"w{i}" for i in range(80)])
    one = spark.createDataFrame([(1, text), (2, "hit"), (3, "hits w")], "file_id long, content string")
    got = {r.file_id: r.s.replace(search.START, "<").replace(search.STOP, ">") for r in one.select("file_id", search.snippet(F.col("content"), "hit", fragments=2).alias("s")).collect()}
    words = text.split()
    marked = [f"<{w}>" if w == "hit" else w for w in words]
    assert got == {1: " ".join(marked[:16]) + " ... " + " ".join(marked[26:42]), 2: "<hit>", 3: "<hits> w"}
    by_stem = one.select(search.snippet(F.col("content"), "hitting", languages=("english",)).alias("s")).collect()
    assert by_stem[2].s.startswith(search.START + "hits")
