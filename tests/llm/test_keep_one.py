"""Rows that near-duplicate removal keeps, with null and repeated ids."""

from shelfmark.llm import neardup


def text(start, n=40):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_null_and_repeated_ids(spark):
    rows = [(1, text(0)), (2, text(100)), (2, text(100)), (3, text(200)), (3, text(0)), (None, text(300)), (None, text(0)), (4, text(100) + " more"), (5, text(400)), (5, text(400).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text.lower()) for r in neardup.keep_one(df).collect()), key=str)
    assert got == sorted([(1, text(0)), (2, text(100)), (3, text(200)), (None, text(300)), (None, text(0)), (5, text(400))], key=str)


def test_clashing_names_and_nothing(spark):
    schema = "_id string, doc_id long, _text_hash int, text string, n int, root string, `a.b` int, c0 int"
    df = spark.createDataFrame([("x", 1, 1, text(0), 1, "r", 1, 1), ("y", 2, 2, text(0), 2, "r", 2, 2), ("z", 1, 3, text(0), 3, "r", 3, 3), ("v", 3, None, None, 4, None, None, 4)], schema)
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    rows = {r["_id"]: r for r in got.collect()}
    assert len(rows) == 2 and "v" in rows and rows[next(k for k in rows if k != "v")].doc_id == 1
    assert neardup.keep_one(df.limit(0)).count() == 0 and neardup.keep_one(df.where("text is null")).count() == 1


def test_components_of_a_node_with_many_neighbours(spark):
    links = [(1, i) for i in range(2, 60)] + [(100, 59), (100, 101), (200, 201)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 1 for n in [*range(1, 60), 100, 101]} | {200: 200, 201: 200}


def test_preferences_with_clashing_names(spark):
    from shelfmark.llm import chat

    turn = "array<struct<turn:bigint,role:string,text:string>>"
    one, two = [(0, "user", "hi"), (1, "assistant", "a")], [(0, "user", "hi"), (1, "assistant", "b")]
    df = spark.createDataFrame([(1, one, two, "x", 2, 3, 4)], f"_c int, chosen {turn}, rejected {turn}, _r string, `a.b` int, c0 int, prompt int")
    got = chat.format_preferences(df)
    assert got.columns == ["_c", "_r", "a.b", "c0", "prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    row = got.first()
    assert (row["_c"], row["_r"], row["a.b"], row["c0"], row.prompt_turns) == (1, "x", 2, 3, 1) and "a<|end|>" in row.chosen and "b<|end|>" in row.rejected
