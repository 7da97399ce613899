"""What sidecars give to the primary file of their item."""

from datetime import datetime

from shelfmark.operators import associate as assoc


def test_opf_attributes_are_promoted(spark):
    names = ["book.epub", "a.opf", "b.opf"]
    files = spark.createDataFrame([(i, f"root/book/{x}", 10, None) for i, x in enumerate(names)], "file_id long, path string, size long, mime string")
    old, new = datetime(2001, 1, 1), datetime(2002, 1, 1)
    rows = [(1, 76, "Ann", None), (2, 76, "Ann", None), (2, 76, "Bea", None), (1, 59, "Press", None), (0, 59, "Press", None), (1, 38, "no", None), (2, 45, None, new), (1, 45, None, old)]
    attributes = spark.createDataFrame(rows, "file_id long, definition int, value_text string, value_date timestamp")
    contents = spark.createDataFrame([], "file_id long, content string")
    got = {tuple(r) for r in assoc.promotions(assoc.associate(files), contents, attributes).collect()}
    assert got == {(0, 76, "Ann", None), (0, 76, "Bea", None), (0, 45, None, old)}
