"""Override files by folder, and the reports of a collector as files."""

from pathlib import Path

from shelfmark.operators import collector
from shelfmark.plans.living import _reports
from shelfmark.sources import readers, sidecars

COLUMNS = "folder string, scope string, owner string, sub_id long, sub_name string, sub_kind string, group string, name string, kind string, value string"
NONE = (None, None, None)


def test_one_file_for_each_folder_and_none_without_edits(spark, tmp_path):
    for d in ("a", "b", "c", "d"):
        (tmp_path / d).mkdir()
    (tmp_path / "c" / "edits.xml").write_text("old")
    at = lambda d: f"file://{tmp_path}/{d}"
    rows = [
        (at("a"), "file", "z.txt", *NONE, "General", "Title", "text", "one & <two>"), (at("a"), "file", "B.txt", *NONE, "General", "Tag", "formattedText", "é"), (at("a"), "file", "B.txt", *NONE, "Audio", "Rating", "int", "4"),
        (at("a"), "file", "a.txt", 2, "Track", "AudioStream", None, "Width", "int", "640"), (at("a"), "collection", "shows", *NONE, "General", "Title", "text", "x"), (at("b"), "file", "b.txt", *NONE, None, "Title", "text", "y"),
        (at("c"), "file", "c.txt", *NONE, None, "Title", "text", ""), (at("d"), "file", "d.txt", *NONE, None, "Title", "text", None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    folders = spark.createDataFrame([(at(d),) for d in "abcd"] + [(at("a"),)], "folder string")
    for _ in range(2):
        done = {r.folder[-1]: r.action for r in sidecars.write_sidecars(df, folders, "edits.xml").collect()}
        assert done["a"] == done["b"] == "written" and done["d"] == "none" and done["c"] in ("deleted", "none")
    assert sorted(str(p.relative_to(tmp_path)) for p in Path(tmp_path).glob("*/*")) == ["a/edits.xml", "b/edits.xml"]
    text = (tmp_path / "a" / "edits.xml").read_text()
    assert [text.index(x) for x in ("a.txt", "B.txt", "z.txt", "shows")] == sorted(text.index(x) for x in ("a.txt", "B.txt", "z.txt", "shows"))
    assert text.index("Rating") < text.index("Tag") and 'version="2"' in text
    back = {tuple(r)[1:] for r in readers.override_xml(spark, f"{tmp_path}/*/edits.xml").collect()}
    want = {(*r[1:5], r[5].lower() if r[5] else None, *r[6:]) for r in rows if r[-1]}
    assert back == want


def test_reports_as_files(spark, tmp_path):
    raw, canonical, summary = _reports(spark, "/root/testdata/sf0.001")
    collector.write_reports(f"file://{tmp_path}/reports", raw, canonical, collector.unmapped_report(raw), summary)
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/reports/{n}")
    assert read("raw-metadata").columns == ["file", "provider", "namespace", "key", "value", "sub_resource", "mapped"]
    assert read("raw-metadata").count() == raw.count() and read("canonical-metadata").count() == canonical.count() and read("file-summary").count() == summary.count()
    files = [int(r.files) for r in read("unmapped-keys").collect()]
    assert files == sorted(files, reverse=True) and len(files) == 3
