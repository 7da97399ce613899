"""Readers and writers of files, ignore files, providers and settings."""

import io
import zipfile

from pyspark.sql import functions as F

from shelfmark.functions import coerce
from shelfmark.operators import associate, browse, facets, layers, normalize, providers, search
from shelfmark.operators.scratch import numbered
from shelfmark.sources import readers


def test_listing_and_collecting(spark, tmp_path):
    for name in ("a.txt", "b.JPG", "sub/c.txt", "sub/skip/.noindex", "sub/skip/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = readers.listing(spark, str(tmp_path), hidden=True)
    assert readers.listing(spark, str(tmp_path)).count() == 4
    assert {p.path.rsplit("/", 1)[1] for p in readers.accepted(found.withColumn("path", F.regexp_replace("path", "^file:/+", ""))).collect()} == {"a.txt", "b.JPG", "c.txt"}
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert sorted(names(readers.collected(spark, str(tmp_path), False))) == ["a.txt", "b.JPG"]
    assert names(readers.collected(spark, str(tmp_path), True, (".TXT",), 2)) == ["a.txt", "c.txt"]
    facts = {r.name: (r.is_dir, r.mime, r.n_entries) for r in readers.file_facts(readers.with_folders(found.withColumn("path", F.regexp_replace("path", f"^file:/*{str(tmp_path)}/", "")))).collect()}
    assert facts["b.JPG"] == (False, "image/jpeg", None) and facts["sub"] == (True, "inode/directory", 2) and facts["skip"][2] == 2


def test_ignore_lines(spark):
    paths = ["x/a.bak", "keep.bak", "logs/1.txt", "x/logs/1.txt", "top/deep/y.c", "z?.d", "zz.d"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in readers.accepted(df, ("# comment", "", "*.bak", "!keep.bak", "/logs/", "top/**/y.c", "z?.d")).collect()}
    assert left == {"keep.bak", "x/logs/1.txt"}


def test_probe_and_archives(spark):
    report = '{"streams":[{"index":0,"codec_type":"video","bit_rate":"1000","duration":"2.5","width":4,"height":2,"r_frame_rate":25.0},{"index":1,"codec_type":"audio","bit_rate":"x","channels":2}]}'
    streams = readers.probe_streams(spark.createDataFrame([(1, report), (2, "broken")], "file_id long, json string"))
    row = layers.media_rollup(streams).first()
    assert (row.file_id, row.n_streams, row.bit_rate, row.width, row.channels) == (1, 2, 1000, 4, 2)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("dir/a.MP3", "tune")
        z.writestr("b.txt", "text")
    archives = spark.createDataFrame([(7, "x.zip", bytearray(data.getvalue())), (8, "y.zip", bytearray(b"no archive"))], "archive_id long, archive_path string, content binary")
    entries = readers.zip_entries(archives)
    assert {(r.archive_id, r.internal, r.size) for r in entries.collect()} == {(7, "dir/a.MP3", 4), (7, "b.txt", 4)}
    wanted = entries.where(browse.read_again(F.col("internal"))).select("archive_id", "internal").unionByName(spark.createDataFrame([(7, "B.TXT"), (7, "none"), (8, "q")], "archive_id long, internal string"))
    got = {(r.archive_id, r.internal): r.result for r in providers.extract_entries(archives, wanted, lambda name, data: data.decode().upper()).collect()}
    assert got == {(7, "dir/a.MP3"): "TUNE", (7, "B.TXT"): "TEXT", (7, "none"): None, (8, "q"): None}


COLUMNS = "sidecar string, scope string, owner string, sub_id long, sub_name string, sub_kind string, group string, name string, kind string, value string"


def test_override_files(spark, tmp_path):
    (tmp_path / "named.xml").write_text(
        """<?xml version="1.0"?><any version="2"><file name="a.txt"><text group="General" name="Title">one</text><text kind="Big" group="General" name="Notes">long</text><int name="Rating">4</int><timeSpan group="Media" name="Duration">00:01:00</timeSpan>
        <subResources><subResource id="2" name="Track 2" kind="audiostream"><text group="Audio" name="Codec">flac</text><float name="Rate">1.5</float></subResource></subResources></file>
        <file name="none.txt"></file><collection name="shows/x"><date group="General" name="Released">01/02/2020</date></collection></any>"""
    )
    (tmp_path / "single.xml").write_text("""<metadata><text group="General" name="Title">old form</text><blob name="Cover">AAEC</blob></metadata>""")
    got = {tuple(r)[1:] for r in readers.override_xml(spark, f"{tmp_path}/*.xml").collect()}
    none = (None, None, None)
    assert got == {
        ("file", "a.txt", *none, "General", "Title", "text", "one"), ("file", "a.txt", *none, "General", "Notes", "bigText", "long"), ("file", "a.txt", *none, None, "Rating", "int", "4"), ("file", "a.txt", *none, "Media", "Duration", "timeSpan", "00:01:00"),
        ("file", "a.txt", 2, "Track 2", "audiostream", "Audio", "Codec", "text", "flac"), ("file", "a.txt", 2, "Track 2", "audiostream", None, "Rate", "float", "1.5"),
        ("collection", "shows/x", *none, "General", "Released", "date", "01/02/2020"), ("file", None, *none, "General", "Title", "text", "old form"), ("file", None, *none, None, "Cover", "blob", "AAEC"),
    }
    assert {r.sidecar.rsplit("/", 1)[1] for r in readers.override_xml(spark, f"{tmp_path}/*.xml").where("owner is null").collect()} == {"single.xml"}


def test_overrides_come_back(spark, tmp_path):
    none = (None, None, None)
    rows = [
        ("file", "a.txt", *none, "General", "Title", "text", "one"), ("file", "a.txt", *none, "General", "Tag", "formattedText", "<b>two</b> & more"), ("file", "a.txt", 1, "One", "videostream", None, "Width", "int", "640"),
        ("file", "c.txt", None, "Only", "page", "General", "Title", "text", "part"), ("collection", "x", *none, "General", "Title", "text", "show"), ("file", "b.txt", *none, "General", "Tag", "text", ""),
    ]
    df = spark.createDataFrame([(None, *r) for r in rows], COLUMNS)
    for scope in ("file", "collection"):
        readers.write_overrides(df, f"{tmp_path}/{scope}", scope)
        assert {tuple(r)[1:] for r in readers.override_xml(spark, f"{tmp_path}/{scope}").collect()} == {r for r in rows if r[0] == scope and r[-1]}


def test_reports(spark, tmp_path):
    readers.write_report(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_retries_and_the_breaker():
    now, slept = [0.0], []
    executor = providers.Executor(retries=2, base_delay=0.5, failures=2, reset=300, clock=lambda: now[0], sleep=slept.append)

    def down():
        raise TimeoutError

    def broken():
        raise ValueError

    assert executor.run(down) == (None, True, "TimeoutError") and slept == [0.5, 1.0]
    assert executor.run(broken) == (None, False, "ValueError")
    assert executor.run(down)[1] and executor.run(lambda: "x") == (None, True, "circuit open")
    now[0] = 301.0
    assert executor.run(lambda: "x") == ("x", False, None) and executor.failed == 0


def test_settings():
    assert providers.merged_settings(['{"a": {"b": 1, "c": [1, 2]}, "d": 1}', "broken", "[1]", '{"a": {"c": [3]}, "d": {"e": 2}}']) == {"a": {"b": 1, "c": [3]}, "d": {"e": 2}}


def test_archives_that_are_containers(spark):
    rows = [(1, "root/x/a.zip", 10, None, None), (2, "root/x/a.zip!/b.txt", 5, None, 1), (3, "root/x/c.txt", 4, None, None)]
    files = spark.createDataFrame(rows, "file_id long, path string, size long, mime string, parent_id long")
    assert {r.file_id for r in associate.associate(files).collect()} == {2, 3}


def test_best_snippet_and_phrases(spark):
    texts = spark.createDataFrame([(1, "a red kite, a red fox"), (2, "the red house"), (3, "Märchen")], "file_id long, content string")
    values = spark.createDataFrame([(1, "red red red")], "file_id long, value_text string")
    got = {r.file_id: r for r in search.search(texts, values, "red", with_snippet=True).collect()}
    assert (got[1].in_content, got[1].in_metadata, got[2].in_metadata) == (True, True, False) and got[1].snippet.count("\x01") == 3
    assert [r.file_id for r in search.hits(texts, '"red fox" -house', "content").collect()] == [1]
    assert [r.file_id for r in search.hits(texts, "marc", "content").collect()] == [3]


def test_hidden_entries_and_candidates(spark):
    rows = [("d/.git", True, None), ("d/b10", False, 1), ("d/b9", False, 1), ("d/sub", True, None)]
    entries = spark.createDataFrame(rows, "path string, is_dir boolean, size long").withColumns({"mime": F.lit("x"), "modified": F.lit(None).cast("timestamp")})
    assert [r.path for r in browse.folder(entries).collect()] == ["d/sub", "d/b9", "d/b10"]
    assert browse.folder(entries, "type", True).count() == 4
    files = spark.createDataFrame([(1, "audio/flac"), (2, None)], "file_id long, mime string")
    none = spark.createDataFrame([], "file_id long, definition int")
    every = {c.key: {r.file_id for r in facets.candidates(files, none, normalize.definitions_table(spark), c).collect()} for c in facets.CATEGORIES}
    assert every["music"] == {1} and every["all"] == {1, 2} and not every["software"] | every["tags"] | every["video"]


def test_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert [r.n for r in numbered(df, ["k"], "n", 5).orderBy("k").collect()] == list(range(5, 1005))
    minted = normalize.mint_definitions(spark.createDataFrame([("b", None), ("a", None), ("a", None), ("c", 3)], "name string, definition int"))
    assert {tuple(r) for r in minted.collect()} == {("a", 1_000_000), ("b", 1_000_001)}


def test_more_coercers(spark):
    cases = [("27 Jan 2024", "2024-01-27 00:00:00"), ("2024/01/27", "2024-01-27 00:00:00"), ("2024-01-27T01:02:03.1234567Z", "2024-01-27 01:02:03"), ("Sat, 27 Jan 2024 01:02:03 GMT", "2024-01-27 01:02:03"), ("1/27/2024", "2024-01-27 00:00:00"), ("soon", None)]
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
    got = [r.v for r in rows.select("i", F.date_format(coerce.iso_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    row = spark.createDataFrame([("IAS3", "3 / 12", "0:02.123456789", "2.5 dB", "x")], "a string, b string, c string, d string, e string")
    got = row.select(coerce.stream_of_language(F.col("a")), coerce.disc_total(F.col("b")), coerce.probe_duration(F.col("c")), coerce.factory_float(F.col("d")), coerce.factory_integer(F.col("e"))).first()
    assert tuple(got) == (3, 12, 2.1234567, 2.5, None)
