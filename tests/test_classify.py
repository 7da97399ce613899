from pyspark.sql import functions as F

from shelfmark.functions import classify, paths


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("v")).orderBy("i").collect()]


def test_tv_episodes(spark):
    rows = [("S1962E03 - The Long Wait", "Season 1962", "Harbour Tales"), ("s2018.e071502 - Evening", "Season 2018", "Bulletin (2011)"), ("Old.Mill.2x11", "Old Mill", None), ("Harbour_Tales s01 e04-05 [hd]", "x", None), ("Lake view", "Pictures", None)]
    got = values(spark, rows, "n string, f string, p string", classify.tv_episode(F.col("n"), F.col("f"), F.col("p")))
    assert [tuple(x) if x else None for x in got] == [("Harbour Tales", 1962, 3, "The Long Wait"), ("Bulletin", 2018, 71502, "Evening"), ("Old Mill", 2, 11, None), ("Harbour Tales", 1, 4, None), None]


def test_file_roles(spark):
    rows = [("metadata.opf", None), ("cover.jpg", None), ("cover.txt", None), ("game.vol", None), ("movie.srt", None), ("a.info.json", None), ("song.lrc", None)]
    assert values(spark, rows, "n string, m string", classify.sidecar_kind(F.col("n"), F.col("m"))) == ["Opf", "CompanionArt", "Content", "CompanionResource", "CompanionResource", "CompanionResource", "Lrc"]
    primary = values(spark, [("movie.txt", "video/mp4"), ("clip.mkv", "text/plain"), ("a.exe", None)], "n string, m string", classify.is_primary_media(F.col("n"), F.col("m")))
    assert primary == [True, False, True]


def test_names(spark):
    rows = [("Season 1",), ("Vol.3",), ("Specials",), ("Season Finale",), ("Disc Golf",)]
    assert values(spark, rows, "n string", classify.is_structural_name(F.col("n"))) == [True, True, True, False, False]
    archives = [("a.zip",), ("b.cbz",), ("c.tar.gz",), ("d.7z",), ("e.jar",), ("f.gz",), ("g.pdf",)]
    assert values(spark, archives, "n string", classify.is_archive(F.col("n"))) == [True] * 4 + [False] * 3


def test_dedicated_folders(spark):
    rows = [("Red Kite (1999)", "Red Kite.avi", ["Red Kite.avi"]), ("Movies", "Quiet Rivers.mkv", ["Quiet Rivers.mkv"]), ("Movies", "x.mkv", ["VTS_01.VOB"]), ("Movies", "movie.mkv", ["movie.mkv"])]
    assert values(spark, rows, "f string, p string, a array<string>", classify.folder_is_dedicated(F.col("f"), F.col("p"), F.col("a"))) == [True, False, True, True]


def test_media_types(spark):
    best = classify.best_mime(F.col("f"), F.col("p"))
    rows = [("application/octet-stream", "application/x-msdownload"), ("application/octet-stream", "*/*"), ("text/plain; charset=x", None)]
    assert values(spark, rows, "f string, p string", classify.media_label(best)) == ["Windows executable", "Unknown", "Text document"]
    assert values(spark, rows, "f string, p string", classify.media_class(best)) == ["Software", "Other", "Document"]


def test_natural_order(spark):
    names = ["a10", "a2", "A1", "a02", "b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(paths.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["A1", "a02", "a2", "a10", "b"]


def test_paths(spark):
    row = spark.createDataFrame([("a/b/c.txt",)], "p string").select(paths.parent_dir(F.col("p")).alias("d"), paths.name_of(F.col("p")).alias("n"), paths.ancestor_dirs(F.col("p")).alias("up")).first()
    assert (row.d, row.n, row.up) == ("a/b", "c.txt", ["a/b", "a"])
