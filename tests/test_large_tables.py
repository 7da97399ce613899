"""What goes wrong on larger tables only, made small: ids that two sources share, archives that are full, rows in one task."""

from functools import reduce

from pyspark.sql import functions as F

from shelfmark.functions.stems import STEMMERS, may_have_stem
from shelfmark.operators import facets, normalize, search
from shelfmark.plans import adapters, catalog, living
from shelfmark.sources import archives


def test_type_of_files_that_share_an_id(spark):
    """A chat and a song of one id: each counts by its own content type."""
    rows = [(1, "a", "text/plain", True, "Primary"), (1, "b", "audio/flac", True, "Primary"), (2, "c", "text/html", True, "Primary"), (3, "d", "text/html", True, "Sidecar"), (4, "e", None, True, "Primary")]
    files = spark.createDataFrame(rows, "file_id long, path string, mime string, exists boolean, role string")
    none = spark.createDataFrame([], "file_id long, definition int, value_text string, value_int long, value_date timestamp, sub_resource long")
    documents = next(c for c in facets.CATEGORIES if c.key == "documents")
    found = facets.listing(files, none, normalize.definitions_table(spark), documents, documents.view[0])
    assert {(r.folder, r.n_files) for r in found.collect()} == {("Text document", 1), ("HTML document", 1)}


def test_mime_filter_of_files_that_share_an_id(spark, monkeypatch):
    rows = [(1, "text/plain"), (1, "audio/flac"), (2, "text/html")]
    monkeypatch.setattr(adapters, "files", lambda *_: spark.createDataFrame(rows, "file_id long, mime string"))
    assert {(r.mime, r.n) for r in catalog.filter_mime_prefix(spark, "").collect()} == {("text/plain", 1), ("text/html", 1)}


def test_a_full_archive_is_followed_by_another(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(7)], "doc_id long, text string").coalesce(1)
    made = living._written_archives(docs, f"file://{tmp_path}/zips", 3).collect()
    listed = archives.archive_entries(spark.createDataFrame(made, "archive string"), 3)
    assert len(made) == 3 and {r.internal for r in listed.collect()} == {f"texts/Doc {i}.TXT" for i in range(7)}


def test_rows_are_dealt_out_before_each_becomes_many(spark):
    """One file is one task: what follows the explosion may not stay in it."""
    for raw in (adapters.music_raw, adapters.date_raw, adapters.text_raw):
        plan = raw(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert all("RepartitionByExpression" in part for part in plan.split("Generate explode")[1:])


def test_text_definitions_leave_no_text_out(spark):
    raw = adapters.raw(spark, "/root/testdata/sf0.001")
    some, every = (normalize.first_wins(normalize.normalize(raw, d)).where("value_text is not null") for d in (catalog.TEXT_DEFINITIONS, None))
    assert some.count() == every.count() and some.exceptAll(every.select(*some.columns)).isEmpty()


def test_stems_are_told_once_for_each_word(spark, monkeypatch):
    """No text is sent to Python, and words beyond the bound are stemmed in place with the same result."""
    rows = [(1, "He operates the machines, don't he"), (2, "ocean's oceanul -- absolut"), (3, None), (4, "țările şi ţară"), (5, "nothing")]
    texts = spark.createDataFrame(rows, "file_id long, content string")
    for query in ("operating machine", "ocean", "oceanul -absolut", "țară"):
        found = search.hits(texts, query, "content", with_snippet=True, languages=search.LANGUAGES, fragments=2)
        assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(search, "MAX_FORMS", 0)
            plain = search.hits(texts, query, "content", with_snippet=True, languages=search.LANGUAGES, fragments=2)
            assert sorted(found.collect()) == sorted(plain.collect()) != []


def test_words_that_may_have_a_stem(spark):
    words = [b + e for b in ("nation", "cap", "sens", "ays", "tied", "țăr", "ocol") for e in ("", "s", "alization", "ability", "ibiliti", "ies", "y", "ating", "ilor", "ească", "ii", "ul")]
    one = spark.createDataFrame([(w,) for w in words], "w string")
    for language, stem in STEMMERS.items():
        assert one.where(~reduce(lambda a, b: a | b, [(F.col("w") == w) & may_have_stem(F.col("w"), stem(w), language) for w in words])).isEmpty()


def test_texts_are_cut_into_words_once(spark):
    """Texts of one file count together, and a filter does not repeat what it stands on."""
    texts = spark.createDataFrame([(1, "a b A"), (1, "b c"), (2, ""), (None, "x"), (3, None)], "file_id long, content string")
    assert {tuple(r) for r in search.token_vectors(texts).collect()} == {(1, "a", 2, 0), (1, "b", 2, 0), (1, "c", 1, 1), (None, "x", 1, 0)}
    plan = search.hits(texts, "b", "content", with_snippet=True, fragments=2)._jdf.queryExecution().optimizedPlan().toString()
    # Each text is folded once for its words and once for the letters of its parts.
    assert plan.count("translate(") == 2
