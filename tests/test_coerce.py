import pytest
from pyspark.sql import functions as F

from shelfmark.functions import coerce

CASES = {
    "integer": [("42", 42), ("  7 ", 7), ("1,000", 1000), ("not a number", None), ("1.5", None), ("", None)],
    "floating": [("1.5", 1.5), ("0.25", 0.25), ("1,5", 15.0), ("1d", None), ("1e3", 1000.0)],
    "duration": [("2:30.5", 150.5), ("1:23:45", 5025.0), ("125.5", 125.5), ("90s", 90.0), ("01:48:05.563000000", 6485.563), ("1:2:3:4", 93784.0), ("1:25:3:4", None), ("x", None)],
    "seconds": [("90", 90.0), ("00:01:30", 90.0), ("1.5", 1.5), ("1.02:03:04", 93784.0), ("1:30", 5400.0)],
    "number": [("0.00 dB", 0.0), ("-5.81 dB", -5.81), ("1,234.5", 1234.5), ("n/a", None)],
    "integer_loose": [("2457 pixels", 2457), ("1/5", 1), ("2.5", 2)],
    "mime": [("text/plain; charset=ISO-8859-1", "text/plain"), (" ; x", None)],
    "pe_machine": [("332", "x86-32"), ("34404", "x86-64"), ("999", None)],
    "meaningful_tag": [("Jazz", True), ("general", False), ("en", False), ("  ", False), ("4k", True)],
    "real_date": [("0000-00-00", False), ("1904:01:01 00:00:00", False), ("1970-01-01", False), ("2024-01-27", True)],
    "attribute_name": [("track_number", "Track number"), ("major-brand", "Major brand"), ("IMDb ID", "IMDb ID")],
    "disc_number": [("1/2", 1), ("x", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_coercer(spark, name):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES[name])], "i int, raw string")
    got = [r.v for r in rows.select("i", getattr(coerce, name)(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in CASES[name]]


def test_units(spark):
    cases = [("1.5 Mbps", "DataRate", 1_500_000.0), ("44.1 kHz", "Frequency", 44_100.0), ("1 KiB", "DataSize", 1024.0), ("44.1 kHz", "DataRate", None), ("5 furlongs", "DataSize", None), ("1,234", "DataSize", 1234.0)]
    for raw, category, want in cases:
        row = spark.createDataFrame([(raw,)], "raw string").select(coerce.in_unit(F.col("raw"), category).alias("v")).first()
        assert row.v == pytest.approx(want) if want is not None else row.v is None, raw


def test_dates(spark):
    rows = spark.createDataFrame([("2024-01-27T17:05:04Z",), ("2024-01-27 17:05:04",), ("2024-01-27",), ("2024",), ("garbage",)], "raw string")
    got = [r.y for r in rows.select(F.year(coerce.iso_date(F.col("raw"))).alias("y")).collect()]
    assert got == [2024, 2024, 2024, 2024, None]
    exif = spark.createDataFrame([("2024:01:27 17:05:04",)], "raw string").select(F.date_format(coerce.exif_date(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("v")).first()
    assert exif.v == "2024-01-27 17:05:04"


def test_years_that_no_time_can_tell(spark):
    """A year too long for a time is no date, and ends no query; formats are tried only where their shape fits."""
    from shelfmark.functions import coerce

    rows = ["+920201-01-31", "99999999-01-01T00:00:00", "2020-01-31", "2020-01", "2020-01-31t01:02:03", "Mon, 3 Feb 2020 04:05:06 GMT", "jan 3, 2020", "3 January 2020 04:05", "2020/1/3 04:05", "1/3/2020", "x", ""]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    got = [r[0] for r in df.select(coerce.iso_date(df["s"]).cast("string")).collect()]
    assert got == [None, None, "2020-01-31 00:00:00", "2020-01-01 00:00:00", "2020-01-31 01:02:03", "2020-02-03 04:05:06", "2020-01-03 00:00:00", "2020-01-03 04:05:00", "2020-01-03 04:05:00", "2020-01-03 00:00:00", None, None]
