from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswork.functions import timestamps as ts
from presswork.operators import clocks

CASES = [
    # stamp, outlet zone, month first, expected
    ("2024-01-03 04:56:59", "America/New_York", True, "2024-01-03T09:56:59.000000Z"),
    ("2024-01-03T23:37:55.897409513Z", "Asia/Tokyo", False, "2024-01-03T23:37:55.897409Z"),
    ("2024-02-24T17:14:21+05:30[Asia/Kolkata]", "UTC", False, "2024-02-24T11:44:21.000000Z"),
    ("2024-01-20 10:50:35 America/New_York", "UTC", False, "2024-01-20T15:50:35.000000Z"),
    ("1704178943", "Asia/Tokyo", False, "2024-01-02T07:02:23.000000Z"),
    ("1704985011.494", "UTC", False, "2024-01-11T14:56:51.494000Z"),
    ("1704207727636", "UTC", False, "2024-01-02T15:02:07.636000Z"),
    ("1706296676334587", "UTC", False, "2024-01-26T19:17:56.334587Z"),
    ("20240102T205308Z", "UTC", False, "2024-01-02T20:53:08.000000Z"),
    ("02/03/2024 17:33", "Europe/London", False, "2024-03-02T17:33:00.000000Z"),
    ("02/03/2024 17:33", "America/Chicago", True, "2024-02-03T23:33:00.000000Z"),
    ("Thu, 04 Jan 2024 23:00:22 CST", "Australia/Adelaide", False, "2024-01-04T12:30:22.000000Z"),
    ("Wed, 03 Jan 2024 04:51:01 -0800", "UTC", False, "2024-01-03T12:51:01.000000Z"),
    ("12 Jan 24 11:04 GMT", "Asia/Tokyo", False, "2024-01-12T11:04:00.000000Z"),
    ("10. März 2024, 10:14 Uhr", "Europe/Berlin", False, "2024-03-10T09:14:00.000000Z"),
    ("22 février 2024 à 20h39", "Europe/Paris", False, "2024-02-22T19:39:00.000000Z"),
    ("5 de marzo de 2024, 03:36 h", "Europe/Madrid", False, "2024-03-05T02:36:00.000000Z"),
    ("January 11, 2024 at 12:36 a.m.", "America/New_York", True, "2024-01-11T05:36:00.000000Z"),
    ("18 February 2024, 10.15pm", "Europe/London", False, "2024-02-18T22:15:00.000000Z"),
    ("2024-01-02", "Asia/Kolkata", False, "2024-01-01T18:30:00.000000Z"),
    ("  2024-01-15 08:04:37\n", "UTC", False, "2024-01-15T08:04:37.000000Z"),
    # a time that occurs twice: the earlier, unless the stamp says which
    ("2024-11-03 01:30:00", "America/New_York", True, "2024-11-03T05:30:00.000000Z"),
    ("Sun, 03 Nov 2024 01:30:00 EST", "America/New_York", True, "2024-11-03T06:30:00.000000Z"),
    ("Sun, 03 Nov 2024 01:30:00 EDT", "America/New_York", True, "2024-11-03T05:30:00.000000Z"),
    # no instant
    ("2024-03-10 02:30:00", "America/New_York", True, None),
    ("2025-02-30T10:00:00Z", "UTC", False, None),
    ("13/13/2025 10:00", "UTC", False, None),
    ("0000-00-00 00:00:00", "UTC", False, None),
    ("2024-01-02 25:00:00", "UTC", False, None),
    ("yesterday", "UTC", False, None),
    ("", "UTC", False, None),
    (None, "UTC", False, None),
]


def test_stamps(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n int, s string, z string, m boolean, e string")
    got = df.select("n", ts.iso_utc(ts.to_instant(ts.parse(F.col("s")), F.col("z"), F.col("m"), F.col("z"))).alias("utc")).collect()
    assert {r["n"]: r["utc"] for r in got} == {i: c[3] for i, c in enumerate(CASES)}


def test_unknown_zone_is_no_instant(spark):
    df = spark.createDataFrame([("2024-01-02 10:00 Mars/Olympus",)], "s string")
    assert df.select(ts.to_instant(ts.parse(F.col("s")), F.lit("UTC"), F.lit(False), F.lit("UTC"))).first()[0] is None


def _articles(spark, rows):
    return spark.createDataFrame(rows, "id string, source_domain string, published_at string, ingested_at string, zone string, delay_h double")


def test_normalise_edges(spark):
    clocks_df = spark.createDataFrame([("a", "Europe/Berlin", "dmy")], "source_domain string, time_zone string, date_order string")
    rows = [("1", "a", "2024-06-01 12:00", "2024-06-01 11:00:00", "x", 1.0)] * 2 + [("2", None, "2024-06-01 12:00", None, None, None), ("3", "nowhere", "nonsense", "", "x", None)]
    got = {tuple(r) for r in clocks.normalise(_articles(spark, rows), clocks_df).collect()}
    assert got == {("1", "published_at", "2024-06-01T10:00:00.000000Z"), ("1", "ingested_at", "2024-06-01T11:00:00.000000Z"), ("2", "published_at", "2024-06-01T12:00:00.000000Z")}
    assert clocks.normalise(_articles(spark, []), clocks_df).count() == 0


@pytest.mark.parametrize("zone, offset", [("Asia/Tokyo", 9), ("America/Bogota", -5)])
def test_estimated_clock(spark, zone, offset):
    from datetime import timedelta

    rows = []
    for i in range(60):
        instant = datetime(2024, 1, 3) + timedelta(hours=70 * i)
        local = instant + timedelta(hours=offset)
        rows.append((str(i), "a", local.strftime("%Y-%m-%d %H:%M:%S"), (instant + timedelta(minutes=4 + 9 * (i % 5))).strftime("%Y-%m-%d %H:%M:%S"), "", 0.0))
    found = clocks.estimate_clocks(clocks.parsed_stamps(_articles(spark, rows))).collect()
    assert [(r["source_domain"], r["time_zone"], r["violations"]) for r in found] == [("a", zone, 0)]
    none = spark.createDataFrame([], "source_domain string, time_zone string, date_order string")
    utc = {r["id"]: r["utc"] for r in clocks.normalise(_articles(spark, rows), none).where("field = 'published_at'").collect()}
    assert utc["0"] == "2024-01-03T00:00:00.000000Z"


def test_estimates_agree_with_the_given_clocks(spark):
    """Held-out accuracy: offsets estimated without the clocks, of outlets that wrote at least 40 zone-less stamps."""
    folder = "/root/testdata/sf0.1"
    articles, given = spark.read.parquet(f"{folder}/articles.parquet"), spark.read.parquet(f"{folder}/outlet_clocks.parquet")
    found = clocks.estimate_clocks(clocks.parsed_stamps(articles)).where("stamps >= 40").withColumnRenamed("time_zone", "estimated").withColumnRenamed("date_order", "order")
    same = F.lit(True)
    for day in ("2025-01-15 12:00:00", "2025-07-15 12:00:00"):
        at = F.lit(day).cast("timestamp_ntz")
        same = same & (F.convert_timezone(F.col("time_zone"), F.lit("UTC"), at) == F.convert_timezone(F.col("estimated"), F.lit("UTC"), at))
    hits = found.join(given, "source_domain").select("source_domain", "time_zone", "estimated", same.cast("int").alias("x")).toPandas()
    assert len(hits) >= 20 and hits["x"].mean() >= 0.9, hits[hits["x"] == 0]
