"""Mixed timestamps of many outlets brought to one unambiguous form (problem 1).

Method: stamps without a zone are aligned with the instants at which their records were
ingested; of the candidate clocks (an IANA zone, that is an offset history, and an order of
day and month) the one with the fewest violations (published after ingested, or no such time)
is taken, ties by the smaller mean delay, then by the more customary zone. A clock that is known beforehand wins over the
estimate, so only outlets without one are estimated.

Defined cases: null, blank, unreadable and impossible stamps give no row; rows delivered twice
count once; an outlet that has neither a clock nor any usable stamp to estimate from is read
as UTC; empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswork.functions import timestamps as ts

#: Names by which the commonest offset histories go; any other history has its first name.
CUSTOMARY = (
    "UTC Europe/London Europe/Berlin Europe/Athens Europe/Moscow America/New_York America/Chicago America/Denver America/Phoenix America/Los_Angeles America/Anchorage "
    "America/Halifax America/St_Johns America/Sao_Paulo America/Bogota Pacific/Honolulu Pacific/Auckland Africa/Lagos Africa/Johannesburg Africa/Nairobi Asia/Tehran Asia/Dubai "
    "Asia/Karachi Asia/Kolkata Asia/Kathmandu Asia/Dhaka Asia/Bangkok Asia/Shanghai Asia/Tokyo Australia/Darwin Australia/Adelaide Australia/Brisbane Australia/Sydney"
).split()
#: Years whose offset histories tell zones apart.
YEARS = (2015, 2031)


@lru_cache(maxsize=1)
def candidate_zones(first: int = YEARS[0], last: int = YEARS[1]) -> tuple[str, ...]:
    """One zone for each distinct offset history of the years, told apart day by day."""
    days = [datetime(first, 1, 1, 12, tzinfo=UTC) + timedelta(days=n) for n in range((last - first) * 366)]
    places = ("Africa/", "America/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    found: dict[tuple, str] = {}
    for name in [*CUSTOMARY, *sorted(n for n in available_timezones() if n.startswith(places))]:
        zone = ZoneInfo(name)
        found.setdefault(tuple(day.astimezone(zone).utcoffset() for day in days), name)
    return tuple(found.values())


#: A delay beyond this many hours says nothing about the clock and counts as this much.
DELAY_CAP_HOURS = 48.0
#: Rates of violations this close to the best count as equal (records loaded out of order).
VIOLATION_SLACK = 0.02

CLOCK_SCHEMA = T.StructType([T.StructField("source_domain", T.StringType()), T.StructField("time_zone", T.StringType()), T.StructField("date_order", T.StringType())])


def parsed_stamps(articles: DataFrame) -> DataFrame:
    """(id, source_domain, field, stamp) with the stamp parsed, one row a field.

    Only four columns of the input are read. The generator stands between parsing and any later
    filter, which would otherwise be pushed down and parse every stamp again.
    """
    fields = F.array(*[F.struct(F.lit(f).alias("field"), ts.parse(F.col(f)).alias("stamp")) for f in ("published_at", "ingested_at")])
    return articles.select("id", "source_domain", F.explode(fields).alias("x")).select("id", "source_domain", "x.field", "x.stamp")


def estimate_clocks(stamps: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """(source_domain, time_zone, date_order, violations, stamps, mean_delay_h) per outlet.

    ``stamps`` comes from parsed_stamps. Each zone-less publication time votes for every
    candidate; the votes are summed before the shuffle, so an outlet with a third of all
    rows costs no more than its few partial sums.
    """
    zones = zones or list(candidate_zones())
    utc = F.lit("UTC")
    stamps = stamps.where("source_domain is not null and id is not null")
    written = stamps.where((F.col("field") == "published_at") & (F.col("stamp.zone") == "")).select(
        "id", "source_domain", F.col("stamp.wall").alias("dmy"),
        F.when(F.col("stamp.form") == "fig", F.col("stamp.wall_mdy")).otherwise(F.col("stamp.wall")).alias("mdy"),
    )
    loaded = stamps.where("field = 'ingested_at'").select("id", ts.to_instant(F.col("stamp"), utc, F.lit(False), utc).alias("ingested"))
    local = written.dropDuplicates(["id"]).join(loaded.dropDuplicates(["id"]), "id")
    candidates = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(z).alias("time_zone"), F.lit(o).alias("date_order")) for n, z in enumerate(zones) for o in ("dmy", "mdy")])
    votes = local.select("*", F.inline(candidates))
    wall = F.when(F.col("date_order") == "mdy", F.col("mdy")).otherwise(F.col("dmy"))
    votes = votes.withColumn("delay_h", _hours(ts.in_zone(wall, F.col("time_zone"), F.lit(False)), F.col("ingested"))).where("ingested is not null")
    bad = F.col("delay_h").isNull() | (F.col("delay_h") < 0)
    scored = votes.groupBy("source_domain", "place", "time_zone", "date_order").agg(
        F.count("*").alias("stamps"),
        F.count_if(bad).alias("violations"),
        F.avg(F.least(F.abs(F.coalesce("delay_h", F.lit(DELAY_CAP_HOURS))), F.lit(DELAY_CAP_HOURS))).alias("mean_delay_h"),
    )
    best = scored.groupBy("source_domain").agg(F.min(F.col("violations") / F.col("stamps")).alias("least"))
    close = scored.join(best, "source_domain").where(F.col("violations") / F.col("stamps") <= F.col("least") + VIOLATION_SLACK)
    rank = F.struct(F.round("mean_delay_h", 6).alias("a"), F.col("violations").alias("b"), F.col("date_order").alias("c"), F.col("place").alias("d"))
    return close.groupBy("source_domain").agg(F.min_by(F.struct("time_zone", "date_order", "violations", "stamps", "mean_delay_h"), rank).alias("x")).select("source_domain", "x.*")


def _hours(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)


def normalise(articles: DataFrame, clocks: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """(id, field, utc): every stamp of the two fields that names an instant, as that instant."""
    stamps = parsed_stamps(articles)
    valid = ts.constant_map({z: z for z in [*ts.zone_table().values(), "UTC"]})
    known = clocks.where(F.try_element_at(valid, F.col("time_zone")).isNotNull()).select("source_domain", "time_zone", "date_order").dropDuplicates(["source_domain"])
    unknown = stamps.where("source_domain is not null").join(known, "source_domain", "left_anti")
    clock = known.unionByName(estimate_clocks(unknown, zones).select("source_domain", "time_zone", "date_order"))
    joined = stamps.join(clock, "source_domain", "left")
    own, first = F.coalesce("time_zone", F.lit("UTC")), F.coalesce(F.col("date_order") == "mdy", F.lit(False))
    bare = F.when(F.col("field") == "published_at", own).otherwise("UTC")
    at = ts.to_instant(F.col("stamp"), own, first, bare)
    named = joined.select("id", "field", F.explode(F.array_compact(F.array(at))).alias("at"))
    return named.select("id", "field", ts.iso_utc(F.col("at")).alias("utc")).distinct()
