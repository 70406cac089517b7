"""The fixture tables in the model's types, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import timestamps as ts
from presswork.session import NOW, table


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Articles, each id once, with ``ingested`` as a UTC time. Only the columns asked for are read."""
    wanted = ["id", "ingested_at", *columns]
    own = F.lit("UTC")
    rows = table(spark, sf_dir, "articles").select(*dict.fromkeys(wanted)).dropDuplicates(["id"])
    return rows.withColumn("ingested", ts.to_instant(ts.parse(F.col("ingested_at")), own, F.lit(False), own)).drop("ingested_at")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "topic_clusters")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "compiled_stories")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sources")


#: DuckDB: articles, each id once, with ``ingested``.
ART = r"""art AS (SELECT DISTINCT ON (id) *, CASE
    WHEN regexp_full_match(ingested_at, '\d{10}') THEN make_timestamp(CAST(ingested_at AS BIGINT) * 1000000)
    WHEN regexp_full_match(ingested_at, '\d{13}') THEN make_timestamp(CAST(ingested_at AS BIGINT) * 1000)
    WHEN ingested_at LIKE '___, %' THEN CAST(strptime(ingested_at, '%a, %d %b %Y %H:%M:%S %z') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
    WHEN regexp_matches(ingested_at, '[+-]\d\d:\d\d(\[.*\])?$') THEN CAST(regexp_replace(ingested_at, '\[.*\]$', '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
    ELSE CAST(replace(ingested_at, 'Z', '') AS TIMESTAMP) END AS ingested FROM articles)"""
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def stamp(c: str):
    """A time as text, alike in both engines."""
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
