"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.operators import clocks
from presswork.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clocks.normalise(table(spark, sf_dir, "articles"), table(spark, sf_dir, "outlet_clocks"))


def p1_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock that the stamps of each outlet speak for, without looking at outlet_clocks."""
    found = clocks.estimate_clocks(clocks.parsed_stamps(table(spark, sf_dir, "articles")))
    return found.select("source_domain", "time_zone", "date_order", "violations", "stamps", F.round("mean_delay_h", 4).alias("mean_delay_h"))


QUERIES = {"p1_found": p1_found, "p1_estimates": p1_estimates}
ORACLES: dict[str, str] = {}
