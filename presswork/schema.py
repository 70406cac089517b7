"""Table schemas, empty tables and column defaults of earlier versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = "array<struct<claimText:string,attributedDomains:array<string>>>"
DISAGREEMENTS = "array<struct<description:string,positions:array<struct<domain:string,position:string>>>>"
SINGLES = "array<struct<claimText:string,domain:string,reasoning:string>>"
IMPACTS = "array<struct<ticker:string,company:string,score:double,direction:string,reasoning:string>>"

TABLES: dict[str, str] = {
    "settings": "key string, value string, updated_at timestamp_ntz",
    "sources": "domain string, display_name string, category string, aliases array<string>, rss_feed_urls array<string>, bias_rating string, credibility_score double, factual_reporting string, is_active boolean, notes string",
    "articles": "id string, url string, source_domain string, title string, author string, published_at string, content string, content_hash string, embedding array<double>, topic_cluster_id string, entities array<string>, ingested timestamp_ntz",
    "topic_clusters": "id string, canonical_title string, section string, last_updated_at timestamp_ntz",
    "compiled_stories": f"id string, slug string, topic_cluster_id string, headline string, deck string, body string, source_domains array<string>, claim_attributions {CLAIMS}, disagreements {DISAGREEMENTS}, single_source_claims {SINGLES}, market_impacts {IMPACTS}, source_mode string, llm_provider string, model_version string, confidence double, notes string, links_hash string, headline_embedding array<double>, reused_count bigint, refreshed_at timestamp_ntz",
    "synthesis_history": "id string, query_text string, source_mode string, compiled_story_id string, created_at timestamp_ntz",
}
#: Columns that later versions added, with what they hold in older rows.
DEFAULTS = {"articles": {"entities": F.array}, "topic_clusters": {"section": lambda: F.lit("world")}, "compiled_stories": {"market_impacts": F.array, "reused_count": lambda: F.lit(0)}}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def upgraded(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A table of any version in today's columns: added ones get their defaults, others null."""
    for field in empty(spark, name).schema:
        if field.name not in df.columns:
            value = DEFAULTS.get(name, {}).get(field.name, lambda: F.lit(None))()
            df = df.withColumn(field.name, value.cast(field.dataType))
    return df.select(*[f.name for f in empty(spark, name).schema])
