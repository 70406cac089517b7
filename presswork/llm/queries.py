"""Queries of problems 2 to 10, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import encoding, linkspam, mainbody, mixing, neighbours, repeats, residue, setpairs, truncation
from presswork.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setpairs.similar_pairs(table(spark, sf_dir, "articles"), "id", "entities", threshold=0.6, min_size=3)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setpairs.linked_classes(table(spark, sf_dir, "articles"), "id", "entities", threshold=0.6, min_size=3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("article", "articles", "embedding"), ("story", "compiled_stories", "headline_embedding"))
    found = [neighbours.nearest_pairs(table(spark, sf_dir, t), "id", c).select(F.lit(kind).alias("record_kind"), "id_a", "id_b") for kind, t, c in kinds]
    return found[0].unionByName(found[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.noise_lines(table(spark, sf_dir, "articles"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, sf_dir, "articles"), "id", "source_domain", "content", least=5)


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.article_and_story_ends(table(spark, sf_dir, "articles"), table(spark, sf_dir, "compiled_stories"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_ends(spark, sf_dir)).select(F.col("kind").alias("record_kind"), "id").distinct()


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ends(spark, sf_dir)
    return truncation.shares(found, truncation.truncated(found))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_ids(residue.judged_pages(table(spark, sf_dir, "articles")))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.corpus_ids(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every target that has documents is met."""
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), size="exact")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkspam.spam(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p2_found, p2_classes, p3_found, p4_found, p5_found, p6_found, p6_shares, p7_found, p8_ids, p9_mixture, p9_shares, p9_exact_shares, p10_found)
}
