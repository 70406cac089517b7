"""Search over articles, suggestions, and source-diverse selections.

Every ranking ends in the id, so that results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions import text as tx
from presswork.session import cut


def since(stamp: Column, now: Column, hours: int, legacy_text_ts: bool = False) -> Column:
    """Within the last hours; ``legacy_text_ts`` keeps the habit of comparing dates only."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    return F.to_date(stamp) > F.to_date(cutoff) if legacy_text_ts else stamp >= cutoff


def search(articles: DataFrame, query: str, now: Column, hours: int, limit: int, domains: list[str] | None = None, wildcards: bool = False) -> DataFrame:
    """Articles that hold the query in title or text, title hits first, then the latest. No domains means all."""
    in_title = tx.contains_text(F.col("title"), query, wildcards)
    found = articles.where(since(F.col("ingested"), now, hours) & (in_title | tx.contains_text(F.col("content"), query, wildcards)))
    if domains:
        found = found.where(F.col("source_domain").isin(*domains))
    ranked = found.select("id", "source_domain", "title", "url", "ingested", F.when(in_title, 1).otherwise(0).alias("title_hit"))
    return ranked.orderBy(F.desc("title_hit"), F.desc("ingested"), "id").limit(limit)


def suggest(articles: DataFrame, partial: str, limit: int = 8) -> DataFrame:
    """Titles that hold the text, the latest first, each with the source of its latest article."""
    wanted = partial.strip()
    if len(wanted) < 2:
        return articles.select("title", "source_domain", F.col("ingested").alias("latest")).limit(0)
    last = F.struct("ingested", "id")
    hits = articles.where(tx.contains_text(F.col("title"), wanted)).groupBy("title").agg(F.max_by("source_domain", last).alias("source_domain"), F.max("ingested").alias("latest"))
    return hits.orderBy(F.desc("latest"), "title").limit(limit)


def diverse(ranked: DataFrame, pos: str, cap: int) -> DataFrame:
    """The first article of every source in order of appearance, then all others source by source, up to cap."""
    by_source = Window.partitionBy("source_domain")
    placed = ranked.withColumn("rn", F.row_number().over(by_source.orderBy(pos))).withColumn("seen", F.min(pos).over(by_source))
    order = [F.when(F.col("rn") > 1, 1).otherwise(0), F.col("seen"), F.col("rn")]
    return placed.orderBy(*order).limit(cap).withColumn("pick", F.row_number().over(Window.orderBy(*order)))


def _numbered(df: DataFrame, rank: int) -> DataFrame:
    order = Window.orderBy(F.desc("title_hit"), F.desc("ingested"), "id")  # a limited result
    return df.withColumn("rank", F.row_number().over(order)).withColumn("pass", F.lit(rank))


def candidates(articles: DataFrame, query: str, now: Column, hours: int, fetch: int, least: int, keyword_fetch: int, domains: list[str] | None = None, until: int | None = None) -> DataFrame:
    """Search results in order (column pos): the whole query, and each of its keywords where it finds too little.

    Keyword results are appended while fewer than ``until`` rows are there (all, by default); first occurrences count.
    """
    whole = _numbered(search(articles, query, now, hours, fetch, domains), 0)
    words = [w for w in query.split() if len(w) >= 3] if " " in query else []
    parts = [whole, *(_numbered(search(articles, w, now, hours, keyword_fetch, domains), i) for i, w in enumerate(words, 1))]
    every = reduce(DataFrame.unionByName, parts).withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("pass", "rank"))).where("copy = 1")
    total = F.sum(F.when(F.col("pass") == 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))
    # a pass is used if the passes before it left room; all rows here are limited search results
    per_pass = every.groupBy("pass").agg(F.count("*").alias("n"))
    before = per_pass.withColumn("before", F.sum("n").over(Window.orderBy("pass")) - F.col("n")).select("pass", "before")
    room = F.lit(True) if until is None else F.col("before") < until
    used = every.withColumn("found", total).join(before, "pass").where((F.col("pass") == 0) | (F.col("found") < least) & room)
    return used.withColumn("pos", F.row_number().over(Window.orderBy("pass", "rank"))).select("id", "source_domain", "title", "url", "ingested", "title_hit", "pos")


def pool(articles: DataFrame, texts: list[str], now: Column, hours: int) -> DataFrame:
    """The recent articles that hold any of the texts or their words, written once: what a selection of
    several searches reads instead of scanning all articles for each."""
    words = dict.fromkeys([*texts, *(w for t in texts if " " in t for w in t.split() if len(w) >= 3)])
    hits = [tx.contains_text(F.col(c), w) for w in words for c in ("title", "content")]
    columns = articles.select("id", "source_domain", "title", "content", "url", "ingested")
    return cut(columns.where(since(F.col("ingested"), now, hours) & reduce(lambda a, b: a | b, hits)))


def assemble_query(articles: DataFrame, query: str, now: Column, hours: int = 72, fetch: int = 30, least: int = 4, cap: int = 8, domains: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Diverse selection for one topic; of known ``sources`` alone, where they are given."""
    articles = pool(articles, [query], now, hours)
    return _known(diverse(candidates(articles, query, now, hours, fetch, least, fetch, domains, fetch), "pos", cap), sources)


def _known(picked: DataFrame, sources: DataFrame | None) -> DataFrame:
    """What is picked, without articles of sources that are not known; their places stay empty."""
    return picked if sources is None else picked.join(sources.select(F.col("domain").alias("source_domain")).distinct(), "source_domain", "left_semi")


def assemble_freeform(articles: DataFrame, query: str, topics: list[str], now: Column, hours: int = 72, cap: int = 10, sources: DataFrame | None = None) -> DataFrame:
    """Selection over the parts of a free query: each part gets its quota, one article a source, and
    what is left is filled from the whole query. ``topics`` are the parts (functions.text.sub_topics)."""
    if len(topics) <= 1:
        return assemble_query(articles, query, now, hours, sources=sources)
    quota = max(2, cap // len(topics))
    articles = pool(articles, [query, *topics], now, hours)
    chosen = None
    for i, topic in enumerate(dict.fromkeys(topics)):  # the few parts of one typed query
        found = candidates(articles, topic, now, hours, 20, 3, 15)
        if chosen is not None:
            found = found.join(chosen.select("id"), "id", "left_anti")
        first = found.withColumn("rn", F.row_number().over(Window.partitionBy("source_domain").orderBy("pos"))).where("rn = 1")
        picked = first.orderBy("pos").limit(quota).select("id", "source_domain", "title", "url", "ingested", F.lit(i).alias("topic"), "pos")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    rest = _numbered(search(articles, query, now, hours, 15), 0).join(chosen.select("id"), "id", "left_anti")
    rest = rest.select("id", "source_domain", "title", "url", "ingested", F.lit(len(topics)).alias("topic"), F.col("rank").alias("pos"))
    order = ["topic", "pos"]
    picked = chosen.unionByName(rest).orderBy(*order).limit(cap)
    return _known(picked.withColumn("pick", F.row_number().over(Window.orderBy(*order))), sources)
