"""Work-lists, reuse, validation and read views of compiled stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions import stories as st
from presswork.functions import text as tx
from presswork.functions import vectors as vc


def latest_per(df: DataFrame, key: str, stamp: str, tie: str = "id", n: int = 1) -> DataFrame:
    """The n latest rows of every key."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(stamp), tie)
    return df.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def without_story(clusters: DataFrame, stories: DataFrame, articles: DataFrame, least: int, batch: int) -> DataFrame:
    """Clusters that no story covers, with at least ``least`` articles, the largest first."""
    open_ = clusters.join(stories.select(F.col("topic_cluster_id").alias("id")).where("id is not null"), "id", "left_anti")
    sizes = articles.groupBy(F.col("topic_cluster_id").alias("id")).agg(F.count("*").alias("articles"))
    sized = open_.join(sizes, "id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
    return sized.where(F.col("articles") >= least).orderBy(F.desc("articles"), F.desc("last_updated_at"), "id").limit(max(1, min(batch, 50)))


def freshness(clusters: DataFrame, stories: DataFrame, articles: DataFrame, now: Column, hours: int, per_section: int, **rule: float) -> DataFrame:
    """(id, section, refreshed_at, new_articles, decision) of the recent clusters of every section."""
    recent = clusters.where(F.col("last_updated_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    top = recent.withColumn("rn", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("last_updated_at"), "id"))).where(F.col("rn") <= per_section)
    last = stories.where("topic_cluster_id is not null").groupBy("topic_cluster_id").agg(F.max("refreshed_at").alias("refreshed_at"))
    told = top.join(last, top["id"] == last["topic_cluster_id"], "left").select(top["id"], "section", "refreshed_at")
    arrived = articles.where("topic_cluster_id is not null").select(F.col("topic_cluster_id").alias("c"), "ingested")
    counted = told.join(arrived, (F.col("id") == F.col("c")) & (F.col("ingested") > F.col("refreshed_at")), "left").groupBy("id", "section", "refreshed_at").agg(F.count("c").alias("new_articles"))
    decision = F.when(F.col("refreshed_at").isNull(), "compile").when(st.needs_refresh(F.col("refreshed_at"), now, F.col("new_articles"), **rule), "refresh").otherwise("skip")
    return counted.withColumn("decision", decision)


def reusable_by_hash(stories: DataFrame, key: Column, now: Column, hours: int = 12) -> DataFrame:
    """The latest story with this set of links within the window."""
    hits = stories.where((F.col("links_hash") == key) & (F.col("refreshed_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    return hits.orderBy(F.desc("refreshed_at"), "id").limit(1).select("id", "slug", st.age_seconds(F.col("refreshed_at"), now).alias("age_seconds"))


def reusable_by_vector(stories: DataFrame, vector: list[float], now: Column, hours: int = 24, candidates: int = 50, threshold: float = 0.88) -> DataFrame:
    """The most similar recent story by its headline, if similar enough; ties to the latest."""
    recent = stories.where(F.col("headline_embedding").isNotNull() & (F.col("refreshed_at") >= now - F.make_dt_interval(hours=F.lit(hours))))
    top = recent.orderBy(F.desc("refreshed_at"), "id").limit(candidates)
    query = F.array(*map(F.lit, vector))
    scored = top.select("id", "slug", "refreshed_at", F.round(vc.cosine(F.col("headline_embedding"), query), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.orderBy(F.desc("similarity"), F.desc("refreshed_at"), "id").limit(1)
    return best.select("id", "slug", "similarity", st.age_seconds(F.col("refreshed_at"), now).alias("age_seconds"))


def source_refs(stories: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, names): display names of a story's sources in their stored order; unknown ones dropped."""
    listed = stories.select("id", F.posexplode("source_domains").alias("pos", "domain"))
    named = listed.join(sources.select("domain", "display_name"), "domain")
    return named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "display_name"))), lambda x: x["display_name"]).alias("names"))


def source_links(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, domain, url): for every source of a story the latest article of its cluster, else its latest of all."""
    listed = stories.select("id", "topic_cluster_id", F.explode("source_domains").alias("domain"))
    last = F.struct("ingested", "id")
    in_cluster = articles.where("topic_cluster_id is not null").groupBy(F.col("topic_cluster_id").alias("c"), F.col("source_domain").alias("d")).agg(F.max_by("url", last).alias("near"))
    of_source = articles.groupBy(F.col("source_domain").alias("s")).agg(F.max_by("url", last).alias("any"))
    joined = listed.join(in_cluster, (F.col("topic_cluster_id") == F.col("c")) & (F.col("domain") == F.col("d")), "left").join(of_source, F.col("domain") == F.col("s"), "left")
    return joined.select("id", "domain", F.coalesce("near", "any").alias("url")).distinct()


def section_of(stories: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, section): business if a business outlet is among the sources, else world."""
    business = sources.where("category = 'business'").select(F.col("domain"), F.lit(True).alias("b"))
    joined = stories.select("id", F.explode_outer("source_domains").alias("domain")).join(business, "domain", "left")
    return joined.groupBy("id").agg(F.when(F.bool_or(F.coalesce("b", F.lit(False))), "business").otherwise("world").alias("section"))


def story_views(stories: DataFrame, articles: DataFrame, sources: DataFrame, prefix: str = "Compiled from ") -> DataFrame:
    """Stories as they are read: (id, slug, section, headline, deck, byline, refreshed_at, blocks, sources,
    claim_attributions, market_impacts, mode, single_source). ``sources`` are those that are known, in
    stored order, each with the address of its latest article of the cluster, of all, or its own."""
    listed = stories.select("id", F.posexplode("source_domains").alias("pos", "domain"))
    named = listed.join(sources.select("domain", "display_name", "category", "bias_rating", "credibility_score", "factual_reporting"), "domain")
    linked = named.join(source_links(stories, articles), ["id", "domain"], "left").withColumn("url", F.coalesce("url", F.concat(F.lit("https://"), "domain")))
    ref = F.struct("pos", "domain", "display_name", "category", "bias_rating", "credibility_score", "factual_reporting", "url")
    refs = linked.groupBy("id").agg(F.array_sort(F.collect_list(ref)).alias("sources"))
    joined = stories.join(refs, "id", "left").join(section_of(stories, sources), "id", "left")
    known = F.coalesce(F.size("sources"), F.lit(0))
    return joined.select(
        "id", "slug", "section", "headline", F.coalesce("deck", F.lit("")).alias("deck"),
        F.concat(F.lit(prefix), F.coalesce(F.array_join("sources.display_name", ", "), F.lit(""))).alias("byline"),
        "refreshed_at", st.blocks(F.col("body")).alias("blocks"), "sources", "claim_attributions",
        F.coalesce("market_impacts", F.array()).alias("market_impacts"), F.col("source_mode").alias("mode"), (known <= 1).alias("single_source"),
    )


def or_fixture(found: DataFrame, fixture: DataFrame) -> DataFrame:
    """What was found, or the fixture's rows where nothing was (one row is looked for)."""
    return fixture.select(*found.columns) if found.isEmpty() else found


def of_section(cards: DataFrame, section: str | None) -> DataFrame:
    """Cards of one section; none, blank and "all" mean every section."""
    wanted = (section or "").strip().lower()
    return cards if wanted in ("", "all") else cards.where(F.lower("section") == wanted)


def front_page(stories: DataFrame, sources: DataFrame, size: int = 8) -> DataFrame:
    """(place, role, id, slug, headline, byline, single_source): the latest stories, the first as the lead."""
    top = stories.orderBy(F.desc("refreshed_at"), "id").limit(size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("refreshed_at"), "id"))).join(source_refs(top, sources), "id", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return placed.select("place", F.when(F.col("place") == 1, "lead").otherwise("side").alias("role"), "id", "slug", "headline", tx.join_names(names).alias("byline"), (F.size(names) <= 1).alias("single_source"))


def checked(stories: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """(id, ok, failures): every story's citations against the known sources and its own."""
    known = F.broadcast(sources.agg(F.array_sort(F.collect_set(F.lower("domain"))).alias("known")))  # the outlet dimension, one row
    cited = st.cited_domains(F.col("claim_attributions"), F.col("source_domains"))
    own = F.transform("source_domains", F.lower)
    found = stories.crossJoin(known).select("id", st.failures(F.col("body"), cited, F.col("known"), own, strict).alias("failures"))
    return found.select("id", (F.size("failures") == 0).alias("ok"), "failures")


def ungrounded(stories: DataFrame, articles: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, claims, ungrounded): claims whose words no article of the story's cluster covers to ``least``."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4))
    claims = stories.select("id", "topic_cluster_id", F.posexplode("claim_attributions").alias("n", "claim")).select("id", "topic_cluster_id", "n", words(F.col("claim.claimText")).alias("cw"))
    texts = articles.select("topic_cluster_id", words(F.concat_ws(" ", "title", "content")).alias("aw"))
    covered = claims.join(texts, "topic_cluster_id", "left").withColumn("share", F.when(F.size("cw") > 0, F.size(F.array_intersect("cw", "aw")) / F.size("cw")).otherwise(1.0))
    best = covered.groupBy("id", "n").agg(F.max(F.coalesce("share", F.lit(0.0))).alias("best"))
    return best.groupBy("id").agg(F.count("*").alias("claims"), F.count_if(F.col("best") < least).alias("ungrounded"))
