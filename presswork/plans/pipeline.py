"""One cycle: ingest, compile the front page, work off the backlog; steps fail on their own."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import entities as en
from presswork.functions import text as tx
from presswork.functions import urls
from presswork.operators import clusters as cl
from presswork.operators import ingest, models, search, stories
from presswork.operators.store import Store, count_hits, latest_value, merge_clusters
from presswork.session import stash


def requests_for(work: DataFrame, articles: DataFrame, sources: DataFrame, mode: str = "topic", latest: int = 8) -> DataFrame:
    """(id, prompt, own) of the clusters to compile, from their latest articles of known sources."""
    recent = stories.latest_per(articles, "topic_cluster_id", "ingested", n=latest).join(work.select(F.col("id").alias("topic_cluster_id")), "topic_cluster_id", "left_semi")
    known = recent.join(sources.select(F.col("domain").alias("source_domain")), "source_domain", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("rn", F.col("source_domain").alias("domain"), F.col("content").alias("body"), "title")))
    grouped = known.groupBy("topic_cluster_id").agg(ordered.alias("articles"))
    return grouped.select(F.col("topic_cluster_id").alias("id"), models.prompt(F.col("articles")[0]["title"], F.col("articles"), F.lit(mode), fields=("title",)).alias("prompt"), F.array_distinct(F.col("articles.domain")).alias("own"))


def _told(answered: DataFrame, now: Column, provider: Callable[[], models.Provider]) -> DataFrame:
    """Rows of compiled_stories of answers that hold, with the vector of headline and deck."""
    kept = answered.where("ok").select(F.sha2(F.concat("id", now.cast("string")), 256).alias("story"), F.col("id").alias("topic_cluster_id"), "answer.*")
    vector = models.embed_udf(provider)(F.concat_ws("\n\n", "headline", "deck"))
    slug = tx.slug(F.col("headline"), 70, F.col("story"))
    return kept.withColumn("slug", slug).withColumn("headline_embedding", vector).withColumn("refreshed_at", now).withColumn("reused_count", F.lit(0).cast("bigint")).withColumnRenamed("story", "id")


def compile_clusters(store: Store, work: DataFrame, now: Column, provider: Callable[[], models.Provider] = models.HashingProvider) -> dict[str, int]:
    """Compile and store the given clusters; counts of what became of them."""
    answered = stash(models.synthesize(requests_for(work, store.read("articles"), store.read("sources")), provider, retry=False))
    told = _told(answered, now, provider).withColumn("source_mode", F.lit("topic")).withColumn("llm_provider", F.lit(provider().name)).withColumn("model_version", F.lit(provider().model_version))
    added = store.append("compiled_stories", told, ["slug"])
    return {"requested": answered.count(), "stored": added.count()}


def ingest_items(store: Store, items: DataFrame, now: Column, provider: Callable[[], models.Provider] = models.HashingProvider, hours: int = 24) -> dict[str, int]:
    """Gate, deduplicate, embed, attach and store a batch of feed items; clusters that articles join are
    touched, those that they begin are inserted."""
    articles, clusters = store.read("articles"), store.read("topic_clusters")
    new, counts = ingest.ingest(items, articles, store.read("sources"))
    shown = tx.excerpt(F.col("title"), F.col("content"), 8000)
    new = new.withColumn("embedding", models.embed_udf(provider)(shown)).withColumn("entities", en.extract(tx.excerpt(F.col("title"), F.col("content"), 1500))["everything"])
    new = stash(new.withColumn("ingested", now).drop("at"))
    live = clusters.where(F.col("last_updated_at") >= now - F.make_dt_interval(hours=F.lit(hours))).select(F.col("id").alias("topic_cluster_id"))
    members = articles.join(live, "topic_cluster_id", "left_semi")
    dim = new.select(F.max(F.size("embedding"))).first()[0] or 0  # one number
    attached = cl.attach_batch(new, cl.centroids(members, dim=dim or 1), cl.cluster_entities(members))
    attached, begun = ingest.new_clusters(stash(attached), new)
    placed = new.drop("topic_cluster_id").join(attached.select("id", "topic_cluster_id"), "id", "left")
    stored = store.append("articles", placed, ["url"])
    touched = stored.select(F.col("topic_cluster_id").alias("id"), F.lit(True).alias("__t")).distinct()
    kept = clusters.join(touched, "id", "left").withColumn("last_updated_at", F.when(F.col("__t"), F.greatest("last_updated_at", now)).otherwise(F.col("last_updated_at"))).drop("__t")
    store.swap("topic_clusters", kept.unionByName(begun))
    row = counts.first()  # one row of counts
    return {**{k: row[k] for k in ("seen", "rejected", "empty")}, "stored": stored.count(), "clusters": begun.count()}


def front_page_step(store: Store, now: Column, hours: int = 72, per_section: int = 4, provider: Callable[[], models.Provider] = models.HashingProvider) -> dict[str, int]:
    """Compile the recent clusters of every section that have no story, or an old one."""
    fresh = stories.freshness(store.read("topic_clusters"), store.read("compiled_stories"), store.read("articles"), now, hours, per_section)
    return compile_clusters(store, fresh.where("decision <> 'skip'"), now, provider)


def backlog_step(store: Store, now: Column, batch: int = 5, least: int = 1, provider: Callable[[], models.Provider] = models.HashingProvider) -> dict[str, int]:
    """Compile the largest clusters without a story; a batch of 0 turns it off."""
    if batch <= 0:
        return {"requested": 0, "stored": 0}
    work = stories.without_story(store.read("topic_clusters"), store.read("compiled_stories"), store.read("articles"), least, batch)
    return compile_clusters(store, work, now, provider)


def run_cycle(store: Store, items: DataFrame, now: Column, batch: int = 5, provider: Callable[[], models.Provider] = models.HashingProvider) -> dict[str, str]:
    """One whole cycle: ingest, front page, backlog; each step on its own, what became of it in the settings."""
    return cycle(store, {
        "ingest": lambda: ingest_items(store, items, now, provider),
        "front_page": lambda: front_page_step(store, now, provider=provider),
        "backlog": lambda: backlog_step(store, now, batch, provider=provider),
    })


def record(store: Store, text: str, mode: str, story: str | None, now: Column) -> None:
    """Append a request to the history."""
    row = store.spark.createDataFrame([(uuid.uuid4().hex, text, mode, story)], "id string, query_text string, source_mode string, compiled_story_id string")
    store.append("synthesis_history", row.withColumn("created_at", now))


def assembled(store: Store, mode: str, text: str, links: list[str], domains: list[str], now: Column, hours: int = 72) -> DataFrame:
    """(pick, id, url, source_domain, title) of the articles that a request is about, by its mode."""
    articles, sources, spark = store.read("articles"), store.read("sources"), store.spark
    if mode == "links":
        given = spark.createDataFrame(list(enumerate(links)), "pos int, url string")
        found = ingest.links_articles(given, articles, sources).where(~F.col("fetch"))
        return found.select(F.col("pos").alias("pick"), "id", "url", F.col("domain").alias("source_domain"), "title")
    if mode == "freeform":
        parts = spark.range(1).select(tx.sub_topics(F.lit(text))).first()[0]
        return search.assemble_freeform(articles, text, parts, now, hours, sources=sources).select("pick", "id", "url", "source_domain", "title")
    return search.assemble_query(articles, text, now, hours, domains=domains if mode == "compare" else None, sources=sources).select("pick", "id", "url", "source_domain", "title")


MODES = ("topic", "headline", "compare", "links", "freeform")


def answer_request(store: Store, request: dict, now: Column, provider: Callable[[], models.Provider] = models.HashingProvider) -> dict:
    """A reader's request (mode, query or headline, urls, domains) from reuse to a stored story.

    Returns a status (200, 400 without a mode, 404 without articles, 422 where two answers fail their
    check) with the story's id and slug, or the reasons. A reused story has its counter raised.
    """
    mode, links, domains = request.get("mode"), request.get("urls") or [], request.get("domains") or []
    if mode not in MODES:
        return {"status": 400, "error": "mode is required"}
    text = (request.get("query") or request.get("headline") or "").strip()
    told, spark = store.read("compiled_stories"), store.spark
    one = spark.range(1)
    key = one.select(urls.links_hash(F.array(*map(F.lit, links)))).first()[0] if mode == "links" and links else None
    if mode == "compare" and text and domains:
        key = one.select(urls.compare_hash(F.lit(text), F.array(*map(F.lit, domains)))).first()[0]
    vector = provider().embed(text) if text and mode not in ("links", "compare") else None
    reused = stories.reusable_by_hash(told, F.lit(key), now).first() if key else stories.reusable_by_vector(told, list(vector), now).first() if vector else None
    if reused:
        store.swap("compiled_stories", count_hits(told, spark.createDataFrame([(reused["id"],)], "id string")))
        record(store, text, mode, reused["id"], now)
        return {"status": 200, "cached": True, "age_seconds": reused["age_seconds"], "id": reused["id"], "slug": reused["slug"]}
    picked = stash(assembled(store, mode, text, links, domains, now).orderBy("pick").limit(8))
    articles = store.read("articles")
    full = picked.join(articles.select("id", F.col("content").alias("body"), "published_at", "author", "topic_cluster_id"), "id")
    rows = full.agg(
        F.array_sort(F.collect_list(F.struct("pick", F.col("source_domain").alias("domain"), "title", "published_at", "author", "body", "topic_cluster_id"))).alias("articles")
    )  # at most eight articles
    if rows.select(F.size("articles")).first()[0] == 0:
        return {"status": 404, "error": "no articles of known sources for this request"}
    title = F.lit(text) if text else F.col("articles")[0]["title"]
    own = F.array_distinct(F.col("articles.domain"))
    asked = rows.select(F.lit("request").alias("id"), models.prompt(title, F.col("articles"), F.lit(mode), fields=("title", "published_at", "author")).alias("prompt"), own.alias("own"))
    answered = stash(models.synthesize(asked, provider, default_confidence=0.5))
    if not answered.first()["ok"]:
        return {"status": 422, "error": "two answers failed their check"}
    counted = full.where("topic_cluster_id is not null").groupBy("topic_cluster_id").agg(F.count("*").alias("n"), F.min("pick").alias("first"))
    common = counted.orderBy(F.desc("n"), "first").first()
    row = _told(answered.withColumn("id", F.concat(F.lit(uuid.uuid4().hex), "id")), now, provider)
    if common:
        cluster = common["topic_cluster_id"]
    else:
        cluster = uuid.uuid4().hex
        begun = spark.createDataFrame([(cluster, text or picked.orderBy("pick").first()["title"], "world")], "id string, canonical_title string, section string")
        store.append("topic_clusters", begun.withColumn("last_updated_at", now))
    row = row.withColumn("topic_cluster_id", F.lit(cluster)).withColumn("links_hash", F.lit(key)).withColumn("source_mode", F.lit(mode))
    row = row.withColumn("llm_provider", F.lit(provider().name)).withColumn("model_version", F.lit(provider().model_version))
    added = store.append("compiled_stories", row, ["slug"]).first()
    record(store, text, mode, added["id"], now)
    return {"status": 200, "cached": False, "age_seconds": 0, "id": added["id"], "slug": added["slug"]}


def due(settings: dict[str, str], name: str, now: datetime, every: timedelta) -> bool:
    """Is a job that last ran at ``settings["ran_<name>"]`` due again?"""
    last = settings.get(f"ran_{name}")
    return last is None or datetime.fromisoformat(last) + every <= now


def run_due(store: Store, jobs: dict[str, tuple[timedelta, Callable[[], dict[str, int]]]], now: datetime) -> dict[str, str]:
    """Run the jobs whose interval has passed since they last ran: schedules of their own (ingestion every
    quarter of an hour, the front page every hour, a view when its time is up) from one caller."""
    settings = {r["key"]: r["value"] for r in store.read("settings").collect()}  # one row a setting
    ready = {name: step for name, (every, step) in jobs.items() if due(settings, name, now, every)}
    results = cycle(store, ready) if ready else {}
    if ready:
        rows = store.spark.createDataFrame([(f"ran_{n}", now.isoformat()) for n in ready], "key string, value string").withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
        store.swap("settings", latest_value(store.read("settings"), rows, "key", "updated_at"))
    return results


def refreshed_view(store: Store, name: str, make: Callable[[], DataFrame], now: datetime, seconds: int) -> DataFrame:
    """A view kept as files under the store and made anew when it is older than ``seconds``."""
    settings = {r["key"]: r["value"] for r in store.read("settings").collect()}
    path = settings.get(f"view_{name}")
    if path is None or due(settings, f"view_{name}", now, timedelta(seconds=seconds)):
        path = f"{store.root}/views/{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        rows = store.spark.createDataFrame([(f"view_{name}", path), (f"ran_view_{name}", now.isoformat())], "key string, value string").withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
        store.swap("settings", latest_value(store.read("settings"), rows, "key", "updated_at"))
    return store.spark.read.parquet(path)


def backlog_size(clusters: DataFrame, told: DataFrame, articles: DataFrame, least: int) -> int:
    return stories.without_story(clusters, told, articles, least, 50).count()


def merge_cycle(store: Store, now: Column, hours: int = 72, cap: int = 15, dry_run: bool = False) -> dict[str, int]:
    """Merge over-split clusters; with ``dry_run`` only count."""
    articles = cl.with_extracted(store.read("articles"))
    snap = cl.snapshot(articles, store.read("topic_clusters"))
    pairs = cl.merge_candidates(snap, hours)
    merges = cl.greedy_merge(snap, pairs, cap)
    counts = {"clusters": snap.count(), "pairs": pairs.count(), "merged": merges.count()}
    if not dry_run and counts["merged"]:
        tables = ("articles", "compiled_stories", "topic_clusters")
        store.change(dict(zip(tables, merge_clusters(articles, store.read("compiled_stories"), store.read("topic_clusters"), merges, now))))
    return counts


def cycle(store: Store, steps: dict[str, Callable[[], dict[str, int]]]) -> dict[str, str]:
    """Run the steps in order, each on its own; their counts or errors are stored as settings."""
    results = {}
    for name, step in steps.items():
        try:
            results[name] = json.dumps(step())
        except Exception as e:  # a failed step must not keep the next from running
            results[name] = json.dumps({"error": f"{type(e).__name__}: {e}"})
    spark = store.spark
    rows = spark.createDataFrame([(f"last_{k}", v) for k, v in results.items()], "key string, value string").withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz"))
    store.swap("settings", latest_value(store.read("settings"), rows, "key", "updated_at"))
    return results
