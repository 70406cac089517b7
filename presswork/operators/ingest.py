"""From feed items to stored articles: source gate, exact duplicates, text fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions import text as tx
from presswork.functions import urls
from presswork.sources.feeds import main_text

USEFUL, CAP, SNIPPET = 300, 30_000, 50


def domain_index(sources: DataFrame) -> DataFrame:
    """(name, domain): every domain and alias of the sources; of two owners the later one counts, by
    the column ``place`` of the sources where they have one, else by their domain. A source's own
    domain stands before its aliases, so an alias that is another source's domain goes to the later."""
    place = F.struct("place", "domain") if "place" in sources.columns else F.struct("domain")
    order = sources.select("domain", place.alias("at"), F.explode(F.concat(F.array("domain"), F.coalesce("aliases", F.array()))).alias("name"))
    return order.groupBy(F.lower("name").alias("name")).agg(F.max_by("domain", "at").alias("domain"))


def resolve(df: DataFrame, url: str, sources: DataFrame) -> DataFrame:
    """The rows with ``domain``: the source that the host, or else its longest known parent domain, belongs to.

    The suffixes of a host are exploded and looked up by equality, instead of testing every source
    on every row; the dimension is joined as Spark sees fit for its size.
    """
    hosts = df.select(url).distinct().withColumn("name", F.explode(urls.host_suffixes(urls.host_of(F.col(url)))))
    hits = hosts.join(domain_index(sources), "name").groupBy(url).agg(F.max_by("domain", F.length("name")).alias("domain"))
    return df.join(hits, url, "left")


def gate(df: DataFrame, url: str, sources: DataFrame, contributor: tuple[str, str] | None = None) -> DataFrame:
    """The rows with domain, ok and reason: unknown source, contributor page, or ok."""
    resolved = resolve(df, url, sources)
    guest = urls.is_contributor(F.col(url), *contributor) if contributor else F.lit(False)
    reason = F.when(F.col("domain").isNull(), "unknown-source").when(guest, "contributor").otherwise("ok")
    return resolved.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok")


def first_useful(attempts: DataFrame, key: str, useful: int = USEFUL) -> DataFrame:
    """Of each page's attempts (priority, text) the first useful one, else the first short one that is no cache hit."""
    long_ = F.length("text") >= useful
    usable = attempts.where(F.col("text").isNotNull() & (long_ | (F.col("priority") < 3)))
    order = Window.partitionBy(key).orderBy(F.when(long_, 0).otherwise(1), "priority")
    return usable.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def capped(text: Column, cap: int = CAP) -> Column:
    """struct<text, truncated>: a text kept to its cap, and whether that cut it."""
    cut = F.length(text) > cap
    return F.struct(F.when(cut, F.concat(F.substring(text, 1, cap), F.lit("\n[...]"))).otherwise(text).alias("text"), cut.alias("truncated"))


def item_text(extracted: Column, snippet: Column, least: int = SNIPPET) -> Column:
    """The extracted text, else a snippet that is long enough, else null."""
    return F.coalesce(F.when(extracted != "", extracted), F.when(F.length(snippet) >= least, snippet))


def fresh_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items that are new by URL and, within their source, by content hash; of equal new ones the first.

    ``items`` has url, source_domain, content and a position ``at``; ``stored`` url, source_domain, content_hash.
    """
    hashed = items.withColumn("content_hash", tx.content_hash(F.col("content")))
    once = hashed.withColumn("u", F.row_number().over(Window.partitionBy("url").orderBy("at"))).where("u = 1")
    once = once.withColumn("h", F.row_number().over(Window.partitionBy("source_domain", "content_hash").orderBy("at"))).where("h = 1").drop("u", "h")
    new = once.join(stored.select("url").distinct(), "url", "left_anti")
    return new.join(stored.select("source_domain", "content_hash").distinct(), ["source_domain", "content_hash"], "left_anti")


def ingest(items: DataFrame, stored: DataFrame, sources: DataFrame, contributor: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new articles, one row of counts) of a batch of feed items (url, title, author, published_at, extracted, snippet, at)."""
    gated = gate(items.where(F.col("url").isNotNull() & F.col("title").isNotNull()), "url", sources, contributor)
    texts = gated.withColumn("content", item_text(F.col("extracted"), F.col("snippet")))
    usable = texts.where(F.col("ok") & F.col("content").isNotNull()).withColumn("source_domain", F.col("domain"))
    new = fresh_items(usable.select("url", "source_domain", "title", "author", "published_at", "content", "at"), stored)
    new = new.withColumn("id", F.sha2(F.col("url"), 256)).withColumn("entities", F.lit(None).cast("array<string>"))
    counts = texts.agg(F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(F.col("ok") & F.col("content").isNull()).alias("empty"))
    return new, counts.crossJoin(new.agg(F.count("*").alias("stored")))


def archive_hits(hits: DataFrame, query: str, limit: int, sources: int) -> DataFrame:
    """Archive listings (url, stamp) that hold a keyword of the query (three of at least three letters), the latest of each domain, then over all."""
    words = [w.lower() for w in query.split() if len(w) >= 3][:3]
    wanted = hits.where(F.lit(not words) | F.greatest(*[F.contains(F.lower("url"), F.lit(w)) for w in [*words, *words]][: max(2, 2 * len(words))])) if words else hits
    each = -(-min(limit, 50) // max(1, sources))
    host = urls.host_of(F.col("url"))
    ranked = wanted.withColumn("rn", F.row_number().over(Window.partitionBy(host).orderBy(F.desc("stamp"), "url"))).where(F.col("rn") <= each)
    return ranked.orderBy(F.desc("stamp"), "url").limit(min(limit, 50)).drop("rn")


def archive_union(listings: list[DataFrame]) -> DataFrame:
    """The archive listings (url, stamp) of several sources in one; those that could not be had are null, and left out."""
    return reduce(DataFrame.unionByName, [x.select("url", "stamp") for x in listings if x is not None]).where("url is not null").distinct()


def archive_ingest(listings: list[DataFrame], pages: DataFrame, stored: DataFrame, sources: DataFrame, query: str, limit: int = 50, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(new articles, one row found, ingested) of archived pages: the listings' hits for the query, with
    the text of ``pages`` (url, title, text) where it has at least ``least`` characters, new by URL and hash."""
    hits = archive_hits(archive_union(listings), query, limit, len(listings))
    gated = gate(hits.join(pages.select("url", "title", "text").dropDuplicates(["url"]), "url", "left"), "url", sources)
    usable = gated.where(F.col("ok") & (F.length("text") >= least))
    new = fresh_items(usable.select("url", F.col("domain").alias("source_domain"), "title", F.col("text").alias("content"), "stamp", F.col("stamp").alias("at")), stored)
    counts = hits.agg(F.count("*").alias("found")).crossJoin(new.agg(F.count("*").alias("ingested")))
    return new.drop("at"), counts


def fetched_pages(urls_in: DataFrame, fetchers: list[Callable[[str, float], str | None]], timeouts: list[float] | None = None, concurrency: int = 8, useful: int = USEFUL) -> DataFrame:
    """(url, text, way, error) of every url: the fetchers (direct, archive, cache) are tried in order, each
    with its seconds, until one gives a useful text; else the longest that came. Errors are values."""
    seconds = timeouts or [15.0, 20.0, 20.0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                best, way, errors = None, None, []
                for n, fetch in enumerate(fetchers):
                    try:
                        text = main_text(fetch(url, seconds[min(n, len(seconds) - 1)]))
                    except Exception as e:  # a page that fails must not end the batch
                        errors.append(f"{type(e).__name__}: {e}")
                        continue
                    if text and len(text) > len(best or ""):
                        best, way = text, n
                    if best and len(best) >= useful:
                        break
                rows.append((url, best, way, "; ".join(errors) or None))
            yield pd.DataFrame(rows, columns=["url", "text", "way", "error"]).astype({"way": "Int64"})

    return urls_in.select("url").distinct().repartition(concurrency, "url").mapInPandas(run, "url string, text string, way bigint, error string")


def new_clusters(attached: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attached with every article in a cluster, the clusters to insert): an article that joined none
    begins one, named after it. Articles of one batch that belong together meet in the merge cycle."""
    named = attached.withColumn("topic_cluster_id", F.coalesce("topic_cluster_id", F.sha2(F.concat(F.lit("cluster:"), "id"), 256)))
    begun = named.where(F.col("matched_by") == "new").select("id", "topic_cluster_id").join(articles.select("id", "title", "ingested"), "id")
    clusters = begun.select(F.col("topic_cluster_id").alias("id"), F.col("title").alias("canonical_title"), F.lit("world").alias("section"), F.col("ingested").alias("last_updated_at"))
    return named, clusters


def links_articles(urls_in: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (pos, url) in their order with the stored article, where the source is known and one is stored; others are to be fetched."""
    gated = gate(urls_in, "url", sources)
    joined = gated.where("ok").join(articles.select("url", "id", "title").dropDuplicates(["url"]), "url", "left")
    return joined.select("pos", "url", "domain", "id", "title", F.col("id").isNull().alias("fetch"))
