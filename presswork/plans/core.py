"""Queries of the document model over the fixture tables, each with the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions import entities as en
from presswork.functions import stories as st
from presswork.functions import text as tx
from presswork.functions import urls
from presswork.functions import vectors as vc
from presswork.operators import clusters as cl
from presswork.operators import ingest, search, store, stories
from presswork.plans import views
from presswork.plans.views import ART, FOLD, NOW_SQL, stamp, stamp_sql
from presswork.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOPIC, WORDS = "housing code", "ballot measure and the toll road"
SEARCH_H = 24 * 365


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scans, projections, filters


@query("SELECT domain, display_name FROM sources WHERE is_active ORDER BY domain")
def active_sources(spark, d):
    return views.sources(spark, d).where("is_active").select("domain", "display_name")


@query("SELECT string_agg(domain || '=' || category, ';' ORDER BY domain) AS settings FROM sources")
def settings_map(spark, d):
    pivoted = views.sources(spark, d).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "category")))).alias("m"))
    return pivoted.select(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("settings"))


@query("SELECT id, headline FROM compiled_stories WHERE slug = (SELECT min(slug) FROM compiled_stories)")
def story_by_slug(spark, d):
    s = views.stories(spark, d)
    return s.join(s.agg(F.min("slug").alias("slug")), "slug", "left_semi").select("id", "headline")


@query(f"WITH {ART} SELECT id, {stamp_sql('ingested')} AS ingested FROM art WHERE ingested >= {NOW_SQL} - INTERVAL 336 HOURS")
def recent_articles(spark, d):
    a = views.articles(spark, d)
    return a.where(search.since(F.col("ingested"), views.now(), 336)).select("id", stamp("ingested").alias("ingested"))


@query(f"WITH {ART} SELECT id FROM art WHERE CAST(ingested AS DATE) > CAST({NOW_SQL} - INTERVAL 336 HOURS AS DATE)")
def recent_articles_by_date(spark, d):
    return views.articles(spark, d).where(search.since(F.col("ingested"), views.now(), 336, legacy_text_ts=True)).select("id")


@query(f"WITH {ART} SELECT id, {stamp_sql('ingested')} AS ingested FROM art WHERE len(entities) = 0 ORDER BY ingested, id LIMIT 200")
def articles_without_entities(spark, d):
    a = views.articles(spark, d, "entities").where(F.size("entities") == 0)
    return a.orderBy("ingested", "id").limit(200).select("id", stamp("ingested").alias("ingested"))


_HIT = f"contains({FOLD.format('title')}, '{TOPIC}')"


@query(f"""WITH {ART} SELECT id, source_domain, title, CAST({_HIT} AS INT) AS title_hit, {stamp_sql('ingested')} AS ingested FROM art
    WHERE ingested >= {NOW_SQL} - INTERVAL {SEARCH_H} HOURS AND ({_HIT} OR contains({FOLD.format('content')}, '{TOPIC}')) ORDER BY title_hit DESC, art.ingested DESC, id LIMIT 30""")
def search_ranked(spark, d):
    a = views.articles(spark, d, "title", "content", "source_domain", "url")
    return search.search(a, TOPIC, views.now(), SEARCH_H, 30).select("id", "source_domain", "title", "title_hit", stamp("ingested").alias("ingested"))


@query(f"""WITH {ART} SELECT id, source_domain FROM art WHERE ingested >= {NOW_SQL} - INTERVAL {SEARCH_H} HOURS AND source_domain IN ('unionchronicle.test', 'valleymonitor.test')
    AND ({FOLD.format('title')} LIKE '%port%trust%' OR {FOLD.format('content')} LIKE '%port%trust%') ORDER BY ({FOLD.format('title')} LIKE '%port%trust%') DESC, ingested DESC, id LIMIT 20""")
def search_in_sources_with_wildcards(spark, d):
    a = views.articles(spark, d, "title", "content", "source_domain", "url")
    return search.search(a, "port%trust", views.now(), SEARCH_H, 20, ["unionchronicle.test", "valleymonitor.test"], wildcards=True).select("id", "source_domain")


@query(f"""WITH {ART} SELECT title, arg_max(source_domain, (ingested, id)) AS source_domain, {stamp_sql('max(ingested)')} AS latest FROM art
    WHERE contains({FOLD.format('title')}, 'water') GROUP BY title ORDER BY max(ingested) DESC, title LIMIT 8""")
def suggestions(spark, d):
    return search.suggest(views.articles(spark, d, "title", "source_domain"), " Water ").select("title", "source_domain", stamp("latest").alias("latest"))


@query("SELECT title, source_domain FROM articles LIMIT 0")
def suggestions_too_short(spark, d):
    return search.suggest(views.articles(spark, d, "title", "source_domain"), " w ").select("title", "source_domain")


@query(f"""WITH {ART}, r AS (SELECT id, source_domain, row_number() OVER (ORDER BY {_HIT} DESC, ingested DESC, id) AS pos FROM art
      WHERE ingested >= {NOW_SQL} - INTERVAL {SEARCH_H} HOURS AND ({_HIT} OR contains({FOLD.format('content')}, '{TOPIC}')) QUALIFY pos <= 30),
    p AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY pos) AS rn, min(pos) OVER (PARTITION BY source_domain) AS seen FROM r)
    SELECT id, source_domain, CAST(row_number() OVER (ORDER BY (rn > 1), seen, rn) AS INT) AS pick FROM p QUALIFY pick <= 8""")
def diverse_selection(spark, d):
    a = views.articles(spark, d, "title", "content", "source_domain", "url")
    ranked = search.search(a, TOPIC, views.now(), SEARCH_H, 30).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("title_hit"), F.desc("ingested"), "id")))
    return search.diverse(ranked, "pos", 8).select("id", "source_domain", "pick")


@query()
def query_selection(spark, d):
    a = views.articles(spark, d, "title", "content", "source_domain", "url")
    return search.assemble_query(a, "margin quarrel", views.now(), SEARCH_H).select("id", "source_domain", "pick")


@query()
def freeform_selection(spark, d):
    a = views.articles(spark, d, "title", "content", "source_domain", "url")
    topics = ["ballot measure", "the toll road"]
    return search.assemble_freeform(a, WORDS, topics, views.now(), SEARCH_H).select("id", "source_domain", "topic", "pick")


# --- sources and ingestion


@query("""WITH n AS (SELECT lower(domain) AS name, domain FROM sources UNION ALL SELECT lower(unnest(aliases)), domain FROM sources),
    i AS (SELECT name, max(domain) AS domain FROM n GROUP BY name),
    u AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM articles)
    SELECT u.url, (SELECT arg_max(i.domain, length(i.name)) FROM i WHERE u.host = i.name OR ends_with(u.host, '.' || i.name)) AS domain FROM u""")
def resolved_sources(spark, d):
    return ingest.resolve(table(spark, d, "articles").select("url").distinct(), "url", views.sources(spark, d)).select("url", "domain")


@query("""WITH n AS (SELECT domain AS name, domain FROM sources WHERE is_active UNION ALL SELECT unnest(aliases), domain FROM sources WHERE is_active),
    u AS (SELECT DISTINCT url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM articles),
    r AS (SELECT url, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE u.host = n.name OR ends_with(u.host, '.' || n.name)) THEN 'unknown-source'
      WHEN ends_with(u.host, 'valleymonitor.test') AND contains(path, '/tech/') THEN 'contributor' ELSE 'ok' END AS reason FROM u)
    SELECT reason, count(*) AS urls FROM r GROUP BY reason""")
def gate_reasons(spark, d):
    active = views.sources(spark, d).where("is_active")
    return ingest.gate(table(spark, d, "articles").select("url").distinct(), "url", active, ("valleymonitor.test", "/tech/")).groupBy("reason").agg(F.count("*").alias("urls"))


@query("SELECT domain, display_name FROM sources WHERE category = 'business'")
def seeded_sources(spark, d):
    s = views.sources(spark, d)
    return store.insert_new(s.where("category <> 'business'"), s, ["domain"]).select("domain", "display_name")


_SPACES = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


@query(f"SELECT id, sha256(trim(regexp_replace(content, '{_SPACES}', ' ', 'g'))) AS content_hash FROM (SELECT DISTINCT ON (id) id, content FROM articles)")
def content_hashes(spark, d):
    return table(spark, d, "articles").select("id", "content").dropDuplicates(["id"]).select("id", tx.content_hash(F.col("content")).alias("content_hash"))


@query(r"""WITH a AS (SELECT DISTINCT ON (id) id, url, source_domain, sha256(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS h FROM articles),
    old AS (SELECT * FROM a WHERE source_domain < 'm'), o AS (SELECT *, row_number() OVER (PARTITION BY source_domain, h ORDER BY id) AS n FROM a)
    SELECT id FROM o WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.url = o.url) AND NOT EXISTS (SELECT 1 FROM old WHERE old.source_domain = o.source_domain AND old.h = o.h)""")
def fresh_items(spark, d):
    a = table(spark, d, "articles").select("id", "url", "source_domain", "content").dropDuplicates(["id"]).withColumn("at", F.col("id"))
    old = a.where("source_domain < 'm'").withColumn("content_hash", tx.content_hash(F.col("content")))
    return ingest.fresh_items(a, old).select("id")


@query("""SELECT doc_id, CASE WHEN doc_kind <> 'snippet' AND text <> '' THEN 'extracted' WHEN length(text) >= 50 THEN 'snippet' ELSE 'none' END AS used FROM documents""")
def item_texts(spark, d):
    t = table(spark, d, "documents")
    got = ingest.item_text(F.when(F.col("doc_kind") != "snippet", F.col("text")), F.col("text"))
    kind = F.when((F.col("doc_kind") != "snippet") & (F.col("text") != ""), "extracted").when(got.isNotNull(), "snippet").otherwise("none")
    return t.select("doc_id", kind.alias("used"))


@query("""WITH t AS (SELECT doc_id // 3 AS page, (doc_id % 3) + 1 AS priority, text FROM documents), u AS (SELECT * FROM t WHERE text IS NOT NULL AND (length(text) >= 300 OR priority < 3))
    SELECT page, CAST(priority AS INT) AS priority, CAST(length(text) AS INT) AS chars FROM u QUALIFY row_number() OVER (PARTITION BY page ORDER BY (length(text) < 300), priority) = 1""")
def first_useful_text(spark, d):
    t = table(spark, d, "documents").select(F.expr("doc_id div 3").alias("page"), (F.col("doc_id") % 3 + 1).cast("int").alias("priority"), "text")
    return ingest.first_useful(t, "page").select("page", "priority", F.length("text").alias("chars"))


@query("SELECT doc_id, length(text) > 3000 AS truncated, CAST(CASE WHEN length(text) > 3000 THEN 3006 ELSE length(text) END AS INT) AS chars FROM documents WHERE text IS NOT NULL")
def capped_texts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", ingest.capped(F.col("text"), 3000).alias("x"))
    return t.select("doc_id", F.col("x.truncated").alias("truncated"), F.length("x.text").alias("chars"))


@query("""SELECT s.domain, coalesce(n.display_name, s.display_name) AS display_name, coalesce(n.credibility_score, s.credibility_score) AS credibility_score, s.category FROM sources s
    LEFT JOIN (SELECT domain, upper(display_name) AS display_name, 70.0 AS credibility_score FROM sources WHERE bias_rating = 'center') n USING (domain)
    UNION ALL SELECT 'new.example', 'new.example', 70.0, NULL""")
def upserted_sources(spark, d):
    s = views.sources(spark, d)
    typed = s.where("bias_rating = 'center'").select("domain", F.upper("display_name").alias("display_name"))
    typed = typed.unionByName(spark.createDataFrame([("https://www.NEW.example/feed", None)], "domain string, display_name string"))
    return store.upsert(s, store.user_sources(typed), "domain", ["display_name", "credibility_score", "factual_reporting", "bias_rating", "notes"]).select("domain", "display_name", "credibility_score", "category")


@query("SELECT domain FROM sources UNION ALL SELECT 'other.example'")
def sources_after_delete(spark, d):
    """Two sources that a user added, of which one is deleted again; one of the given sources, which is not."""
    typed = spark.createDataFrame([("https://www.NEW.example/feed",), ("other.example",)], "domain string")
    every = store.upsert(views.sources(spark, d), store.user_sources(typed), "domain", [])
    return store.delete_user_source(store.delete_user_source(every, "New.example"), "UnionChronicle.test").select("domain")


@query("SELECT s.id, s.reused_count + coalesce(h.n, 0) AS reused_count FROM compiled_stories s LEFT JOIN (SELECT compiled_story_id AS id, count(*) AS n FROM synthesis_history GROUP BY 1) h USING (id)")
def reuse_counters(spark, d):
    hits = table(spark, d, "synthesis_history").select(F.col("compiled_story_id").alias("id")).where("id is not null")
    return store.count_hits(views.stories(spark, d), hits).select("id", "reused_count")


@query("SELECT source_mode AS key, arg_max(query_text, (created_at, id)) AS value FROM synthesis_history GROUP BY 1")
def latest_settings(spark, d):
    h = table(spark, d, "synthesis_history").select(F.col("source_mode").alias("key"), F.col("query_text").alias("value"), F.struct("created_at", "id").alias("at"))
    return store.latest_value(h.limit(0), h, "key", "at").select("key", "value")


@query("""SELECT c.id, coalesce(u.section, c.section) AS section FROM topic_clusters c LEFT JOIN (SELECT topic_cluster_id AS id, 'told' AS section FROM compiled_stories WHERE topic_cluster_id IS NOT NULL GROUP BY 1) u USING (id)""")
def updated_by_key(spark, d):
    changes = views.stories(spark, d).where("topic_cluster_id is not null").select(F.col("topic_cluster_id").alias("id")).distinct().withColumn("section", F.lit("told"))
    return store.update_by_key(views.clusters(spark, d), changes, "id").select("id", "section")


# --- clusters


@query(f"""WITH {ART}, x AS (SELECT topic_cluster_id AS c, embedding AS e FROM art WHERE topic_cluster_id IS NOT NULL AND len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY topic_cluster_id ORDER BY ingested, id) <= 20),
    u AS (SELECT c, unnest(e) AS v, unnest(range(1, 65)) AS i FROM x), m AS (SELECT c, i, avg(v) AS v FROM u GROUP BY c, i)
    SELECT c AS topic_cluster_id, CAST(i AS INT) AS place, round(v, 6) + 0.0 AS value FROM m""")
def cluster_centroids(spark, d):
    c = cl.centroids(views.articles(spark, d, "topic_cluster_id", "embedding"))
    return c.select("topic_cluster_id", F.posexplode("centroid").alias("i", "v")).select("topic_cluster_id", (F.col("i") + 1).alias("place"), (F.round("v", 6) + 0.0).alias("value"))


_CENTRES = f"""{ART}, r AS (SELECT id FROM topic_clusters WHERE last_updated_at >= {NOW_SQL} - INTERVAL 1000 HOURS),
    x AS (SELECT topic_cluster_id AS c, embedding AS e FROM art WHERE topic_cluster_id IN (SELECT id FROM r) AND len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY topic_cluster_id ORDER BY ingested, id) <= 20),
    u AS (SELECT c, unnest(e) AS v, unnest(range(1, 65)) AS i FROM x), m AS (SELECT c, i, avg(v) AS v FROM u GROUP BY c, i), z AS (SELECT c, list(v ORDER BY i) AS e FROM m GROUP BY c),
    q AS (SELECT id, embedding, entities FROM art WHERE ingested >= {NOW_SQL} - INTERVAL 336 HOURS),
    near AS (SELECT q.id, z.c, round(coalesce(list_cosine_similarity(q.embedding, z.e), 0), 9) AS s FROM q JOIN z ON len(q.embedding) = 64 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY s DESC, z.c) = 1)"""


def _recent(spark, d):
    a = views.articles(spark, d, "topic_cluster_id", "embedding", "entities")
    live = views.clusters(spark, d).where(F.col("last_updated_at") >= views.now() - F.expr("INTERVAL 1000 HOURS")).select(F.col("id").alias("topic_cluster_id"))
    members = a.join(live, "topic_cluster_id", "left_semi")
    return a.where(F.col("ingested") >= views.now() - F.expr("INTERVAL 336 HOURS")), members


@query(f"WITH {_CENTRES} SELECT near.id, c AS topic_cluster_id, round(s, 6) AS similarity FROM near JOIN q USING (id) WHERE list_sum(list_transform(q.embedding, lambda x: x * x)) > 0")
def nearest_centroids(spark, d):
    new, members = _recent(spark, d)
    usable = new.where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))
    return cl.best_centroid(usable, cl.centroids(members)).select("id", "topic_cluster_id", F.round("similarity", 6).alias("similarity"))


_MEMBERS = "em AS (SELECT DISTINCT topic_cluster_id AS c, unnest(entities) AS entity FROM art WHERE topic_cluster_id IN (SELECT id FROM r))"
_SHARED = """eo AS (SELECT q.id, em.c, count(*) FILTER (WHERE em.entity LIKE '$%') AS tickers, count(*) FILTER (WHERE em.entity NOT LIKE '$%') AS proper_nouns
    FROM (SELECT DISTINCT id, unnest(entities) AS entity FROM q) q JOIN em ON q.entity = em.entity GROUP BY 1, 2 HAVING tickers >= 1 OR proper_nouns >= 2)"""


@query(f"WITH {_CENTRES}, {_MEMBERS}, {_SHARED} SELECT id, c AS topic_cluster_id, tickers, proper_nouns, tickers * 10 + proper_nouns AS score FROM eo")
def entity_overlaps(spark, d):
    new, members = _recent(spark, d)
    return cl.entity_overlaps(new, cl.cluster_entities(members))


@query(f"""WITH {_CENTRES}, {_MEMBERS}, {_SHARED}, be AS (SELECT id, c FROM eo QUALIFY row_number() OVER (PARTITION BY id ORDER BY tickers * 10 + proper_nouns DESC, c) = 1)
    SELECT q.id, CASE WHEN near.s >= 0.74 THEN near.c ELSE be.c END AS topic_cluster_id, CASE WHEN near.s >= 0.74 THEN 'vector' WHEN be.c IS NOT NULL THEN 'entity' ELSE 'new' END AS matched_by
    FROM q LEFT JOIN near ON q.id = near.id LEFT JOIN be ON q.id = be.id""")
def attached_batch(spark, d):
    new, members = _recent(spark, d)
    return cl.attach_batch(new, cl.centroids(members), cl.cluster_entities(members)).select("id", "topic_cluster_id", "matched_by")


@query()
def attached_online(spark, d):
    a = views.articles(spark, d, "embedding", "entities", "source_domain")
    recent = a.where(F.col("ingested") >= views.now() - F.expr("INTERVAL 1440 HOURS"))
    return cl.attach_online(recent).select("id", "topic_cluster_id", F.round("similarity", 6).alias("similarity"), "matched_by")


@query("WITH a AS (SELECT DISTINCT ON (id) * FROM articles) SELECT topic_cluster_id, count(DISTINCT entity) AS entities FROM (SELECT topic_cluster_id, unnest(entities) AS entity FROM a WHERE topic_cluster_id IS NOT NULL) GROUP BY 1")
def cluster_entity_counts(spark, d):
    return cl.cluster_entities(views.articles(spark, d, "topic_cluster_id", "entities")).groupBy("topic_cluster_id").agg(F.count("*").alias("entities"))


@query("SELECT DISTINCT topic_cluster_id, entity FROM (SELECT topic_cluster_id, unnest(entities) AS entity FROM articles WHERE topic_cluster_id IS NOT NULL) WHERE entity IS NOT NULL")
def cluster_entity_rows(spark, d):
    return cl.cluster_entities(views.articles(spark, d, "topic_cluster_id", "entities")).select("topic_cluster_id", "entity")


_SNAP = f"""{ART}, n AS (SELECT topic_cluster_id AS id, count(*) AS articles FROM art WHERE topic_cluster_id IS NOT NULL GROUP BY 1),
    l AS (SELECT topic_cluster_id AS id, entities FROM art WHERE topic_cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic_cluster_id ORDER BY ingested DESC, id) <= 50),
    e AS (SELECT DISTINCT id, unnest(entities) AS entity FROM l)"""


@query(f"WITH {_SNAP} SELECT c.id, coalesce(n.articles, 0) AS articles, CAST((SELECT count(*) FROM e WHERE e.id = c.id) AS INT) AS entities FROM topic_clusters c LEFT JOIN n ON n.id = c.id")
def cluster_snapshot(spark, d):
    s = cl.snapshot(views.articles(spark, d, "topic_cluster_id", "entities"), views.clusters(spark, d))
    return s.select("id", "articles", F.size("entities").alias("entities"))


@query(f"""WITH {_SNAP}, f AS (SELECT e.id, e.entity, c.last_updated_at AS at FROM e JOIN topic_clusters c ON c.id = e.id)
    SELECT x.id AS a, y.id AS b, count(*) FILTER (WHERE x.entity LIKE '$%') AS tickers, count(*) FILTER (WHERE x.entity NOT LIKE '$%') AS proper_nouns FROM f x JOIN f y ON x.entity = y.entity AND x.id < y.id
    WHERE abs(epoch_us(x.at) - epoch_us(y.at)) <= 72 * 3600000000 GROUP BY 1, 2 HAVING tickers >= 1 OR proper_nouns >= 2""")
def merge_candidates(spark, d):
    return cl.merge_candidates(cl.snapshot(views.articles(spark, d, "topic_cluster_id", "entities"), views.clusters(spark, d)))


@query()
def merged_clusters(spark, d):
    snap = cl.snapshot(views.articles(spark, d, "topic_cluster_id", "entities"), views.clusters(spark, d))
    return cl.greedy_merge(snap, cl.merge_candidates(snap, cap=15))


@query("WITH a AS (SELECT DISTINCT ON (id) * FROM articles) SELECT source_domain, arg_min(topic_cluster_id, (-n, f)) AS topic_cluster_id FROM (SELECT source_domain, topic_cluster_id, count(*) AS n, min(id) AS f FROM a WHERE topic_cluster_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def commonest_cluster(spark, d):
    a = views.articles(spark, d, "source_domain", "topic_cluster_id").where("topic_cluster_id is not null")
    counted = a.groupBy("source_domain", "topic_cluster_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return counted.groupBy("source_domain").agg(F.min_by("topic_cluster_id", F.struct(-F.col("n"), "first")).alias("topic_cluster_id"))


# --- work-lists and views


@query(f"""WITH {ART}, n AS (SELECT topic_cluster_id AS id, count(*) AS articles FROM art GROUP BY 1)
    SELECT c.id, n.articles FROM topic_clusters c JOIN n USING (id) WHERE c.id NOT IN (SELECT topic_cluster_id FROM compiled_stories WHERE topic_cluster_id IS NOT NULL) AND n.articles >= 2 ORDER BY n.articles DESC, c.last_updated_at DESC, c.id LIMIT 50""")
def backlog(spark, d):
    return stories.without_story(views.clusters(spark, d), views.stories(spark, d), views.articles(spark, d, "topic_cluster_id"), 2, 50).select("id", "articles")


@query(f"""WITH {ART}, n AS (SELECT topic_cluster_id AS id, count(*) AS k FROM art GROUP BY 1)
    SELECT count(*) AS clusters FROM topic_clusters c JOIN n USING (id) WHERE n.k >= 2 AND c.id NOT IN (SELECT topic_cluster_id FROM compiled_stories WHERE topic_cluster_id IS NOT NULL)""")
def backlog_count(spark, d):
    c, s, a = views.clusters(spark, d), views.stories(spark, d), views.articles(spark, d, "topic_cluster_id")
    sizes = a.groupBy(F.col("topic_cluster_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")
    return c.join(s.select(F.col("topic_cluster_id").alias("id")), "id", "left_anti").join(sizes, "id").agg(F.count("*").alias("clusters"))


@query(f"""WITH {ART}, t AS (SELECT id, section FROM topic_clusters WHERE last_updated_at >= {NOW_SQL} - INTERVAL 8760 HOURS QUALIFY row_number() OVER (PARTITION BY section ORDER BY last_updated_at DESC, id) <= 20),
    l AS (SELECT topic_cluster_id AS id, max(refreshed_at) AS told FROM compiled_stories WHERE topic_cluster_id IS NOT NULL GROUP BY 1),
    k AS (SELECT t.id, t.section, l.told, (SELECT count(*) FROM art WHERE art.topic_cluster_id = t.id AND art.ingested > l.told) AS new_articles FROM t LEFT JOIN l USING (id))
    SELECT id, section, new_articles, CASE WHEN told IS NULL THEN 'compile' WHEN new_articles >= 3 OR (epoch_us({NOW_SQL}) - epoch_us(told) >= 6 * 3600000000 AND new_articles > 0) THEN 'refresh' ELSE 'skip' END AS decision FROM k""")
def front_page_worklist(spark, d):
    f = stories.freshness(views.clusters(spark, d), views.stories(spark, d), views.articles(spark, d, "topic_cluster_id"), views.now(), 8760, 20)
    return f.select("id", "section", "new_articles", "decision")


@query("SELECT topic_cluster_id, id FROM compiled_stories WHERE topic_cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic_cluster_id ORDER BY refreshed_at DESC, id) = 1")
def latest_story(spark, d):
    return stories.latest_per(views.stories(spark, d), "topic_cluster_id", "refreshed_at").select("topic_cluster_id", "id")


@query(f"WITH {ART} SELECT topic_cluster_id, id, CAST(row_number() OVER (PARTITION BY topic_cluster_id ORDER BY ingested DESC, id) AS INT) AS rn FROM art WHERE topic_cluster_id IS NOT NULL QUALIFY rn <= 8")
def latest_articles(spark, d):
    return stories.latest_per(views.articles(spark, d, "topic_cluster_id"), "topic_cluster_id", "ingested", n=8).select("topic_cluster_id", "id", "rn")


@query("SELECT section, id FROM topic_clusters QUALIFY row_number() OVER (PARTITION BY section ORDER BY last_updated_at DESC, id) <= 4")
def clusters_by_section(spark, d):
    return stories.latest_per(views.clusters(spark, d), "section", "last_updated_at", n=4).select("section", "id")


@query("SELECT id, slug FROM compiled_stories ORDER BY refreshed_at DESC, id LIMIT 8")
def recent_stories(spark, d):
    return views.stories(spark, d).orderBy(F.desc("refreshed_at"), "id").limit(8).select("id", "slug")


@query("SELECT id, query_text FROM synthesis_history ORDER BY created_at DESC, id LIMIT 20")
def recent_history(spark, d):
    return table(spark, d, "synthesis_history").orderBy(F.desc("created_at"), "id").limit(20).select("id", "query_text")


_QUERY_STORY = "SELECT * FROM compiled_stories WHERE headline_embedding IS NOT NULL AND len(headline_embedding) = 64 ORDER BY refreshed_at DESC, id LIMIT 1"


@query(f"""WITH q AS ({_QUERY_STORY}), c AS (SELECT * FROM compiled_stories WHERE headline_embedding IS NOT NULL AND refreshed_at >= {NOW_SQL} - INTERVAL 8760 HOURS ORDER BY refreshed_at DESC, id LIMIT 50)
    SELECT c.id, c.slug, round(coalesce(CASE WHEN len(c.headline_embedding) = 64 THEN list_cosine_similarity(c.headline_embedding, q.headline_embedding) END, 0), 6) AS similarity FROM c, q WHERE similarity >= 0.88 ORDER BY similarity DESC, c.refreshed_at DESC, c.id LIMIT 1""")
def reusable_story(spark, d):
    s = views.stories(spark, d)
    asked = s.where(F.size("headline_embedding") == 64).orderBy(F.desc("refreshed_at"), "id").select("headline_embedding").first()  # one request's vector
    return stories.reusable_by_vector(s, asked[0] if asked else [], views.now(), 8760).select("id", "slug", "similarity")


@query(f"""WITH k AS (SELECT links_hash AS h FROM compiled_stories WHERE links_hash IS NOT NULL ORDER BY refreshed_at DESC, id LIMIT 1)
    SELECT id, CAST(floor((epoch_us({NOW_SQL}) - epoch_us(refreshed_at)) / 1000000) AS BIGINT) AS age_seconds FROM compiled_stories, k WHERE links_hash = h AND refreshed_at >= {NOW_SQL} - INTERVAL 8760 HOURS ORDER BY refreshed_at DESC, id LIMIT 1""")
def reusable_by_links(spark, d):
    s = views.stories(spark, d)
    key = s.where("links_hash is not null").orderBy(F.desc("refreshed_at"), "id").select("links_hash").first()
    return stories.reusable_by_hash(s, F.lit(key[0] if key else None), views.now(), 8760).select("id", "age_seconds")


@query("""WITH l AS (SELECT id, unnest(source_domains) AS domain, unnest(range(len(source_domains))) AS pos FROM compiled_stories)
    SELECT l.id, string_agg(s.display_name, ', ' ORDER BY pos) AS names FROM l JOIN sources s USING (domain) GROUP BY 1""")
def story_sources(spark, d):
    return stories.source_refs(views.stories(spark, d), views.sources(spark, d)).select("id", F.array_join("names", ", ").alias("names"))


@query(f"""WITH {ART}, l AS (SELECT DISTINCT id, topic_cluster_id AS c, unnest(source_domains) AS domain FROM compiled_stories),
    n AS (SELECT topic_cluster_id AS c, source_domain AS domain, arg_max(url, (ingested, id)) AS url FROM art WHERE topic_cluster_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT source_domain AS domain, arg_max(url, (ingested, id)) AS url FROM art GROUP BY 1)
    SELECT l.id, l.domain, coalesce(n.url, o.url) AS url FROM l LEFT JOIN n ON n.c = l.c AND n.domain = l.domain LEFT JOIN o ON o.domain = l.domain""")
def story_links(spark, d):
    return stories.source_links(views.stories(spark, d), views.articles(spark, d, "topic_cluster_id", "source_domain", "url"))


@query("SELECT id, CASE WHEN len(list_intersect(source_domains, (SELECT list(domain) FROM sources WHERE category = 'business'))) > 0 THEN 'business' ELSE 'world' END AS section FROM compiled_stories")
def story_sections(spark, d):
    return stories.section_of(views.stories(spark, d), views.sources(spark, d))


@query("""WITH t AS (SELECT *, row_number() OVER (ORDER BY refreshed_at DESC, id) AS place FROM compiled_stories QUALIFY place <= 8),
    n AS (SELECT t.id, list(s.display_name ORDER BY l.pos) AS names FROM t, LATERAL (SELECT unnest(t.source_domains) AS domain, unnest(range(len(t.source_domains))) AS pos) l JOIN sources s ON s.domain = l.domain GROUP BY 1)
    SELECT CAST(place AS INT) AS place, CASE WHEN place = 1 THEN 'lead' ELSE 'side' END AS role, t.id, headline,
      CASE WHEN names IS NULL THEN '' WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 THEN names[1] || ' and ' || names[2] ELSE array_to_string(names[1:len(names)-1], ', ') || ', and ' || names[len(names)] END AS byline, coalesce(len(names), 0) <= 1 AS single_source
    FROM t LEFT JOIN n USING (id)""")
def front_page(spark, d):
    return stories.front_page(views.stories(spark, d), views.sources(spark, d)).select("place", "role", "id", "headline", "byline", "single_source")


@query(r"""WITH p AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(body, '\n{2,}'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')) AS p FROM compiled_stories)
    SELECT id, count(*) AS paragraphs, CAST(sum(len(regexp_extract_all(p, '\[\^[^\]]+\]'))) AS BIGINT) AS citations, CAST(sum(len(list_filter(regexp_extract_all(p, '\[\^[^\]]+\]'), lambda x: NOT contains(x, ',')))) AS BIGINT) AS single FROM p GROUP BY id""")
def story_tokens(spark, d):
    b = views.stories(spark, d).select("id", F.explode(st.blocks(F.col("body"))).alias("b"))
    cites = F.filter("b.tokens", lambda t: t["kind"] == "cite")
    return b.groupBy("id").agg(F.count("*").alias("paragraphs"), F.sum(F.size(cites)).alias("citations"), F.sum(F.size(F.filter(cites, lambda t: t["single"]))).alias("single"))


@query("""WITH c AS (SELECT id, lower(unnest(flatten(list_transform(claim_attributions, lambda x: x.attributedDomains)))) AS dom FROM compiled_stories UNION SELECT id, lower(unnest(source_domains)) FROM compiled_stories),
    b AS (SELECT c.id, count(*) AS n FROM c JOIN compiled_stories s ON s.id = c.id WHERE c.dom NOT IN (SELECT lower(domain) FROM sources WHERE is_active) OR NOT list_contains(list_transform(s.source_domains, lambda x: lower(x)), c.dom) GROUP BY 1)
    SELECT s.id, b.n IS NULL AS ok, CAST(coalesce(b.n, 0) AS INT) AS failures FROM compiled_stories s LEFT JOIN b USING (id)""")
def validated_stories(spark, d):
    return stories.checked(views.stories(spark, d), views.sources(spark, d).where("is_active")).select("id", "ok", F.size("failures").alias("failures"))


@query(r"SELECT id, len(list_filter(list_transform(regexp_split_to_array(body, '\n{2,}'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '' AND NOT regexp_matches(x, '\[\^[^\]]+\]'))) AS bare FROM compiled_stories")
def uncited_paragraphs(spark, d):
    return views.stories(spark, d).select("id", F.size(F.filter(st.paragraphs(F.col("body")), lambda p: ~st.has_citation(p))).cast("bigint").alias("bare"))


@query(r"""WITH a AS (SELECT DISTINCT ON (id) id, topic_cluster_id, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, content)), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4)) AS aw FROM articles),
    c AS (SELECT id, topic_cluster_id, unnest(range(len(claim_attributions))) AS n, unnest(claim_attributions).claimText AS t FROM compiled_stories),
    w AS (SELECT id, topic_cluster_id, n, list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4)) AS cw FROM c),
    s AS (SELECT w.id, w.n, max(coalesce(CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, aw)) / len(cw) WHEN cw IS NOT NULL THEN 1.0 END, 0)) AS best FROM w LEFT JOIN a ON a.topic_cluster_id = w.topic_cluster_id GROUP BY 1, 2)
    SELECT id, count(*) AS claims, count(*) FILTER (WHERE best < 0.6) AS ungrounded FROM s GROUP BY 1""")
def ungrounded_claims(spark, d):
    return stories.ungrounded(views.stories(spark, d), views.articles(spark, d, "topic_cluster_id", "title", "content"))


@query(f"""WITH {ART}, l AS (SELECT id, topic_cluster_id AS c, unnest(source_domains) AS domain, unnest(range(len(source_domains))) AS pos FROM compiled_stories),
    n AS (SELECT topic_cluster_id AS c, source_domain AS domain, arg_max(url, (ingested, id)) AS url FROM art WHERE topic_cluster_id IS NOT NULL GROUP BY 1, 2), o AS (SELECT source_domain AS domain, arg_max(url, (ingested, id)) AS url FROM art GROUP BY 1),
    r AS (SELECT l.id, string_agg(s.display_name, ', ' ORDER BY pos) AS names, string_agg(coalesce(n.url, o.url, 'https://' || l.domain), ' ' ORDER BY pos) AS urls, count(*) AS known, bool_or(s.category = 'business') AS b
      FROM l JOIN sources s ON s.domain = l.domain LEFT JOIN n ON n.c = l.c AND n.domain = l.domain LEFT JOIN o ON o.domain = l.domain GROUP BY 1)
    SELECT t.id, CASE WHEN b THEN 'business' ELSE 'world' END AS section, 'Compiled from ' || coalesce(names, '') AS byline, coalesce(urls, '') AS urls, coalesce(known, 0) <= 1 AS single_source FROM compiled_stories t LEFT JOIN r USING (id)""")
def story_views(spark, d):
    v = stories.story_views(views.stories(spark, d), views.articles(spark, d, "topic_cluster_id", "source_domain", "url"), views.sources(spark, d))
    return v.select("id", "section", "byline", F.coalesce(F.array_join("sources.url", " "), F.lit("")).alias("urls"), "single_source")


@query("SELECT id, canonical_title FROM topic_clusters WHERE lower(section) = 'world'")
def section_cards(spark, d):
    return stories.of_section(views.clusters(spark, d), " World ").select("id", "canonical_title")


@query("""WITH f AS (SELECT topic_cluster_id, string_agg(url, chr(13) || chr(10) || '  ' ORDER BY url) || chr(10) AS form FROM (SELECT DISTINCT topic_cluster_id, url FROM articles WHERE topic_cluster_id IS NOT NULL) GROUP BY 1)
    SELECT topic_cluster_id, array_to_string(list_filter(list_transform(regexp_split_to_array(form, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> ''), ' ') AS links FROM f""")
def form_links(spark, d):
    a = table(spark, d, "articles").where("topic_cluster_id is not null").groupBy("topic_cluster_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    form = F.concat(F.array_join("urls", "\r\n  "), F.lit("\n"))
    return a.select("topic_cluster_id", F.array_join(tx.form_lines(form), " ").alias("links"))


@query(r"""WITH u AS (SELECT DISTINCT topic_cluster_id AS c, url FROM articles WHERE topic_cluster_id IS NOT NULL), p AS (SELECT c, regexp_extract(url, '^(https?)://', 1) AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h,
      regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'ref_src')) AS q FROM u),
    k AS (SELECT DISTINCT c, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p)
    SELECT c AS topic_cluster_id, sha256(array_to_string(list_sort(list(url)), chr(10))) AS hash FROM k GROUP BY 1""")
def link_hashes(spark, d):
    a = table(spark, d, "articles").where("topic_cluster_id is not null").groupBy("topic_cluster_id").agg(F.collect_list("url").alias("urls"))
    return a.select("topic_cluster_id", urls.links_hash(F.col("urls")).alias("hash"))


@query("""WITH m AS (SELECT id, unnest(market_impacts) AS m, unnest(range(len(market_impacts))) AS pos FROM compiled_stories)
    SELECT id, m.ticker AS ticker, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(m.score) DESC, pos) AS INT) AS place,
      CASE WHEN abs(m.score) <= 20 THEN 'minor' WHEN abs(m.score) <= 50 THEN 'moderate' WHEN abs(m.score) <= 80 THEN 'significant' ELSE 'extreme' END AS label,
      CASE WHEN m.score >= 20 THEN 2 WHEN m.score > 0 THEN 1 WHEN m.score = 0 THEN 0 WHEN m.score > -20 THEN -1 ELSE -2 END AS band FROM m""")
def market_impacts(spark, d):
    m = views.stories(spark, d).select("id", F.posexplode("market_impacts").alias("pos", "m"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.abs("m.score")), "pos"))
    return m.select("id", F.col("m.ticker").alias("ticker"), place.alias("place"), tx.impact_label(F.col("m.score")).alias("label"), tx.impact_band(F.col("m.score")).alias("band"))


@query("SELECT category, string_agg(display_name, ', ' ORDER BY display_name) AS names, count(*) AS outlets FROM sources GROUP BY category")
def sources_by_category(spark, d):
    return views.sources(spark, d).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("display_name")), ", ").alias("names"), F.count("*").alias("outlets"))


@query("""SELECT '/' AS loc, 1.0 AS priority UNION ALL SELECT '/about', 0.5 UNION ALL SELECT * FROM (SELECT '/topic/' || slug, 0.7 FROM compiled_stories ORDER BY refreshed_at DESC, id LIMIT 1000)""")
def sitemap(spark, d):
    fixed = spark.createDataFrame([("/", 1.0), ("/about", 0.5)], "loc string, priority double")
    told = views.stories(spark, d).orderBy(F.desc("refreshed_at"), "id").limit(1000)
    return fixed.unionByName(told.select(F.concat(F.lit("/topic/"), "slug").alias("loc"), F.lit(0.7).alias("priority")))


@query("SELECT id, 'NewsArticle' AS kind, headline, deck, len(source_domains) AS sources FROM compiled_stories")
def story_export(spark, d):
    """Stories as linked-data objects, read back."""
    s = views.stories(spark, d)
    made = s.select("id", F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("headline"), F.col("deck").alias("description"), F.col("source_domains").alias("isBasedOn"))).alias("json"))
    read = F.from_json("json", "`@type` string, headline string, description string, isBasedOn array<string>")
    return made.select("id", read.alias("r")).select("id", F.col("r.`@type`").alias("kind"), "r.headline", F.col("r.description").alias("deck"), F.size("r.isBasedOn").cast("bigint").alias("sources"))


# --- archives, links, models


@query(f"""WITH {ART}, h AS (SELECT DISTINCT url, strftime(ingested, '%Y%m%d%H%M%S') AS stamp, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM art WHERE contains(lower(url), 'water') OR contains(lower(url), 'board')),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY stamp DESC, url) AS rn FROM h) SELECT url, stamp FROM r WHERE rn <= 7 ORDER BY stamp DESC, url LIMIT 50""")
def archive_listing(spark, d):
    hits = views.articles(spark, d, "url").select("url", F.date_format("ingested", "yyyyMMddHHmmss").alias("stamp")).distinct()
    return ingest.archive_hits(hits, "Water of Board", 50, 8)


@query("""WITH l AS (SELECT url, min(id) AS id FROM articles WHERE source_domain < 'f' GROUP BY url), u AS (SELECT source_domain, url, row_number() OVER (PARTITION BY source_domain ORDER BY url) AS pos FROM (SELECT DISTINCT source_domain, url FROM articles))
    SELECT CAST(u.pos AS INT) AS pos, u.url, l.id IS NULL AS fetch FROM u LEFT JOIN l USING (url)""")
def linked_articles(spark, d):
    a = table(spark, d, "articles").select("url", "id", "title", "source_domain")
    wanted = a.select("source_domain", "url").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("source_domain").orderBy("url"))).drop("source_domain")
    return ingest.links_articles(wanted, a.where("source_domain < 'f'"), views.sources(spark, d)).select("pos", "url", "fetch")


@query("SELECT id, headline, confidence FROM compiled_stories")
def parsed_answers(spark, d):
    s = views.stories(spark, d)
    answer = F.concat(F.lit("<think>plan</think>Here:\n```json\n"), F.to_json(F.struct("headline", "confidence")), F.lit("\n```"))
    return s.select("id", st.parse_answer(answer, "headline string, confidence double").alias("a")).select("id", "a.headline", "a.confidence")


@query("WITH m AS (SELECT min(id) AS victim, max(id) AS survivor FROM topic_clusters) SELECT DISTINCT a.id, CASE WHEN a.topic_cluster_id = m.victim THEN m.survivor ELSE a.topic_cluster_id END AS topic_cluster_id FROM articles a, m")
def repointed_articles(spark, d):
    merges = views.clusters(spark, d).agg(F.min("id").alias("victim"), F.max("id").alias("survivor"))
    return cl.repoint(table(spark, d, "articles").select("id", "topic_cluster_id").distinct(), merges)


@query("""WITH s AS (SELECT label, unnest(embedding) AS v, unnest(range(1, 65)) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM s GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY 1)
    SELECT vec_id, CAST(arg_max(c.label, (round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c), 9), -c.label)) AS INT) AS nearest FROM embeddings e, c GROUP BY vec_id""")
def nearest_labels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    centres = e.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("centroid")).select(F.lpad(F.col("label").cast("string"), 4, "0").alias("topic_cluster_id"), "centroid")
    best = cl.best_centroid(e.select(F.col("vec_id").alias("id"), "embedding"), centres)
    return best.select(F.col("id").alias("vec_id"), F.col("topic_cluster_id").cast("int").alias("nearest"))


@query("""WITH l AS (SELECT user_id, max(ts) AS told FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, count(*) FILTER (WHERE e.event_type <> 'purchase' AND e.ts > l.told) AS new FROM events e LEFT JOIN l USING (user_id) GROUP BY 1""")
def activity_since_refresh(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("told"))
    return e.join(last, "user_id", "left").groupBy("user_id").agg(F.count_if((F.col("event_type") != "purchase") & (F.col("ts") > F.col("told"))).alias("new"))


@query("SELECT domain, source_domain IS NOT NULL AS used FROM sources LEFT JOIN (SELECT DISTINCT source_domain FROM articles) ON source_domain = domain")
def used_sources(spark, d):
    used = table(spark, d, "articles").select("source_domain").distinct()
    return views.sources(spark, d).join(used, F.col("domain") == F.col("source_domain"), "left").select("domain", F.col("source_domain").isNotNull().alias("used"))


@query()
def compiled_offline(spark, d):
    a = views.articles(spark, d, "topic_cluster_id", "source_domain", "title", "content")
    work = stories.without_story(views.clusters(spark, d), views.stories(spark, d), a, 2, 50)
    from presswork.operators import models
    from presswork.plans import pipeline

    return models.synthesize(pipeline.requests_for(work, a, views.sources(spark, d))).select("id", "ok", F.size("answer.source_domains").alias("domains"))


@query()
def hashed_embeddings(spark, d):
    from presswork.operators import models

    a = table(spark, d, "articles").select("id", "title", "content").dropDuplicates(["id"])
    return a.select("id", F.round(models.embed_udf()(tx.excerpt(F.col("title"), F.col("content"), 600))[0], 6).alias("first"))


# --- scalar functions on whole columns


@query(r"""WITH u AS (SELECT DISTINCT url FROM articles), p AS (SELECT url, regexp_extract(url, '^(https?)://', 1) AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h,
      regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'ref_src')) AS q FROM u)
    SELECT url, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""")
def canonical_urls(spark, d):
    return table(spark, d, "articles").select("url").distinct().select("url", urls.canonical_url(F.col("url")).alias("canonical"))


@query("""WITH a AS (SELECT DISTINCT ON (id) * FROM articles), k AS (SELECT topic_cluster_id, lower(trim(regexp_replace(min(title), '\\s+', ' ', 'g'))) AS t, list_sort(list_distinct(list(lower(source_domain)))) AS ds FROM a WHERE topic_cluster_id IS NOT NULL GROUP BY 1)
    SELECT topic_cluster_id, sha256(t || chr(9247) || array_to_string(ds, chr(10))) AS hash FROM k""")
def compare_hashes(spark, d):
    a = views.articles(spark, d, "topic_cluster_id", "title", "source_domain").where("topic_cluster_id is not null")
    k = a.groupBy("topic_cluster_id").agg(F.min("title").alias("t"), F.collect_set("source_domain").alias("ds"))
    return k.select("topic_cluster_id", urls.compare_hash(F.col("t"), F.col("ds")).alias("hash"))


_SYMBOLS = "[" + ", ".join(f"'{x}'" for x in [*en.TICKER_STOP, *en.TICKER_BLOCK]) + "]"


@query(rf"""WITH a AS (SELECT id, title || ' $' || CASE WHEN id < '8' THEN 'QRS' ELSE 'CEO' END || ' (' || upper(substr(source_domain, 1, 3)) || ':XY) $TOOLONG $ABCx' AS t FROM (SELECT DISTINCT ON (id) * FROM articles)),
    f AS (SELECT id, list_concat(regexp_extract_all(t, '\$([A-Z]{{1,5}})\b', 1), regexp_extract_all(t, '\(([A-Z]{{1,5}})(?::[A-Z]+)?\)', 1)) AS s FROM a)
    SELECT id, array_to_string(list_sort(list_distinct(list_filter(s, lambda x: NOT list_contains({_SYMBOLS}, x)))), ',') AS tickers FROM f""")
def ticker_symbols(spark, d):
    a = table(spark, d, "articles").select("id", "title", "source_domain").dropDuplicates(["id"])
    t = F.concat("title", F.lit(" $"), F.when(F.col("id") < "8", "QRS").otherwise("CEO"), F.lit(" ("), F.upper(F.substring("source_domain", 1, 3)), F.lit(":XY) $TOOLONG $ABCx"))
    return a.select("id", F.array_join(en.tickers(t), ",").alias("tickers"))


_KINDS = f"""list_transform(list_filter(regexp_split_to_array(regexp_replace(content, '[^A-Za-z0-9_\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' | ', 'g'), '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+'), lambda w: w <> ''),
    lambda w: CASE WHEN regexp_full_match(w, '[A-Z][a-z][A-Za-z]*') THEN 'N' WHEN w IN {en.CONNECTORS} THEN 'c' ELSE 'x' END)"""


@query(f"WITH a AS (SELECT DISTINCT ON (id) id, content FROM articles) SELECT id, CAST(len(regexp_extract_all(array_to_string({_KINDS}, ''), '{en.NAME_RUN}')) AS INT) AS phrases FROM a")
def name_phrases(spark, d):
    a = table(spark, d, "articles").select("id", "content").dropDuplicates(["id"])
    return a.select("id", F.size(en.name_phrases(F.col("content"))).alias("phrases"))


@query()
def extracted_entities(spark, d):
    a = table(spark, d, "articles").select("id", "title", "content").dropDuplicates(["id"])
    return a.select("id", F.array_join(en.extract(tx.excerpt(F.col("title"), F.col("content"), 1500))["everything"], ";").alias("entities"))


@query("""WITH h AS (SELECT id, query_text || ' and harbour dues, vs. tariffs' AS q FROM synthesis_history), p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(q, '(?i)\\b(?:and|vs\\.?|versus|compared?\\s+to|compare|with|&)\\b|,'), lambda x: trim(x)), lambda x: length(x) >= 3) AS p, q FROM h)
    SELECT id, array_to_string(CASE WHEN len(p) > 0 THEN p ELSE [trim(q)] END, '|') AS topics FROM p""")
def query_topics(spark, d):
    q = F.concat("query_text", F.lit(" and harbour dues, vs. tariffs"))
    return table(spark, d, "synthesis_history").select("id", F.array_join(tx.sub_topics(q), "|").alias("topics"))


@query("SELECT id, array_to_string(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda x: length(x) >= 3), ' ') AS words FROM synthesis_history")
def query_keywords(spark, d):
    return table(spark, d, "synthesis_history").select("id", F.array_join(tx.keywords(F.col("query_text")), " ").alias("words"))


@query("""WITH t AS (SELECT id, regexp_replace(strip_accents(lower(headline)), '[^a-z0-9]+', '-', 'g') AS s FROM compiled_stories)
    SELECT id, substr(regexp_replace(s, '^-|-$', '', 'g'), 1, 70) || '-' || substr(id, 1, 6) AS slug FROM t""")
def story_slugs(spark, d):
    return views.stories(spark, d).select("id", tx.slug(F.col("headline"), 70, F.col("id")).alias("slug"))


@query(f"""SELECT id, strftime(refreshed_at, '%A, %B %-d, %Y') AS long_date, strftime(refreshed_at, '%H:%M') || ' UTC' AS clock, 'No. ' || lpad(CAST(dayofyear(refreshed_at) AS VARCHAR), 3, '0') AS issue,
    CAST(floor((epoch_us({NOW_SQL}) - epoch_us(refreshed_at)) / 1000000) AS BIGINT) AS age, strftime(refreshed_at, '%Y%m%d%H%M%S') AS wayback FROM compiled_stories""")
def story_dates(spark, d):
    at = F.col("refreshed_at")
    return views.stories(spark, d).select(
        "id", F.date_format(at, "EEEE, MMMM d, yyyy").alias("long_date"), F.date_format(at, "HH:mm 'UTC'").alias("clock"), tx.volume_issue(at)["issue"].alias("issue"),
        st.age_seconds(at, views.now()).alias("age"), tx.wayback_stamp(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).alias("wayback"),
    )


@query(r"SELECT id, least(greatest(coalesce(TRY_CAST(regexp_extract(query_text || ' 7', '^\s*([-+]?\d+)', 1) AS DOUBLE), 10), 1), 50) AS batch FROM synthesis_history")
def clamped_settings(spark, d):
    return table(spark, d, "synthesis_history").select("id", tx.number_setting(F.concat("query_text", F.lit(" 7")), 10, 1, 50).alias("batch"))


@query("SELECT domain, regexp_replace(domain, '\\.[^.]+$', '') AS label, lower(regexp_replace(regexp_replace(regexp_replace('https://www.' || domain || '/x/y', '^https?://', ''), '^www\\.', ''), '/.*$', '')) AS typed FROM sources")
def source_labels(spark, d):
    return views.sources(spark, d).select("domain", tx.short_label(F.col("domain")).alias("label"), urls.user_domain(F.concat(F.lit("https://www."), "domain", F.lit("/x/y"))).alias("typed"))


# --- the events table as a log of activity, and the relational tables


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS events, round(sum(value), 4) AS total, max(ts) FILTER (WHERE event_type = 'purchase') IS NOT NULL AS bought FROM events GROUP BY user_id""")
def activity_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("event_type") == "purchase").__gt__(0).alias("bought"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events")
def parsed_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@query("""SELECT n.n_name AS nation, count(*) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1""")
def revenue_by_nation(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
