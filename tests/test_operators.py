import json
from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from presswork import schema
from presswork.operators import clusters as cl
from presswork.operators import ingest, models, search, stories
from presswork.operators.store import Store, update_by_key, upsert
from presswork.plans import pipeline
from presswork.sources import feeds
from presswork.streaming import ingest as stream

NOW = datetime(2024, 1, 10)


def test_store_versions_and_unique_append(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = [("a", "https://x/1", "s", "t", "text")]
    df = spark.createDataFrame(row, "id string, url string, source_domain string, title string, content string")
    assert store.append("articles", df, ["url"]).count() == 1
    assert store.append("articles", df, ["url"]).count() == 0
    assert store.read("articles").count() == 1 and set(store.read("articles").columns) == {f.name for f in schema.empty(spark, "articles").schema}
    assert store.read("topic_clusters").count() == 0


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("b", 5), ("c", 7)], "k string, n int")
    assert sorted(map(tuple, upsert(old, new, "k", ["n"]).collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 7, None)]
    assert sorted(map(tuple, update_by_key(old, new, "k").collect())) == [("a", 1, "x"), ("b", 5, "y")]


def _items(spark):
    rows = [
        ("https://www.a.test/1", "T", "long enough text " * 5, None, 1),
        ("https://www.a.test/1", "T", "long enough text " * 5, None, 2),
        ("https://a.test/2", "T", "long  enough text " * 5, None, 3),
        ("https://b.test/3", "T", None, "s" * 60, 4),
        ("https://b.test/4", "T", None, "short", 5),
        ("https://other.example/5", "T", "text", None, 6),
        ("https://sub.alias.test/6", "T", "other", None, 7),
    ]
    return spark.createDataFrame([(u, t, None, None, e, s, a) for u, t, e, s, a in rows], "url string, title string, author string, published_at string, extracted string, snippet string, at int")


def _sources(spark):
    return spark.createDataFrame([("a.test", "A", ["alias.test"], "wire"), ("b.test", "B", [], "business")], "domain string, display_name string, aliases array<string>, category string")


def test_ingest_gates_and_deduplicates(spark):
    stored = spark.createDataFrame([], "url string, source_domain string, content_hash string")
    new, counts = ingest.ingest(_items(spark), stored, _sources(spark))
    assert {r["url"] for r in new.collect()} == {"https://www.a.test/1", "https://b.test/3", "https://sub.alias.test/6"}
    assert tuple(counts.first()) == (7, 1, 1, 3)
    again, _ = ingest.ingest(_items(spark), new.select("url", "source_domain", "content_hash"), _sources(spark))
    assert again.count() == 0


def test_first_useful(spark):
    rows = [(1, 1, "x" * 10), (1, 2, "y" * 400), (2, 1, "x" * 10), (2, 2, "z" * 20), (3, 3, "short"), (4, 3, "w" * 300), (5, 1, None)]
    got = ingest.first_useful(spark.createDataFrame(rows, "k int, priority int, text string"), "k").select("k", "priority").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1), (4, 3)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.sampled_from("abcd"), min_size=1, max_size=14))
def test_diverse_is_the_loop(spark, domains):
    rows = [(f"i{n}", d, n) for n, d in enumerate(domains)]
    got = [r["id"] for r in search.diverse(spark.createDataFrame(rows, "id string, source_domain string, pos int"), "pos", 8).orderBy("pick").collect()]
    groups: dict[str, list[str]] = {}
    for i, d, _ in rows:
        groups.setdefault(d, []).append(i)
    want = [g[0] for g in groups.values()] + [x for g in groups.values() for x in g[1:]]
    assert got == want[:8]


def test_greedy_merge_respects_the_cap(spark):
    base = datetime(2024, 1, 1)
    snap = spark.createDataFrame([("a", base, 8, ["$X"]), ("b", base - timedelta(hours=1), 6, ["$X"]), ("c", base - timedelta(hours=2), 4, ["$X"]), ("d", base - timedelta(hours=400), 1, ["$X"])], "id string, last_updated_at timestamp_ntz, articles int, entities array<string>")
    pairs = cl.merge_candidates(snap)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert [tuple(r) for r in cl.greedy_merge(snap, pairs).collect()] == [("b", "a")]
    moved = cl.repoint(spark.createDataFrame([("1", "b"), ("2", "c"), ("3", None)], "id string, topic_cluster_id string"), cl.greedy_merge(snap, pairs))
    assert {tuple(r) for r in moved.collect()} == {("1", "a"), ("2", "c"), ("3", None)}


def test_greedy_merge_of_a_chain_takes_no_round_a_link(spark, monkeypatch):
    written, stash = [], cl.stash
    monkeypatch.setattr(cl, "stash", lambda df: written.append(df) or stash(df))
    base, n = datetime(2024, 1, 1), 40
    # each pair waits for the one before it: every second one is beyond the cap once that is merged
    snap = spark.createDataFrame([(f"c{i:02d}", base - timedelta(hours=i), 6 if i % 2 else 5, []) for i in range(n)] + [("c00", base, 5, [])], "id string, last_updated_at timestamp_ntz, articles int, entities array<string>")
    pairs = spark.createDataFrame([(f"c{i:02d}", f"c{i + 1:02d}") for i in range(n - 1)] + [("c03", "c02"), ("c01", "c01")], "a string, b string")
    got = {tuple(r) for r in cl.greedy_merge(snap, pairs).collect()}
    assert got == {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(0, n, 2)}
    assert len(written) <= 3
    assert cl.greedy_merge(snap, pairs.where("a = 'none'")).collect() == []


def test_candidates_that_fit_the_cap_give_the_same_merges(spark):
    base = datetime(2024, 1, 1)
    snap = spark.createDataFrame([("a", base, 8, ["$X"]), ("b", base, 7, ["$X"]), ("c", base, 15, ["$X"]), ("d", base, 0, ["$X"]), ("e", base, 16, ["$X"])], "id string, last_updated_at timestamp_ntz, articles int, entities array<string>")
    fit = cl.merge_candidates(snap, cap=15)
    assert {(r["a"], r["b"]) for r in fit.collect()} == {("a", "b"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert set(cl.greedy_merge(snap, fit).collect()) == set(cl.greedy_merge(snap, cl.merge_candidates(snap)).collect())


def _stream_rows():
    rows = []
    for i in range(12):
        v = [1.0, 0.05 * (i % 3), 0.0] if i % 2 else [0.0, 0.05 * (i % 3), 1.0]
        rows.append((f"a{i:02d}", NOW + timedelta(hours=i), v if i != 5 else None, [f"name {i % 2} x", f"name {i % 2} y"] if i != 7 else None, "k"))
    return rows


SCHEMA = "id string, ingested timestamp_ntz, embedding array<double>, entities array<string>, section string"


def test_online_clusters(spark):
    got = cl.attach_online(spark.createDataFrame(_stream_rows(), SCHEMA), "section", hours=30).toPandas()
    assert got.topic_cluster_id.nunique() == 2 and (got.matched_by == "new").sum() == 2
    assert got.set_index("id").loc["a05", "matched_by"] == "entity"


def test_registered_clusters_cross_outlets(spark):
    from presswork.plans import registry, views

    data = "/root/testdata/sf0.01"
    outlet = {r["id"]: r["source_domain"] for r in views.articles(spark, data, "source_domain").collect()}
    got = registry.queries()["attached_online"](spark, data).toPandas()
    joined = got[got.matched_by != "new"]
    assert any(outlet[a] != outlet[c] for a, c in zip(joined.id, joined.topic_cluster_id))


def test_online_clusters_in_plain_order(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{i:03d}", NOW + timedelta(hours=int(rng.integers(0, 300))), rng.normal(size=3).tolist(), [f"n{x}" for x in rng.integers(0, 9, 3)], "ab"[i % 2]) for i in range(120)]
    got = {r["id"]: (r["topic_cluster_id"], r["matched_by"]) for r in cl.attach_online(spark.createDataFrame(rows, SCHEMA)).collect()}
    clusters, want = {}, {}
    for a, when, v, names, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        live = sorted((c for c in clusters if when - clusters[c][2] <= timedelta(hours=24)), key=lambda c: (clusters[c][2], c), reverse=True)
        cos = {c: float(np.mean(clusters[c][0][:20], axis=0) @ v / np.linalg.norm(np.mean(clusters[c][0][:20], axis=0)) / np.linalg.norm(v)) for c in live}
        shared = {c: len(clusters[c][1] & set(names)) for c in live}
        if live and max(cos.values()) >= 0.74:
            want[a] = max(live, key=cos.get), "vector"
        elif live and max(shared.values()) >= 2:
            want[a] = max(live, key=shared.get), "entity"
        else:
            want[a] = a, "new"
            clusters[a] = ([], set(), when)
        vectors, known, _at = clusters[want[a][0]]
        clusters[want[a][0]] = (vectors + [v], known | set(names), when)
    assert got == want

def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_stream_rows(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = stream.attach_stream(live, "section", hours=30).writeStream.format("memory").queryName("attached").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = cl.attach_online(df, "section", hours=30)
    assert sorted(map(tuple, spark.table("attached").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_stores_once(spark, tmp_path):
    items = _items(spark).withColumn("at", F.lit(NOW).cast("timestamp"))
    items.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for n in range(2):
        live = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
        stream.store_batches(live, store, _sources(spark), str(tmp_path / f"c{n}")).awaitTermination()
        assert store.read("articles").count() == 3


def test_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://x/1"/><updated>2024</updated></entry></feed>'
    rss = "<rss><channel><item><title>B</title><link>https://x/2</link><description>d</description></item><item><title>no link</title></item></channel></rss>"
    assert [i["link"] for i in feeds.parse_feed(atom) + feeds.parse_feed(rss)] == ["https://x/1", "https://x/2"]


def test_feed_errors_are_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("gone")
        return "<rss><item><title>B</title><link>https://x/2</link></item></rss>"

    got = feeds.fetch_feeds(spark.createDataFrame([("good",), ("bad",)], "url string"), fetch).toPandas()
    assert sorted(got.feed) == ["bad", "good"] and got.set_index("feed").loc["bad", "error"] == "OSError: gone"


def test_html_main_text(spark):
    page = "<html><script>x()</script><nav>Home</nav><article><h1>Title</h1><p>Body text that is long enough to count as the main part of it, and a little more.</p><div class='ad-box'>Buy</div><p>More &amp; more.</p></article><footer>Contact</footer></html>"
    assert feeds.main_text(page) == "Title\n\nBody text that is long enough to count as the main part of it, and a little more.\n\nMore & more."
    assert feeds.main_text("") is None and feeds.main_text(None) is None
    got = spark.createDataFrame([(page,), (None,)], "p string").select(feeds.main_text_udf()("p")).collect()
    assert got[0][0].startswith("Title") and got[1][0] is None


def test_models_answer_and_are_checked(spark):
    articles = spark.createDataFrame([("c1", [("a.test", "One two."), ("b.test", "Three.")])], "id string, articles array<struct<domain:string,body:string>>")
    asked = articles.select("id", models.prompt(F.lit("Title"), F.col("articles"), F.lit("topic")).alias("prompt"), F.col("articles.domain").alias("own"))
    got = models.synthesize(asked).first()
    assert got["ok"] and got["answer"]["source_domains"] == ["a.test", "b.test"] and "[^a.test]" in got["answer"]["body"]
    vectors = spark.createDataFrame([("some text",), (None,)], "t string").select(models.embed_udf()("t")).collect()
    assert len(vectors[0][0]) == 64 and vectors[1][0] is None


def test_cycle_isolates_failures(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def broken():
        raise ValueError("no")

    assert json.loads(pipeline.cycle(store, {"ingest": broken, "merge": lambda: {"merged": 0}})["ingest"]) == {"error": "ValueError: no"}
    assert {r["key"] for r in store.read("settings").collect()} == {"last_ingest", "last_merge"}


def test_compile_and_merge_through_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = F.lit(NOW).cast("timestamp_ntz")
    rows = [(str(i), f"https://a.test/{i}", "a.test", f"T{i}", f"Text {i}.", "c1" if i < 3 else "c2", ["$X"]) for i in range(5)]
    store.append("articles", spark.createDataFrame(rows, "id string, url string, source_domain string, title string, content string, topic_cluster_id string, entities array<string>").withColumn("ingested", at))
    store.append("sources", _sources(spark))
    store.append("topic_clusters", spark.createDataFrame([("c1", "t"), ("c2", "t")], "id string, canonical_title string").withColumn("last_updated_at", at))
    work = stories.without_story(store.read("topic_clusters"), store.read("compiled_stories"), store.read("articles"), 1, 50)
    assert pipeline.compile_clusters(store, work, at) == {"requested": 2, "stored": 2}
    assert pipeline.merge_cycle(store, at, dry_run=True) == {"clusters": 2, "pairs": 1, "merged": 1}
    pipeline.merge_cycle(store, at)
    assert store.read("topic_clusters").count() == 1 and store.read("articles").select("topic_cluster_id").distinct().count() == 1


def test_validation_strict_and_lenient(spark):
    story = spark.createDataFrame([("s", "One.[^a.test]\n\nTwo.", ["a.test", "z.test"], [("c", ["A.test"])]), ("e", "", [], [])], "id string, body string, source_domains array<string>, claim_attributions array<struct<claimText:string,attributedDomains:array<string>>>")
    got = {r["id"]: r["failures"] for r in stories.checked(story, _sources(spark)).collect()}
    assert got == {"s": ["unknown domain: z.test"], "e": ["no body"]}
    strict = {r["id"]: r["failures"] for r in stories.checked(story, _sources(spark), strict=True).collect()}
    assert strict["s"] == ["unknown domain: z.test", "no citation in paragraph 2"]


def test_upgraded_rows_get_defaults(spark):
    old = spark.createDataFrame([("c", "t")], "id string, canonical_title string")
    assert schema.upgraded(spark, old, "topic_clusters").first()["section"] == "world"


