"""The store, models, requests and the cycle, end to end on small tables."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswork.functions.stories import repair_json
from presswork.operators import clusters as cl
from presswork.operators import ingest, models, search, stories
from presswork.operators.store import Store
from presswork.plans import pipeline

NOW = datetime(2024, 1, 10)
AT = "2024-01-10 00:00:00"
ITEM = "url string, title string, author string, published_at string, extracted string, snippet string, at int"


def now():
    return F.lit(AT).cast("timestamp_ntz")


def _items(spark):
    text = "The harbour council of Port Askel met Granite Water Board and Silver Data Office over the plan. " * 2
    rows = [("https://a.test/1", "Harbour plan", text), ("https://b.test/2", "Harbour plan again", text + "More was said."), ("https://a.test/3", "Other things", "Nothing of the sort was ever heard of, in this place or in any other one."), ("https://no.example/4", "Unknown", text)]
    return spark.createDataFrame([(u, t, None, None, x, None, i) for i, (u, t, x) in enumerate(rows)], ITEM)


@pytest.fixture()
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.append("sources", spark.createDataFrame([("a.test", "A", "business"), ("b.test", "B", "general")], "domain string, display_name string, category string").withColumn("aliases", F.array().cast("array<string>")))
    return made


def test_appends_write_the_batch_only(spark, tmp_path):
    made = Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(f"{i}", f"https://x/{i}", "t" * 1000)], "id string, url string, content string")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path) for f in files)
    sizes = []
    for i in range(5):
        made.append("articles", row(i), ["url"])
        sizes.append(size())
    steps = [b - a for a, b in zip(sizes, sizes[1:])]
    assert max(steps) < 1.3 * min(steps) and made.read("articles").count() == 5
    assert made.append("articles", row(2), ["url"]).count() == 0 and made.read("articles").count() == 5
    made.compact("articles")
    assert made.vacuum("articles", keep=1) == 6 and made.read("articles").count() == 5


def test_second_writer_is_refused(spark, tmp_path):
    made = Store(spark, str(tmp_path))
    df = spark.createDataFrame([("k", "v")], "key string, value string")
    made.append("settings", df)
    with pytest.raises(RuntimeError):
        made._publish("settings", made._parts("settings"), 0)
    assert made.read("settings").count() == 1


class Counting(models.HashingProvider):
    """Fails where the prompt's title says so; writes a file a call."""

    folder = ""

    def synthesize(self, prompt):
        n = len(os.listdir(self.folder))
        open(os.path.join(self.folder, f"{n}-{os.getpid()}-{hash(prompt)}"), "w").close()
        return "no json" if prompt.startswith("bad") else super().synthesize(prompt)


def test_models_are_asked_once_and_failures_twice(spark, tmp_path):
    folder = str(tmp_path)
    make = lambda: _counting(folder)
    asked = spark.createDataFrame([("1", "good\nsources:\n[a.test] Text.", ["a.test"]), ("2", "bad\nsources:\n[a.test] Text.", ["a.test"])], "id string, prompt string, own array<string>").coalesce(1)
    got = {r["id"]: r["ok"] for r in models.synthesize(asked, make).collect()}
    assert got == {"1": True, "2": False} and len(os.listdir(folder)) == 3


def _counting(folder):
    made = Counting()
    made.folder = folder
    return made


def test_prompt_caps(spark):
    a = spark.createDataFrame([([("a.test", "x" * 30_000, "H", None)] * 9,)], "articles array<struct<domain:string,body:string,title:string,author:string>>")
    text = a.select(models.prompt(F.lit("T"), F.col("articles"), F.lit("compare"), fields=("title", "author"))).first()[0]
    assert text.count("[a.test] ") == 8 and text.count("x" * 20_000) == 8 and "x" * 20_001 not in text
    assert "say where these outlets differ" in text and "title: H" in text and "author: unknown" in text


def test_cycle_ingests_attaches_and_compiles(spark, store):
    results = {k: json.loads(v) for k, v in pipeline.run_cycle(store, _items(spark), now(), batch=5).items()}
    assert results["ingest"] == {"seen": 4, "rejected": 1, "empty": 0, "stored": 3, "clusters": 3}
    articles = store.read("articles")
    assert articles.where("embedding is null or topic_cluster_id is null").count() == 0
    assert store.read("topic_clusters").count() == 3 and store.read("compiled_stories").count() == 3
    again = json.loads(pipeline.run_cycle(store, _items(spark), now())["ingest"])
    assert again["stored"] == 0 and again["clusters"] == 0 and store.read("articles").count() == 3
    more = _items(spark).where("at = 0").withColumn("url", F.lit("https://b.test/9")).withColumn("extracted", F.concat("extracted", F.lit("New words.")))
    joined = json.loads(pipeline.run_cycle(store, more, now())["ingest"])
    assert joined["stored"] == 1 and joined["clusters"] == 0  # attached to a cluster that was there
    view = stories.story_views(store.read("compiled_stories"), store.read("articles"), store.read("sources")).collect()
    assert all(r["byline"].startswith("Compiled from ") and r["sources"][0]["url"].startswith("https://") for r in view)


def test_requests(spark, store):
    pipeline.ingest_items(store, _items(spark), now())
    assert pipeline.answer_request(store, {}, now())["status"] == 400
    assert pipeline.answer_request(store, {"mode": "topic", "query": "no such words here"}, now())["status"] == 404
    asked = {"mode": "links", "urls": ["https://a.test/1", "https://b.test/2?utm_source=x", "https://no.example/4"]}
    first = pipeline.answer_request(store, {"mode": "links", "urls": ["https://a.test/1", "https://b.test/2"]}, now())
    assert first["status"] == 200 and not first["cached"]
    again = pipeline.answer_request(store, {"mode": "links", "urls": ["https://b.test/2/", "https://a.test/1?utm_source=y"]}, now())
    assert again["cached"] and again["id"] == first["id"]
    assert store.read("compiled_stories").first()["reused_count"] == 1
    query = pipeline.answer_request(store, {"mode": "topic", "query": "harbour"}, now())
    assert query["status"] == 200 and asked["mode"] == "links"
    bad = pipeline.answer_request(store, {"mode": "topic", "query": "Nothing of the sort"}, now(), _silent)
    assert bad["status"] == 422
    assert store.read("synthesis_history").count() == 3


class Silent(models.HashingProvider):
    def synthesize(self, prompt):
        return ""


def _silent():
    return Silent()


def test_schedules_and_views(spark, store):
    ran = []
    jobs = {"a": (timedelta(minutes=15), lambda: ran.append("a") or {}), "b": (timedelta(hours=1), lambda: ran.append("b") or {})}
    for minutes in (0, 10, 15, 40, 61):
        pipeline.run_due(store, jobs, NOW + timedelta(minutes=minutes))
    assert ran == ["a", "b", "a", "a", "a", "b"]
    made = []
    view = lambda s: pipeline.refreshed_view(store, "front", lambda: made.append(1) or spark.range(3), NOW + timedelta(seconds=s), 300)
    assert [view(s).count() for s in (0, 200, 400)] == [3, 3, 3] and len(made) == 2


def test_remote_providers():
    seen = []

    def post(path, headers, payload, seconds):
        seen.append((path, headers, payload, seconds))
        return {"message": {"content": "m"}, "choices": [{"message": {"content": "c"}}], "content": [{"type": "text", "text": "p"}, {"type": "x"}], "embedding": [1.0], "data": [{"embedding": [2.0]}]}

    got = {n: (p := models.connected(n, post, model="x", key="k")()) and (p.synthesize("q"), p.embed("e" * 9000)) for n in models.REMOTE}
    assert got == {"local-chat": ("m", [1.0]), "completions": ("c", [2.0]), "hosted-completions": ("c", [2.0]), "hosted-messages": ("p", None)}
    assert {s for *_, s in seen} == {300.0, 15.0} and max(len(p.get("prompt") or p.get("input") or "") for _, _, p, _ in seen) == 8000

    def broken(*_):
        raise OSError("gone")

    p = models.connected("completions", broken, model="x")()
    assert p.synthesize("q") == "" and p.embed("e") is None


def test_pages_are_tried_in_order(spark):
    page = lambda n: "<article><p>" + "word " * n + "</p></article>"

    def direct(url, seconds):
        assert seconds == 15.0
        if "gone" in url:
            raise OSError("gone")
        return page(20)

    got = {r["url"]: (r["way"], r["error"]) for r in ingest.fetched_pages(spark.createDataFrame([("https://a/gone",), ("https://a/short",)], "url string"), [direct, lambda u, s: page(100) if "gone" in u else None]).collect()}
    assert got == {"https://a/gone": (1, "OSError: gone"), "https://a/short": (0, None)}


def test_archive_ingest(spark):
    listing = lambda *rows: spark.createDataFrame(list(rows), "url string, stamp string")
    listings = [listing(("https://a.test/water-1", "20240101"), ("https://a.test/other", "20240102")), None, listing(("https://b.test/water-2", "20240103"), ("https://b.test/water-3", "20240104"))]
    pages = spark.createDataFrame([("https://a.test/water-1", "T", "x" * 150), ("https://b.test/water-2", "T", "short"), ("https://b.test/water-3", "T", "y" * 150)], "url string, title string, text string")
    stored = spark.createDataFrame([("https://b.test/water-3", "b.test", "h")], "url string, source_domain string, content_hash string")
    sources = spark.createDataFrame([("a.test", []), ("b.test", [])], "domain string, aliases array<string>")
    new, counts = ingest.archive_ingest(listings, pages, stored, sources, "water")
    assert [r["url"] for r in new.collect()] == ["https://a.test/water-1"] and tuple(counts.first()) == (3, 1)


def test_alias_of_two_owners_goes_to_the_later(spark):
    rows = [("z.test", ["shared.test"], 0), ("m.test", ["shared.test", "own.test"], 1), ("a.test", [], 2)]
    df = spark.createDataFrame(rows, "domain string, aliases array<string>, place int")
    index = {r["name"]: r["domain"] for r in ingest.domain_index(df).collect()}
    assert index["shared.test"] == "m.test" and index["z.test"] == "z.test"
    assert {r["name"]: r["domain"] for r in ingest.domain_index(df.drop("place")).collect()}["shared.test"] == "z.test"


def test_keyword_passes_of_free_queries_do_not_stop(spark):
    at = datetime(2024, 1, 9)
    rows = [(f"h{i:02d}", "harbour news", "x", "a.test", at) for i in range(30)] + [(f"t{i:02d}", "toll news", "x", f"b{i}.test", at) for i in range(3)]
    df = spark.createDataFrame([(i, t, c, s, "u", a) for i, t, c, s, a in rows], "id string, title string, content string, source_domain string, url string, ingested timestamp_ntz")
    got = search.candidates(df, "harbour toll", now(), 72, 20, 3, 25)
    assert got.where("id like 't%'").count() == 3
    assert search.candidates(df, "harbour toll", now(), 72, 20, 3, 25, until=20).where("id like 't%'").count() == 0


def test_greedy_merge_is_the_sequential_walk(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(2):
        n = 30
        when = [NOW - timedelta(hours=int(h)) for h in rng.integers(0, 40, n)]
        sizes, names = rng.integers(1, 9, n), [f"c{i:02d}" for i in rng.permutation(n)]
        pairs = sorted({tuple(sorted((names[a], names[b]))) for a, b in rng.integers(0, n, (60, 2)) if a != b})
        snap = spark.createDataFrame([(names[i], when[i], int(sizes[i]), []) for i in range(n)], "id string, last_updated_at timestamp_ntz, articles int, entities array<string>")
        got = {tuple(r) for r in cl.greedy_merge(snap, spark.createDataFrame(pairs, "a string, b string")).collect()}
        at = {names[i]: (-when[i].timestamp(), names[i]) for i in range(n)}
        live, into, gone = {names[i]: int(sizes[i]) for i in range(n)}, {}, []

        def find(x):
            while x in into:
                x = into[x]
            return x

        for a, b in sorted((sorted(p, key=at.get) for p in pairs), key=lambda p: (at[p[0]], at[p[1]])):
            x, y = find(a), find(b)
            if x == y or live[x] + live[y] > 15:
                continue
            keep, lost = (x, y) if live[x] >= live[y] else (y, x)
            live[keep] += live[lost]
            into[lost] = keep
            gone.append(lost)
        assert got == {(v, find(v)) for v in gone} and gone


def test_best_centroid_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    centres = [(f"c{i}", rng.normal(size=3).tolist()) for i in range(9)] + [("a-short", [1.0])]
    rows = [(f"v{i}", rng.normal(size=3).tolist()) for i in range(12)] + [("zero", [0.0, 0.0, 0.0]), ("none", None), ("other", [2.0, 0.0])]
    c = spark.createDataFrame(centres, "topic_cluster_id string, centroid array<double>")
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = {}
    for i, x in rows:
        if x is not None:
            cos = lambda m: round(float(unit(x) @ unit(m)), 9) if len(m) == len(x) and any(x) else 0.0  # noqa: B023, E731
            want[i] = min((-cos(m), n) for n, m in centres)
    for block in (2, 100):
        got = {r["id"]: (-r["similarity"], r["topic_cluster_id"]) for r in cl.best_centroid(v, c, block=block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[i][0] - want[i][0]) < 1e-8 and got[i][1] == want[i][1] for i in want)


def test_sections_and_fixture(spark):
    cards = spark.createDataFrame([("a", "World"), ("b", "business")], "id string, section string")
    assert [stories.of_section(cards, s).count() for s in (None, "", "all", "world", "none")] == [2, 2, 2, 1, 0]
    assert stories.or_fixture(cards.limit(0), cards).count() == 2 and stories.or_fixture(cards.limit(1), cards).count() == 1


def test_repair_is_linear():
    raw = '{"a": "' + 'he said "no" and left, ' * 20_000 + '"}'
    assert json.loads(repair_json(raw))["a"].startswith('he said "no"')


def test_refresh_triggers_by_number_and_by_timer(spark, tmp_path):
    import time

    from presswork.streaming import ingest as stream

    folder = str(tmp_path / "in")
    rows = [("busy", NOW)] * 4 + [("slow", NOW), (None, NOW)]
    spark.createDataFrame(rows, "topic_cluster_id string, at timestamp").coalesce(1).write.parquet(folder)
    live = spark.readStream.schema("topic_cluster_id string, at timestamp").parquet(folder)
    made = stream.refresh_triggers(live, 3, 2 / 3600)
    run = made.writeStream.format("memory").queryName("refreshes").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 40
        while time.time() < until and spark.table("refreshes").count() < 2:
            time.sleep(1)
    finally:
        run.stop()
    assert sorted(map(tuple, spark.table("refreshes").collect())) == [("busy", 4, "new"), ("slow", 1, "age")]
