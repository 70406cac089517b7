"""Topic clusters: centroids, attachment by vector and entities, merge candidates, greedy merge."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.functions import entities as en
from presswork.session import stash


def centroids(articles: DataFrame, sample: int = 20, dim: int = 64) -> DataFrame:
    """(topic_cluster_id, centroid, vectors): mean of a cluster's first vectors by time of ingestion."""
    order = Window.partitionBy("topic_cluster_id").orderBy("ingested", "id")
    first = articles.where(F.col("topic_cluster_id").isNotNull() & (F.size("embedding") == dim)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    means = [F.avg(F.col("embedding")[i]) for i in range(dim)]
    return first.groupBy("topic_cluster_id").agg(F.array(*means).alias("centroid"), F.count("*").alias("vectors"))


def cluster_entities(articles: DataFrame, latest: int | None = None) -> DataFrame:
    """(topic_cluster_id, entity, first_seen): distinct entities of a cluster, of its latest articles on request."""
    rows = articles.where("topic_cluster_id is not null")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("topic_cluster_id").orderBy(F.desc("ingested"), "id")))
    if latest:
        rows = rows.where(F.col("n") <= latest)
    seen = rows.select("topic_cluster_id", "n", F.posexplode("entities").alias("at", "entity")).where("entity is not null")
    return seen.groupBy("topic_cluster_id", "entity").agg(F.min(F.struct("n", "at")).alias("first_seen"))


def best_centroid(articles: DataFrame, centres: DataFrame, block: int = 20_000) -> DataFrame:
    """(id, topic_cluster_id, similarity): the most similar centre of every article, ties by cluster id.

    Centres are handed to the tasks in blocks of at most ``block`` of them; a block meets the articles
    as one matrix product a batch, which leaves one row an article. No pair of the two is ever a row.
    """
    named = stash(centres.select(F.col("topic_cluster_id").cast("string").alias("topic_cluster_id"), "centroid").where("topic_cluster_id is not null"))
    blocks = max(1, -(-named.count() // block))
    kind = dict(articles.dtypes)["id"]
    vectors = articles.where(F.size("embedding") > 0).select("id", "embedding")
    placed = named.withColumn("place", F.pmod(F.xxhash64("topic_cluster_id"), F.lit(blocks)))
    best = None
    for n in range(blocks):
        rows = placed.where(F.col("place") == n).select("topic_cluster_id", "centroid").collect()  # about ``block`` rows
        found = vectors.mapInPandas(_nearest_of(rows), f"id {kind}, topic_cluster_id string, similarity double")
        best = found if best is None else best.unionByName(found)
    best = best.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "topic_cluster_id")).alias("x"))
    return best.select("id", F.col("x.topic_cluster_id").alias("topic_cluster_id"), (-F.col("x.s")).alias("similarity"))


def _nearest_of(rows: list):
    """For mapInPandas: the centre of ``rows`` most similar to each vector (9 decimals, ties by id).
    Vectors of other lengths and without a direction have a similarity of 0 to every centre."""
    rows = sorted(rows, key=lambda r: r["topic_cluster_id"])
    names = [r["topic_cluster_id"] for r in rows]
    units: dict[int, tuple[np.ndarray, list[int]]] = {}
    for dim in {len(r["centroid"]) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r["centroid"]) == dim]
        m = np.array([rows[i]["centroid"] for i in at], dtype=float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        units[dim] = np.divide(m, size, out=np.zeros_like(m), where=size > 0), at

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, score = np.zeros(len(frame), dtype=int), np.zeros(len(frame))
            lengths = frame["embedding"].map(len).to_numpy() if len(frame) else np.zeros(0)
            for dim, (m, at) in units.items():
                mine = np.flatnonzero(lengths == dim)
                for part in np.array_split(mine, max(1, -(-len(mine) // 1024))):
                    if not len(part):
                        continue
                    v = np.array([frame["embedding"].iloc[i] for i in part], dtype=float)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    cos = np.round(np.divide(v, size, out=np.zeros_like(v), where=size > 0) @ m.T, 9)
                    top = cos.argmax(axis=1)
                    # a centre of another length has 0, and may come first
                    best[part] = [at[t] for t in top]
                    score[part] = cos[np.arange(len(part)), top]
                    if len(at) < len(rows):
                        other = min(set(range(len(rows))) - set(at))
                        zero = (score[part] < 0) | ((score[part] == 0) & (other < best[part]))
                        best[part] = np.where(zero, other, best[part])
                        score[part] = np.where(zero, 0.0, score[part])
            if names:
                yield pd.DataFrame({"id": frame["id"], "topic_cluster_id": [names[i] for i in best], "similarity": score})

    return run


def entity_overlaps(articles: DataFrame, members: DataFrame) -> DataFrame:
    """(id, topic_cluster_id, tickers, proper_nouns, score): shared entities of article and cluster, through the entities."""
    own = articles.select("id", F.explode(F.array_distinct("entities")).alias("entity")).where("entity is not null")
    shared = own.join(members.select("topic_cluster_id", "entity"), "entity")
    symbol = F.col("entity").startswith("$")
    counted = shared.groupBy("id", "topic_cluster_id").agg(F.count_if(symbol).alias("tickers"), F.count_if(~symbol).alias("proper_nouns"))
    return counted.where("tickers >= 1 or proper_nouns >= 2").withColumn("score", F.col("tickers") * 10 + F.col("proper_nouns"))


def attach_batch(articles: DataFrame, centres: DataFrame, members: DataFrame, threshold: float = 0.74, floor: float = 0.55) -> DataFrame:
    """(id, topic_cluster_id, similarity, matched_by) against frozen clusters: by vector, else by entities, else new."""
    near = best_centroid(articles, centres)
    overlaps = entity_overlaps(articles, members)
    by_entity = overlaps.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "topic_cluster_id")).alias("x")).select("id", F.col("x.topic_cluster_id").alias("entity_cluster"))
    joined = articles.select("id").join(near, "id", "left").join(by_entity, "id", "left")
    by_vector = F.col("similarity") >= max(threshold, floor)
    return joined.select(
        "id",
        F.when(by_vector, F.col("topic_cluster_id")).otherwise(F.col("entity_cluster")).alias("topic_cluster_id"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.when(by_vector, "vector").when(F.col("entity_cluster").isNotNull(), "entity").otherwise("new").alias("matched_by"),
    )


class OnlineClusters:
    """Clusters that change with every article, as ingestion sees them one by one."""

    def __init__(self, threshold: float, hours: float, sample: int = 20):
        self.threshold, self.hours, self.sample = threshold, hours, sample
        self.ids: list[str] = []
        self.sums: list[np.ndarray] = []
        self.counts: list[int] = []
        self.entities: list[set[str]] = []
        self.updated: list[pd.Timestamp] = []
        self.latest: pd.Timestamp | None = None
        self.recent: list[int] | None = None  # clusters that are not too old at ``latest``

    def add(self, article: str, when: pd.Timestamp, vector: np.ndarray | None, entities: list[str]) -> tuple[str, float, str]:
        """(cluster, best similarity, matched_by) of the next article."""
        span = pd.Timedelta(hours=self.hours)
        if self.recent is None:
            self.recent = list(range(len(self.ids)))  # a stream's state is put in before the first article
        if self.latest is None or when >= self.latest:
            # no article of this time or later sees a cluster that is too old now
            self.latest, self.recent = when, [i for i in self.recent if when - self.updated[i] <= span]
            known = self.recent
        else:
            known = range(len(self.ids))
        live = [i for i in known if self.counts[i] and when - self.updated[i] <= span]
        live.sort(key=lambda i: (self.updated[i], self.ids[i]), reverse=True)
        best, at = 0.0, -1
        if vector is not None and np.linalg.norm(vector) > 0:
            for i in live:
                if len(self.sums[i]) != len(vector):
                    continue
                centre = self.sums[i] / self.counts[i]
                size = np.linalg.norm(centre) * np.linalg.norm(vector)
                cos = float(centre @ vector / size) if size else 0.0
                if cos > best:
                    best, at = cos, i
        how = "vector" if at >= 0 and best >= self.threshold else ""
        if not how:
            at, top = -1, 0
            for i in live:
                both = self.entities[i].intersection(entities)
                symbols = sum(e.startswith("$") for e in both)
                names = len(both) - symbols
                if (symbols >= 1 or names >= 2) and 10 * symbols + names > top:
                    at, top, how = i, 10 * symbols + names, "entity"
        if at < 0:
            at, how = len(self.ids), "new"
            self.ids.append(article)
            self.sums.append(np.zeros(0 if vector is None else len(vector)))
            self.counts.append(0)
            self.entities.append(set())
            self.updated.append(when)
            self.recent.append(at)
        if vector is not None and self.counts[at] < self.sample and len(self.sums[at]) == len(vector):
            self.sums[at] = self.sums[at] + vector
            self.counts[at] += 1
        self.entities[at].update(entities)
        self.updated[at] = max(self.updated[at], when)
        return self.ids[at], best, how


def attach_online(articles: DataFrame, key: str | None = None, threshold: float = 0.74, hours: float = 24) -> DataFrame:
    """(id, topic_cluster_id, similarity, matched_by), article by article in order of ingestion.

    The order is part of the definition, so all articles are one sequence, in one task. A key (a
    section, a language) divides the stream where no story may cross it: an article never joins a
    cluster of another key. attach_batch is the form for streams that one task does not hold.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = OnlineClusters(threshold, hours), []
        for r in rows.sort_values(["ingested", "id"]).itertuples(index=False):
            vector = None if r.embedding is None else np.asarray(r.embedding, dtype=float)
            names = [] if r.entities is None else [e for e in r.entities if e is not None]
            out.append((r.id, *state.add(r.id, r.ingested, vector, names)))
        return pd.DataFrame(out, columns=["id", "topic_cluster_id", "similarity", "matched_by"])

    columns = articles.select("id", "ingested", "embedding", "entities", (F.col(key) if key else F.lit(0)).alias("__key"))
    return columns.groupBy("__key").applyInPandas(lambda rows: run(rows), "id string, topic_cluster_id string, similarity double, matched_by string")


def snapshot(articles: DataFrame, clusters: DataFrame, latest: int = 50) -> DataFrame:
    """(id, last_updated_at, articles, entities): every cluster with its size and recent entities in order."""
    sizes = articles.where("topic_cluster_id is not null").groupBy("topic_cluster_id").agg(F.count("*").alias("articles"))
    names = cluster_entities(articles, latest).groupBy("topic_cluster_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "entity"))).alias("o"))
    joined = clusters.join(sizes, F.col("id") == F.col("topic_cluster_id"), "left").drop("topic_cluster_id").join(names, F.col("id") == F.col("topic_cluster_id"), "left")
    return joined.select("id", "last_updated_at", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce(F.col("o.entity"), F.array().cast("array<string>")).alias("entities"))


def merge_candidates(snap: DataFrame, hours: int = 72, cap: int | None = None) -> DataFrame:
    """(a, b, tickers, proper_nouns): clusters within the window that share a symbol or two names, a < b.
    With a cap, those that together have no more articles, which are all that a merge can take."""
    fit = snap if cap is None else snap.where(F.col("articles") <= cap)
    rows = fit.select("id", "last_updated_at", "articles", F.explode(F.array_distinct("entities")).alias("entity"))
    # buckets of the window's width keep a frequent entity from pairing clusters of all times
    rows = rows.withColumn("bucket", F.floor(F.unix_seconds(F.col("last_updated_at").cast("timestamp")) / F.lit(hours * 3600)))
    other = rows.select(F.col("id").alias("b"), F.col("last_updated_at").alias("b_at"), F.col("articles").alias("b_articles"), "entity", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    pairs = rows.withColumnRenamed("id", "a").join(other, ["entity", "bucket"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(F.abs(F.timestamp_diff("MICROSECOND", F.col("last_updated_at"), F.col("b_at"))) <= hours * 3_600_000_000)
    if cap is not None:
        pairs = pairs.where(F.col("articles") + F.col("b_articles") <= cap)
    symbol = F.col("entity").startswith("$")
    counted = pairs.groupBy("a", "b").agg(F.count_if(symbol).alias("tickers"), F.count_if(~symbol).alias("proper_nouns"))
    return counted.where("tickers >= 1 or proper_nouns >= 2")


def greedy_merge(snap: DataFrame, pairs: DataFrame, cap: int = 15) -> DataFrame:
    """(victim, survivor): merges pair by pair, larger cluster first, none beyond ``cap`` articles.

    Pairs are taken in the order of their clusters in the snapshot (latest first): by the earlier
    cluster, then by the later one. A walk from entity to entity in the order in which they were
    stored would meet the same pairs in another order, and merge others once the cap binds.

    Each decision may depend on the one before it, over any distance, so the walk is one sequence, in
    one task. All else is shared out: the clusters are numbered in their order, the pairs of which both
    sides fit the cap at the outset are gathered as one row of numbers for each earlier cluster, and the
    task takes these rows as they come. It holds nine bytes a cluster and one batch of rows.
    """
    t = F.coalesce(-unix(F.col("last_updated_at")), F.lit(2**63 - 1)).alias("t")
    known = snap.select("id", t, F.col("articles").cast("bigint").alias("n")).groupBy("id").agg(F.min("t").alias("t"), F.max("n").alias("n"))
    placed = _numbered(known.where(F.col("n") <= cap), "t", "id")
    total = placed.count()
    a, b = (placed.select(F.col("id").alias(c), F.col("place").alias(f"p{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    fit = pairs.select("a", "b").join(a, "a").join(b, "b").where((F.col("na") + F.col("nb") <= cap) & (F.col("pa") != F.col("pb")))
    early = F.col("pa") < F.col("pb")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y)).cast("int")
    each = fit.select(pick("pa", "pb").alias("u"), pick("na", "nb").alias("n"), F.struct(pick("pb", "pa").alias("v"), pick("nb", "na").alias("n")).alias("later"))
    rows = each.groupBy("u", "n").agg(F.array_sort(F.collect_set("later")).alias("later"))
    walked = rows.select("u", "n", F.col("later.v").alias("v"), F.col("later.n").alias("m")).repartition(1).sortWithinPartitions("u").mapInArrow(_walk(total, cap), "victim int, survivor int")
    name = lambda c: placed.select(F.col("place").alias(c), F.col("id").alias(f"{c}_id"))
    moves = stash(walked).join(name("victim"), "victim").join(name("survivor"), "survivor")
    return moves.select(F.col("victim_id").alias("victim"), F.col("survivor_id").alias("survivor"))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """The rows with their ``place`` in the order, from 0. No task holds more than its part of them."""
    ordered = stash(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the row within its partition is in the lower bits
    sizes = sorted(ordered.groupBy(part.cast("int").alias("part")).count().collect())
    starts, so_far = [], 0
    for n, size in sizes:
        starts.append((n, so_far - (n << 33)))
        so_far += size
    shift = df.sparkSession.createDataFrame(starts, "part int, shift bigint")
    return ordered.withColumn("part", part.cast("int")).join(F.broadcast(shift), "part").withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _walk(total: int, cap: int):
    """For mapInArrow: the merges of (u, n, v, m), pairs of the cluster u with later ones and their sizes, by u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, size = array("i", np.arange(total, dtype=np.int32).tobytes()), array("i", bytes(4 * total))
        seen = bytearray(total)  # clusters that have their size

        def root(i: int) -> int:
            while into[i] != i:
                into[i] = i = into[into[i]]
            return i

        for batch in batches:
            for u, n, later, sizes in zip(*(c.to_pylist() if k < 2 else c for k, c in enumerate(batch.columns))):
                if not seen[u]:
                    seen[u], size[u] = 1, n
                x = root(u)
                for v, m in zip(later.values.to_numpy().tolist(), sizes.values.to_numpy().tolist()):
                    if not seen[v]:
                        seen[v], size[v] = 1, m
                    y = root(v)
                    if x != y and size[x] + size[y] <= cap:
                        if size[x] < size[y]:
                            x, y = y, x
                        size[x] += size[y]
                        into[y] = x
        gone = [i for i in range(total) if into[i] != i]
        for at in range(0, len(gone), 100_000):
            some = gone[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(map(root, some), pa.int32())], names=["victim", "survivor"])

    return run


def repoint(df: DataFrame, merges: DataFrame, column: str = "topic_cluster_id") -> DataFrame:
    """The rows with merged clusters replaced by their survivors."""
    moves = merges.select(F.col("victim").alias("__victim"), F.col("survivor").alias("__survivor"))
    return df.join(moves, F.col(column) == F.col("__victim"), "left").withColumn(column, F.coalesce("__survivor", column)).drop("__victim", "__survivor")


def with_extracted(articles: DataFrame, size: int = 1500) -> DataFrame:
    """Articles whose entities were never extracted (null) get them from title and text."""
    from presswork.functions.text import excerpt

    found = en.extract(excerpt(F.col("title"), F.col("content"), size))["everything"]
    return articles.withColumn("entities", F.when(F.col("entities").isNull(), found).otherwise(F.col("entities")))


def unix(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))
