"""Incremental ingestion and online clustering as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.clusters import OnlineClusters
from presswork.operators.ingest import ingest
from presswork.operators.store import Store


def deduplicated(items: DataFrame, stamp: str = "at", horizon: str = "3 days") -> DataFrame:
    """Items of a stream, each URL once within the horizon; state older than that is dropped."""
    return items.withWatermark(stamp, horizon).dropDuplicatesWithinWatermark(["url"])


def store_batches(items: DataFrame, store: Store, sources: DataFrame, checkpoint: str, interval: str | None = None):
    """Start the query that gates, deduplicates and stores each micro-batch. Without an interval it
    works off what is there and ends. Replayed batches store nothing twice: what is stored is anti-joined."""

    def one(batch: DataFrame, _: int) -> None:
        new, _counts = ingest(batch, store.read("articles"), sources)
        store.append("articles", new.withColumn("ingested", F.col("at").cast("timestamp_ntz")).drop("at"), ["url"])

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return deduplicated(items).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def attach_stream(articles: DataFrame, key: str, threshold: float = 0.74, hours: float = 24) -> DataFrame:
    """(id, topic_cluster_id, similarity, matched_by) of a stream of articles. The clusters of a key are
    its state; those out of the window leave it, and a key whose last article is twice the window
    behind the watermark loses its state, so state is bounded by the window, not the stream."""

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clusters = OnlineClusters(threshold, hours)
        if state.exists:
            for cluster, total, count, names, updated in json.loads(state.get[0]):
                clusters.ids.append(cluster)
                clusters.sums.append(np.asarray(total, dtype=float))
                clusters.counts.append(count)
                clusters.entities.append(set(names))
                clusters.updated.append(pd.Timestamp(updated))
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ingested", "id"])
        out = []
        for r in rows.itertuples(index=False):
            vector = None if r.embedding is None else np.asarray(r.embedding, dtype=float)
            out.append((r.id, *clusters.add(r.id, pd.Timestamp(r.ingested), vector, [] if r.entities is None else [e for e in r.entities if e is not None])))
        latest = max(clusters.updated)
        live = [i for i, u in enumerate(clusters.updated) if latest - u <= pd.Timedelta(hours=hours)]
        kept = [(clusters.ids[i], clusters.sums[i].tolist(), clusters.counts[i], sorted(clusters.entities[i]), clusters.updated[i].isoformat()) for i in live]
        state.update((json.dumps(kept),))
        ends = int(latest.tz_localize("UTC").timestamp() * 1000) + int(2 * hours * 3_600_000)
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "topic_cluster_id", "similarity", "matched_by"])

    timed = articles.withColumn("__at", F.col("ingested").cast("timestamp")).withWatermark("__at", f"{max(1, int(hours))} hours")
    columns = timed.select("id", "ingested", "embedding", "entities", "__at", F.col(key).alias("__key"))
    return columns.groupBy("__key").applyInPandasWithState(
        step, "id string, topic_cluster_id string, similarity double, matched_by string",
        "clusters string", "append", "EventTimeTimeout",
    )


def refresh_triggers(arrivals: DataFrame, least_new: int = 3, age_hours: float = 6.0) -> DataFrame:
    """(topic_cluster_id, articles, why) of a stream of arrivals (topic_cluster_id, at): a cluster is
    to be compiled anew once ``least_new`` articles have come since the last time, or some have and
    ``age_hours`` have passed since the first of them, which a timer finds without another arrival."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], waiting, "age")], columns=["topic_cluster_id", "articles", "why"])
            return
        fresh = not waiting
        waiting += sum(map(len, frames))
        if waiting >= least_new:
            state.remove()
            yield pd.DataFrame([(key[0], waiting, "new")], columns=["topic_cluster_id", "articles", "why"])
            return
        until = state.getCurrentProcessingTimeMs() + int(age_hours * 3_600_000) if fresh else state.get[1]
        state.update((waiting, until))
        state.setTimeoutDuration(max(1, until - state.getCurrentProcessingTimeMs()))

    rows = arrivals.where("topic_cluster_id is not null").select("topic_cluster_id", "at")
    return rows.groupBy("topic_cluster_id").applyInPandasWithState(
        step, "topic_cluster_id string, articles bigint, why string", "waiting bigint, until bigint", "append", "ProcessingTimeTimeout"
    )


def new_since_refresh(arrivals: DataFrame, window: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(topic_cluster_id, window, articles): arrivals per cluster and event-time window, for refresh triggers."""
    timed = arrivals.withWatermark("at", late)
    return timed.groupBy("topic_cluster_id", F.window("at", window)).agg(F.count("*").alias("articles"))
