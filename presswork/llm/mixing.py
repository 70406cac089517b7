"""A mixture of sources with target shares of its tokens (problem 9).

Every source streams its documents in a fixed pseudo-random order, at most ``max_repeats`` times.
Its quota is its share of the mixture's size, as far as its repeats allow. The stream is read in
blocks of ``block`` tokens; block k of a source with weight w (its quota by all quotas) has the
Pfair release time floor((k - 1) / w) and deadline ceil(k / w), counted in slots of one block.
Earliest deadline first among the released blocks fills the slots, which on one resource meets
every deadline, so that at no slot is a source a whole block away from its share.

The schedule depends on the weights alone and is made in segments of ``SEGMENT`` slots, side by
side. At a border t every source has had floor(w t) or ceil(w t) blocks, t in all, never fewer than
at the border before; such counts always exist and are found border by border. Within a segment
the blocks between two borders, with their windows clipped to it, fill its slots exactly: of the
blocks whose windows lie in any interval there are never more than its slots, so that earliest
deadline first meets all deadlines there too. Blocks thus keep their width however large the
mixture is; the borders, one row per SEGMENT blocks, are all that one task computes.

Positions within a source come from sums over hash buckets of it, so that a source with a third
of all rows is no single task's work. Defined cases: null and empty texts have no tokens and take
no part; sources without a target, with a null name or a share of 0 take no part; a target without
documents gets a row with zero tokens; rows delivered twice count once; empty tables give an empty
mixture; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork.llm.encoding import TOKENIZERS, token_counts
from presswork.session import stash

BLOCK = 2048
BUCKETS = 256
SEGMENT = 65_536  # slots that one task schedules


def quotas(counted: DataFrame, targets: DataFrame, size: int | str | None) -> DataFrame:
    """(source, target_share, max_repeats, available, quota) of every target.

    size: tokens of the mixture; None for those of all sources that take part; "exact" for the
    largest mixture in which every target with documents is met.
    """
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    both = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    every = Window.partitionBy(F.lit(0))  # one row a target
    share = F.col("target_share") / F.sum("target_share").over(every)
    if size == "exact":
        both = both.withColumn("share", share)
        total = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))).over(every)
    else:
        total = F.lit(size) if size else F.sum("available").over(every)
    return both.withColumn("quota", F.least((share * total).cast("bigint"), F.col("available") * F.greatest("max_repeats", F.lit(0)))).drop("share")


def _streams(counted: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, repeat, begin): every use of a document with its place in its source's stream."""
    placed = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).withColumn("h", F.xxhash64("doc_id", F.lit(1)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    ahead = sums.withColumn("ahead", F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("sum")).select("source", "bucket", "ahead")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once = placed.withColumn("own", F.sum("tokens").over(inner) - F.col("tokens")).join(ahead, ["source", "bucket"]).withColumn("first", F.col("ahead") + F.col("own"))
    used = once.join(plan.select("source", "quota", "available"), "source")
    # the last use may overshoot or undershoot the quota by half a document at most
    room = (F.col("quota") - F.col("first") - F.col("tokens") / 2) / F.col("available")
    uses = F.when(room >= 0, F.floor(room) + 1).otherwise(0)
    return used.withColumn("repeat", F.explode(F.when(uses > 0, F.sequence(F.lit(1).cast("bigint"), uses)))).select(
        "doc_id", "source", "tokens", F.col("repeat").cast("int").alias("repeat"), (F.col("first") + (F.col("repeat") - 1) * F.col("available")).alias("begin")
    )


def _started(n: int, total: int, begin: int, slots: int) -> np.ndarray:
    """ceil(w t) of a source of n blocks at each slot t behind ``begin``: blocks released before t."""
    base, rest = divmod(n * begin, total)
    return base - (-(rest + n * np.arange(1, slots, dtype=np.int64)) // total)


def borders(blocks: dict[str, int], segment: int = SEGMENT) -> Iterator[tuple[int, dict[str, int], dict[str, int]]]:
    """(first slot, blocks had before it, blocks had after the segment) of every segment."""
    total, had = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for begin in range(0, total, segment):
        end = min(total, begin + segment)
        slots = end - begin
        after = {s: max(had[s], n * end // total) for s, n in blocks.items()}
        # slots left from each slot on, less the blocks that cannot start before it
        free = np.arange(slots - 1, 0, -1, dtype=np.int64)
        for s, n in blocks.items():
            if after[s] > had[s]:
                free -= np.maximum(0, after[s] - np.maximum(had[s], _started(n, total, begin, slots)))
        missing = slots - sum(after.values()) + sum(had.values())
        # the blocks due first that still fit; none has more than ceil(w end)
        more = sorted((-(-(after[s] + 1) * total // n), s) for s, n in blocks.items() if after[s] < -(-n * end // total))
        for _, s in more:
            late = _started(blocks[s], total, begin, slots) <= after[s]  # at these slots it is still to be released
            if missing and (free[late] > 0).all():
                free -= late
                after[s] += 1
                missing -= 1
        yield begin, had, after
        had = after


def pfair(blocks: dict[str, int], begin: int = 0, had: dict[str, int] | None = None, after: dict[str, int] | None = None) -> Iterator[tuple[str, int]]:
    """(source, block) slot by slot from ``begin``: earliest deadline first among the released of
    the blocks from ``had`` to ``after`` (of all, by default)."""
    total = sum(blocks.values())
    had, after = had or dict.fromkeys(blocks, 0), after or blocks
    waiting = [(had[s] * total // blocks[s], s, had[s] + 1) for s in sorted(blocks) if after[s] > had[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(begin, begin + sum(after[s] - had[s] for s in blocks)):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // blocks[s]), s, k))
        _, s, k = heapq.heappop(ready)
        if k < after[s]:
            heapq.heappush(waiting, (k * total // blocks[s], s, k + 1))
        yield s, k


def _schedule(sized: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(source, block, slot) from (source, blocks)."""

    def divide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = {s: int(n) for frame in frames for s, n in frame.itertuples(index=False)}
        for begin, had, after in borders(blocks, segment):
            counts = [[d[s] for s in blocks] for d in (had, after, blocks)]
            yield pd.DataFrame({"begin": [begin], "sources": [list(blocks)], "had": counts[:1], "after": counts[1:2], "blocks": counts[2:]})

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin, sources, had, after, blocks in frame.itertuples(index=False):
                known, before, behind = (dict(zip(sources, map(int, x))) for x in (blocks, had, after))
                made = list(pfair(known, int(begin), before, behind))
                yield pd.DataFrame({"source": [s for s, _ in made], "block": [k for _, k in made], "slot": range(int(begin), int(begin) + len(made))}).astype({"block": "int64", "slot": "int64"})

    one = sized.select("source", "blocks").where("blocks > 0").coalesce(1)
    segments = one.mapInPandas(divide, "begin bigint, sources array<string>, had array<bigint>, after array<bigint>, blocks array<bigint>")
    spread = segments.repartition(df_partitions(sized), F.col("begin"))
    return spread.mapInPandas(fill, "source string, block bigint, slot bigint")


def df_partitions(df: DataFrame) -> int:
    """Tasks that segments are spread over: as many as a shuffle of the session has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plan_mixture(documents: DataFrame, targets: DataFrame, size: int | str | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(counted documents, quotas). ``size``: tokens of the mixture, by default those of the sources that take part."""
    named = documents.join(targets.where("target_share > 0").select("source").distinct(), "source", "left_semi")
    counted = stash(token_counts(named, tokenizer=tokenizer, folder=folder, keep=("source",)).where("tokens > 0").dropDuplicates(["doc_id"]))
    return counted, quotas(counted, targets, size)


def mixture(documents: DataFrame, targets: DataFrame, size: int | str | None = None, block: int = BLOCK, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, segment: int = SEGMENT) -> DataFrame:
    """(slot, source, block, doc_id, repeat, tokens): every use of a document, at its place."""
    counted, plan = plan_mixture(documents, targets, size, tokenizer, folder)
    sized = plan.withColumn("blocks", F.ceil(F.col("quota") / F.lit(block)))
    streams = _streams(counted, plan).join(sized.select("source", "blocks"), "source")
    streams = streams.withColumn("block", F.least(F.floor(F.col("begin") / F.lit(block)) + 1, F.col("blocks")))
    return streams.join(_schedule(sized, segment), ["source", "block"]).select("slot", "source", "block", "doc_id", "repeat", "tokens")


def shares(documents: DataFrame, targets: DataFrame, size: int | str | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(source, target_share, max_repeats, available, used, most_repeats, actual_share) of every target."""
    counted, plan = plan_mixture(documents, targets, size, tokenizer, folder)
    got = _streams(counted, plan).groupBy("source").agg(F.sum("tokens").alias("used"), F.max("repeat").alias("most_repeats"))
    joined = plan.join(got, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return joined.select(
        "source", "target_share", "max_repeats", "available", "used", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.round(F.col("used") / F.sum("used").over(Window.partitionBy(F.lit(0))), 6).alias("actual_share"),
    )
