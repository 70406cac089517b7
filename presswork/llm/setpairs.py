"""All pairs of records whose sets of values overlap strongly (problem 2).

Every set gets a binary sketch of one-bit minhashes packed into 64-bit words. Candidates come
from a multi-index, pass a Hamming radius calibrated for the threshold, and are verified on the
original sets. Two indexes exist:

* ``anchor=True`` (default): each record is posted under its rarest tokens, as many as any
  partner above the threshold must share one of; tokens held by more than ``hot`` sets are
  posted only together with a second token of the prolonged prefix, which partners must share
  as well. Both rules are exact, so the only loss is that of the radius (under 1e-6 a pair).
* ``anchor=False``: the plain pigeonhole index, ``segments`` segments of ``width`` bits of the
  code. At a Jaccard of 0.6 a bit agrees with probability 0.8 only, hence a radius of about a
  third of the code, and a pigeonhole guarantee would need segments of two or three bits.
  README has the figures that made it second choice.

Defined cases: null sets and null or blank values are ignored; values are compared trimmed,
with single spaces, in lower case; repeated values count once; sets smaller than ``min_size``
take no part; rows delivered twice count once; empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.session import cut

WORDS = 4  # 64-bit words of a code: 256 one-bit minhashes
HOT = 2000  # a token in more sets than this is posted in pairs


def clean_set(values: Column) -> Column:
    """Sorted distinct values in the form in which they are compared."""
    spaced = F.transform(values, lambda v: F.lower(F.trim(F.regexp_replace(v, r"[\s ]+", " "))))
    return F.array_sort(F.array_distinct(F.filter(spaced, lambda v: v.isNotNull() & (v != ""))))


def hamming_radius(threshold: float, bits: int = 64 * WORDS, sigmas: float = 4.9) -> int:
    """Distance that a pair at the threshold exceeds with a probability below 1e-6."""
    p = (1 - threshold) / 2
    return math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: public constants."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_bit_codes(flat: np.ndarray, starts: np.ndarray, words: int = WORDS) -> np.ndarray:
    """(sets, words) int64: bit i is the lowest bit of the least hash under function i.

    flat holds the 64-bit token hashes of all sets one after another, starts where each begins.
    """
    seeds = _mix(np.arange(1, 64 * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes = np.zeros((len(starts), words), dtype=np.uint64)
    flat = flat.astype(np.uint64)
    for i, seed in enumerate(seeds):
        least = np.minimum.reduceat(_mix(flat ^ seed), starts)
        codes[:, i // 64] |= ((least >> np.uint64(7)) & np.uint64(1)) << np.uint64(i % 64)
    return codes.view(np.int64)


def _with_codes(df: DataFrame) -> DataFrame:
    """Add code array<bigint> from hashes array<bigint> (never empty); other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column(batch.schema.get_field_index("hashes"))
            offsets = np.asarray(hashes.offsets)
            flat = np.asarray(hashes.values)[offsets[0] : offsets[-1]]
            codes = one_bit_codes(flat, offsets[:-1] - offsets[0])
            column = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "code"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", code array<bigint>"
    return df.mapInArrow(run, schema)


def classes(df: DataFrame, id_col: str, set_col: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, class), (class sets: class, tokens). Equal sets form one class, named by a digest."""
    items = df.select(F.col(id_col).alias("id"), clean_set(F.col(set_col)).alias("tokens")).where((F.size("tokens") >= min_size) & F.col("id").isNotNull())
    items = cut(items.withColumn("class", F.md5(F.concat_ws("\u001f", "tokens"))).dropDuplicates(["id"]))
    return items.select("id", "class"), items.groupBy("class").agg(F.first("tokens").alias("tokens"))


def _sized(sets: DataFrame) -> DataFrame:
    """Add hashes: the token hashes from the rarest to the most frequent, with their counts."""
    long = sets.select("class", F.explode("tokens").alias("token")).select("class", F.xxhash64("token").alias("h"))
    counts = long.groupBy("h").agg(F.count("*").alias("n"))
    ordered = long.join(counts, "h").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("o"))
    return ordered.select("class", F.col("o.h").alias("hashes"), F.col("o.n").alias("counts"))


def _anchors(threshold: float, hot: int) -> Column:
    """Keys array<bigint> of a set: rare prefix tokens, hot ones joined with each other prefix token."""
    size = F.size("hashes")
    length = (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    prefix = F.slice(F.arrays_zip("hashes", "counts"), 1, length)
    longer = F.slice("hashes", F.lit(1), F.least(length + 1, size))
    pairs = lambda x: F.transform(F.filter(longer, lambda y: y != x["hashes"]), lambda y: F.xxhash64(F.least(x["hashes"], y), F.greatest(x["hashes"], y)))
    return F.array_distinct(F.flatten(F.transform(prefix, lambda x: F.when(x["counts"] > hot, pairs(x)).otherwise(F.array(x["hashes"])))))


def _segments(segments: int, width: int) -> Column:
    """Keys array<bigint> of a code: segment number and its bits."""
    keys = []
    for k in range(segments):
        bit = k * width
        word, at = F.col("code")[bit // 64], bit % 64
        bits = F.shiftrightunsigned(word, at)
        if at + width > 64:
            bits = bits.bitwiseOR(F.shiftleft(F.col("code")[bit // 64 + 1], 64 - at))
        keys.append(F.lit(k << 32) + bits.bitwiseAND(F.lit((1 << width) - 1)))
    return F.array(*keys)


def class_links(sets: DataFrame, threshold: float, anchor: bool = True, hot: int = HOT, segments: int = 21, width: int = 12) -> DataFrame:
    """(a, b, jaccard): pairs of different classes at or above the threshold, a < b."""
    coded = _with_codes(_sized(sets)).select("class", "code", F.size("hashes").alias("n"), (_anchors(threshold, hot) if anchor else _segments(segments, width)).alias("keys"))
    posts = coded.select("class", "n", F.struct(*[F.col("code")[i].alias(f"w{i}") for i in range(WORDS)]).alias("c"), F.explode("keys").alias("key"))
    left, right = posts.alias("l"), posts.alias("r")
    distance = sum((F.bit_count(F.col(f"l.c.w{i}").bitwiseXOR(F.col(f"r.c.w{i}"))) for i in range(WORDS)), F.lit(0))
    near = (
        left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.class") < F.col("r.class")))
        .where((F.least("l.n", "r.n") >= F.lit(threshold) * F.greatest("l.n", "r.n") - 1e-9) & (distance <= hamming_radius(threshold)))
        .select(F.col("l.class").alias("a"), F.col("r.class").alias("b"))
        .distinct()
    )
    a, b = (sets.select(F.col("class").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ta", "tb"))
    return near.join(a, "a").join(b, "b").select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def linked_classes(df: DataFrame, id_col: str, set_col: str, threshold: float = 0.6, min_size: int = 3, **index: object) -> DataFrame:
    """(id, class, links): every record with the class of records whose sets equal its own, and how many
    other classes are linked to it. Copies are not expanded into pairs, however many they are."""
    members, sets = classes(df, id_col, set_col, min_size)
    links = class_links(sets, threshold, **index).select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(links, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def similar_pairs(df: DataFrame, id_col: str, set_col: str, threshold: float = 0.6, min_size: int = 3, **index: object) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records at or above the threshold."""
    members, sets = classes(df, id_col, set_col, min_size)
    links = class_links(sets, threshold, **index).select("a", "b")
    m1, m2 = (members.select(F.col("class").alias(c), F.col("id").alias(i)) for c, i in (("a", "i"), ("b", "j")))
    across = links.join(m1, "a").join(m2, "b").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    within = m1.join(m2, F.col("a") == F.col("b")).where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
    return across.unionByName(within)
