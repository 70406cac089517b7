"""The most similar vectors for every vector (problem 3), by a permutation index.

A sample of the vectors serves as pivots, one for every ``ROWS_PER_PIVOT`` vectors between 4,096 and
65,536 of them. Each vector is represented by the order of its nearest pivots, which are looked up
in two levels, and posted in the inverted files of the first of them. Within a file, pairs are
ranked by the footrule distance of their pivot orders; those within the radius are reranked by
cosine. A file of more than ``max_list`` rows is worked off in pairs of blocks, which compare the
same pairs as one task would, so no task ever holds an unbounded group and no pair is lost to size.
As pivots are drawn from the vectors, a dense region has as many of them as it has vectors, and
files keep their size as the collection grows.

Postings carry unit vectors in fixed point, 32 bits an element (cosines to 1e-9).

Equal vectors are indexed once and share their neighbours. Defined cases: null vectors, zero
vectors and vectors with nulls or another number of elements take no part; rows delivered twice
count once; equal cosines (to 9 decimals) rank by the smaller id; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presswork.session import stash

PIVOTS, MOST_PIVOTS = 4096, 65_536  # bounds of the sample from which the index is fitted
ROWS_PER_PIVOT = 25
SEARCHED = 24  # cells of pivots that are looked through for a vector's nearest
ORDER = 8  # pivots kept of each vector's order
POSTED = 5  # files that each vector is posted in
MAX_LIST = 3000  # rows of a file, or of each of a pair of blocks, in one task
SCALE = float(2**30)  # fixed point of an element of a unit vector
TASK_BYTES, POSTING_BYTES = 48_000_000, 340  # postings in one task of the comparison; size of one


def footrule_radius(order: int = ORDER) -> int:
    """Largest footrule distance of two orders that is reranked: all but those that share next to nothing."""
    return order * (order + 1) - 2 * (order // 2)


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.values, dtype=np.float64)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(-1, dim)


class Pivots:
    """Pivots in cells around every sqrt(n)-th of them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float32)
        self.heads = self.pivots[: max(1, int(np.sqrt(len(pivots))))]
        home = np.concatenate([np.argmax(self.pivots[i : i + 4096] @ self.heads.T, axis=1) for i in range(0, len(pivots), 4096)])
        self.cells = [np.flatnonzero(home == c) for c in range(len(self.heads))]

    def nearest(self, units: np.ndarray, order: int) -> np.ndarray:
        """The nearest pivots of each unit vector in order, from the SEARCHED nearest cells."""
        k = min(order, len(self.pivots))
        u = units.astype(np.float32)
        wide = min(max(SEARCHED, k), len(self.heads))
        close = u @ self.heads.T
        cells = np.argpartition(-close, wide - 1, axis=1)[:, :wide]
        sims = np.full((len(u), wide * k), -2, dtype=np.float32)
        found = np.zeros((len(u), wide * k), dtype=np.int32)
        flat = cells.ravel()
        by_cell = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[by_cell], np.arange(len(self.heads) + 1))
        for c, members in enumerate(self.cells):
            rows, at = np.divmod(by_cell[bounds[c] : bounds[c + 1]], wide)
            if not len(rows) or not len(members):
                continue
            got = u[rows] @ self.pivots[members].T
            top = min(k, len(members))
            part = np.argpartition(-got, top - 1, axis=1)[:, :top]
            columns = at[:, None] * k + np.arange(top)
            sims[rows[:, None], columns] = np.take_along_axis(got, part, 1)
            found[rows[:, None], columns] = members[part]
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        by = np.take_along_axis(sims, best, 1)
        best = np.take_along_axis(best, np.argsort(-by, axis=1, kind="stable"), 1)
        return np.take_along_axis(found, best, 1)


def pivot_orders(df: DataFrame, pivots: np.ndarray, dim: int, order: int, posted: int) -> DataFrame:
    """(rep, unit binary, near binary, files array<int>) of (rep, v): unit vectors in fixed point, the
    order of their nearest pivots (16 bits each), and the files they are posted in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Pivots(pivots)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit_rows(batch.column(1), dim)
            norm = np.sqrt((v * v).sum(1))
            keep = np.isfinite(norm) & (norm > 0)
            u = v[keep] / norm[keep, None]
            near = index.nearest(u, order)
            fixed = np.rint(u * SCALE).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(near[:, :posted]).ravel()), min(posted, near.shape[1])).cast(pa.list_(pa.int32()))
            binary = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (fixed, near.astype(np.uint16))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), *binary, lists], names=["rep", "unit", "near", "files"])

    return df.select("rep", "v").mapInArrow(run, "rep string, unit binary, near binary, files array<int>")


def footrule(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """Footrule distances of two sets of pivot orders; a pivot outside an order counts as just behind it."""
    k = near_a.shape[1]
    common = np.zeros((len(near_a), len(near_b)), dtype=np.int16)
    for i in range(k):
        for j in range(k):
            common += (near_a[:, i, None] == near_b[None, :, j]) * np.int16(k - max(i, j))
    return np.int16(k * (k + 1)) - 2 * common


def _best_of_list(threshold: float, top: int, radius: int):
    """Of one file (or pair of blocks): each vector's ``top`` most similar partners."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        reps = rows["rep"].to_numpy(object)
        u = np.frombuffer(b"".join(rows["unit"]), dtype=np.int32).reshape(len(rows), -1) / SCALE
        near = np.frombuffer(b"".join(rows["near"]), dtype=np.uint16).reshape(len(rows), -1).astype(np.int32)
        side = rows["side"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for begin in range(0, len(rows), 512):
            a = slice(begin, begin + 512)
            cos = u[a] @ u.T
            ok = cos >= threshold - 1e-10
            hit = ok.any(1)
            if not hit.any():
                continue
            index = np.flatnonzero(hit) + begin
            ok = ok[hit] & (footrule(near[index], near) <= radius) & (np.arange(len(rows))[None, :] != index[:, None])
            if key[1] != key[2]:
                ok &= side[index][:, None] != side[None, :]
            x, y = np.nonzero(ok)
            c = np.round(cos[hit][x, y], 9)
            at = np.lexsort((y, -c, x))  # rows are in the order of their ids
            x, y, c = x[at], y[at], c[at]
            first = np.searchsorted(x, x)
            best = (np.arange(len(x)) - first) < top
            out.append((index[x[best]], y[best], c[best]))
        if not out:
            return pd.DataFrame({"x": [], "y": [], "cos": []}).astype({"x": object, "y": object, "cos": float})
        x, y, c = (np.concatenate(p) for p in zip(*out))
        return pd.DataFrame({"x": reps[x], "y": reps[y], "cos": c})

    return run


def _postings(orders: DataFrame, max_list: int) -> DataFrame:
    """(p, b, e, side, rep, unit, near): the rows of each file, of large files by pairs of blocks b and e."""
    posts = orders.select("rep", "unit", "near", F.explode("files").alias("p"))
    # one row a file at most: bounded by the pivots
    large = orders.select(F.explode("files").alias("p")).groupBy("p").agg(F.ceil(F.count("*") / F.lit(max_list)).cast("int").alias("blocks")).where("blocks > 1")
    sized = posts.join(F.broadcast(large), "p", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cutup = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = cutup.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("p", F.least("own", "with").alias("b"), F.greatest("own", "with").alias("e"), F.col("own").alias("side"), "rep", "unit", "near")


def nearest_pairs(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, threshold: float = 0.85, top: int = 5,
    pivots: int | None = None, order: int = ORDER, posted: int = POSTED, max_list: int = MAX_LIST, radius: int | None = None,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with a cosine of at least the threshold, one of them among
    the ``top`` most similar of the other."""
    usable = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    )
    keyed = usable.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.reverse("v")).alias("k2"))
    reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("v").alias("v"))
    reps = stash(reps)
    # the vectors with the least hashes; those beyond twice the wanted share are not even sorted,
    # so what the tasks hand over stays a few thousand rows, however many tasks there are
    count = reps.count()
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, -(-count // ROWS_PER_PIVOT)))
    share = min(1.0, 2 * pivots / max(1, count))
    least = reps.where(F.col("k1") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else reps
    sample = least.select("v").orderBy("k1", "k2").limit(pivots).collect()
    fitted = np.array([r["v"] for r in sample], dtype=np.float64).reshape(-1, dim)
    norms = np.sqrt((fitted * fitted).sum(1))
    fitted = fitted[norms > 0] / norms[norms > 0, None]
    if not len(fitted):
        return df.sparkSession.createDataFrame([], "id_a string, id_b string")
    orders = stash(pivot_orders(reps, fitted, dim, order, posted))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * posted * POSTING_BYTES // TASK_BYTES))
    files = _postings(orders, max_list).repartition(tasks, "p", "b", "e").groupBy("p", "b", "e")
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("cos", T.DoubleType())])
    links = files.applyInPandas(_best_of_list(threshold, top, footrule_radius(order) if radius is None else radius), schema).distinct()
    # equal vectors: everybody's neighbours are the smallest ids of the neighbouring classes
    member = keyed.select("id", "k1", "k2").distinct().join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("rep", "id")
    smallest = member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= top + 1)
    own = orders.select("rep").join(smallest.where("n > 1").select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("cos"))
    found = links.unionByName(own).join(smallest.select(F.col("rep").alias("y"), F.col("id").alias("other")), "y")
    lists = found.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cos"), "other"))).where(F.col("n") <= top + 1)
    each = lists.join(member.withColumnRenamed("rep", "x"), "x").where("id != other")
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))).where(F.col("n") <= top)
    return ranked.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
