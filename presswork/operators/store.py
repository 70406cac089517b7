"""Tables that change: versions on disk, appends, upserts, updates by key and deletes, as set operations.

A plain Spark has no transactions over tables. A table is a sequence of numbered manifests, each
of which names the parquet folders that make up one version. An append writes its batch and a
manifest that adds one folder; a change of other rows writes new folders. A manifest is written
aside and renamed to the next number, so readers see one version or the other, and of two writers
only one gets the number. Several tables change one after the other; ``Store.change`` writes the
data of all of them before it publishes the first.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswork import schema
from presswork.functions import urls


class Store:
    """Named tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def _parts(self, name: str, number: int | None = None) -> list[tuple[str, tuple[str, ...]]]:
        """(folder, columns) of the parts of a version, by default the current one."""
        numbers = self._numbers(name)
        if not numbers:
            return []
        lines = self.spark.read.text(f"{self.root}/{name}/manifests/{numbers[-1] if number is None else number:012d}").collect()  # one row a part
        return [(folder, tuple(columns.split(","))) for folder, _, columns in (r[0].partition("\t") for r in lines) if folder]

    def read(self, name: str) -> DataFrame:
        """The table in today's columns. Parts of one set of columns are one scan."""
        parts = self._parts(name)
        groups = {columns: [f"{self.root}/{name}/{f}" for f, c in parts if c == columns] for _, columns in parts}
        read = [schema.upgraded(self.spark, self.spark.read.parquet(*folders), name) for folders in groups.values()]
        return reduce(DataFrame.unionByName, read) if read else schema.empty(self.spark, name)

    def _write(self, name: str, df: DataFrame) -> tuple[str, tuple[str, ...]]:
        folder = f"v-{uuid.uuid4().hex}"
        df = schema.upgraded(self.spark, df, name)
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return folder, tuple(df.columns)

    def _publish(self, name: str, parts: list[tuple[str, tuple[str, ...]]], after: int) -> None:
        aside = self._path(f"{self.root}/{name}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray("\n".join(f"{folder}\t{','.join(columns)}" for folder, columns in parts).encode()))
        out.close()
        target = self._path(f"{self.root}/{name}/manifests/{after + 1:012d}")
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer changed {name}")

    def _last(self, name: str) -> int:
        return max(self._numbers(name), default=0)

    def swap(self, name: str, df: DataFrame) -> None:
        """Replace a table."""
        self.change({name: df})

    def change(self, tables: dict[str, DataFrame]) -> None:
        """Replace several tables: all of them are written before the first is published."""
        last = {name: self._last(name) for name in tables}
        written = {name: self._write(name, df) for name, df in tables.items()}
        for name, part in written.items():
            self._publish(name, [part], last[name])

    def append(self, name: str, df: DataFrame, unique: list[str] | None = None) -> DataFrame:
        """Add the rows whose unique columns are not there yet; returns what was added, as written."""
        last, parts = self._last(name), self._parts(name)
        part = self._write(name, insert_new(self.read(name), df, unique) if unique else df)
        self._publish(name, [*parts, part], last)
        return self.spark.read.parquet(f"{self.root}/{name}/{part[0]}")

    def compact(self, name: str) -> None:
        """Bring the parts of a table into one folder; for the time between loads."""
        self.swap(name, self.read(name))

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions has; returns how many."""
        numbers = self._numbers(name)
        used = {folder for n in numbers[-keep:] for folder, _ in self._parts(name, n)}
        old = {folder for n in numbers[:-keep] for folder, _ in self._parts(name, n)} - used
        for folder in old:
            self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{name}/manifests/{n:012d}"), False)
        return len(old)


def insert_new(old: DataFrame, new: DataFrame, unique: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, one a key."""
    return new.dropDuplicates(unique).join(old.select(*unique), unique, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Old rows with ``columns`` replaced where ``new`` has the key, and the rows that only ``new`` has."""
    marked = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in old.columns if c != key and c in new.columns])
    joined = old.withColumn("__old", F.lit(True)).join(marked, F.col(key) == F.col("__key"), "full_outer")
    have, here = F.col("__key").isNotNull(), F.col("__old").isNotNull()

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "__key").alias(key)
        if c not in new.columns:
            return F.col(c)
        return F.when(here & ~(have & F.lit(c in columns)), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)

    return joined.select(*[pick(c) for c in old.columns])


def update_by_key(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Old rows with the columns of ``changes`` (one row a key), where it has a value."""
    names = [c for c in changes.columns if c != key]
    joined = old.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def latest_value(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """A log of settings as one value a key: the last written."""
    order = Window.partitionBy(key).orderBy(F.desc(stamp))
    return old.unionByName(new).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def count_hits(stories: DataFrame, hits: DataFrame) -> DataFrame:
    """Stories with their reuse counter raised by one a hit (column id)."""
    counted = hits.groupBy("id").agg(F.count("*").alias("__hits"))
    return stories.join(counted, "id", "left").withColumn("reused_count", F.col("reused_count") + F.coalesce("__hits", F.lit(0))).drop("__hits")


def user_sources(typed: DataFrame) -> DataFrame:
    """Sources as users add them (domain, and optionally a name), with the defaults of user-added ones."""
    domain = urls.user_domain(F.col("domain"))
    name = F.col("display_name") if "display_name" in typed.columns else F.lit(None).cast("string")
    return typed.where(domain != "").select(
        domain.alias("domain"), F.coalesce(name, domain).alias("display_name"), F.lit(70.0).alias("credibility_score"), F.lit("mostly-factual").alias("factual_reporting"),
        F.lit("center").alias("bias_rating"), F.lit("User-added source").alias("notes"),
    )


def delete_user_source(sources: DataFrame, domain: str) -> DataFrame:
    """Without the source, if users added it; others stay."""
    return sources.where(~((F.col("domain") == domain.lower()) & F.coalesce(F.col("notes").contains("User-added"), F.lit(False))))


def merge_clusters(articles: DataFrame, stories: DataFrame, clusters: DataFrame, merges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after merges (victim, survivor): rows re-pointed, victims gone, survivors touched."""
    from presswork.operators.clusters import repoint

    kept = clusters.join(merges.select(F.col("victim").alias("id")), "id", "left_anti")
    touched = kept.join(merges.select(F.col("survivor").alias("id"), F.lit(True).alias("__t")).distinct(), "id", "left")
    touched = touched.withColumn("last_updated_at", F.when(F.col("__t"), now).otherwise(F.col("last_updated_at"))).drop("__t")
    return repoint(articles, merges), repoint(stories, merges), touched
