"""Lines of pages that are not their article (problem 4); the block rules are in pages.py.

The rules read a page twice. What a page alone cannot tell, its source does: lines, and labels that
lead or trail lines, are counted per source over the corpus, and what a source has under ``least``
distinct titles is boilerplate. Copies of an article have one title and count once. The texts are
read once: the second pass works on one number a line, the repeated lines come to it by a join.

Defined cases: null and empty texts have no lines; lines without a letter are never reported;
a page of boilerplate alone has all its lines reported; a null source is a source of its own; a page
without a title counts as its text; rows delivered twice count once; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import pages, residue

LEAST = 5  # titles of one source under which a line is found


def _hash(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return x - (1 << 64) if x >= 1 << 63 else x


class Counted:
    """(what a page counts as, codes of its lines, numbers and keys of what is counted) of a page; short
    lines are remembered within a task. The last line may be cut anywhere and has no label behind it."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def keys(self, line: str) -> tuple[int, ...]:
        found = self.known.get(line)
        if found is None:
            found = tuple(_hash(k) if k else 0 for k in pages.marks(line))
            if len(line) < 200:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[line] = found
        return found

    def __call__(self, text: str, title: str | None, codes: list[int]) -> tuple:
        numbers, keys = [], []
        lettered = [i for i, c in enumerate(codes) if c & 7 != pages.NONE]
        lines = text.replace("\r", "").split("\n")
        for i in lettered:
            line, lead, trail = self.keys(lines[i])
            for key in (line, lead, trail if i != lettered[-1] else 0):
                if key:
                    numbers.append(i)
                    keys.append(key)
        return _hash((title or "").strip() or text), codes, numbers, keys


def repeated_lines(judged: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """(id, repeated array<int>): numbers from 0 of the lines that the source of a page repeats."""
    marks = judged.join(sources, "id").select("id", "source", "page", F.explode(F.arrays_zip("numbers", "keys")).alias("m"))
    marks = marks.select("id", "source", "page", F.col("m.numbers").alias("no"), F.col("m.keys").alias("key"))
    often = marks.select("source", "key", "page").distinct().groupBy("source", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return marks.join(often.select("source", "key"), ["source", "key"], "left_semi").groupBy("id").agg(F.collect_set("no").alias("repeated"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers = [], []
        for i, codes, repeated in zip(*(c.to_pylist() for c in batch.columns)):
            noise = [no for no, x in enumerate(pages.settle(codes, set(repeated or ())), 1) if x == pages.NOISE]
            ids += [i] * len(noise)
            numbers += noise
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int64())], names=["id", "line_no"])


def noise_lines(df: DataFrame, id_col: str = "id", title_col: str = "title", text_col: str = "content", source_col: str = "source_domain", least: int = LEAST) -> DataFrame:
    """(id, line_no): every line with a letter that holds nothing of the article's body, on pages
    that are not residue (problem 7). The text is read and judged once for both questions."""
    judged = residue.judged_pages(df, id_col, title_col, text_col, Counted(), "page bigint, codes array<int>, numbers array<int>, keys array<bigint>")
    once = judged.dropDuplicates(["id"])
    source = F.xxhash64(F.col(source_col).cast("string"))
    sources = df.select(F.col(id_col).cast("string").alias("id"), source.alias("source")).where("id is not null").dropDuplicates(["id"])
    left = once.select("id", "codes").join(residue.residue_ids(judged), "id", "left_anti")
    return left.join(repeated_lines(once, sources, least), "id", "left").mapInArrow(_settled, "id string, line_no bigint")


def main_body(df: DataFrame, title_col: str = "title", text_col: str = "content") -> DataFrame:
    """The input with ``text_col`` reduced to the article's body by the rules on single pages,
    without what the corpus tells of a source; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            titles = batch.column(batch.schema.get_field_index(title_col)).to_pylist()
            texts = [x and pages.main_text(x.replace("\r", ""), t, cache) for x, t in zip(batch.column(at).to_pylist(), titles)]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)
