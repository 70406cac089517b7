"""Lines that one source repeats in many documents (problem 5).

The letters of a document are one stream, cut by content: a chunk ends where a rolling hash of the
last ``WINDOW`` bytes hits a mask (or ``MAX_CHUNK`` bytes behind the last end), wherever a line
ends. Whether an end lies at a place depends on the bytes before it alone, so a line holds the
same chunks in every document, apart from those that reach into its neighbours. Of every chunk
the distinct documents of its source are counted, with map-side sums; a line whose own chunks are
not all repeated cannot be repeated and falls out. Lines too short to hold a chunk of their own are
covered by none and stay. What is left is counted exactly, by distinct documents per whole line.
Lines are compared by their letters alone, in lower case.

Defined cases: null texts have no lines; a null source is a source of its own; lines without a
letter never count; rows delivered twice count once; a line twice in one document counts once
but is reported at both places; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.pages import letters
from presswork.session import stash

MAX_CHUNK, MASK, WINDOW = 1024, 0x1F, 8  # bytes of letters; one end in 32 places

_GEAR = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)


def hits(data: bytes) -> np.ndarray:
    """Places of a stream of letters (UTF-8) behind which the rolling hash ends a chunk."""
    n = len(data)
    gear = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(WINDOW, n)):
        rolled[k:] += gear[: n - k] << np.uint64(k)
    at = np.flatnonzero((rolled >> np.uint64(11)) & np.uint64(MASK) == 0) + 1
    return at[at >= WINDOW]


def _filled(places: list[int], start: int) -> list[int]:
    """The places, with those between them by which no chunk is longer than MAX_CHUNK."""
    ends = []
    for at in places:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        ends.append(at)
        start = at
    return ends


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a whole stream."""
    places = hits(data).tolist()
    return _filled(places if places and places[-1] == len(data) else [*places, len(data)], 0)


def own_chunks(places: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
    """The chunks that the line at begin:end of a stream has in any document that carries it."""
    own = places[np.searchsorted(places, begin + WINDOW) : np.searchsorted(places, end, side="right")].tolist()
    ends = _filled(own[1:], own[0]) if len(own) > 1 else []
    return list(zip([*own[:1], *ends], ends))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_chunks(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, line_no, line binary(16), head, tail, fresh array<bigint>): one row a line with
    a letter, its first and last own chunk, and its chunks that no earlier line of the document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            rows = []
            for i, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = []
                for raw in (text or "").split("\n"):
                    data = known.get(raw)
                    if data is None:
                        data = letters(raw).encode()
                        if len(raw) < 400:
                            if len(known) > 50_000:
                                known.clear()
                            known[raw] = data
                    pieces.append(data)
                stream = b"".join(pieces)
                places, at, counted = hits(stream), 0, set()
                for no, data in enumerate(pieces, 1):
                    if data:
                        chunks = [_signed(xxhash.xxh3_64_intdigest(stream[a:b])) for a, b in own_chunks(places, at, at + len(data))]
                        fresh = [c for c in dict.fromkeys(chunks) if c not in counted]
                        counted.update(fresh)
                        rows.append((i, source, no, xxhash.xxh3_128_digest(data), *((chunks[0], chunks[-1]) if chunks else (None, None)), fresh))
                        at += len(data)
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "source", "line_no", "line", "head", "tail", "fresh"])

    columns = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return columns.where("id is not null").mapInArrow(run, "id string, source string, line_no bigint, line binary, head bigint, tail bigint, fresh array<bigint>")


def repeated_chunks(lines: DataFrame, least: int) -> DataFrame:
    """(source, chunk): chunks that at least ``least`` documents of a source hold, where rows delivered twice count twice."""
    counted = lines.select("source", F.explode("fresh").alias("chunk")).groupBy("source", "chunk").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select("source", "chunk")


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5) -> DataFrame:
    """(id, line_no): every occurrence of a line that at least ``least`` documents of its source carry."""
    lines = stash(line_chunks(df, id_col, source_col, text_col))
    often = repeated_chunks(lines, least).select(F.col("source").alias("s"), "chunk")
    # all chunks of a repeated line are repeated; the first and the last are asked for, the exact count decides
    plain = lines.select("id", "source", "line_no", "line", "head", "tail")
    kept = plain.where("head is not null")
    for end in ("head", "tail"):
        kept = kept.join(often, F.col("source").eqNullSafe(F.col("s")) & (F.col(end) == F.col("chunk")), "left_semi")
    kept = kept.unionByName(plain.where("head is null")).select("id", "source", "line_no", "line")
    documents = kept.select("source", "line", "id").distinct().groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = kept.join(documents.select(F.col("source").alias("s"), F.col("line").alias("l")), F.col("source").eqNullSafe(F.col("s")) & (F.col("line") == F.col("l")), "left_semi")
    return found.select("id", "line_no").distinct()


def without_repeated(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5) -> DataFrame:
    """The input with the repeated lines cut from ``text_col``; other columns and rows stay as they are."""
    bad = repeated_lines(df, id_col, source_col, text_col, least).groupBy(F.col("id").alias("__id")).agg(F.collect_set("line_no").alias("__bad"))
    joined = df.join(bad, F.col(id_col).cast("string") == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.coalesce(F.array_contains("__bad", (i + 1).cast("bigint")), F.lit(False))), "\n")
    return joined.withColumn(text_col, F.when(F.col("__bad").isNull(), F.col(text_col)).otherwise(kept)).drop("__id", "__bad")
