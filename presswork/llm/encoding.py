"""Token ids of a whole corpus by a public byte-level BPE (problem 8).

Content-defined chunk reuse: a text is cut where a rolling hash of its bytes hits a mask, so that
passages shared by documents give the same chunks wherever they stand. A task encodes a chunk
once and takes it from a bounded table the next time; chunks of different tasks are not
exchanged, since shuffling the corpus costs more than encoding it (figures in the README).

Joins: the tokenizer never merges across the places where its pattern splits, and it always
splits between a character that is not white space and a white space. A join at such a place is
exact. Any other join is repaired by re-encoding both chunks together, widening until both ends
are such places; what is emitted then agrees with the encoding of the whole text.

Defined cases: null and empty texts give an empty list; strings that look like special tokens
are ordinary text; rows delivered twice give one row; empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import stash

TOKENIZERS = os.environ.get("PRESSWORK_TOKENIZERS", "/opt/tokenizers")
WINDOW, MASK, LEAST, MOST = 8, 0x7F, 192, 4096  # bytes: one boundary in 128 positions beyond LEAST
CACHE_BYTES = 24_000_000  # texts that a task's table of chunks holds before it is emptied
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GEAR = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def encoder(name: str, folder: str):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as ranks:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 text; never inside a character."""
    n = len(data)
    if n <= 2 * LEAST:
        return [n]
    raw = np.frombuffer(data, dtype=np.uint8)
    gear = _GEAR[raw]
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled[k:] += gear[: n - k] << np.uint64(k)
    hit = (rolled >> np.uint64(9)) & np.uint64(MASK) == 0
    # the next place at or behind a hit where a space follows another character
    safe = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
    wanted = np.flatnonzero(hit) + 1
    places = np.unique(safe[np.minimum(np.searchsorted(safe, wanted), len(safe) - 1)]) if len(safe) else wanted[:0]
    out, start = [], 0
    for at in places.tolist():
        if at - start >= LEAST:
            out.append(at)
            start = at
    # runs without such a place are cut by length, and their joins are repaired
    full, start = [], 0
    for at in [*out, n]:
        while at - start > MOST:
            end = start + MOST
            while end > start and (data[end] & 0xC0) == 0x80:
                end -= 1
            full.append(end)
            start = end
        if at > start:
            full.append(at)
            start = at
    return full


def exact_join(data: bytes, at: int) -> bool:
    """Does the tokenizer split at this place whatever surrounds it?"""
    return at in (0, len(data)) or (data[at] == 32 and 32 < data[at - 1] < 127)


def encode(text: str, tokenizer, table: dict[bytes, np.ndarray] | None = None) -> np.ndarray:
    """Ids of a text, equal to tokenizer.encode_ordinary(text)."""
    data = text.encode("utf-8", "replace")
    ends = cuts(data)
    if len(ends) == 1 and table is None:
        return tokenizer.encode_to_numpy(text, disallowed_special=())
    out, start = [], 0
    for end in ends:
        if not exact_join(data, end):
            continue  # repaired: this chunk is encoded together with the next
        chunk = data[start:end]
        ids = table.get(chunk) if table is not None else None
        if ids is None:
            ids = tokenizer.encode_to_numpy(chunk.decode(), disallowed_special=())
            if table is not None and len(chunk) <= 2 * MOST:
                table[chunk] = ids
        out.append(ids)
        start = end
    return np.concatenate(out)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) without repeated rows. Only ids are exchanged to find the repeated ones; the
    list of those is written, and joined by broadcast if the planner finds its files small enough."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    again = stash(texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    return texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").dropDuplicates())


def _encoded(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    tokenizer = encoder(name, folder)
    table: dict[bytes, np.ndarray] = {}
    held = 0
    for batch in batches:
        rows = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            if not text:
                rows.append(np.empty(0, dtype=np.uint32))
                continue
            rows.append(encode(text, tokenizer, table))
            held += len(text)
            if held > CACHE_BYTES:
                table.clear()
                held = 0
        yield batch, rows


def corpus_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _encoded(batches, tokenizer, folder):
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in rows], out=offsets[1:])
            flat = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, tokens int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _encoded(batches, tokenizer, folder):
            counts = pa.array([len(x) for x in rows], pa.int32())
            others = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*others, counts], names=[*(n for n in batch.schema.names if n != "text"), "tokens"])

    columns = df.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in keep], F.col(text_col).alias("text"))
    return columns.where("doc_id is not null").mapInArrow(run, ", ".join(["doc_id bigint", *(f"`{c}` string" for c in keep), "tokens int"]))
