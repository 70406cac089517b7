"""Texts that stop before they end (problem 6), and how often each source truncates.

1. Each text's end is read: marks of a cut (ellipses in brackets, counts of missing characters,
   invitations to read on, half tags and half citations) are taken off, which leaves the length
   at which it was cut. An end is *open* (a cut mark, or prose without an end), *doubtful* (a
   line that need not end with a full stop, such as a list item) or *closed*.
2. Discrete hazards by length, in three measures, as fields are limited in different ones
   (characters without marks, characters, bytes): of the texts of a source that reach a length, the
   share that stops there, against the hazard of the neighbouring lengths, by window functions.
   Lengths with a significant excess (Benjamini-Hochberg at 0.01 %, since thousands of lengths are
   no limits) are field limits.
3. Ends are weighed together with their lengths: an open end is a case, a doubtful one is a case
   at a significant length. Texts cut in transfer have no length in common, so that open ends
   count elsewhere too; ``at_limit`` tells which cases a limit explains.

An ellipsis that closes many different texts in the same words is a manner of closing, not a cut;
copies of one text count once.
Defined cases: null, empty and blank texts are no cases; rows delivered twice count once; a null
source is a source of its own; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from presswork.llm import pages, residue
from presswork.session import stash

NEIGHBOURS = 60  # lengths on either side that the hazard at a length is held against
LEAST = 3  # texts that stop at a length before it is tested
FALSE_DISCOVERY = 0.0001
CLOSED, DOUBTFUL, OPEN, ELLIPSIS = 0, 1, 2, 3

_INVITATION = re.compile(
    r"\s*[\[(]?\s*(?:read (?:on|more|the (?:full|whole|rest).{0,20})|continue reading.{0,20}|(?:see|show|view) more|more|mehr|weiterlesen|mehr lesen|lire la suite|la suite|suite|seguir leyendo|leer más|más|continued|tbc)\s*[\])]?\s*[»›→>]*\s*$", re.IGNORECASE
)
_BRACKETED = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\[\s*\+\s*[\d.,]+(?:\s*\w+)?\s*\])\s*$")
_DOTS = re.compile(r"\s*(?:\.\.\.|…)\s*$")
_MARKUP = re.compile(r"\s*(?:<[a-zA-Z/!]{0,12}(?:\s[^<>]{0,60})?|&(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{1,7}))$")
_JSON = re.compile(r"[\"”]\s*,\s*(?:\\n|\n)?\s*\"\w*$|\\[nu\"][0-9a-f]{0,3}$")
_CITATION = re.compile(r"\[(?:\^[^\]\n]*)?$")
_STOPPED = re.compile(r"(?:[.!?](?:[”“»’\"')\]]|\s*\[\^[^\]]*\])*|[”»]|\]|\((?:ends|ende|fin|end)\))$", re.IGNORECASE)


def end_of(text: str, page: bool, title: str | None = None, cache: dict | None = None) -> tuple[int, int, str]:
    """(state, length without the marks of a cut, last sentence) of a text that is not blank."""
    base = text.rstrip()
    marked = False
    for pattern in (_INVITATION, _BRACKETED, _DOTS, _MARKUP, _JSON):
        found = pattern.search(base[-160:])
        if not found:
            continue
        rest = base[: len(base) - len(base[-160:]) + found.start()]
        if pattern is _INVITATION and not (found[0].strip()[:1] in "[(" or _DOTS.search(rest) or "»" in found[0]):
            continue
        if pattern is _DOTS and not marked:
            lines = rest.replace("\r", "").split("\n")
            # dots end a message or a footer as well as a cut paragraph
            if page and (pages.label_lines(lines, title, cache)[-1] != pages.BODY or residue.message_line(lines[-1])):
                return CLOSED, len(rest), ""
            sentence = re.split(r"[.!?”»\]\n]\s+", rest[-300:])[-1]
            return ELLIPSIS, len(rest), " ".join(sentence.lower().split())
        marked, base = True, rest
    if marked:
        return OPEN, len(base), ""
    if _CITATION.search(base[-300:]):
        return OPEN, len(base), ""
    lines = base.replace("\r", "").split("\n")
    tail = lines[-1].strip()
    if _STOPPED.search(tail) or page and residue.message_line(tail):
        return CLOSED, len(base), ""
    if page:
        label = pages.label_lines(lines, title, cache)[-1]
        if label != pages.BODY:
            # a footer that is whole ends the text; one that matches nothing known may have been cut
            return (DOUBTFUL if pages.classify(lines[-1])[0] == pages.OPEN else CLOSED), len(base), ""
    words, item = len(pages._WORD.findall(tail)), tail[:1] in "-•*·"
    if not item and (words >= 3 and not re.search(r"\w\.\w+$", tail) or re.search(r"[.!?”»\]]\s+\S", tail)):
        return OPEN, len(base), ""
    return DOUBTFUL, len(base), ""


def before_closing(text: str, length: int, closing: str) -> str:
    """Digest of a text without its mark of a cut and its last sentence, the closing."""
    words = " ".join(text[:length].lower().split())
    return xxhash.xxh3_128_hexdigest(words.removesuffix(closing).rstrip().encode())


def ends(df: DataFrame, kind: str, id_col: str, source_col: str, text_col: str, title_col: str | None, page: bool) -> DataFrame:
    """(kind, id, source, length, chars, bytes, state, closing, before) of every text; ``before`` for ellipses only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for i, source, text, title in zip(*(c.to_pylist() for c in batch.columns)):
                if text and text.strip():
                    state, length, closing = end_of(text, page, title, cache)
                    rows.append((kind, i, source, length, len(text), len(text.encode("utf-8", "replace")), state, closing, before_closing(text, length, closing) if state == ELLIPSIS else None))
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "id", "source", "length", "chars", "bytes", "state", "closing", "before"])

    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    columns = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), title.alias("title"))
    return columns.where("id is not null").mapInArrow(run, "kind string, id string, source string, length bigint, chars bigint, bytes bigint, state int, closing string, before string")


@F.pandas_udf(T.DoubleType())
def _poisson_tail(seen: pd.Series, expected: pd.Series) -> pd.Series:
    """P(X >= seen) of a Poisson variable."""

    def tail(k: int, mean: float) -> float:
        below, term = 0.0, math.exp(-mean)
        for i in range(int(k)):
            below += term
            term *= mean / (i + 1)
        return max(0.0, 1.0 - below) if below < 1 - 1e-9 else term * 1.5

    return pd.Series([tail(k, m) for k, m in zip(seen, expected)])


MEASURES = ("length", "chars", "bytes")


def _measured(found: DataFrame, *columns: str) -> DataFrame:
    """(kind, source, *columns, measure, length): one row a text and measure."""
    sizes = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES])).alias("m")
    return found.select("kind", "source", *columns, sizes).select("kind", "source", *columns, "m.measure", "m.length")


def limits(found: DataFrame) -> DataFrame:
    """(kind, source, measure, length, stopped, reached, p): lengths at which a source's texts stop significantly often."""
    # open and doubtful ends are what a limit produces; closed ends only count as texts that were at risk
    series = ["kind", "source", "measure"]
    counts = _measured(found, "state").groupBy(*series, "length").agg(F.count("*").alias("n"), F.count_if(F.col("state") != CLOSED).alias("stopped"))
    near = Window.partitionBy(series).orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    hazards = counts.withColumn("reached", F.sum("n").over(Window.partitionBy(series).orderBy(F.desc("length"))))
    hazards = hazards.withColumn("around_n", F.sum("stopped").over(near) - F.col("stopped")).withColumn("around", F.greatest("around_n", F.lit(1)) / (F.avg("reached").over(near) * 2 * NEIGHBOURS))
    tested = hazards.where(F.col("stopped") >= LEAST).withColumn("p", _poisson_tail("stopped", F.col("reached") * F.col("around")))
    # at most one row per source, measure and length with LEAST stops: what is ranked here does not grow with the texts
    order = Window.partitionBy("kind").orderBy("p", "source", "length", "measure")
    tests = F.count("*").over(Window.partitionBy("kind"))
    ranked = tested.withColumn("bound", FALSE_DISCOVERY * F.row_number().over(order) / tests)
    cut = ranked.withColumn("worst", F.max(F.when(F.col("p") <= F.col("bound"), F.col("p"))).over(Window.partitionBy("kind")))
    return cut.where(F.col("p") <= F.col("worst")).select(*series, "length", "stopped", "reached", "p")


def truncated(found: DataFrame) -> DataFrame:
    """(kind, id, source, at_limit) of the cases among ``found``, which holds the ends of all texts."""
    manner = found.where(F.col("state") == ELLIPSIS).select("kind", "closing", "before").distinct().groupBy("kind", "closing").agg(F.count("*").alias("n"))
    total = found.where(F.col("state") == ELLIPSIS).groupBy("kind").agg(F.countDistinct("closing", "before").alias("all"))
    manner = manner.join(total, "kind").where((F.col("n") >= 3) & (F.col("n") >= 0.05 * F.col("all")) & (F.size(F.split("closing", " ")) >= 3)).select("kind", "closing")
    judged = found.join(manner.withColumn("customary", F.lit(True)), ["kind", "closing"], "left")
    state = F.when(F.col("state") == ELLIPSIS, F.when(F.col("customary"), CLOSED).otherwise(OPEN)).otherwise(F.col("state"))
    judged = judged.withColumn("state", state).drop("customary", "closing", "before")
    at = limits(judged).select(F.col("kind").alias("k"), F.col("source").alias("s"), F.col("measure").alias("m"), F.col("length").alias("l"))
    stops = _measured(judged.where(F.col("state") != CLOSED), "id")
    same = (F.col("kind") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("length") == F.col("l"))
    limited = stops.join(at, same, "left_semi").select("kind", "id").distinct().withColumn("at_limit", F.lit(True))
    full = judged.where(F.col("state") != CLOSED).join(limited, ["kind", "id"], "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    return full.where((F.col("state") == OPEN) | F.col("at_limit")).select("kind", "id", "source", "at_limit").distinct()


def article_and_story_ends(articles: DataFrame, stories: DataFrame) -> DataFrame:
    a = ends(articles, "article", "id", "source_domain", "content", "title", True)
    s = ends(stories, "story", "id", "llm_provider", "body", None, False)
    return stash(a.unionByName(s).dropDuplicates(["kind", "id"]))


def shares(found: DataFrame, cases: DataFrame) -> DataFrame:
    """(record_kind, source, texts, truncated, at_limits, share) per source; at_limits: cases at significant lengths."""
    totals = found.groupBy("kind", "source").agg(F.count("*").alias("texts"))
    cut = cases.groupBy(F.col("kind").alias("k"), F.col("source").alias("s")).agg(F.count("*").alias("truncated"), F.count_if("at_limit").alias("at_limits"))
    joined = totals.join(cut, (F.col("kind") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")), "left")
    n, m = F.coalesce("truncated", F.lit(0)), F.coalesce("at_limits", F.lit(0))
    return joined.select(F.col("kind").alias("record_kind"), "source", "texts", n.alias("truncated"), m.alias("at_limits"), F.round(n / F.col("texts"), 6).alias("share"))
