"""Compiled texts: citations, paragraphs, validation, reuse and model answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CITATION = r"\[\^([^\]]+)\]"


def paragraphs(body: Column) -> Column:
    """Trimmed paragraphs that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def _domains(inner: Column) -> Column:
    return F.filter(F.transform(F.split(inner, ","), lambda d: F.trim(d)), lambda d: d != "")


def tokens(paragraph: Column) -> Column:
    """array<struct<kind, text, domains, single>>: text and citations of a paragraph, in order."""
    marked = F.split(F.regexp_replace(paragraph, CITATION, "\u0001\u0002$1\u0001"), "\u0001")
    parts = F.filter(marked, lambda x: x != "")

    def token(x: Column) -> Column:
        cited = x.startswith("\u0002")
        domains = F.when(cited, _domains(F.substring(x, 2, 100_000)))
        return F.struct(F.when(cited, "cite").otherwise("text").alias("kind"), F.when(~cited, x).alias("text"), domains.alias("domains"), F.when(cited, F.size(domains) == 1).alias("single"))

    return F.transform(parts, token)


def blocks(body: Column) -> Column:
    """array<struct<drop_cap, tokens>> of a body."""
    return F.transform(paragraphs(body), lambda p, i: F.struct((i == 0).alias("drop_cap"), tokens(p).alias("tokens")))


def has_citation(body: Column) -> Column:
    return body.rlike(CITATION)


def cited_domains(claims: Column, source_domains: Column) -> Column:
    """Distinct lower-case domains that a text cites, in order of first mention."""
    from_claims = F.flatten(F.transform(F.coalesce(claims, F.array()), lambda c: F.coalesce(c["attributedDomains"], F.array().cast("array<string>"))))
    return F.array_distinct(F.transform(F.concat(from_claims, F.coalesce(source_domains, F.array().cast("array<string>"))), F.lower))


def failures(body: Column, cited: Column, known: Column, own: Column, strict: bool = False) -> Column:
    """What speaks against a compiled text: no body, domains that are unknown or not among its
    articles; with ``strict`` also paragraphs without a citation."""
    unknown = F.transform(F.array_except(cited, known), lambda d: F.concat(F.lit("unknown domain: "), d))
    foreign = F.transform(F.array_except(F.array_intersect(cited, known), own), lambda d: F.concat(F.lit("domain outside the article set: "), d))
    found = F.concat(unknown, foreign)
    if strict:
        bare = F.filter(F.transform(paragraphs(body), lambda p, i: F.when(~has_citation(p), F.concat(F.lit("no citation in paragraph "), (i + 1).cast("string")))), lambda x: x.isNotNull())
        found = F.concat(found, bare)
    return F.when(F.coalesce(body, F.lit("")) == "", F.array(F.lit("no body"))).otherwise(found)


def needs_refresh(refreshed: Column, now: Column, new: Column, least_new: int = 3, age_hours: float = 6) -> Column:
    """Enough new articles, or some and an old text."""
    age = F.timestamp_diff("MICROSECOND", refreshed, now) / F.lit(3.6e9)
    return (new >= least_new) | ((age >= age_hours) & (new > 0))


def age_seconds(then: Column, now: Column) -> Column:
    return F.floor(F.timestamp_diff("MICROSECOND", then, now) / F.lit(1_000_000)).cast("bigint")


def json_part(answer: Column) -> Column:
    """The JSON object within a model's answer: without thinking blocks, fences and text around it."""
    bare = F.trim(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner).otherwise(bare)


def repair_json(raw: str) -> str:
    """Mend what models get wrong in JSON: raw line ends, quotes and control characters within
    strings, and commas before a closing bracket.

    One walk over the text: a quote closes a string only where the next visible character can
    follow a string, any other quote belongs to it.
    """
    out: list[str] = []
    inside, i = False, 0

    def next_visible(at: int) -> str:
        while at < len(raw) and raw[at].isspace():
            at += 1
        return raw[at : at + 1]

    while i < len(raw):
        c = raw[i]
        following = next_visible(i + 1) if c in '",' else ""
        if inside and c == "\\" and i + 1 < len(raw):
            out.append(raw[i : i + 2])
            i += 2
            continue
        if c == '"':
            if not inside:
                inside = True
                out.append(c)
            elif following in ("", ",", ":", "}", "]"):
                inside = False
                out.append(c)
            else:
                out.append('\\"')
        elif inside and c < " ":
            out.append(json.dumps(c)[1:-1])
        elif not inside and c == "," and following in ("}", "]"):
            pass
        else:
            out.append(c)
        i += 1
    return "".join(out)


def repair_json_udf():
    @F.pandas_udf(T.StringType())
    def repaired(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else repair_json(x))

    return repaired


def parse_answer(answer: Column, schema: str) -> Column:
    """The answer as a struct: as it stands, or else repaired; null where neither parses."""
    inner = json_part(answer)
    whole = lambda c: F.from_json(c, schema)
    good = F.try_parse_json(inner).isNotNull()
    return F.when(good, whole(inner)).otherwise(whole(repair_json_udf()(inner)))
