import pytest
from pyspark.sql import functions as F

from presswork.functions import entities as en
from presswork.functions import stories as st
from presswork.functions import text as tx
from presswork.functions import urls
from presswork.functions import vectors as vc


def column(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, v {kind}")
    return [r[0] for r in rows.orderBy("n").select(f(F.col("v"))).collect()]


def test_urls(spark):
    cases = {
        "https://www.Example.com/a/b/?utm_source=x&id=7#top": "https://example.com/a/b?id=7",
        "http://example.com": "http://example.com/",
        " https://example.com/a// ": "https://example.com/a",
        "https://example.com/?ref=1": "https://example.com/",
        "not a url": None,
        None: None,
    }
    assert column(spark, urls.canonical_url, list(cases)) == list(cases.values())


def test_links_hash_ignores_order_and_copies(spark):
    sets = [["https://a.com/x", "https://b.com/"], ["https://b.com", "https://www.a.com/x/?fbclid=1", "https://a.com/x"], ["https://a.com/y"]]
    a, b, c = column(spark, urls.links_hash, sets, "array<string>")
    assert a == b != c and len(a) == 64


def test_host_suffixes(spark):
    assert column(spark, lambda c: urls.host_suffixes(urls.host_of(c)), ["https://WWW.news.example.co/x"]) == [["news.example.co", "example.co", "co"]]


def test_tickers(spark):
    texts = ["Up: $QRS and (XYZ:NY) but not $CEO, (FBI) or $TOOLONG or $AB1", None]
    assert column(spark, en.tickers, texts) == [["QRS", "XYZ"], None]


def test_names(spark):
    texts = ["The White House and Bank of America met Harbour Steel on Monday Morning Show", "éApple Pie", "Alpha Beta\n\nGamma went"]
    got = column(spark, en.proper_nouns, texts)
    assert got == [["bank of america", "harbour steel", "morning show"], ["apple pie"], ["alpha beta gamma"]]


@pytest.mark.parametrize("a, b, merge", [(["$A", "x y"], ["$A"], True), (["x y"], ["x y"], False), (["x y", "z w"], ["z w", "x y"], True), ([], ["$A"], False)])
def test_overlap(spark, a, b, merge):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(en.overlap(en.from_stored(F.col("a")), en.from_stored(F.col("b")))["merge"]).first()[0] is merge


def test_sub_topics(spark):
    queries = ["rates and trade, vs. tariffs", "a & b", "water", "Compare oil WITH gas"]
    assert column(spark, tx.sub_topics, queries) == [["rates", "trade", ". tariffs"], ["a & b"], ["water"], ["oil", "gas"]]


def test_names_joined(spark):
    assert column(spark, tx.join_names, [[], ["a"], ["a", "b"], ["a", "b", "c"]], "array<string>") == ["", "a", "a and b", "a, b, and c"]


def test_roman(spark):
    assert column(spark, tx.roman, [0, -2, 1, 4, 9, 14, 40, 90, 400, 1994, 2026], "int") == ["0", "-2", "I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMXXVI"]


def test_slug(spark):
    assert column(spark, tx.slug, ["Água & Gás: 3 Días!", "--x--", ""]) == ["agua-gas-3-dias", "x", ""]


def test_settings(spark):
    assert column(spark, lambda c: tx.number_setting(c, 10, 1, 50), ["7 days", "x", None, "-3", "900"]) == [7.0, 10.0, 10.0, 1.0, 50.0]
    assert column(spark, lambda c: tx.number_setting(c, 0.74, 0.55, whole=False), ["0.9x", "0.1", ""]) == [0.9, 0.55, 0.74]


def test_ascii_fold(spark):
    assert column(spark, lambda c: tx.contains_text(c, "É"), ["é", "É", "xÉy"]) == [False, True, True]
    assert column(spark, lambda c: tx.contains_text(c, "100%"), ["is 100% sure", "100 x"]) == [True, False]


def test_space_beyond_java(spark):
    assert column(spark, tx.collapse, [" a  b﻿"]) == ["a b"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vc.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_tokens(spark):
    body = "First.[^a.test,b.test] Then.\n\nSecond[^c.test]"
    got = column(spark, st.blocks, [body, None, ""])
    first = got[0]
    assert [b["drop_cap"] for b in first] == [True, False]
    assert [(t["kind"], t["text"], t["domains"], t["single"]) for t in first[0]["tokens"]] == [("text", "First.", None, None), ("cite", None, ["a.test", "b.test"], False), ("text", " Then.", None, None)]
    assert first[1]["tokens"][1]["single"] is True and got[1:] == [[], []]


def test_model_answers(spark):
    answers = ['<think>x</think>```json\n{"headline": "a"}\n```', 'Sure: {"headline": "line\nbreak",} ok', "no json"]
    got = column(spark, lambda c: st.parse_answer(c, "headline string")["headline"], answers)
    assert got == ["a", "line\nbreak", None]


def test_wayback(spark):
    assert column(spark, tx.wayback_iso, ["20240503", "20240503102030"]) == ["2024-05-03T00:00:00Z", "2024-05-03T10:20:30Z"]
    assert column(spark, tx.wayback_stamp, ["2024-05-03", "2024-05-03T10:20:30.123Z"]) == ["20240503", "20240503102030"]
