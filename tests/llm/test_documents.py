import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from presswork.llm import encoding, linkspam, mixing
from presswork.llm.queries import QUERIES
from presswork.llm.sql import ORACLES

from ..oracle import connect, values

TOKENIZER = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS)
DOCS = "doc_id bigint, text string, source string, tokens int, slot string"


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.sampled_from(["a", "word", " ", "  ", "\n", "é", "日本語", " 12", "'s", "…", "!", " ", "\t", "x" * 90, "<|endoftext|>", "語" * 300, "the council met "]), max_size=120))
def test_encoding_is_exact(parts):
    text = "".join(parts)
    table = {}
    want = TOKENIZER.encode_ordinary(text)
    if text:
        assert encoding.encode(text, TOKENIZER, table).tolist() == want
        assert encoding.encode(text, TOKENIZER, table).tolist() == want  # from the table
        assert TOKENIZER.decode(want) == text


def test_unbroken_runs_are_exact():
    for text in ("x" * 9000, "語" * 5000, " " * 9000, "ab" * 6000 + " " + "c" * 9000):
        assert encoding.encode(text, TOKENIZER, {}).tolist() == TOKENIZER.encode_ordinary(text)


def test_corpus_ids_edges(spark):
    rows = [(1, None, "a", 1, ""), (2, "", "a", 1, ""), (3, "Hello world", "a", 1, ""), (3, "Hello world", "a", 1, ""), (4, " \n", None, None, None), (5, "<|endoftext|>", "a", 1, ""), (None, "x", "a", 1, "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["ids"] for r in encoding.corpus_ids(df).collect()}
    assert got == {i: TOKENIZER.encode_ordinary(t or "") for i, t, *_ in rows if i is not None}
    assert encoding.corpus_ids(df.limit(0)).count() == 0


def _mix(spark):
    random.seed(1)
    rows = [(i, "word " * random.randint(20, 60), s, None, None) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 4 + ["none"] * 5)]
    rows += [(900, None, "big", None, None), (901, "", "big", None, None), (902, "x", None, None, None), rows[0]]
    targets = [("big", 0.5, 1), ("mid", 0.3, 5), ("tiny", 0.15, 3), ("absent", 0.05, 2), ("zero", 0.0, 1), (None, 0.1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares(spark):
    docs, targets = _mix(spark)
    got = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    total = sum(r["available"] for r in got.values())
    assert set(got) == {"big", "mid", "tiny", "absent"} and got["absent"]["used"] == 0
    assert got["tiny"]["used"] == 3 * got["tiny"]["available"] and got["tiny"]["most_repeats"] == 3
    for s, share in (("big", 0.5), ("mid", 0.3)):
        assert abs(got[s]["used"] - share * total) < 80
    exact = {r["source"]: r["actual_share"] for r in mixing.shares(docs, targets, size="exact").collect()}
    assert abs(exact["big"] - 0.5 / 0.95) < 0.03 and abs(exact["tiny"] - 0.15 / 0.95) < 0.03
    assert mixing.shares(docs.limit(0), targets).where("used > 0").count() == 0
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_mixture_uses(spark):
    docs, targets = _mix(spark)
    m = mixing.mixture(docs, targets, block=100).toPandas()
    assert not m.duplicated(["doc_id", "repeat"]).any() and not m.doc_id.isin([900, 901, 902]).any()
    assert (m.groupby("slot").source.nunique() == 1).all()
    assert m.groupby("source").repeat.max().to_dict() == {"big": 1, "mid": 2, "tiny": 3}


@settings(max_examples=120, deadline=None)
@given(hs.dictionaries(hs.sampled_from("abcdefgh"), hs.one_of(hs.integers(1, 5), hs.integers(1, 400)), min_size=1), hs.integers(1, 60))
def test_segments_keep_the_lag(blocks, segment):
    total, done, slots = sum(blocks.values()), dict.fromkeys(blocks, 0), 0
    for begin, had, after in mixing.borders(blocks, segment):
        assert begin == slots == sum(had.values()) and had == done
        for t, (s, k) in enumerate(mixing.pfair(blocks, begin, had, after), begin + 1):
            done[s] += 1
            assert k == done[s]
            assert all(abs(done[x] - n * t / total) < 1 for x, n in blocks.items())
            slots = t
        assert done == after
    assert done == blocks


def test_segments_do_not_change_the_mixture(spark):
    docs, targets = _mix(spark)
    small, whole = (mixing.mixture(docs, targets, block=50, segment=n).toPandas() for n in (16, 10_000))
    assert sorted(small.slot.unique()) == sorted(whole.slot.unique())
    columns = ["doc_id", "repeat", "source", "block", "tokens"]
    assert small[columns].sort_values(columns).values.tolist() == whole[columns].sort_values(columns).values.tolist()
    assert small.slot.nunique() > 100


@pytest.mark.parametrize("blocks", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 97, "b": 31, "c": 30, "d": 1, "e": 0}, {str(i): 7 for i in range(9)}])
def test_pfair_lag(blocks):
    total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
    for t, (s, k) in enumerate(mixing.pfair(blocks), 1):
        done[s] += 1
        assert k == done[s]
        assert all(abs(done[x] - n * t / total) < 1 for x, n in blocks.items())
    assert done == blocks


PROSE = "The council met on Monday to discuss the plan. Members were told that the vote would be held in a week. Nobody asked for it.\n"
SPAM = {
    "keywords": "cheap grain futures, loan no check, gold coins, cheap grain futures 2025, airline deals Oskeby, loan no check, " * 6,
    "bare": "mortgage broker near me mortgage broker near me Tarnholm mortgage broker near me " * 8,
    "phrases": "Looking for cheap grain? Our cheap grain page has cheap grain and gold coins for Brenn. " * 12,
    "links": "\n".join(f"Some headline number {i} https://x.invalid/some-headline-{i}" for i in range(12)),
    "headlines": "\n".join(f"Mayor {c} under pressure as harbour weighs the plan" for c in "ABCDEFGHIJKLMN"),
    "index": "\n".join(f"Harbour Trust {c} ({i})" for i, c in enumerate("ABCDEFGHIJKLMNOPQ")),
    "tags": "Tags: harbour / steel / grain-port / oskeby / brenn / velmora / grain / steel-works / harbour / morva",
    "hash": "#harbour #steel #grain #port #oskeby #brenn #velmora #works #morva #trust",
    "mostly": PROSE + "cheap grain futures, loan no check, gold coins, airline deals, " * 20,
}
LIVE = [
    "The council met and the vote was close.", "Nobody could say who had paid for the study.", "Rain closed the road to the harbour.", "The mayor left the room when the plan came up.",
    "A second meeting will be held on Friday.", "Traders had priced in a fall; it came in at 4.1 per cent.", "Work on the wall has stopped.", "Supporters point to a scheme that cut costs by a third.",
]
CLEAN = {
    "prose": PROSE * 4,
    "sources": PROSE * 5 + "Sources:\nhttps://a.example/1\nhttps://a.example/2",
    "figures": PROSE * 3 + "\n".join(f"Harbour Trust {c} {i}.50 +{i}.1%" for i, c in enumerate("ABCDEFGH")),
    "live": "\n".join(f"{9 + i // 4:02d}:{15 * (i % 4):02d} {s}" for i, s in enumerate(LIVE)),
    "refrain": (PROSE + "And the river runs down to the sea, to the sea.\n") * 6,
    "tagged": PROSE * 4 + "Tags: harbour / steel / grain / oskeby / brenn",
    "blank": "   \n", "empty": "", "null": None,
}


def test_spam_and_content(spark):
    rows = [(i, t, f"h{i % 4}", None, None) for i, t in enumerate([*SPAM.values(), *CLEAN.values()])]
    df = spark.createDataFrame([*rows, rows[0], (None, "x", None, None, None)], DOCS)
    got = {r["id"] for r in linkspam.spam(df).collect()}
    names = [*SPAM, *CLEAN]
    assert {names[i] for i in got} == set(SPAM)
    assert linkspam.spam(df.limit(0)).count() == 0



def test_stitched_share_decides_below_the_half(spark):
    rng = random.Random(4)
    words = "harbour council ledger river meadow window answer letter winter bridge market garden button orchard lantern copper".split()
    prose = lambda: " ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "." for _ in range(8))
    items = lambda: ", ".join(" ".join(rng.choice(words) for _ in range(3)) for _ in range(11))
    page, own = prose() + "\n" + items(), prose() + "\n" + items()
    for text in (page, own):
        assert 0.25 < sum(linkspam.shape(text)) <= 0.45
    # the same phrases at other hosts start at another word, so that steps of five would not meet
    shifted = page.replace("\n", " and\none two, ").split(" ", 2)[2]
    rows = [(1, page, "h1"), (2, "So " + shifted, "h2"), (3, "Now it " + shifted, "h3"), (4, own, "h1"), (5, own, "h1"), (6, own, "h2")]
    rows += [(7 + i, prose() + " " + prose(), f"h{i}") for i in range(3)]
    df = spark.createDataFrame([(i, t, h, None, None) for i, t, h in rows], DOCS)
    got = {r["id"] for r in linkspam.spam(df).collect()}
    assert 1 in got and not got & {4, 5, 6, 7, 8, 9}

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert values(got) == values(connect(data).sql(ORACLES[name]).df())
    assert not got.astype(str).duplicated().any()


def test_core_does_not_import_this_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "presswork"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "presswork.llm" not in path.read_text()


@pytest.mark.parametrize("text", ["l'été don’t naïve_x a1b ² ½", "žluťoučký kůň", "don’t stop", "Straße—weiß", "слово x", "日本 x", "x\ud800y", ""])
def test_words_of_are_the_matches_of_the_pattern(text):
    assert linkspam.words_of(text) == linkspam._WORD.findall(text)


def test_pairs_are_counted_once_for_both_measures():
    rng = random.Random(5)
    seen = set()
    for _ in range(400):
        words = rng.choices(["of", "the", "blue", "shoes", "red", *(f"w{chr(97 + i)}q" for i in range(rng.randint(1, 26)))], k=rng.randint(20, 60))
        pairs = Counter(zip(words, words[1:]))
        content = 2 * sum(n for x, n in pairs.items() if n >= 3 and linkspam._content(x)) >= len(words) / 3
        top = sum(n for _, n in pairs.most_common(4)) >= 0.18 * len(words)
        assert bool(linkspam._may_be_stuffed([" ".join(words)])) is (content or top)
        seen.add((content, top))
    assert {(False, False), (False, True), (True, True)} <= seen
    assert not linkspam._may_be_stuffed(["blue shoes " * 5])  # fewer than twenty words
