import random
import re
import time

import pytest

from presswork.llm import mainbody, pages, repeats, residue, truncation

PAGE = "id string, title string, content string, source_domain string, label string, noise int"
PARAGRAPH = "The council met on Monday to discuss the plan. Members of the public were told that the vote would be held in a week, and that nobody had asked for it."
LINES = [
    ("Home | World | Politics | Sport", pages.NOISE),
    ("By Anna Meyer, Evening Post", pages.NOISE),
    ("Updated 2024-01-05 · 3 min read", pages.NOISE),
    ("", pages.NONE),
    (PARAGRAPH, pages.BODY),
    ("What the mayor wants", pages.BODY),
    (PARAGRAPH, pages.BODY),
    ("Sign up for our newsletter and get the news in your inbox.", pages.NOISE),
    ("“We were told on Friday,” said the mayor.", pages.BODY),
    ("* First point of the list", pages.BODY),
    ("* Second point of the list", pages.BODY),
    ("You may also like", pages.NOISE),
    ("1. Council under pressure as harbour weighs the plan", pages.NOISE),
    ("2. Mayor to face hearing in May", pages.NOISE),
    ("© 2024 Evening Post. All rights reserved.", pages.NOISE),
    ("Back to top", pages.NOISE),
]


def test_blocks_of_a_page():
    assert pages.label_lines([x for x, _ in LINES]) == [y for _, y in LINES]


def test_other_languages():
    lines = ["Startseite", "Von Anna Meyer", "Der Rat hat am Montag über den Plan beraten, und die Mitglieder waren sich nicht einig, wer die Kosten trägt.", "Diese Seite nutzt Cookies. Mit dem Weiterlesen stimmen Sie zu.", "Mentions légales | Confidentialité", "Le conseil n'a pas souhaité répondre à nos questions sur le coût du projet de port.", "Todos los derechos reservados."]
    assert pages.label_lines(lines) == [2, 2, 1, 2, 2, 1, 2]


def rows(*texts, title="A title of the page"):
    return [(f"{i:02d}", title, t, "a.test", "x", 1) for i, t in enumerate(texts)]


def test_noise_lines_edges(spark):
    text = "\r\n".join(x for x, _ in LINES)
    data = rows(text, None, "", "   ", "12 34", "word " * 40_000) + [("00", "A title of the page", text, "a.test", "x", 1), (None, None, text, None, None, None)]
    df = spark.createDataFrame(data, PAGE)
    got = {tuple(r) for r in mainbody.noise_lines(df).collect()}
    assert got == {("00", n) for n, (_, y) in enumerate(LINES, 1) if y == pages.NOISE}
    assert mainbody.noise_lines(df.limit(0)).count() == 0
    kept = {r["id"]: r["content"] for r in mainbody.main_body(df.where("id in ('00', '01')")).collect()}
    assert kept["01"] is None and kept["00"].split("\n") == [x for x, y in LINES if y == pages.BODY]


def test_what_a_source_repeats_is_noise(spark):
    prompt = "Zabor felunta in every house of the county and in all the villages around it is what we stand for."
    own = "Nobody in the harbour had been told of the plan, and that was the end of it for the council."
    data = []
    for i in range(5):
        data.append((f"r{i}", f"Title {i}", f"{PARAGRAPH}\n{prompt}\nFelun {chr(97 + i)} of the port. Snap: Zabor House\n{PARAGRAPH} {chr(97 + i)}.", "a.test", "x", 1))
        data.append((f"c{i}", "One title", f"{own}\n{own} Then it was on to the next.", "a.test", "x", 1))  # copies count once
        data.append((f"b{i}", f"Title {i}" if i < 4 else "Title 0", f"{own}\n{prompt}\n{own}", "b.test", "x", 1))  # four titles
    df = spark.createDataFrame([*data, data[0]], PAGE)
    assert {tuple(r) for r in mainbody.noise_lines(df).collect()} == {(f"r{i}", n) for i in range(5) for n in (1, 2, 3)}


def test_stop_words_decide_prose():
    words = "harbour council ledger river meadow window answer letter winter bridge market garden".split()
    assert pages.classify(" ".join(words) + ".")[0] == pages.OPEN
    assert pages.classify("The " + " of the ".join(words) + ".")[0] == pages.BODY


BODY = "\n".join([PARAGRAPH] * 4)


def test_residue(spark):
    data = rows(
        "Please enable JavaScript to continue reading “A title of the page”.",
        "Home | World | Sport\n404 – we looked for “A title of the page” and did not find it.\nBack to top",
        "Fehler 404: Die Seite „X“ wurde nicht gefunden.",
        "Lorem ipsum dolor sit amet consectetur magna aliqua veniam quis nostrud ullamco laboris.",
        BODY + "\nThe mayor {{ article.city }} said no.",
        BODY + "\nLetters began “Dear {{customer_name}}”, an error traced to one clerk.",
        BODY + "\n“Error 404 is not an answer,” said the mayor when the register went dark.",
        BODY + "\nThe portal refused to load unless JavaScript was switched on, the audit found.",
        None, "", "  ",
    )
    df = spark.createDataFrame([*data, data[0]], PAGE)
    assert {r["id"] for r in residue.residue_ids(residue.judged_pages(df)).collect()} == {"00", "01", "02", "03", "04"}
    assert residue.residue_ids(residue.judged_pages(df.limit(0))).count() == 0


def test_labels_spread_to_near_duplicates(spark):
    known = "Access denied on this server for the address that you asked for at this time of the day because it is closed to all of our visitors from there until the end of the week"
    near = known.replace("Access denied on", "Entry stopped at").replace("the end of the week", "the start of the week")
    other = "The council has set out how it wants to pay for the harbour wall over the next ten years and who will run it after that time"
    df = spark.createDataFrame(rows(known + " again " + known, near + " again " + known, other), PAGE)
    got = {r["id"] for r in residue.residue_ids(residue.judged_pages(df)).collect()}
    assert "00" in got and "02" not in got



def test_spreading_reaches_the_stated_agreement(spark):
    rng = random.Random(5)
    words = "harbour council ledger river meadow window answer letter winter bridge market garden button orchard lantern copper".split()
    known, near, far = [], [], []
    for _ in range(12):
        common = " ".join(rng.choice(words) for _ in range(54))
        known.append("access denied " + common)
        near.append("entry stopped " + " ".join(common.split()[:-2]) + " old boat")
        far.append("entry stopped " + " ".join(rng.sample(common.split(), 54)))
    memo = {}
    for a, b in zip(known, near):
        s, t = (set(residue.shingles(residue.masked(x, None), memo).tolist()) for x in (a, b))
        assert 0.8 <= len(s & t) / len(s | t) < 0.9
    df = spark.createDataFrame(rows(*known, *near, *far, title=None), PAGE)
    got = {r["id"] for r in residue.residue_ids(residue.judged_pages(df)).collect()}
    assert got == {f"{i:02d}" for i in range(24)}


def test_repeated_lines(spark):
    prompt, long_line = "Share this with your friends!", "legal words and more of them, " * 60
    data = []
    for i in range(6):
        data.append((f"a{i}", None, f"unique text number {chr(97 + i)}\n{prompt.upper() if i % 2 else prompt}\n{long_line}\n123", "a.test", "x", 1))
    data += [("b0", None, f"{prompt}\n{prompt}", "b.test", "x", 1), ("b1", None, prompt, "b.test", "x", 1), ("n", None, None, "a.test", "x", 1), data[0]]
    data += [(f"z{i}", None, prompt, None, "x", 1) for i in range(5)]
    df = spark.createDataFrame(data, PAGE)
    got = {tuple(r) for r in repeats.repeated_lines(df, "id", "source_domain", "content").collect()}
    assert got == {(f"a{i}", n) for i in range(6) for n in (2, 3)} | {(f"z{i}", 1) for i in range(5)}
    assert repeats.repeated_lines(df.limit(0), "id", "source_domain", "content").count() == 0
    kept = {r["id"]: r["content"] for r in repeats.without_repeated(df, "id", "source_domain", "content").collect()}
    assert kept["a1"] == "unique text number b\n123" and kept["b0"] == f"{prompt}\n{prompt}" and kept["n"] is None


def test_chunks_follow_content():
    tail = bytes(random.Random(3).choices(range(97, 123), k=6000))
    def chunks(data):
        ends = repeats.boundaries(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    a, b = chunks(b"x" * 37 + tail), chunks(tail)
    assert b"".join(a) == b"x" * 37 + tail and max(map(len, a)) <= repeats.MAX_CHUNK
    assert len(set(a) & set(b)) >= 0.6 * len(b)


def test_ends():
    end = lambda t, page=True: truncation.end_of(t, page)[0]
    assert end(BODY) == truncation.CLOSED
    assert end(BODY + "\nMembers of the public were told that the vote would be held in a") == truncation.OPEN
    for mark in (" [...]", "\n[+2108]", "… [read on]", " ... Read the full story »", " <a hr", " &quo", "... (more)"):
        assert end(BODY + "\nMembers of the public were told that the vote would" + mark) == truncation.OPEN, mark
    assert end(BODY + " (ends)") == truncation.CLOSED
    assert end(BODY + "\n* A point of the list") == truncation.DOUBTFUL
    assert end("Text that is cited.[^a.test]", False) == truncation.CLOSED
    assert end("Text that is cited.[^a.te", False) == truncation.OPEN
    assert end("Text.[^a.test] The council has set out how it wants to pay", False) == truncation.OPEN


def test_truncation_by_limits(spark):
    random.seed(2)
    words = "council mayor harbour plan vote public member budget street winter river office letter answer".split()
    def prose(n):
        text = ""
        while len(text) < n:
            text += " ".join(random.choice(words) for _ in range(9)).capitalize() + ". "
        return text

    articles = [(f"w{i}", None, prose(random.randint(300, 1500)).strip(), "a.test", "x", 1) for i in range(150)]
    articles += [(f"c{i}", None, prose(900)[:600], "a.test", "x", 1) for i in range(25)]
    closers = [(f"s{i}", None, prose(random.randint(300, 900)) + "And so it goes on...", "b.test", "x", 1) for i in range(6)]
    df = spark.createDataFrame(articles + closers + [articles[0], ("n", None, None, None, None, None), ("e", "", " ", "", "", 0)], PAGE)
    stories = spark.createDataFrame([("s", "p", "Text.[^a.te"), ("t", "p", "Text.[^a.test]"), ("u", None, None)], "id string, llm_provider string, body string")
    found = truncation.article_and_story_ends(df, stories)
    got = {(r["kind"], r["id"]) for r in truncation.truncated(found).collect()}
    cut = {("article", f"c{i}") for i in range(25) if not articles[150 + i][2].rstrip().endswith(".")}
    assert got == cut | {("story", "s")}
    assert [(r["length"], r["source"]) for r in truncation.limits(found).collect()][:1] in ([(600, "a.test")], [(599, "a.test")])
    shares = {(r["record_kind"], r["source"]): r["truncated"] for r in truncation.shares(found, truncation.truncated(found)).collect()}
    assert shares["article", "b.test"] == 0 and shares["article", "a.test"] == len(cut)
    empty = truncation.article_and_story_ends(df.limit(0), stories.limit(0))
    assert truncation.truncated(empty).count() == 0


def test_copies_of_a_cut_text_are_no_manner_of_closing(spark):
    cut = BODY + "\nMembers of the public were told that the vote would be..."
    data = [(f"c{i}", None, cut, f"{'abc'[i % 3]}.test", "x", 1) for i in range(9)]
    data += [(f"m{i}", None, f"{BODY} Item {i}.\nAnd so it goes on...", "d.test", "x", 1) for i in range(9)]
    stories = spark.createDataFrame([], "id string, llm_provider string, body string")
    found = truncation.article_and_story_ends(spark.createDataFrame(data, PAGE), stories)
    cases = truncation.truncated(found)
    assert {r["id"] for r in cases.collect()} == {f"c{i}" for i in range(9)}
    assert {r["source"]: r["truncated"] for r in truncation.shares(found, cases).collect()} == {"a.test": 3, "b.test": 3, "c.test": 3, "d.test": 0}


@pytest.mark.parametrize("line", ["x" * 155, "by " + "x" * 150 + " 7", "x" * 130 + " 7 reporter"])
def test_long_words_cost_no_backtracking(line):
    began = time.process_time()
    pages.look(line)
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize(
    "line, said",
    [("jane de la cruz, staff writer", True), ("a b c d e f, reporter", False), ("jane cruz | reporter", True), ("jane cruz reports", True), ("von jane cruz-meier, berlin", True), ("by one two three four five six", False)]
    + [("5 min read", True), ("quay at dawn (photo: j. cruz)", True), ("quay at dawn. foto: cruz", True), ("cruz / city archives", True), ("the reporter, who left", False)],
)
def test_lines_by_which_a_page_talks_about_itself(line, said):
    assert pages.site_line(line) is said


@pytest.mark.parametrize("text, there", [("a {{ name }} b", True), ("x___TITLE__ x", False), ("___TITLE__ x", True), ("x __TITLE__", True), ("TKTK and TK x TK", True), ("5 % of [1] [^2]", False), ("w[NAME]", False), ("[NAME]", True), ("$${price}", True), ("%%date%%", True), ("TOTAL @ T", False)])
def test_places_are_tried_where_they_can_begin(text, there):
    assert bool(residue._UNFILLED.search(text)) is there
    assert residue._holds_place(text) is there


def test_codes_are_masked_as_by_the_plain_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("af19 g_-é٣²") for _ in range(rng.randint(0, 40)))
        assert residue._CODE.sub("#", text) == re.sub(r"\b[a-f]{0,16}\d\w*", "#", text)
