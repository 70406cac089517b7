import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from presswork.llm import neighbours, setpairs

SETS = "id string, entities array<string>, class string, tokens int"


def pairs(df):
    return {tuple(r) for r in df.select("id_a", "id_b").collect()}


def jaccard_pairs(rows, threshold=0.6, least=3):
    clean = {}
    for i, values, *_ in rows:
        s = {" ".join(v.split()).lower() for v in values or [] if v and v.strip()}
        if i is not None and len(s) >= least:
            clean[i] = s
    ids = sorted(clean)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(clean[a] & clean[b]) / len(clean[a] | clean[b]) >= threshold - 1e-12}


def test_edges(spark):
    rows = [
        ("1", ["A", " b  c ", "d", None, ""], "x", 1), ("1", ["A", " b  c ", "d", None, ""], "x", 1), ("2", ["a", "B C", "D", "d"], None, 2), ("3", ["a", "b c", "d", "e"], "x", 3),
        ("4", ["a", "b c"], "x", 4), ("5", None, "x", 5), ("6", [], "x", 6), (None, ["a", "b c", "d"], "x", 7), ("7", ["x" * 5000, "y" * 5000, "z"], "x", 8),
    ]
    df = spark.createDataFrame(rows, SETS)
    assert pairs(setpairs.similar_pairs(df, "id", "entities")) == jaccard_pairs(rows) == {("1", "2"), ("1", "3"), ("2", "3")}
    assert setpairs.similar_pairs(df.limit(0), "id", "entities").count() == 0


def test_hot_tokens_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{i:03d}", [f"h{x}" for x in rng.choice(12, rng.integers(3, 7), replace=False)] + (["all"] if i % 2 else []), "", 0) for i in range(160)]
    df = spark.createDataFrame(rows, SETS)
    assert pairs(setpairs.similar_pairs(df, "id", "entities", hot=10)) == jaccard_pairs(rows)


def test_plain_pigeonhole_recall(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        base = [f"c{c}t{k}" for k in range(10)]
        rows += [(f"{c}-{m}", [t for t in base if rng.random() < 0.9] + [f"x{c}{m}"], "", 0) for m in range(4)]
    df = spark.createDataFrame(rows, SETS)
    truth = jaccard_pairs(rows)
    got = pairs(setpairs.similar_pairs(df, "id", "entities", anchor=False))
    assert got <= truth and len(got) >= 0.8 * len(truth)
    assert pairs(setpairs.similar_pairs(df, "id", "entities")) == truth


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.lists(hs.sampled_from("abcdefgh"), max_size=8), min_size=1, max_size=25))
def test_any_sets(spark, sets):
    rows = [(f"{i:02d}", list(s), "", 0) for i, s in enumerate(sets)]
    assert pairs(setpairs.similar_pairs(spark.createDataFrame(rows, SETS), "id", "entities", hot=4)) == jaccard_pairs(rows)


def test_classes_of_copies(spark):
    rows = [(f"c{i:03d}", ["a", "b", "c", "d"], "", 0) for i in range(300)] + [("n", ["a", "b", "c", "e"], "", 0), ("far", ["x", "y", "z"], "", 0), ("few", ["a"], "", 0)]
    got = {r["id"]: (r["class"], r["links"]) for r in setpairs.linked_classes(spark.createDataFrame(rows, SETS), "id", "entities").collect()}
    assert len({got[f"c{i:03d}"] for i in range(300)}) == 1 and got["c000"][1] == got["n"][1] == 1
    assert got["far"][1] == 0 and "few" not in got


VECTORS = "id string, embedding array<double>, rep string, near string"


def brute(rows, threshold=0.85, top=5, dim=64):
    good = {i: np.array(v, float) for i, v, *_ in rows if i is not None and v is not None and len(v) == dim and all(x is not None for x in v) and np.linalg.norm(v) > 0}
    ids = sorted(good)
    unit = {i: good[i] / np.linalg.norm(good[i]) for i in ids}
    out = set()
    for a in ids:
        ranked = sorted(((-round(float(unit[a] @ unit[b]), 9), b) for b in ids if b != a))
        out |= {(min(a, b), max(a, b)) for c, b in ranked[:top] if -c >= threshold}
    return out


def clustered(n, rng, spread=0.25):
    centres = rng.normal(size=(max(1, n // 8), 64))
    return [(f"v{i:04d}", (centres[i % len(centres)] + spread * rng.normal(size=64)).tolist(), "", "") for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered(400, np.random.default_rng(1))
    got, truth = pairs(neighbours.nearest_pairs(spark.createDataFrame(rows, VECTORS), "id", "embedding")), brute(rows)
    assert len(got & truth) >= 0.98 * len(truth) and len(got & truth) >= 0.98 * len(got)


def test_split_files_find_the_same(spark):
    rows = clustered(240, np.random.default_rng(2))
    df = spark.createDataFrame(rows, VECTORS)
    truth = brute(rows)
    got = pairs(neighbours.nearest_pairs(df, "id", "embedding", pivots=12, max_list=30))
    assert len(got & truth) >= 0.95 * len(truth)


def test_vector_edges(spark):
    rng = np.random.default_rng(5)
    v, w = rng.normal(size=64).tolist(), rng.normal(size=64).tolist()
    rows = [(f"d{i}", v, "", "") for i in range(9)] + [("d0", v, "", ""), ("e", [2 * x for x in v], None, None), ("far", w, "", ""), ("zero", [0.0] * 64, "", ""), ("short", v[:10], "", ""), ("null", None, "", ""), ("hole", [None, *v[1:]], "", ""), (None, v, "", "")]
    df = spark.createDataFrame(rows, VECTORS)
    assert pairs(neighbours.nearest_pairs(df, "id", "embedding")) == brute(rows)
    assert neighbours.nearest_pairs(df.limit(0), "id", "embedding").count() == 0


def test_footrule():
    a = np.array([[0, 1, 2], [2, 1, 0], [7, 8, 9]])
    assert neighbours.footrule(a, a).tolist() == [[0, 4, 12], [4, 0, 12], [12, 12, 0]]
