import itertools
import random

from paralogic.operators import smatch


def exact(pred, gold):
    own, other = sorted({s for s, r, _ in pred if r == ":instance"}), sorted({s for s, r, _ in gold if r == ":instance"})
    best = 0
    for picks in itertools.permutations(other + [None] * len(own), len(own)):
        m = dict(zip(own, picks))
        best = max(best, sum((m.get(s), r, m[t] if t in m and r != ":instance" else t) in set(gold) for s, r, t in set(pred)))
    return best


def graph(rng, n):
    names = [f"v{i}" for i in range(n)]
    rng.shuffle(names)
    out = [(x, ":instance", rng.choice(["a-01", "b", "c-02"])) for x in names]
    return out + [(rng.choice(names), rng.choice([":ARG0", ":ARG1"]), rng.choice(names)) for _ in range(n)] + [(names[0], ":polarity", "-")]


def test_search_against_all_mappings():
    rng = random.Random(3)
    hits = 0
    for _ in range(40):
        a, b = graph(rng, rng.randint(1, 4)), graph(rng, rng.randint(1, 4))
        got, want = smatch.best_match(a, b), exact(a, b)
        assert got <= want and smatch.best_match(a, a) == len(set(a))
        hits += got == want
    assert hits >= 36


def test_variants_and_sums(spark):
    gold = [("a", ":instance", "see-01"), ("a", ":ARG0", "b"), ("b", ":instance", "boy"), ("a", ":ARG1", "c"), ("c", ":instance", "go-02"), ("c", ":ARG0", "b")]
    pred = [("x", ":instance", "see-03"), ("x", ":ARG0", "y"), ("y", ":instance", "boy"), ("x", ":ARG2", "z"), ("z", ":instance", "go-02"), ("z", ":ARG0", "y")]
    kind = "graph_id string, pred array<struct<source:string,role:string,target:string>>, gold array<struct<source:string,role:string,target:string>>"
    rows = spark.createDataFrame([("1", pred, gold), ("2", None, gold[:1]), ("3", [], [])], kind)
    got = {r["variant"]: (r["matched"], r["n_pred"], r["n_gold"]) for r in smatch.pair_scores(rows).filter("graph_id = '1'").collect()}
    assert got == {"smatch": (4, 6, 6), "unlabeled": (5, 6, 6), "no_wsd": (5, 6, 6), "reentrancies": (4, 5, 5), "srl": (4, 6, 6)}
    sums = {r["variant"]: r["recall"] for r in smatch.corpus_scores(rows).collect()}
    assert sums["smatch"] == round(4 / 7, 8)
