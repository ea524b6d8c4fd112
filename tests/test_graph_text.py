import pytest
from pyspark.sql import functions as F

from paralogic.functions import penman
from paralogic.operators import graphs as triples_ops
from paralogic.operators import rules
from paralogic.operators.lineage import cut


def test_parse_turns_inverse_roles_and_keeps_constants():
    top, g = penman.parse('# ::snt x\n(b / buy-01~e.1 :ARG0 (x / dog :name (n / name :op1 "A (b) ~ c")) :polarity - :ARG1-of (w / want-01 :ARG0 x) :consist-of x)')
    assert top == "b"
    assert g == [("b", ":instance", "buy-01"), ("b", ":ARG0", "x"), ("x", ":instance", "dog"), ("x", ":name", "n"), ("n", ":instance", "name"), ("n", ":op1", '"A (b) ~ c"'), ("b", ":polarity", "-"),
                 ("w", ":ARG1", "b"), ("w", ":instance", "want-01"), ("w", ":ARG0", "x"), ("b", ":consist-of", "x")]


@pytest.mark.parametrize("text", [None, "", "(", "(a / b", "(a / b))", "a b", "(a / b :r)", "(a / b (c / d))", "() x"])
def test_broken_texts_are_null(text):
    assert penman.parse(text) is None


def test_variable_before_its_definition():
    assert penman.parse("(a / x :ARG0 b :ARG1 (b / y))")[1] == [("a", ":instance", "x"), ("a", ":ARG0", "b"), ("a", ":ARG1", "b"), ("b", ":instance", "y")]


def test_write_round_trips_and_reroots():
    g = [("w", ":instance", "wet-01"), ("w", ":condition", "r"), ("r", ":instance", "rain-01"), ("r", ":ARG1", "k"), ("k", ":instance", "sky"), ("k", ":loop", "w"), ("z", ":instance", "z"), ("z", ":ARG2", "k")]
    for top in "wrkz":
        text = penman.write(top, g)
        back = penman.parse(text)
        assert back[0] == top and sorted(back[1]) == sorted(g), text
    assert penman.write("w", g + [("q", ":instance", "lost")]) is None
    assert penman.write("q", g) is None


def test_columns(spark):
    df = spark.createDataFrame([(1, "(a / b :ARG0-of (c / d))"), (2, None), (3, "(")], "id int, text string")
    got = {r["id"]: r["back"] for r in df.withColumn("p", penman.decode("text")).withColumn("back", penman.encode("p.top", "p.g")).collect()}
    assert got == {1: "(a / b :ARG0-of (c / d))", 2: None, 3: None}


def test_links_to_encyclopedia(spark):
    df = spark.createDataFrame([("g", 0, "a", ":instance", "x"), ("g", 1, "a", ":wiki", '"Q1"')], "graph_id string, pos int, source string, role string, target string")
    assert triples_ops.without_roles(df, ":wiki").count() == 1
    assert {r["target"] for r in triples_ops.mask_links(df).collect()} == {"x", "+"}


def test_chains_of_two_graphs(spark):
    texts = {"a": "(w / wet-01 :condition (r / rain-01))", "b": "(h / have-condition-91 :ARG1 (s / slip-01) :ARG2 (w / wet-02))", "c": "(s / sing-01 :condition (h / happy-01 :ARG1 (x / boy) :mod (y / very)))", "d": "(p / plain)"}
    df = cut(spark.createDataFrame(list(texts.items()), "graph_id string, text string").select("graph_id", penman.decode("text").alias("p")).select("graph_id", "p.top", "p.g"))
    # the words of a side include all it reaches, so the antecedent of "a" counts to its consequent
    found = rules.chains(df, 0.5).collect()
    assert {(r["first"], r["second"], r["similarity"]) for r in found} == {("a", "b", 0.5)}
    made = rules.conclude(df, rules.chains(df, 0.5)).select(penman.encode("top", "g").alias("t")).collect()
    assert [r["t"] for r in made] == ["(g2_s / slip-01 :condition (r / rain-01))"]


def brute_chains(facts, t):
    out = set()
    for a in facts:
        for b in facts:
            x, y = set(a["cons_words"]), set(b["ante_words"])
            if a["graph_id"] != b["graph_id"] and x and y and len(x & y) / len(x | y) >= t:
                out.add((a["graph_id"], b["graph_id"]))
    return out


def test_chains_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    side = lambda v: f"({v} / {rng.choice('pqrs')}-01 " + " ".join(f":op{i} ({v}{i} / {rng.choice('abcdef')})" for i in range(1, rng.randint(2, 4))) + ")"
    texts = [(str(i), f"(h / have-condition-91 :ARG1 {side('x')} :ARG2 {side('y')})") for i in range(40)]
    df = spark.createDataFrame(texts, "graph_id string, text string").select("graph_id", penman.decode("text").alias("p")).select("graph_id", "p.top", "p.g").persist()
    facts = rules.implications(df).collect()
    for t in (0.5, 0.8):
        want = brute_chains(facts, t)
        assert want and {(r["first"], r["second"]) for r in rules.chains(df, t).collect()} == want
