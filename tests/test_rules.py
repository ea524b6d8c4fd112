import pytest

from paralogic.operators import rules

CONDITION = [("c", ":instance", "have-condition-91"), ("c", ":ARG1", "b"), ("b", ":instance", "wet-01"), ("c", ":ARG2", "x"), ("x", ":instance", "and"), ("x", ":op1", "p"), ("p", ":instance", "rain-01"), ("x", ":op2", "q"), ("q", ":instance", "cold-01"), ("q", ":polarity", "-")]
EDGE = [("w", ":instance", "wet-01"), ("w", ":condition", "r"), ("r", ":instance", "rain-01")]
BUY = [("b", ":instance", "buy-01"), ("b", ":ARG0", "x"), ("x", ":instance", "dog"), ("b", ":ARG2", "y"), ("y", ":instance", "cat"), ("b", ":time", "t"), ("t", ":instance", "after"), ("t", ":op1", "e"), ("e", ":instance", "run-02")]
ROLE = [("h", ":instance", "have-rel-role-91"), ("h", ":ARG0", "x"), ("h", ":ARG1", "y"), ("h", ":ARG2", "m"), ("m", ":instance", "mother"), ("x", ":instance", "person"), ("y", ":instance", "person")]
PLAIN = [("m", ":instance", "obligate-01"), ("m", ":ARG2", "g"), ("g", ":instance", "go-02"), ("m", ":freq", "d"), ("d", ":instance", "marry-01"), ("d", ":ARG1", "u"), ("d", ":ARG2", "v"), ("u", ":instance", "boy"), ("v", ":instance", "girl")]
WRAP = [("s", ":instance", "say-01"), ("s", ":polarity", "-"), ("s", ":ARG1", "o"), ("o", ":instance", "or"), ("o", ":op1", "p"), ("o", ":op2", "q"), ("p", ":instance", "lead-01"), ("p", ":ARG0", "q"), ("p", ":ARG1", "k"), ("q", ":instance", "z")]
GRAPHS = {"condition": CONDITION, "edge": EDGE, "buy": BUY, "role": ROLE, "plain": PLAIN, "wrap": WRAP}


@pytest.fixture(scope="module")
def graphs(spark):
    rows = [(k, i, *t) for k, g in GRAPHS.items() for i, t in enumerate(g)]
    return rules.pack(spark.createDataFrame(rows, "graph_id string, pos int, source string, role string, target string"))


def results(graphs, rule):
    return {(r["graph_id"], r["at"], r["label"]): (r["top"], [tuple(t) for t in r["g"]]) for r in rules.transform(graphs, rule).collect()}


def change(graph, gone=(), new=()):
    return sorted([t for t in graph if t not in gone] + list(new))


def check(found, key, top, graph, gone=(), new=()):
    assert found[key][0] == top and sorted(found[key][1]) == change(graph, gone, new), found[key]


def test_pack_and_unpack_round_trip(graphs):
    back = {}
    for r in rules.unpack(graphs).orderBy("graph_id", "pos").collect():
        back.setdefault(r["graph_id"], []).append((r["source"], r["role"], r["target"]))
    assert back == GRAPHS


def test_contraposition_negates_through_connectives(graphs):
    found = results(graphs, "contraposition")
    assert set(found) == {(k, 0, n) for k in ("condition", "edge") for n in (0, 1)}
    check(found, ("condition", 0, 1), "c", CONDITION, [("c", ":ARG1", "b"), ("c", ":ARG2", "x"), ("x", ":instance", "and"), ("q", ":polarity", "-")],
          [("c", ":ARG2", "b"), ("c", ":ARG1", "x"), ("x", ":instance", "or"), ("b", ":polarity", "-"), ("p", ":polarity", "-")])
    check(found, ("condition", 0, 0), "c", CONDITION, (), [("x", ":polarity", "-")])
    check(found, ("edge", 0, 1), "r", EDGE, [("w", ":condition", "r")], [("r", ":condition", "w"), ("w", ":polarity", "-"), ("r", ":polarity", "-")])


def test_implication(graphs):
    found = results(graphs, "implication")
    check(found, ("edge", 0, 1), "or", EDGE, [("w", ":condition", "r")], [("or", ":instance", "or"), ("or", ":op1", "r"), ("or", ":op2", "w"), ("r", ":polarity", "-")])
    check(found, ("condition", 0, 0), "c", CONDITION, [("c", ":instance", "have-condition-91"), ("c", ":ARG1", "b"), ("c", ":ARG2", "x")], [("c", ":instance", "or"), ("c", ":op2", "b"), ("c", ":op1", "x")])
    check(found, ("wrap", 0, 1), "s", WRAP, [("o", ":instance", "or"), ("o", ":op1", "p"), ("o", ":op2", "q")], [("o", ":instance", "have-condition-91"), ("o", ":ARG2", "p"), ("o", ":ARG1", "q"), ("p", ":polarity", "-")])


def test_de_morgan_below_a_negated_node(graphs):
    found = results(graphs, "de_morgan")
    assert set(found) == {("wrap", 0, 0), ("wrap", 0, 1)}
    check(found, ("wrap", 0, 1), "s", WRAP, [("s", ":polarity", "-"), ("o", ":instance", "or")], [("o", ":instance", "and"), ("p", ":polarity", "-"), ("q", ":polarity", "-")])
    check(found, ("wrap", 0, 0), "s", WRAP, [("s", ":polarity", "-"), ("o", ":instance", "or")], [("o", ":instance", "and")])


def test_lexicon_rules(graphs):
    found = results(graphs, "inverse_relation")
    check(found, ("buy", 0, 1), "b", BUY, [("b", ":instance", "buy-01"), ("b", ":ARG0", "x"), ("b", ":ARG2", "y")], [("b", ":instance", "sell-01"), ("b", ":ARG2", "x"), ("b", ":ARG0", "y")])
    check(found, ("role", 0, 1), "h", ROLE, [("m", ":instance", "mother"), ("h", ":ARG0", "x"), ("h", ":ARG1", "y")], [("m", ":instance", "son"), ("h", ":ARG1", "x"), ("h", ":ARG0", "y")])
    check(results(graphs, "symmetric"), ("plain", 0, 1), "m", PLAIN, [("d", ":ARG1", "u"), ("d", ":ARG2", "v")], [("d", ":ARG2", "u"), ("d", ":ARG1", "v")])
    check(results(graphs, "asymmetric"), ("wrap", 0, 1), "s", WRAP, [("p", ":ARG0", "q"), ("p", ":ARG1", "k")], [("p", ":ARG1", "q"), ("p", ":ARG0", "k"), ("p", ":polarity", "-")])
    check(results(graphs, "modal_strength_inversion"), ("plain", 0, 1), "m", PLAIN, [("m", ":instance", "obligate-01")], [("m", ":instance", "possible-01"), ("m", ":polarity", "-"), ("g", ":polarity", "-")])
    found = results(graphs, "predicate_implication")
    check(found, ("buy", 2, 1), "b", BUY, [("e", ":instance", "run-02")], [("e", ":instance", "move-02")])
    assert ("buy", 0, 0) not in found


def test_time_and_aspect(graphs):
    check(results(graphs, "doc_level_temporal_transitivity"), ("buy", 0, 1), "trans_temporal", BUY, [("b", ":time", "t")], [("trans_temporal", ":instance", "precede-01"), ("trans_temporal", ":ARG0", "e"), ("trans_temporal", ":ARG1", "b")])
    check(results(graphs, "tense_transformation"), ("buy", 0, 1), "b", BUY, (), [("_tense_marker", ":instance", "tense-shifted"), ("b", ":mod", "_tense_marker")])
    found = results(graphs, "aspect_equivalence")
    assert len(found) == 2 * len(GRAPHS)
    check(found, ("plain", 0, 0), "m", PLAIN, (), [("_asp_neg_habitual", ":instance", "one-time"), ("m", ":mod", "_asp_neg_habitual")])


def test_double_negation_and_commutative(graphs):
    found = results(graphs, "double_negation")
    check(found, ("condition", 4, 1), "c", CONDITION, [("q", ":polarity", "-")])
    check(found, ("condition", 4, 0), "c", CONDITION)
    check(results(graphs, "commutative"), ("condition", 0, 1), "c", CONDITION, [("x", ":op1", "p"), ("x", ":op2", "q")], [("x", ":op2", "p"), ("x", ":op1", "q")])


def test_compose_and_pick(graphs, spark):
    made = rules.compose(graphs, ["commutative", "contraposition"])
    assert {(r["graph_id"], r["label"]) for r in made.collect()} == {("condition", 0), ("condition", 1)}
    labels = spark.createDataFrame([("buy", 0), ("condition", 1)], "graph_id string, label int")
    picked = {r["graph_id"]: r["label"] for r in rules.pick_by_label(rules.transform(graphs, "predicate_implication").unionByName(rules.transform(graphs, "commutative")), labels).collect()}
    assert picked == {"buy": 1, "condition": 1}


@pytest.mark.parametrize("name", ["triple_f1", "triple_f1_gate", "graph_subscores"])
def test_exploded_triples_are_never_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
