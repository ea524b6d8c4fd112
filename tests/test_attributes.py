from paralogic.functions.penman import parse
from paralogic.operators import attributes, rules


def test_attributes(spark):
    text = "(m / possible-01 :ARG1 (g / go-02 :polarity - :ARG0 (b / boy) :mod (e / every)) :ARG2 (k / know-01 :tense (q / present-continuous) :ARG1 (s / stone :quant (y / eat-01 :freq 3))))"
    top, g = parse(text)
    packed = rules.pack(spark.createDataFrame([("g", i, *t) for i, t in enumerate(g)], "graph_id string, pos int, source string, role string, target string"))
    got = {(r["node"], r["role"]): r["value"] for r in attributes.attributes(packed, {"know-01": "state", "possible-01": "state", "go-02": "performance"}).collect()}
    assert got == {
        ("m", ":aspect"): "state", ("m", ":modal-strength"): "partial-affirmative", ("g", ":aspect"): "habitual", ("g", ":modal-strength"): "full-negative",
        ("b", ":animacy"): "animate", ("e", ":animacy"): "inanimate", ("k", ":aspect"): "state", ("s", ":animacy"): "inanimate", ("y", ":aspect"): "habitual",
    }
    plain = {(r["node"], r["role"]) for r in attributes.attributes(packed).collect()}
    assert plain == set(got) - {("m", ":aspect"), ("k", ":aspect")}
    assert len(attributes.annotate(packed).first()["g"]) == len(g) + len(plain)


def test_without_concepts(spark):
    packed = rules.pack(spark.createDataFrame([("g", 0, "a", ":r", "b")], "graph_id string, pos int, source string, role string, target string"))
    assert attributes.attributes(packed).count() == 0 and attributes.annotate(packed).first()["g"][0]["target"] == "b"
