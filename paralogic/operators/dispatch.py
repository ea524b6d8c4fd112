"""From rule labels to rules: dispatch, composition templates, picks among results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attributes, rules

# ---- fixed values: label of a request -> rules tried in this order
DISPATCH = {
    "contraposition": ["contraposition"],
    "commutative": ["commutative"],
    "implication": ["implication"],
    "double_negation": ["double_negation"],
    "de_morgan": ["de_morgan"],
    "transitivity": ["transitivity"],
    "inverse_relation": ["inverse_relation"],
    "symmetric_asymmetric": ["symmetric", "asymmetric"],
    "predicate_implication": ["predicate_implication"],
    "aspect_equivalence": ["aspect_equivalence"],
    "modal_strength_inversion": ["modal_strength_inversion"],
    "doc_level_temporal_transitivity": ["doc_level_temporal_transitivity"],
    "tense_transformation": ["tense_transformation"],
}
# ---- fixed values: rules whose chain keeps the meaning
TEMPLATES = [
    ["contraposition"],
    ["implication"],
    ["commutative"],
    ["contraposition", "commutative"],
    ["implication", "commutative"],
]
# ---- end of fixed values


def first_that_fires(requests: DataFrame) -> DataFrame:
    """(graph_id, label, top, g, rule) of requests (graph_id, top, g, label): the first rule of the label that has a
    match, null if none has. Rules over two graphs (transitivity) have none here."""
    tried = [r for names in DISPATCH.values() for r in names if r in rules.RULES]
    fires = {r: F.size(rules.RULES[r].detect(F.col("g"), F.col("top"))) > 0 for r in dict.fromkeys(tried)}
    pick = None
    for label, names in DISPATCH.items():
        first = F.coalesce(*(F.when(fires[r], F.lit(r)) for r in names if r in fires), F.lit(None).cast("string"))
        pick = F.when(F.col("label") == label, first) if pick is None else pick.when(F.col("label") == label, first)
    return requests.withColumn("rule", pick)


def compositions(graphs: DataFrame) -> DataFrame:
    """(graph_id, template, label, top, g): every template on every graph where all its steps fire."""
    out = None
    for steps in TEMPLATES:
        one = rules.compose(graphs, steps).withColumn("template", F.lit("+".join(steps)))
        out = one if out is None else out.unionByName(one)
    return out.select("graph_id", "template", "label", "top", "g")


def both_variants(results: DataFrame) -> DataFrame:
    """(graph_id, positive, negative): of each graph's matches the first that has both variants."""
    sides = results.groupBy("graph_id", "at").agg(F.max(F.when(F.col("label") == 1, F.struct("top", "g"))).alias("positive"), F.max(F.when(F.col("label") == 0, F.struct("top", "g"))).alias("negative"))
    whole = sides.filter("positive is not null and negative is not null")
    return whole.groupBy("graph_id").agg(F.min_by(F.struct("positive", "negative"), "at").alias("v")).select("graph_id", "v.*")


def added_attributes(graphs: DataFrame) -> DataFrame:
    """(role, n): how many attribute triples the conversion adds, by role."""
    return attributes.attributes(graphs).groupBy("role").agg(F.count("*").alias("n"))
