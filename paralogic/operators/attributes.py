"""Attributes inferred for the nodes of packed graphs: aspect, modal strength, animacy.

Defined results: a node without a concept gets none; the first concept of a node
counts; nothing is inferred where no rule fires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import concept, edge, lookup, negative

# Modal frame -> strength
STRENGTHS = {
    "obligate-01": "full-affirmative", "require-01": "full-affirmative", "need-01": "full-affirmative", "must-01": "full-affirmative",
    "mandate-01": "full-affirmative", "mandatory-01": "full-affirmative", "have-to-01": "full-affirmative",
    "possible-01": "partial-affirmative", "permit-01": "partial-affirmative", "allow-01": "partial-affirmative", "recommend-01": "partial-affirmative",
    "suggest-01": "partial-affirmative", "may-01": "partial-affirmative", "can-01": "partial-affirmative", "might-01": "partial-affirmative", "could-01": "partial-affirmative",
    "prohibit-01": "full-negative", "forbid-01": "full-negative", "ban-01": "full-negative",
}

# Concepts of animate beings
ANIMATE = (
    "person", "man", "woman", "boy", "girl", "child", "baby", "adult", "dog", "cat", "horse", "animal", "bird", "fish", "tiger", "lion",
    "human", "patient", "doctor", "teacher", "student",
)

# A predicate's form, modifiers of habit, roles below the top that assert
FRAME = r"^[a-z][a-z0-9-]*-\d{2,3}$"
HABITS = ("every", "all", "habitual")
ASSERTING = (":op1", ":op2", ":op3", ":op4", ":ARG1")


def _aspect(g: Column, node: Column, word: Column, lexicon: dict[str, str] | None) -> Column:
    own = lambda test: F.exists(g, lambda t: (t["source"] == node) & test(t))
    habit = own(lambda t: t["role"].isin(":freq", ":frequency") | ((t["role"] == ":mod") & F.coalesce(concept(g, t["target"]).isin(*HABITS), F.lit(False))))
    going = own(lambda t: t["role"].isin(":tense", ":aspect") & t["target"].rlike("continuous|progressive"))
    out = F.when(habit, "habitual").when(going, "activity")
    return out.otherwise(lookup(lexicon, word)) if lexicon else out


def attributes(graphs: DataFrame, aspects: dict[str, str] | None = None) -> DataFrame:
    """(graph_id, node, role, value): the attributes inferred, one row each.

    ``aspects`` (concept -> state, inceptive, process, performance or activity) is a parameter: it travels
    in the plan, so it has to be a small table. Modal strength is for the top and what it asserts."""
    g, top, n = F.col("g"), F.col("top"), F.col("node")
    firsts = F.array_distinct(F.transform(F.filter("g", lambda t: t["role"] == ":instance"), lambda t: t["source"]))
    nodes = graphs.select("graph_id", "top", "g", F.explode(firsts).alias("node")).withColumn("word", concept(g, n))
    root = (n == top) | F.exists(g, lambda t: (t["target"] == n) & (t["source"] == top) & t["role"].isin(*ASSERTING))
    modal = F.coalesce(lookup(STRENGTHS, F.col("word")), F.when(F.col("word").rlike(FRAME), F.when(negative(g, n), "full-negative").otherwise("full-affirmative")))
    animacy = F.when(F.col("word").isin(*ANIMATE), "animate").when(~F.col("word").contains("-"), "inanimate")
    found = F.array(*(F.struct(F.lit(r).alias("role"), v.alias("value")) for r, v in ((":aspect", _aspect(g, n, F.col("word"), aspects)), (":modal-strength", F.when(root, modal)), (":animacy", animacy))))
    return nodes.select("graph_id", "node", F.explode(found).alias("a")).select("graph_id", "node", "a.role", "a.value").filter("value is not null")


def annotate(graphs: DataFrame, aspects: dict[str, str] | None = None) -> DataFrame:
    """``graphs`` with the attributes as further triples; each graph's are gathered before they meet it."""
    extra = attributes(graphs, aspects).groupBy("graph_id").agg(F.array_sort(F.collect_list(edge(F.col("node"), F.col("role"), F.col("value")))).alias("_extra"))
    joined = graphs.join(extra, "graph_id", "left")
    return joined.withColumn("g", F.when(F.col("_extra").isNull(), F.col("g")).otherwise(F.concat("g", "_extra"))).drop("_extra")
