"""Semantic graphs as a triples table (graph_id, pos, source, role, target): detection,
rewriting and comparison of graphs as joins and aggregates.

A concept is a triple of role ``:instance``. Rewrites never touch other graphs' rows,
so all joins carry graph_id and are dealt by it, never broadcast (``lineage.dealt``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, dealt

CONDITION, CONNECTIVES = "have-condition-91", ("and", "or")


def concepts(triples: DataFrame) -> DataFrame:
    """(graph_id, node, concept)."""
    return triples.filter("role = ':instance'").select("graph_id", F.col("source").alias("node"), F.col("target").alias("concept"))


def negated(triples: DataFrame) -> DataFrame:
    """(graph_id, node): nodes with a negative polarity."""
    return triples.filter("role = ':polarity' and target = '-'").select("graph_id", F.col("source").alias("node")).distinct()


def polarity_gate(expected: DataFrame, got: DataFrame) -> DataFrame:
    """(graph_id, expected, got, reason): reason is null if the graph passes.

    Parity first, then a lost negation, then a difference of two or more."""
    count = lambda df, name: df.groupBy("graph_id").agg(F.count_if((F.col("role") == ":polarity") & (F.col("target") == "-")).alias(name))
    both = count(expected, "expected").join(dealt(count(got, "got")), "graph_id")
    e, g = F.col("expected"), F.col("got")
    return both.withColumn("reason", F.when(e % 2 != g % 2, "parity").when((e > 0) & (g == 0), "lost").when(F.abs(e - g) >= 2, "difference"))


def canonical(triples: DataFrame) -> DataFrame:
    """(graph_id, triple): triples with concepts in place of variables, as a set."""
    c = concepts(triples)
    left = c.withColumnsRenamed({"node": "source", "concept": "cs"})
    right = c.withColumnsRenamed({"node": "target", "concept": "ct"})
    named = triples.filter("role <> ':instance'").join(dealt(left), ["graph_id", "source"], "left").join(dealt(right), ["graph_id", "target"], "left")
    own = c.select("graph_id", F.concat_ws(" ", F.lit(":instance"), "concept").alias("triple"))
    return named.select("graph_id", F.concat_ws(" ", F.coalesce("cs", "source"), "role", F.coalesce("ct", "target")).alias("triple")).unionByName(own).distinct()


def triple_f1(a: DataFrame, b: DataFrame) -> DataFrame:
    """(graph_id, f1) of the canonical triple sets of equal ids."""
    both = canonical(a).withColumn("a", F.lit(1)).join(dealt(canonical(b).withColumn("b", F.lit(1))), ["graph_id", "triple"], "full")
    sums = both.groupBy("graph_id").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("hit"))
    return sums.select("graph_id", F.round(2.0 * F.col("hit") / (F.col("na") + F.col("nb")), 8).alias("f1"))


def _pair(triples: DataFrame, nodes: DataFrame, first: str, second: str) -> DataFrame:
    """``nodes`` that have exactly one edge of each of two roles: (graph_id, node, a, b)."""
    edges = triples.filter(F.col("role").isin(first, second)).groupBy("graph_id", F.col("source").alias("node")).agg(
        F.count_if(F.col("role") == first).alias("na"), F.count_if(F.col("role") == second).alias("nb"), F.max(F.when(F.col("role") == first, F.col("target"))).alias("a"), F.max(F.when(F.col("role") == second, F.col("target"))).alias("b")
    )
    return nodes.join(dealt(edges.filter("na = 1 and nb = 1")), ["graph_id", "node"]).select("graph_id", "node", "a", "b")


def detect(triples: DataFrame) -> DataFrame:
    """(graph_id, rule, node): where the relational rules apply."""
    c = concepts(triples)
    linked = c.filter(F.col("concept").isin(*CONNECTIVES))
    both = _pair(triples, linked, ":op1", ":op2")
    condition = _pair(triples, c.filter(F.col("concept") == CONDITION), ":ARG1", ":ARG2")
    edges = triples.filter("role = ':condition'").select("graph_id", F.col("source").alias("node")).distinct()
    found = {
        "contraposition": condition.select("graph_id", "node").unionByName(edges),
        "implication": condition.select("graph_id", "node").unionByName(_pair(triples, c.filter("concept = 'or'"), ":op1", ":op2").select("graph_id", "node")).unionByName(edges),
        "commutative": both.select("graph_id", "node"),
        "de_morgan": both.join(dealt(negated(triples)), ["graph_id", "node"], "left_semi").select("graph_id", "node"),
        "double_negation": c.select("graph_id", "node"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.select("graph_id", F.lit(rule).alias("rule"), "node")
        out = one if out is None else out.unionByName(one)
    return out


def toggle(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Take the negative polarity from ``nodes`` (graph_id, node) that have it, give it to the others."""
    had = negated(triples)
    gone = nodes.join(dealt(had), ["graph_id", "node"], "left_semi").select("graph_id", F.col("node").alias("source"), F.lit(":polarity").alias("role"))
    kept = triples.join(dealt(gone), ["graph_id", "source", "role"], "left_anti")
    new = nodes.join(dealt(had), ["graph_id", "node"], "left_anti").distinct().select("graph_id", F.lit(1_000_000).alias("pos"), F.col("node").alias("source"), F.lit(":polarity").alias("role"), F.lit("-").alias("target"))
    return kept.select(*triples.columns).unionByName(new.select(*triples.columns))


def swap_roles(triples: DataFrame, nodes: DataFrame, first: str, second: str) -> DataFrame:
    """Exchange two roles of ``nodes``."""
    marked = triples.join(dealt(nodes.select("graph_id", F.col("node").alias("source")).distinct().withColumn("_hit", F.lit(True))), ["graph_id", "source"], "left")
    role = F.when(F.col("_hit") & (F.col("role") == first), second).when(F.col("_hit") & (F.col("role") == second), first).otherwise(F.col("role"))
    return marked.withColumn("role", role).select(*triples.columns)


def commutative(triples: DataFrame, positive: bool = True) -> DataFrame:
    """Swap op1 and op2; the negative toggles the second operand instead."""
    both = _pair(triples, concepts(triples).filter(F.col("concept").isin(*CONNECTIVES)), ":op1", ":op2")
    return swap_roles(triples, both, ":op1", ":op2") if positive else toggle(triples, both.select("graph_id", F.col("b").alias("node")))


def contraposition(triples: DataFrame, positive: bool = True) -> DataFrame:
    """Of condition frames: swap ARG1 and ARG2 and negate both; the negative toggles the condition only."""
    frame = _pair(triples, concepts(triples).filter(F.col("concept") == CONDITION), ":ARG1", ":ARG2")
    sides = frame.select("graph_id", F.col("a").alias("node")).unionByName(frame.select("graph_id", F.col("b").alias("node")))
    if not positive:
        return toggle(triples, frame.select("graph_id", F.col("b").alias("node")))
    return toggle(swap_roles(triples, frame, ":ARG1", ":ARG2"), sides)


def de_morgan(triples: DataFrame, positive: bool = True) -> DataFrame:
    """Of negated connectives: drop the negation, exchange and / or, toggle both operands (positive only)."""
    both = _pair(triples, concepts(triples).filter(F.col("concept").isin(*CONNECTIVES)), ":op1", ":op2").join(dealt(negated(triples)), ["graph_id", "node"], "left_semi")
    marked = triples.join(dealt(both.select("graph_id", F.col("node").alias("source")).withColumn("_hit", F.lit(True))), ["graph_id", "source"], "left")
    flipped = F.when(F.col("_hit") & (F.col("role") == ":instance"), F.when(F.col("target") == "and", "or").otherwise("and")).otherwise(F.col("target"))
    changed = marked.withColumn("target", flipped).filter(~(F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("role") == ":polarity"))).select(*triples.columns)
    sides = both.select("graph_id", F.col("a").alias("node")).unionByName(both.select("graph_id", F.col("b").alias("node")))
    return toggle(changed, sides) if positive else changed


def without_roles(triples: DataFrame, *roles: str) -> DataFrame:
    """Triples of other roles; ``:wiki`` alone removes the links to an encyclopedia."""
    return triples.filter(~F.col("role").isin(*roles))


def mask_links(triples: DataFrame) -> DataFrame:
    """Every ``:wiki`` target becomes ``+``."""
    return triples.withColumn("target", F.when(F.col("role") == ":wiki", "+").otherwise(F.col("target")))


def literal_closure(implications: DataFrame, chain: bool = True) -> DataFrame:
    """(a, b): closure of implications under contraposition and, with ``chain``, transitivity, until nothing is new;
    a literal's negation is '-' before it.

    Each round joins the newest implications with all; the lineage is cut by a checkpoint."""
    minus = lambda c: F.when(F.startswith(c, F.lit("-")), F.substring(c, 2, 1_000_000)).otherwise(F.concat(F.lit("-"), c))
    known = implications.select("a", "b").unionByName(implications.select(minus(F.col("b")).alias("a"), minus(F.col("a")).alias("b"))).distinct()
    if not chain:
        return known
    known = cut(known)
    fresh = known
    while True:
        left = fresh.alias("l").join(known.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b"))
        right = known.alias("l").join(fresh.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b"))
        fresh = cut(left.unionByName(right).filter("a <> b").distinct().join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def node_features(graphs: DataFrame) -> DataFrame:
    """(graph_id, node, stem, numbered, negated, depth, n_args, parent_role) of packed graphs, for each node with a concept.

    Depth is the least number of edges from the top, found by as many steps as the graph has
    edges at most; a node out of reach has -1. The parent's role is that of the first edge to the node."""
    g = F.col("g")
    ahead = lambda seen: F.transform(F.filter(g, lambda t: F.array_contains(seen, t["source"]) & (t["role"] != ":instance")), lambda t: t["target"])
    grow = lambda rings, _: F.concat(rings, F.array(F.array_union(F.element_at(rings, -1), ahead(F.element_at(rings, -1)))))
    rings = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(g), F.lit(1))), F.array(F.array("top")), grow)
    nodes = F.transform(F.filter(g, lambda t: t["role"] == ":instance"), lambda t: F.struct(t["source"].alias("node"), t["target"].alias("concept")))
    rows = graphs.withColumn("rings", rings).select("graph_id", "g", "rings", F.explode(nodes).alias("n")).select("graph_id", "g", "rings", "n.*")
    inside = F.size(F.filter("rings", lambda r: ~F.array_contains(r, F.col("node"))))
    args = F.size(F.filter(g, lambda t: (t["source"] == F.col("node")) & t["role"].startswith(":ARG")))
    parent = F.get(F.transform(F.filter(g, lambda t: (t["target"] == F.col("node")) & (t["role"] != ":instance")), lambda t: t["role"]), F.lit(0))
    minus = F.exists(g, lambda t: (t["source"] == F.col("node")) & (t["role"] == ":polarity") & (t["target"] == "-"))
    depth = F.when(inside < F.size("rings"), inside).otherwise(-1)
    return rows.select("graph_id", "node", F.regexp_replace("concept", "-[0-9]+$", "").alias("stem"), F.col("concept").rlike("-[0-9]+$").alias("numbered"), minus.alias("negated"), depth.alias("depth"), args.alias("n_args"), parent.alias("parent_role"))
