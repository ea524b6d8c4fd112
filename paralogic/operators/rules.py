"""Rewrite rules on graphs held as one row each: (graph_id, top, g), g an array of
(source, role, target) in page order.

A rule finds its matches as an array, is exploded to one row for each match and
edits that match's own copy of the graph, all in column expressions. Between the
one aggregate that packs the triples and the result there is no shuffle, join or
Python. A graph has to fit in memory; there is no bound on their number.

Defined results: a graph without instances has no matches; a null role or target
matches nothing; repeated triples count as two edges, so a role that has to be
single is not; rows of a null graph_id form one graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard
from . import lexicons as lex
from .lineage import cut

EDGE = "struct<source:string,role:string,target:string>"
MATCH = "struct<form:string,node:string,a:string,b:string,role_a:string,role_b:string,word:string>"

# ---------------------------------------------------------------- encodings


def pack(triples: DataFrame) -> DataFrame:
    """(graph_id, top, g) of a triples table (graph_id, pos, source, role, target); the first source is the top."""
    rows = triples.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "role", "target"))).alias("_rows"))
    edges = F.transform("_rows", lambda t: F.struct(t["source"].alias("source"), t["role"].alias("role"), t["target"].alias("target")))
    return rows.select("graph_id", F.get("_rows", F.lit(0))["source"].alias("top"), edges.alias("g"))


def unpack(graphs: DataFrame) -> DataFrame:
    """The triples table of packed graphs; other columns are kept."""
    rest = [c for c in graphs.columns if c != "g"]
    return graphs.select(*rest, F.posexplode("g").alias("pos", "t")).select(*rest, "pos", "t.source", "t.role", "t.target")


# ---------------------------------------------------------------- reading a graph


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edge(source: Column, role: Column | str, target: Column) -> Column:
    return F.struct(source.alias("source"), (F.lit(role) if isinstance(role, str) else role).alias("role"), target.alias("target"))


def targets(g: Column, node: Column, *roles: str) -> Column:
    return F.transform(F.filter(g, lambda t: (t["source"] == node) & t["role"].isin(*roles)), lambda t: t["target"])


def single(g: Column, node: Column, role: str) -> Column:
    """The only target of a role, null if there are none or several."""
    return let(targets(g, node, role), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))


def concept(g: Column, node: Column) -> Column:
    return F.get(targets(g, node, ":instance"), F.lit(0))


def negative(g: Column, node: Column) -> Column:
    return F.exists(g, lambda t: (t["source"] == node) & (t["role"] == ":polarity") & (t["target"] == "-"))


def match(form: str | Column = "", node=None, a=None, b=None, role_a=None, role_b=None, word=None) -> Column:
    parts = {"form": F.lit(form) if isinstance(form, str) else form, "node": node, "a": a, "b": b, "role_a": role_a, "role_b": role_b, "word": word}
    return F.struct(*((F.lit(None).cast("string") if c is None else F.lit(c) if isinstance(c, str) else c).alias(k) for k, c in parts.items()))


def at_nodes(g: Column, wanted: Callable[[Column], Column], make: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """Matches made at the instances ``wanted`` names, as far as they ``fit``."""
    nodes = F.filter(g, lambda t: (t["role"] == ":instance") & wanted(t["target"]))
    return F.filter(F.transform(nodes, make), fits)


def lookup(table: dict[str, str], key: Column) -> Column:
    """A bounded, fixed table as a map literal."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


# ---------------------------------------------------------------- editing a graph


def set_concept(g: Column, node: Column, new: Column) -> Column:
    return F.transform(g, lambda t: edge(t["source"], t["role"], F.when((t["source"] == node) & (t["role"] == ":instance"), new).otherwise(t["target"])))


def rename(g: Column, node: Column, *pairs: tuple[Column | str, Column | str]) -> Column:
    """New roles of a node's edges, all at once, so two roles can be exchanged."""

    def role(t: Column) -> Column:
        out = None
        for old, new in pairs:
            old, new = (F.lit(x) if isinstance(x, str) else x for x in (old, new))
            out = F.when(t["role"] == old, new) if out is None else out.when(t["role"] == old, new)
        return F.when(t["source"] == node, out.otherwise(t["role"])).otherwise(t["role"])

    return F.transform(g, lambda t: edge(t["source"], role(t), t["target"]))


def swap(g: Column, node: Column, a: Column | str, b: Column | str) -> Column:
    return rename(g, node, (a, b), (b, a))


def drop(g: Column, e: Column) -> Column:
    return F.filter(g, lambda t: ~(t == e))


def add(g: Column, *edges: Column) -> Column:
    return F.concat(g, F.array(*edges))


def toggle(g: Column, node: Column) -> Column:
    """Take a node's negation away, or give it one."""
    minus = edge(node, ":polarity", F.lit("-"))
    return let(g, lambda x: F.when(negative(x, node), drop(x, minus)).otherwise(add(x, minus)))


def negate(g: Column, node: Column) -> Column:
    """Negate a node; through and / or the negation moves down to the operands, whose connectives are exchanged.

    The connectives reached are gathered by as many steps as the graph has edges at most; each is visited once."""
    ops = lambda x, n: F.transform(F.filter(x, lambda t: F.array_contains(n, t["source"]) & t["role"].startswith(":op")), lambda t: t["target"])
    linked = lambda x: F.transform(F.filter(x, lambda t: (t["role"] == ":instance") & t["target"].isin("and", "or")), lambda t: t["source"])

    def run(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)))
        reached = F.aggregate(steps, F.array(node), lambda seen, _: F.array_union(seen, ops(x, F.array_intersect(seen, linked(x)))))
        return let(
            F.struct(reached.alias("all"), linked(x).alias("linked")),
            lambda s: let(F.array_intersect(s["all"], s["linked"]), lambda inner: _negate_all(x, inner, F.array_except(s["all"], s["linked"]))),
        )

    return let(g, run)


def _negate_all(x: Column, inner: Column, leaves: Column) -> Column:
    turned = F.transform(x, lambda t: edge(t["source"], t["role"], F.when(F.array_contains(inner, t["source"]) & (t["role"] == ":instance"), F.when(t["target"] == "and", "or").when(t["target"] == "or", "and").otherwise(t["target"])).otherwise(t["target"])))
    is_minus = lambda t: (t["role"] == ":polarity") & (t["target"] == "-") & F.array_contains(leaves, t["source"])
    had = F.transform(F.filter(x, is_minus), lambda t: t["source"])
    kept = F.filter(turned, lambda t: ~F.coalesce(is_minus(t), F.lit(False)))
    return F.concat(kept, F.transform(F.array_except(leaves, had), lambda n: edge(n, ":polarity", F.lit("-"))))


def fresh(g: Column, prefix: str) -> Column:
    """A variable that is not in use: the prefix, or the prefix with the first free number."""
    used = F.transform(F.filter(g, lambda t: t["role"] == ":instance"), lambda t: t["source"])
    tries = F.concat(F.array(F.lit(prefix)), F.transform(F.sequence(F.lit(1), F.size(g) + 1), lambda i: F.concat(F.lit(prefix), i.cast("string"))))
    return F.get(F.array_except(tries, used), F.lit(0))


# ---------------------------------------------------------------- the rules


@dataclass(frozen=True)
class Rule:
    """Matches of a graph, and the (g, top) a match makes; ``contrast`` is the non-equivalent variant, if there is one."""

    detect: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column, Column], tuple[Column, Column]]
    contrast: Callable[[Column, Column, Column], tuple[Column, Column]] | None = None


BOTH = lambda m: m["a"].isNotNull() & m["b"].isNotNull()


def _pairs(form: str, names: tuple[str, ...], ra: str, rb: str, extra=None):
    wanted = lambda c: c.isin(*names)
    fits = (lambda g: BOTH) if extra is None else (lambda g: lambda m: BOTH(m) & extra(g, m))
    return lambda g: at_nodes(g, wanted, lambda t: match(form, t["source"], single(g, t["source"], ra), single(g, t["source"], rb), ra, rb, t["target"]), fits(g))


def _conditions(g: Column) -> Column:
    return F.transform(F.filter(g, lambda t: t["role"] == ":condition"), lambda t: match("edge", t["source"], t["source"], t["target"]))


_frames = _pairs("frame", ("have-condition-91",), ":ARG1", ":ARG2")
_linked = _pairs("ops", ("and", "or"), ":op1", ":op2")
_either = _pairs("or", ("or",), ":op1", ":op2")


def _contraposition(g, top, m):
    edge_form = m["form"] == "edge"
    turned = F.when(edge_form, add(drop(g, edge(m["a"], ":condition", m["b"])), edge(m["b"], ":condition", m["a"]))).otherwise(swap(g, m["node"], ":ARG1", ":ARG2"))
    return negate(negate(turned, m["a"]), m["b"]), F.when(edge_form, m["b"]).otherwise(top)


def _implication(flip: bool):
    def run(g, top, m):
        root = fresh(g, "or")
        edges = F.concat(F.array(edge(root, ":instance", F.lit("or"))), add(drop(g, edge(m["a"], ":condition", m["b"])), edge(root, ":op1", m["b"]), edge(root, ":op2", m["a"])))
        to_or = set_concept(rename(g, m["node"], (":ARG2", ":op1"), (":ARG1", ":op2")), m["node"], F.lit("or"))
        to_if = set_concept(rename(g, m["node"], (":op1", ":ARG2"), (":op2", ":ARG1")), m["node"], F.lit("have-condition-91"))
        out = F.when(m["form"] == "edge", edges).when(m["form"] == "frame", to_or).otherwise(to_if)
        # the antecedent is b of an edge or a frame, and the first operand of an or
        return toggle(out, F.when(m["form"] == "or", m["a"]).otherwise(m["b"])) if flip else out, F.when(m["form"] == "edge", root).otherwise(top)

    return run


def _wrapped(g: Column) -> Column:
    """Connectives below a negated node; role_a is the wrapper, one match for each edge to them."""
    wraps = F.filter(g, lambda t: ~t["role"].isin(":instance", ":polarity") & negative(g, t["source"]) & F.coalesce(concept(g, t["source"]).isNotNull(), F.lit(False)) & concept(g, t["target"]).isin("and", "or"))
    return F.filter(F.transform(wraps, lambda t: match("wrapped", t["target"], single(g, t["target"], ":op1"), single(g, t["target"], ":op2"), t["source"], None, concept(g, t["target"]))), BOTH)


def _de_morgan(push: bool):
    def run(g, top, m):
        outer = F.when(m["form"] == "wrapped", m["role_a"]).otherwise(m["node"])
        out = set_concept(drop(g, edge(outer, ":polarity", F.lit("-"))), m["node"], F.when(m["word"] == "and", "or").otherwise("and"))
        return (toggle(toggle(out, m["a"]), m["b"]) if push else out), top

    return run


def _lexicon_pair(names: tuple[str, ...]):
    """The first role pair, in the fixed order, of which both are single."""

    def detect(g, top):
        def pick(n: Column) -> Column:
            tries = F.array(*(match("pair", n, single(g, n, a), single(g, n, b), a, b) for a, b in lex.ARGUMENT_PAIRS))
            return F.get(F.filter(tries, BOTH), F.lit(0))

        nodes = F.filter(g, lambda t: (t["role"] == ":instance") & t["target"].isin(*names))
        return F.filter(F.transform(nodes, lambda t: pick(t["source"])), lambda m: m.isNotNull())

    return detect


def _swapped(g, top, m):
    return swap(g, m["node"], m["role_a"], m["role_b"]), top


def _inverse(g, top):
    def frame(t: Column) -> Column:
        ra, rb = (lookup({k: v[i] for k, v in lex.INVERSE_FRAMES.items()}, t["target"]) for i in (1, 2))
        one = lambda r: let(F.filter(g, lambda e: (e["source"] == t["source"]) & (e["role"] == r)), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))["target"]))
        return match("frame", t["source"], one(ra), one(rb), ra, rb, lookup({k: v[0] for k, v in lex.INVERSE_FRAMES.items()}, t["target"]))

    frames = at_nodes(g, lambda c: c.isin(*lex.INVERSE_FRAMES), frame, BOTH)

    def named(t: Column) -> Column:
        whose = single(g, t["source"], ":ARG2")
        both = F.when(single(g, t["source"], ":ARG0").isNotNull() & single(g, t["source"], ":ARG1").isNotNull(), whose)
        return match("role", t["source"], both, both, ":ARG0", ":ARG1", lookup(lex.INVERSE_ROLES, concept(g, whose)))

    roles = at_nodes(g, lambda c: c.isin("have-rel-role-91", "have-org-role-91"), named, lambda m: BOTH(m) & m["word"].isNotNull())
    return F.concat(frames, roles)


def _inverse_apply(g, top, m):
    return set_concept(swap(g, m["node"], m["role_a"], m["role_b"]), F.when(m["form"] == "role", m["a"]).otherwise(m["node"]), m["word"]), top


def _hypernyms(g, top):
    stem = lambda c: F.regexp_replace(c, r"^(.+?)-(\d+)$", "$1")
    sense = lambda c: F.regexp_extract(c, r"^.+?(-\d+)$", 1)
    return at_nodes(g, lambda c: stem(c).isin(*lex.HYPERNYMS), lambda t: match("word", t["source"], word=F.concat(lookup(lex.HYPERNYMS, stem(t["target"])), sense(t["target"]))), lambda m: m["word"].isNotNull())


def _modal(g, top):
    def made(t: Column) -> Column:
        first, second = single(g, t["source"], ":ARG1"), single(g, t["source"], ":ARG2")
        return match("modal", t["source"], F.when(t["target"] == "obligate-01", F.coalesce(second, first)).otherwise(F.coalesce(first, second)), word=lookup(lex.MODAL_DUALS, t["target"]))

    return at_nodes(g, lambda c: c.isin(*lex.MODAL_DUALS), made, lambda m: m["a"].isNotNull())


def _marked(variable: Callable[[Column], Column], word: Callable[[Column], Column]):
    """Put a marker below the match's node by :mod."""

    def run(g, top, m):
        v = variable(m)
        return F.concat(F.array(edge(v, ":instance", word(m))), add(g, edge(m["node"], ":mod", v))), top

    return run


def _aspect(g, top):
    has = lambda *roles: F.exists(g, lambda t: (t["source"] == top) & t["role"].isin(*roles))
    kind = F.when(has(":freq", ":frequency"), "habitual").when(has(":duration"), "activity").otherwise("performance")
    return F.filter(F.array(match(kind, top)), lambda m: m["node"].isNotNull())


def _choose(table: dict[str, str]):
    return lambda m: lookup(table, m["form"])


def _times(g, top):
    hits = F.filter(g, lambda t: (t["role"] == ":time") & concept(g, t["target"]).isin("after", "before"))
    return F.filter(F.transform(hits, lambda t: match("time", t["source"], t["target"], single(g, t["target"], ":op1"), word=concept(g, t["target"]))), BOTH)


def _ordered(variable: str, exchange: bool):
    def run(g, top, m):
        v = F.lit(variable)
        first, second = (m["node"], m["b"]) if exchange else (m["b"], m["node"])
        frame = F.when(m["word"] == "after", "precede-01").otherwise("follow-01")
        return F.concat(F.array(edge(v, ":instance", frame)), add(drop(g, edge(m["node"], ":time", m["a"])), edge(v, ":ARG0", first), edge(v, ":ARG1", second))), v

    return run


def _tense(g, top):
    return F.filter(F.array(F.when(F.exists(g, lambda t: (t["source"] == top) & t["role"].isin(":time", ":date")), match("tense", top))), lambda m: m.isNotNull())


RULES = {
    "contraposition": Rule(lambda g, top: F.concat(_frames(g), _conditions(g)), _contraposition, lambda g, top, m: (toggle(g, m["b"]), top)),
    "commutative": Rule(lambda g, top: _linked(g), lambda g, top, m: (swap(g, m["node"], ":op1", ":op2"), top), lambda g, top, m: (toggle(g, m["b"]), top)),
    "implication": Rule(lambda g, top: F.concat(_frames(g), _either(g), _conditions(g)), _implication(True), _implication(False)),
    "double_negation": Rule(
        lambda g, top: at_nodes(g, lambda c: c.isNotNull(), lambda t: match("node", t["source"]), lambda m: m["node"].isNotNull()),
        lambda g, top, m: (toggle(g, m["node"]), top),
        lambda g, top, m: (F.when(negative(g, m["node"]), g).otherwise(toggle(g, m["node"])), top),
    ),
    "de_morgan": Rule(lambda g, top: F.concat(_pairs("direct", ("and", "or"), ":op1", ":op2", lambda x, m: negative(x, m["node"]))(g), _wrapped(g)), _de_morgan(True), _de_morgan(False)),
    "inverse_relation": Rule(_inverse, _inverse_apply, _swapped),
    "symmetric": Rule(_lexicon_pair(lex.SYMMETRIC), _swapped, lambda g, top, m: (toggle(g, m["a"]), top)),
    "asymmetric": Rule(_lexicon_pair(lex.ASYMMETRIC), lambda g, top, m: (toggle(swap(g, m["node"], m["role_a"], m["role_b"]), m["node"]), top), _swapped),
    "predicate_implication": Rule(_hypernyms, lambda g, top, m: (set_concept(g, m["node"], m["word"]), top)),
    "aspect_equivalence": Rule(_aspect, _marked(lambda m: F.concat(F.lit("_asp_"), m["form"]), _choose(lex.ASPECT_MARKS)), _marked(lambda m: F.concat(F.lit("_asp_neg_"), m["form"]), _choose(lex.WRONG_ASPECT_MARKS))),
    "modal_strength_inversion": Rule(_modal, lambda g, top, m: (toggle(toggle(set_concept(g, m["node"], m["word"]), m["node"]), m["a"]), top), lambda g, top, m: (set_concept(g, m["node"], m["word"]), top)),
    "doc_level_temporal_transitivity": Rule(_times, _ordered("trans_temporal", False), _ordered("trans_temporal_neg", True)),
    "tense_transformation": Rule(_tense, _marked(lambda m: F.lit("_tense_marker"), lambda m: F.lit("tense-shifted")), _marked(lambda m: F.lit("_tense_neg_marker"), lambda m: F.lit("tense-contradicted"))),
}


def detect(graphs: DataFrame, *rules: str) -> DataFrame:
    """(graph_id, top, g, rule, at, m): one row for each match of the named rules, all by default."""
    found = F.array(*(F.struct(F.lit(r).alias("rule"), RULES[r].detect(F.col("g"), F.col("top")).alias("ms")) for r in rules or RULES))
    each = graphs.select("graph_id", "top", "g", F.explode(found).alias("r"))
    return each.select("graph_id", "top", "g", "r.rule", F.posexplode("r.ms").alias("at", "m"))


def transform(graphs: DataFrame, rule: str) -> DataFrame:
    """(graph_id, rule, at, label, top, g): each match's equivalent graph (label 1) and its contrast (0)."""
    it = RULES[rule]
    args = (F.col("g"), F.col("top"), F.col("m"))
    variants = [(1, it.apply)] + ([(0, it.contrast)] if it.contrast else [])
    made = []
    for label, rewrite in variants:
        g, top = rewrite(*args)
        made.append(F.struct(F.lit(label).alias("label"), top.alias("top"), g.alias("g")))
    return detect(graphs, rule).select("graph_id", "rule", "at", F.explode(F.array(*made)).alias("v")).select("graph_id", "rule", "at", "v.label", "v.top", "v.g")


def compose(graphs: DataFrame, steps: list[str]) -> DataFrame:
    """(graph_id, label, top, g): rules one after another; each takes the first match, and a graph where one finds none is out."""
    out = graphs
    for k, rule in enumerate(steps):
        made = transform(out, rule).filter("at = 0")
        if k + 1 < len(steps):
            made = made.filter("label = 1")
        out = made.select("graph_id", "label", "top", "g")
    return out


def pick_by_label(results: DataFrame, labels: DataFrame) -> DataFrame:
    """For each (graph_id, label) of ``labels`` the first result of that label, else the first of any."""
    rank = F.struct((F.col("label") != F.col("wanted")).alias("other"), "at", (-F.col("label")).alias("n"))
    joined = labels.select("graph_id", F.col("label").alias("wanted")).join(results, "graph_id")
    return joined.groupBy("graph_id", "wanted").agg(F.min_by(F.struct("label", "top", "g"), rank).alias("v")).select("graph_id", "wanted", "v.*")


# ---------------------------------------------------------------- two graphs


def implications(graphs: DataFrame, depth: int = 4) -> DataFrame:
    """(graph_id, g, cons, ante, cons_words, ante_words): the first implication of each graph that has one.

    Words are the concepts, without senses, within ``depth`` edges of a side."""
    g = F.col("g")
    frames = F.transform(F.filter(g, lambda t: (t["role"] == ":instance") & (t["target"] == "have-condition-91")), lambda t: F.struct(F.get(targets(g, t["source"], ":ARG1"), F.lit(0)).alias("cons"), F.get(targets(g, t["source"], ":ARG2"), F.lit(0)).alias("ante")))
    edges = F.transform(F.filter(g, lambda t: t["role"] == ":condition"), lambda t: F.struct(t["source"].alias("cons"), t["target"].alias("ante")))
    first = F.get(F.concat(F.filter(frames, lambda m: m["cons"].isNotNull() & m["ante"].isNotNull()), edges), F.lit(0))

    def words(node: str) -> Column:
        ahead = lambda seen: F.transform(F.filter(g, lambda t: F.array_contains(seen, t["source"]) & ~t["role"].isin(":instance", ":polarity")), lambda t: t["target"])
        near = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(F.col(node)), lambda seen, _: F.array_union(seen, ahead(seen)))
        return let(near, lambda n: F.array_distinct(F.transform(F.filter(g, lambda t: (t["role"] == ":instance") & F.array_contains(n, t["source"])), lambda t: F.regexp_replace(t["target"], r"-\d+$", ""))))

    found = graphs.select("graph_id", "g", first.alias("i")).filter("i is not null").select("graph_id", "g", "i.cons", "i.ante")
    return found.withColumns({"cons_words": words("cons"), "ante_words": words("ante")})


def chains(graphs: DataFrame, threshold: float = 0.5, depth: int = 4) -> DataFrame:
    """(first, second, similarity, cons, ante): ordered pairs of different graphs where the consequent of the first
    is like the antecedent of the second; ``cons`` (of the second) and ``ante`` (of the first) make the conclusion.

    Word sets are collapsed to classes before they meet by prefix filter, so copies are compared once. A side
    without words matches nothing."""
    facts = cut(implications(graphs, depth).drop("g"))
    side = lambda c, k: facts.select(F.array_sort(c).alias(k)).filter(F.size(k) > 0).distinct()
    a, b = side("cons_words", "words_a"), side("ante_words", "words_b")
    rarity = a.select(F.explode("words_a").alias("w")).unionByName(b.select(F.explode("words_b").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def prefix(rows: DataFrame, k: str) -> DataFrame:
        ranked = rows.select(k, F.explode(k).alias("w")).join(rarity, "w").groupBy(k).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
        return ranked.select(k, F.explode(F.slice("r", 1, F.size(k) - F.ceil(F.size(k) * threshold - 1e-9).cast("int") + 1)).alias("p")).select(k, F.col("p.w").alias("w"))

    met = prefix(a, "words_a").join(prefix(b, "words_b"), "w").select("words_a", "words_b").distinct()
    alike = met.withColumn("similarity", jaccard(F.col("words_a"), F.col("words_b"))).filter(F.col("similarity") >= threshold)
    left = facts.select(F.col("graph_id").alias("first"), "ante", F.array_sort("cons_words").alias("words_a"))
    right = facts.select(F.col("graph_id").alias("second"), "cons", F.array_sort("ante_words").alias("words_b"))
    return alike.join(left, "words_a").join(right, "words_b").filter("first <> second").select("first", "second", "similarity", "cons", "ante")


def conclude(graphs: DataFrame, found: DataFrame) -> DataFrame:
    """(first, second, top, g): ``consequent of the second :condition antecedent of the first`` for each chain. Variables of
    the second graph get the prefix ``g2_``; of both graphs only what the two sides reach without :condition edges stays."""
    g1, g2 = (graphs.select(F.col("graph_id").alias(k), F.col("g").alias(f"_{k}")) for k in ("first", "second"))

    def part(g: Column, node: Column) -> Column:
        ahead = lambda seen: F.transform(F.filter(g, lambda t: F.array_contains(seen, t["source"]) & ~t["role"].isin(":instance", ":condition")), lambda t: t["target"])
        near = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(g), F.lit(1))), F.array(node), lambda seen, _: F.array_union(seen, ahead(seen)))
        return let(near, lambda n: F.filter(g, lambda t: F.array_contains(n, t["source"]) & (t["role"] != ":condition")))

    names = F.transform(F.filter("_second", lambda t: t["role"] == ":instance"), lambda t: t["source"])
    named = lambda c: F.when(F.array_contains(names, c), F.concat(F.lit("g2_"), c)).otherwise(c)
    second = F.transform(part(F.col("_second"), F.col("cons")), lambda t: edge(named(t["source"]), t["role"], named(t["target"])))
    top = named(F.col("cons"))
    joined = found.join(g1, "first").join(g2, "second")
    # stored, so that a UDF that follows (the text form) gets plain columns and not these lambdas
    return cut(joined.select("first", "second", top.alias("top"), F.concat(second, F.array(edge(top, ":condition", F.col("ante"))), part(F.col("_first"), F.col("ante"))).alias("g")))
