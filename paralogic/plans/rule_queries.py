"""Queries that apply the rewrite rules to graphs of varied shape, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch, documents, graphs, lexicons as lex, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FRAMES = ["buy-01", "marry-01", "exceed-01", "obligate-01", "bark-02", "lead-01", "possible-01", "have-rel-role-91", "teach-01", "allow-01", "own-01", "border-01"]
_FRAME = "case p_partkey % 12 " + " ".join(f"when {k} then '{f}'" for k, f in enumerate(FRAMES)) + " end"
_THIRD = "p_size % 3 = 0 or p_partkey % 12 = 7"
#: (source, role, target as SQL over part); null targets are left out.
SHAPE = [
    ("e", ":instance", _FRAME), ("e", ":ARG0", "case when p_size % 4 > 0 then 'x' end"), ("x", ":instance", "case when p_size % 2 = 0 then 'dog' else 'person' end"), ("x", ":polarity", "case when p_size % 5 = 0 then '-' end"),
    ("e", ":ARG1", "'y'"), ("y", ":instance", "'run-02'"), ("e", ":ARG2", f"case when {_THIRD} then 'z' end"), ("z", ":instance", f"case when {_THIRD} then 'mother' end"), ("e", ":polarity", "case when p_size % 7 = 0 then '-' end"),
    ("e", ":time", "case when p_size % 6 < 4 then 't' end"), ("t", ":instance", "case p_size % 6 when 0 then 'after' when 1 then 'before' when 2 then 'now' when 3 then 'after' end"), ("t", ":op1", "case when p_size % 6 < 2 then 'a' end"),
    ("a", ":instance", "case when p_size % 6 < 2 then 'night' end"), ("e", ":freq", "case when p_size % 9 = 0 then '3' end"), ("e", ":duration", "case when p_size % 10 = 0 then 'd' end"),
]


def varied(spark: SparkSession, d: str) -> DataFrame:
    """Triples of a graph for each part: twelve frames, with and without each role, negation, time and frequency."""
    rows = [F.struct(F.lit(k).alias("pos"), F.lit(s).alias("source"), F.lit(r).alias("role"), F.expr(t).alias("target")) for k, (s, r, t) in enumerate(SHAPE)]
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("graph_id"), F.explode(F.array(*rows)).alias("t")).select("graph_id", "t.*").filter("target is not null")


W = """
w as (select 'w' || p_partkey graph_id, pos, source, role, target from part, lateral (values """ + ", ".join(f"({k}, '{s}', '{r}', {t})" for k, (s, r, t) in enumerate(SHAPE)) + """) t(pos, source, role, target) where target is not null),
h as (select graph_id, max(target) filter (source = 'e' and role = ':instance') frame, max(target) filter (source = 'e' and role = ':ARG0') a0, max(target) filter (source = 'e' and role = ':ARG1') a1, max(target) filter (source = 'e' and role = ':ARG2') a2,
  max(target) filter (source = 't' and role = ':instance') word, max(target) filter (source = 't' and role = ':op1') anchor, bool_or(role = ':freq') freq, bool_or(role = ':duration') dur, bool_or(role = ':time') timed from w group by graph_id),
neg as (select graph_id, source from w where role = ':polarity')"""


def _packed(s: SparkSession, d: str) -> DataFrame:
    return rules.pack(varied(s, d))


def _applied(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rules.unpack(rules.transform(_packed(s, d), rule)).select("graph_id", "at", "label", "source", "role", "target")


def _values(table: dict) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in (k, *(v if isinstance(v, tuple) else (v,)))) + ")" for k, v in table.items())


#: Of matches m (graph_id, node, ra, rb): all triples with two roles of the node exchanged.
_SWAPPED = "select w.graph_id, label, pos, source, case when source = node and role = ra then rb when source = node and role = rb then ra else role end role, target from w join m using (graph_id), l"


def _toggled(rows: str, nodes: str) -> str:
    """Rows (graph_id, label, source, role, target) with the polarity of ``nodes`` (graph_id, label, source) taken away or given."""
    return f"""select r.graph_id, 0 "at", r.label, r.source, r.role, r.target from ({rows}) r where not (r.role = ':polarity' and exists (select 1 from ({nodes}) n where n.graph_id = r.graph_id and n.label = r.label and n.source = r.source))
union all select n.graph_id, 0, n.label, n.source, ':polarity', '-' from ({nodes}) n where not exists (select 1 from neg where neg.graph_id = n.graph_id and neg.source = n.source)"""


_PAIR = "case when a0 is not null then ':ARG0' when a2 is not null then ':ARG1' end ra, case when a0 is not null then ':ARG1' when a2 is not null then ':ARG2' end rb, case when a0 is not null then a0 when a2 is not null then a1 end first"
_L = "l as (select unnest([0, 1]) label)"

QUERIES["rewrite_inverse_relation"] = _applied("inverse_relation")
SQL["rewrite_inverse_relation"] = f"""with {W}, {_L}, x(frame, new, ra, rb) as (values {_values(lex.INVERSE_FRAMES)}), y(old, new) as (values {_values(lex.INVERSE_ROLES)}),
m as (select graph_id, 'e' node, ra, rb, 'e' renamed, new from h join x using (frame) where case ra when ':ARG0' then a0 when ':ARG1' then a1 end is not null and case rb when ':ARG1' then a1 when ':ARG2' then a2 end is not null
  union all select graph_id, 'e', ':ARG0', ':ARG1', 'z', new from h join y on old = 'mother' where frame = 'have-rel-role-91' and a0 is not null and a1 is not null and a2 is not null)
select s.graph_id, 0 "at", label, source, role, case when label = 1 and source = renamed and role = ':instance' then new else target end target from ({_SWAPPED}) s join m using (graph_id)"""

_SYM = f"m as (select graph_id, 'e' node, {_PAIR} from h where frame in ({{0}}) and (a0 is not null or a2 is not null))"
QUERIES["rewrite_symmetric"] = _applied("symmetric")
SQL["rewrite_symmetric"] = f"""with {W}, {_L}, {_SYM.format(", ".join(f"'{x}'" for x in lex.SYMMETRIC))},
k as (select graph_id, label, source, case when label = 1 and source = node and role = ra then rb when label = 1 and source = node and role = rb then ra else role end role, target from w join m using (graph_id), l)
{_toggled("select * from k", "select graph_id, 0 label, first source from m")}"""
QUERIES["rewrite_asymmetric"] = _applied("asymmetric")
SQL["rewrite_asymmetric"] = f"""with {W}, {_L}, {_SYM.format(", ".join(f"'{x}'" for x in lex.ASYMMETRIC))}, k as (select graph_id, label, source, role, target from ({_SWAPPED}))
{_toggled("select * from k", "select graph_id, 1 label, node source from m")}"""

QUERIES["rewrite_predicate_implication"] = _applied("predicate_implication")
SQL["rewrite_predicate_implication"] = f"""with {W}, y(stem, up) as (values {_values(lex.HYPERNYMS)}),
m as (select graph_id, source node, up || regexp_extract(target, '(-[0-9]+)?$') new, row_number() over (partition by graph_id order by pos) - 1 "at" from w join y on regexp_replace(target, '-[0-9]+$', '') = stem where role = ':instance')
select graph_id, "at", 1 as label, source, role, case when source = node and role = ':instance' then new else target end target from w join m using (graph_id)"""

QUERIES["rewrite_modal_strength_inversion"] = _applied("modal_strength_inversion")
SQL["rewrite_modal_strength_inversion"] = f"""with {W}, {_L}, y(frame, dual) as (values {_values(lex.MODAL_DUALS)}),
m as (select graph_id, dual, case when frame = 'obligate-01' then coalesce(a2, a1) else coalesce(a1, a2) end act from h join y using (frame)),
k as (select graph_id, label, source, role, case when source = 'e' and role = ':instance' then dual else target end target from w join m using (graph_id), l)
{_toggled("select * from k", "select graph_id, 1 label, 'e' source from m union all select graph_id, 1, act from m")}"""

_KIND = "case when freq then 'habitual' when dur then 'activity' else 'performance' end"
QUERIES["rewrite_aspect_equivalence"] = _applied("aspect_equivalence")
SQL["rewrite_aspect_equivalence"] = f"""with {W}, {_L}, good(kind, mark) as (values {_values(lex.ASPECT_MARKS)}), bad(kind, mark) as (values {_values(lex.WRONG_ASPECT_MARKS)}),
m as (select graph_id, label, case when label = 1 then '_asp_' else '_asp_neg_' end || {_KIND} as v, case when label = 1 then good.mark else bad.mark end mark from h join good on good.kind = {_KIND} join bad on bad.kind = {_KIND}, l)
select w.graph_id, 0 "at", label, source, role, target from w, l union all select graph_id, 0, label, v, ':instance', mark from m union all select graph_id, 0, label, 'e', ':mod', v from m"""

QUERIES["rewrite_doc_level_temporal_transitivity"] = _applied("doc_level_temporal_transitivity")
SQL["rewrite_doc_level_temporal_transitivity"] = f"""with {W}, {_L},
m as (select graph_id, label, case when label = 1 then 'trans_temporal' else 'trans_temporal_neg' end as v, case word when 'after' then 'precede-01' else 'follow-01' end frame, case when label = 1 then anchor else 'e' end side0, case when label = 1 then 'e' else anchor end side1 from h, l where timed and word in ('after', 'before') and anchor is not null)
select graph_id, 0 "at", label, source, role, target from w join (select distinct graph_id from m) using (graph_id), l where not (source = 'e' and role = ':time')
union all select graph_id, 0, label, v, ':instance', frame from m union all select graph_id, 0, label, v, ':ARG0', side0 from m union all select graph_id, 0, label, v, ':ARG1', side1 from m"""

QUERIES["rewrite_tense_transformation"] = _applied("tense_transformation")
SQL["rewrite_tense_transformation"] = f"""with {W}, {_L}, m as (select graph_id, label, case when label = 1 then '_tense_marker' else '_tense_neg_marker' end as v, case when label = 1 then 'tense-shifted' else 'tense-contradicted' end mark from h, l where timed)
select graph_id, 0 "at", label, source, role, target from w join (select distinct graph_id from m) using (graph_id), l
union all select graph_id, 0, label, v, ':instance', mark from m union all select graph_id, 0, label, 'e', ':mod', v from m"""


# ------------------------------------------------------------------ dispatch and picks


def _requested(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d).select("graph_id", "top", "g", F.lit("symmetric_asymmetric").alias("label"))


QUERIES["dispatch_first_rule"] = lambda s, d: dispatch.first_that_fires(_requested(s, d)).select("graph_id", "label", "rule")
_FIRES = f"""case when a0 is null and a2 is null then null when frame in ({", ".join(f"'{x}'" for x in lex.SYMMETRIC)}) then 'symmetric' when frame in ({", ".join(f"'{x}'" for x in lex.ASYMMETRIC)}) then 'asymmetric' end"""
SQL["dispatch_first_rule"] = f"with {W} select graph_id, 'symmetric_asymmetric' as label, {_FIRES} as rule from h"

QUERIES["pick_both_variants"] = lambda s, d: rules.unpack(dispatch.both_variants(rules.transform(_packed(s, d), "tense_transformation")).select("graph_id", F.col("positive.g").alias("g"))).select("graph_id", "source", "role", "target")
SQL["pick_both_variants"] = f"""with {W}, m as (select graph_id from h where timed)
select graph_id, source, role, target from w semi join m using (graph_id) union all select graph_id, '_tense_marker', ':instance', 'tense-shifted' from m union all select graph_id, 'e', ':mod', '_tense_marker' from m"""

QUERIES["attribute_counts"] = lambda s, d: dispatch.added_attributes(_packed(s, d))
SQL["attribute_counts"] = f"""with {W}, f as (select graph_id, source, target from w where role = ':instance'),
x as (select graph_id, ':animacy' as role from f where target in ('dog', 'person', 'mother', 'after', 'before', 'now', 'night') union all
  select graph_id, ':modal-strength' from f where source in ('e', 'y') union all select graph_id, ':aspect' from h where freq)
select role, count(*) n from x group by role"""

# ------------------------------------------------------------------ documents


def _sentences(s: SparkSession, d: str) -> DataFrame:
    no = F.regexp_replace("graph_id", "w", "").cast("long")
    return _packed(s, d).select((no % 10).alias("doc"), no.alias("pos"), F.concat("graph_id", F.lit(".")).alias("prefix"), "top", "g")


QUERIES["document_relations"] = lambda s, d: documents.relations(_sentences(s, d))
SQL["document_relations"] = f"""with {W}, k as (select *, substr(graph_id, 2)::bigint no from w),
e as (select no % 10 doc, no, graph_id || '.' p, source, row_number() over (partition by graph_id order by pos) n from k where role = ':instance' and regexp_matches(target, '^[a-z][a-z0-9_-]*-[0-9]{{2,3}}$'))
select doc, 'author' src, case when exists (select 1 from neg where neg.graph_id || '.' = p and neg.source = e.source) then ':full-negative' else ':full-affirmative' end rel, p || source tgt from e
union all select doc, 'document-creation-time', ':before', p || source from e
union all select a.doc, a.p || a.source, ':overlap', b.p || b.source from e a join e b on a.no = b.no and a.n < b.n and b.n <= 8
union all select substr(graph_id, 2)::bigint % 10, graph_id || '.e', ':' || word, graph_id || '.' || anchor from h where timed and word in ('after', 'before') and anchor is not null
union all select doc, src, ':before', tgt from (select substr(graph_id, 2)::bigint % 10 doc, graph_id || '.e' src, lead(graph_id || '.e') over (partition by substr(graph_id, 2)::bigint % 10 order by substr(graph_id, 2)::bigint) tgt from h) where tgt is not null"""

# ------------------------------------------------------------------ nodes, links, chains

QUERIES["node_features"] = lambda s, d: graphs.node_features(_packed(s, d)).withColumn("parent_role", F.coalesce("parent_role", F.lit("-")))
SQL["node_features"] = f"""with {W} select graph_id, source node, regexp_replace(target, '-[0-9]+$', '') stem, regexp_matches(target, '-[0-9]+$') numbered, exists (select 1 from neg n where n.graph_id = w.graph_id and n.source = w.source) negated,
  case source when 'e' then 0 when 'a' then 2 else 1 end depth, (select count(*) from w v where v.graph_id = w.graph_id and v.source = w.source and starts_with(v.role, ':ARG')) n_args,
  coalesce((select arg_min(v.role, v.pos) from w v where v.graph_id = w.graph_id and v.target = w.source and v.role <> ':instance'), '-') parent_role from w where role = ':instance' and (source <> 'x' or exists (select 1 from h where h.graph_id = w.graph_id and a0 is not null))
union all select graph_id, source, regexp_replace(target, '-[0-9]+$', ''), regexp_matches(target, '-[0-9]+$'), exists (select 1 from neg n where n.graph_id = w.graph_id and n.source = w.source), -1, 0, '-' from w where role = ':instance' and source = 'x' and exists (select 1 from h where h.graph_id = w.graph_id and a0 is null)"""


def _linked(s: SparkSession, d: str) -> DataFrame:
    t = varied(s, d)
    links = t.filter("role = ':instance' and target = 'dog'").select("graph_id", F.lit(99).alias("pos"), "source", F.lit(":wiki").alias("role"), F.concat(F.lit("Q"), F.substring("graph_id", 2, 9)).alias("target"))
    return t.unionByName(links)


_LINKED = f"{W}, k as (select graph_id, source, role, target from w union all select graph_id, source, ':wiki', 'Q' || substr(graph_id, 2) from w where role = ':instance' and target = 'dog')"
_FLAT = ("graph_id", "source", "role", "target")
QUERIES["links_removed"] = lambda s, d: graphs.without_roles(_linked(s, d), ":wiki").select(*_FLAT)
SQL["links_removed"] = f"with {_LINKED} select * from k where role <> ':wiki'"
QUERIES["links_masked"] = lambda s, d: graphs.mask_links(_linked(s, d)).select(*_FLAT)
SQL["links_masked"] = f"with {_LINKED} select graph_id, source, role, case when role = ':wiki' then '+' else target end target from k"
QUERIES["roles_stripped"] = lambda s, d: graphs.without_roles(_linked(s, d), ":time", ":freq", ":duration", ":wiki", ":polarity").select(*_FLAT)
SQL["roles_stripped"] = f"with {_LINKED} select * from k where role not in (':time', ':freq', ':duration', ':wiki', ':polarity')"
QUERIES["tagged_inputs"] = lambda s, d: varied(s, d).filter("role = ':instance'").join(s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("graph_id"), "p_name"), "graph_id").select("graph_id", "source", F.concat("p_name", F.lit(" [SEP] target: "), "target").alias("input"))
SQL["tagged_inputs"] = f"with {W} select graph_id, source, p_name || ' [SEP] target: ' || target as input from w join part on graph_id = 'w' || p_partkey where role = ':instance'"
QUERIES["prompt_types"] = lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("commutative"), F.lit("de_morgan"))).otherwise(F.array(F.lit("implication")))).alias("rule")).filter(F.col("rule").isin("commutative", "implication"))
SQL["prompt_types"] = "select p_partkey, r as rule from part, unnest(case when p_size % 2 = 0 then ['commutative', 'de_morgan'] else ['implication'] end) u(r) where r in ('commutative', 'implication')"


def _facts(s: SparkSession, d: str) -> DataFrame:
    """If <nation> then <region>; if <region> then earth."""
    nation, region = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/region.parquet")
    facts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("graph_id"), F.col("n_name").alias("ante"), F.col("r_name").alias("cons"))
    facts = facts.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("graph_id"), F.col("r_name").alias("ante"), F.lit("earth").alias("cons")))
    t = lambda pos, a, r, b: F.struct(F.lit(pos).alias("pos"), F.lit(a).alias("source"), F.lit(r).alias("role"), (F.lit(b) if isinstance(b, str) else b).alias("target"))
    rows = F.array(t(0, "c", ":instance", "have-condition-91"), t(1, "c", ":ARG1", "x"), t(2, "x", ":instance", F.col("cons")), t(3, "c", ":ARG2", "y"), t(4, "y", ":instance", F.col("ante")))
    return rules.pack(facts.select("graph_id", F.explode(rows).alias("t")).select("graph_id", "t.*"))


QUERIES["transitive_chains"] = lambda s, d: rules.chains(_facts(s, d)).select("first", "second", F.round("similarity", 8).alias("similarity"))
SQL["transitive_chains"] = "select 'n' || n_nationkey as first, 'r' || n_regionkey as second, 1.0::double similarity from nation"


def _concluded(s: SparkSession, d: str) -> DataFrame:
    packed = _facts(s, d)
    made = rules.conclude(packed, rules.chains(packed))
    return made.select("first", "second", F.posexplode("g").alias("pos", "t")).select("first", "second", "t.source", "t.role", "t.target")


QUERIES["transitive_conclusions"] = _concluded
SQL["transitive_conclusions"] = "select 'n' || n_nationkey as first, 'r' || n_regionkey as second, t.source, t.role, t.target from nation, lateral (values ('g2_x', ':instance', 'earth'), ('g2_x', ':condition', 'y'), ('y', ':instance', n_name)) t(source, role, target)"
