"""Queries for projections, predicates, joins, selections, evaluation and string functions, and their SQL.

An ``Input`` names columns by expressions that Spark and DuckDB read alike: it is the
given data. What is done with it is the operators' in the query and plain SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores, strings as st
from ..functions.text import tokenize
from ..operators import evaluation as ev, selection as sel
from ..operators.verdicts import precision_recall

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Input:
    table: str
    columns: dict[str, str]
    where: str = "true"

    def df(self, s: SparkSession, d: str) -> DataFrame:
        return s.read.parquet(f"{d}/{self.table}.parquet").filter(self.where).selectExpr(*(f"{e} as `{c}`" for c, e in self.columns.items()))

    def cte(self, name: str) -> str:
        return f"{name} as (select " + ", ".join(f'{e} as "{c}"' for c, e in self.columns.items()) + f" from {self.table} where {self.where})"


def _q(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _row(name: str, i: Input, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query over one input ``i``, called ``i`` in its SQL too."""
    QUERIES[name] = lambda s, d: make(i.df(s, d))
    SQL[name] = f"with {i.cte('i')} {sql}"


# ------------------------------------------------------------------ projections

_ORDERS = Input("orders", {"id": "o_orderkey", "origin": "concat('o', cast(o_custkey as string))", "sentence": "concat('  Order of ', o_orderpriority, ' is ', o_orderstatus, '.  ')", "generated": "concat('Is ', o_orderstatus)", "score": "o_totalprice", "label": "o_orderkey % 2", "tag": "o_orderpriority"})
_row("pair_projection", _ORDERS, lambda x: x.select(F.col("sentence").alias("sentence1"), F.col("generated").alias("sentence2"), "label"), "select sentence sentence1, generated sentence2, label from i")
_row("positional_rename", _ORDERS, lambda x: x.toDF("a", "b", "s1", "s2", "c", "lab", "e").drop("a", "b", "c", "e"), "select sentence s1, generated s2, label lab from i")
_row("provenance_suffix", _ORDERS, lambda x: x.select(F.concat("origin", F.lit("_v14_"), "tag").alias("origin"), F.concat("origin", F.lit("_v9_s"), F.pmod("id", F.lit(3)).cast("string")).alias("sampled")), "select origin || '_v14_' || tag origin, origin || '_v9_s' || (id % 3)::varchar sampled from i")
_row("prompt_prefix", _ORDERS, lambda x: x.select("id", F.concat(F.lit("extract triples from sentence: "), F.trim("sentence")).alias("prompt")), "select id, 'extract triples from sentence: ' || trim(sentence) prompt from i")
_row("prompt_template", _ORDERS, lambda x: x.select("id", F.format_string("Rule: %s\nSentence: %s\nRewrite:", F.col("tag"), F.trim("sentence")).alias("prompt")), "select id, 'Rule: ' || tag || chr(10) || 'Sentence: ' || trim(sentence) || chr(10) || 'Rewrite:' prompt from i")
_row("key_split_back", _ORDERS, lambda x: x.select(F.concat_ws("::", "tag", "origin", F.col("id").cast("string")).alias("key")).select("key", F.split("key", "::")[0].alias("system"), F.element_at(F.split("key", "::"), -1).alias("rule")), "select concat_ws('::', tag, origin, id::varchar) as key, tag as system, id::varchar as rule from i")

_MCQ = Input("customer", {"id": "c_custkey", "question": "case when c_custkey % 3 = 0 then concat('The _ of ', c_mktsegment, ' is _') else concat('Which is ', c_mktsegment) end", "ending": "c_name", "answer": "case c_custkey % 7 when 0 then 'A' when 1 then 'D' when 2 then '3' when 3 then '1' when 4 then 'E' when 5 then 'b' end", "split": "case when c_custkey % 5 = 0 then 'test' else 'train' end"})
_row("choice_text", _MCQ, lambda x: x.select("id", st.choice_text(F.col("question"), F.col("ending")).alias("choice")), "select id, case when contains(question, '_') then replace(question, '_', ending) else question || ' ' || ending end choice from i")
_row("answer_index", _MCQ, lambda x: x.select("id", F.when(F.col("split") == "test", 0).otherwise(F.coalesce(st.answer_index(F.col("answer")), F.lit(-1))).alias("label")), "select id, case when split = 'test' then 0 else case answer when 'A' then 0 when 'B' then 1 when 'C' then 2 when 'D' then 3 when '1' then 0 when '2' then 1 when '3' then 2 when '4' then 3 else -1 end end as label from i")
_row("context_copies", _MCQ, lambda x: x.select("id", F.posexplode(F.array_repeat("question", 4)).alias("pos", "context")), "select id, p pos, question context from i, range(4) r(p)")

_MENTION = Input("part", {"id": "p_partkey", "sentence": "concat('The ', p_type, ' by ', p_brand, ' here')", "mention": "case when p_size % 2 = 0 then p_brand else 'nobody' end"})
_row("mention_context", _MENTION, lambda x: x.select("id", st.mention_context(F.col("sentence"), F.col("mention")).alias("c")).select("id", "c.left", "c.right"), "select id, case when p > 0 then substr(s, 1, p - 1) else s end as left, case when p > 0 then substr(s, p + length(mention)) else s end as right from (select *, lower(sentence) s, instr(lower(sentence), lower(mention)) p from i)")

_ANSWERS = Input("orders", {"id": "o_orderkey", "text": "case o_orderkey % 8 when 0 then concat('assistant: It is ', o_orderstatus, ' now') when 1 then concat(chr(34), 'Quoted ', o_orderstatus, chr(34)) when 2 then concat('Here: done ', o_orderstatus) when 3 then 'no' when 4 then concat('first', chr(10), chr(10), 'second') when 5 then concat('I think: ', o_orderpriority) when 6 then concat('Paraphrase: ', o_orderpriority, chr(10), 'more') else o_orderpriority end"})
_row("completion_cleanup", _ANSWERS, lambda x: x.select("id", st.cleaned_completion(F.col("text")).alias("text")).filter("text is not null"), """, a as (select id, trim(case when text like 'assistant:%' then ltrim(substr(text, 11), ':' || chr(10) || ' ') when text like 'Paraphrase:%' then ltrim(substr(text, 12), ':' || chr(10) || ' ') when text like 'Here%' then ltrim(substr(text, 5), ':' || chr(10) || ' ') else text end) t from i),
b as (select id, trim(trim(string_split(t, chr(10) || chr(10))[1]), chr(34)) t from a), c as (select id, case when (lower(t) like 'i %' or lower(t) like 'as %') and contains(t, ':') then trim(substr(t, instr(t, ':') + 1)) else t end t from b) select id, t as text from c where length(t) >= 4""")
_row("completion_head", _ANSWERS, lambda x: x.select("id", st.completion_head(F.col("text")).alias("head")), "select id, substr(string_split(text, chr(10))[1], 1, 200) head from i")

# ------------------------------------------------------------------ predicates

_CANDIDATES = Input("orders", {"id": "o_orderkey", "system": "concat('s', cast(o_custkey % 3 as string))", "rule": "o_orderpriority", "output": "case o_orderkey % 6 when 0 then null when 1 then '[rule_did_not_fire]' when 2 then '[parse_failed] x' else concat('out ', o_orderstatus) end", "status": "case o_orderkey % 5 when 0 then 'ok' when 1 then 'ok_retry' when 2 then '' when 3 then null when 4 then case o_orderkey % 2 when 0 then 'rule_did_not_fire:x' else 'self_check_failed' end end", "gold": "case when o_orderkey % 4 > 0 then concat('out ', substr(o_orderstatus, 1, 1)) end", "judge": "case o_orderkey % 3 when 0 then 'EQUIVALENT' when 1 then 'NOT_EQUIVALENT' end"})
_REAL = "(output is not null and not (starts_with(output, '[rule_did_not_fire') or starts_with(output, '[rule_not_implemented') or starts_with(output, '[parse_failed') or starts_with(output, '[generation_failed')) and coalesce(status, 'ok') in ('ok', ''))"
_STATUS = "case when starts_with(coalesce(status, 'ok'), 'rule_did_not_fire') or starts_with(coalesce(status, 'ok'), 'rule_not_implemented') then 'rule_did_not_fire' when starts_with(coalesce(status, 'ok'), 'self_check_failed') then 'self_check_failed' when coalesce(status, 'ok') in ('ok', 'ok_retry') then 'ok' else 'other' end"
_row("real_outputs", _CANDIDATES, lambda x: x.filter(st.is_real_output(F.col("output"), F.col("status"))).select("id", "output"), f"select id, output from i where {_REAL}")
_row("status_histogram", _CANDIDATES, lambda x: x.groupBy(st.status_category(F.col("status")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"), f"select {_STATUS} category, count(*) n from i group by 1 order by n desc, category")
_row("self_check_table", _CANDIDATES, lambda x: x.groupBy(st.status_category(F.col("status")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("judge") == "EQUIVALENT").alias("eq"), F.count_if(F.col("judge") == "NOT_EQUIVALENT").alias("neq"), F.count_if(F.col("judge").isNull()).alias("pending")).withColumn("percent", st.percent(F.col("eq"), F.col("n"))), f"select {_STATUS} category, count(*) n, count(*) filter (judge = 'EQUIVALENT') eq, count(*) filter (judge = 'NOT_EQUIVALENT') neq, count(*) filter (judge is null) pending, (count(*) filter (judge = 'EQUIVALENT') * 100 // count(*))::bigint as percent from i group by 1")
_row("rule_breakdown", _CANDIDATES, lambda x: ev.rule_breakdown(x, "rule", "gold", "output", "judge"), "select rule, count(*) total, count(*) filter (gold is null) no_gold, count(*) filter (gold = output) exact, count(*) filter (judge = 'EQUIVALENT') judged_eq, count(*) filter (judge = 'NOT_EQUIVALENT') judged_neq from i group by rule")
_row("non_blank_rows", _CANDIDATES, lambda x: x.dropna(subset=["output", "gold", "status"]).filter("trim(status) <> ''").select("id"), "select id from i where output is not null and gold is not null and status is not null and trim(status) <> ''")
_row("value_in_set", _CANDIDATES, lambda x: x.filter(F.col("rule").isin("1-URGENT", "5-LOW")).select("id", "rule"), "select id, rule from i where rule in ('1-URGENT', '5-LOW')")
_row("non_collision", _CANDIDATES, lambda x: x.filter((F.col("output") != "") & (F.col("gold") != "") & (F.lower(F.trim("output")) != F.lower(F.trim("gold")))).select("id"), "select id from i where output <> '' and gold <> '' and lower(trim(output)) <> lower(trim(gold))")
_TUPLES = Input("part", {"id": "p_partkey", "tuple": "case p_size % 5 when 0 then concat('(', p_brand, '; ', p_type, ')') when 1 then concat(p_brand, '; ; x') when 2 then concat('(', p_size, 'x; ', p_type, ')') when 3 then concat(p_brand, '; L:here') else p_name end"})
_row("clean_tuples", _TUPLES, lambda x: x.filter(st.is_clean_tuple(F.col("tuple"))).select("id"), ", p as (select id, list_transform(string_split(regexp_replace(tuple, '[()]', '', 'g'), ';'), lambda x: trim(x)) a from i) select id from p where len(list_filter(a, lambda x: x = '' or regexp_matches(x, '^[0-9]') or contains(x, 'L:') or contains(x, 'T:'))) = 0")
_row("length_agreement", Input("part", {"id": "p_partkey", "a": "p_name", "b": "case when p_size % 2 = 0 then concat(p_type, ' x') else p_type end"}), lambda x: x.filter(F.size(st.words(F.col("a"))) == F.size(st.words(F.col("b")))).select("id"), "select id from i where len(list_filter(string_split(a, ' '), lambda x: x <> '')) = len(list_filter(string_split(b, ' '), lambda x: x <> ''))")
_row("degenerate_graphs", Input("part", {"id": "p_partkey", "graph": "case p_size % 4 when 0 then '(d / dummy)' when 1 then concat('(a / ', p_brand, '~e.1)') else concat('(a / ', p_brand, ')') end"}), lambda x: x.filter(~F.col("graph").isin("(d / dummy)", "(a / amr-empty)", "()") & ~F.col("graph").contains("~")), "select * from i where graph not in ('(d / dummy)', '(a / amr-empty)', '()') and not contains(graph, '~')")
_row("frequent_labels", Input("customer", {"id": "c_custkey", "label": "case when c_custkey % 50 = 0 then concat('rare', cast(c_custkey as string)) else c_mktsegment end"}), lambda x: sel.frequent_labels(x, "label"), "select id, label from i qualify count(*) over (partition by label) >= 2")
_PRED = Input("documents", {"id": "doc_id", "gold": "doc_id % 3", "pred": "case when doc_id % 7 = 0 then (doc_id + 1) % 3 else doc_id % 3 end"})
_row("mislabelled", _PRED, lambda x: x.filter("gold <> pred"), "select * from i where gold <> pred")

# ------------------------------------------------------------------ joins

_LEFT = Input("lineitem", {"k": "l_orderkey", "n": "l_linenumber", "q": "l_quantity"})
_RIGHT = Input("lineitem", {"k": "l_orderkey", "n": "l_linenumber % 3", "s": "l_suppkey"})


@_q("two_key_left_join", f"with {_LEFT.cte('a')}, {_RIGHT.cte('b')} select a.k, a.n, q, coalesce(s, -1) s from a left join b on a.k = b.k and a.n = b.n")
def _two_keys(s, d):
    return _LEFT.df(s, d).join(_RIGHT.df(s, d), ["k", "n"], "left").select("k", "n", "q", F.coalesce("s", F.lit(-1).cast("long")).alias("s"))


_VERDICT = Input("events", {"id": "user_id", "pos": "event_id", "majority": "case when event_id % 2 = 0 then 'EQUIVALENT' else 'NOT_EQUIVALENT' end", "q": "value", "needs_review": "value > 40"})


def _judged(s, d, group):
    return ev.judged_coverage(_CANDIDATES.df(s, d), sel.last_by(_VERDICT.df(s, d), ["id"], "pos"), ["id"], group, st.is_real_output(F.col("output"), F.col("status")))


_JUDGED = f"""with {_CANDIDATES.cte('i')}, {_VERDICT.cte('v')}, u as (select id, arg_max(majority, pos) majority, arg_max(needs_review, pos) needs_review from v group by id),
j as (select i.*, majority, needs_review, {_REAL} o from i left join u using (id))"""
_MEASURES = """count(*) n_total, count(*) filter (o) with_output, count(*) filter (o and not coalesce(needs_review, false) and majority = 'EQUIVALENT') eq, count(*) filter (o and not coalesce(needs_review, false) and majority = 'NOT_EQUIVALENT') neq, count(*) filter (o and needs_review) pending,
count(*) filter (o and majority is null) no_judgment"""
_RATES = "round(with_output::double / n_total, 8) coverage, round(coalesce(eq::double / nullif(eq + neq, 0), 0), 8) quality, round(eq::double / n_total, 8) overall"
_q("verdict_lookup_last_wins", f"{_JUDGED} select id, coalesce(majority, '-') majority from j")(lambda s, d: _CANDIDATES.df(s, d).join(sel.last_by(_VERDICT.df(s, d), ["id"], "pos"), "id", "left").select("id", F.coalesce("majority", F.lit("-")).alias("majority")))
_q("coverage_with_no_judgment", f"{_JUDGED}, c as (select system, {_MEASURES} from j group by system) select *, {_RATES} from c")(lambda s, d: _judged(s, d, ["system"]))


@_q("rule_system_pivot", f"{_JUDGED}, c as (select system, rule, {_MEASURES} from j group by system, rule), r as (select *, {_RATES} from c) select rule, " + ", ".join(f"coalesce(format('{{:.1f}}%', max(round(quality * 100, 1)) filter (system = 's{k}')), '-') s{k}" for k in range(3)) + " from r group by rule")
def _pivot(s, d):
    cells = _judged(s, d, ["system", "rule"]).select("system", "rule", st.percent_text(F.col("quality")).alias("cell"))
    return cells.groupBy("rule").pivot("system", ["s0", "s1", "s2"]).agg(F.first("cell")).na.fill("-")


@_q("run_trajectory", f"with {_CANDIDATES.cte('i')}, {_VERDICT.cte('v')}, t as (select unnest([20, 30, 40]) run), u as (select run, id, arg_max(majority, pos) majority, arg_max(q, pos) q from v, t group by run, id),\nj as (select t.run, i.*, majority, q > t.run needs_review, {_REAL} o from i cross join t left join u on u.id = i.id and u.run = t.run), c as (select run, system, {_MEASURES} from j group by run, system), r as (select *, {_RATES} from c)\nselect run, " + ", ".join(f"coalesce(max(quality) filter (system = 's{k}'), 0) s{k}" for k in range(3)) + " from r group by run")
def _trajectory(s, d):
    runs = s.createDataFrame([(20,), (30,), (40,)], "run int")  # a row a run
    last = sel.last_by(_VERDICT.df(s, d).drop("needs_review"), ["id"], "pos").join(F.broadcast(runs)).withColumn("needs_review", F.col("q") > F.col("run"))
    rows = ev.judged_coverage(_CANDIDATES.df(s, d).join(F.broadcast(runs)), last, ["id", "run"], ["run", "system"], st.is_real_output(F.col("output"), F.col("status")))
    return rows.groupBy("run").pivot("system", ["s0", "s1", "s2"]).agg(F.first("quality")).na.fill(0.0)


@_q("cached_lookup", "select doc_id, lang, md5(lang) parsed from documents")
def _cache(s, d):
    return sel.cached_lookup(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "lang", lambda x: x.withColumn("parsed", F.md5("lang")))


_SILVER, _GOLD = Input("orders", {"sid": "o_custkey", "rule": "o_orderpriority", "amr": "concat('s', o_orderkey)"}), Input("orders", {"sid": "o_custkey", "rule": "o_orderpriority", "amr": "concat('g', cast(o_orderkey as string))"}, "o_orderkey % 3 = 0")
_q("gold_override", f"with {_SILVER.cte('s')}, {_GOLD.cte('g')}, u as (select sid, rule, max(amr) gold from g group by sid, rule) select sid, rule, coalesce(gold, amr) amr, case when gold is not null then 'gold' else 'silver' end origin from s left join u using (sid, rule)")(lambda s, d: sel.gold_or_silver(_SILVER.df(s, d), _GOLD.df(s, d), ["sid", "rule"], "amr"))
_row("first_hit", _CANDIDATES, lambda x: x.filter("judge = 'EQUIVALENT'").groupBy("system", "rule").agg(F.min_by("output", "id").alias("output"), F.min("id").alias("id")), "select system, rule, (list(output order by id))[1] output, min(id) id from i where judge = 'EQUIVALENT' group by system, rule")
_POS = Input("documents", {"pos": "doc_id", "gold": "doc_id % 2"})
_q("positional_join", f"with {_POS.cte('a')}, {_PRED.cte('b')} select pos, a.gold as label, pred from a join b on pos = id")(lambda s, d: _POS.df(s, d).withColumnRenamed("gold", "label").join(_PRED.df(s, d).select(F.col("id").alias("pos"), "pred"), "pos"))
_LINES = Input("events", {"doc": "user_id", "pos": "event_id", "event": "concat('e', event_id)", "value": "case when event_id % 3 = 1 then event_id end", "score": "value"})
_row("pairs_before", _LINES, lambda x: sel.pairs_before(x, ["doc"], "pos", "event", 4), ", r as (select *, row_number() over (partition by doc order by pos) n from i) select a.doc, a.event a, b.event b from r a join r b on a.doc = b.doc and a.n < b.n and b.n <= 4")
_row("adjacent_rows", _LINES, lambda x: sel.previous_and_next(x, ["doc"], "pos", "event").select("doc", "pos", "event", "following"), "select doc, pos, event, lead(event) over (partition by doc order by pos) as following from i qualify following is not null")
_row("latest_known", _LINES, lambda x: sel.latest_known(x, ["doc"], "pos", "value").select("doc", "pos", F.coalesce("latest", F.lit(-1).cast("long")).alias("latest")), "select doc, pos, coalesce(last_value(value ignore nulls) over (partition by doc order by pos rows between unbounded preceding and current row), -1) latest from i")
_row("best_so_far", _LINES, lambda x: sel.best_so_far(x, ["doc"], "pos", "score").select("doc", "pos", "best"), "select doc, pos, max(score) over (partition by doc order by pos rows between unbounded preceding and current row) best from i")
_row("first_three_events", _LINES, lambda x: x.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).filter("rn <= 3").select("doc", "pos", "event"), "select doc, pos, event from i qualify row_number() over (partition by doc order by pos) <= 3")
_row("sequential_names", Input("part", {"id": "p_partkey", "concept": "p_type"}), lambda x: sel.numbered(x, ["concept"], "id").select("id", "no", "name"), "select id, row_number() over w - 1 as no, case when count(*) over (partition by concept) = 1 then concept else concept || '_' || (row_number() over w - 1)::varchar end as name from i window w as (partition by concept order by id)")
_row("random_partner", Input("customer", {"id": "c_custkey"}), lambda x: sel.random_partner(x, "id", "p"), ", r as (select id, row_number() over (order by md5(concat_ws('|', 'p', id::varchar)), id) k, count(*) over () n from i) select a.id, b.id partner from r a join r b on b.k = a.k % a.n + 1")
_row("length_batches", Input("documents", {"id": "doc_id", "text": "coalesce(text, '')"}), lambda x: sel.by_length(x, "text", 32, "id").select("id", "batch"), "select id, (row_number() over (order by length(text) desc, id) - 1) // 32 as batch from i")

# ------------------------------------------------------------------ selections

_LABELS = Input("labels", {"id": "doc_id", "label": "cast(quality as string)"})
_row("split_stratified", _LABELS, lambda x: sel.stratified_split(x, "id", "label", "st", 0.8), "select *, case when row_number() over (partition by label order by md5(concat_ws('|', 'st', id::varchar)), id) <= floor(count(*) over (partition by label) * 0.8::double) then 'train' else 'validation' end split from i")
_row("seeded_sample", Input("documents", {"id": "doc_id"}), lambda x: sel.seeded_sample(x, "id", "sam", 100), "select id from i qualify row_number() over (order by md5(concat_ws('|', 'sam', id::varchar)), id) <= 100")
_row("up_weight", _LABELS, lambda x: sel.up_weighted(x, F.when(F.col("label") == "0", F.lit(10)).otherwise(F.lit(1))), "select id, label, c::int as copy from i, range(1, 11) r(c) where c <= case when label = '0' then 10 else 1 end")
_SAMPLES = Input("events", {"k": "user_id", "text": "concat('t', cast(event_id % 3 as string))", "passed": "value > 35", "pos": "event_id", "f1": "value"})
_row("first_passing_sample", _SAMPLES, lambda x: sel.first_passing(x, ["k"], "text", "passed", "pos"), ", o as (select k, text, bool_or(passed) passed, min(pos) pos from i group by k, text) select k, arg_min(text, (not passed)::bigint * 1000000000 + pos) as text, not bool_or(passed) flagged from o group by k")
_row("best_of_many", _SAMPLES, lambda x: sel.best_of(x, ["k"], "text", "f1", "pos"), "select k, text, f1 from i qualify row_number() over (partition by k order by f1 desc, pos) = 1")
_row("sorted_distinct", _ORDERS, lambda x: x.select("tag").distinct().orderBy("tag"), "select distinct tag from i order by tag")
_row("vocabulary_order", _ORDERS, lambda x: x.groupBy("origin").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin").limit(50), "select origin, count(*) n from i group by origin order by n desc, origin limit 50")
_CONF = Input("documents", {"gold": "case when doc_id % 11 > 0 then lang end", "pred": "case when doc_id % 5 = 0 then 'en' when doc_id % 7 > 0 then lang end"})
_row("confusions", _CONF, lambda x: ev.confusion(x, "gold", "pred"), "select case when gold is not null and pred is not null then 'confusion' when gold is not null then 'gold_only' else 'pred_only' end kind, case when gold is not null and pred is not null then gold || '->' || pred else coalesce(gold, pred) end as key, count(*) n from i where gold is distinct from pred group by 1, 2")
_row("top_confusions", _CONF, lambda x: ev.confusion(x, "gold", "pred").filter("kind = 'confusion'").orderBy(F.desc("n"), "key").limit(5).select("key", "n"), "select gold || '->' || pred as key, count(*) n from i where gold <> pred group by 1 order by n desc, key limit 5")

# ------------------------------------------------------------------ set operations

_A, _B = Input("lineitem", {"k": "l_orderkey"}, "l_linenumber = 1 and l_orderkey % 3 > 0"), Input("lineitem", {"k": "l_orderkey"}, "l_orderkey % 2 = 0")
for _name, _do, _word in (("set_union_all", lambda a, b: a.unionByName(b), "union all"), ("set_union_distinct", lambda a, b: a.unionByName(b).distinct(), "union"), ("set_intersect", lambda a, b: a.intersect(b), "intersect"), ("set_except", lambda a, b: b.subtract(a), "except")):
    _one, _two = ("b", "a") if _word == "except" else ("a", "b")
    _q(_name, f"with {_A.cte('a')}, {_B.cte('b')} select k from {_one} {_word} select k from {_two}")(lambda s, d, do=_do: do(_A.df(s, d), _B.df(s, d)))

# ------------------------------------------------------------------ evaluation

_row("accuracy_f1", _PRED, lambda x: ev.accuracy_f1(x, "gold", "pred"), ", l as (select distinct gold g from i), c as (select g, count(*) filter (gold = g and pred = g) tp, count(*) filter (gold <> g and pred = g) fp, count(*) filter (gold = g and pred <> g) fn from l, i group by g), m as (select round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 8) macro_f1 from c) select count(*) n, round(count(*) filter (gold = pred)::double / count(*), 8) accuracy, max(macro_f1) macro_f1 from i, m")
_row("simple_accuracy", _PRED, lambda x: x.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 8).alias("accuracy")), "select round(avg((gold = pred)::int::double), 8) accuracy from i")
_HYB = Input("documents", {"gold": "case when doc_id % 9 > 0 then lang end", "rule": "case when doc_id % 4 = 0 then lang end", "model": "case when doc_id % 3 > 0 then 'en' end"})
_row("hybrid_by_source", _HYB, lambda x: ev.hybrid(x, "gold", "rule", "model"), "select case when rule is not null then 'rule' when model is not null then 'model' else 'none' end source, count(*) n, count(*) filter (coalesce(rule, model) = gold) as right, round(count(*) filter (coalesce(rule, model) = gold)::double / count(*), 8) accuracy from i where gold is not null group by 1")
_ROOTS = Input("documents", {"gold": "doc_id % 3", "pred": "case when doc_id % 5 = 0 then doc_id % 3 else 1 end", "root": "doc_id % 2 = 0"})


@_q("roots_only_prf", f"with {_ROOTS.cte('i')}, p as (select gold, case when root then pred end pred from i), c as (select count(*) filter (gold = pred) tp, count(*) filter (pred is not null and gold <> pred) fp, count(*) filter (pred is null or gold <> pred) fn from p) select tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::double, 8) f1 from c")
def _roots(s, d):
    return precision_recall(_ROOTS.df(s, d).withColumn("pred", F.when(F.col("root"), F.col("pred"))), "gold", "pred").select("tp", "fp", "fn", "f1")


_GR = Input("lineitem", {"doc_id": "l_orderkey", "src": "concat('n', l_linenumber)", "rel": "case l_linenumber % 3 when 0 then ':before' when 1 then ':overlap' else ':contained' end", "tgt": "concat('n', l_partkey % 7)"})
_PR = Input("lineitem", {"doc_id": "l_orderkey", "src": "case when l_suppkey % 2 = 0 then concat('n', l_linenumber) else concat('n', l_partkey % 7) end", "rel": "case when l_suppkey % 2 = 0 then case l_linenumber % 3 when 0 then ':before' when 1 then ':overlap' else ':contained' end else case l_linenumber % 3 when 0 then ':after' when 1 then ':overlap' else ':contained' end end", "tgt": "case when l_suppkey % 2 = 0 then concat('n', l_partkey % 7) else concat('n', l_linenumber) end"}, "l_quantity > 10")
_INV = "case p.rel when ':before' then ':after' when ':after' then ':before' when ':overlap' then ':overlap' end"
_q("relation_scores", f"""with {_GR.cte('g')}, {_PR.cte('p')}, u as (select distinct * from g),
m as (select p.*, {_INV} inv, exists (select 1 from u where u.doc_id = p.doc_id and u.src = p.src and u.rel = p.rel and u.tgt = p.tgt) a, exists (select 1 from u where u.doc_id = p.doc_id and u.src = p.tgt and u.rel = {_INV} and u.tgt = p.src) b from p),
n as (select doc_id, src, rel, tgt from m where a union select doc_id, tgt, inv, src from m where not a and b)
select count(*) filter (a or b) tp, count(*) filter (not a and not b) fp, (select count(*) from g anti join n using (doc_id, src, rel, tgt)) fn from m""")(lambda s, d: ev.relation_scores(_GR.df(s, d), _PR.df(s, d)))
_ALIGN = Input("part", {"gold": "split(p_name, ' ')" , "pred": "split(concat(p_name, ' ', p_brand), ' ')"})
_q("alignment_macro_prf", "with i as (select string_split(p_name, ' ') gold, string_split(p_name || ' ' || p_brand, ' ') pred from part), c as (select avg(len(list_intersect(gold, pred))::double / len(pred)) p, avg(len(list_intersect(gold, pred))::double / len(gold)) r from i) select round(p, 8) as precision, round(r, 8) recall, round(2 * p * r / (p + r), 8) f1 from c")(lambda s, d: ev.macro_alignment(_ALIGN.df(s, d), "gold", "pred"))


# ------------------------------------------------------------------ scores

_NUM = Input("lineitem", {"id": "l_orderkey", "line": "l_linenumber", "f": "cast(l_discount as double) * 10", "a": "cast(l_quantity as double)", "b": "cast(l_tax as double) * 100", "c": "cast(l_linenumber as double)", "miss": "l_linenumber % 2 = 0"})
_row("verdict_confidence", _NUM, lambda x: x.select("id", "line", F.round(scores.confidence(F.col("f"), 0.6), 8).alias("confidence"), scores.smatch_band(F.col("f")).alias("b")).select("id", "line", "confidence", F.col("b.label").alias("label"), F.round("b.confidence", 8).alias("band")), "select id, line, round(least(1.0::double, 0.5 + 2 * abs(f - 0.6::double)), 8) confidence, case when f >= 0.7::double then 'EQUIVALENT' when f <= 0.45::double then 'NOT_EQUIVALENT' else 'UNKNOWN' end as label, round(case when f >= 0.7::double then f when f <= 0.45::double then 1 - f else 0.3::double end, 8) band from i")
_row("argmax_classes", _NUM, lambda x: x.select("id", "line", scores.argmax(F.array("a", "b", "c")).alias("cls"), F.coalesce(scores.sure_class(F.array("a", "b", "c"), 0.9), F.lit(-1)).alias("sure")), ", p as (select id, line, [a, b, c] v, greatest(a, b, c) t from i) select id, line, list_position(v, t) - 1 cls, case when 1 / (exp(v[1] - t) + exp(v[2] - t) + exp(v[3] - t)) >= 0.9::double then list_position(v, t) - 1 else -1 end sure from p")
_row("verifier_reward", _NUM, lambda x: x.select("id", "line", F.round(scores.reward(F.col("f"), F.when(~F.col("miss"), F.col("b") / 10), F.when(F.col("miss"), F.lit(1.0)), F.col("line") == 1, F.col("line") == 3), 8).alias("reward")), "select id, line, round(case when line = 3 then 0 else f * 0.5::double end + case when miss then 0 else b / 10 * 0.3::double end + case when miss then 0.2::double else 0 end + case when line = 1 then 0.1::double else 0 end, 8) reward from i")

# ------------------------------------------------------------------ strings

_TEXT = Input("part", {"id": "p_partkey", "t": "concat(p_name, ', ', p_type, '!')", "c": "concat(lower(substr(p_type, 1, 4)), '-', case when p_size < 10 then '01' else cast(p_size as string) end)", "u": "concat('(a / ', lower(substr(p_type, 1, 3)), '-02~e.', p_size, ' :ARG0-of (b / x-17~e.1,2) :op1 c)')", "tagged": "concat(p_name, '~NN x~VB$')", "stem": "concat(':role ++keep++ ', lower(p_type))", "num": "concat(p_size, ' ', p_partkey, ' 7 8 9')", "dash": "concat(p_size, '-', p_partkey, ' 1-2')"})
_row("string_forms", _TEXT, lambda x: x.select("id", st.without_punctuation(F.col("t")).alias("plain"), st.without_sense(F.col("c")).alias("sense"), F.coalesce(st.frame(F.col("c"))["lemma"], F.lit("-")).alias("lemma"), st.is_event_frame(F.col("c")).alias("event"), st.without_alignments(F.col("u")).alias("bare"), st.without_tags(F.col("tagged")).alias("untagged")),
     "select id, regexp_replace(t, '[!-/:-@\\[-`{-~]', '', 'g') plain, regexp_replace(c, '-[0-9]+$', '') sense, case when regexp_matches(c, '^.+?-[0-9]+$') then regexp_extract(c, '^(.+?)-([0-9]+)$', 1) else '-' end lemma, regexp_matches(c, '^[a-z][a-z0-9_-]*-[0-9]{2,3}$') as event, regexp_replace(u, '~e\\.[0-9]+(,[0-9]+)*', '', 'g') bare, regexp_replace(tagged, '~[A-Z$]+', '', 'g') untagged from i")
_row("graph_text_forms", _TEXT, lambda x: x.select("id", st.first_sense(st.without_alignments(F.col("u"))).alias("wsd"), st.unlabelled(st.without_alignments(F.col("u"))).alias("roles")), ", b as (select id, regexp_replace(u, '~e\\.[0-9]+(,[0-9]+)*', '', 'g') u from i) select id, regexp_replace(u, '(/ [a-zA-Z0-9-]+)-[0-9]+', '\\1-01', 'g') wsd, replace(regexp_replace(regexp_replace(u, ':[0-9a-zA-Z]*-of', chr(1), 'g'), ':[0-9a-zA-Z]+', ':label', 'g'), chr(1), ':label-of') roles from b")
_row("aligner_lines", _TEXT, lambda x: x.select("id", st.stemmed_line(F.col("stem")).alias("stems"), st.with_positions(F.col("num")).alias("numbered"), st.joined_pairs(F.col("num")).alias("pairs"), st.swapped_pairs(F.col("dash")).alias("swapped")),
     ", w as (select id, list_filter(string_split(stem, ' '), lambda x: x <> '') a, string_split(num, ' ') b, string_split(dash, ' ') c from i) select id, array_to_string(list_transform(a, lambda x: case when starts_with(x, ':') or starts_with(x, '++') and ends_with(x, '++') then x else substr(x, 1, 3) end), ' ') stems, array_to_string(list_transform(b, lambda x, k: x || '_' || (k - 1)::varchar), ' ') numbered, array_to_string(list_transform(range(1, len(b), 2), lambda k: b[k] || '-' || b[k + 1]), ' ') pairs, array_to_string(list_transform(c, lambda x: string_split(x, '-')[2] || '-' || string_split(x, '-')[1]), ' ') swapped from w")
_row("stop_words", _TEXT, lambda x: x.select("id", st.kept_words(F.lower("t"), ["the", "red", "a"]).alias("k")).select("id", F.array_join(F.transform("k", lambda y: y["word"]), " ").alias("words"), F.array_join(F.transform("k", lambda y: y["pos"].cast("string")), " ").alias("places"), F.array_join(F.transform(st.remapped(F.array(F.lit(0)), F.col("k")), lambda p: p.cast("string")), " ").alias("first")),
     ", w as (select id, list_filter(string_split(lower(t), ' '), lambda x: x <> '') a from i), k as (select id, list_filter(range(1, len(a) + 1), lambda j: a[j] not in ('the', 'red', 'a')) p, a from w) select id, array_to_string(list_transform(p, lambda j: a[j]), ' ') words, array_to_string(list_transform(p, lambda j: (j - 1)::varchar), ' ') places, coalesce((p[1] - 1)::varchar, '') as first from k")
_row("prefix_and_keywords", _TEXT, lambda x: x.select("id", st.common_prefix(F.col("c"), F.lower(F.substring("t", 1, 6))).alias("shared"), st.keyword_place(tokenize(F.col("t")), "steel").alias("one"), st.keyword_place(tokenize(F.col("t")), "plated steel").alias("two")),
     ", w as (select id, c, lower(substr(t, 1, 6)) b, list_filter(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') a from i) select id, list_max(list_filter(range(0, least(length(c), length(b)) + 1), lambda k: substr(c, 1, k) = substr(b, 1, k))) shared, coalesce(list_position(a, 'steel'), 0) - 1 as one, case when instr(array_to_string(a, ' '), 'plated steel') = 0 then -1 else len(list_filter(string_split(substr(array_to_string(a, ' '), 1, instr(array_to_string(a, ' '), 'plated steel') - 1), ' '), lambda x: x <> '')) end as two from w")
_WORDS = Input("part", {"id": "p_partkey", "w": "case p_size % 6 when 0 then 'March' when 1 then 'seven' when 2 then 'unhappy' when 3 then 'dec' when 4 then 'Inept' else p_brand end", "r": "case p_size % 4 when 0 then ':fullaff' when 1 then 'partialneg' when 2 then ':before' else 'full_affirmative' end", "s": "concat(p_name, ' . ', p_type)"})
_row("match_candidates", _WORDS, lambda x: x.select("id", F.array_join(st.candidates(F.col("w")), "|").alias("candidates"), st.relation_name(F.col("r")).alias("relation"), st.summary_lines(F.col("s")).alias("lines")),
     "select id, lower(w) || case lower(w) when 'march' then '|3' when 'seven' then '|7' when 'dec' then '|12' else '' end || case when lower(substr(w, 1, 2)) in ('in', 'un', 'ir') then '|' || lower(substr(w, 3)) else '' end candidates, case when ltrim(r, ':') in ('full-affirmative', 'fullaff', 'full_affirmative') then ':full-affirmative' when ltrim(r, ':') in ('partial-negative', 'partialneg') then ':partial-negative' else ':' || ltrim(r, ':') end relation, replace(s, ' . ', ' .' || chr(10)) as lines from i")
_row("json_reason", Input("events", {"id": "event_id", "props": "props"}), lambda x: x.select("id", F.coalesce(F.get_json_object("props", "$.reason"), F.lit("")).alias("reason"), F.md5(F.substring("props", 1, 8)).alias("chunk")), "select id, coalesce(json_extract_string(props, '$.reason'), '') reason, md5(substr(props, 1, 8)) chunk from i")
_row("formatted_time", Input("events", {"id": "event_id", "ts": "ts"}), lambda x: x.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")), "select id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from i")

# ------------------------------------------------------------------ symbolic baseline

_LIT = Input("part", {"id": "p_partkey", "a": "p_brand", "an": "p_size % 2 = 0", "b": "p_type", "bn": "p_size % 3 = 0", "ctx": "concat('Red is here. ', p_brand, ' is ', p_type, '. End.')", "old": "case p_size % 3 when 0 then concat(p_brand, ' is ', p_type, '.') when 1 then concat(p_brand, ' is ', p_type, '. now') else 'nothing alike' end", "new": "concat('not ', p_brand, '.')"})
_row("verbalized_implications", _LIT, lambda x: x.select("id", st.verbalized(F.col("a"), F.col("an"), F.col("b"), F.col("bn")).alias("sentence")), "select id, 'If it is ' || case when an then 'not ' else '' end || a || ', then it will be ' || case when bn then 'not ' else '' end || b || '.' sentence from i")
_row("spliced_contexts", _LIT, lambda x: x.select("id", F.coalesce(st.spliced(F.col("ctx"), F.col("old"), F.col("new")), F.lit(" ")).alias("context")), """, p as (select *, string_split(regexp_replace(ctx, '([.!?])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1)) ps, list_distinct(string_split(lower(old), ' ')) os from i),
q as (select *, list_filter(ps, lambda x: len(list_intersect(list_distinct(string_split(lower(x), ' ')), os)) > len(os) * 0.8::double)[1] hit from p)
select id, case when contains(ctx, old) then replace(ctx, old, new) when hit is not null then array_to_string(list_transform(ps, lambda x: case when x = hit then new else x end), ' ') else ' ' end context from q""")

_CHAIN = Input("part", {"id": "p_partkey", "phrases": "split(concat(p_name, ' ', p_brand), ' ')", "other": "split(concat(p_brand, ' ', p_type), ' ')"})
_q("spread_phrases", "with i as (select p_partkey id, string_split(p_name || ' ' || p_brand, ' ') phrases from part) select id, phrases[k] a, phrases[k + 1] b from i, unnest(range(1, len(phrases))) r(k)")(lambda s, d: _CHAIN.df(s, d).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("phrases") - 2), lambda k: F.struct(F.get("phrases", k).alias("a"), F.get("phrases", k + 1).alias("b")))).alias("p")).select("id", "p.a", "p.b"))
_q("overlap_rates", "with i as (select p_partkey id, string_split(p_name || ' ' || p_brand, ' ') a, string_split(p_brand || ' ' || p_type, ' ') b from part) select id, round(len(list_intersect(list_distinct(a), list_distinct(b)))::double / len(list_distinct(a)), 8) rate, len(list_intersect(list_distinct(a), list_distinct(b)))::double / len(list_distinct(a)) > 0.2::double as alike from i")(lambda s, d: _CHAIN.df(s, d).select("id", (F.size(F.array_intersect("phrases", "other")) / F.size(F.array_distinct("phrases"))).alias("r")).select("id", F.round("r", 8).alias("rate"), (F.col("r") > 0.2).alias("alike")))
_U = "(('0x' || substr(md5(concat_ws('|', 'op', id::varchar)), 1, 13))::bigint::double / 4503599627370496::double)"
_row("negative_operations", Input("part", {"id": "p_partkey"}), lambda x: x.withColumn("u", F.conv(F.substring(sel.seeded("op", "id"), 1, 13), 16, 10).cast("double") / float(2**52)).select("id", F.when(F.col("u") > 0.75, "delete").when(F.col("u") > 0.35, "reverse").when(F.col("u") > 0.175, "negate_left").otherwise("negate_right").alias("op")), f"select id, case when {_U} > 0.75::double then 'delete' when {_U} > 0.35::double then 'reverse' when {_U} > 0.175::double then 'negate_left' else 'negate_right' end op from i")
_row("component_tags", Input("lineitem", {"doc": "l_orderkey", "name": "concat('n', l_partkey % 5)", "pos": "l_linenumber"}), lambda x: x.groupBy("doc", "name").agg(F.min("pos").alias("first")).withColumn("tag", F.dense_rank().over(Window.partitionBy("doc").orderBy("first", "name")) - 1).select("doc", "name", "tag"), ", f as (select doc, name, min(pos) first from i group by doc, name) select doc, name, dense_rank() over (partition by doc order by first, name) - 1 tag from f")

# ------------------------------------------------------------------ documents and tables

_NAMES = Input("events", {"doc": "user_id % 20", "pos": "event_id", "name": "event_type", "map_value": "event_type"})
_row("name_chains", _NAMES, lambda x: x.groupBy("doc", "name").agg(F.array_sort(F.collect_list("pos")).alias("nodes")).select("doc", "name", F.explode(F.when(F.size("nodes") > 1, F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("a"), F.slice("nodes", F.lit(2), F.size("nodes")).alias("b")))).alias("p")).select("doc", "name", "p.a", "p.b"), "select doc, name, pos a, lead(pos) over (partition by doc, name order by pos) b from i qualify b is not null")
_row("doc_groups", _NAMES, lambda x: x.groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names")), "select doc, count(*) n, count(distinct name) n_names, array_to_string(list_sort(list_distinct(list(name))), ',') names from i group by doc")
_row("label_statistics", Input("events", {"id": "event_id", "kind": "event_type"}), lambda x: ev.label_statistics(x.withColumn("m", F.create_map(F.lit("aspect"), F.col("kind"))), ["id"], "m"), "select kind as value, count(*) n from i group by kind")
_row("mean_length_by_label", Input("documents", {"label": "doc_id % 2", "text": "text"}), lambda x: x.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size(tokenize(F.col("text")))), 8).alias("mean_tokens")), "select label, count(*) n, round(avg(len(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\\[-`{-~]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> ''))), 8) mean_tokens from i group by label")
_row("transposed_table", Input("lineitem", {"a": "l_orderkey", "b": "l_linenumber", "p": "l_discount / 1e7"}), lambda x: x.filter("p > 1e-9").select(F.col("b").alias("a"), F.col("a").alias("b"), "p"), "select b as a, a as b, p from i where p > 1e-9::double")
_ENTITY, _KNOWN = Input("customer", {"id": "c_custkey", "name": "c_mktsegment"}), Input("region", {"name": "upper(case r_regionkey when 0 then 'BUILDING' when 1 then 'MACHINERY' else r_name end)", "link": "concat('Q', cast(r_regionkey as string))"})
_q("added_links", f"with {_ENTITY.cte('e')}, {_KNOWN.cte('k')} select id, coalesce(link, '-') link from e left join k using (name)")(lambda s, d: _ENTITY.df(s, d).join(F.broadcast(_KNOWN.df(s, d)), "name", "left").select("id", F.coalesce("link", F.lit("-")).alias("link")))  # the entity table is a dimension of a region's size

# ------------------------------------------------------------------ generated text

_TURNS = """with p as (select a.conv_id id, a.turn, {x} x, {y} y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"""
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '')"


def _turns(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/conversations.parquet")
    user = c.filter("role = 'user'").select(F.col("conv_id").alias("id"), "turn", tokenize(F.col("text")).alias("x"))
    return user.join(c.filter("role = 'assistant'").select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("turn"), tokenize(F.col("text")).alias("y")), ["id", "turn"])


_TP = _TURNS.format(x=_TOKENS.format("a.text"), y=_TOKENS.format("b.text"))
_ORDERS_OF = " union all ".join(f"select id, turn, {n} n, s, g, count(*) c from (select id, turn, 'x' s, array_to_string(x[i:i + {n - 1}], ' ') g from p, unnest(range(1, len(x) - {n - 2})) r(i) union all select id, turn, 'y', array_to_string(y[i:i + {n - 1}], ' ') from p, unnest(range(1, len(y) - {n - 2})) r(i)) group by all" for n in range(1, 5))
_COUNTS = f"{_TP}, g as ({_ORDERS_OF}), m as (select a.id, a.turn, a.n, sum(a.c) total, sum(least(a.c, coalesce(b.c, 0))) hit, from (select * from g where s = 'x') a left join (select * from g where s = 'y') b on a.id = b.id and a.turn = b.turn and a.n = b.n and a.g = b.g group by a.id, a.turn, a.n)"


@_q("corpus_bleu", f"{_COUNTS}, t as (select n, sum(hit) hit, sum(total) total from m group by n), l as (select sum(len(x)) c, sum(len(y)) r from p) select round(100 * exp(sum(ln(hit::double / total)) / 4) * case when max(c) < max(r) then exp(1 - max(r)::double / max(c)) else 1 end, 6) bleu from t, l")
def _corpus_bleu(s, d):
    counts = _turns(s, d).select(F.size("x").alias("c"), F.size("y").alias("r"), *(scores.clipped(F.col("x"), F.col("y"), n).alias(f"k{n}") for n in range(1, 5)))
    sums = counts.agg(F.sum("c").alias("c"), F.sum("r").alias("r"), *(F.sum(f"k{n}.{f}").alias(f"{f}{n}") for n in range(1, 5) for f in ("matched", "total")))
    mean = sum((F.log(F.col(f"matched{n}") / F.col(f"total{n}")) for n in range(1, 5)), F.lit(0.0)) / 4
    return sums.select(F.round(100 * F.exp(mean) * F.when(F.col("c") < F.col("r"), F.exp(1 - F.col("r") / F.col("c"))).otherwise(1.0), 6).alias("bleu"))


_q("rouge_scores", f"{_COUNTS}, h as (select id, turn, n, hit, total, greatest(len(y) - n + 1, 0) ref from m join p using (id, turn) where n <= 2), f as (select id, turn, n, case when hit = 0 then 0 else 2 * (hit::double / total) * (hit::double / ref) / (hit::double / total + hit::double / ref) end v from h)\nselect round(avg(coalesce(a.v, 0)) * 100, 6) rouge1, round(avg(coalesce(b.v, 0)) * 100, 6) rouge2 from p left join f a on a.id = p.id and a.turn = p.turn and a.n = 1 left join f b on b.id = p.id and b.turn = p.turn and b.n = 2")(lambda s, d: _turns(s, d).agg(F.round(F.avg(scores.rouge_n(F.col("y"), F.col("x"), 1)) * 100, 6).alias("rouge1"), F.round(F.avg(scores.rouge_n(F.col("y"), F.col("x"), 2)) * 100, 6).alias("rouge2")))
_READ = Input("conversations", {"id": "conv_id", "turn": "turn", "text": "coalesce(text, '')"})
_row("readability", _READ, lambda x: x.select("id", "turn", scores.reading_ease(F.regexp_count("text", F.lit("[A-Za-z]+")), F.regexp_count("text", F.lit("[.!?]+")), F.regexp_count("text", F.lit("[A-Za-z]")), F.regexp_count("text", F.lit("[aeiouyAEIOUY]+"))).alias("r")).select("id", "turn", "r.flesch", "r.flesch_kincaid", "r.coleman_liau", "r.ari"),
     ", c as (select id, turn, len(regexp_extract_all(text, '[A-Za-z]+'))::double w, len(regexp_extract_all(text, '[.!?]+'))::double s, len(regexp_extract_all(text, '[A-Za-z]'))::double l, len(regexp_extract_all(text, '[aeiouyAEIOUY]+'))::double y from i) select id, turn, case when w > 0 and s > 0 then round(206.835::double - 1.015::double * (w / s) - 84.6::double * (y / w), 2) else 0 end flesch, case when w > 0 and s > 0 then round(0.39::double * (w / s) + 11.8::double * (y / w) - 15.59::double, 2) else 0 end flesch_kincaid, case when w > 0 and s > 0 then round(5.88::double * (l / w) - 29.6::double * (s / w) - 15.8::double, 2) else 0 end coleman_liau, case when w > 0 and s > 0 then round(4.71::double * (l / w) + 0.5::double * (w / s) - 21.43::double, 2) else 0 end ari from c")
@_q("graph_subscores")
def _subscores(s, d):
    from .rule_queries import varied

    gold = varied(s, d)
    pred = gold.withColumn("target", F.when((F.col("role") == ":instance") & (F.col("target") == "dog"), "cat").otherwise(F.col("target"))).filter("role <> ':polarity' or source <> 'x'")
    return ev.subscores(gold, pred)


def _subscores_sql() -> str:
    from .rule_queries import W

    side = """{0}c as (select graph_id, source node, target concept from {0} where role = ':instance'), {0}s as (
  select distinct graph_id, 'concepts' score, concept item from {0}c union select distinct graph_id, 'frames', concept from {0}c where regexp_matches(concept, '^.+-[0-9]+$') union select distinct graph_id, 'non_sense_frames', regexp_replace(concept, '-[0-9]+$', '') from {0}c where regexp_matches(concept, '^.+-[0-9]+$')
  union select distinct e.graph_id, 'negations', concept || ' ' || target from {0} e join {0}c c on c.graph_id = e.graph_id and c.node = e.source where role = ':polarity'
  union select distinct e.graph_id, 'ignore_vars', concat_ws(' ', coalesce(a.concept, source), role, coalesce(b.concept, target)) from {0} e left join {0}c a on a.graph_id = e.graph_id and a.node = source left join {0}c b on b.graph_id = e.graph_id and b.node = target where role <> ':instance')"""
    return f"""with {W}, q as (select graph_id, pos, source, role, case when role = ':instance' and target = 'dog' then 'cat' else target end target from w where role <> ':polarity' or source <> 'x'),
{side.format('w')}, {side.format('q')}, j as (select coalesce(a.score, b.score) score, a.item g, b.item p from ws a full join qs b on a.graph_id = b.graph_id and a.score = b.score and a.item = b.item)
select score, count(*) filter (g is not null and p is not null) matched, count(p) n_pred, count(g) n_gold, round(coalesce(2.0 * count(*) filter (g is not null and p is not null) / nullif(count(p) + count(g), 0), 0)::double, 8) f1 from j group by score"""


SQL["graph_subscores"] = _subscores_sql()
