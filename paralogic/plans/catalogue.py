"""Registered queries over the driver's tables and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine, normalize
from ..functions import penman
from ..operators import attributes, corpus, dispatch, graphs, rules
from ..operators import verdicts as v
from . import extended, rule_queries


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ inputs


def verdict_rows(spark: SparkSession, d: str, limit: float = 150_000.0) -> DataFrame:
    """Three verifiers' verdicts on orders, in long form."""
    orders, customer = _read(spark, d, "orders"), _read(spark, d, "customer")
    price = F.when(F.col("o_totalprice") > limit, v.EQ).otherwise(v.NEQ)
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), v.EQ).when(F.col("o_orderpriority") == "3-MEDIUM", v.UNKNOWN).otherwise(v.NEQ)
    status = F.when(F.col("o_orderstatus") == "F", v.EQ).when(F.col("o_orderstatus") == "O", v.NEQ).otherwise(v.UNKNOWN)
    one = lambda k, name, label, sure: F.struct(F.lit(k).alias("pos"), F.lit(name).alias("verifier"), label.alias("label"), F.lit(sure).alias("confidence"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", F.col("c_mktsegment").alias("system"), F.col("o_orderpriority").alias("rule"), F.explode(F.array(one(0, "price", price, 0.9), one(1, "urgent", urgent, 0.6), one(2, "status", status, 0.8))).alias("x"))
    return rows.select(F.col("o_orderkey").alias("item_id"), "system", "rule", "x.*")


_VERDICTS = """
v as (
  select o_orderkey item_id, c_mktsegment system, o_orderpriority rule, pos, verifier, label, confidence from orders join customer on o_custkey = c_custkey,
  lateral (values
    (0, 'price', case when o_totalprice > {limit} then 'EQUIVALENT' else 'NOT_EQUIVALENT' end, 0.9::double),
    (1, 'urgent', case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'EQUIVALENT' when o_orderpriority = '3-MEDIUM' then 'UNKNOWN' else 'NOT_EQUIVALENT' end, 0.6::double),
    (2, 'status', case when o_orderstatus = 'F' then 'EQUIVALENT' when o_orderstatus = 'O' then 'NOT_EQUIVALENT' else 'UNKNOWN' end, 0.8::double)) x(pos, verifier, label, confidence))"""
_ITEMS = """
a as (
  select item_id, system, rule, count(*) n, count(*) filter (label = 'EQUIVALENT') eq, count(*) filter (label = 'NOT_EQUIVALENT') neq,
    arg_min(label, pos) filter (label <> 'UNKNOWN') first, sum(case when label = 'EQUIVALENT' then confidence else 0 end) ceq, sum(case when label = 'NOT_EQUIVALENT' then confidence else 0 end) cneq
  from v {where} group by item_id, system, rule),
i as (
  select item_id, system, rule, case when eq + neq = 0 then 'UNKNOWN' when eq > neq then 'EQUIVALENT' when neq > eq then 'NOT_EQUIVALENT' else first end majority,
    eq + neq > 0 and (eq = 0 or neq = 0) unanimous, not (eq + neq > 0 and (eq = 0 or neq = 0)) {strict} needs_review,
    round(case when eq + neq = 0 then 0 when eq > neq or eq = neq and first = 'EQUIVALENT' then ceq else cneq end / greatest(eq + neq, 1), 4) confidence, n n_verdicts
  from a)"""
_CONSENSUS = f"with {_VERDICTS.format(limit=150000)}, {_ITEMS.format(where='', strict='or eq + neq < n')}"

KEYS = ["item_id", "system", "rule"]


def _items(spark: SparkSession, d: str) -> DataFrame:
    return v.consensus(verdict_rows(spark, d), KEYS)


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Triples of a small implication graph for each part: if <brand> (not, for odd sizes) then <type> and/or <name>."""
    part = _read(spark, d, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("graph_id"), "p_brand", "p_type", "p_name", "p_size")
    t = lambda pos, s, r, o: F.struct(F.lit(pos).alias("pos"), F.lit(s).alias("source"), F.lit(r).alias("role"), o.alias("target"))
    odd, low = F.col("p_size") % 2 == 1, F.col("p_size") <= 25
    rows = [
        t(0, "c", ":instance", F.lit("have-condition-91")), t(1, "c", ":ARG1", F.lit("x")), t(2, "x", ":instance", F.when(low, "and").otherwise("or")),
        t(3, "x", ":op1", F.lit("p")), t(4, "p", ":instance", F.col("p_type")), t(5, "x", ":op2", F.lit("q")), t(6, "q", ":instance", F.col("p_name")),
        t(7, "c", ":ARG2", F.lit("a")), t(8, "a", ":instance", F.col("p_brand")), t(9, "a", ":polarity", F.when(odd, "-")), t(10, "x", ":polarity", F.when(F.col("p_size") % 3 == 0, "-")),
    ]
    return part.select("graph_id", F.explode(F.array(*rows)).alias("t")).select("graph_id", "t.*").filter("target is not null")


_GRAPH = """
g as (
  select 'g' || p_partkey graph_id, pos, source, role, target from part, lateral (values
    (0, 'c', ':instance', 'have-condition-91'), (1, 'c', ':ARG1', 'x'), (2, 'x', ':instance', case when p_size <= 25 then 'and' else 'or' end), (3, 'x', ':op1', 'p'), (4, 'p', ':instance', p_type),
    (5, 'x', ':op2', 'q'), (6, 'q', ':instance', p_name), (7, 'c', ':ARG2', 'a'), (8, 'a', ':instance', p_brand), (9, 'a', ':polarity', case when p_size % 2 = 1 then '-' end),
    (10, 'x', ':polarity', case when p_size % 3 = 0 then '-' end)) t(pos, source, role, target) where target is not null)"""


def _flat(triples: DataFrame) -> DataFrame:
    return triples.select("graph_id", "source", "role", "target")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Each document's whole text against the next document's, as candidate and reference."""
    docs = _read(spark, d, "documents").select("doc_id", F.col("text").alias("s"))
    return docs.select(F.col("doc_id").alias("id"), F.col("s").alias("cand")).join(docs.select((F.col("doc_id") - 1).alias("id"), F.col("s").alias("ref")), "id")


_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '')"
_SENT = "string_split(regexp_replace({0}, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1))"
_NORM = "regexp_replace(trim(regexp_replace(lower({0}), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '[.!?]+$', '')"
_JAC = "case when len(list_distinct(list_concat({0}, {1}))) = 0 then 1.0 else len(list_intersect(list_distinct({0}), list_distinct({1})))::double / len(list_distinct(list_concat({0}, {1}))) end"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ------------------------------------------------------------------ corpus

_add("sentence_split_dedup", lambda s, d: corpus.first_seen_sentences(_read(s, d, "documents")), f"""
with x as (select doc_id, unnest({_SENT.format('text')}) s, generate_subscripts({_SENT.format('text')}, 1) - 1 pos from documents),
y as (select trim(s) sentence, doc_id, pos from x where length(trim(s)) >= 5)
select sentence, doc_id, pos from y qualify row_number() over (partition by sentence order by doc_id, pos) = 1""")

_DIV = """
with t as (select {0} grp, """ + _TOK.replace("{0}", "text") .replace("{{", "{").replace("}}", "}") + """ ws from documents),
u as (select grp, unnest(ws) w from t), b as (select grp, ws[i] || ' ' || ws[i + 1] w from t, unnest(range(1, len(ws))) r(i)),
c as (select grp, count(*) n_texts, round(sum(len(ws))::double / count(*), 8) avg_tokens from t group by grp),
u1 as (select grp, round(count(distinct w)::double / count(*), 8) ttr from u group by grp), b1 as (select grp, round(count(distinct w)::double / count(*), 8) distinct_2 from b group by grp)
select grp, n_texts, avg_tokens, coalesce(ttr, 0) ttr, coalesce(distinct_2, 0) distinct_2 from c left join u1 using (grp) left join b1 using (grp)"""
_add("diversity_by_group", lambda s, d: corpus.diversity(_read(s, d, "documents"), "lang"), _DIV.replace("{0}", "lang"))
_add("diversity_by_source", lambda s, d: corpus.diversity(_read(s, d, "documents"), "source"), _DIV.replace("{0}", "source"))

_add("near_dup_rate", lambda s, d: corpus.near_duplicate_rate(_read(s, d, "documents")), f"""
with t as (select doc_id, list_distinct({_TOK.format('text')}) ws from documents), n as (select count(*) n_docs from t),
p as (select b.doc_id, max(j) j from (select a.doc_id a_id, b.doc_id, len(list_intersect(a.ws, b.ws))::double / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) j
  from t a join t b on a.doc_id < b.doc_id and len(a.ws) > 0 and len(b.ws) > 0 and least(len(a.ws), len(b.ws)) >= greatest(len(a.ws), len(b.ws)) * 0.7 - 1e-9) b group by b.doc_id)
select x threshold, count(p.doc_id) n_dup, n_docs, round(count(p.doc_id)::double / n_docs, 8) rate
from (values (0.8::double), (0.7::double)) v(x) cross join n left join p on p.j >= x group by x, n_docs""")

_PAIRS = f"""
with p as (select a.conv_id, a.turn, {_TOK.format('a.text')} x, {_TOK.format('b.text')} y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'),
j as (select conv_id, turn, round({_JAC.format('x', 'y')}, 8) jaccard from p)"""
_add("pair_jaccard", lambda s, d: corpus.turn_pairs(_read(s, d, "conversations")), f"{_PAIRS} select * from j")
_add("pair_jaccard_quartiles", lambda s, d: corpus.quartiles(corpus.turn_pairs(_read(s, d, "conversations")), "jaccard"), f"""{_PAIRS},
r as (select jaccard, row_number() over (order by jaccard) - 1 i, count(*) over () n, avg(jaccard) over () m from j)
select n, round(max(m), 8) mean, max(jaccard) filter (i = n // 4) q1, max(jaccard) filter (i = 3 * n // 4) q3 from r group by n""")

_add("heldout_exclusion", lambda s, d: corpus.held_out(_read(s, d, "documents"), _read(s, d, "benchmark")), f"""
with a as (select distinct {_NORM.format('s')} sentence from (select unnest({_SENT.format('text')}) s from documents)), b as (select distinct {_NORM.format('s')} sentence from (select unnest({_SENT.format('text')}) s from benchmark))
select sentence from a where sentence <> '' and sentence not in (select sentence from b)""")

_add("vocab_counts", lambda s, d: corpus.vocabulary(_read(s, d, "documents")), f"select token, count(*) n from (select unnest({_TOK.format('text')}) token from documents) group by token")
_add("vocab_characters", lambda s, d: corpus.character_vocabulary(_read(s, d, "documents")), f"select ch, count(*) n from (select unnest(string_split(token, '')) ch from (select unnest({_TOK.format('text')}) token from documents)) where ch <> '' group by ch")
_add("bleu_clipped_counts", lambda s, d: corpus.bleu_clipped(_copies(s, d), 1), f"""
with s as (select doc_id, text s from documents), c as (select doc_id id, w cand, count(*) n from (select doc_id, unnest({_TOK.format('s')}) w from s) where doc_id + 1 in (select doc_id from s) group by all),
r as (select doc_id - 1 id, w, count(*) m from (select doc_id, unnest({_TOK.format('s')}) w from s) group by all)
select sum(least(n, coalesce(m, 0)))::bigint matched, sum(n)::bigint total from c left join r on c.id = r.id and c.cand = r.w""")

# ------------------------------------------------------------------ verdicts

_add("consensus_items", _items, f"{_CONSENSUS} select * from i")
_add("consensus_by_verifier", lambda s, d: v.by_verifier(verdict_rows(s, d)), f"""with {_VERDICTS.format(limit=150000)}
select verifier, count(*) filter (label = 'EQUIVALENT') equivalent, count(*) filter (label = 'NOT_EQUIVALENT') not_equivalent, count(*) filter (label = 'UNKNOWN') abstain,
  round(case when count(*) filter (label <> 'UNKNOWN') = 0 then 0 else count(*) filter (label = 'EQUIVALENT')::double / count(*) filter (label <> 'UNKNOWN') end, 8) equivalence_rate from v group by verifier""")
_BY_SYSTEM = """ select system, count(*) n, count(*) filter (needs_review) pending_review, count(*) filter (not needs_review and majority = 'EQUIVALENT') equivalent,
  count(*) filter (not needs_review and majority = 'NOT_EQUIVALENT') not_equivalent,
  round(coalesce(count(*) filter (not needs_review and majority = 'EQUIVALENT')::double / nullif(count(*) filter (not needs_review and majority <> 'UNKNOWN'), 0), 0), 8) equivalence_rate_decided,
  round(count(*) filter (needs_review)::double / count(*), 8) pending_fraction from i group by system"""
_add("consensus_by_system", lambda s, d: v.by_system(_items(s, d)), _CONSENSUS + _BY_SYSTEM)
_add("review_queue", lambda s, d: _items(s, d).filter("needs_review").select(F.concat_ws("::", "system", "item_id", "rule").alias("key"), "majority"), f"{_CONSENSUS} select concat_ws('::', system, item_id::varchar, rule) as key, majority from i where needs_review")
_add("reaggregate_drop", lambda s, d: v.by_system(v.consensus(verdict_rows(s, d).filter("verifier <> 'price'"), KEYS, strict=False)), f"with {_VERDICTS.format(limit=150000)}, {_ITEMS.format(where="where verifier <> 'price'", strict='')}" + _BY_SYSTEM)
_COVER = """count(*) n_total, count(*) filter (o) with_output, count(*) filter (o and not needs_review and majority = 'EQUIVALENT') eq, count(*) filter (o and not needs_review and majority = 'NOT_EQUIVALENT') neq,
  count(*) filter (o and needs_review) pending, round(count(*) filter (o)::double / count(*), 8) coverage,
  round(coalesce(count(*) filter (o and not needs_review and majority = 'EQUIVALENT')::double / nullif(count(*) filter (o and not needs_review and majority <> 'UNKNOWN'), 0), 0), 8) quality,
  round(count(*) filter (o and not needs_review and majority = 'EQUIVALENT')::double / count(*), 8) overall"""
_add("coverage_quality_by_rule", lambda s, d: v.coverage(_items(s, d), F.col("item_id") % 7 != 0, [["system"], ["system", "rule"]]), f"{_CONSENSUS} select system, rule, {_COVER} from (select *, item_id % 7 <> 0 o from i) group by grouping sets ((system), (system, rule))")


def _runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = v.consensus(verdict_rows(s, d, 150_000.0), KEYS).filter("item_id % 11 <> 0")
    return before, v.consensus(verdict_rows(s, d, 120_000.0), KEYS).filter("item_id % 13 <> 0")


def _run_sql(limit: int, name: str) -> str:
    text = f"{_VERDICTS.format(limit=limit)}, {_ITEMS.format(where='', strict='or eq + neq < n')}"
    for old in ("v", "a", "i"):
        text = text.replace(f"\n{old} as (", f"\n{old}_{name} as (").replace(f"from {old} ", f"from {old}_{name} ").replace(f"from {old})", f"from {old}_{name})")
    return text


_add("run_diff", lambda s, d: v.run_diff(*_runs(s, d), "item_id", "majority"), f"""with {_run_sql(150000, 'x')}, {_run_sql(120000, 'y')},
b as (select item_id, majority m from i_x where item_id % 11 <> 0), c as (select item_id, majority m from i_y where item_id % 13 <> 0),
z as (select case when b.item_id is null then 'only_after' when c.item_id is null then 'only_before' when b.m = 'NOT_EQUIVALENT' and c.m = 'EQUIVALENT' then 'neq_to_eq' when b.m = 'EQUIVALENT' and c.m = 'NOT_EQUIVALENT' then 'eq_to_neq'
  when b.m = 'EQUIVALENT' and c.m = 'EQUIVALENT' then 'stable_eq' when b.m = 'NOT_EQUIVALENT' and c.m = 'NOT_EQUIVALENT' then 'stable_neq' end change from b full join c on b.item_id = c.item_id)
select change, count(*) n from z where change is not null group by change""")
_add("self_check_groups", lambda s, d: _read(s, d, "events").withColumn("category", F.when(F.col("event_type").isin("click", "view"), "ok").when(F.startswith("event_type", F.lit("p")), "self_check_failed").otherwise("other")).groupBy("category").agg(F.count("*").alias("n"), F.floor(F.count_if(F.col("value") > 50) * 100 / F.count("*")).alias("percent")),
     "select case when event_type in ('click', 'view') then 'ok' when starts_with(event_type, 'p') then 'self_check_failed' else 'other' end category, count(*) n, count(*) filter (value > 50) * 100 // count(*) percent from events group by 1")
_add("prf_confusion", lambda s, d: v.precision_recall(_read(s, d, "labels").join(_read(s, d, "documents").select("doc_id", F.when(F.length("text") > 1000, 1).when(F.length("text") > 300, 0).alias("pred")), "doc_id").select(F.col("toxic").alias("gold"), "pred"), "gold", "pred"), """
with r as (select toxic gold, case when length(text) > 1000 then 1 when length(text) > 300 then 0 end pred from labels join documents using (doc_id)),
c as (select count(*) filter (gold = pred) tp, count(*) filter (pred is not null and (gold is null or gold <> pred)) fp, count(*) filter (gold is not null and (pred is null or gold <> pred)) fn from r),
q as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) p, coalesce(tp::double / nullif(tp + fn, 0), 0) r from c)
select tp, fp, fn, round(p, 8) as "precision", round(r, 8) recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 8) f1 from q""")
_VOTES = ["l_linenumber % 3", "cast(l_quantity as int) % 3", "l_orderkey % 3", "l_partkey % 3", "l_suppkey % 3", "(l_linenumber + l_orderkey) % 3"]
_add("ensemble_mode", lambda s, d: v.ensemble_mode(_read(s, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(x).cast("int").alias(f"m{k}") for k, x in enumerate(_VOTES))), ["l_orderkey", "l_linenumber"], [f"m{k}" for k in range(6)]), f"""
with p as (select l_orderkey, l_linenumber, [{', '.join(f'({x})::int' for x in _VOTES)}] a from lineitem), c as (select *, list_transform(a, lambda x: len(list_filter(a, lambda y: y = x))) n from p)
select l_orderkey, l_linenumber, a[list_position(n, list_max(n))] as "mode" from c""")

# ------------------------------------------------------------------ data sets

_MD5 = "md5(concat_ws('|', '{0}', doc_id::varchar))"
_add("split_80_20", lambda s, d: corpus.split(_read(s, d, "documents").select("doc_id"), "doc_id", "s8", [("train", 0.8)], "validation"), f"select doc_id, case when row_number() over (order by {_MD5.format('s8')}, doc_id) <= floor(count(*) over () * 0.8::double) then 'train' else 'validation' end split from documents")
_add("split_90_5_5", lambda s, d: corpus.split(_read(s, d, "documents").select("doc_id"), "doc_id", "s9", [("train", 0.9), ("dev", 0.05)], "test"), f"""with r as (select doc_id, row_number() over (order by {_MD5.format('s9')}, doc_id) k, count(*) over () n from documents)
select doc_id, case when k <= floor(n * 0.9::double) then 'train' when k <= floor(n * 0.9::double) + floor(n * 0.05::double) then 'dev' else 'test' end split from r""")
_add("label_merge_left", lambda s, d: _read(s, d, "documents").select("doc_id", "lang").join(_read(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), "doc_id", "left"), "select d.doc_id, lang, quality::varchar quality, toxic::varchar toxic from documents d left join labels l on d.doc_id = l.doc_id")
_add("negative_oversample", lambda s, d: corpus.oversample_negatives(_read(s, d, "labels")), """
with neg as (select doc_id neg_id, row_number() over (order by md5(doc_id::varchar), doc_id) k from labels where quality = 0), t as (select count(*) n, count(*) filter (quality = 0) m from labels),
p as (select doc_id, j, ('0x' || substr(md5(concat_ws('|', 'neg', doc_id::varchar, j::varchar)), 1, 13))::bigint % m + 1 k from labels, range(1, 3) r(j), t where quality = 1 and m > 0),
a as (select neg_id doc_id, 0 quality, concat_ws('|', 'neg', p.doc_id::varchar, j::varchar) tag from p join neg using (k) union all select doc_id, 1, concat_ws('|', 'pos', doc_id::varchar) from labels where quality = 1),
o as (select row_number() over (order by md5(tag), tag) ord, doc_id, quality from a) select ord, doc_id, quality from o, t where ord <= n""")
_add("mcq_explode_binary", lambda s, d: _read(s, d, "conversations").filter("turn < 4").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c")).filter("size(c) = 4").select("conv_id", F.posexplode("c").alias("pos", "x")).select("conv_id", "pos", F.length("x.text").alias("n"), (F.col("pos") == F.col("conv_id") % 4).cast("int").alias("label")),
     "select conv_id, row_number() over (partition by conv_id order by turn) - 1 pos, length(text) n, (row_number() over (partition by conv_id order by turn) - 1 = conv_id % 4)::int as label from conversations where turn < 4 qualify count(*) over (partition by conv_id) = 4")
_add("exact_match_rate", lambda s, d: _copies(s, d).agg(F.round(F.avg((normalize(F.col("cand")) == normalize(F.col("ref"))).cast("double")), 8).alias("rate"), F.count("*").alias("n")), f"""
with s as (select doc_id, text s from documents)
select round(avg(({_NORM.format('a.s')} = {_NORM.format('b.s')})::int::double), 8) rate, count(*) n from s a join s b on b.doc_id = a.doc_id + 1""")


def _cosine_accuracy(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "embeddings")
    pairs = e.select("vec_id", "embedding", "label").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label")), "vec_id")
    same, cos = (F.col("label") == F.col("other_label")).cast("int"), cosine(F.col("embedding"), F.col("other"))
    return pairs.select(F.when(same == 1, cos > 0.5).otherwise(cos < 0.5).cast("double").alias("right")).agg(F.round(F.avg("right"), 8).alias("accuracy"), F.count("*").alias("n"))


_add("cosine_threshold_accuracy", _cosine_accuracy, """
with p as (select list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c, a.label = b.label s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select round(avg((case when s then c > 0.5 else c < 0.5 end)::int::double), 8) accuracy, count(*) n from p""")

# ------------------------------------------------------------------ generators


def _records(s: SparkSession, d: str) -> DataFrame:
    """Ordered choices of four distinct nations of a region: rule contexts."""
    n = _read(s, d, "nation").select("n_regionkey", "n_name")
    side = lambda k: n.select("n_regionkey", F.col("n_name").alias(f"x{k}"))
    rows = side(1)
    for k in (2, 3, 4):
        rows = rows.join(side(k), "n_regionkey")
        for j in range(1, k):
            rows = rows.filter(F.col(f"x{j}") != F.col(f"x{k}"))
    return rows.select("n_regionkey", F.concat(F.col("x1"), F.lit(" is not "), F.col("x2"), F.lit(". If "), F.col("x3"), F.lit(" then "), F.col("x4"), F.lit(".")).alias("context"))


_add("permutation_records", _records, "select a.n_regionkey, a.n_name || ' is not ' || b.n_name || '. If ' || c.n_name || ' then ' || e.n_name || '.' context from nation a join nation b using (n_regionkey) join nation c using (n_regionkey) join nation e using (n_regionkey) where a.n_name not in (b.n_name, c.n_name, e.n_name) and b.n_name not in (c.n_name, e.n_name) and c.n_name <> e.n_name")
_add("synthetic_cross", lambda s, d: _read(s, d, "region").select("r_name").join(F.broadcast(_read(s, d, "nation").select("n_name", "n_regionkey").filter("n_regionkey < 3"))).select(F.concat_ws(" ", F.lit("The"), "n_name", F.lit("is in"), "r_name").alias("sentence"), (F.col("n_regionkey") == 0).cast("int").alias("label")), "select concat_ws(' ', 'The', n_name, 'is in', r_name) sentence, (n_regionkey = 0)::int as label from region, nation where n_regionkey < 3")
_add("law_pairs", lambda s, d: _read(s, d, "nation").select("n_nationkey", F.explode(F.array(
    F.struct(F.lit("contraposition").alias("tag"), F.concat(F.lit("If not "), F.col("n_name"), F.lit(" then not here.")).alias("sentence2"), F.lit(1).alias("label")),
    F.struct(F.lit("implication").alias("tag"), F.concat(F.lit("Here or not "), F.col("n_name"), F.lit(".")).alias("sentence2"), F.lit(1).alias("label")),
    F.struct(F.lit("contraposition").alias("tag"), F.concat(F.lit("If not "), F.col("n_name"), F.lit(" then here.")).alias("sentence2"), F.lit(0).alias("label")))).alias("x")).select("n_nationkey", "x.*"),
    "select n_nationkey, tag, sentence2, label from nation, lateral (values ('contraposition', 'If not ' || n_name || ' then not here.', 1), ('implication', 'Here or not ' || n_name || '.', 1), ('contraposition', 'If not ' || n_name || ' then here.', 0)) x(tag, sentence2, label)")

# ------------------------------------------------------------------ graphs

_add("rule_detect", lambda s, d: graphs.detect(_graph(s, d)), f"""with {_GRAPH}
select graph_id, 'contraposition' rule, source node from g where role = ':instance' and target = 'have-condition-91' union all
select graph_id, 'implication', source from g where role = ':instance' and target in ('have-condition-91', 'or') union all
select graph_id, 'commutative', source from g where role = ':instance' and target in ('and', 'or') union all
select graph_id, 'de_morgan', source from g where role = ':polarity' and source = 'x' union all select graph_id, 'double_negation', source from g where role = ':instance'""")
_add("rule_apply_commutative", lambda s, d: _flat(graphs.commutative(_graph(s, d))), f"with {_GRAPH} select graph_id, source, case when source = 'x' and role = ':op1' then ':op2' when source = 'x' and role = ':op2' then ':op1' else role end as role, target from g")
_add("rule_apply_contraposition", lambda s, d: _flat(graphs.contraposition(_graph(s, d))), f"""with {_GRAPH},
k as (select graph_id, source, case when source = 'c' and role = ':ARG1' then ':ARG2' when source = 'c' and role = ':ARG2' then ':ARG1' else role end as role, target from g where role <> ':polarity'),
n as (select distinct graph_id, s source from g, (values ('a'), ('x')) v(s)) select * from k union all
select graph_id, source, ':polarity', '-' from n where not exists (select 1 from g where g.graph_id = n.graph_id and g.source = n.source and g.role = ':polarity')""")
_add("rule_apply_de_morgan", lambda s, d: _flat(graphs.de_morgan(_graph(s, d))), f"""with {_GRAPH}, m as (select distinct graph_id from g where source = 'x' and role = ':polarity')
select graph_id, source, role, case when source = 'x' and role = ':instance' and graph_id in (select graph_id from m) then case target when 'and' then 'or' else 'and' end else target end target from g
where not (source = 'x' and role = ':polarity') union all select graph_id, s, ':polarity', '-' from m, (values ('p'), ('q')) v(s)""")
_add("triples_polarity_gate", lambda s, d: graphs.polarity_gate(_graph(s, d), graphs.contraposition(_graph(s, d))), f"""with {_GRAPH},
c as (select graph_id, count(*) filter (role = ':polarity') expected, 2 - count(*) filter (role = ':polarity') got from g group by graph_id)
select graph_id, expected, got, case when expected % 2 <> got % 2 then 'parity' when expected > 0 and got = 0 then 'lost' when abs(expected - got) >= 2 then 'difference' end reason from c""")
_add("triple_f1", lambda s, d: graphs.triple_f1(_graph(s, d), graphs.commutative(_graph(s, d), positive=False)), f"""with {_GRAPH},
h as (select graph_id, source, role, target from g where not (source = 'q' and role = ':polarity') union all select distinct graph_id, 'q', ':polarity', '-' from g),
n as (select graph_id, source node, target concept from g where role = ':instance'),
ca as (select distinct g.graph_id, case when role = ':instance' then ':instance ' || target else concat_ws(' ', coalesce(a.concept, source), role, coalesce(b.concept, target)) end t from g left join n a on a.graph_id = g.graph_id and a.node = source left join n b on b.graph_id = g.graph_id and b.node = target),
cb as (select distinct h.graph_id, case when role = ':instance' then ':instance ' || target else concat_ws(' ', coalesce(a.concept, source), role, coalesce(b.concept, target)) end t from h left join n a on a.graph_id = h.graph_id and a.node = source left join n b on b.graph_id = h.graph_id and b.node = target)
select coalesce(ca.graph_id, cb.graph_id) graph_id, round(2.0 * count(*) filter (ca.t is not null and cb.t is not null) / (count(ca.t) + count(cb.t)), 8)::double f1 from ca full join cb on ca.graph_id = cb.graph_id and ca.t = cb.t group by 1""")
_add("triple_f1_gate", lambda s, d: QUERIES["triple_f1"](s, d).filter("f1 >= 0.9"), f"select * from ({SQL['triple_f1']}) where f1 >= 0.9::double")
_add("literal_closure", lambda s, d: graphs.literal_closure(_read(s, d, "nation").join(_read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b")).unionByName(_read(s, d, "region").select(F.col("r_name").alias("a"), F.lit("EARTH").alias("b")))), """
with recursive i as (select n_name a, r_name b from nation join region on n_regionkey = r_regionkey union select r_name, 'EARTH' from region),
k as (select a, b from i union select '-' || b, '-' || a from i), c as (select a, b from k union select c.a, k.b from c join k on c.b = k.a where c.a <> k.b) select a, b from c""")

_add("closure_contraposition", lambda s, d: graphs.literal_closure(_read(s, d, "nation").join(_read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b")), chain=False), "with i as (select n_name a, r_name b from nation join region on n_regionkey = r_regionkey) select a, b from i union select '-' || b, '-' || a from i")
_add("distinct_trigrams", lambda s, d: corpus.distinct_ngrams(_read(s, d, "documents"), 3), f"with t as (select {_TOK.format('text')} ws from documents), g as (select ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from t, unnest(range(1, len(ws) - 1)) r(i)) select count(distinct g) as distinct, count(*) total, round(count(distinct g)::double / count(*), 8) ratio from g")


# ------------------------------------------------------------------ packed graphs


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return rules.pack(_graph(spark, d))


def _applied(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rules.unpack(rules.transform(_packed(s, d), rule)).select("graph_id", "at", "label", "source", "role", "target")


_add("rule_matches", lambda s, d: rules.detect(_packed(s, d)).groupBy("graph_id", "rule").agg(F.count("*").alias("n")), """
select 'g' || p_partkey graph_id, r.rule, r.n::bigint n from part, lateral (values
  ('contraposition', 1), ('implication', case when p_size <= 25 then 1 else 2 end), ('commutative', 1), ('double_negation', 5), ('aspect_equivalence', 1),
  ('de_morgan', case when p_size % 3 = 0 then 1 else 0 end)) r(rule, n) where r.n > 0""")

_add("rule_apply_implication", _applied("implication"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label),
neg as (select graph_id, source from g where role = ':polarity'),
f as (select graph_id, 0 "at", label, source, case when source = 'c' and role = ':ARG1' then ':op2' when source = 'c' and role = ':ARG2' then ':op1' else role end role,
    case when source = 'c' and role = ':instance' then 'or' else target end target from g, l where not (label = 1 and source = 'a' and role = ':polarity')),
o as (select graph_id from g where source = 'x' and role = ':instance' and target = 'or'),
h as (select graph_id, 1 "at", label, source, case when source = 'x' and role = ':op1' then ':ARG2' when source = 'x' and role = ':op2' then ':ARG1' else role end role,
    case when source = 'x' and role = ':instance' then 'have-condition-91' else target end target from g semi join o using (graph_id), l)
select * from f union all select * from h
union all select graph_id, 1, 1, 'p', ':polarity', '-' from o
union all select distinct graph_id, 0, 1, 'a', ':polarity', '-' from g where graph_id not in (select graph_id from neg where source = 'a')""")

_add("rule_apply_double_negation", _applied("double_negation"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label),
n as (select graph_id, source node, row_number() over (partition by graph_id order by pos) - 1 "at" from g where role = ':instance'),
neg as (select graph_id, source node from g where role = ':polarity')
select graph_id, "at", label, source, role, target from g join n using (graph_id), l where not (label = 1 and source = node and role = ':polarity')
union all select graph_id, "at", label, node, ':polarity', '-' from (select * from n anti join neg using (graph_id, node)), l""")

_add("rewrite_contraposition", _applied("contraposition"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label), ids as (select distinct graph_id from g),
neg as (select graph_id from g where role = ':polarity' and source = 'a')
select graph_id, 0 "at", label, source, case when label = 1 and source = 'c' and role = ':ARG1' then ':ARG2' when label = 1 and source = 'c' and role = ':ARG2' then ':ARG1' else role end role,
  case when label = 1 and source = 'x' and role = ':instance' then case target when 'and' then 'or' else 'and' end else target end target
from g, l where not (source = 'a' and role = ':polarity')
union all select graph_id, 0, label, 'a', ':polarity', '-' from (select * from ids anti join neg using (graph_id)), l
union all select graph_id, 0, 1, n, ':polarity', '-' from ids, (select unnest(['p', 'q']) n)""")

_add("rewrite_de_morgan", _applied("de_morgan"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label), ids as (select distinct graph_id from g where source = 'x' and role = ':polarity')
select graph_id, 0 "at", label, source, role, case when source = 'x' and role = ':instance' then case target when 'and' then 'or' else 'and' end else target end target
from g semi join ids using (graph_id), l where not (source = 'x' and role = ':polarity')
union all select graph_id, 0, 1, n, ':polarity', '-' from ids, (select unnest(['p', 'q']) n)""")

_add("rewrite_commutative", _applied("commutative"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label)
select graph_id, 0 "at", label, source, case when label = 1 and source = 'x' and role = ':op1' then ':op2' when label = 1 and source = 'x' and role = ':op2' then ':op1' else role end role, target from g, l
union all select distinct graph_id, 0, 0, 'q', ':polarity', '-' from g""")

_add("node_attributes", lambda s, d: attributes.attributes(_packed(s, d)), f"""
with {_GRAPH}
select graph_id, source node, ':animacy' role, 'inanimate' as value from g where role = ':instance' and not contains(target, '-')
union all select graph_id, source, ':modal-strength', 'full-affirmative' from g where role = ':instance' and source = 'c'""")

_add("composition_contraposition_commutative", lambda s, d: rules.unpack(dispatch.compositions(_packed(s, d)).filter("template = 'contraposition+commutative'").drop("template", "top")).select("graph_id", "label", "source", "role", "target"), f"""
with {_GRAPH}, l as (select unnest([0, 1]) label), ids as (select distinct graph_id from g), neg as (select graph_id from g where role = ':polarity' and source = 'a')
select graph_id, label, source, case when source = 'c' and role = ':ARG1' then ':ARG2' when source = 'c' and role = ':ARG2' then ':ARG1' when label = 1 and source = 'x' and role = ':op1' then ':op2' when label = 1 and source = 'x' and role = ':op2' then ':op1' else role end role,
  case when source = 'x' and role = ':instance' then case target when 'and' then 'or' else 'and' end else target end target from g, l where not (source = 'a' and role = ':polarity')
union all select graph_id, label, 'a', ':polarity', '-' from (select * from ids anti join neg using (graph_id)), l
union all select graph_id, label, 'p', ':polarity', '-' from ids, l union all select graph_id, 1, 'q', ':polarity', '-' from ids""")

_add("graph_text", lambda s, d: _packed(s, d).select("graph_id", penman.encode("top", "g").alias("text")), """
select 'g' || p_partkey graph_id, '(c / have-condition-91 :ARG1 (x / ' || case when p_size <= 25 then 'and' else 'or' end || ' :op1 (p / ' || p_type || ') :op2 (q / ' || p_name || ')'
  || case when p_size % 3 = 0 then ' :polarity -' else '' end || ') :ARG2 (a / ' || p_brand || case when p_size % 2 = 1 then ' :polarity -' else '' end || '))' as text from part""")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | rule_queries.QUERIES | extended.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | rule_queries.SQL | extended.SQL
