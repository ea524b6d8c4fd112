"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws a key -ln(u) / w, u from a hash of its id, w its quality
weight (the share of its characters that are neither symbols nor digits). Within
a source, documents in ascending order of key are a weighted sample without
replacement of any size; sizes are summed along that order up to the budget.
Whole epochs of a source (target div size) precede the fractional selection.

Targets share ``ratio`` of all words by source weights; a source's target stops
at ``most`` times its size and the excess is shared again by weight (solved at
once: sources in order of cap over weight fill up one after the other).

Scale: native DataFrame functions only. No window runs over a source's documents:
keys are cut into 4096 buckets by their distribution, bucket sums are
pre-aggregated, and the one bucket of each source that holds its budget's end is
cut again; only documents of one bucket in 16 million are ordered one by one. The
rank of a source's last document is all the rows need, so they decide by their own
columns and a table of sources. So a source with a third of all rows costs no task
more than another. Targets are solved in one task over a row a source (a few dozen
bytes each: a million sources still fit it).

Defined results: null texts and texts without a word have size 0 and are taken 0
times; null sources are a source, the last one; ties of keys are broken by doc_id,
size and row; repeated rows are drawn together, row by row; an empty table gives no
rows; other columns are ignored (kept by ``repeated``, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, cut, free_name, table, with_place

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MOST = 2
SEED = "mix"
BUCKETS = 4096
_ODD = "#*$%&|<>0123456789"


def sized(docs: DataFrame, seed: str = SEED, text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, key, row) of every row of ``docs``, which has a column ``row``: columns of the row alone."""
    return docs.select(*key_columns(seed, text_col), "row")


def key_columns(seed: str = SEED, text_col: str = "text") -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    weight = 0.25 + 0.75 * F.length(F.translate(text, _ODD, "")) / F.greatest(F.length(text), F.lit(1))
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), source, size.cast("string"))), 1, 13), 16, 10).cast("double")
    key = -F.log((drawn + 1) / F.lit(float(2**52 + 2))) / weight
    return [doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), key.alias("key")]


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row a source, so the windows are over a small aggregate."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    w = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).withColumn("goal", F.sum("source_size").over(every) * ratio)
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped", (F.col("goal") - F.coalesce(F.sum("cap").over(rising), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0))) * F.col("w") >= F.col("cap"))
    free, full = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every), F.sum(F.when(F.col("capped"), F.col("cap"))).over(every)
    share = (F.col("goal") - F.coalesce(full, F.lit(0))) * F.col("w") / free
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _crossing(sums: DataFrame, goals: DataFrame, level: int) -> DataFrame:
    """goals with (b<level>, before<level>): the bucket that holds the end of the source's budget, and the words before it."""
    b, before = f"b{level}", f"before{level}"
    start = F.lit(0).cast("long") if level == 1 else F.col(f"before{level - 1}")
    upto = sums.withColumn("_upto", F.sum("words").over(Window.partitionBy("source").orderBy(b)))
    joined = attach(upto, goals, ["source"]).withColumn("_from", start + F.col("_upto") - F.col("words"))
    hit = joined.filter((F.col("_from") <= F.col("rest")) & (F.col("_from") + F.col("words") > F.col("rest")))
    return cut(attach(goals, cut(hit.groupBy("source").agg(F.min(b).alias(b), F.min("_from").alias(before))), ["source"]))


def place(level: int) -> Column:
    """Bucket of a key: by its distribution, and on level 2 within the bucket of level 1."""
    at = (1 - F.exp(-F.col("key"))) * BUCKETS
    return (F.floor(at) if level == 1 else F.floor((at - F.floor(at)) * BUCKETS)).cast("int")


def rank() -> Column:
    """The order in which documents of a source are drawn; a row number ends all ties."""
    return F.struct("key", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size", "row")


def budgets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, every, last): a row a source, checkpointed.

    ``last`` is the rank of the last document of the fractional selection, ``every``
    says that all (true) or none (false) of the source are in it. ``rows`` is read
    several times: it should be a checkpoint."""
    goals = cut(targets(rows))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.withColumn("b1", place(1)).withColumn("b2", place(2))
    goals = _crossing(rows.groupBy("source", "b1").agg(F.sum("size").alias("words")), goals, 1)
    first = goals.select("source", F.col("b1").alias("at1"))
    inside = attach(rows, first, ["source"]).filter("b1 = at1")
    goals = _crossing(inside.groupBy("source", "b2").agg(F.sum("size").alias("words")), goals, 2)
    ends = cut(goals.select("source", "rest", F.col("b1").alias("at1"), F.col("b2").alias("at2"), "before2"))
    edge = attach(rows, ends, ["source"]).filter("b1 = at1 and b2 = at2")
    upto = F.col("before2") + F.sum("size").over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = edge.withColumn("rank", rank()).withColumn("_upto", upto).filter(2 * F.col("_upto") - F.col("size") <= 2 * F.col("rest"))
    ranks = picked.groupBy("source").agg(F.max("rank").alias("last"))
    found = attach(goals, cut(ranks), ["source"])
    every = F.when(F.col("b1").isNull(), F.col("rest") > 0)
    return cut(found.select("source", "source_size", "target", "epochs", every.alias("every"), F.col("b1").alias("at1"), F.coalesce("b2", F.lit(0)).alias("at2"), "last"))


def times() -> Column:
    """How often a row with the columns of ``budgets`` and its own rank is drawn."""
    before = (place(1) < F.col("at1")) | (place(1) == F.col("at1")) & (place(2) < F.col("at2"))
    inside = (place(1) == F.col("at1")) & (place(2) == F.col("at2")) & F.coalesce(rank() <= F.col("last"), F.lit(False))
    return F.col("epochs") + F.coalesce("every", before | inside).cast("long")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``."""
    rows = cut(sized(docs.withColumn("row", F.monotonically_increasing_id()), seed))
    joined = attach(rows, budgets(rows), ["source"])
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it (0 times: it goes, and so do texts
    without a word), with all its columns.

    The small columns are checkpointed for the budgets; the rows themselves are read
    once more and take their count from their own columns, so no copy of the texts
    is written and nothing of them shuffled."""
    place_name, whole = free_name(docs, "_row"), free_name(docs, "_whole")
    placed = with_place(docs, place_name)
    rows = cut(sized(placed.select("doc_id", "source", "text", F.col(place_name).alias("row")), seed))
    packed = placed.select(F.struct(*docs.columns).alias(whole), *key_columns(seed), F.col(place_name).alias("row"))
    drawn = attach(packed, budgets(rows), ["source"]).withColumn("_times", F.when(F.col("size") > 0, times()).otherwise(0).cast("int"))
    return drawn.select(whole, F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(f"{whole}.*")


def mix_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ``repeated``; all columns stay."""
    return repeated(docs)


SQL = f"""
with d as (
  select doc_id, source, coalesce(text, '') t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::bigint size from documents),
k as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id::varchar, source, size::varchar)), 1, 13))::bigint::double + 1) / {float(2**52 + 2)!r})
      / (0.25::double + 0.75::double * (length(regexp_replace(t, '[#*$%&|<>0-9]', '', 'g'))::double / greatest(length(t), 1))) key
  from d),
s as (select source, sum(size)::bigint source_size from k group by source),
w as (
  select *, ([{", ".join(map(str, WEIGHTS))}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] w, source_size * {MOST} cap,
    sum(source_size) over ()::double * {RATIO}::double goal from s),
c as (
  select *, (goal - coalesce(sum(cap) over r, 0)::double) / (sum(w) over () - coalesce(sum(w) over r, 0))::double * w >= cap capped
  from w window r as (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
g as (
  select source, source_size, case when capped then cap::double
    else (goal - coalesce(sum(cap) filter (where capped) over (), 0)::double) * w / (sum(w) filter (where not capped) over ())::double end target from c),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end epochs from g),
p as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id nulls last, k.size rows between unbounded preceding and current row) upto
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (epochs + case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end))::bigint taken from p
"""
