"""Picking, ordering and pairing rows: splits, samples, first hits, neighbours.

Windows run inside a key; ranks over all rows come from ``corpus.exact_rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import exact_rank


def seeded(seed: str, *ids: str) -> Column:
    """The hash that orders rows in seeded draws; the same value in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in ids)))


def stratified_split(rows: DataFrame, id_col: str, label: str, seed: str, share: float) -> DataFrame:
    """Add ``split``: of each label's rows floor(n * share) are ``train``, the others ``validation``.

    A label's rows are ranked inside 4096 key ranges, so a large label is no single task."""
    keyed = rows.withColumn("_key", seeded(seed, id_col)).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    places = counts.select(F.col(label).alias("_l"), F.col("_range").alias("_r"), (F.sum("_n").over(Window.partitionBy(label).orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy(label, "_range").orderBy("_key", id_col)))
    joined = inside.join(places, (F.col("_range") == F.col("_r")) & F.col(label).eqNullSafe(F.col("_l")))
    train = F.col("_before") + F.col("_in") <= F.floor(F.col("_all") * F.lit(share))
    return joined.withColumn("split", F.when(train, "train").otherwise("validation")).select(*rows.columns, "split")


def seeded_sample(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """``n`` rows without replacement, the first by a seeded hash; all if there are fewer."""
    return exact_rank(rows, seeded(seed, id_col), id_col).filter(F.col("rank") <= n).drop("rank")


def up_weighted(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).filter("copy >= 1")


def frequent_labels(rows: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows whose label stands ``least`` times or more."""
    often = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return rows.join(often, label, "left_semi")


def first_passing(samples: DataFrame, keys: list[str], text: str, passed: str, pos: str) -> DataFrame:
    """Of each key's samples the first that passed, else the first; ``flagged`` tells the latter. Equal texts count once."""
    once = samples.groupBy(*keys, text).agg(F.max(passed).alias(passed), F.min(pos).alias(pos))
    best = F.min_by(F.struct(text, passed), F.struct(~F.col(passed), F.col(pos)))
    return once.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b")[text].alias(text), (~F.col("_b")[passed]).alias("flagged"))


def best_of(rows: DataFrame, keys: list[str], value: str, score: str, pos: str) -> DataFrame:
    """The value of the highest score of each key, the earliest of equals."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(score), -F.col(pos))).alias(value), F.max(score).alias(score))


def last_by(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row for each key, the last by ``pos``; a plain aggregate, so large keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_v")).select(*keys, "_v.*")


def gold_or_silver(silver: DataFrame, gold: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Silver rows with gold values where there are any, and which they are."""
    g = last_by(gold, keys, value).withColumnRenamed(value, "_gold")
    out = silver.join(g, keys, "left")
    return out.withColumn("origin", F.when(F.col("_gold").isNotNull(), "gold").otherwise("silver")).withColumn(value, F.coalesce("_gold", value)).drop("_gold")


def cached_lookup(rows: DataFrame, key: str, compute) -> DataFrame:
    """``compute`` (a DataFrame function on one column) once for each distinct key, joined back."""
    return rows.join(compute(rows.select(key).distinct()), key, "left")


def previous_and_next(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each row's value with the next one's in its key: adjacent pairs; the last row of a key has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("following", F.lead(value).over(w)).filter("following is not null")


def pairs_before(rows: DataFrame, keys: list[str], order: str, value: str, first: int = 8) -> DataFrame:
    """(keys, a, b): ordered pairs of the first ``first`` rows of a key (the operator's own bound), made from one array."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_rn") <= first)
    lists = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(value).alias("v")))).alias("_l"))
    pairs = F.flatten(F.transform("_l", lambda x, i: F.transform(F.slice("_l", i + 2, first), lambda y: F.struct(x["v"].alias("a"), y["v"].alias("b")))))
    return lists.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.a", "p.b")


def random_partner(rows: DataFrame, id_col: str, seed: str) -> DataFrame:
    """(id, partner): another row for each, the next in a seeded order (the last one gets the first); none for a single row."""
    ranked = exact_rank(rows.select(id_col), seeded(seed, id_col), id_col)
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))
    wanted = ranked.join(n).withColumn("rank", F.col("rank") % F.col("_n") + 1).filter("_n > 1").drop("_n")
    return wanted.join(ranked.select("rank", F.col(id_col).alias("partner")), "rank").select(id_col, "partner")


def latest_known(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add ``latest``: the last value that is not null, up to the row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("latest", F.last(value, ignorenulls=True).over(w))


def best_so_far(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("best", F.max(value).over(w))


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add ``no`` (from 0) within a key and ``name``: the key alone if its row is the only one, else with the number."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"no": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return rows.withColumn("name", F.when(F.col("_n") == 1, F.col(keys[-1])).otherwise(F.concat_ws("_", F.col(keys[-1]), F.col("no").cast("string")))).drop("_n")


def by_length(rows: DataFrame, text: str, size: int, id_col: str) -> DataFrame:
    """Add ``batch``: rows in order of falling length, ``size`` to a batch; the id restores the order."""
    length = F.lpad((F.lit(10**9) - F.length(text)).cast("string"), 10, "0")
    ranges = rows.withColumn("_at", F.concat(length, F.lpad(F.col(id_col).cast("string"), 19, "0")))
    counts = ranges.groupBy(F.length(text).alias("_len")).agg(F.count("*").alias("_n"))
    before = counts.select("_len", (F.sum("_n").over(Window.orderBy(F.desc("_len"))) - F.col("_n")).alias("_before"))  # a row for each length
    inside = ranges.withColumn("_len", F.length(text)).withColumn("_in", F.row_number().over(Window.partitionBy("_len").orderBy(id_col)))
    return inside.join(before, "_len").withColumn("batch", F.floor((F.col("_before") + F.col("_in") - 1) / size)).select(*rows.columns, "batch")
