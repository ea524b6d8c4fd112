"""Verdicts of several verifiers: votes, consensus, rates, review queue, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import zero_guard

EQ, NEQ, UNKNOWN = "EQUIVALENT", "NOT_EQUIVALENT", "UNKNOWN"


def consensus(verdicts: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """One row an item of long verdicts (keys, pos, verifier, label, confidence).

    Only EQ and NEQ vote; on a tie the first voter's label wins. Review is asked for
    unless the votes are unanimous; with ``strict`` an abstention asks for it too."""
    votes = F.col("label").isin(EQ, NEQ)
    rows = verdicts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == EQ).alias("eq"),
        F.count_if(F.col("label") == NEQ).alias("neq"),
        F.min_by("label", F.when(votes, F.col("pos"))).alias("first"),
        F.sum(F.when(F.col("label") == EQ, F.col("confidence")).otherwise(0.0)).alias("ceq"),
        F.sum(F.when(F.col("label") == NEQ, F.col("confidence")).otherwise(0.0)).alias("cneq"),
    )
    cast = F.col("eq") + F.col("neq")
    majority = F.when(cast == 0, UNKNOWN).when(F.col("eq") > F.col("neq"), EQ).when(F.col("neq") > F.col("eq"), NEQ).otherwise(F.col("first"))
    unanimous = (cast > 0) & ((F.col("eq") == 0) | (F.col("neq") == 0))
    review = ~unanimous | (cast < F.col("n")) if strict else ~unanimous
    sure = F.when(majority == EQ, F.col("ceq")).when(majority == NEQ, F.col("cneq")).otherwise(0.0)
    return rows.select(*keys, majority.alias("majority"), unanimous.alias("unanimous"), review.alias("needs_review"), F.round(sure / F.greatest(cast, F.lit(1)), 4).alias("confidence"), F.col("n").alias("n_verdicts"))


def by_verifier(verdicts: DataFrame) -> DataFrame:
    """Counts and equivalence rate of each verifier."""
    rows = verdicts.groupBy("verifier").agg(F.count_if(F.col("label") == EQ).alias("equivalent"), F.count_if(F.col("label") == NEQ).alias("not_equivalent"), F.count_if(~F.col("label").isin(EQ, NEQ)).alias("abstain"))
    return rows.withColumn("equivalence_rate", F.round(zero_guard(F.col("equivalent"), F.col("equivalent") + F.col("not_equivalent")), 8))


def by_system(items: DataFrame, system: str = "system") -> DataFrame:
    """Counts of each system; items under review count as pending only."""
    calm = ~F.col("needs_review")
    rows = items.groupBy(system).agg(F.count("*").alias("n"), F.count_if(F.col("needs_review")).alias("pending_review"), F.count_if(calm & (F.col("majority") == EQ)).alias("equivalent"), F.count_if(calm & (F.col("majority") == NEQ)).alias("not_equivalent"))
    return rows.withColumn("equivalence_rate_decided", F.round(zero_guard(F.col("equivalent"), F.col("equivalent") + F.col("not_equivalent")), 8)).withColumn("pending_fraction", F.round(zero_guard(F.col("pending_review"), F.col("n")), 8))


def coverage(items: DataFrame, has_output: Column, sets: list[list[str]]) -> DataFrame:
    """Coverage, quality and overall rate at several grains in one pass (grouping sets)."""
    kept = items.withColumn("_out", has_output)
    grains = sorted({c for s in sets for c in s})
    calm = F.col("_out") & ~F.col("needs_review")
    rows = kept.groupingSets([[F.col(c) for c in s] for s in sets], *grains).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("_out")).alias("with_output"),
        F.count_if(calm & (F.col("majority") == EQ)).alias("eq"),
        F.count_if(calm & (F.col("majority") == NEQ)).alias("neq"),
        F.count_if(F.col("_out") & F.col("needs_review")).alias("pending"),
    )
    return rows.withColumn("coverage", F.round(zero_guard(F.col("with_output"), F.col("n_total")), 8)).withColumn("quality", F.round(zero_guard(F.col("eq"), F.col("eq") + F.col("neq")), 8)).withColumn("overall", F.round(zero_guard(F.col("eq"), F.col("n_total")), 8))


def run_diff(before: DataFrame, after: DataFrame, key: str, label: str) -> DataFrame:
    """(change, n) between two runs: transitions of common items, and items of one run only."""
    both = before.select(key, F.col(label).alias("b"), F.lit(True).alias("in_b")).join(after.select(key, F.col(label).alias("a"), F.lit(True).alias("in_a")), key, "full")
    change = F.when(F.col("in_b").isNull(), "only_after").when(F.col("in_a").isNull(), "only_before").when((F.col("b") == NEQ) & (F.col("a") == EQ), "neq_to_eq").when((F.col("b") == EQ) & (F.col("a") == NEQ), "eq_to_neq").when((F.col("b") == EQ) & (F.col("a") == EQ), "stable_eq").when((F.col("b") == NEQ) & (F.col("a") == NEQ), "stable_neq")
    return both.select(change.alias("change")).filter("change is not null").groupBy("change").agg(F.count("*").alias("n"))


def precision_recall(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1): a wrong label counts as both fp and fn."""
    g, p = F.col(gold), F.col(pred)
    sums = rows.agg(F.count_if(g == p).alias("tp"), F.count_if(p.isNotNull() & (g.isNull() | (g != p))).alias("fp"), F.count_if(g.isNotNull() & (p.isNull() | (g != p))).alias("fn"))
    pr, rc = zero_guard(F.col("tp"), F.col("tp") + F.col("fp")), zero_guard(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", F.round(pr, 8).alias("precision"), F.round(rc, 8).alias("recall"), F.round(zero_guard(2 * pr * rc, pr + rc), 8).alias("f1"))


def ensemble_mode(rows: DataFrame, id_cols: list[str], votes: list[str]) -> DataFrame:
    """The most frequent prediction of several models; the earliest model's on ties."""
    array = F.array(*votes)
    counts = F.transform(array, lambda v: F.size(F.filter(array, lambda w: w == v)))
    return rows.select(*id_cols, F.element_at(array, F.array_position(counts, F.array_max(counts)).cast("int")).alias("mode"))
