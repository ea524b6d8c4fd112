"""Evaluation of labels, relations, alignments and graphs: counts first, ratios last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import f1
from ..functions.strings import frame, without_sense
from ..functions.text import zero_guard
from .lineage import dealt
from .verdicts import EQ, NEQ

# ---- fixed values: what a relation says when its ends are exchanged
INVERSE = {
    ":before": ":after",
    ":after": ":before",
    ":overlap": ":overlap",
    ":same-entity": ":same-entity",
    ":same-event": ":same-event",
    ":full-affirmative": ":full-affirmative",
    ":partial-affirmative": ":partial-affirmative",
    ":full-negative": ":full-negative",
}
# ---- end of fixed values


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(kind, key, n): disagreements as gold->pred, labels only one side has, by count."""
    g, p = F.col(gold).cast("string"), F.col(pred).cast("string")
    kind = F.when(g.isNotNull() & p.isNotNull() & (g != p), "confusion").when(g.isNotNull() & p.isNull(), "gold_only").when(g.isNull() & p.isNotNull(), "pred_only")
    key = F.when(kind == "confusion", F.concat(g, F.lit("->"), p)).otherwise(F.coalesce(g, p))
    return rows.select(kind.alias("kind"), key.alias("key")).filter("kind is not null").groupBy("kind", "key").agg(F.count("*").alias("n"))


def hybrid(rows: DataFrame, gold: str, rule: str, model: str) -> DataFrame:
    """Rule first, model where it is silent: (source, n, right) and the accuracy over rows with gold."""
    pred = F.coalesce(F.col(rule), F.col(model))
    source = F.when(F.col(rule).isNotNull(), "rule").when(F.col(model).isNotNull(), "model").otherwise("none")
    out = rows.filter(F.col(gold).isNotNull()).groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_if(pred == F.col(gold)).alias("right"))
    return out.withColumn("accuracy", F.round(zero_guard(F.col("right"), F.col("n")), 8))


def accuracy_f1(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(n, accuracy, macro_f1): micro F1 equals accuracy when each row has one label; macro is over gold labels."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    side = cells.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("g") == F.col("p"), 0).otherwise(F.col("n")).alias("fn"), F.lit(1).alias("gold")),
        F.struct(F.col("p").alias("label"), F.lit(0).alias("tp"), F.when(F.col("g") == F.col("p"), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("gold")))).alias("x")).select("x.*")
    labels = side.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "gold"))).filter("gold > 0")
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    macro = labels.agg(F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 8).alias("macro_f1"))
    return total.join(F.broadcast(macro)).select("n", F.round(zero_guard(F.col("hits"), F.col("n")), 8).alias("accuracy"), "macro_f1")


def macro_alignment(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(precision, recall, f1) of two arrays a row: set overlap over list length, averaged."""
    hit = F.size(F.array_intersect(F.col(gold), F.col(pred)))
    means = rows.agg(F.avg(zero_guard(hit, F.size(pred))).alias("p"), F.avg(zero_guard(hit, F.size(gold))).alias("r"))
    return means.select(F.round("p", 8).alias("precision"), F.round("r", 8).alias("recall"), F.round(zero_guard(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 8).alias("f1"))


def relation_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(tp, fp, fn) of relations (doc_id, src, rel, tgt): a prediction is right if it or its inverse is gold.

    Each prediction counts, repeated ones too; a gold row is missed if none names it."""
    inverse = F.create_map(*(F.lit(x) for pair in INVERSE.items() for x in pair))[F.col("rel")]
    key = ["doc_id", "src", "rel", "tgt"]
    known = gold.select(*key).distinct()
    straight = pred.withColumn("_inv", inverse).join(known.withColumn("_g", F.lit(True)), key, "left")
    both = straight.join(known.toDF("doc_id", "tgt", "_inv", "src").withColumn("_t", F.lit(True)), ["doc_id", "src", "_inv", "tgt"], "left")
    right = F.col("_g").isNotNull() | F.col("_t").isNotNull()
    counts = both.agg(F.count_if(right).alias("tp"), F.count_if(~right).alias("fp"))
    # the inverse names a gold row only where the prediction itself is none
    named = straight.filter("_g").select(*key).union(straight.filter("_g is null").select("doc_id", F.col("tgt").alias("src"), F.col("_inv").alias("rel"), F.col("src").alias("tgt"))).distinct()
    missed = gold.join(named, key, "left_anti").agg(F.count("*").alias("fn"))
    return counts.join(F.broadcast(missed))


def subscores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(score, matched, n_pred, n_gold, f1) of graphs in triples form, as sums of set overlaps a graph.

    Sets of a graph: concepts, frames, frames without sense, negated concepts, names,
    links, and all triples with concepts in place of variables."""

    def sets(triples: DataFrame) -> DataFrame:
        c = triples.filter("role = ':instance'").select("graph_id", F.col("source").alias("node"), F.col("target").alias("concept"))
        of = lambda role, name: triples.filter(F.col("role") == role).select("graph_id", F.col("source").alias("node"), F.col("target").alias("t")).join(dealt(c), ["graph_id", "node"]).select("graph_id", F.lit(name).alias("score"), F.concat_ws(" ", "concept", "t").alias("item"))
        plain = lambda name, item, keep: c.filter(keep).select("graph_id", F.lit(name).alias("score"), item.alias("item"))
        numbered = frame(F.col("concept"))["sense"].isNotNull()
        left, right = c.withColumnsRenamed({"node": "source", "concept": "cs"}), c.withColumnsRenamed({"node": "target", "concept": "ct"})
        edges = triples.filter("role <> ':instance'").join(dealt(left), ["graph_id", "source"], "left").join(dealt(right), ["graph_id", "target"], "left")
        every = edges.select("graph_id", F.lit("ignore_vars").alias("score"), F.concat_ws(" ", F.coalesce("cs", "source"), "role", F.coalesce("ct", "target")).alias("item"))
        out = plain("concepts", F.col("concept"), F.lit(True))
        for more in (plain("frames", F.col("concept"), numbered), plain("non_sense_frames", without_sense(F.col("concept")), numbered), of(":polarity", "negations"), of(":wiki", "wikification"), of(":name", "named_entities"), every):
            out = out.unionByName(more)
        return out.distinct()

    both = sets(gold).withColumn("g", F.lit(1)).join(dealt(sets(pred).withColumn("p", F.lit(1))), ["graph_id", "score", "item"], "full")
    sums = both.groupBy("score").agg(F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("matched"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    return sums.withColumn("f1", F.round(f1(F.col("matched"), F.col("n_pred") - F.col("matched"), F.col("n_gold") - F.col("matched")), 8))


def rule_breakdown(rows: DataFrame, rule: str, gold: str, output: str, label: str) -> DataFrame:
    """Per rule: items, items without gold, exact matches, and what the judge said."""
    g, o = F.col(gold), F.col(output)
    return rows.groupBy(rule).agg(F.count("*").alias("total"), F.count_if(g.isNull()).alias("no_gold"), F.count_if(F.coalesce(g == o, F.lit(False))).alias("exact"), F.count_if(F.col(label) == EQ).alias("judged_eq"), F.count_if(F.col(label) == NEQ).alias("judged_neq"))


def judged_coverage(items: DataFrame, verdicts: DataFrame, keys: list[str], group: list[str], has_output: Column) -> DataFrame:
    """Coverage and quality of candidates left-joined with verdicts; items without a verdict are ``no_judgment``."""
    rows = items.join(verdicts, keys, "left").withColumn("_out", has_output)
    some, calm = F.col("_out") & F.col("majority").isNotNull(), F.col("_out") & ~F.coalesce("needs_review", F.lit(False))
    out = rows.groupBy(*group).agg(F.count("*").alias("n_total"), F.count_if("_out").alias("with_output"), F.count_if(calm & (F.col("majority") == EQ)).alias("eq"), F.count_if(calm & (F.col("majority") == NEQ)).alias("neq"), F.count_if(some & F.col("needs_review")).alias("pending"), F.count_if(F.col("_out") & F.col("majority").isNull()).alias("no_judgment"))
    return out.withColumns({"coverage": F.round(zero_guard(F.col("with_output"), F.col("n_total")), 8), "quality": F.round(zero_guard(F.col("eq"), F.col("eq") + F.col("neq")), 8), "overall": F.round(zero_guard(F.col("eq"), F.col("n_total")), 8)})


def label_statistics(rows: DataFrame, keys: list[str], aspects: str) -> DataFrame:
    """Of rows with a map of labels: (value, n) over all maps."""
    return rows.select(F.explode(F.map_values(aspects)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
