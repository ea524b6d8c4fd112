"""Scores and decisions, Column to Column; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, ngrams, zero_guard


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = zero_guard(tp, tp + fp), zero_guard(tp, tp + fn)
    return zero_guard(2 * p * r, p + r)


def confidence(score: Column, threshold: float) -> Column:
    """How far a score lies from its threshold: a half at it, one at most."""
    return F.least(F.lit(1.0), 0.5 + 2 * F.abs(score - threshold))


def smatch_band(score: Column) -> Column:
    """(label, confidence) of a graph similarity: equivalent from .7, not below or at .45, unknown between."""
    label = F.when(score >= 0.7, "EQUIVALENT").when(score <= 0.45, "NOT_EQUIVALENT").otherwise("UNKNOWN")
    return F.struct(label.alias("label"), F.when(label == "EQUIVALENT", score).when(label == "NOT_EQUIVALENT", 1 - score).otherwise(0.3).alias("confidence"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / F.aggregate(logits, F.lit(0.0), lambda s, y: s + F.exp(y - top)))


def argmax(values: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sure_class(logits: Column, least: float) -> Column:
    """The first most likely class, null if its probability is below ``least``."""
    return F.when(F.array_max(softmax(logits)) >= least, argmax(logits))


def reward(first: Column, second: Column, own: Column, gold_hit: Column, abstained: Column, weights: tuple[float, ...] = (0.5, 0.3, 0.2, 0.1), abstain: float = 0.0) -> Column:
    """Weighted sum of verifier scores; missing ones add nothing, an abstention counts as ``abstain``."""
    a, b, c, d = weights
    v1 = F.when(abstained, F.lit(abstain)).otherwise(first)
    part = lambda x, w: F.coalesce(x, F.lit(0.0)) * w
    return part(v1, a) + part(second, b) + part(own, c) + F.when(gold_hit, F.lit(d)).otherwise(0.0)


def clipped(cand: Column, ref: Column, n: int) -> Column:
    """(matched, total) of n-grams of ``cand`` found in ``ref``, each as often as it stands there."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))

    def count(p: Column) -> Column:
        both = F.array_intersect(p["a"], p["b"])
        hit = F.aggregate(both, F.lit(0), lambda s, x: s + F.least(times(p["a"], x), times(p["b"], x)))
        return F.struct(hit.alias("matched"), F.size(p["a"]).alias("total"))

    return let(F.struct(ngrams(cand, n).alias("a"), ngrams(ref, n).alias("b")), count)


def sentence_bleu(cand: Column, ref: Column, order: int = 4) -> Column:
    """BLEU of token arrays, 0 to 100; orders without a match count a half, a quarter, ... (exp smoothing), orders without an n-gram end it."""
    counts = F.array(*(clipped(cand, ref, n) for n in range(1, order + 1)))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("used"), F.lit(1.0).alias("power"))

    def add(s: Column, c: Column) -> Column:
        power = F.when(c["matched"] == 0, s["power"] * 2).otherwise(s["power"])
        share = F.when(c["matched"] > 0, c["matched"] / c["total"]).otherwise(1 / (power * c["total"]))
        more = F.struct((s["total"] + F.log(share)).alias("total"), (s["used"] + 1).alias("used"), power.alias("power"))
        return F.when(c["total"] > 0, more).otherwise(s)

    brevity = F.when(F.size(cand) < F.size(ref), F.exp(1 - F.size(ref) / F.size(cand))).otherwise(1.0)
    score = lambda cs: F.when((F.size(cand) == 0) | (F.get(cs, F.lit(0))["matched"] == 0), F.lit(0.0)).otherwise(100 * brevity * F.exp(F.aggregate(cs, start, add, lambda s: s["total"] / s["used"])))
    return let(counts, score)


def rouge_n(target: Column, made: Column, n: int) -> Column:
    """F-measure of n-gram overlap of token arrays."""
    hit = clipped(made, target, n)["matched"]
    p, r = zero_guard(hit, F.size(ngrams(made, n))), zero_guard(hit, F.size(ngrams(target, n)))
    return zero_guard(2 * p * r, p + r)


def reading_ease(n_words: Column, n_sentences: Column, n_letters: Column, n_syllables: Column) -> Column:
    """Readability indices that counts alone decide, rounded; zeros without words or sentences.

    Rounded as a hundredfold double, so 8.075, which is less as a double, becomes 8.07: ``F.round(x, 2)`` rounds its decimal digits."""
    per, short = zero_guard(n_words, n_sentences), zero_guard(n_syllables, n_words)
    letters = zero_guard(n_letters, n_words)
    some = (n_words > 0) & (n_sentences > 0)
    one = lambda x: F.when(some, F.round(x * 100) / 100).otherwise(0.0)
    return F.struct(
        one(206.835 - 1.015 * per - 84.6 * short).alias("flesch"),
        one(0.39 * per + 11.8 * short - 15.59).alias("flesch_kincaid"),
        one(5.88 * letters - 29.6 * zero_guard(n_sentences, n_words) - 15.8).alias("coleman_liau"),
        one(4.71 * letters + 0.5 * per - 21.43).alias("ari"),
    )
