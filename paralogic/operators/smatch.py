"""Smatch: the most triples two graphs can share under a mapping of their variables.

The mapping is searched by hill climbing from a start that pairs equal concepts and
from seeded random ones; a search can miss the best mapping, so a score is a lower
bound. Graph pairs are searched in Arrow batches, a pair at a time; sums and ratios
are aggregates. Defined results: null or empty graphs have no triples; repeated
triples count once."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import f1
from ..functions.text import zero_guard

RESTARTS = 4
Triple = tuple[str, str, str]


def without_senses(graph: list[Triple]) -> list[Triple]:
    return [(s, r, re.sub(r"-\d+$", "-01", t) if r == ":instance" else t) for s, r, t in graph]


def without_labels(graph: list[Triple]) -> list[Triple]:
    return [(s, r if r == ":instance" else ":label", t) for s, r, t in graph]


def reentrant(graph: list[Triple]) -> list[Triple]:
    """Instances and relations of variables that more than one edge reaches."""
    variables = {s for s, r, _ in graph if r == ":instance"}
    edges = [t for t in graph if t[1] != ":instance" and t[2] in variables]
    often = {t[2] for t in edges if sum(e[2] == t[2] for e in edges) > 1}
    kept = [t for t in edges if t[2] in often]
    ends = {x for t in kept for x in (t[0], t[2])}
    return [t for t in graph if t[1] == ":instance" and t[0] in ends] + kept


def arguments(graph: list[Triple]) -> list[Triple]:
    """Instances and numbered arguments of frames."""
    kept = [t for t in graph if t[1].startswith(":ARG")]
    ends = {x for t in kept for x in (t[0], t[2])}
    return [t for t in graph if t[1] == ":instance" and t[0] in ends] + kept


VARIANTS = {"smatch": lambda g: g, "unlabeled": without_labels, "no_wsd": without_senses, "reentrancies": reentrant, "srl": arguments}


def shared(pred: set[Triple], gold: set[Triple], own: list[str], other: list[str], mapping: dict[str, str | None]) -> int:
    named = set(own)
    to = lambda x: mapping.get(x) if x in named else x
    return sum((to(s), r, to(t)) in gold for s, r, t in pred if to(s) is not None and to(t) is not None)


def best_match(pred: list[Triple], gold: list[Triple], restarts: int = RESTARTS, seed: int = 7) -> int:
    """Number of triples shared under the best mapping found; deterministic."""
    a, b = set(pred), set(gold)
    own, other = sorted({s for s, r, _ in a if r == ":instance"}), sorted({s for s, r, _ in b if r == ":instance"})
    # variables are kept apart from values of the same name
    mark = lambda side, names, tag: {(tag + s if s in names else s, r, tag + t if t in names and r != ":instance" else t) for s, r, t in side}
    a, b = mark(a, set(own), "\x01"), mark(b, set(other), "\x02")
    own, other = ["\x01" + x for x in own], ["\x02" + x for x in other]
    words = {s: t for s, r, t in b if r == ":instance"}
    best, rng = 0, random.Random(seed)
    for k in range(restarts + 1):
        free, mapping = list(other), {}
        if k:
            rng.shuffle(free)
        for s, r, t in sorted(a):
            if r == ":instance" and s not in mapping:
                same = [x for x in free if words.get(x) == t]
                if same or k:
                    mapping[s] = (same or free or [None])[0]
                    if mapping[s] in free:
                        free.remove(mapping[s])
        score = shared(a, b, own, other, mapping)
        while True:
            step, found = score, None
            for i, x in enumerate(own):
                used = {v for key, v in mapping.items() if key != x}
                tries = [{**mapping, x: y} for y in other if y not in used and y != mapping.get(x)]
                tries += [{**mapping, x: mapping.get(y), y: mapping.get(x)} for y in own[i + 1 :]]
                for t in tries:
                    n = shared(a, b, own, other, t)
                    if n > step:
                        step, found = n, t
            if found is None:
                break
            score, mapping = step, found
        best = max(best, score)
    return best


def pair_scores(pairs: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """(graph_id, variant, matched, n_pred, n_gold) of pairs (graph_id, pred, gold) of packed graphs."""
    names = variants or list(VARIANTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for graph_id, *sides in zip(*(batch.column(k).to_pylist() for k in range(3))):
                graphs = [[(t["source"], t["role"], t["target"]) for t in side or []] for side in sides]
                for name in names:
                    p, g = (list(dict.fromkeys(VARIANTS[name](x))) for x in graphs)
                    rows.append((graph_id, name, best_match(p, g), len(p), len(g)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["graph_id", "variant", "matched", "n_pred", "n_gold"])

    return pairs.select(F.col("graph_id").cast("string").alias("graph_id"), "pred", "gold").mapInArrow(run, "graph_id string, variant string, matched long, n_pred long, n_gold long")


def corpus_scores(pairs: DataFrame, variants: list[str] | None = None) -> DataFrame:
    """(variant, precision, recall, f1) from summed counts."""
    sums = pair_scores(pairs, variants).groupBy("variant").agg(*(F.sum(c).alias(c) for c in ("matched", "n_pred", "n_gold")))
    m, p, g = (F.col(c) for c in ("matched", "n_pred", "n_gold"))
    return sums.select("variant", F.round(zero_guard(m, p), 8).alias("precision"), F.round(zero_guard(m, g), 8).alias("recall"), F.round(f1(m, p - m, g - m), 8).alias("f1"))
