"""Quality rules with adaptive thresholds in place of fixed cutoffs.

Per text four counts are taken (Python, a text at a time, bounded by the text).
Ratios of them go into mergeable quantile sketches per language and source: a
high-dynamic-range histogram on integers, whose counts add up, whose bins are
exact below 1024 and have a relative width of at most 1/512 above. Quantiles of
the sketches give each group's limits; the limits are joined back and filter.

The upper limit of a metric is ``q75 + REACH * max(q75 - q25, least)``, the lower one
of word length its mirror image: far outside what the group's own middle half
spreads over, so an ordinary text is kept whatever share of its group is junk up to a
quarter, and a group whose texts vary more is given more room. ``least`` is the
smallest spread a metric can tell. No cutoff is fixed beside that.

A group's quantiles are shrunk towards its language's, and those towards all texts',
as if ``PRIOR`` texts of the wider sketch were added; so a group of a few texts leans
on its language and a large one on itself, by one rule at every size. Sketches of
languages and of all texts are sums of the groups' sketches.

Scale: texts are read once; 8 integers a text are kept in a checkpoint. Sketches
are pre-aggregated before they are shuffled, so a source with a third of all rows
costs no more than another. The limits (a row for each language and source) are
joined by ``attach``: broadcast below a checked number of rows, salted beyond.

Defined results: a null text is an empty text: no words, base_failed, not kept.
Null languages and sources are groups of their own. Repeated rows stay.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, table

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Odd multipliers of the window hash (fixed, arbitrary).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

#: Texts of the wider sketch that a group's quantiles are blended with.
PRIOR = 50
#: Spreads that a limit lies beyond the middle half.
REACH = 6
#: metric: (sides, least spread in the metric's unit).
METRICS = {
    "word_len": ("both", 20),  # hundredths of a code point a word
    "symbols": ("high", 10),  # thousandths of a symbol a word
    "dup_lines": ("high", 60),  # thousandths of duplicate lines a line
    "repeats": ("high", 30),  # thousandths of repeated words a word
}


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    m = n - width + 1
    spread = (ids + np.uint64(1)) * _MIX[0]
    spread ^= spread >> np.uint64(29)
    hashes = np.zeros(m, np.uint64)
    for k in range(width):
        hashes = hashes * _MIX[1] + (spread[k : k + m] ^ _MIX[k]) * _MIX[2]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    again = np.zeros(m, bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    # verify: windows of one hash are equal word by word, else fall back to exact keys
    a, b = order[1:][equal], order[:-1][equal]
    if any((ids[a + k] != ids[b + k]).any() for k in range(width)):
        seen: dict[tuple, int] = {}
        keys = [tuple(ids[i : i + width].tolist()) for i in range(m)]
        for key in keys:
            seen[key] = seen.get(key, 0) + 1
        again = np.fromiter((seen[key] > 1 for key in keys), bool, m)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0, 0
    letters = b"".join(words)
    chars = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
    lines, repeated = duplicate_lines(text)
    return len(words), chars, len(_SYMBOLS.findall(text)), repeated, repeat_words(words), lines


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measured(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The counts of every text beside the columns ``carry``."""
    picked = docs.select(F.col(text_col).cast("binary").alias("_text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py()) for t in batch.column(0)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=[*carry, *COUNTS])

    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} long" for c in COUNTS)]))


# ---------------------------------------------------------------- sketches


def metric_columns() -> dict[str, Column]:
    """Integer metrics of a row with words."""
    return {
        "word_len": F.expr("word_chars * 100 div n_words"),
        "symbols": F.expr("n_symbols * 1000 div n_words"),
        "dup_lines": F.expr("n_dup_lines * 1000 div n_lines"),
        "repeats": F.expr("n_repeat_words * 1000 div n_words"),
    }


def bin_of(value: Column) -> Column:
    """The sketch's bin: the value, cut to its ten leading binary digits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 10)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): mergeable, counts of equal bins add up."""
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), bin_of(v).alias("bin")) for k, v in metric_columns().items())))
    spread = rows.filter("n_words > 0").select("lang", "source", entries.alias("e")).select("lang", "source", "e.metric", "e.bin")
    return spread.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, size, q25, q75): the least bin with the share of the texts in or below it.

    A window holds the bins of one sketch, whose number the bin widths bound."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "metric")
    upto = merged.select("*", F.sum("n").over(whole.orderBy("bin")).alias("upto"), F.sum("n").over(whole).alias("size"))
    least = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("size") * q, F.col("bin")))
    return upto.groupBy(*keys, "metric").agg(F.max("size").alias("size"), least(1).alias("q25"), least(3).alias("q75"))


def shrunk(own: DataFrame, wider: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """Quantiles of ``own`` blended with those of ``prior`` texts of the wider sketch, unique in ``keys``."""
    joined = attach(own, cut(wider.select(*keys, F.col("q25").alias("w25"), F.col("q75").alias("w75"))), keys)
    blend = lambda q, w: F.expr(f"(size * {q} + {prior} * {w}) div (size + {prior})")
    return joined.withColumns({"q25": blend("q25", "w25"), "q75": blend("q75", "w75")}).drop("w25", "w75")


def limits(sketch: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high): a row for each group."""
    langs = shrunk(quantiles(sketch, ["lang"]), quantiles(sketch, []), ["metric"], prior)
    groups = shrunk(quantiles(sketch, ["lang", "source"]), langs, ["lang", "metric"], prior)
    columns = []
    for name, (sides, least) in METRICS.items():
        room = reach * F.greatest(F.col("q75") - F.col("q25"), F.lit(least))
        mine = F.col("metric") == name
        columns.append(F.max(F.when(mine, F.col("q75") + room)).alias(f"{name}_high"))
        if sides == "both":
            columns.append(F.max(F.when(mine, F.col("q25") - room)).alias(f"{name}_low"))
    return groups.groupBy("lang", "source").agg(*columns)


def judge(rows: DataFrame, found: DataFrame, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Add base_failed and kept to measured rows."""
    joined = attach(rows, found, ["lang", "source"])
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    inside = F.lit(True)
    for name, value in metric_columns().items():
        value = F.when(F.col("n_words") > 0, value)
        inside = inside & (value <= F.col(f"{name}_high"))
        if METRICS[name][0] == "both":
            inside = inside & (value >= F.col(f"{name}_low"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def adaptive_filter(docs: DataFrame, id_col: str = "doc_id", prior: int = PRIOR) -> DataFrame:
    """Measured rows of ``docs`` with their group's limits and verdicts."""
    columns = [F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text")]
    rows = cut(measured(docs.select(*columns), ["doc_id", "lang", "source"]))
    return judge(rows, cut(limits(cut(sketches(rows)), prior)))


def op3_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and verdicts of every document."""
    found = adaptive_filter(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_limits(keys: str, name: str) -> str:
    comma = f"{keys}, " if keys else ""
    part = f"partition by {comma}metric"
    return f"""
{name}_bins as (select {comma}metric, bin, count(*) n from bins group by {comma}metric, bin),
{name}_upto as (select *, sum(n) over ({part} order by bin) upto, sum(n) over ({part}) size from {name}_bins),
{name} as (select {comma}metric, max(size) size, min(bin) filter (where upto * 4 >= size) q25, min(bin) filter (where upto * 4 >= size * 3) q75
  from {name}_upto group by {comma}metric)"""


def _sql_high(name: str) -> str:
    return f"max(q75 + {REACH} * greatest(q75 - q25, {METRICS[name][1]})) filter (where metric = '{name}') {name}_high"


def _sql_blend(own: str, wider: str) -> str:
    return ", ".join(f"({own}.size * {own}.{q} + {PRIOR} * {wider}.{q})::bigint // ({own}.size + {PRIOR})::bigint {q}" for q in ("q25", "q75"))


SQL = f"""
with w as (
  select doc_id, lang, source, coalesce(text, '') t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) ls
  from documents),
windows as (select doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') g from w, unnest(range(1, len(ws) - 3)) r(i)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (select doc_id, count(distinct i + k) n from twice, range(5) r(k) group by doc_id),
m as (
  select w.doc_id, lang, source, len(ws)::bigint n_words, coalesce(length(array_to_string(ws, '')), 0)::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines
  from w left join covered using (doc_id)),
metrics as (
  select doc_id, lang, source, 'word_len' metric, word_chars * 100 // n_words v from m where n_words > 0
  union all select doc_id, lang, source, 'symbols', n_symbols * 1000 // n_words from m where n_words > 0
  union all select doc_id, lang, source, 'dup_lines', n_dup_lines * 1000 // n_lines from m where n_words > 0
  union all select doc_id, lang, source, 'repeats', n_repeat_words * 1000 // n_words from m where n_words > 0),
bins as (
  select lang, source, metric, (v >> greatest(0, length(bin(v)) - 10)::int) << greatest(0, length(bin(v)) - 10)::int bin from metrics),
{_sql_limits("lang, source", "own")},
{_sql_limits("lang", "tongue")},
{_sql_limits("", "every")},
langs as (select tongue.lang, tongue.metric, {_sql_blend("tongue", "every")} from tongue join every on tongue.metric = every.metric),
used as (
  select own.lang, own.source, own.metric, {_sql_blend("own", "langs")}
  from own join langs on own.lang is not distinct from langs.lang and own.metric = langs.metric),
lim as (
  select lang, source, {", ".join(_sql_high(k) for k in METRICS)},
    max(q25 - {REACH} * greatest(q75 - q25, {METRICS["word_len"][1]})) filter (where metric = 'word_len') word_len_low
  from used group by lang, source),
judged as (
  select m.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
    case when n_words > 0 then word_chars * 100 // n_words between word_len_low and word_len_high and n_symbols * 1000 // n_words <= symbols_high
      and n_dup_lines * 1000 // n_lines <= dup_lines_high and n_repeat_words * 1000 // n_words <= repeats_high else false end inside
  from m left join lim on m.lang is not distinct from lim.lang and m.source is not distinct from lim.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside kept from judged
"""
