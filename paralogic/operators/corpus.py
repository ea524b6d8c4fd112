"""Corpus measures: diversity, near-duplicate rate, first-seen rows, splits, vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, ngrams, normalize, sentences, tokenize
from ..llm.common import discard, release_spent, small_batches, stored
from .lineage import cut

#: Longs of parity bits of a token set.
PARITIES = 16
#: Tokens that are numbered by rarity at most; rarer ones keep their hash.
LISTED = 500_000
#: Shares of the tokens that are shuffled one after the other.
PASSES = 8


def first_seen_sentences(docs: DataFrame, least: int = 5) -> DataFrame:
    """(sentence, doc_id, pos): each sentence of ``least`` characters or more where it stands first."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence")).filter(F.length("sentence") >= least)
    return rows.groupBy("sentence").agg(F.min(F.struct("doc_id", "pos")).alias("f")).select("sentence", "f.doc_id", "f.pos")


def diversity(docs: DataFrame, group: str) -> DataFrame:
    """Per group: texts, mean tokens, type-token ratio, distinct-2.

    Texts are read and tokenised once: tokens and bigrams leave as one tagged array, and
    texts and tokens are counted from the same rows. Distinct counts are two-step
    aggregates, so no task holds a group's vocabulary."""
    rows = docs.select(F.col(group).alias("grp"), tokenize(F.col("text")).alias("tokens"))
    tagged = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    whole = F.array(F.struct(F.lit("0").alias("kind"), F.lit("").alias("item")))  # one for each text
    items = rows.select("grp", F.explode(F.concat(whole, tagged("1", F.col("tokens")), tagged("2", ngrams(F.col("tokens"), 2)))).alias("x")).select("grp", "x.*")
    seen = items.groupBy("grp", "kind", "item").agg(F.count("*").alias("n")).groupBy("grp", "kind").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"))
    wide = seen.groupBy("grp").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in "012" for c in ("distinct", "total")))
    ratio = lambda k: F.round(F.col(f"distinct{k}") / F.greatest(F.col(f"total{k}"), F.lit(1)), 8)
    return wide.select("grp", F.col("total0").alias("n_texts"), F.round(F.col("total1") / F.col("total0"), 8).alias("avg_tokens"), ratio("1").alias("ttr"), ratio("2").alias("distinct_2"))


def distinct_ngrams(docs: DataFrame, n: int) -> DataFrame:
    """(distinct, total, ratio) of word n-grams over all texts."""
    grams = docs.select(F.explode(ngrams(tokenize(F.col("text")), n)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    return grams.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("c"), F.lit(0)).alias("total")).withColumn("ratio", F.round(F.col("distinct") / F.greatest("total", F.lit(1)), 8))


def listed_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, their ranks by rarity, seed) of the most frequent tokens, ``LISTED`` at most.

    A token's hash has 63 bits; the seed is the first one under which a second, independent
    hash finds no two tokens of one hash, so equal hashes are equal tokens."""
    for seed in count():
        # an inner explode, or a filter on sizes, would make Spark cut every text into tokens twice
        items = docs.select(F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("item")).filter("item is not null").select(token_hash(F.col("item"), seed).alias("h"), F.xxhash64(F.lit("second"), "item").alias("other"))
        counted = items.groupBy("h").agg(F.count("*").alias("df"), F.min("other").alias("x"), F.max("other").alias("y"))
        often = stored(counted.filter("df > 1").select("h", "df", (F.col("x") != F.col("y")).alias("clash")), "often")  # two tokens of one hash count as two
        if often.filter("clash").isEmpty():
            break
        discard(often)
    least, n = 2, 0
    for r in often.groupBy(F.least("df", F.lit(100_000)).alias("df")).count().orderBy(F.desc("df")).collect():  # 100,000 rows at most
        n += r["count"]
        if n > LISTED:
            least = r["df"] + 1
            break
    rows = often.filter(F.col("df") >= least).select("h", "df").toArrow()
    discard(often)
    hashes, df = (rows.column(k).to_numpy().astype(np.int64) for k in range(2))
    ranks = np.empty(len(hashes), np.int64)
    ranks[np.lexsort((hashes, df))] = np.arange(len(hashes))
    by_hash = np.argsort(hashes)
    return hashes[by_hash], ranks[by_hash], seed


def token_hash(token: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), token), 1)


def numbered_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, ids, parity0, ...) of the token sets that are not empty: ids ascend from rare to frequent.

    A listed token's id is its rank, another one's is its hash less 2 ** 63. The list bears on
    speed only: any one order of the tokens loses no pair."""
    hashes, ranks, seed = listed_tokens(docs)
    items = docs.select("doc_id", F.array_sort(F.array_distinct(tokenize(F.col("text")))).alias("items"))
    # tokens hold no white space, so equal digests are equal sets
    hashed = items.select("doc_id", F.unhex(F.sha2(F.array_join("items", " "), 256)).alias("digest"), F.transform("items", lambda t: token_hash(t, seed)).alias("h"))
    names = [f"parity{k}" for k in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            column = batch.column(2)
            h, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            ids = h + np.iinfo(np.int64).min
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ids = np.where(hashes[at] == h, ranks[at], ids)
            ids = ids[np.lexsort((ids, owner))]
            bits = np.bincount(owner * 64 * PARITIES + h % (64 * PARITIES), minlength=len(size) * 64 * PARITIES).astype(np.uint8) & 1
            parity = np.packbits(bits, bitorder="little").view("<i8").reshape(len(size), PARITIES)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), lists, *(pa.array(parity[:, k]) for k in range(PARITIES))], names=["doc_id", "digest", "size", "ids", *names])

    kind = dict(items.dtypes)["doc_id"]
    with small_batches(docs.sparkSession):
        return stored(hashed.mapInArrow(run, f"doc_id {kind}, digest binary, size long, ids array<long>" + "".join(f", {c} long" for c in names)), "sets")


def met_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """(no_a, no_b), no_a < no_b: pairs of a token whose sizes, places and parities allow the threshold.

    ``entries``: id, no, size, left, parity0, ... A token's members stream through a task in order of size;
    all members are compared at once with those that stand 1, 2, ... places after them, until sizes end it."""

    def compare(m: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, d, parts, n = np.arange(m.shape[1]), 0, [], 0
        while len(at):
            d += 1
            at = at[at + d < m.shape[1]]
            at = at[(m[0, at] == m[0, at + d]) & (m[2, at] >= m[2, at + d] * threshold - 1e-9)]
            to = at + d
            total = m[2, at] + m[2, to]
            needed = total * (threshold / (1 + threshold)) - 1e-9
            fits = (np.minimum(m[3, at], m[3, to]) >= needed) & (m[1, at] != m[1, to])
            x, y, most = at[fits], to[fits], (total - 2 * needed)[fits]
            fits = sum(np.bitwise_count((m[k, x] ^ m[k, y]).view(np.uint64)).astype(np.int64) for k in range(4, 4 + PARITIES)) <= most
            parts.append(np.stack([m[1, x[fits]], m[1, y[fits]]]))
            n += parts[-1].shape[1]
            if n > 200_000 or not len(at):
                both = np.sort(np.concatenate(parts, axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["no_a", "no_b"])
                parts, n = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4 + PARITIES, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if last:
                yield from compare(held[:, :last])
                held = held[:, last:]
        yield from compare(held)

    dealt = entries.repartition("id").sortWithinPartitions("id", "size")
    return dealt.mapInArrow(run, "no_a long, no_b long").distinct()


def nearest_classes(docs: DataFrame, thresholds: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, no, cls) of the classes of equal token sets, and (no, other0, other1, ...): for each threshold the
    smallest class whose Jaccard with this one reaches it; a class has a number and is named by its smallest doc_id.

    Classes meet by prefix filter: sets as similar share one of their rarest
    size - ceil(t * size) + 1 tokens. A meeting counts if sizes and the tokens left
    after its place still allow the overlap; the first token two alike sets share
    always does, so no pair is lost. A meeting also ends where the sets' parities (for
    each of 1024 hash values, whether an odd number of tokens has it) differ in more bits
    than alike sets differ in tokens, so whole sets are joined to few pairs. Tokens are
    numbers before anything is shuffled, and meet in ``PASSES`` shares, each shuffled when
    the one before is deleted: disk holds the numbered sets and a share."""
    spark, threshold = docs.sparkSession, min(thresholds)
    sets = numbered_sets(docs)
    release_spent(spark)
    classes = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("cls")).withColumn("no", F.monotonically_increasing_id()), "classes")
    members = stored(sets.select("doc_id", "digest").join(classes, "digest").select("doc_id", "no", "cls"), "members")
    parities = [f"parity{k}" for k in range(PARITIES)]
    # a row repeated as it is stands here as often; its pairs are the same
    ranked = stored(sets.withColumnRenamed("doc_id", "cls").join(classes, ["digest", "cls"]).select("no", "cls", "size", "ids", *parities), "ranked")
    discard(sets)
    discard(classes)
    release_spent(spark)
    length = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    prefix = ranked.select("no", "size", *parities, F.posexplode(F.slice("ids", F.lit(1), length)).alias("at", "id")).select("id", "no", "size", (F.col("size") - F.col("at")).alias("left"), *parities)
    shares = []
    for k in range(PASSES):
        shares.append(stored(met_pairs(prefix.filter(F.pmod(F.xxhash64("id"), F.lit(PASSES)) == k), threshold), "pairs"))
        release_spent(spark)
    pairs = stored(reduce(DataFrame.union, shares).distinct(), "met")
    for share in shares:
        discard(share)
    release_spent(spark)
    left, right = (ranked.select(F.col("no").alias(f"no_{x}"), F.col("cls").alias(f"cls_{x}"), F.col("ids").alias(f"ids_{x}")) for x in "ab")
    found, runs = [], 1 + pairs.count() // max(1, ranked.count())  # a run shuffles about as many sets as there are
    for k in range(runs):
        share = pairs.filter(F.pmod(F.xxhash64("no_a"), F.lit(runs)) == k)
        scored = share.join(left, "no_a").join(right, "no_b").select("no_a", "no_b", "cls_a", "cls_b", F.size(F.array_intersect("ids_a", "ids_b")).alias("both"), (F.size("ids_a") + F.size("ids_b")).alias("sum"))
        scored = scored.select("no_a", "no_b", "cls_a", "cls_b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("alike")).filter(F.col("alike") >= threshold)
        found.append(stored(scored, "alike"))
        release_spent(spark)
    discard(ranked)
    discard(pairs)
    sides = reduce(DataFrame.union, found).select("alike", F.explode(F.array(F.struct(F.col("no_a").alias("no"), F.col("cls_b").alias("other")), F.struct(F.col("no_b").alias("no"), F.col("cls_a").alias("other")))).alias("s")).select("alike", "s.*")
    nearest = sides.groupBy("no").agg(*(F.min(F.when(F.col("alike") >= t, F.col("other"))).alias(f"other{k}") for k, t in enumerate(thresholds)))
    return members, nearest


def near_duplicate_rate(docs: DataFrame, thresholds: tuple[float, ...] = (0.8, 0.7)) -> DataFrame:
    """(threshold, n_dup, n_docs, rate): documents whose token set has Jaccard >= threshold with some earlier one that is
    not empty; empty documents count in the denominator."""
    total = docs.agg(F.count("*").alias("n_docs"))
    members, nearest = nearest_classes(docs, thresholds)
    # a copy follows its class's first; another class counts if its first document is earlier than this one
    hit = lambda k: F.coalesce((F.col("doc_id") > F.col("cls")) | (F.col(f"other{k}") < F.col("doc_id")), F.lit(False))
    counts = members.join(nearest, "no", "left").agg(*(F.count_if(hit(k)).alias(f"n{k}") for k in range(len(thresholds))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("n_dup")) for k, t in enumerate(thresholds))))
    return counts.join(F.broadcast(total)).select("n_docs", rows.alias("r")).select("r.threshold", "r.n_dup", "n_docs", F.round(F.col("r.n_dup") / F.greatest("n_docs", F.lit(1)), 8).alias("rate"))


def exact_rank(rows: DataFrame, key: Column, *ties: str) -> DataFrame:
    """Add ``rank`` (from 1) in order of a uniform hex ``key``, then ``ties``, without a window over all rows:
    rows are ranked inside one of 4096 key ranges, whose counts add up to the range's offset."""
    keyed = rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # 4096 rows at most
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", *ties))
    return keyed.withColumn("_in", inside).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + F.col("_in")).drop("_key", "_range", "_n", "_before", "_in")


def split(rows: DataFrame, id_col: str, seed: str, cuts: list[tuple[str, float]], rest: str) -> DataFrame:
    """Add ``split``: exact sizes floor(n * share), in order of md5 of seed and id."""
    ranked = exact_rank(rows, F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), id_col)
    ranked = ranked.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    label, upto = None, F.lit(0)
    for name, share in cuts:
        upto = upto + F.floor(F.col("_n") * F.lit(share))
        label = F.when(F.col("rank") <= upto, name) if label is None else label.when(F.col("rank") <= upto, name)
    return ranked.withColumn("split", label.otherwise(rest)).drop("_n", "rank")


def quartiles(values: DataFrame, column: str, ranges: int = 1024) -> DataFrame:
    """(n, mean, q1, q3): values at index n // 4 and 3 n // 4 of the sorted list, without interpolation; for values in 0 .. 1.

    Equal values are counted first. The count of each of ``ranges`` value ranges says in
    which one an index falls; running sums are over ranges, and inside one range."""
    counts = cut(values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c")).withColumn("_range", F.floor(F.col(column) * ranges)))
    totals = values.agg(F.count("*").alias("n"), F.round(F.avg(column), 8).alias("mean"))
    sums = counts.groupBy("_range").agg(F.sum("c").alias("_c"))
    before = sums.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))  # a row a range
    upto = counts.join(F.broadcast(before), "_range").withColumn("u", F.col("_before") + F.sum("c").over(Window.partitionBy("_range").orderBy(column)))
    at = lambda k: F.min(F.when(F.col("u") > F.floor(F.col("n") * k / 4), F.col(column)))
    return upto.join(F.broadcast(totals)).groupBy("n", "mean").agg(at(1).alias("q1"), at(3).alias("q3"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, jaccard): each user turn with the assistant turn that follows it."""
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    reply = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard(tokenize(F.col("a")), tokenize(F.col("b"))), 8).alias("jaccard"))


def held_out(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(sentence): distinct sentences of documents that are no sentence of the benchmark."""
    pick = lambda df: df.select(F.explode(sentences(F.col("text"))).alias("s")).select(normalize(F.col("s")).alias("sentence")).filter("sentence <> ''")
    return pick(docs).distinct().join(pick(benchmark).distinct(), "sentence", "left_anti")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n): tokens and their counts."""
    return docs.select(F.explode(tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def character_vocabulary(docs: DataFrame) -> DataFrame:
    """(ch, n): characters, each weighted by the count of its tokens."""
    return vocabulary(docs).select(F.explode(F.split("token", "")).alias("ch"), "n").filter("ch <> ''").groupBy("ch").agg(F.sum("n").alias("n"))


def oversample_negatives(labels: DataFrame, k: int = 2, seed: str = "neg") -> DataFrame:
    """Positives and, for each, ``k`` negatives drawn with replacement by hash, cut to the number of rows.

    Returns (ord, doc_id, quality, drawn)."""
    negatives = exact_rank(labels.filter("quality = 0").select("doc_id"), F.md5(F.col("doc_id").cast("string")), "doc_id").select(F.col("doc_id").alias("neg_id"), F.col("rank").alias("at"))
    total = F.broadcast(labels.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("m")))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "doc_id", "j")), 1, 13), 16, 10).cast("long")
    picks = labels.filter("quality = 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")).crossJoin(total).filter("m > 0").withColumn("at", drawn % F.col("m") + 1)
    rows = picks.join(negatives, "at").select(F.col("neg_id").alias("doc_id"), F.lit(0).alias("quality"), F.concat_ws("|", F.lit(seed), "doc_id", "j").alias("tag"))
    rows = rows.unionByName(labels.filter("quality = 1").select("doc_id", F.lit(1).alias("quality"), F.concat_ws("|", F.lit("pos"), F.col("doc_id")).alias("tag")))
    return exact_rank(rows, F.md5("tag"), "tag").join(total, F.col("rank") <= F.col("n")).select(F.col("rank").alias("ord"), "doc_id", "quality")


def bleu_clipped(pairs: DataFrame, n: int) -> DataFrame:
    """(matched, total): clipped n-gram counts of columns cand against ref, summed over rows of column id."""
    side = lambda c: pairs.select("id", F.explode(ngrams(tokenize(F.col(c)), n)).alias("g")).groupBy("id", "g").agg(F.count("*").alias(c))
    both = side("cand").join(side("ref"), ["id", "g"], "left")
    return both.agg(F.sum(F.least("cand", F.coalesce("ref", F.lit(0)))).alias("matched"), F.sum("cand").alias("total"))
