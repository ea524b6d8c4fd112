"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints link at
``radius`` or fewer differing bits. Bits that agree with one another are grouped
into partitions; thresholds per partition, which sum to radius - partitions + 1
(-1: the partition is not probed), come from a dynamic programme over candidate
counts of all fingerprints. Any linking pair is within the threshold on one of
the partitions, so probing these keys and verifying whole fingerprints loses
none. Exact copies share a fingerprint and are collapsed before any probing.

Scale: what is shuffled is a few (key, fingerprint) rows for each *distinct*
fingerprint. A key's members are compared in blocks inside a task and leave as
star edges, one for each member at most, never as pairs. Keys with more than
``HOT`` members are split again by the pigeonhole over their other bits, and
what is still larger is dealt as pairs of blocks, so no task holds more than two
blocks of a key.

Defined results: null and empty texts (and texts without a word) have
fingerprint zero and link like any other; texts shorter than a shingle are one
shingle; repeated rows each stay a row; a null doc_id never names a component,
unless all its members are null; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, cut, discard, free_name, release_spent, small_batches, stored, table, with_place
from .shingle_links import frequent_shingles, linked_rows, prefixes

BITS = 64
#: Members of a probe key above which the key is split.
HOT = 2000
#: Hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half of the shingles' XXH64 have it."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, *carry): one row for each input row; fp is the fingerprint as a signed long."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *(batch.column(2 + k) for k in range(len(carry)))], names=["doc_id", "fp", *carry])

    extra = "".join(f", {c} {dict(picked.dtypes)[c]}" for c in carry)
    return picked.mapInArrow(run, f"doc_id long, fp long{extra}")


# ---------------------------------------------------------------- the plan


def bit_agreement(fps: DataFrame) -> np.ndarray:
    """How often each two bits are equal, over all fingerprints (64 x 64 counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view("<u8")
            bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            signs = 2 * bits - 1
            total += np.rint(signs.T @ signs).astype(np.int64)
        ij = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(ij), pa.array(total.ravel())], names=["ij", "n"])

    rows = fps.select("fp").mapInArrow(run, "ij long, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:  # 4096 rows at most
        out[r["ij"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(agreement: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of even size; each takes the bits that correlate most with it."""
    strength = np.abs(agreement).astype(float)
    np.fill_diagonal(strength, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds, one for each partition, of least summed cost and sum ``total``.

    ``costs[i][t + 1]`` is the cost of threshold t (from -1) of partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, picks) in best.items():
            for t in range(-1, len(row) - 1):
                entry = (cost + row[t + 1], [*picks, t])
                if spent + t not in step or entry < step[spent + t]:
                    step[spent + t] = entry
        best = step
    return best[total][1]


def plan(fps: DataFrame, n: int, radius: int = 3, most: int = 1) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the partitions to probe.

    Collisions of every partition are counted over all fingerprints; the count
    for threshold 1 follows from them and each bit's share of ones. The numbers
    of partitions tried are those from which thresholds 0 and 1 suffice."""
    agreement = bit_agreement(fps)
    pairs = max(1.0, float(n) * n)
    # P(two fingerprints differ in bit b) needs the share of ones; take it from all rows too
    ones = fps.agg(*(F.sum(F.shiftright(F.col("fp"), b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS))).first()
    share = np.array([float(ones[f"b{b}"] or 0) for b in range(BITS)]) / max(1, n)
    differ = np.clip(2 * share * (1 - share), 0.0, 0.98)
    tried = [m for m in range(2, radius + 2) if radius - m + 1 <= m * most]
    groups = {m: group_bits(agreement, m) for m in tried}
    keyed = F.explode(F.array(*(F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for m in tried for i, g in enumerate(groups[m]))))
    same = fps.select(keyed.alias("k")).select("k.*").groupBy("part", "key").agg(F.count("*").cast("double").alias("c"))
    counted = {r["part"]: r["s"] for r in same.groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s")).collect()}
    options = []
    for m in tried:
        costs = []
        for i, g in enumerate(groups[m]):
            zero = counted.get(m * 100 + i, 0.0)
            spread = float(sum(differ[b] / (1 - differ[b]) for b in g))
            near = zero * spread + pairs / 2.0 ** (len(g) + 1) * len(g)
            # a row for each fingerprint and probe, and a comparison for each candidate
            costs.append([0.0, 4.0 * n + zero, 4.0 * n * (1 + len(g) / 2) + zero + near][: most + 2])
        picks = allocate(costs, radius - m + 1)
        options.append((sum(c[t + 1] for c, t in zip(costs, picks)), m, [(g, t) for g, t in zip(groups[m], picks) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


# ---------------------------------------------------------------- probing


def probes(fps: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): a fingerprint's own keys, and for threshold 1 neighbouring keys.

    A probe sets a bit that is clear, so two keys that differ in one bit meet once."""
    rows = []
    for i, (bits, threshold) in enumerate(planned):
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        rows.append(F.array(F.struct(F.lit(i).alias("part"), own.alias("key"))))
        if threshold >= 1:
            near = F.array(*(F.struct(F.lit(i).alias("part"), own.bitwiseOR(F.lit(mask_of([b]))).alias("key")) for b in bits))
            rows.append(F.filter(near, lambda s: s["key"] != F.col("fp").bitwiseAND(F.lit(mask_of(bits)))))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("k")).select("k.part", "k.key", "fp")


def split_hot(rows: DataFrame, planned: list[tuple[list[int], int]], radius: int, hot: int) -> DataFrame:
    """(bucket columns, fp) whose buckets are small enough for a task.

    Level 1: keys with more than ``hot`` members. Level 2: within them, members
    that link agree on one of radius + 1 groups of the other bits. Level 3: what
    is still larger is cut into blocks, and each pair of blocks is a bucket."""
    rows = rows.withColumns({"sub": F.lit(-1), "subkey": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")})
    large = cut(rows.groupBy("part", "key").agg(F.count("*").alias("size")).filter(F.col("size") > hot))
    if large.isEmpty():
        return rows
    rows = _mark(rows, large, ["part", "key"])
    calm = rows.filter(F.col("size").isNull()).drop("size")
    subkeys = []
    for i, (bits, _) in enumerate(planned):
        rest = [b for b in range(BITS) if b not in bits]
        groups = [rest[len(rest) * k // (radius + 1) : len(rest) * (k + 1) // (radius + 1)] for k in range(radius + 1)]
        subkeys.append(F.when(F.col("part") == i, F.array(*(F.struct(F.lit(k).alias("sub"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("subkey")) for k, g in enumerate(groups)))))
    again = rows.filter(F.col("size").isNotNull()).select("part", "key", "fp", "cell", F.explode(F.coalesce(*subkeys)).alias("s")).select("part", "key", "fp", "s.sub", "s.subkey", "cell")
    still = cut(again.groupBy("part", "key", "sub", "subkey").agg(F.count("*").alias("size")).filter(F.col("size") > hot))
    out = calm.unionByName(again) if still.isEmpty() else None
    if out is not None:
        return out
    again = _mark(again, still, ["part", "key", "sub", "subkey"])
    blocks = F.ceil(F.col("size") / F.lit(hot)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), blocks)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(j, mine) * blocks + F.greatest(j, mine))
    dense = again.filter(F.col("size").isNotNull()).withColumn("cell", F.explode(cells))
    return calm.unionByName(again.filter(F.col("size").isNull()).drop("size")).unionByName(dense.drop("size"))


def _mark(rows: DataFrame, large: DataFrame, keys: list[str], bound: int = 20_000) -> DataFrame:
    """Join the sizes of large keys: broadcast while they are few, which their lower size bound makes likely."""
    few = large.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(large) if few else large, keys, "left")


BUCKET = ["part", "key", "sub", "subkey", "cell"]


def star(members: np.ndarray, radius: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, the first one that reaches it inside this bucket) of its linking pairs.

    A breadth-first search: each member is compared once with those not reached yet.
    With ``direct`` an edge's second end is the one it was compared with, within the radius itself."""
    rest = np.unique(members).view(np.uint64)
    ends, roots = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                ends.append(found)
                roots.append(np.full(len(found), one if direct else root))
    if not ends:
        return members[:0], members[:0]
    return np.concatenate(ends).view(np.int64), np.concatenate(roots).view(np.int64)


def links(buckets: DataFrame, radius: int, direct: bool = False) -> DataFrame:
    """(a, b): edges of every bucket (``star``); buckets meet in a partition, sorted, and stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.empty((0, len(BUCKET)), np.int64)
        fp = np.empty(0, np.int64)

        def edges(fp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            found = [star(fp[a:b], radius, direct) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
            left = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
            right = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(BUCKET) + 1)]
            keys = np.concatenate([keys, np.stack(columns[: len(BUCKET)], axis=1)])
            fp = np.concatenate([fp, columns[-1]])
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(change):
                last = change[-1]
                yield edges(fp, np.concatenate([[0], change]))
                keys, fp = keys[last:], fp[last:]
        if len(fp):
            yield edges(fp, np.array([0, len(fp)]))

    dealt = buckets.select(*BUCKET, "fp").repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): connected components by least label, with pointer jumping.

    Every round is a join and a min aggregate over all edges, checkpointed; the
    rounds grow with the logarithm of the longest chain."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("fp")).agg(F.least(F.min("v"), F.col("fp")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("fp", "v"), "v").select(F.col("u").alias("fp"), "root")
        least = labels.unionByName(heard).groupBy("fp").agg(F.min("root").alias("root"))
        up = labels.select(F.col("fp").alias("root"), F.col("root").alias("above"))
        jumped = least.join(up, "root", "left").select("fp", F.least("root", F.coalesce("above", "root")).alias("root"))
        before, labels = labels, cut(jumped)
        moved = labels.join(before.withColumnRenamed("root", "old"), "fp").filter(F.col("root") != F.col("old"))
        if moved.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that is reachable, for every row of ``docs``."""
    rows = cut(fingerprints(docs, words, seed, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    return assign(rows, distinct, radius, hot)


def assign(rows: DataFrame, distinct: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Component ids of rows with fingerprints; ``distinct`` has each fingerprint once with its smallest id."""
    n = distinct.count()
    if n < 2:
        return rows.join(F.broadcast(distinct), "fp", "left").select("doc_id", "fp", F.col("least_id").alias("component_id"))
    planned = plan(distinct.select("fp"), n, radius)
    buckets = split_hot(probes(distinct.select("fp"), planned), planned, radius, hot)
    edges = cut(links(buckets, radius).distinct())
    roots = distinct.join(components(edges), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = cut(roots)
    smallest = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = cut(roots.join(smallest, "root").select("fp", "component_id"))
    # rows of one fingerprint can be a third of all: a plain join, whose large partitions Spark splits
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits().alias("fingerprint"), "component_id")


#: Differing bits up to which the pipeline's stage looks for near copies by fingerprint.
STAGE_RADIUS = 6


def near_rows(once: DataFrame, radius: int = STAGE_RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b): pairs of rows (row, fp) with equal fingerprints or fingerprints within the radius, as spanning edges
    of each probe key's group: the row of a fingerprint is its first, its other rows follow that one."""
    fps = cut(once.groupBy("fp").agg(F.min("row").alias("first")))
    same = once.join(fps, "fp").filter("row > first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    n = fps.count()
    if n < 2:
        return same
    planned = plan(fps.select("fp"), n, radius)
    found = cut(links(split_hot(probes(fps.select("fp"), planned), planned, radius, hot), radius, True).distinct())
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("first").alias(f"row_{c}"))
    met = found.join(side("a"), "a").join(side("b"), "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    return same.union(met).distinct()


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one of smallest doc_id; all columns stay.

    Documents link at a Jaccard coefficient of 0.8 or more of their five-word
    shingles; op7's three words and 3 bits do not bind here. SimHashes of these
    shingles, probed by the generalised pigeonhole principle, find near copies, and
    each pair found is verified; links between texts whose fingerprints differ in
    more than ``STAGE_RADIUS`` bits follow by exact prefixes (``shingle_links``).
    Rows are told apart by their place in the stored input, which stays the same
    after an executor is lost; of repeated rows one stays. No copy of the texts is
    written: only the numbers of kept rows meet them again, in one join. Texts go to
    Python in small batches, since buffers beside the heap count as an executor's memory too."""
    bound_batches(spark)
    release_spent(spark)  # of the stage before, which trains in the driver
    name = free_name(docs, "_row")
    placed = with_place(docs, name)
    texts = placed.select("doc_id", F.col(name).alias("_row"), "text")
    frequent = frequent_shingles(texts)
    release_spent(spark)
    with small_batches(spark):
        rows = stored(prefixes(texts, frequent), "prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = cut(rows.groupBy("digest").agg(first).select("first", F.col("first.row").alias("row")))
    once = stored(rows.join(distinct.select("row"), "row", "left_semi").select("row", "fp", "size", "known", "keys"), "distinct")
    discard(rows)
    del rows
    release_spent(spark)
    near = near_rows(once.select("row", "fp"))
    release_spent(spark)
    roots = linked_rows(once, texts, near, components)
    release_spent(spark)
    named = distinct.join(roots, "row", "left").groupBy(F.coalesce("root", "row")).agg(F.min("first").alias("first"))
    kept = cut(named.select(F.col("first.row").alias(name)))
    discard(once)
    return placed.join(kept, name, "left_semi").select(*docs.columns)
