"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash over the last 16 bytes of the UTF-8 text marks cut points; chunks
have ``LEAST`` to ``MOST`` bytes. Cuts follow from the bytes around them, so an
insertion shifts positions but not the cuts beyond it, and a repeated passage
yields the same chunks wherever it stands. Cuts move on to the next border between
characters, so no chunk ends inside one. Chunks are compared by a 128-bit digest: every occurrence but the first (by doc_id, then position) is a repeat.
Repeats next to each other are one span; spans of fewer than ``SPAN`` bytes are
chance and stay.

Scale: five longs a chunk are shuffled, twice: once as counts, pre-aggregated by
digest, and once to look up the digests that repeat. The look-up is a plain join
without an aggregate above it before the next exchange, so the large partition of
a passage that a third of all documents share can be split. No window or list
holds the occurrences of a digest; spans are gathered per document, whose length
bounds them.

Defined results: null and empty texts have no chunk; texts shorter than ``LEAST``
bytes are one chunk; repeated rows: each is an occurrence of its own, told apart
by a row number; a null doc_id comes last in the order; an empty table gives no
rows; documents without a repeated span have no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, stored, table, with_place

#: Bytes of a chunk: at least, at most; one position in 2 ** MASK_BITS is a cut point.
LEAST, MOST, MASK_BITS = 24, 160, 5
#: Bytes of repeated chunks in a row that make a span.
SPAN = 72


def gear_table(seed: int = 20) -> np.ndarray:
    """256 fixed 16-bit values from a seeded digest."""
    raw = b"".join(hashlib.blake2b(bytes([i]), digest_size=2, key=bytes([seed])).digest() for i in range(256))
    return np.frombuffer(raw, "<u2").astype(np.uint16)


_GEAR = gear_table()


def cut_points(data: bytes) -> np.ndarray:
    """Positions after which the gear hash, h = 2 h + gear[byte], has its top bits clear.

    The shifts drop what is older than 16 bytes, so the sums of 2, 4, 8, 16 bytes double up."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        later = h.copy()
        later[k:] += h[:-k] << np.uint16(k)
        h = later
    return np.flatnonzero(h >> np.uint16(16 - MASK_BITS) == 0) + 1


def on_borders(data: bytes, cuts: np.ndarray) -> np.ndarray:
    """Cuts moved on to the next place where a character of UTF-8 begins (three bytes at most)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = np.frombuffer(data, np.uint8) & 0xC0 == 0x80
    for _ in range(3):
        cuts = cuts + inside[cuts]
    return cuts


def chunks(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n, out, start = len(data), [], 0
    if n <= LEAST:
        return [n] if n else []
    cuts = cut_points(data)

    def longest(start: int) -> int:
        return int(on_borders(data, np.array([start + MOST - 3]))[0])

    for at in (cuts if data.isascii() else on_borders(data, cuts)).tolist():
        while at - start > MOST:
            start = longest(start)
            out.append(start)
        if at - start >= LEAST:
            out.append(at)
            start = at
    while n - start > MOST:
        start = longest(start)
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, d1, d2): a row for each chunk of ``docs`` (doc_id, row, text).

    ``at`` is the chunk's first byte * 256 + its length, d1 and d2 are its digest."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row").cast("long").alias("row"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py() or b""
                stops = chunks(data)
                for k in range(0, len(stops), 50_000):
                    part = stops[k : k + 50_000]
                    starts = [stops[k - 1] if k else 0, *part[:-1]]
                    digests = np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts, part)]), "<i8").reshape(-1, 2)
                    n, first = len(part), np.array(starts, np.int64)
                    columns = [pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, row)), pa.array(first * 256 + np.array(part) - first), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "at", "d1", "d2"])

    return picked.mapInArrow(run, "doc_id long, row long, at long, d1 long, d2 long")


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, row, n_spans, repeated_bytes, spans): documents with repeated spans; spans are (start, stop) in bytes.

    ``row`` tells the rows of ``docs`` apart; it is taken from a column of that name that is a long, or made."""
    picked = docs if dict(docs.dtypes).get("row") == "bigint" else docs.withColumn("row", F.monotonically_increasing_id())
    rows = stored(chunked(picked), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    first = rows.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("d1", "d2", "first")
    again = rows.join(first, ["d1", "d2"]).filter(place != F.col("first"))
    # repeats that touch are one span; a window holds the repeats of one document
    parts = again.select("doc_id", "row", F.shiftright("at", 8).alias("start"), (F.shiftright("at", 8) + F.col("at").bitwiseAND(F.lit(255))).alias("stop"))
    in_order = Window.partitionBy("doc_id", "row").orderBy("start")
    starts_span = F.coalesce((F.lag("stop").over(in_order) != F.col("start")).cast("int"), F.lit(1))
    numbered = parts.withColumn("new", starts_span).withColumn("k", F.sum("new").over(in_order))
    spans = numbered.groupBy("doc_id", "row", "k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).filter(F.col("stop") - F.col("start") >= span)
    out = spans.groupBy("doc_id", "row").agg(F.count("*").alias("n_spans"), F.sum(F.col("stop") - F.col("start")).alias("repeated_bytes"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return out.select("doc_id", "row", "n_spans", "repeated_bytes", "spans")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its repeated spans."""
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Every row of ``docs`` with all its columns; of ``text`` what no earlier document has."""
    name, cuts = free_name(docs, "_row"), free_name(docs, "_spans")
    placed = with_place(docs, name)
    found = repeated_spans(placed.select("doc_id", F.col(name).alias("row"), "text"), span).select(F.col("row").alias(name), F.col("spans").alias(cuts))
    joined = placed.join(found, name, "left").select(*docs.columns, cuts)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(at), batch.column(len(names)))
            texts = [without_spans(t.as_py().encode(), [(s["start"], s["stop"]) for s in c.as_py()]).decode() if t.is_valid and c.is_valid else t.as_py() for t, c in pairs]
            columns = [pa.array(texts, batch.column(at).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_spans, repeated_bytes, spans of every document that repeats an earlier passage."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row")
