"""Benchmark decontamination: block-max WAND over a BM25 index of test items.

Test items are the indexed side; every passage of every training document is a
query. Weights are BM25 contributions divided by the item's score against itself,
so a full copy scores 1 and one threshold fits items of any length. An item of
more than ``HALF`` words is indexed in parts of that size; passages are two
halves of ``HALF`` words that overlap by one, so every part of an item lies
whole in some passage.

Retrieval is for all items above the threshold, not a top k, in two steps. Passages of
a slice are first bounded together: for each passage, the lists of least weight that
together stay under a share of the threshold are set aside (their bound is kept), and
the block maxima of the others are added up by range of blocks. Only a passage with a
range that can reach the threshold is searched, within these ranges, by block-max WAND:
one cursor a list, sorted by the part it stands at; the pivot is the first part at which
the list maxima add up to the threshold; where the block maxima around the pivot do not,
the cursors skip to the end of the nearest block, and only otherwise is the part scored.
Both steps leave out nothing that can reach the threshold. Hits are verified against the
words around the passage: the share of three-word windows of the item's question and of
its answer found there must both reach ``OVERLAP``.

Without separate columns an item's answer is its end: whole sentences of at
least ``ANSWER`` words together; the question is what stands before (or the whole
item where nothing does).

Scale: one narrow pass over the documents for each shard of ``SHARD`` items (the
proven bound of what is broadcast); no shuffle. Test sets are far smaller than
corpora; a larger one costs more passes. A long text is read and searched in segments
that overlap by a passage and the longest item's surroundings, so memory is that of a
slice of words and the index, whatever the length of a text.

Defined results: null and empty texts and items never match; repeated rows are
each reported; items of equal text are each reported; a null doc_id or item_id
is carried as null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table, tidy

HALF = 64
SHARD = 20_000
BLOCK = 4
THRESHOLD = 0.6
OVERLAP = 0.6
ANSWER = 8
#: Ranges of blocks that passages are bounded by at first, at most.
RANGES = 512
#: Share of the threshold that the lists set aside may add up to.
ASIDE = 0.1
SLICE_WORDS = 100_000
#: Bytes of a text that are split into words at once.
READ = 1 << 20
K1, B = 1.2, 0.75

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_NOT_SPACE = bytes(b for b in range(256) if b != 32)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs separate, everything else stays in the word."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def word_stream(text: memoryview) -> Iterator[list[bytes]]:
    """``tokens`` of a UTF-8 text, some READ bytes at a time."""
    at, size = 0, len(text)
    while at < size:
        piece = bytes(text[at : at + READ])
        if at + len(piece) < size:  # end behind the last separator; a longer word is read whole
            while at + len(piece) < size and not (cut := len(piece.translate(_PLAIN).rstrip(_NOT_SPACE))):
                piece += bytes(text[at + len(piece) : at + len(piece) + READ])
            if at + len(piece) < size:
                piece = piece[:cut]
        at += len(piece)
        yield tokens(piece.decode("utf-8", "replace"))


def question_answer(text: str) -> tuple[str, str]:
    """Split an item without separate columns into question and answer."""
    sentences = _SENTENCE.split(text.strip())
    for k in range(len(sentences) - 1, 0, -1):
        answer = " ".join(sentences[k:])
        if len(tokens(answer)) >= ANSWER:
            return " ".join(sentences[:k]), answer
    return text, text


def windows(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    """Word windows of size n; of a shorter list, the list."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    """Inverted index of one shard of items: BM25 weights, list maxima and block maxima."""

    def __init__(self, items: list[tuple[int | None, str, str]], half: int = HALF, block: int = BLOCK) -> None:
        """items: (item_id, question, answer)."""
        self.half, self.block = half, block
        self.items, parts = [], []
        for item_id, question, answer in items:
            q, a = tokens(question), tokens(answer)
            words = q if question == answer else q + a
            if not words:
                continue
            k = len(self.items)
            self.items.append((item_id, len(words), windows(q) or windows(a), windows(a) or windows(q)))
            parts += [(k, words[i : i + half]) for i in range(0, len(words), half) if i == 0 or len(words) - i >= half // 4]
        # parts that are alike share blocks, so block maxima stay close to the parts' own weights
        parts.sort(key=lambda p: sorted(p[1]))
        n = len(parts)
        frequency = Counter(w for _, ws in parts for w in set(ws))
        self.term = {w: i for i, w in enumerate(frequency)}
        mean = sum(len(ws) for _, ws in parts) / max(1, n)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        self.owner = [k for k, _ in parts]
        for p, (_, ws) in enumerate(parts):
            weights = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[self.term[w]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            whole = sum(weights.values())
            for t, v in weights.items():
                postings[t].append((p, v / whole))
        self.lists = [([p for p, _ in ps], [v for _, v in ps]) for ps in postings]
        self.top_of_list = [max(v for _, v in ps) for ps in postings]
        self.list_max = np.array(self.top_of_list or [0.0], np.float32)
        self.longest = max((n for _, n, *_ in self.items), default=0)
        # block maxima: the last part and the maximum of each block of a list; and of ranges of parts
        self.block_max = [[max(vs[i : i + block]) for i in range(0, len(vs), block)] for _, vs in self.lists]
        self.span = max(block, -(-n // RANGES))
        self.ranges = -(-n // self.span)
        starts, at, top = [0], [], []
        for ps in postings:
            best: dict[int, float] = {}
            for p, v in ps:
                best[p // self.span] = max(best.get(p // self.span, 0.0), v)
            at += best.keys()
            top += best.values()
            starts.append(len(at))
        self.starts, self.at, self.top = np.array(starts), np.array(at, np.int64), np.array(top, np.float32)

    def bounds(self, ids: np.ndarray, half_of: np.ndarray, halves: int, threshold: float) -> np.ndarray:
        """Upper bounds (halves x ranges): of what the words of a half add to any part of a range."""
        terms = len(self.term)
        code = np.sort(half_of * terms + ids)
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
        half, term = code // terms, code % terms
        weight = self.list_max[term]
        # set aside the lists of least weight, up to a share of the threshold for two halves
        order = np.lexsort((weight, half))
        half, term, weight = half[order], term[order], weight[order]
        upto = np.cumsum(weight, dtype=np.float64)
        first = np.searchsorted(half, half, side="left")
        upto -= np.concatenate([[0.0], upto])[first]
        aside = upto < threshold * ASIDE / 2
        bound = np.bincount(half[aside], weight[aside], halves)
        half, term = half[~aside], term[~aside]
        sizes = self.starts[term + 1] - self.starts[term]
        skip = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.empty(0, np.int64)
        entry = np.arange(len(skip)) + skip
        cell = np.repeat(half, sizes) * self.ranges + self.at[entry]
        found = np.bincount(cell, self.top[entry], halves * self.ranges).reshape(halves, self.ranges)
        return found + bound[:, None]

    @property
    def part_terms(self) -> list[dict[int, float]]:
        """Of each part the weights of its terms: the index read the other way."""
        rows: list[dict[int, float]] = [{} for _ in self.owner]
        for term, (parts, weights) in enumerate(self.lists):
            for p, v in zip(parts, weights):
                rows[p][term] = v
        return rows

    def wand(self, terms: set[int], first: int, stop: int, threshold: float) -> Iterator[tuple[int, float]]:
        """(part, score) of the parts in [first, stop) whose score with these words reaches the threshold."""
        least, block = threshold - 1e-9, self.block
        cursors = []  # [part, place in the list, term]
        for t in terms:
            parts = self.lists[t][0]
            at = bisect_left(parts, first)
            if at < len(parts) and parts[at] < stop:
                cursors.append([parts[at], at, t])

        def move(some: list[list[int]], to: int) -> None:
            """Move cursors to the first part at ``to`` or behind; those at their end go."""
            for c in some:
                parts = self.lists[c[2]][0]
                at = bisect_left(parts, to, c[1])
                if at < len(parts) and parts[at] < stop:
                    c[0], c[1] = parts[at], at
                else:
                    cursors.remove(c)

        while cursors:
            cursors.sort()
            bound, k = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.top_of_list[c[2]]
                if bound >= least:
                    break
            else:
                return
            pivot = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            upto, bound, edge = cursors[: k + 1], 0.0, stop
            for _, at, t in upto:  # the block of each list that holds the pivot, if the list has it
                parts = self.lists[t][0]
                b = bisect_left(parts, pivot, at) // block
                if b < len(self.block_max[t]):
                    bound += self.block_max[t][b]
                    edge = min(edge, parts[min(len(parts), (b + 1) * block) - 1])
            if bound < least:
                behind = cursors[k + 1][0] if k + 1 < len(cursors) else stop
                move(upto, max(pivot + 1, min(edge + 1, behind)))
            elif cursors[0][0] == pivot:
                score = sum(self.lists[t][1][at] for _, at, t in upto)
                if score >= least:
                    yield pivot, score
                move(upto, pivot + 1)
            else:
                move([c for c in upto if c[0] < pivot], pivot)

    def search(self, texts: list[list[bytes]], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple]]:
        """For each text [(item index, score, question overlap, answer overlap, first word of the passage)]."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.items:
            return out
        get, half = self.term.get, self.half
        counts = np.array([len(ws) for ws in texts])
        halves = np.maximum(1, -(-counts // half))
        first = np.cumsum(halves) - halves
        ids = np.fromiter((get(w, -1) for ws in texts for w in ws), np.int64, counts.sum())
        text_of = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(ids)) - (np.cumsum(counts) - counts)[text_of]
        half_of = first[text_of] + place // half
        known = ids >= 0
        bounds = self.bounds(ids[known], half_of[known], int(halves.sum()), threshold)
        owner = np.repeat(np.arange(len(texts)), halves)
        both = bounds.copy()
        same = owner[1:] == owner[:-1]
        both[:-1][same] += bounds[1:][same]
        begin = np.cumsum(counts) - counts
        for passage, span in np.argwhere(both >= threshold - 1e-6):
            text = int(owner[passage])
            at = int(passage - first[text]) * half
            here = ids[begin[text] + at : begin[text] + min(counts[text], at + 2 * half)]
            for part, score in self.wand(set(here[here >= 0].tolist()), int(span) * self.span, (int(span) + 1) * self.span, threshold):
                item = self.owner[part]
                size = self.items[item][1]
                near = windows(texts[text][max(0, at - size) : at + 2 * half + size])
                q, a = (sum(g in near if len(g) == 3 else _within(g, near) for g in grams) / len(grams) for grams in self.items[item][2:])
                if q >= overlap and a >= overlap:
                    out[text].append((item, float(score), q, a, at))
        return [best(hits) for hits in out]


def _within(gram: tuple[bytes, ...], near: set[tuple[bytes, ...]]) -> bool:
    """Whether a window of fewer than three words stands in one of the longer windows."""
    n = len(gram)
    return any(w[i : i + n] == gram for w in near for i in range(len(w) - n + 1))


def best(hits: list[tuple]) -> list[tuple]:
    """The best hit of each item in one text."""
    top: dict[int, tuple] = {}
    for hit in hits:
        if hit[0] not in top or (hit[1:4], -hit[4]) > (top[hit[0]][1:4], -top[hit[0]][4]):
            top[hit[0]] = hit
    return [top[k] for k in sorted(top)]


def indexes(benchmark: DataFrame, shard: int = SHARD) -> Iterator[Index]:
    """The index in shards of about ``shard`` items; each is on the driver alone while it is built."""
    named = {"question", "answer"} <= set(benchmark.columns)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), *(["question", "answer"] if named else ["text"]))
    shards = max(1, math.ceil(items.count() / shard))
    for k in range(shards):
        rows = items.filter(F.pmod(F.xxhash64(*items.columns), F.lit(shards)) == k).collect()
        rows = sorted(((r[0], *(r[1:] if named else question_answer(r[1] or ""))) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Index([(i, q or "", a or "") for i, q, a in rows])


def segments(texts: pa.Array, index: Index, most: int = SLICE_WORDS) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Slices of some ``most`` words: [(row, number of the first word, words)]; long texts in overlapping segments.

    Segments begin at multiples of half a passage, and overlap so far that each
    passage has the words around it whole in one of them."""
    half = index.half
    overlap = 3 * half + 2 * index.longest
    held, n = [], 0
    for row, text in enumerate(texts.cast(pa.large_binary())):
        start, words = 0, []
        for more in word_stream(memoryview(text.as_buffer())) if text.is_valid else ():
            words += more
            while len(words) > most + overlap:
                yield [*held, (row, start, words[: most + overlap])]
                held, n = [], 0
                step = most // half * half
                start, words = start + step, words[step:]
        held.append((row, start, words))
        n += len(words)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def row_hits(texts: pa.Array, index: Index, threshold: float, overlap: float) -> Iterator[tuple[int, list[tuple]]]:
    """(row, hits) of each row with hits; first words are counted from the text's beginning."""
    row, open_hits = -1, []
    for part in segments(texts, index):
        for (at, start, _), hits in zip(part, index.search([w for *_, w in part], threshold, overlap)):
            if at != row:
                if open_hits:
                    yield row, best(open_hits)
                row, open_hits = at, []
            open_hits += [(*h[:4], h[4] + start) for h in hits]
    if open_hits:
        yield row, best(open_hits)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): test items found in documents."""
    spark, out = docs.sparkSession, None
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[row].as_py(), index.items[h[0]][0], *h[1:]) for row, hits in row_hits(batch.column(1), index, threshold, overlap) for h in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        found = picked.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        out = found if out is None else out.unionByName(found)
    return out


_NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _ in row_hits(batch.column(at), index, threshold, overlap):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and evidence: a row for each document and test item found in it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go; all columns stay."""
    bound_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
