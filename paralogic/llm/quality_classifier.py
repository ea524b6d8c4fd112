"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole
text is encoded (style shares, hashed bags of word shapes and of words), embedded, and
weighted by gated attention, a = softmax(w . (tanh(V h) * sigmoid(U h))); the
document's score is a logistic function of the weighted passage representation.
Attention weights and embeddings are learned from document labels alone.

Training: at most ``MAX_TRAIN`` labelled documents of each class, the first by a
hash of doc_id among those whose crc32(doc_id) mod 5 is not 0, and of those the
first that have ``MAX_PASSAGES`` passages together; each with all its passages. Both
bounds are parameters; they bound the driver's memory. Scoring uses all passages of
all documents. Labels, lang, source and doc_id are not inputs of a score.

Scale: the model (some 20 kB) travels in the task's closure; scoring is one
narrow pass over the texts without a shuffle, in slices of some 100,000 words.

Defined results: null and empty texts, and texts without a word, are one passage
of its own kind and get a score like any other; a null doc_id is not held out
and never trained on; of several labels of one doc_id the largest counts, of
several texts the first by a hash of the text is trained on;
repeated rows each get their (equal) score; an empty table gives no rows; with
labels of fewer than two classes every score is 0.5; other columns stay out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, cut, give_back, table, tidy

PASSAGE = 64
MAX_TRAIN = 2000
MAX_PASSAGES = 100_000
THRESHOLD = 0.3

SHAPES = 96
CONTENT = 64
STYLE = 14
WIDTH = STYLE + SHAPES + CONTENT
#: Distinct words an encoder remembers before it starts anew.
MEMORY = 200_000
#: Words encoded at once.
SLICE = 100_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Classes of bytes for word shapes: letters, digits, ASCII signs as they are, the rest.
_KIND = bytes(97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b if b < 128 else 98 for b in range(256))
_SIGNS = b"#*$%&|<>{}[]=_~^\\@"


_SAME = re.compile(rb"(.)\1+", re.S)


def word_features(word: bytes) -> tuple[list[float], int, int]:
    """Style counts of one word, the bucket of its shape (runs of a class are one), and its own."""
    kinds = word.translate(_KIND)
    n = len(word)
    upper, digits, letters = kinds.count(b"A"), kinds.count(b"9"), kinds.count(b"a") + kinds.count(b"A") + kinds.count(b"b")
    signs = n - len(word.translate(None, _SIGNS))
    shouts = word.count(b"!") + word.count(b"?")
    ends = word[-1:] in (b".", b",", b";", b":", b"!", b"?")
    values = [min(n, 40) / 10, min(signs, 8), min(shouts, 8), upper / n, upper == letters and letters > 1, digits / n, ends, letters == 0, n <= 3, n > 20, kinds.count(b"b") / n]
    return [float(v) for v in values], zlib.crc32(_SAME.sub(rb"\1", kinds)) % SHAPES, zlib.crc32(word.lower(), 1) % CONTENT


class Encoder:
    """Encodes whole texts as passages; remembers the features of words it has seen."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.values = np.empty((1024, STYLE - 3), np.float32)
        self.shapes, self.content = np.empty(1024, np.int64), np.empty(1024, np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in set(words).difference(number):
            at = number[w] = len(number)
            if at == len(self.shapes):
                self.values, self.shapes, self.content = (np.concatenate([old, np.empty_like(old)]) for old in (self.values, self.shapes, self.content))
            self.values[at], self.shapes[at], self.content[at] = word_features(w)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(passages x WIDTH, index of each passage's text); every text has a passage at least."""
        if len(self.number) > MEMORY:
            self.__init__()
        words = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in words])
        flat = self.ids([w for ws in words for w in ws])
        parts = np.maximum(1, -(-sizes // PASSAGE))
        owner = np.repeat(np.arange(len(texts)), parts)
        first = np.cumsum(parts) - parts
        out = np.zeros((len(owner), WIDTH), np.float32)
        out[:, STYLE - 1] = (sizes == 0)[owner]
        if not len(flat):
            return out, owner
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = first[doc] + (np.arange(len(flat)) - starts[doc]) * parts[doc] // sizes[doc]
        n = len(owner)
        count = np.maximum(1, np.bincount(place, minlength=n))
        k = self.values.shape[1]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # of passages with words
        out[place[starts], :k] = np.add.reduceat(self.values[flat], starts) / count[place[starts], None]
        # words not yet seen in the passage; three-word windows seen before in the text
        most = np.int64(len(self.number))
        code = np.sort(place * most + flat)
        fresh = np.concatenate([[True], code[1:] != code[:-1]])
        out[:, k] = np.bincount(code[fresh] // most, minlength=n) / count
        if len(flat) > 2:
            spread = (flat.astype(np.uint64) + np.uint64(1)) * _MIX[0]
            window = ((spread[:-2] * _MIX[1] + spread[1:-1]) * _MIX[2] + spread[2:]) ^ (doc[2:].astype(np.uint64) * _MIX[1])
            order = np.argsort(window, kind="stable")
            again = np.zeros(len(window), bool)
            again[order[1:]] = window[order[1:]] == window[order[:-1]]
            again &= doc[2:] == doc[:-2]
            out[:, k + 1] = np.bincount(place[2:][again], minlength=n) / count
        at = STYLE
        for size, bucket in ((SHAPES, self.shapes), (CONTENT, self.content)):
            bags = np.bincount(place * size + bucket[flat], minlength=n * size).reshape(n, size)
            out[:, at : at + size] = np.sqrt(bags / count[:, None])
            at += size
        return out, owner


@dataclass
class Model:
    """Gated-attention multiple-instance classifier; arrays only, so it pickles small."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        t = np.tanh(h @ w["V"])
        g = 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        logit = (t * g) @ w["a"]
        starts = np.searchsorted(owner, np.arange(n))  # owner ascends and every text has a passage
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[owner])
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def scores(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, owner, n)["p"]


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 200, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> Model:
    """Fit by full-batch Adam on the class-balanced log loss; deterministic."""
    rng, n = np.random.default_rng(seed), len(y)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    weights = {"E": init(x.shape[1], hidden), "e": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "a": init(gate), "c": init(hidden), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 0.05, weights)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    norm = (x - model.mean) / model.scale
    m, v = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(norm, owner, n)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dp = share * (f["p"] - y)  # gradient at the document's logit
        dz = dp[:, None] * weights["c"]
        da = (dz[owner] * h).sum(axis=1)
        dlogit = a * (da - np.bincount(owner, a * da, n)[owner])
        dh = a[:, None] * dz[owner]
        dt, dg = dlogit[:, None] * weights["a"] * g * (1 - t * t), dlogit[:, None] * weights["a"] * t * g * (1 - g)
        dh = (dh + dt @ weights["V"].T + dg @ weights["U"].T) * (1 - h * h)
        grads = {"E": norm.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ dlogit, "c": f["z"].T @ dp, "d": np.array([dp.sum()])}
        for k, w in weights.items():
            grad = grads[k] + decay * w
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE words of text."""
    at, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        held += size or 0
        if held >= SLICE * 6:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def sample_features(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> list:
    """[(doc_id, y, passages as bytes)] of the bounded training sample, on the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).filter(~held_out("_id"))
    first = lambda y: known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # 2 * max_train rows at most
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("_id", "_y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            found = [encoder.encode([text.as_py()])[0].astype(np.float16) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "y", "n", "x"])

    rows = cut(texts.mapInArrow(tidy(run), "doc_id long, y int, n long, x binary"))
    in_turn = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over 2 * max_train rows
    taken = rows.select("doc_id", F.sum("n").over(in_turn).alias("upto")).filter(F.col("upto") <= max_passages)
    found = rows.join(F.broadcast(taken), "doc_id").select("doc_id", "y", "x").collect()
    return sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in found)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """The model of the training sample; None where it lacks a class."""
    rows = sample_features(docs, labels, max_train)
    y = np.array([r[1] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(r[2], np.float16).reshape(-1, WIDTH).astype(np.float32) for r in rows]
    return train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float | None = None) -> DataFrame:
    """(doc_id, text, score) of ``docs``; with ``min_score`` the rows that reach it, with the columns of ``docs``."""
    docs = docs.select("doc_id", text_col) if min_score is None else docs
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            values = np.full(batch.num_rows, 0.5)
            for a, b in slices(texts) if model else ():
                x, owner = encoder.encode(texts[a:b].to_pylist())
                values[a:b] = model.scores(x, owner, b - a)
            if min_score is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*columns, "score"])
            else:
                yield batch.filter(pa.array(values >= min_score))

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]) if min_score is None else docs.schema
    return docs.mapInArrow(tidy(run), schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; all columns stay."""
    bound_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    give_back()
    return scored(docs, model, min_score=THRESHOLD)
