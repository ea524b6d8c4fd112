"""Token ids in Arrow stream files of fixed-size-list batches.

A shard is one Arrow IPC stream of the columns ``ids`` and ``mask``, both lists
of exactly ``SEQUENCE`` entries, in batches of exactly ``BATCH`` sequences (the
last one shorter). All batches of one size are laid out alike, so sequence k of
a memory-mapped shard is found by arithmetic on k and read without a copy. Token
streams of the shard's documents are packed end to end, each with its end id; the
mask is 1 for tokens and 0 for the padding at the end of the shard. A second
stream beside it, the shard's index, has (doc_id, start, n_tokens) of each
document in the shard.

Documents are dealt into shards by ranges of doc_id and sorted, so shards in
order of their numbers hold ascending doc_ids. Each task tokenizes and writes its
own shard to a name of its own and renames it: a task that is run again, or twice,
leaves the same whole shard. Memory: a batch of sequences and one document.

Files lie in the shared folder (``common.shared_dir``) through pyarrow's file
systems; nothing is left in an executor's own folder.

Tokenization: words between ASCII white space never merge in a tokenizer that
drops white space and splits at it, so each distinct piece (see ``pieces``) goes
through the tokenizers library once a worker and is then looked up.

Defined results: a null text is an empty one: its end id alone; null doc_ids come
first; repeated rows each have a place, in the order of their texts; an empty
table gives no rows; texts of any length are one document; other columns stay out.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_dir, table, tidy

SEQUENCE = 2048
BATCH = 64
END = 1
#: Distinct words whose ids a task remembers before it starts anew.
MEMORY = 600_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Where a tokenizer that splits signs from letters and digits cuts in any case.
_CUT = re.compile(rb"([!-/:-@\[-`{-~])(?<=[a-z0-9].)")


def pieces(text: bytes) -> list[bytes]:
    """Parts of a text whose encodings, in a row, are the text's.

    The tokenizer lowers case and cuts between a letter or digit and a sign, so ASCII
    is lowered and cut here and fewer words are distinct. Special tokens are matched
    before that: a text that may hold one is only cut at white space."""
    return text.split() if b"<|" in text else _CUT.sub(rb" \1", text.lower()).split()


class _Numbers(dict):
    """Words' numbers in order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Tokens:
    """Ids of whole texts, by the tokenizers library; remembers words."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)

    def _learn(self, known: int) -> None:
        """Encode the words numbered from ``known``."""
        new = list(islice(reversed(self.number), len(self.number) - known))
        if not new:
            return
        new.reverse()
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        stops = self.starts[known] + np.cumsum(sizes)
        while len(self.starts) <= known + len(new):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.ids) < stops[-1]:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.starts[known] : stops[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.starts[known + 1 : known + 1 + len(new)] = stops

    def encode(self, texts: list[bytes | None], end: int) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.number) > MEMORY:
            self._forget()
        known, look = len(self.number), self.number.__getitem__
        try:
            split = [pieces(t or b"") for t in texts]
            numbers = [np.fromiter(map(look, words), np.int64, len(words)) for words in split]
            self._learn(known)
        except BaseException:  # no word may keep a number without ids
            self._forget()
            raise
        out = []
        for w in numbers:
            first = self.starts[w]
            sizes = self.starts[w + 1] - first
            upto = np.cumsum(sizes)
            total = int(upto[-1]) if len(w) else 0
            ids = np.empty(total + 1, np.uint32)
            ids[:total] = self.ids[np.arange(total) + np.repeat(first - upto + sizes, sizes)]
            ids[total] = end
            out.append(ids)
        return out


#: Tokenizers of this Python worker, by path: tasks that follow find known words.
_KNOWN: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    if path not in _KNOWN:
        _KNOWN[path] = Tokens(path)
    return _KNOWN[path]


def forget() -> None:
    """Drop this worker's tokenizers and their words; the files are written and nothing looks words up again."""
    _KNOWN.clear()


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text, a row at least."""
    at = held = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        held += size or 0
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def schema(sequence: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(kind, sequence)), pa.field("mask", pa.list_(pa.bool_(), sequence))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Packs token streams into fixed-size sequences and writes them batch by batch."""

    def __init__(self, files: pafs.FileSystem, path: str, sequence: int, kind: pa.DataType) -> None:
        self.files, self.path, self.sequence, self.kind = files, path, sequence, kind
        self.draft = f"{path}.{uuid.uuid4().hex}"
        self.out = [files.open_output_stream(f"{self.draft}.{k}") for k in ("seq", "idx")]
        self.sequences = ipc.new_stream(self.out[0], schema(sequence, kind))
        self.index = ipc.new_stream(self.out[1], INDEX)
        self.held: list[np.ndarray] = []
        self.size, self.total = 0, 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.sequence * BATCH:
            self._flush(self.size // (self.sequence * BATCH) * BATCH)
        if len(self.rows) >= 10_000:
            self._rows()

    def _rows(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=INDEX))
            self.rows = []

    def _flush(self, count: int, pad: int = 0) -> None:
        """Write ``count`` sequences; ``pad`` of their last entries are padding."""
        flat = np.concatenate(self.held)
        used = flat[: count * self.sequence - pad]
        rest = flat[len(used) :]
        if pad:
            used = np.concatenate([used, np.zeros(pad, flat.dtype)])
        for at in range(0, count, BATCH):
            n = min(BATCH, count - at)
            ids = pa.FixedSizeListArray.from_arrays(pa.array(used[at * self.sequence : (at + n) * self.sequence].astype(self.kind.to_pandas_dtype())), self.sequence)
            mask = np.ones(n * self.sequence, bool)
            if pad and at + n == count:
                mask[n * self.sequence - pad :] = False
            self.sequences.write_batch(pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=schema(self.sequence, self.kind)))
        self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        if self.size:
            count = -(-self.size // self.sequence)
            self._flush(count, count * self.sequence - self.size)
        self._rows()
        for writer, out in zip((self.sequences, self.index), self.out):
            writer.close()
            out.close()
        for k in ("seq", "idx"):
            self.files.move(f"{self.draft}.{k}", f"{self.path}.{k}")


def read_shard(path: str, start: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches of a shard; memory-mapped where the file is local, so they are views of the file."""
    files, at = pafs.FileSystem.from_uri(path)
    source = pa.memory_map(at) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(at)
    with ipc.open_stream(source) as reader:
        yield from reader


class Shard:
    """Random access to the sequences of one local shard, without copies and without an index of its batches.

    Batches of one size are laid out alike, so batch b begins b times the first one's
    length behind it. Opening a shard reads its schema, its first and its last batch."""

    def __init__(self, path: str) -> None:
        files, at = pafs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at)
        reader = ipc.open_stream(self.source)
        self.schema, self.first = reader.schema, self.source.tell()
        left = self.source.size() - self.first
        try:
            self.size, self.step = reader.read_next_batch().num_rows, self.source.tell() - self.first
        except StopIteration:
            self.size, self.step = 1, max(1, left)
            self.total = 0
            return
        whole, rest = divmod(left, self.step)
        self.total = whole * self.size
        if rest > 8:  # more than the mark of the stream's end: a last, shorter batch
            self.total += self._batch(whole).num_rows

    def _batch(self, b: int) -> pa.RecordBatch:
        self.source.seek(self.first + b * self.step)
        return ipc.read_record_batch(ipc.read_message(self.source), self.schema)

    def __len__(self) -> int:
        return self.total

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence k; ids is a view of the file."""
        if not 0 <= k < self.total:
            raise IndexError(k)
        batch, row = self._batch(k // self.size), k % self.size
        ids, mask = batch.column(0), batch.column(1)
        n = ids.type.list_size
        return ids.flatten()[row * n : (row + 1) * n].to_numpy(), mask.flatten()[row * n : (row + 1) * n]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, sequence: int = SEQUENCE, end: int = END, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder``; returns (shard, path, n_docs, n_tokens), one row a shard.

    The returned table is read from the shards' small manifest, not recomputed."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    dealt = picked.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.crc32("text").asc_nulls_first())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, docs_here = None, 0
        shard = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None and batch.num_rows:
                encode = tokens_of(path)
                kind = pa.uint16() if max(encode.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
                files.create_dir(root, recursive=True)
                writer = ShardWriter(files, f"{root}/shard-{shard:06d}", sequence, kind)
            docs_here += batch.num_rows
            for a, b in slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0)[a:b].to_pylist(), encode.encode(batch.column(1)[a:b].to_pylist(), end)):
                    writer.add(doc_id, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([f"{folder}/shard-{shard:06d}"]), pa.array([docs_here]), pa.array([writer.total])], names=["shard", "path", "n_docs", "n_tokens"])

    manifest = f"{folder}/manifest"
    ordered.mapInArrow(tidy(run), "shard long, path string, n_docs long, n_tokens long").write.parquet(manifest)
    return spark.read.schema("shard long, path string, n_docs long, n_tokens long").parquet(manifest)


class Stream:
    """A shard's tokens in order, batch by batch."""

    def __init__(self, path: str) -> None:
        self.batches = (b.column(0).flatten().to_numpy() for b in read_shard(path))
        self.held = np.empty(0, np.uint16)

    def take(self, n: int) -> np.ndarray:
        parts, left = [self.held[:n]], n - len(self.held[:n])
        self.held = self.held[n:]
        while left:
            batch = next(self.batches)
            parts.append(batch[:left])
            self.held = batch[left:]
            left -= len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(manifest: DataFrame, value=lambda ids: ids.astype("<u4").tobytes(), kind: str = "binary") -> DataFrame:
    """(doc_id, start, n_tokens, value): ``value`` of the ids of every document, read from the shards' files.

    ``start`` counts the ids of all documents before it, in this shard and the earlier ones."""
    # one row a shard, so the running sum is over a small table by construction
    based = manifest.select("path", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("base"))
    spread = based.repartition(max(1, manifest.count()), "path")
    arrow = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = Stream(f"{path}.seq")
                for index in read_shard(f"{path}.idx"):
                    for at in range(0, index.num_rows, 200):
                        part = index.slice(at, 200)
                        values = [value(stream.take(n)) for n in part.column(2).to_pylist()]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1).to_numpy() + base), part.column(2), pa.array(values, arrow)], names=["doc_id", "start", "n_tokens", "value"])

    return spread.mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, value {kind}")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and digest them from there."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    found = read_documents(write_tokens(docs, folder), ids_crc32, "long")
    return found.select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return encode_and_read(table(spark, sf_dir, "documents"))


def write_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as token files; the digest rows read back from them."""
    bound_batches(spark)
    return encode_and_read(docs)
