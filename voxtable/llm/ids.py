"""Token ids as binary files: frequency-ranked ids in byte-aligned variable length, with separate control bytes.

1. ``token_ids`` encodes every text with the tokenizers library and appends the end id. White space ends every pre-token of such a
   tokenizer, so a text's ids are those of its chunks between ASCII white space, and trailing punctuation behind a letter or digit is a
   pre-token of its own: each distinct chunk is encoded once per Python worker (table of bounded size).
2. ``ranks`` counts all ids of the corpus; the most frequent id gets rank 0. The result has at most one row per vocabulary entry.
3. ``write_files`` sorts documents by id over range partitions and writes blocks. Each id becomes the one to four low bytes of its
   rank; its length lies in two bits of a control byte, four ids to a byte. A block row holds document ids, lengths, control bytes and data bytes; a block
   ends when it has ``BLOCK_IDS`` ids, and a longer document is a block of its own.
4. ``read_files`` decodes: a table of 256 rows turns control bytes into lengths, their running sums into places, and ranks into ids.

Defined cases: a null text is empty and has only the end id; repeated rows are documents of their own, equal ids are ordered by a hash of
their tokens; rows with a null id come first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import kept, text_slices
from voxtable.session import scratch_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
#: Distinct chunks a worker remembers at most.
TABLE_ROWS = 800_000
_TAIL = b".,!?;:|#$%&*"


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one printable character: itself where it is one, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


class Encoder(dict):
    """Chunk to ids, as bytes of unsigned integers of ``kind``; a chunk that is not there yet is encoded and kept."""

    def __init__(self, path: str, kind=np.uint32, rows: int = TABLE_ROWS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind, self.rows = kind, rows
        self.letters = _byte_letters()
        self.tails: dict[bytes, bytes] = {}

    def _library(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_TAIL)
        word = core.decode().lower()
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            # Latin letters only: one pre-token, which normalisation leaves as it is but for lower case. The punctuation behind it is another.
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(word)], self.kind).tobytes()
            if tail := chunk[len(core) :]:
                if tail not in self.tails:
                    self.tails[tail] = self._library(tail)
                ids += self.tails[tail]
        else:
            ids = self._library(chunk)
        self[chunk] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.rows:
            self.clear()
            self.tails.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and all ids of the text with the end id, as bytes: 16-bit if the vocabulary allows, else 32-bit."""
    kind = _kind(_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept(f"ids of {path}", lambda: Encoder(path, kind)), kind(end_id).tobytes()
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x + end for x in encoder.encode(texts)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _kind(size: int):
    return np.uint16 if size <= 1 << 16 else np.uint32


def ranks(coded: DataFrame, size: int) -> np.ndarray:
    """Rank of each id: by falling count over the whole corpus, then by id."""
    kind = _kind(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    out = np.empty(size, np.uint32)
    out[np.lexsort((np.arange(size), -counts))] = np.arange(size, dtype=np.uint32)
    return out


#: For each control byte the lengths of its four ids.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, np.uint32)
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    padded = np.zeros(-(-len(more) // 4) * 4, np.uint8)
    padded[: len(more)] = more
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values again."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    start = np.cumsum(length) - length
    # Bytes behind the end are read for short values and masked away.
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(length > k)
        out[some] |= raw[start[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_files(ids: DataFrame, rank: np.ndarray, folder: str) -> None:
    """Blocks in ascending document order, one file per range of documents."""
    kind = _kind(len(rank))
    schema = "part int, first long, doc_ids array<long>, lengths array<int>, control binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            control, data = coded(np.concatenate([rank[x] for _, x in held]))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(x) for _, x in held]], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], ["part", "first", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, kind)
                if held and size + len(x) > BLOCK_IDS:
                    yield block()
                    first, held, size = first + size, [], 0
                held.append((i, x))
                size += len(x)
        if held:
            yield block()

    order = ["doc_id", F.xxhash64("ids")]
    # Two columns of their own keep the text of a document out of the sampled bounds.
    ordered = ids.repartitionByRange(*order).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered.mapInArrow(run, schema).write.parquet(folder)


def read_files(files: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone."""
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = files.select("part", lengths.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per file
    before, ids_before = 0, {}
    for r in totals:
        ids_before[r.part], before = before, before + r.n
    unrank = np.argsort(rank).astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                ids = unrank[decoded(r["control"], r["data"], int(ends[-1]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(ids_before[r["part"]] + r["first"] + ends - n, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())], pa.int64()),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_output(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Encode, write the files to ``folder`` (a new one in the shared scratch folder if none is given), and read them back."""
    spark, path = docs.sparkSession, path or public_tokenizers.path(TOKENIZER)
    base = f"{scratch_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    raw = f"{base}/raw"
    token_ids(docs, path).write.option("compression", "zstd").parquet(raw)
    ids = spark.read.parquet(raw)
    rank = ranks(ids, _vocabulary(path))
    folder = folder or f"{base}/files"
    write_files(ids, rank, folder)
    return read_files(spark.read.parquet(folder), rank)
