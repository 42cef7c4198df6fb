"""Helpers the corpus operators share: tables, bounded slices of Arrow batches, word hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on, so that its arrays stay small whatever the batch holds.
SLICE_BYTES = 1 << 20
#: Longest buffer whose positions get powers at once; a longer text is cut at separators. One more byte would double the table of powers.
PIECE_BYTES = (1 << 18) - 1

_U = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def first_by_hash(rows: DataFrame, order: Column, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hash ``order``, then ``ties``.

    Rows beyond a bound that about twice as many rows meet go before anything is sent, so the one task that sorts gets a few ``n``, however many tasks there are.
    """
    total = rows.count()
    few = rows
    if total > 4 * n:
        bound = -(1 << 63) + int((2 * n + 200) / total * 2**64)
        few = rows.where(order <= F.lit(min(bound, (1 << 63) - 1)))
        if few.count() < n:
            few = rows
    return few.orderBy(order, *ties).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> list:
    """(text, label) rows to learn from: at most ``per_class`` of each class, in the order of a hash of the id.

    Only rows of ``labels`` that satisfy ``train`` count. Null ids, null labels and ids whose labels disagree are left out.
    The ids are chosen first, so no more than ``2 * per_class`` texts reach the driver.
    """
    clean = (
        labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).where(train)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    )
    present = clean.join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        part = first_by_hash(present.where(F.col("y") == y), order, ["doc_id"], per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of 12 bytes.
    picked = {r.doc_id: r.y for r in chosen.collect()}
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(list(picked.items()), "doc_id bigint, y int")
    # Of rows with equal ids the first text counts, in every run the same.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r.text or "", picked[r.doc_id]) for r in sorted(rows, key=lambda r: r.doc_id)]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each (one row at least), and the texts; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, end - at), [v or b"" for v in texts.slice(at, end - at).cast(pa.large_binary()).to_pylist()]
            at = end


def kept(name: str, make: Callable):
    """An object that a Python worker keeps from task to task, made where there is none; a lost worker only makes it again."""
    state = sys.modules.setdefault("_voxtable_worker", types.ModuleType("_voxtable_worker")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def mixed(z: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every bit of the result depends on every bit of ``z``."""
    z = z ^ (z >> _U(30))
    z = z * _U(0xBF58476D1CE4E5B9)
    z = z ^ (z >> _U(27))
    z = z * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class WordHasher:
    """64-bit hashes of all words of a buffer, without a loop over words.

    A word is a run of bytes outside ``separators``. Its hash is a polynomial in the positions with a random value per byte,
    taken from prefix sums modulo 2^64 and shifted back to the word's start.
    """

    def __init__(self, separators: bytes, lower: bool = True):
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        codes = np.arange(256, dtype=np.uint64)
        if lower:
            codes[65:91] = codes[97:123]
        self.value = mixed(codes * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
        self.base = _U(0xD6E8FEB86659FD93)
        self.back = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, self.base)]))
                self.down = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, self.back)]))

    def words(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word, in order."""
        data = np.frombuffer(buffer, np.uint8)
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE_BYTES)
            if end < len(data):
                gaps = np.flatnonzero(self.apart[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # a word longer than a piece: up to its end
                    more = np.flatnonzero(self.apart[data[end:]])
                    end = end + int(more[0]) if len(more) else len(data)
            out.append(self._piece(data[at:end], at))
            at = end
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def _piece(self, data: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.concatenate([[False], ~self.apart[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        self._powers(len(data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum(self.value[data] * self.up[: len(data)], dtype=np.uint64)])
            h = (total[end] - total[start]) * self.down[start]
            h = mixed(h + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        return h, start + offset, end + offset


def joined_words(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of the words of several texts, as positions in the texts joined by a line feed."""
    buffer = b"\n".join(texts)
    h, start, end = hasher.words(buffer)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, start, end, np.searchsorted(begins, start, side="right") - 1
