"""Best-fit packing of documents into token windows under conflicts.

A bin has ``capacity`` tokens and carries two bitmaps: the sources and the duplicate clusters it already holds. A document fits a
bin when it has room and neither bit is set. Documents are dealt to shards, and in each shard they are placed longest first: among
the bins ordered by residual room the search starts at the tightest one with room and moves to its successors until one is
compatible; if none is, a new bin opens. A document longer than the capacity is cut into pieces of at most ``capacity`` tokens, so no
text is lost; its pieces conflict with each other.

Shards have about ``shard_rows`` documents and are dealt by a hash of id and text, whatever the source or cluster, so a hot source
or a huge cluster spreads evenly and no task holds more than one shard. The number of shards follows the number of documents.

Defined cases: tokens are runs outside ASCII white space plus one end mark, so an empty or null text takes one token; a null source
is a source of its own; clusters are given, or else equal texts; repeated rows are documents of their own; equal lengths are placed in
the order of id and text hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 4096
_SCHEMA = "doc_id long, piece int, bin string, start int, n_tokens int"


class Shard:
    """Open bins of one shard, ordered by residual room."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity = capacity
        self.words = (sources + 63) // 64
        self.source_bits = np.zeros((64, self.words), np.uint64)
        self.cluster_bits = np.zeros((64, (clusters + 63) // 64), np.uint64)
        self.room = np.zeros(64, np.int64)
        self.count = 0
        self.order = np.zeros(0, np.int64)  # bins by (room, number)

    def _grow(self) -> None:
        for name in ("source_bits", "cluster_bits", "room"):
            x = getattr(self, name)
            setattr(self, name, np.concatenate([x, np.zeros_like(x)]))

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin that takes the piece, and where in it the piece starts."""
        s, c = np.uint64(1 << (source % 64)), np.uint64(1 << (cluster % 64))
        sw, cw = source // 64, cluster // 64
        found = -1
        at = int(np.searchsorted(self.room[self.order], size))
        while at < len(self.order):  # blocks of successors, the tightest first
            block = self.order[at : at + 256]
            free = (self.source_bits[block, sw] & s == 0) & (self.cluster_bits[block, cw] & c == 0)
            if free.any():
                at += int(free.argmax())
                found = int(self.order[at])
                self.order = np.delete(self.order, at)
                break
            at += len(block)
        if found < 0:
            if self.count == len(self.room):
                self._grow()
            found, self.count = self.count, self.count + 1
            self.room[found] = self.capacity
        start = self.capacity - int(self.room[found])
        self.room[found] -= size
        self.source_bits[found, sw] |= s
        self.cluster_bits[found, cw] |= c
        if self.room[found]:
            self.order = np.insert(self.order, int(np.searchsorted(self.room[self.order], self.room[found], side="right")), found)
        return found, start


def _packer(capacity: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, sizes, ties = rows["doc_id"].to_pylist(), rows["n_tokens"].to_numpy(), rows["tie"].to_numpy()
        _, sources = np.unique([x or "" if x is not None else "\0null" for x in rows["source"].to_pylist()], return_inverse=True)
        _, clusters = np.unique(rows["cluster"].to_numpy(), return_inverse=True)
        pieces = []
        for i, size in enumerate(sizes.tolist()):
            whole, rest = divmod(size, capacity)
            lengths = [capacity] * whole + [rest] * bool(rest)
            pieces += [(length, i, k) for k, length in enumerate(lengths)]
        pieces.sort(key=lambda p: (-p[0], ids[p[1]] is None, ids[p[1]] or 0, int(ties[p[1]]), p[2], p[1]))
        shard, out = Shard(capacity, int(sources.max()) + 1, int(clusters.max()) + 1), []
        for length, i, k in pieces:
            bin_, start = shard.place(length, int(sources[i]), int(clusters[i]))
            out.append((ids[i], k, f"{key[0].as_py()}-{bin_}", start, length))
        columns = list(zip(*out))
        return pa.table({
            "doc_id": pa.array(columns[0], pa.int64()), "piece": pa.array(columns[1], pa.int32()), "bin": pa.array(columns[2], pa.string()),
            "start": pa.array(columns[3], pa.int32()), "n_tokens": pa.array(columns[4], pa.int32()),
        })

    return pack


def token_counts(docs: DataFrame, cluster: Column | None = None) -> DataFrame:
    """doc_id, source, cluster, tie, n_tokens of every document; counted where the text is read."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int") + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", (F.xxhash64(text) if cluster is None else cluster).alias("cluster"),
        F.xxhash64("doc_id", text).alias("tie"), tokens.alias("n_tokens"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece, bin, start, n_tokens: where each document, or each piece of a long one, lies."""
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows must be positive")
    shards = max(1, -(-docs.select("doc_id").count() // shard_rows))
    sized = token_counts(docs, cluster).withColumn("shard", F.pmod(F.xxhash64(F.col("tie"), F.lit(7)), F.lit(shards)))
    return sized.groupBy("shard").applyInArrow(_packer(capacity), _SCHEMA)


def bins(packed: DataFrame) -> Iterator:
    """Fill of each bin: bin, pieces, n_tokens."""
    return packed.groupBy("bin").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n_tokens"))
