"""Filter interaction audit: what each of five filters removes, alone, after others and in every order, per part of a corpus.

The filters' failures of a document are bits of a mask. All measures of all 120 orders are sums of the counts of the 32 masks, so documents are
counted once and never visited per order.

1. Four filters look at one text and run where it is read. The fifth, an exact duplicate of a smaller id's text, needs the whole table.
2. Prepass: every task counts hashes of its texts, ``HASHES`` counters a text, in a counting sketch that is merged by ranges of counters. A text with a
   counter of exactly one occurs once, for sure, and is cleared. The sketch has about ``COUNTERS`` counters a row, 2^MOST_BITS at most: the bitmap of
   ones that is sent to the tasks never exceeds 128 MB. A fuller sketch clears fewer texts, and the result stays the same.
3. Only texts that may repeat are grouped, in full, for their smallest id; copies meet in each task first, so a group of copies costs a row per task.
4. Rows that keep their place (the smallest id of their text) are found by id and 128-bit text key; the others fail.
5. Flags join the labels and become counts per part, mask and label; sums over the sets of masks give every order and step.

Defined cases: a null text is empty; empty texts are duplicates of each other; a null source is the part ''; a null id has no label, is never a
duplicate and never makes another row one; rows with the same id and text are no duplicates of each other; an id labelled more than once counts as
good (toxic) if any of its labels says so; an empty table gives an empty result; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.session import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Counters per row of the table, and counters that one text raises.
COUNTERS, HASHES = 8, 3
#: Counters of one merged range, and of the whole sketch at least and at most, as powers of two.
RANGE_BITS, LEAST_BITS, MOST_BITS = 16, 16, 30
#: Rows that a task holds before it passes their counters on.
FLUSH = 1 << 18
_U = np.uint64

WHITE = "[ \\t\\n\\x0b\\f\\r]+"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A (few words), B (repeated words), C (capitals), D (symbols); ``text`` is not null."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]"),
    }


def sketch_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(COUNTERS * rows - 1).bit_length() if rows else 0))


def counters_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The ``HASHES`` counters of every 64-bit key."""
    z = keys.view(np.uint64)
    step = (z * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits) | _U(1)
    first = z >> _U(64 - bits)
    return np.stack([(first + _U(k) * step) & _U((1 << bits) - 1) for k in range(HASHES)], 1).astype(np.int64)


def _partial(bits: int):
    """Counters that a task raised once, and more than once, by range of the sketch."""

    def rows(slots: np.ndarray) -> pa.RecordBatch:
        slot, n = np.unique(slots, return_counts=True)
        ends = np.flatnonzero(np.diff(slot >> RANGE_BITS)) + 1
        names, once, more = [], [], []
        for part, count in zip(np.split(slot, ends), np.split(n, ends)):
            low = (part & ((1 << RANGE_BITS) - 1)).astype(np.uint16)
            names.append(int(part[0] >> RANGE_BITS))
            once.append(low[count == 1].tobytes())
            more.append(low[count > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["range", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            # A text raises a counter of its own once, also where two of its hashes meet.
            slots = np.sort(counters_of(keys, bits), 1)
            slots = slots[np.concatenate([np.ones((len(slots), 1), bool), slots[:, 1:] != slots[:, :-1]], 1)]
            held.append(slots)
            n += len(keys)
            if n >= FLUSH:
                yield rows(np.concatenate(held))
                held, n = [], 0
        if n:
            yield rows(np.concatenate(held))

    return run


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of the counters of one range that are exactly one."""
    total = np.zeros(1 << RANGE_BITS, np.uint8)
    for batch in batches:
        for once, more in zip(batch.column(batch.schema.get_field_index("once")).to_pylist(), batch.column(batch.schema.get_field_index("more")).to_pylist()):
            slot = np.frombuffer(once, np.uint16)  # distinct within one row
            total[slot] = np.minimum(total[slot] + 1, 2)
            total[np.frombuffer(more, np.uint16)] = 2
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total == 1, bitorder="little").tobytes()], pa.binary())], ["range", "ones"])


def ones(keys: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Bitmap of the sketch's counters of exactly one over the 64-bit ``keys`` (one column), and the sketch's bits."""
    bits = sketch_bits(rows)
    merged = keys.mapInArrow(_partial(bits), "range int, once binary, more binary").groupBy("range").applyInArrow(_merge, "range int, ones binary")
    out = np.zeros((1 << bits - RANGE_BITS, 1 << RANGE_BITS - 3), np.uint8)
    for row in merged.toLocalIterator():  # 2^MOST_BITS bits in all, at most
        out[row.range] = np.frombuffer(row.ones, np.uint8)
    return out.ravel(), bits


def may_repeat(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """False where a counter of exactly one proves that the key occurs once."""
    slots = counters_of(keys, bits)
    return ~(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool).any(1)


def flagged(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, part and mask (bit k: failure of the filter FILTERS[k]) of every row; ``extra`` columns of ``docs`` come along."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"),
        *(c.alias(n) for n, c in (extra or {}).items()),
    ).withColumn("key", F.xxhash64("text"))
    found, bits = ones(base.select("key"), base.count())
    shared = spark.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def repeats(key: pa.Array) -> pa.Array:
        return pa.array(may_repeat(key.to_numpy(zero_copy_only=False), shared.value, bits))

    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures(F.col("text")).values())), F.lit(0))
    # The second half of the key tells texts apart that share the first.
    rows = written(base.select("doc_id", "part", *(extra or {}), "key", F.xxhash64(F.lit("second"), "text").alias("second"), mask.alias("mask")).withColumn(
        "repeat", repeats("key")), "flags")
    lows = base.select("doc_id", "text", "key").where(repeats("key")).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select(
        "doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit("second"), "text").alias("second"), F.lit(0).alias("first"))
    alone = rows.where("not repeat or doc_id is null").drop("repeat", "key", "second")
    again = rows.where("repeat and doc_id is not null").drop("repeat").join(lows, ["doc_id", "key", "second"], "left")
    again = again.withColumn("mask", F.col("mask") + F.coalesce("first", F.lit(16))).select(*alone.columns)
    return alone.unionByName(again)


def _set(letters: str) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


#: Order, step, filter, and the filters before and up to it, of every row of a part.
STEPS = [(o, s + 1, FILTERS.index(o[s]), _set(o[:s]), _set(o[: s + 1])) for o in ORDERS for s in range(len(FILTERS))]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def measures(mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of all ``STEPS`` from the counts of each mask (32 rows at most)."""
    k, before, after = (np.array([s[i] for s in STEPS]) for i in (2, 3, 4))
    sets = np.arange(1 << len(FILTERS))
    # What any set of filters leaves: the masks without a bit of it.
    left = {name: (sets[:, None] & mask == 0) @ v for name, v in (("n", n), ("good", good), ("toxic", toxic))}
    fails = mask >> np.arange(len(FILTERS))[:, None] & 1
    removed = left["n"][before] - left["n"][after]
    alone = (mask == 1 << np.arange(len(FILTERS))[:, None]) @ n
    # Among the filters that a document fails, each comes first in an equal share of the orders.
    share = fails @ (n * (len(ORDERS) // np.maximum(1, fails.sum(0))))
    return {
        "kept": left["n"][after], "removed": removed, "redundant": (fails @ n)[k] - removed, "unique_fails": alone[k],
        "good_lost": left["good"][before] - left["good"][after], "toxic_lost": left["toxic"][before] - left["toxic"][after], "shapley": share[k],
    }


def _expand(key: tuple, table: pa.Table) -> pa.Table:
    rows = measures(*(table[c].to_numpy().astype(np.int64) for c in ("mask", "n", "good", "toxic")))
    return pa.table({
        "part": pa.array([key[0].as_py()] * len(STEPS), pa.string()), "filter_order": pa.array([s[0] for s in STEPS], pa.string()),
        "step": pa.array([s[1] for s in STEPS], pa.int32()), **{m: pa.array(rows[m], pa.int64()) for m in MEASURES},
    })


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders of every part."""
    rows = flagged(docs)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    good, toxic = F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0))
    counts = rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(good).cast("long").alias("good"), F.sum(toxic).cast("long").alias("toxic"))
    return counts.groupBy("part").applyInArrow(_expand, RESULT)
