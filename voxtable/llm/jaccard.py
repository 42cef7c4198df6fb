"""N-gram Jaccard join: documents whose word shingle sets have a Jaccard similarity of ``percent`` / 100 or more, and their components.

Words are runs of bytes outside ASCII white space, with A-Z lower-cased; a document's set holds its distinct ``n``-word shingles, or the
whole sequence if it has fewer words. Sets are compared as 64-bit hashes of shingles.

1. One scan gives each document's set size and a 128-bit signature of its set, and counts shingles in a sketch of fixed size. Documents
   with equal sets are one class from here on.
2. A second scan orders each set rare-first (by the sketch's count class, then by hash: one order for all documents) and emits its prefix.
   Two sets that reach the threshold share a shingle of their prefixes. The shingles of two or more sets become the posting lists.
3. A third scan counts each listed set by hash range, for the suffix filter: the counts bound the difference of two sets from below, exactly.
4. Round one pairs each list's first member with its other members that pass the length, positional and suffix filters. A scan fetches the
   sets of the pairs left (a bitmap lets the others go where they are read), and each pair is verified once, in however many
   lists it stands. Linked classes form components.
5. Round two takes the lists whose other members still lie in different components; of lists with the same members, the first. Lists are cut
   into blocks, and each pair of blocks is a unit of work. A unit looks at a pair only if its list is that of the pair's first common shingle, so
   every pair is verified once at most. A first pass over the units names the members with a pair that the length, positional and suffix filters
   leave; a second one, which knows their prefixes, those with a pair that this list is the first for; a third one has their sets, verifies, and
   sends no more links than join its members. None sends a row per pair, and rows grow heavier only as they grow few.

Every pair that shares a prefix shingle is thus either in one component already, or excluded by an exact filter, or verified: components
equal those of all links. Groups of copies cost a row per copy and list, not a row per pair.

Defined cases: documents without words, or with null text, link with nothing and are their own component; rows with equal ids are judged
one by one, and a component is named by its smallest id; a null id is named only if no other id is there; equal texts with different white
space are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import WordHasher, joined_words, mixed, text_slices
from voxtable.operators.graph import linked_components
from voxtable.session import written

WHITE = b" \t\n\x0b\x0c\r"
SKETCH_BITS = 20
#: Fewest hash ranges of the suffix filter; a larger set has one for about eight members, which still tells unrelated sets apart.
RANGES = 64
#: Members of a block of a posting list.
BLOCK = 512
#: Bits of the bitmap of wanted classes: sixteen for a class, as powers of two between these bounds (128 MB at most).
LEAST_BITS, MOST_BITS = 16, 30
_U = np.uint64


def shingle_sets(hasher: WordHasher, texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    h, _, _, doc = joined_words(hasher, texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        z = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n if len(z) else 0):
            z = mixed(z + h[k : k + len(z)] * _U(2 * k + 0x9E3779B97F4A7C15))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(z[a : b - n + 1]))
            elif b > a:
                whole = _U(b - a)
                for x in h[a:b]:
                    whole = mixed(np.array([whole * _U(0x9E3779B97F4A7C15) + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(z: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    with np.errstate(over="ignore"):
        return np.array([mixed(z).sum(dtype=np.uint64), mixed(z ^ _U(0xA5A5F00DBEEF1234)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sizes_and_sketch(n: int):
    schema = "doc_id long, n int, node binary, slot int, counts binary"
    names = ["doc_id", "n", "node", "slot", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = WordHasher(WHITE), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch, texts in text_slices(batches, "text"):
            sets = shingle_sets(hasher, texts, n)
            flat = np.concatenate(sets)
            np.add.at(sketch, (flat >> _U(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            empty = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(z) for z in sets], pa.int32()), pa.array([signature(z) if len(z) else None for z in sets], pa.binary()),
                empty.cast(pa.int32()), empty.cast(pa.binary()),
            ], names)
        slots = sketch.reshape(256, -1)
        some = np.flatnonzero(slots.any(axis=1))
        empty = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays([
            empty.cast(pa.int64()), empty.cast(pa.int32()), empty.cast(pa.binary()), pa.array(some, pa.int32()),
            pa.array([np.minimum(slots[i], 65535).astype(np.uint16).tobytes() for i in some], pa.binary()),
        ], names)

    return run, schema


def _classes_of_counts(parts: DataFrame) -> np.ndarray:
    """Count class (twice the binary logarithm) of each sketch slot; the sketch has a fixed size."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS - 8, np.uint64)
        for batch in rows:
            for x in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(x, np.uint16)
        level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slot", "level"])

    out = np.zeros((256, 1 << SKETCH_BITS - 8), np.uint8)
    for r in parts.groupBy("slot").applyInArrow(add, "slot int, level binary").collect():  # 256 rows at most
        out[r.slot] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def rare_first(z: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A sorted set in the order (count class, hash)."""
    return z[np.argsort(level[(z >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def _needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Smallest common size of two sets with this total size that reach the threshold."""
    return -(-percent * total // (100 + percent))


def _prefixes(n: int, percent: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, ranks = WordHasher(WHITE), set(), level.value
        for _, texts in text_slices(batches, "text"):
            tokens, nodes, sizes, places = [], [], [], []
            for z in shingle_sets(hasher, texts, n):
                if not len(z) or (node := signature(z)) in seen:
                    continue
                seen.add(node)
                keep = prefix_length(len(z), percent)
                tokens.append(rare_first(z, ranks)[:keep])
                nodes += [node] * keep
                sizes.append(np.full(keep, len(z)))
                places.append(np.arange(keep))
            if tokens:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(nodes, pa.binary()), pa.array(np.concatenate(sizes), pa.int32()),
                    pa.array(np.concatenate(places), pa.int32()),
                ], ["token", "node", "n", "place"])

    return run, "token long, node binary, n int, place int"


def range_counts(z: np.ndarray) -> np.ndarray:
    """Members by hash range, up to 255 each; the number of ranges is a power of two."""
    size = max(RANGES, 1 << (len(z) // 8).bit_length())
    return np.minimum(np.bincount((z & _U(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts over fewer ranges; the last axis holds the ranges."""
    return counts.reshape(*counts.shape[:-1], -1, size).sum(-2, dtype=np.int32)


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size // 100) + 1


def _fetch(texts: DataFrame, nodes: DataFrame, n: int, kind: str, level=None, percent: int = 0) -> DataFrame:
    """node and value of the wanted classes; a few others may come along.

    The value is the set itself (``sets``, rare-first if there is a ``level``) or its counts by hash range (``ranges``); with ``leads`` the rare-first
    prefix comes in a column ``lead`` beside the counts.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * nodes.count()).bit_length()))
    wanted = texts.sparkSession.sparkContext.broadcast(_bitmap(nodes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marked, seen = WordHasher(WHITE), wanted.value, set()
        for _, part in text_slices(batches, "text"):
            found = {}
            for z in shingle_sets(hasher, part, n):
                node = signature(z) if len(z) else b""
                at = int.from_bytes(node[:4], "little") % (1 << bits)
                if node and node not in seen and marked[at >> 3] >> (at & 7) & 1:
                    lead = rare_first(z, level.value)[: prefix_length(len(z), percent)].tobytes() if kind == "leads" else None
                    found[node] = (z.tobytes() if kind == "sets" else range_counts(z).tobytes(), lead)
            seen.update(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), *(pa.array(c, pa.binary()) for c in zip(*found.values()))], ["node", "value", "lead"])

    out = texts.mapInArrow(run, "node binary, value binary, lead binary").dropDuplicates(["node"])
    return written(out if kind == "leads" else out.drop("lead"), kind)


def _bitmap(nodes: DataFrame, bits: int) -> bytes:
    """A bitmap of the nodes' first four bytes."""
    pieces = 256

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = np.array([int.from_bytes(node[:4], "little") % (1 << bits) for node in batch.column(0).to_pylist()], np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = held.reshape(pieces, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["slot", "bits"])

    def unite(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = reduce(np.bitwise_or, (np.frombuffer(x, np.uint8) for batch in rows for x in batch.column(batch.schema.get_field_index("bits")).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([both.tobytes()], pa.binary())], ["slot", "bits"])

    out = np.zeros((pieces, (1 << bits - 3) // pieces), np.uint8)
    for r in nodes.mapInArrow(mark, "slot int, bits binary").groupBy("slot").applyInArrow(unite, "slot int, bits binary").toLocalIterator():  # 2^bits bits in all
        out[r.slot] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold; each is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return _with_values(pairs, sets).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    left = values.select(F.col("node").alias("a"), F.col("value").alias("x"))
    right = values.select(F.col("node").alias("b"), F.col("value").alias("y"))
    return pairs.join(left, "a").join(right, "b")


def _near(pairs: DataFrame, ranges: DataFrame, percent: int) -> DataFrame:
    """The pairs that the suffix filter leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                far.append(int(np.abs(folded(x, size) - folded(y, size)).sum()))
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = pa.array(np.array(far, np.int64) <= total - 2 * _needed(total, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return _with_values(pairs, ranges).select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a binary, b binary")


class Unit:
    """The members of one or two blocks of a posting list, and the pairs across them that are looked at here.

    ``lead``, where the rows have it, holds the shingles that come before this list's shingle in each member's prefix. A pair that has one of them in
    common stands in an earlier list.
    """

    #: Largest count vectors that are kept folded for all members.
    FOLDED = 1 << 12

    def __init__(self, table: pa.Table, low: int, high: int, percent: int):
        self.percent = percent
        self.n, self.place = (table[c].to_numpy().astype(np.int64) for c in ("n", "place"))
        self.counts = [np.frombuffer(x, np.uint8) for x in table["value"].to_pylist()]
        self.ranges = np.array([len(x) for x in self.counts], np.int64)
        _, self.parent = np.unique(np.array(table["comp"].to_pylist(), object), return_inverse=True)
        self.parent = self.parent.astype(np.int64)
        leads = [np.frombuffer(x or b"", np.uint64) for x in table["lead"].to_pylist()] if "lead" in table.column_names else [np.zeros(0, np.uint64)] * table.num_rows
        self.lead_start = np.cumsum([0] + [len(x) for x in leads])
        names, self.leads = np.unique(np.concatenate(leads), return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        block = table["block"].to_numpy()
        self.left, self.right, self.same = np.flatnonzero(block == low), np.flatnonzero(block == high), low == high
        self.cache: dict[int, np.ndarray] = {}

    def _apart(self, i: int, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences between set i and the sets j."""
        out, size = np.zeros(len(j), np.int64), np.minimum(self.ranges[i], self.ranges[j])
        for wide in np.unique(size).tolist():
            at = np.flatnonzero(size == wide)
            own = folded(self.counts[i], wide)
            if wide <= self.FOLDED:
                if wide not in self.cache:
                    fits = np.flatnonzero(self.ranges >= wide)
                    rows = np.zeros((len(self.counts), wide), np.int32)
                    for k in fits.tolist():
                        rows[k] = folded(self.counts[k], wide)
                    self.cache[wide] = rows
                out[at] = np.abs(self.cache[wide][j[at]] - own).sum(1)
            else:
                out[at] = [int(np.abs(folded(self.counts[k], wide) - own).sum()) for k in j[at].tolist()]
        return out

    def candidates(self, i: int) -> np.ndarray:
        """Members of the other block that could be similar to i, across components, with this list as the first common one."""
        j = self.right[self.right > i] if self.same else self.right
        n, m = self.n[i], self.n[j]
        need = _needed(n + m, self.percent)
        use = (self.parent[i] != self.parent[j]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & (np.minimum(n - self.place[i], m - self.place[j]) >= need)
        j, need = j[use], need[use]
        if len(j):
            mine = self.leads[self.lead_start[i] : self.lead_start[i + 1]]
            self.mark[mine] = True
            seen = np.concatenate([[0], np.cumsum(self.mark[self.leads])])
            self.mark[mine] = False
            first = seen[self.lead_start[j + 1]] == seen[self.lead_start[j]]
            j, need = j[first], need[first]
        if len(j):
            j = j[self._apart(i, j) <= n + self.n[j] - 2 * need]
        return j

    def join(self, i: int, j: int) -> None:
        self.parent[self.parent == self.parent[j]] = self.parent[i]


def _involved(percent: int):
    """The members of a unit that have a candidate in it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit = Unit(table, key[1].as_py(), key[2].as_py(), percent)
        keep = np.zeros(table.num_rows, bool)
        for i in unit.left.tolist():
            j = unit.candidates(i)
            keep[j] = True
            keep[i] |= len(j) > 0
        return table.filter(pa.array(keep))

    return run


def _joined(percent: int):
    """Links (a, b) that join the components of a unit's members: at most one fewer than it has members."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit = Unit(table, key[1].as_py(), key[2].as_py(), percent)
        sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
        start = np.cumsum([0] + [len(z) for z in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark, links = np.zeros(len(names), bool), []
        for i in unit.left.tolist():
            j = unit.candidates(i)
            if not len(j):
                continue
            mine, size = flat[start[i] : start[i + 1]], start[j + 1] - start[j]
            first = np.cumsum(size) - size
            mark[mine] = True
            common = np.add.reduceat(mark[flat[np.repeat(start[j] - first, size) + np.arange(size.sum())]].astype(np.int64), first)
            mark[mine] = False
            for k in j[100 * common >= percent * (unit.n[i] + unit.n[j] - common)].tolist():
                if unit.parent[i] != unit.parent[k]:  # not joined since
                    unit.join(i, k)
                    links.append((i, k))
        nodes = table["node"].to_pylist()
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.binary()), "b": pa.array([nodes[k] for _, k in links], pa.binary())})

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def similar_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; a component is named by its smallest doc_id."""
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent must lie in 1 to 100, and n be positive")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _sizes_and_sketch(n)
    first = written(texts.mapInArrow(run, schema), "sizes")
    own = first.where("slot is null").select("doc_id", "n", "node")
    level = spark.sparkContext.broadcast(_classes_of_counts(first.where("slot is not null").select("slot", "counts")))

    run, schema = _prefixes(n, percent, level)
    # Lists of one set end here. All rows of a token meet; the rows of copies were dropped where they were read.
    tokens = texts.mapInArrow(run, schema).repartition("token").dropDuplicates(["token", "node"])
    token = Window.partitionBy("token")
    lists = tokens.withColumn("size", F.count("*").over(token)).where("size > 1").withColumn("hub", F.min(F.struct("node", "n", "place")).over(token))
    lists = written(lists, "lists")

    ranges = _fetch(texts, lists.select("node"), n, "ranges")

    h, mine = F.col("hub.n"), F.col("n")
    common = F.least(h - F.col("hub.place"), mine - F.col("place"))
    reach = (100 * F.least(h, mine) >= percent * F.greatest(h, mine)) & (common >= F.ceil(percent * (h + mine) / (100 + percent)))
    pairs = lists.where((F.col("hub.node") != F.col("node")) & reach).select(F.col("hub.node").alias("a"), F.col("node").alias("b"), h.alias("n"), mine.alias("m")).distinct()
    pairs = written(_near(pairs, ranges, percent), "pairs")
    links = written(_verified(pairs, _fetch(texts, _ends(pairs), n, "sets"), percent), "links")
    member = written(linked_components(links), "members")

    # Pairs with the first member of a list are decided. Lists of two are done, and so are lists whose other members lie in one component.
    others = lists.where((F.col("hub.node") != F.col("node")) & (F.col("size") > 2)).drop("hub")
    placed = written(others.join(member, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "placed")
    # Of lists with the same members only the first in the common order counts: every pair comes first there.
    mark = F.xxhash64("node")
    state = placed.groupBy("token").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"), F.bit_xor(mark).alias("mark"),
        F.sum(F.pmod(mark, F.lit((1 << 31) - 1))).alias("sum"), F.sum("place").alias("places"),
    ).where("low != high")
    tokens = state.groupBy("members", "mark", "sum").agg(F.min_by("token", F.struct("places", "token")).alias("token")).select("token")
    # Counts are wanted for members of open lists only; both joins by class meet before the lists are dealt out.
    open_ = placed.join(tokens, "token").join(ranges, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    unit = ["token", "low", "high"]
    rows = open_.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "place", "comp", "value")
    near = written(rows.groupBy(*unit).applyInArrow(_involved(percent), rows.schema), "near")
    leads = _fetch(texts, near.select("node"), n, "leads", level, percent).select("node", "lead")
    # A row carries only the shingles before its place.
    first = near.join(leads, "node").withColumn("lead", F.expr("substring(lead, 1, 8 * place)")).select(*near.columns, "lead")
    first = written(first.groupBy(*unit).applyInArrow(_involved(percent), first.schema), "near")
    members = _fetch(texts, first.select("node"), n, "sets").select("node", F.col("value").alias("members"))
    more = written(first.join(members, "node").groupBy(*unit).applyInArrow(_joined(percent), "a binary, b binary"), "links")
    final = linked_components(links.unionByName(more))

    classes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("smallest"))
    named = classes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    ids = named.join(roots, "root").select("node", "component_id")
    out = own.join(ids, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
