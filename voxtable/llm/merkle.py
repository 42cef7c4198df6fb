"""Merkle manifest of a document table: a postorder append log per language, proofs addressed by closed-form positions.

Every row is a leaf: the hash of its fields. Leaves of a language ascend by id; every ``FAN`` consecutive nodes have a parent, up to one node,
the subroot. The subroots, ordered by language, form one more tree of the same shape, up to the root.

The log of a tree holds its nodes in the order of their completion: a leaf, then every ancestor whose last leaf it is. In a tree of n leaves the
node of height h and index i has the last leaf e = min((i + 1) * FAN^h, n) - 1 and stands at e + h + sum over k of floor(e / FAN^k): all leaves up to
e, the inner nodes complete before e, and its own h predecessors since. A position thus follows from subtree sizes alone, without a search or a pointer.

1. Leaf hashes are made where texts are read; from there on a row is an id and two digests. A range sort by (language, id) numbers the leaves:
   row numbers inside each task, plus the sizes of the tasks before it.
2. Aligned builders take ``FAN ** LEVELS`` consecutive nodes each and append their ancestors of ``LEVELS`` levels; the tops are the next round's leaves.
   Rounds grow with the logarithm of the largest tree; the log of each round is a written table.
3. Proofs go down the same rounds: a block knows the siblings above its top, addresses the siblings inside its own part of the log, and hands both
   on. No leaf is joined with its siblings one by one.

Defined cases: a null field is hashed as ``-``, an empty text as ``0:``; null ids come first in their language; rows with equal ids are ordered by their
leaves, equal rows stand side by side; a null language is a tree of its own, first in order; a single leaf is its own subroot, a single subroot the root, and
a proof without siblings is the hash of nothing; an empty table gives an empty result; other columns are ignored. Long texts cost their bytes once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtable.session import written

FAN = 8
#: Levels that one builder completes; a block has at most FAN ** LEVELS nodes at its base.
LEVELS = 4
WIDTH = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tree of the subroots; trees of languages are "0" for null and "1" with the language.
TOP = "2"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents whose text is ``text``."""
    return F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def tree_of(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def height(n: int) -> int:
    """Height of a tree of ``n`` leaves."""
    h, width = 0, 1
    while width < n:
        h, width = h + 1, width * FAN
    return h


def nodes_at(n: int, h: int) -> int:
    return -(-n // FAN**h)


def position(n: int, h: int, index):
    """Place of the nodes of height ``h`` in the log of a tree of ``n`` leaves; ``index`` is a number or an array."""
    last = np.minimum((np.asarray(index, np.int64) + 1) * FAN**h, n) - 1
    out, rest = last + h, last // FAN
    while np.any(rest):
        out, rest = out + rest, rest // FAN
    return out


def sibling_positions(n: int, index: int) -> list[tuple[list[int], list[int]]]:
    """Per level of the tree, from the leaf ``index`` up: log positions of the siblings before and after its ancestor."""
    out = []
    for h in range(height(n)):
        i = index // FAN**h
        first = i - i % FAN
        after = range(i + 1, min(first + FAN, nodes_at(n, h)))
        out.append(([int(position(n, h, k)) for k in range(first, i)], [int(position(n, h, k)) for k in after]))
    return out


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``index`` (from 0, in ``order``) and ``size`` of their tree, without one task per tree."""
    columns = rows.columns
    keys = ["tree", *order, "_row"]
    spread = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            # Runs of one tree; a run may go on from the batch before.
            names = batch.column(0).to_pylist()
            place = np.empty(len(names), np.int64)
            for k, name in enumerate(names):
                if name != tree:
                    tree, at = name, 0
                place[k] = at
                at += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(names), part), pa.int32()), pa.array(place)], [*batch.schema.names, "_part", "_place"])

    from pyspark.sql.types import IntegerType, LongType, StructType

    ordered = spread.select("tree", *(c for c in columns if c != "tree"))
    schema = StructType([*ordered.schema.fields]).add("_part", IntegerType()).add("_place", LongType())
    placed = written(ordered.mapInArrow(count, schema), "numbered")
    # One row for each tree and task.
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    return placed.join(starts, ["tree", "_part"]).select(*columns, (F.col("_start") + F.col("_place")).alias("index"), "size")


LOG = "tree string, size long, position long, height int, index long, digest string, doc_id long, changed string"
LOG_NAMES = [part.split()[0] for part in LOG.split(", ")]


def _builder(base: int):
    """Nodes of a block, in the order of their completion; the base is part of the log in the first round only."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        n, first = table["size"][0].as_py(), table["index"][0].as_py()
        level, at = table["digest"].to_pylist(), first
        digests, heights, indices = ([level], [np.full(len(level), base)], [np.arange(at, at + len(level))]) if base == 0 else ([], [], [])
        for h in range(base + 1, min(base + LEVELS, height(n)) + 1):
            level, at = [hashed("".join(level[k : k + FAN])) for k in range(0, len(level), FAN)], at // FAN
            digests.append(level)
            heights.append(np.full(len(level), h))
            indices.append(np.arange(at, at + len(level)))
        if not digests:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string())], LOG_NAMES)
        places = np.concatenate([position(n, int(h[0]), i) for h, i in zip(heights, indices)])
        order, more = np.argsort(places), len(places) - (table.num_rows if base == 0 else 0)
        own = [table[c].combine_chunks() if base == 0 else pa.nulls(0, t) for c, t in (("doc_id", pa.int64()), ("changed", pa.string()))]
        return pa.table([
            pa.array([table["tree"][0].as_py()] * len(places), pa.string()), pa.array(np.full(len(places), n)), pa.array(places),
            pa.array(np.concatenate(heights), pa.int32()), pa.array(np.concatenate(indices), pa.int64()), pa.array(sum(digests, []), pa.string()),
            *(pa.concat_arrays([x, pa.nulls(more, x.type)]) for x in own),
        ], LOG_NAMES).take(order)

    return run


def _append(leaves: DataFrame, rounds: int) -> DataFrame:
    """The log of all trees whose numbered ``leaves`` are given."""
    base, log = leaves.withColumn("height", F.lit(0)), None
    for step in range(rounds):
        low = step * LEVELS
        block = F.expr(f"index div {WIDTH}")
        part = written(base.withColumn("block", block).groupBy("tree", "block").applyInArrow(_builder(low), LOG), "log")
        log = part if log is None else log.unionByName(part)
        # Tops that are no subroots go on.
        base = part.where((F.col("height") == low + LEVELS) & (F.col("size") > F.lit(FAN ** (low + LEVELS))))
    return log


def _top(log: DataFrame) -> DataFrame:
    """The one highest node of each tree."""
    return log.where(F.col("size") <= F.pow(F.lit(FAN), F.col("height"))).where("index = 0").where((F.col("height") == 0) | (F.col("size") > F.pow(F.lit(FAN), F.col("height") - 1)))


@dataclass
class Manifest:
    """log: all nodes (tree, size, position, height, index, digest; leaves with their doc_id and the leaf to verify, ``changed``).
    subroots: tree, lang, size, digest, and the place in the tree of subroots. root: null for an empty table."""

    log: DataFrame
    subroots: DataFrame
    root: str | None
    rounds: int
    top_rounds: int


def _rounds(size: int) -> int:
    return max(1, -(-height(size) // LEVELS))


def build(docs: DataFrame, text: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text). ``text``: what is to be verified in place of the text, itself by default."""
    leaves = docs.select(
        tree_of(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("digest"),
        leaf(F.col("text") if text is None else text).alias("changed"),
    )
    placed = numbered(leaves, "doc_id", "digest")
    largest = placed.agg(F.max("size")).first()[0]
    rounds = _rounds(largest or 1)
    log = _append(placed, rounds)
    tops = _top(log).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest", F.col("size").alias("leaves"))
    upper = written(numbered(tops, "of"), "subroots")
    langs = upper.agg(F.max("size")).first()[0]
    top_rounds = _rounds(langs or 1)
    top_log = _append(upper.withColumn("doc_id", F.lit(None).cast("long")).withColumn("changed", F.lit(None).cast("string")), top_rounds)
    found = _top(top_log).select("digest").first()
    subroots = upper.select(
        F.col("of").alias("tree"), F.when(F.col("of") != "0", F.expr("substring(of, 2)")).alias("lang"), F.col("leaves").alias("size"), "digest", "index")
    return Manifest(log.unionByName(top_log), subroots, found.digest if found else None, rounds, top_rounds)


PATH = "tree string, index long, lefts array<string>, rights array<string>, subroot string"
PROOF = "tree string, index long, doc_id long, leaf string, changed string, subroot string, proof_sha256 string, folded_root string"
_STRINGS = pa.list_(pa.string())


def _extractor(base: int, last: bool):
    """Siblings of every base node of a block, then those of the block's top; as digests of a proof in the last round."""

    def run(segment: pa.Table, above: pa.Table) -> pa.Table:
        segment = segment.sort_by("position")
        n = segment["size"][0].as_py()
        places, digests = segment["position"].to_numpy(), segment["digest"].to_pylist()
        at_base = np.flatnonzero(segment["height"].to_numpy() == base)
        index = segment["index"].to_numpy()[at_base]
        first, count = int(index.min()), len(index)
        lefts, rights = [[] for _ in range(count)], [[] for _ in range(count)]
        for h in range(base, min(base + LEVELS, height(n))):
            step = FAN ** (h - base)
            own = np.arange(first // step, (first + count - 1) // step + 1)
            level = [digests[k] for k in np.searchsorted(places, position(n, h, own)).tolist()]
            for k in range(len(level)):
                run_ = k - k % FAN
                left, right = "".join(level[run_:k]), "".join(level[k + 1 : run_ + FAN])
                for x in range(k * step, min((k + 1) * step, count)):
                    lefts[x].append(left)
                    rights[x].append(right)
        top_left, top_right = above["lefts"][0].as_py(), above["rights"][0].as_py()
        subroot = above["subroot"][0].as_py()
        tree = pa.array([segment["tree"][0].as_py()] * count, pa.string())
        for x in range(count):
            lefts[x] += top_left
            rights[x] += top_right
        if not last:
            return pa.table([tree, pa.array(index), pa.array(lefts, _STRINGS), pa.array(rights, _STRINGS), pa.array([subroot] * count, pa.string())],
                            ["tree", "index", "lefts", "rights", "subroot"])
        rows = segment.take(pa.array(at_base))
        proofs, folded = [], []
        for x, node in enumerate(rows["changed"].to_pylist()):
            proofs.append(hashed("".join(a + b for a, b in zip(lefts[x], rights[x]))))
            for a, b in zip(lefts[x], rights[x]):
                node = hashed(a + node + b)
            folded.append(node)
        return pa.table([tree, pa.array(index), rows["doc_id"], rows["digest"], rows["changed"], pa.array([subroot] * count, pa.string()), pa.array(proofs, pa.string()),
                         pa.array(folded, pa.string())], ["tree", "index", "doc_id", "leaf", "changed", "subroot", "proof_sha256", "folded_root"])

    return run


def _paths(log: DataFrame, tops: DataFrame, rounds: int, last: bool) -> DataFrame:
    """Down from the ``tops`` (one per tree: size, lefts, rights, subroot): the siblings above every leaf, or its proof."""
    carried = None
    for step in range(rounds - 1, -1, -1):
        low = step * LEVELS
        starts = tops.where(F.col("size") <= F.lit(FAN ** (low + LEVELS)))
        if step:
            starts = starts.where(F.col("size") > F.lit(FAN**low))
        starts = starts.select("tree", F.lit(0).cast("long").alias("index"), "lefts", "rights", "subroot")
        above = starts if carried is None else starts.unionByName(carried)
        # Nodes under the tops of this round; a lone leaf is its own top.
        inside = log.where((F.col("height") >= low) & (F.col("height") < low + LEVELS))
        if step:
            inside = inside.where(F.col("size") > F.lit(FAN**low))
        width = F.pow(F.lit(FAN), F.lit(low + LEVELS) - F.col("height")).cast("long")
        inside = inside.withColumn("block", F.floor(F.col("index") / width))
        final = last and step == 0
        carried = inside.groupBy("tree", "block").cogroup(above.withColumn("block", F.col("index")).groupBy("tree", "block")).applyInArrow(
            _extractor(low, final), PROOF if final else PATH)
        carried = carried if step == 0 else written(carried, "paths")
    return carried


def proofs(manifest: Manifest) -> DataFrame:
    """tree, index, doc_id, leaf, changed, subroot, root, proof_sha256, folded_root, verified of every leaf."""
    spark = manifest.log.sparkSession
    none = F.array().cast("array<string>")
    root = F.lit(manifest.root)
    log = manifest.log
    start = manifest.subroots.agg(F.max(F.lit(1)).alias("one"), F.count("*").alias("size")).where("size > 0").select(
        F.lit(TOP).alias("tree"), "size", none.alias("lefts"), none.alias("rights"), root.alias("subroot"))
    upper = _paths(log.where(F.col("tree") == TOP), start, manifest.top_rounds, False)
    tops = manifest.subroots.join(upper.select("index", "lefts", "rights"), "index").select("tree", "size", "lefts", "rights", F.col("digest").alias("subroot"))
    rows = _paths(log.where(F.col("tree") != TOP), written(tops, "paths"), manifest.rounds, True)
    return rows.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def lookup(manifest: Manifest, lang: str | None, index: int) -> list[tuple[list[str], list[str]]]:
    """The proof of one leaf: per level the digests before and after, read from the log by position alone."""
    tree = "0" if lang is None else "1" + lang
    subroot = manifest.subroots.where(F.col("tree") == tree).first()
    places = [(tree, sibling_positions(subroot["size"], index)), (TOP, sibling_positions(manifest.subroots.count(), subroot["index"]))]
    out = []
    for name, levels in places:
        wanted = [p for left, right in levels for p in left + right]
        found = {r.position: r.digest for r in manifest.log.where((F.col("tree") == name) & F.col("position").isin(wanted)).select("position", "digest").collect()}
        out += [([found[p] for p in left], [found[p] for p in right]) for left, right in levels]
    return out
