"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours, audited, and cut at a cosine.

1. First lists: under several random orders (bits of hyperplane signs, then one projection) the vectors are sorted by range partitions, and each
   run of ``LEAF`` vectors is compared within itself. Every vector keeps its ``K`` best.
2. Rounds: each vector gathers its neighbours and those that name it, and these meet each other; every pair may improve the lists of both.
   Rounds go on while one finds more than ``CHANGE`` new links.
3. Enlarging: a list is saturated when all its entries reach the threshold; a link can hide only where both lists are saturated. Saturated
   vectors get lists of twice the length and descend again among each other, until no list is saturated or lists hold ``LONGEST`` entries.
4. Growing: what is still saturated is searched again without the vectors of its own component, so what it already reaches takes no place in
   its lists. Links found so merge components; every search either merges some or is the last.
5. Audit: a bounded, hash-ordered sample of all vectors is compared with all vectors, a larger one if it has fewer than ``LEAST_SEEN`` links.
   Recall is taken per link, and as the mean over vectors with few and with many links. While one of them is below ``GOAL``, another set of orders follows, ``MOST_ROUNDS`` at most; if that does not
   reach it, all vectors meet in blocks, so no result falls short in silence.

Counting: equal vectors are one row with a weight from the start. The vectors of a component of three or more meet all others of it, in
blocks that give counts, not pairs, so one found link between two groups is enough for all links between them.

All links are verified: their cosine is computed in double precision from the components as given. A hub is cut into blocks of ``BLOCK`` rows by a hash wherever rows
meet, so no task holds a whole group.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component; vectors of
different length never link; rows with equal ids and different content are vectors of their own, rows that are equal in both are one vector; every
row of the input has a row in the result; rows with a null id have no links and a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm.common import first_by_hash
from voxtable.operators.graph import linked_components
from voxtable.session import written

THRESHOLD = 0.9
K = 8
ORDERS = 4
LEAF = 96
BITS = 24
BLOCK = 512
WIDE = 4096
CHANGE = 0.005
#: Longest lists of saturated vectors.
LONGEST = 32
#: Vectors that an audit asks at first and at most, and the links it wants to see.
AUDIT, MOST_AUDIT, LEAST_SEEN = 2000, 32_000, 100
GOAL = 0.98
MOST_ROUNDS = 4
_EDGE = "a long, b long, cosine double"


def _parsed(vectors: DataFrame) -> DataFrame:
    """vec_id and x (doubles) of every row; x is null where the row cannot link."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")),
    ) & F.exists("embedding", lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, x).alias("x"))


def usable(vectors: DataFrame) -> DataFrame:
    """The distinct (id, x) that can link, as rows (vec_id, dims, x)."""
    return _parsed(vectors).where("x is not null").distinct().select("vec_id", F.size("x").alias("dims"), "x")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _edges(a: list, b: list, cosine: list) -> pa.RecordBatch:
    a, b, cosine = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((a, np.int64), (b, np.int64), (cosine, float)))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cosine, pa.float64())], ["a", "b", "cosine"])


def _best(ids: np.ndarray, roots: np.ndarray, units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges from each vector to its k best others among these, of other components only."""
    cosine = units @ units.T
    cosine[roots[:, None] == roots[None, :]] = -2
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(cosine, top, 1)
    some = value.ravel() > -2
    return np.repeat(ids, k)[some], ids[top].ravel()[some], value.ravel()[some]


def _rooted(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, root, x: without components, each vector is its own."""
    return vectors.select("vec_id", "dims", (F.col("root") if "root" in vectors.columns else F.col("vec_id")).alias("root"), "x")


def _ordered(vectors: DataFrame, orders: int, seed: int) -> DataFrame:
    """Each vector once per order, with its place in it: sign bits as a number, then one projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                some = pa.array(np.flatnonzero(dims == d))
                part = batch.take(some)
                units = _units(_matrix(part.column(3)))
                for order in range(orders):
                    plane = np.random.default_rng([seed, order, d]).normal(size=(d, BITS + 1))
                    shadow = units @ plane
                    code = (shadow[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(units), order), pa.int32()), part.column(1).cast(pa.int32()), pa.array(code, pa.int64()),
                        pa.array(shadow[:, BITS], pa.float64()), part.column(0), part.column(2), part.column(3),
                    ], ["way", "dims", "code", "shadow", "vec_id", "root", "x"])

    return _rooted(vectors).mapInArrow(run, "way int, dims int, code long, shadow double, vec_id long, root long, x array<double>")


def first_lists(vectors: DataFrame, k: int = K, orders: int = ORDERS, seed: int = 1) -> DataFrame:
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            whole = len(held) // LEAF * LEAF
            if whole:
                yield from compared(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield from compared(held)

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out = ([], [], [])
        for at in range(0, len(rows), LEAF):
            leaf = rows.slice(at, LEAF)
            dims, way = leaf["dims"].to_numpy(), leaf["way"].to_numpy()
            for d, w in set(zip(dims.tolist(), way.tolist())):
                part = leaf.take(pa.array(np.flatnonzero((dims == d) & (way == w))))
                for store, value in zip(out, _best(part["vec_id"].to_numpy(), part["root"].to_numpy(), _units(_matrix(part["x"])), k)):
                    store.append(value)
        yield _edges(*out)

    sort = ["way", "dims", "code", "shadow", "vec_id"]
    spread = _ordered(vectors, orders, seed).repartitionByRange(*sort).sortWithinPartitions(*sort)
    return spread.mapInArrow(leaves, _EDGE)


def _kept(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each vector; an edge that came twice counts once."""
    once = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def descend(graph: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """One round: at each vector, those it names and those that name it meet."""
    pairs = graph.select(F.col("a").alias("at"), F.col("b").alias("vec_id")).unionByName(graph.select(F.col("b").alias("at"), F.col("a").alias("vec_id")))
    pairs = pairs.unionByName(vectors.select(F.col("vec_id").alias("at"), "vec_id")).distinct()
    crowd = pairs.groupBy("at").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = pairs.join(crowd, "at").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # The blocks of a hub meet each other, too.
    members = members.select("at", "vec_id", F.struct(F.least("block", "other"), F.greatest("block", "other")).alias("part")).withColumn("part", F.xxhash64("part"))
    members = members.join(_rooted(vectors), "vec_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, ([], [], []), 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            at, part = rows["at"].to_numpy(), rows["part"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])]))
            done = rows.slice(0, int(starts[-1]))
            held = rows.slice(int(starts[-1]))
            yield grouped(done, starts)
        if held is not None and len(held):
            yield grouped(held, np.array([0, len(held)]))

    def grouped(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out = ([], [], [])
        if len(rows):
            ids, roots, dims = rows["vec_id"].to_numpy(), rows["root"].to_numpy(), rows["dims"].to_numpy()
            turns = np.flatnonzero(np.diff(dims, prepend=-1, append=-1))  # rows of one length follow each other
            for lo, hi in zip(turns[:-1].tolist(), turns[1:].tolist()):
                units = _units(_matrix(rows["x"].slice(lo, hi - lo)))
                own = starts[(starts >= lo) & (starts <= hi)]
                for a, b in zip(own[:-1].tolist(), own[1:].tolist()):
                    for store, value in zip(out, _best(ids[a:b], roots[a:b], units[a - lo : b - lo], k)):
                        store.append(value)
        return _edges(*out)

    near = members.repartition("at", "part").sortWithinPartitions("dims", "at", "part").select("at", "part", "vec_id", "dims", "root", "x").mapInArrow(meet, _EDGE)
    return graph.unionByName(near)


def _counts_within(groups: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """vec_id and n: the weight of all other vectors of its group (root, vec_id) that reach the threshold; block by block."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.join(vectors.select("vec_id", "weight", "x"), "vec_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "vec_id", "weight", "x")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, units, block, weight = table["vec_id"].to_numpy(), _units(_matrix(table["x"])), table["block"].to_numpy(), table["weight"].to_numpy()
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        near = (units[left] @ units[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
        a, n = ids[left], near.astype(np.int64) @ weight[right]
        if key[1].as_py() != key[2].as_py():
            a, n = np.concatenate([a, ids[right]]), np.concatenate([n, weight[left] @ near.astype(np.int64)])
        return pa.table({"vec_id": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64())})

    return rows.groupBy("root", "low", "high").applyInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def _components(links: DataFrame) -> DataFrame:
    return written(linked_components(links).select(F.col("node").alias("vec_id"), "root"), "roots")


def _with_roots(vectors: DataFrame, roots: DataFrame) -> DataFrame:
    return vectors.drop("root").join(roots, "vec_id", "left").withColumn("root", F.coalesce("root", "vec_id"))


def _thinned(vectors: DataFrame, seed: int) -> DataFrame:
    """About ``K`` vectors of each component, others for each seed: a large component fills whole leaves, and its neighbours do not meet it."""
    sizes = vectors.groupBy("root").agg(F.ceil(F.count("*") / K).alias("share"))
    return vectors.join(sizes, "root").where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("share")) == 0).drop("share")


def enlarged(graph: DataFrame, vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """The graph, with longer lists for saturated vectors."""
    out, lists = graph, graph
    while k < LONGEST:
        full = lists.where(F.col("cosine") >= threshold).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("a").alias("vec_id"))
        part = written(vectors.join(full, "vec_id", "left_semi"), "saturated")
        if part.isEmpty():
            break
        k *= 2
        ids = part.select(F.col("vec_id").alias("a"))
        among = lists.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "cosine")
        lists, links, before = among, 0, -1
        while links > (1 + CHANGE) * before:
            lists = written(_kept(descend(lists, part, k), k), "longer")
            before, links = links, lists.where(F.col("cosine") >= threshold).count()
        out = out.unionByName(lists)
    return out


def grown(graph: DataFrame, vectors: DataFrame, threshold: float, k: int, seed: int = 1) -> DataFrame:
    """vec_id and root of all vectors with links: the components of the graph, merged while saturated vectors find links to other components."""
    strong = written(graph.where(F.col("cosine") >= threshold).select("a", "b"), "links")
    # A vector is still saturated if it has as many links as the longest list holds.
    full = strong.groupBy("a").agg(F.countDistinct("b").alias("n")).where(F.col("n") >= k).select(F.col("a").alias("vec_id"))
    asked, roots = written(vectors.join(full, "vec_id", "left_semi"), "saturated"), _components(strong)
    while not asked.isEmpty():
        seed += 100
        part = written(_with_roots(asked, roots), "saturated")
        lists = _kept(first_lists(part, k, ORDERS, seed).unionByName(first_lists(_thinned(part, seed), k, ORDERS, seed + 50)), k)
        more = written(lists.where(F.col("cosine") >= threshold).select("a", "b"), "links")
        if more.isEmpty():
            break
        roots = _components(more.unionByName(roots.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))))
    return roots


def counted(vectors: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """vec_id, root, n_links of every vector: links between equal vectors, and all links inside the components."""
    rows = written(_with_roots(vectors, roots).select("vec_id", "root", "weight"), "roots")
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"), F.sum("weight").alias("all"))
    groups = rows.join(sizes, "root")
    # Two vectors of one component have one link; three or more must meet.
    inside = _counts_within(groups.where("size > 2").select("root", "vec_id"), vectors, threshold)
    n = F.when(F.col("size") > 2, F.coalesce("n", F.lit(0)) + F.col("weight") - 1).otherwise(F.col("all") - 1)
    return groups.join(inside, "vec_id", "left").select("vec_id", "root", n.cast("long").alias("n_links"))


def audit(rooted: DataFrame, threshold: float, k: int = K, size: int = AUDIT) -> float:
    """Share of the true links of a sample of vectors that were found, that is, lie inside a component: the least of the share of all links and
    the mean shares of vectors with less than ``k`` links and of others. The sample is the first ``size`` by a hash of the id."""
    chosen = first_by_hash(rooted.select("vec_id"), F.xxhash64("vec_id", F.lit(3)), ["vec_id"], size)
    asked = rooted.join(F.broadcast(chosen), "vec_id").select("vec_id", "dims", "root", "x").collect()  # ``size`` vectors at most
    if not asked:
        return 1.0
    by_length = {}
    for r in asked:
        by_length.setdefault(r.dims, []).append(r)
    known = {d: (np.array([r.vec_id for r in rows]), np.array([r.root for r in rows]), _units(np.array([r.x for r in rows], float))) for d, rows in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d, (ids, roots, units) in known.items():
                part = batch.filter(pa.array(dims == d))
                if part.num_rows:
                    near = (units @ _units(_matrix(part.column(3))).T >= threshold) & (ids[:, None] != part.column(0).to_numpy()[None, :])
                    found = near & (roots[:, None] == part.column(2).to_numpy()[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.sum(1)), pa.array(found.sum(1))], ["vec_id", "total", "found"])

    rows = _rooted(rooted).mapInArrow(run, "vec_id long, total long, found long").groupBy("vec_id").agg(F.sum("total").alias("total"), F.sum("found").alias("found")).where("total > 0").collect()
    if sum(r.total for r in rows) < LEAST_SEEN and size < MOST_AUDIT and len(asked) == size:
        return audit(rooted, threshold, k, 4 * size)
    if not rows:
        return 1.0
    classes = [[r.found / r.total for r in rows if (r.total < k) == few] for few in (True, False)]
    return min([sum(r.found for r in rows) / sum(r.total for r in rows), *(sum(c) / len(c) for c in classes if c)])


def all_blocks(rooted: DataFrame, threshold: float) -> DataFrame:
    """a, b: of all vectors, a link for every two components that a block comparison finds linked; the way without lists."""
    counts = rooted.groupBy("dims").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("blocks"))
    rows = rooted.join(counts, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("dims", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "root", "x")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        roots, units, block = table["root"].to_numpy(), _units(_matrix(table["x"])), table["block"].to_numpy()
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        out = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left), BLOCK):
            part = left[at : at + BLOCK]
            i, j = np.nonzero((units[part] @ units[right].T >= threshold) & (roots[part][:, None] != roots[right][None, :]))
            out.append(np.unique(np.stack([roots[part[i]], roots[right[j]]], 1), axis=0))
        a, b = np.unique(np.concatenate(out), axis=0).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("dims", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept of every row; the audited recall)."""
    single = written(usable(vectors), "vectors")
    # Equal vectors are one row from here on, under a number of its own; ``low`` is the smallest of their ids.
    equal = single.groupBy("x").agg(F.min("vec_id").alias("low"), F.min("dims").alias("dims"), F.count("*").alias("weight"))
    good = written(equal.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
    graph, recall = None, 0.0
    for step in range(MOST_ROUNDS):
        more = first_lists(good, k, ORDERS, seed=step + 1)
        graph = written(_kept(more if graph is None else graph.unionByName(more), k), "graph")
        links, before = graph.where(F.col("cosine") >= threshold).count(), -1
        while links > (1 + CHANGE) * before:
            graph = written(_kept(descend(graph, good, k), k), "graph")
            before, links = links, graph.where(F.col("cosine") >= threshold).count()
        longer = written(enlarged(graph, good, threshold, k), "graph")
        roots = grown(longer, good, threshold, LONGEST, seed=step + 1)
        recall = audit(_with_roots(good, roots), threshold, k)
        if recall >= GOAL:
            break
    else:
        more = all_blocks(_with_roots(good, roots), threshold)
        roots = _components(more.unionByName(roots.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))))
        recall = 1.0
    counts = written(counted(good, roots, threshold).join(good.select("vec_id", "low"), "vec_id"), "counts")
    names = counts.groupBy("root").agg(F.min("low").alias("component"))
    named = counts.join(names, "root").join(good.select("vec_id", "x"), "vec_id").select("x", "n_links", "component")
    rows = _parsed(vectors)
    found = rows.where("x is not null").join(named, "x").select("vec_id", "n_links", "component")
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = found.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept")), recall
