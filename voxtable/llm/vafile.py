"""Exact top-k search by vector-approximation files.

A file holds, for blocks of about ``BLOCK`` vectors, the quantised cell of every component (one byte) beside the exact vector.

1. Scan: for every query and every block the cells give a lower and an upper bound of each inner product. The k best lower bounds of all
   blocks together give a floor that the kth result cannot fall below.
2. Read: in each block, the candidates whose upper bound reaches the floor are read exactly, best bound first, until the next bound is below
   the kth exact score. The k best of each block meet, at most k rows per query and block.

Queries are dealt to blocks too; a task handles one block of queries and one block of vectors, so neither side is broadcast or gathered.
Scores are integers: computed in doubles where every sum stays below 2^53, else in longs, else in Python integers. Bounds that may be rounded are
widened by more than the rounding. Vectors with a component of ``LARGE`` or more have blocks and cells of their own, so they do not coarsen the others.

Components are floor(scale * x) as long. Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, neither do those
with a component that is no long after scaling; a result whose score is no long is an error, not left out; vectors of different length never meet;
rows with a null id take no part; a query is not its own candidate; equal rows count once, rows with equal ids and other components are candidates
of their own, and as queries share one ranking; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.session import written

K = 20
SCALE = 64
BLOCK = 4096
#: Cells per component: 2 ** BITS.
BITS = 6
LARGE = 1 << 24


def integers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and x (array of long) of the vectors that take part."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float(1 << 63)),
    )
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).distinct()


def _matrix(rows: pa.Table, name: str, kind: type = np.float64) -> np.ndarray:
    x = rows[name].combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(x), -1)


def approximation(vectors: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """The file: dims, block, vec_id, x and cells; ``low`` and ``step`` say which values a cell stands for."""
    known = vectors.withColumns({"dims": F.size("x"), "large": F.exists("x", lambda v: F.abs(v) >= LARGE)})
    ranges = known.select("dims", "large", F.array_min("x").cast("double").alias("low"), F.array_max("x").cast("double").alias("high")).groupBy("dims", "large").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    step = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(float(1 << bits)))
    # A row or two for each length of vector; joined by Spark, broadcast only if small.
    sized = ranges.select("dims", "large", "low", step.alias("step"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    out = known.join(sized, ["dims", "large"])
    cells = F.transform("x", lambda v: F.floor((v.cast("double") - F.col("low")) / F.col("step")).cast("short"))
    place = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    # Blocks of large vectors are numbered from -1 down.
    return out.select("dims", F.when(F.col("large"), -1 - place).otherwise(place).alias("block"), "blocks", "low", "step", "vec_id", "x", cells.alias("cells"))


def _bounds(q: np.ndarray, cells: np.ndarray, low: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and cells; whole numbers in doubles below 2^53, else widened by the rounding."""
    floor = low + step * cells
    base = q @ floor.T
    spread = step - 1
    most = np.abs(q).sum(1) * (np.abs(floor).max() + step)
    margin = np.where(most < 1 << 52, 0, most * (q.shape[1] + 16) * 2.0**-52)[:, None]
    return base + spread * np.minimum(q, 0).sum(1)[:, None] - margin, base + spread * np.maximum(q, 0).sum(1)[:, None] + margin


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs and one: longs, or Python integers where a sum might not fit."""
    most = np.abs(x).max() * np.abs(q).astype(float).sum()
    if most < 1 << 52:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return x @ q if most < 1 << 62 else x.astype(object) @ q.astype(object)


def _scan(k: int):
    def scan(key: tuple, queries: pa.Table, file: pa.Table) -> pa.Table:
        ids, best = [], []
        if len(queries) and len(file):
            vec = file["vec_id"].to_numpy()
            cells = _matrix(file, "cells")
            for at in range(0, len(queries), 256):
                part = queries.slice(at, 256)
                low, _ = _bounds(_matrix(part, "x"), cells, file["low"][0].as_py(), file["step"][0].as_py())
                own = part["vec_id"].to_numpy()
                low[own[:, None] == vec[None, :]] = -np.inf
                top = -np.sort(-low, axis=1)[:, :k] if low.shape[1] <= k else -np.partition(-low, k - 1, axis=1)[:, :k]
                ids.append(np.repeat(own, top.shape[1]))
                best.append(top.ravel())
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        best = np.concatenate(best) if best else np.zeros(0)
        some = np.isfinite(best)
        return pa.table({"query_id": pa.array(ids[some], pa.int64()), "low": pa.array(best[some], pa.float64())})

    return scan


def _read(k: int):
    def read(key: tuple, queries: pa.Table, file: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bool]] = []
        if len(queries) and len(file):
            vec, cells = file["vec_id"].to_numpy(), _matrix(file, "cells")
            exact = _matrix(file, "x", np.int64)
            for at in range(0, len(queries), 256):
                part = queries.slice(at, 256)
                q, own, floor = _matrix(part, "x", np.int64), part["vec_id"].to_numpy(), part["floor"].to_numpy(zero_copy_only=False).astype(float)
                _, high = _bounds(q.astype(float), cells, file["low"][0].as_py(), file["step"][0].as_py())
                high[own[:, None] == vec[None, :]] = -np.inf
                for i in range(len(q)):
                    some = np.flatnonzero((high[i] >= floor[i]) & np.isfinite(high[i]))
                    some = some[np.argsort(-high[i][some], kind="stable")]
                    scores, ids, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf
                    step = 4 * k
                    for lo in range(0, len(some), step):
                        if len(scores) >= k and high[i][some[lo]] < kth:
                            break
                        batch = some[lo : lo + step]
                        scores, ids = np.concatenate([scores, _scores(exact[batch], q[i])]), np.concatenate([ids, vec[batch]])
                        keep = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
                        scores, ids = scores[keep], ids[keep]
                        kth = float(scores[-1])
                    fit = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores.tolist()]
                    out += zip([int(own[i])] * len(ids), ids.tolist(), fit, [x != y for x, y in zip(fit, scores.tolist())])
        q, v, s, o = zip(*out) if out else ((), (), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64()), "over": pa.array(o, pa.bool_())})

    return read


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of every query; both sides as ``integers`` gives them."""
    spark = vectors.sparkSession
    file = written(approximation(vectors, bits, block), "cells")
    asked = queries.select(F.col("vec_id"), "x", F.size("x").alias("dims"))
    if file.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A row for each length: the number of blocks of large vectors, and of the others.
    large = F.col("block") < 0
    sides = file.groupBy("dims").agg(F.max(F.when(large, F.col("blocks"))).alias("large"), F.max(F.when(~large, F.col("blocks"))).alias("other")).collect()
    shape = {r.dims: (r.large or 0, r.other or 0) for r in sides}
    counts = {r.dims: math.ceil(r.n / block) for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    lookup = lambda of, column: F.element_at(F.create_map(*[F.lit(x) for item in of.items() for x in item]), column)
    query_blocks = lookup(counts, F.col("dims"))
    asked = asked.where(F.col("dims").isin(list(shape))).withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), query_blocks).cast("int"))
    first, after = (lookup({d: n[i] for d, n in shape.items()}, F.col("dims")) for i in (0, 1))
    spread_queries = asked.withColumn("block", F.explode(F.sequence(-first, after - 1)))
    known = file.where(F.col("dims").isin(list(counts)))
    spread = known.withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
    key = ["dims", "query_block", "block"]
    cells = spread.select(*key, "vec_id", "cells", "low", "step")
    low = spread_queries.groupBy(*key).cogroup(cells.groupBy(*key)).applyInArrow(_scan(k), "query_id long, low double")
    floors = low.groupBy("query_id").agg(F.sort_array(F.collect_list("low"), asc=False).alias("lows"))
    floors = written(floors.select("query_id", F.try_element_at("lows", F.lit(k)).alias("floor")), "floors")
    certain = spread_queries.join(floors, F.col("vec_id") == F.col("query_id")).drop("query_id")
    certain = certain.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = certain.groupBy(*key).cogroup(spread.select(*key, "vec_id", "cells", "x", "low", "step").groupBy(*key)).applyInArrow(
        _read(k), "query_id long, vec_id long, score long, over boolean")
    # ~score falls as the score rises, and fits for every long.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "over"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("place", "hit"))
    score = F.when(F.col("hit.over"), F.raise_error(F.format_string("the score of query %d and vector %d is no long", "query_id", "hit.vec_id"))).otherwise(F.bitwise_not("hit.s"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), score.alias("score"))
