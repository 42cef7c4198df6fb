"""URL filter: rules first, then gradient-boosted trees on lexical features.

``parts`` gives host and path. ``ruled`` gives the longest rule whose host is the url's host or a parent domain of it and whose path
starts the url's path. Rules label urls, and the trees learn from a bounded, hash-ordered sample of those urls what allowed and blocked
urls look like; they judge the urls that no rule fits. Features: lengths, path depth, digit ratio, entropy, parameter counts, host
shape, and statistics of the host's suffix and of the first path segment, both hashed to tables of fixed size and counted over all urls.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged by the trees on zero features;
repeated rows are judged one by one; without labelled urls of both kinds the verdict is the kind that exists, or allow; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import first_by_hash

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Most labelled urls of each kind that the trees learn from.
PER_KIND = 10_000
#: Folds of the urls; statistics of a url that is learned from come from the other folds.
FOLDS = 4
SLOTS = 4096
BINS = 32


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(safe, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(safe, pattern, 2)


def ruled(host: Column, path: Column, rules: list = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS)).cast("int")


def _described(pages: DataFrame, rules: list) -> DataFrame:
    """page_id, host, path, url, rule, ruling, suffix slot and segment slot."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    segment = F.concat_ws("/", F.element_at(labels, -1), F.split_part("path", F.lit("/"), F.lit(2)))
    fit = ruled(F.col("host"), F.col("path"), rules)
    return rows.select("*", fit["rule"].alias("rule"), fit["verdict"].alias("ruling"), _slot(suffix).alias("suffix"), _slot(segment).alias("segment"))


def features(urls: list[str], hosts: list[str], paths: list[str], suffix: np.ndarray, segment: np.ndarray, tables: dict) -> np.ndarray:
    """A row of lexical features for each url."""
    out = np.zeros((len(urls), 16), np.float32)
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths)):
        raw = url.encode()
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
        share = counts[counts > 0] / max(1, len(raw))
        rest = url[len(url.split("://", 1)[0]) :]
        digits = counts[48:58].sum()
        out[i, :14] = (
            len(raw), len(host), len(path), path.count("/"), digits / max(1, len(raw)), -(share * np.log2(share)).sum() if len(share) else 0,
            rest.count("=") + rest.count("&"), "?" in url, "#" in url, host.count("."), host.count("-"), path.endswith("/"),
            url.startswith("https"), max(map(len, path.split("/"))),
        )
    out[:, 14], out[:, 15] = tables["suffix"][suffix], tables["segment"][segment]
    return out


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1], method="lower")) for j in range(x.shape[1])]
        rows, mean = self.binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(rows, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._apply(tree, rows)
        return self

    def _grow(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        """feature, cut and value of every node of a full tree, root first; a feature of -1 marks a leaf."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        where = np.zeros(len(rows), np.int64)
        for node in range(nodes):
            own = np.flatnonzero(where == node)
            if not len(own):
                continue
            g, h = grad[own], hess[own]
            total_g, total_h = g.sum(), h.sum()
            value[node] = self.rate * total_g / (total_h + self.penalty)
            if node >= nodes // 2:
                continue
            best = (1e-6, -1, 0)
            for j in range(rows.shape[1]):
                left_g = np.cumsum(np.bincount(rows[own, j], g, BINS))[:-1]
                left_h = np.cumsum(np.bincount(rows[own, j], h, BINS))[:-1]
                gain = left_g**2 / (left_h + self.penalty) + (total_g - left_g) ** 2 / (total_h - left_h + self.penalty) - total_g**2 / (total_h + self.penalty)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), j, k))
            if best[1] >= 0:
                feature[node], cut[node] = best[1:]
                where[own] = 2 * node + 1 + (rows[own, best[1]] > best[2])
        return feature, cut, value

    def _apply(self, tree: tuple, rows: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            split = feature[node] >= 0
            right = rows[np.arange(len(rows)), np.maximum(feature[node], 0)] > cut[node]
            node = np.where(split, 2 * node + 1 + right, node)
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        rows = self.binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._apply(t, rows) for t in self.trees))))


def _share(counts: np.ndarray) -> np.ndarray:
    """Share of blocked urls from (blocked, known) counts, drawn to one half where few are known."""
    return (counts[..., 0] + 1) / (counts[..., 1] + 2)


def train(described: DataFrame, per_kind: int = PER_KIND) -> tuple[Trees | float, dict]:
    """The trees (or a constant, if only one kind is labelled) and the statistics of suffixes and segments over all urls."""
    tables, folds = {}, {}
    described = described.withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    for name in ("suffix", "segment"):
        stats = described.groupBy(name, "fold").agg(F.count("ruling").alias("known"), F.count_if(F.col("ruling") == "block").alias("bad"))
        counts = np.zeros((FOLDS, SLOTS, 2), np.int64)
        for r in stats.collect():  # FOLDS * SLOTS rows at most
            counts[r.fold, r[name]] = r["bad"], r["known"]
        folds[name] = counts
        tables[name] = _share(counts.sum(0)).astype(np.float32)
    order = F.xxhash64("page_id", "url")
    sample = None
    for kind in ("allow", "block"):
        part = first_by_hash(described.where(F.col("ruling") == kind), order, ["page_id", "url"], per_kind)
        sample = part if sample is None else sample.unionByName(part)
    rows = sample.select("url", "host", "path", "suffix", "segment", "ruling", "fold").collect()  # 2 * per_kind urls at most
    y = np.array([r.ruling == "block" for r in rows], float)
    if not len(y) or y.min() == y.max():
        return float(y.max()) if len(y) else 0.0, tables
    slots = {name: np.array([r[name] for r in rows]) for name in ("suffix", "segment")}
    x = features([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], slots["suffix"], slots["segment"], tables)
    # A url that is learned from sees the statistics of the other folds only, never its own label.
    fold = np.array([r.fold for r in rows])
    for column, name in ((14, "suffix"), (15, "segment")):
        x[:, column] = _share((folds[name].sum(0) - folds[name])[fold, slots[name]])
    return Trees().fit(x, y), tables


def judge(pages: DataFrame, rules: list = RULES, per_kind: int = PER_KIND) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of block, by the trees) for every row."""
    described = _described(pages, rules)
    model, tables = train(described, per_kind)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {name: batch.column(batch.schema.get_field_index(name)) for name in ("url", "host", "path", "suffix", "segment")}
            if isinstance(model, float):
                score = np.full(batch.num_rows, model)
            else:
                score = model.score(features(
                    got["url"].to_pylist(), got["host"].to_pylist(), got["path"].to_pylist(), got["suffix"].to_numpy(), got["segment"].to_numpy(), tables,
                ))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "host", "path", "rule", "ruling")), pa.array(score, pa.float64())],
                ["page_id", "host", "path", "rule", "ruling", "score"],
            )

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    out = described.select("page_id", "url", "host", "path", "rule", "ruling", "suffix", "segment").mapInArrow(
        scored, f"page_id {kind}, host string, path string, rule string, ruling string, score double",
    )
    verdict = F.coalesce("ruling", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
