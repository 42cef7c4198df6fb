"""Quality classifier: a byte-level convolutional network in numpy over the whole text.

Input is one symbol per byte: the byte and whether its word, or its word and the one before, came up shortly before. Filters of ``WIDTH``
bytes are learned; their rectified outputs are max-pooled over chunks of two hops that overlap by one hop, from the first byte to the last.
The mean and the maximum over the chunks go through one linear layer into one probability of the label 1.

The network is trained on the driver from a bounded sample (``PER_CLASS`` rows of each label, in hash order of the id) and sent to the tasks
(about 250 kB); every text is scored where it is read, without a shuffle.

Defined cases: a null or empty text is one chunk of padding and gets a score from that; rows with a null id are scored too; repeated rows are
scored one by one; without labelled rows of both kinds every score is the share of label 1 among them, or 0.5; an empty table gives an empty
result; other columns are kept by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import WordHasher, joined_words, labelled_sample, mixed, text_slices

#: Labelled rows of each class that the network learns from, at most.
PER_CLASS = 1500
#: A small sample is read again until so many steps are done.
LEAST_STEPS = 800
THRESHOLD = 0.3
HOP = 256
WIDTH = 5
FILTERS = 12
PAD = 3 * 256
WHITE = b" \t\n\x0b\x0c\r"
_U = np.uint64


def repeats(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and mark of the words that repeat: 1 if the word is one of the 8 before it, 2 if it follows its like or the same pair of
    words began within the 32 before it."""
    h, start, end, doc = joined_words(hasher, texts)
    mark = np.zeros(len(h), np.int8)

    def came(x: np.ndarray, lags: int) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for lag in range(1, min(lags, len(x) - 1) + 1):
            out[lag:] |= (x[lag:] == x[:-lag]) & (doc[lag:] == doc[:-lag])
        return out

    mark[came(h, 8)] = 1
    with np.errstate(over="ignore"):
        pair = h.copy()
        pair[1:] = mixed(h[1:] * _U(3) + h[:-1] * (doc[1:] == doc[:-1]))
    mark[came(pair, 32) | came(h, 1)] = 2
    some = mark > 0
    return start[some], end[some], mark[some]


def symbols(hasher: WordHasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts and the number of hops of each text. Each begins with padding, which the last filters of the text before it reach,
    and is padded to whole hops."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    step = np.zeros(len(raw) + 1, np.int8)
    start, end, mark = repeats(hasher, texts)
    step[start] += mark
    step[end] -= mark
    coded = raw.astype(np.int32) + 256 * np.cumsum(step[:-1], dtype=np.int8).astype(np.int32)
    sizes = np.array([len(t) for t in texts], np.int64)
    hops = -(-(sizes + WIDTH - 1) // HOP)
    out = np.full(int(hops.sum()) * HOP, PAD, np.int32)
    begins, places = np.cumsum(sizes + 1) - sizes - 1, (np.cumsum(hops) - hops) * HOP + WIDTH - 1
    for a, n, b in zip(begins.tolist(), sizes.tolist(), places.tolist()):
        out[b : b + n] = coded[a : a + n]
    return out, hops


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.filters = (rng.normal(size=(WIDTH, PAD + 1, FILTERS)) * 0.3).astype(np.float32)
        self.filters[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.mean_weight = (rng.normal(size=FILTERS) * 0.1).astype(np.float32)
        self.max_weight = (rng.normal(size=FILTERS) * 0.1).astype(np.float32)
        self.constant = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.mean_weight, self.max_weight, self.constant]

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filter sums at every byte."""
        out = self.filters[0][x]
        for k in range(1, WIDTH):
            out[:-k] += self.filters[k][x[k:]]
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each hop."""
        rows = 1 << 9
        parts = []
        for at in range(0, len(x), rows * HOP):
            part = x[at : at + rows * HOP + WIDTH - 1]
            n = min(rows * HOP, len(x) - at)
            parts.append(self.responses(part)[:n].reshape(-1, HOP, FILTERS).max(1))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    @staticmethod
    def chunks(pools: np.ndarray, hops: np.ndarray) -> np.ndarray:
        """Chunk maxima: each hop with the one after it in its text; the last hop of a text stands alone."""
        after = np.concatenate([pools[1:], pools[-1:]])
        after[np.cumsum(hops) - 1] = 0
        return np.maximum(pools, after)

    def logits(self, x: np.ndarray, hops: np.ndarray) -> np.ndarray:
        chunks = self.chunks(self.pooled(x), hops)
        first = np.cumsum(hops) - hops
        mean = np.add.reduceat(chunks, first, axis=0) / hops[:, None]
        return mean @ self.mean_weight + np.maximum.reduceat(chunks, first, axis=0) @ self.max_weight + self.constant[0]

    def gradients(self, x: np.ndarray, hops: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        raw = self.responses(x).reshape(-1, HOP, FILTERS)
        place = raw.argmax(1) + HOP * np.arange(len(raw))[:, None]
        pools = np.maximum(raw.max(1) + self.bias, 0)
        after = np.concatenate([pools[1:], pools[-1:]])
        after[np.cumsum(hops) - 1] = 0
        chunks = np.maximum(pools, after)
        first, text = np.cumsum(hops) - hops, np.repeat(np.arange(len(hops)), hops)
        mean, top = np.add.reduceat(chunks, first, axis=0) / hops[:, None], np.maximum.reduceat(chunks, first, axis=0)
        p = 1 / (1 + np.exp(-(mean @ self.mean_weight + top @ self.max_weight + self.constant[0])))
        error = ((p - y) * weight / len(y)).astype(np.float32)
        per_chunk = (error / hops)[text][:, None] * self.mean_weight + error[text][:, None] * self.max_weight * (chunks == top[text]) / np.maximum(
            1, np.add.reduceat((chunks == top[text]).astype(np.float32), first, axis=0))[text]
        own = pools >= after
        per_hop = per_chunk * own
        per_hop[1:] += (per_chunk * ~own)[:-1]
        per_hop *= pools > 0
        grad = np.zeros_like(self.filters)
        row, column = np.nonzero(per_hop)
        at, value = place[row, column], per_hop[row, column]
        for k in range(WIDTH):
            inside = at + k < len(x)
            np.add.at(grad[k], (x[at[inside] + k], column[inside]), value[inside])
        grad[:, PAD] = 0
        return [grad, per_hop.sum(0), (error[:, None] * mean).sum(0), (error[:, None] * top).sum(0), np.array([error.sum()])]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 5) -> "Network":
        hasher, rng = WordHasher(WHITE, lower=False), np.random.default_rng(seed)
        inputs = [symbols(hasher, [t]) for t in texts]
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
        # Both labels weigh the same.
        weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                grads = self.gradients(np.concatenate([inputs[i][0] for i in some]), np.concatenate([inputs[i][1] for i in some]), y[some], weight[some])
                step += 1
                pace = rate * 0.02 ** (epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self.parameters(), grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def scores(self, hasher: WordHasher, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*symbols(hasher, texts)).astype(np.float64), -60, 60)))


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", per_class: int = PER_CLASS) -> Network | float:
    """A network for ``label`` from the labelled rows that satisfy ``rows``; a constant without rows of both kinds."""
    sample = labelled_sample(docs, labels, label, rows, per_class)
    y = np.array([v for _, v in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return Network().fit([t.encode() for t, _ in sample], y)


def scored(docs: DataFrame, model: Network | float, column: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores, in place of one of that name; all other columns stay as they are."""
    docs = docs.drop(column)
    if isinstance(model, float):
        return docs.withColumn(column, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, network = WordHasher(WHITE, lower=False), shared.value
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(hasher, texts), pa.float64())], [*names, column])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))
