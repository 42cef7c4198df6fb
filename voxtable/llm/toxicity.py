"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word is a run of letters (bytes from 128 on count as letters), in lower case. Its input is a learned vector of the word, if the training texts
hold it in ``WORD_TEXTS`` texts, beside the sum of learned vectors of its character 3- and 5-grams with word ends, over the
root of their number. Windows of ``WINDOW`` words that overlap by ``WINDOW - STRIDE`` words cover the whole text. In each window two gated
recurrent layers read forward and backward, attention pools their states, and a linear layer gives a logit. The text's logit is that
of its worst window.

Training (on the driver, from a bounded sample of ``PER_CLASS`` rows of each label in hash order of the id) weighs the windows of a text by the
softmax of their logits, so that a label on the text finds its window. Texts are scored where they are read, without a shuffle.

Defined cases: a null text and a text without letters are one window without words and get the score of that; rows with a null id are
scored too; repeated rows are scored one by one; without labelled rows of both kinds every score is the share of label 1 among them,
or 0; an empty table gives an empty result; other columns are kept by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm.common import WordHasher, joined_words, labelled_sample, text_slices

#: Labelled rows of each class that the network learns from, at most.
PER_CLASS = 1500
#: A small sample is read again until so many steps are done.
LEAST_STEPS = 600
THRESHOLD = 0.7
WINDOW = 32
STRIDE = 24
#: Text that shares one table of distinct words.
SLICE_BYTES = 1 << 19
HIDDEN = 8
WORD_SIZE = 8
GRAM_SIZE = 12
GRAM_SLOTS = 1 << 17
WORD_TEXTS = 3
MOST_WORDS = 20_000
#: All ASCII bytes but letters end a word.
APART = bytes(c for c in range(128) if not chr(c).isalpha())
_U = np.uint64


def new_hasher() -> WordHasher:
    return WordHasher(APART)


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slot and word number of every 3- and 5-gram of the words in ``|word|``."""
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    slots, owner = [], []
    with np.errstate(over="ignore"):
        for n in (3, 5):
            if len(data) < n:
                continue
            h = np.zeros(len(data) - n + 1, np.uint64) + _U(n)
            inner = np.zeros(len(h), bool)
            for k in range(n):
                part = data[k : k + len(h)]
                h = h * _U(0x100000001B3) + part
                if 0 < k < n - 1:
                    inner |= part == 0
            at = np.flatnonzero(~inner)
            h = h[at] * _U(0x9E3779B97F4A7C15)
            slots.append((h >> _U(64 - 17)).astype(np.int64))
            owner.append(np.searchsorted(ends, at, side="right"))
    return np.concatenate(slots), np.concatenate(owner)


class Inputs:
    """Distinct words of some texts, their grams, and the windows over them."""

    def __init__(self, hasher: WordHasher, texts: list[bytes]):
        buffer = b"\n".join(texts)
        h, start, end, doc = joined_words(hasher, texts)
        self.hashes, first, place = np.unique(h, return_index=True, return_inverse=True)
        words = [buffer[a:b].lower() for a, b in zip(start[first].tolist(), end[first].tolist())]
        self.slots, self.owner = _grams(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(self.owner, kind="stable")
        self.slots, self.owner = self.slots[order], self.owner[order]
        self.counts = np.bincount(self.owner, minlength=len(words)).astype(np.float32)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        sizes = np.diff(bounds)
        windows = np.maximum(1, 1 + -(-np.maximum(0, sizes - WINDOW) // STRIDE))
        self.text = np.repeat(np.arange(len(texts)), windows)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (bounds[:-1][self.text] + number * STRIDE).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
        self.mask = at < bounds[1:][self.text].astype(np.int32)[:, None]
        #: Distinct word of each place; the number of words stands for none.
        self.index = np.where(self.mask, np.append(place, len(words)).astype(np.int32)[np.minimum(at, np.int32(len(place)))], np.int32(len(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + GRAM_SIZE, HIDDEN
        f = np.float32
        self.words = np.zeros(0, np.uint64)
        self.word_vectors = np.zeros((1, WORD_SIZE), f)
        self.gram_vectors = np.zeros((GRAM_SLOTS, GRAM_SIZE), f)
        #: Update, reset and new gate of the forward layer, then of the backward layer.
        self.into = (rng.normal(size=(size, 6 * h)) / np.sqrt(size)).astype(f)
        self.bias = np.zeros(6 * h, f)
        self.across = [(rng.normal(size=(h, 3 * h)) / np.sqrt(h)).astype(f) for _ in range(2)]
        self.attention = (rng.normal(size=2 * h) * 0.3).astype(f)
        self.out = (rng.normal(size=2 * h) * 0.3).astype(f)
        self.constant = np.array([-1.0], f)

    def dense(self) -> list[np.ndarray]:
        return [self.into, self.bias, *self.across, self.attention, self.out, self.constant]

    def _vectors(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """The input vector of each distinct word, and its row among the word vectors."""
        row = np.searchsorted(self.words, x.hashes)
        known = row < len(self.words)
        known[known] = self.words[row[known]] == x.hashes[known]
        row = np.where(known, row, len(self.words))
        grams = np.zeros((len(x.hashes), GRAM_SIZE), np.float32)
        if len(x.slots):
            first = np.flatnonzero(np.diff(x.owner, prepend=-1))
            grams[x.owner[first]] = np.add.reduceat(self.gram_vectors[x.slots], first, axis=0)
        grams /= np.sqrt(np.maximum(x.counts, 1))[:, None]
        return np.concatenate([self.word_vectors[row], grams], 1), row

    def _layer(self, given: np.ndarray, index: np.ndarray, mask: np.ndarray, across: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
        h, n = HIDDEN, len(index)
        state, states, kept = np.zeros((n, h), np.float32), np.zeros((WINDOW, n, h), np.float32), []
        for t in range(WINDOW - 1, -1, -1) if back else range(WINDOW):
            x, old = given[index[:, t]], state
            turned = old @ across
            gates = _sigmoid(x[:, : 2 * h] + turned[:, : 2 * h])
            new = np.tanh(x[:, 2 * h :] + gates[:, h:] * turned[:, 2 * h :])
            state = new + gates[:, :h] * (old - new)
            state = np.where(mask[:, t, None], state, old)
            states[t] = state
            if keep:
                kept.append((t, old, turned[:, 2 * h :], gates, new))
        return states, kept

    def _forward(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        given = np.concatenate([vectors @ self.into + self.bias, self.bias[None]])
        parts = [self._layer(given[:, : 3 * HIDDEN], index, mask, self.across[0], False, keep), self._layer(given[:, 3 * HIDDEN :], index, mask, self.across[1], True, keep)]
        states = np.concatenate([p[0] for p in parts], 2)
        weight = states @ self.attention
        weight = np.where(mask.T, weight, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        return pooled @ self.out + self.constant[0], states, weight, pooled, given, [p[1] for p in parts]

    def window_logits(self, x: Inputs) -> np.ndarray:
        vectors, _ = self._vectors(x)
        # Blocks of windows that stay in the processor's cache.
        parts = [self._forward(vectors, x.index[at : at + 512], x.mask[at : at + 512])[0] for at in range(0, len(x.index), 512)]
        return np.concatenate(parts)

    def scores(self, hasher: WordHasher, texts: list[bytes]) -> np.ndarray:
        x = Inputs(hasher, texts)
        worst = np.maximum.reduceat(self.window_logits(x), np.flatnonzero(np.diff(x.text, prepend=-1)))
        return _sigmoid(np.clip(worst.astype(np.float64), -60, 60))

    def gradients(self, x: Inputs, y: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the dense parameters, and of the input vectors of the distinct words, with their word rows."""
        h = HIDDEN
        vectors, row = self._vectors(x)
        logits, states, weight, pooled, given, kept = self._forward(vectors, x.index, x.mask, keep=True)
        first = np.flatnonzero(np.diff(x.text, prepend=-1))
        share = np.exp(logits - np.maximum.reduceat(logits, first)[x.text])
        share /= np.add.reduceat(share, first)[x.text]
        total = np.add.reduceat(share * logits, first)
        error = ((_sigmoid(total) - y) * counts / len(y)).astype(np.float32)
        d_logit = (share * error[x.text]).astype(np.float32)
        d_pooled = d_logit[:, None] * self.out
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_attention = np.einsum("tn,tnh->h", d_score, states)
        d_states += d_score[:, :, None] * self.attention
        d_given, d_across = np.zeros_like(given), []
        for k in range(2):
            d_state, d_turn = np.zeros((len(y) and len(x.index), h), np.float32), np.zeros_like(self.across[k])
            part = np.zeros((len(given), 3 * h), np.float32)
            for t, old, turned_new, gates, new in reversed(kept[k]):
                on = x.mask[:, t, None]
                d = d_state + d_states[t][:, k * h : k * h + h]
                d_on = d * on
                z, r = gates[:, :h], gates[:, h:]
                d_new = d_on * (1 - z) * (1 - new * new)
                d_gate = np.concatenate([d_on * (old - new) * z * (1 - z), d_new * turned_new * r * (1 - r)], 1)
                d_turned = np.concatenate([d_gate, d_new * r], 1)
                d_turn += old.T @ d_turned
                d_state = d * ~on + d_on * z + d_turned @ self.across[k].T
                np.add.at(part, x.index[:, t], np.concatenate([d_gate, d_new], 1))
            d_across.append(d_turn)
            d_given[:, 3 * h * k : 3 * h * (k + 1)] = part
        words = d_given[:-1]
        dense = [vectors.T @ words, d_given.sum(0), *d_across, d_attention, d_logit @ pooled, np.array([d_logit.sum()])]
        return dense, words @ self.into.T, row

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 5) -> "Network":
        hasher, rng = new_hasher(), np.random.default_rng(seed)
        seen = [np.unique(joined_words(hasher, [t])[0]) for t in texts]
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        common = np.lexsort((values, -counts))[:MOST_WORDS]
        self.words = np.sort(values[common[counts[common] >= WORD_TEXTS]])
        self.word_vectors = np.zeros((len(self.words) + 1, WORD_SIZE), np.float32)
        word_power, gram_power = np.full(len(self.words) + 1, 1e-6, np.float32), np.full(GRAM_SLOTS, 1e-6, np.float32)
        epochs = max(epochs, -(-LEAST_STEPS * batch // len(texts)))
        # Both labels weigh the same.
        weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
        first, second = ([np.zeros_like(p) for p in self.dense()] for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = Inputs(hasher, [texts[i] for i in some])
                grads, d_vectors, row = self.gradients(x, y[some], weight[some])
                step += 1
                fall = 0.05 ** (epoch / epochs)
                pace = rate * fall * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(self.dense(), grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
                # Vectors of words and grams: steps scaled by the squares so far.
                known = row < len(self.words)
                g = d_vectors[known, :WORD_SIZE]
                word_power[row[known]] += (g * g).mean(1)
                self.word_vectors[row[known]] -= 0.1 * fall * g / np.sqrt(word_power[row[known]])[:, None]
                g = (d_vectors[:, WORD_SIZE:] / np.sqrt(np.maximum(x.counts, 1))[:, None])[x.owner]
                slots, place = np.unique(x.slots, return_inverse=True)
                total = np.zeros((len(slots), GRAM_SIZE), np.float32)
                np.add.at(total, place, g)
                gram_power[slots] += (total * total).mean(1)
                self.gram_vectors[slots] -= 0.1 * fall * total / np.sqrt(gram_power[slots])[:, None]
        return self


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Network | float:
    """A network for ``label`` from the labelled rows that satisfy ``rows``; a constant without rows of both kinds."""
    sample = labelled_sample(docs, labels, label, rows, per_class)
    y = np.array([v for _, v in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return Network().fit([t.encode() for t, _ in sample], y)


def scored(docs: DataFrame, model: Network | float, column: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column of scores, in place of one of that name; all other columns stay as they are."""
    docs = docs.drop(column)
    if isinstance(model, float):
        return docs.withColumn(column, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, network = new_hasher(), shared.value
        for batch, texts in text_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(hasher, texts), pa.float64())], [*names, column])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))
