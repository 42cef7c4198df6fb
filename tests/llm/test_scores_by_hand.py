"""Scores of both networks recomputed with plain loops, and the pipeline's stages against the scores of their operators."""

import collections
import math
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from voxtable.llm import quality, toxicity
from voxtable.llm.common import remainder

TEXTS = [
    b"", b"a", b" \n", b"the the cat sat and the cat sat again", b"x" * 700, b"one two three " * 90, "Straße é ü — schön schön".encode(), b"A!B?c 12 Wor-d's end.",
    b"word " * 31, b"word " * 33, b" ".join(b"w%d" % (k % 50) for k in range(300)),
]


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-60, min(60, x))))


# Quality: bytes with marks, filters at every byte, hops, chunks of two hops.


def marked_symbols(text):
    """Byte plus 256 times the mark of its word."""
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text)]
    words = [text[a:b] for a, b in spans]
    out = list(text)
    for k, (a, b) in enumerate(spans):
        pairs = [(words[j - 1] if j else None, words[j]) for j in range(k + 1)]
        mark = 1 if words[k] in words[max(0, k - 8) : k] else 0
        if pairs[k] in pairs[max(0, k - 32) : k] or (k and words[k] == words[k - 1]):
            mark = 2
        for i in range(a, b):
            out[i] += 256 * mark
    return out


def plain_quality(net, text):
    size = -(-(len(text) + quality.WIDTH - 1) // quality.HOP) * quality.HOP
    x = [quality.PAD] * (quality.WIDTH - 1) + marked_symbols(text)
    x += [quality.PAD] * (size + quality.WIDTH - 1 - len(x))
    pools = []
    for hop in range(0, size, quality.HOP):
        best = [max(sum(float(net.filters[k, x[i + k], f]) for k in range(quality.WIDTH)) for i in range(hop, hop + quality.HOP)) for f in range(quality.FILTERS)]
        pools.append([max(0.0, v + float(net.bias[f])) for f, v in enumerate(best)])
    chunks = [[max(a, b) for a, b in zip(pool, after)] for pool, after in zip(pools, pools[1:] + [[0.0] * quality.FILTERS])]
    logit = float(net.constant[0])
    for f in range(quality.FILTERS):
        column = [c[f] for c in chunks]
        logit += float(net.mean_weight[f]) * sum(column) / len(column) + float(net.max_weight[f]) * max(column)
    return sigmoid(logit)


def test_quality_scores_equal_plain_loops():
    net = quality.Network()
    rng = np.random.default_rng(4)
    net.filters[:, : quality.PAD] += rng.normal(size=net.filters[:, : quality.PAD].shape).astype(np.float32) * 0.2
    net.bias[:] = rng.normal(size=len(net.bias)) * 0.3
    got = net.scores(quality.WordHasher(quality.WHITE, lower=False), TEXTS)
    assert np.allclose(got, [plain_quality(net, t) for t in TEXTS], atol=1e-5)


# Toxicity: windows of words, two gated layers, attention, the worst window.


def plain_grams(word):
    data = b"\0" + word + b"\0"
    out = []
    for n in (3, 5):
        for at in range(len(data) - n + 1):
            h = n
            for byte in data[at : at + n]:
                h = (h * 0x100000001B3 + byte) % 2**64
            out.append((h * 0x9E3779B97F4A7C15 % 2**64) >> 47)
    return out


def plain_vector(net, hasher, word):
    h = hasher.words(word)[0][0]
    row = np.flatnonzero(net.words == h)
    known = net.word_vectors[row[0]] if len(row) else net.word_vectors[-1]
    grams = plain_grams(word.lower())
    total = sum((net.gram_vectors[g].astype(float) for g in grams), np.zeros(toxicity.GRAM_SIZE)) / math.sqrt(max(1, len(grams)))
    return np.concatenate([known.astype(float), total])


def plain_layer(net, vectors, direction):
    h = toxicity.HIDDEN
    into, bias, across = net.into[:, 3 * h * direction : 3 * h * (direction + 1)].astype(float), net.bias[3 * h * direction : 3 * h * (direction + 1)].astype(float), net.across[direction].astype(float)
    state, out = np.zeros(h), [None] * len(vectors)
    for t in reversed(range(len(vectors))) if direction else range(len(vectors)):
        x, turned = vectors[t] @ into + bias, state @ across
        z, r = (1 / (1 + np.exp(-(x[a : a + h] + turned[a : a + h]))) for a in (0, h))
        new = np.tanh(x[2 * h :] + r * turned[2 * h :])
        state = (1 - z) * new + z * state
        out[t] = state
    return out


def plain_toxicity(net, hasher, text):
    words = re.findall(rb"[A-Za-z\x80-\xff]+", text)
    starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if len(words) > toxicity.WINDOW else [0]
    worst = -math.inf
    for start in starts:
        vectors = [plain_vector(net, hasher, w) for w in words[start : start + toxicity.WINDOW]]
        pooled = np.zeros(2 * toxicity.HIDDEN)
        if vectors:
            states = [np.concatenate(s) for s in zip(plain_layer(net, vectors, 0), plain_layer(net, vectors, 1))]
            weights = [math.exp(float(s @ net.attention.astype(float))) for s in states]
            pooled = sum(w * s for w, s in zip(weights, states)) / sum(weights)
        worst = max(worst, float(pooled @ net.out.astype(float)) + float(net.constant[0]))
    return sigmoid(worst)


def test_toxicity_scores_equal_plain_loops():
    rng, hasher, net = np.random.default_rng(6), toxicity.new_hasher(), toxicity.Network()
    net.gram_vectors = (rng.normal(size=net.gram_vectors.shape) * 0.3).astype(np.float32)
    net.words = np.sort(np.array([hasher.words(w)[0][0] for w in (b"cat", b"word", b"two")], np.uint64))
    net.word_vectors = (rng.normal(size=(4, toxicity.WORD_SIZE)) * 0.5).astype(np.float32)
    net.word_vectors[-1] = 0
    net.out *= 3
    got = net.scores(hasher, TEXTS)
    assert np.allclose(got, [plain_toxicity(net, hasher, t) for t in TEXTS], atol=1e-4)


# Pipeline.


def test_filtering_stages_keep_exactly_what_their_operators_accept(spark):
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    base += [base[0], (None, base[1][1], "en", None, 3), (9001, None, None, None, None)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, module, divisor, rest, label, keep in (
        ("quality", quality, 5, 0, "quality", lambda s: s >= quality.THRESHOLD), ("toxicity", toxicity, 3, 1, "toxic", lambda s: s < toxicity.THRESHOLD)):
        kept = stages[name](spark, docs, SMALL)
        model = module.train(docs, labels, remainder("doc_id", divisor) != rest, label)
        scored = module.scored(docs, model, "s").collect()
        want = collections.Counter(tuple(r[c] for c in docs.columns) for r in scored if keep(r.s))
        assert kept.columns == docs.columns and collections.Counter(map(tuple, kept.collect())) == want
        assert 0 < sum(want.values()) < len(base) or name == "toxicity"


def test_packing_stage_places_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    placed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SMALL)
    assert placed.select("doc_id").distinct().count() == docs.count()
    assert placed.where(F.col("doc_id").isNull()).count() == 0
