"""Fingerprints, manifest and filter audit against brute force, with the awkward rows of every contract."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from driver_checks.compare import difference, views
from voxtable.llm import audit, fingerprints, merkle
from voxtable.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, part int, key string, index long"
LABELS = "doc_id long, quality int, toxic int, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "x", 1, "k", 2) for i, t, lang, source, n in rows], DOCS).repartition(3)


def odd_rows(n=60, seed=4):
    rng = random.Random(seed)
    texts = [None, "", " \n", "One", "UPPER CASE all THE way", "money $ 5", "a b a b a b", "é Ü ß 日本", "w " * 5000, "x" * 20000]
    texts += [" ".join(rng.choice(["alpha", "Beta", "gamma", "Delta", f"w{k % 7}"]) for _ in range(rng.randint(1, 120))) for k in range(n)]
    texts += texts[10:30] + [texts[12]] * 15
    rows = [(i * 3 % 101 + 7 * (i // 101), t, rng.choice(["en", "de", "é", "", None]), rng.choice(["s", "t", "", None]), None if i % 9 == 0 else i) for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "One", "en", None, None), (None, None, None, "s", 4), (rows[5][0], "another text of the same id", "en", "s", 1)]


# Fingerprints


def brute_terms(text):
    words = (text or "").encode().split()
    edge = [None, *words, None]
    return collections.Counter(zip(edge, edge[1:])) if words else collections.Counter()


def brute_jaccard(a, b):
    a, b = brute_terms(a), brute_terms(b)
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_a_fingerprint_is_the_least_draw_of_every_sample():
    hasher = fingerprints.new_hasher()
    text = b"one two two three one two"
    _, term, weight = fingerprints.weighted_terms(hasher, [text])
    assert sorted(weight.tolist()) == sorted(brute_terms(text.decode()).values())
    got = fingerprints.fingerprints(hasher, [text])[0]
    for j in range(fingerprints.SAMPLES):
        best = min(int(fingerprints.draws(term[k : k + 1], weight[k : k + 1])[0, j]) for k in range(len(term)))
        assert got[j] == (best & 0xFFFFFFFF) % 65535 + 1


def test_gamma_draws_have_their_mean_and_weights_their_share():
    rng = np.random.default_rng(1)
    term = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    r = fingerprints._gamma(fingerprints.mixed(term))
    assert abs(r.mean() - 2) < 0.1 and abs(r.var() - 2) < 0.3
    # Of two terms the one of weight 3 is taken three times as often as the one of weight 1.
    heavy, light = fingerprints.draws(term[:2000], np.full(2000, 3)), fingerprints.draws(term[2000:], np.ones(2000, np.int64))
    assert abs((heavy < light).mean() - 0.75) < 0.01


def test_collision_rate_equals_generalised_jaccard():
    rng, hasher = random.Random(3), fingerprints.new_hasher()
    errors = []
    for _ in range(60):
        a = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 300))]
        b = a[: rng.randint(0, len(a))] + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 200))]
        a, b = " ".join(a), " ".join(b)
        f = fingerprints.fingerprints(hasher, [a.encode(), b.encode()])
        errors.append(fingerprints.likeness(f[:1], f[1:])[0] - brute_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.3 * math.sqrt(0.25 / fingerprints.SAMPLES)


def test_fingerprints_do_not_depend_on_their_batch(monkeypatch):
    hasher = fingerprints.new_hasher()
    texts = [(r[1] or "").encode() for r in odd_rows()]
    together = fingerprints.fingerprints(hasher, texts)
    monkeypatch.setattr(fingerprints, "BLOCK", 37)
    assert (together == np.concatenate([fingerprints.fingerprints(hasher, [t]) for t in texts])).all()
    assert not together[0].any() and not together[2].any() and together[3].all()


@pytest.mark.parametrize("size", [50, 1 << 18])
def test_edits_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", size)
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = fingerprints.edits(documents(spark, rows)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted(texts)
    following = dict(zip(order, order[1:] + order[:1]))
    hasher = fingerprints.new_hasher()
    own = {i: fingerprints.fingerprints(hasher, [texts[i].encode()]) for i in order}
    assert len(got) == len(rows)
    for r in got:
        text, after = texts[r.doc_id], texts[following[r.doc_id]]
        n = len(text) // 4
        want = text[: len(text) - n] + after[:n]
        other = fingerprints.fingerprints(hasher, [want.encode()])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(want.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint_text(own[r.doc_id])[0] and r.edited_fingerprint == fingerprints.fingerprint_text(other)[0]
        assert r.near_edited == (own[r.doc_id] == other).mean() and r.near_next == (own[r.doc_id] == own[following[r.doc_id]]).mean()


def test_edits_of_few_repeated_and_unnamed_rows(spark):
    assert fingerprints.edits(documents(spark, [(1, "a b", "en", "s", 3)]).limit(0)).count() == 0
    lone = fingerprints.edits(documents(spark, [(1, "abcdefgh", "en", "s", 3)])).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = odd_rows()
    got = fingerprints.edits(documents(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    assert len({r.fingerprint for r in got}) <= len({" ".join((r[1] or "").split()) for r in rows})


def test_fingerprint_column_keeps_the_rows(spark):
    docs = documents(spark, odd_rows()).withColumn("fingerprint", F.lit(1))
    got = fingerprints.fingerprinted(docs)
    assert set(got.columns) == set(docs.columns) and got.count() == docs.count()
    assert got.where("length(fingerprint) != 256").count() == 0


# Manifest


def brute_leaf(i, text, lang, source, n):
    parts = (i, source, lang, n, text)
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts).encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """Levels of a tree, from the leaves to its one top."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 8
        out.append((level[start:i], level[i + 1 : start + 8]))
        i //= 8
    return out


def brute_proofs(rows):
    trees = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        low = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        trees[lang].append((i is not None, i or 0, brute_leaf(i, text, lang, source, n), brute_leaf(i, low, lang, source, n)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {x: brute_tree([r[2] for r in sorted(trees[x])]) for x in langs}
    upper = brute_tree([levels[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for k, (named, i, leaf, changed) in enumerate(sorted(trees[lang])):
            pairs = brute_siblings(levels[lang], k) + brute_siblings(upper, place)
            node = changed
            for left, right in pairs:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in pairs))
            out.append((i if named else None, leaf, levels[lang][-1][0], upper[-1][0], proof, node, node == upper[-1][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_equal_brute_force(spark, monkeypatch, levels):
    """Trees of one to some hundred leaves, built in one round and in several."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDTH", merkle.FAN**levels)
    rows = odd_rows(150) + [(1000 + k, f"Text {k}", f"l{k}", "s", k) for k in range(9)]
    lowered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))
    got = merkle.proofs(merkle.build(documents(spark, rows), lowered))
    got = collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())
    assert got == brute_proofs(rows)


def test_the_log_is_written_in_postorder(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(577)]
    manifest = merkle.build(documents(spark, rows))
    log = {r.position: r for r in manifest.log.where("tree = '1en'").collect()}
    assert sorted(log) == list(range(577 + 73 + 10 + 2 + 1))
    done = collections.deque()
    for at in sorted(log):  # every node closes the open nodes below it
        node = log[at]
        below = []
        while done and done[-1].height == node.height - 1 and done[-1]["index"] // 8 == node["index"]:
            below.append(done.pop().digest)
        assert node.height == 0 or node.digest == sha("".join(reversed(below)))
        done.append(node)
    assert len(done) == 1
    levels = brute_tree([brute_leaf(*r[:1], r[1], *r[2:]) for r in rows])
    for index in (0, 63, 64, 512, 576):
        assert merkle.lookup(manifest, "en", index) == brute_siblings(levels, index)


@pytest.mark.parametrize("rows", [[], [(5, "Only One", "en", "s", 8)], [(5, "A", None, None, None), (None, None, None, None, None)]])
def test_small_manifests(spark, rows):
    docs = documents(spark, rows or [(1, "x", "en", "s", 1)])
    got = merkle.proofs(merkle.build(docs if rows else docs.limit(0))).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    if len(rows) == 1:
        assert got[0].root == got[0].subroot == got[0].leaf and got[0].proof_sha256 == sha("")


# Filter audit


def brute_audit(rows, labels):
    lows = {}
    for i, text, *_ in rows:
        if i is not None:
            lows[text or ""] = min(i, lows.get(text or "", i))
    marks = collections.defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        marks[i][0] |= quality == 1
        marks[i][1] |= toxic == 1
    failed = collections.defaultdict(list)
    for i, text, _, source, _ in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > lows[text],
        }
        good, toxic = marks[i] if i is not None else (False, False)
        failed[source or ""].append(({k for k in fails if fails[k]}, good, toxic))
    out = {}
    for part, docs in failed.items():
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            gone = [False] * len(docs)
            for step, letter in enumerate(order, 1):
                row = collections.Counter()
                for k, (fails, good, toxic) in enumerate(docs):
                    if letter in fails:
                        row["redundant"] += gone[k]
                        row["unique"] += len(fails) == 1
                        if not gone[k]:
                            row["removed"] += 1
                            row["good"] += good
                            row["toxic"] += toxic
                            gone[k] = True
                share[letter] += row["removed"]
                out[part, "".join(order), step] = [gone.count(False), *(row[c] for c in ("removed", "redundant", "unique", "good", "toxic"))]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rows = odd_rows()
    labels = [(r[0], k % 2, k % 5 == 0) for k, r in enumerate(rows) if k % 3] + [(rows[4][0], 1, 1), (rows[4][0], 0, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    table = spark.createDataFrame([(*x, "p") for x in labels], LABELS)
    got = audit.audit(documents(spark, rows), table).collect()
    want = brute_audit(rows, [x for x in labels if x[0] is not None])
    assert {(r.part, r.filter_order, r.step): tuple(r[m] for m in audit.MEASURES) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bits", [16, 4])
def test_the_sketch_clears_only_texts_that_occur_once(bits, monkeypatch):
    """Also where it is far too small."""
    monkeypatch.setattr(audit, "RANGE_BITS", min(bits, 16))
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    keys[1:400:2] = keys[0:400:2]
    import pyarrow as pa

    rows = [b for part in np.split(keys, 5) for b in audit._partial(bits)([pa.RecordBatch.from_arrays([pa.array(part)], ["key"])])]
    bitmap = np.zeros(1 << bits, bool)
    for name in {x for b in rows for x in b.column(0).to_pylist()}:
        mine = [b.filter(pa.compute.equal(b.column(0), name)) for b in rows]
        merged = next(audit._merge((pa.scalar(name),), iter(mine)))
        ones = np.unpackbits(np.frombuffer(merged.column(1)[0].as_py(), np.uint8), bitorder="little").astype(bool)
        bitmap[name << audit.RANGE_BITS : (name + 1) << audit.RANGE_BITS] = ones
    again = audit.may_repeat(keys, np.packbits(bitmap, bitorder="little"), bits)
    assert again[:400].all()
    assert again[400:].mean() < 0.1 if bits == 16 else True


def test_sketch_grows_with_the_rows():
    assert audit.sketch_bits(0) == audit.LEAST_BITS and audit.sketch_bits(1 << 20) == 23 and audit.sketch_bits(1 << 40) == audit.MOST_BITS


def test_only_possible_repeats_leave_their_task(spark):
    unique = [(k, f"text number {k}", "en", "s", 1) for k in range(2000)]
    rows = audit.flagged(documents(spark, unique + [(5000 + k, "twin", "en", "s", 1) for k in range(300)]))
    assert rows.where("mask >= 16").count() == 299 and rows.where("mask >= 16 and doc_id = 5000").count() == 0


def test_empty_audit(spark):
    none = documents(spark, [(1, "x", "en", "s", 1)]).limit(0)
    assert audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_filter_audit"])
def test_new_queries_match_their_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), views(SMALL), ORACLE[name]) is None
