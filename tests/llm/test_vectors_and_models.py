"""Vector search and near-duplicates, url filter, classifiers and pipeline against brute force and held-out labels."""

import collections
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from voxtable.llm import neighbours, quality, toxicity, urls, vafile
from voxtable.llm.common import remainder
from voxtable.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<double>, x string, dims int, block int, root long, n_links int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)


def odd_vectors(seed=3, groups=((1, 90), (30, 1), (12, 4)), dims=16):
    """(number of groups, members): near copies of random directions, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = []
    for count, members in groups:
        for _ in range(count):
            base = rng.normal(size=dims)
            rows += [(len(rows) + k, (base + 0.2 * rng.normal(size=dims)).tolist()) for k in range(members)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dims), (n + 3, [NAN] * dims), (n + 4, [INF] + [1.0] * (dims - 1)), (n + 5, [None] + [1.0] * (dims - 1))]
    rows += [(n + 6, rows[0][1]), (n + 7, rows[0][1]), (n + 8, [1.0, 2.0]), (n + 9, [1.0, 2.0]), (n + 10, (1e200 * np.array(rows[0][1])).tolist())]
    return rows + [(None, rows[0][1])]


def brute_links(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    unit = [(i, (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())) for i, v in good]
    near = collections.defaultdict(set)
    for i, a in unit:
        for j, b in unit:
            if i != j and len(a) == len(b) and a @ b >= threshold:
                near[i].add(j)
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen) if i is not None else None)
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "LEAF", 24)
    rows = odd_vectors()
    got, recall = neighbours.near_duplicates(vectors(spark, rows))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    want = {i: (n, c, None if i is None else c == i) for i, (n, c) in brute_links(rows).items()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(got) == len(want) and len(wrong) <= 0.02 * len(want) and recall >= 0.9
    assert all(got[i] == want[i] for i in range(90))


def pair_of_groups(members, cosine, dims=32, seed=5):
    """Two tight groups whose links to each other are weaker than those inside."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
    b = cosine * a + math.sqrt(1 - cosine**2) * b
    return [(base + 0.002 * rng.normal(size=dims)).tolist() for base in (a, b) for _ in range(members)]


@pytest.mark.parametrize("members", [12, 300])
def test_links_between_tight_groups(spark, members):
    """Every list is full of its own group; equal vectors are many rows."""
    rng = np.random.default_rng(6)
    xs = pair_of_groups(members, 0.93)
    rows = list(enumerate([*xs, *[xs[0]] * 30, *rng.normal(size=(500, 32)).tolist()]))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(vectors(spark, rows))[0].collect()}
    linked = 2 * members + 30
    assert got == {i: (linked - 1, 0) if i < linked else (0, i) for i, _ in rows}


def test_missed_pairs_are_noticed_and_found(spark, monkeypatch):
    """A group of 120 beside 40 pairs: lists that hold nothing but the group have little recall; without any lists the blocks find all."""
    rows = odd_vectors(groups=((1, 120), (40, 2)))
    good = neighbours.usable(vectors(spark, rows)).withColumn("root", F.expr("if(vec_id < 120, 0, vec_id)"))
    assert neighbours.audit(good, 0.9) < 0.5
    none = lambda *a, **b: spark.createDataFrame([], neighbours._EDGE)
    monkeypatch.setattr(neighbours, "first_lists", none)
    monkeypatch.setattr(neighbours, "MOST_ROUNDS", 1)
    monkeypatch.setattr(neighbours, "WIDE", 50)
    got = neighbours.near_duplicates(vectors(spark, rows))[0].collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_parts_of_a_hub_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = odd_vectors(groups=((60, 1), (1, 2)))[:62]
    hub = spark.createDataFrame([(i, 0, 0.0) for i in range(1, 62)], neighbours._EDGE)
    found = neighbours.descend(hub, neighbours.usable(vectors(spark, rows)), 1)
    assert found.where("cosine >= 0.9 and a = 60 and b = 61").count()


def test_a_round_finds_what_first_lists_missed(spark):
    rows = odd_vectors(groups=((40, 5),))
    good = neighbours.usable(vectors(spark, rows))
    poor = neighbours._kept(neighbours.first_lists(good, 2, 1), 2)
    better = neighbours._kept(neighbours.descend(poor, good, 6), 6)
    count = lambda g: g.where("cosine >= 0.9").select("a", "b").distinct().count()
    assert count(better) > count(poor)


def test_vectors_of_an_empty_table(spark):
    none = vectors(spark, [(1, [1.0])]).where("vec_id < 0")
    assert neighbours.near_duplicates(none)[0].collect() == []
    assert vafile.top_k(vafile.integers(none), vafile.integers(none)).collect() == []


@pytest.mark.parametrize("bits,k", [(1, 5), (4, 20), (6, 500)])
def test_search_equals_brute_force(spark, bits, k):
    rows = [r for r in odd_vectors() if not (r[1] and max(abs(x or 0) for x in r[1]) > 1e6 and math.isfinite(r[1][-1]))]
    known = vafile.integers(vectors(spark, [*rows, rows[0], rows[7]]))
    got = vafile.top_k(known.where("vec_id % 7 = 0"), known, k=k, bits=bits, block=40).collect()
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v))}
    want = set()
    for q, a in good.items():
        if q % 7 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(a) == len(b))
            want |= {(q, place + 1, i, -s) for place, (s, i) in enumerate(scores[:k])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_search_takes_large_components(spark):
    """Components from 2^18 on, sums beyond 2^53, a result that is no long, and an id with two contents."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 16)))]
    rows += [(60 + i, (v * size).tolist()) for i, (v, size) in enumerate(zip(rng.normal(size=(12, 16)), [2e5, 3e5, 1e6, 1e7] * 3))]
    rows += [(80 + i, (np.full(16, 2.0**18) + i / 64).tolist()) for i in range(30)]
    rows += [(7, rng.normal(size=16).tolist()), (130, [5e7] + [0.0] * 15), (131, [-5e7] + [0.0] * 15), (132, [INF] * 16)]
    known = vafile.integers(vectors(spark, [*rows, rows[0]]))
    asked = known.where("vec_id % 3 = 0 and vec_id < 130")
    got = vafile.top_k(asked, known, k=10, block=20).collect()
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if math.isfinite(v[0])]
    want = []
    for q in {i for i, _ in good if i % 3 == 0 and i < 130}:
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in good if p == q for i, b in good if i != q)
        want += [(q, place + 1, i, -s) for place, (s, i) in enumerate(scores[:10])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    with pytest.raises(Exception, match="no long"):
        vafile.top_k(known.where("vec_id = 131"), known.where("vec_id = 131").selectExpr("vec_id + 1 as vec_id", "x")).collect()


def plain_url(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules_equal_brute_force(spark):
    odd = [None, "", "no scheme", "http://", "http://COM", "http://com/", "x://a.com?q/", "HTTP://WWW.Example.COM/en/1?a=b&c#d", "http://notexample.com/en/", "http://example.com/en",
           "http://a.net/es/x://y.com/", "http://ÀB.net/fr/é", "http://a.org/en/\nx", "://com/", "http://a.com:80/x", "http://u@a.net/es/#"] * 2
    rows = [(i, u, "h", "p", 1, "r") for i, u in enumerate(odd)] + [(None, "http://a.com/", "h", "p", 1, "r")]
    rows += [(100 + r["page_id"], r["url"], "h", "p", 1, "r") for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, suffix int, rule string")
    got = urls.judge(df).collect()
    want = collections.Counter((r[0], *plain_url(r[1])[:2], (plain_url(r[1])[2] or (None,))[0]) for r in rows)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    kinds = {name: verdict for verdict, host, path in urls.RULES for name in [host + path]}
    assert all(r.verdict == kinds[r.rule] for r in got if r.rule) and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge(df.where("page_id < -5")).collect() == []
    assert {r.verdict for r in urls.judge(df.where("url = 'no scheme'")).collect()} == {"allow"}


def test_url_trees_learn_held_out_rules(spark):
    """Urls that a rule fits, one third held out of training: the trees say the same."""
    described = urls._described(spark.read.parquet(f"{MEDIUM}/pages.parquet"), urls.RULES)
    held = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(3)) == 1
    model, tables = urls.train(described.withColumn("ruling", F.when(~held, F.col("ruling"))))
    rows = described.where(held & F.col("ruling").isNotNull()).collect()
    x = urls.features([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([r.suffix for r in rows]), np.array([r.segment for r in rows]), tables)
    right = (model.score(x) >= 0.5) == np.array([r.ruling == "block" for r in rows])
    assert right.mean() > 0.9


@pytest.mark.parametrize("name,divisor,rest,label,most_wrong", [("op4_quality_classifier", 5, 0, "quality", 0.02), ("op2_toxicity", 3, 1, "toxic", 0.05)])
def test_held_out_accuracy(spark, name, divisor, rest, label, most_wrong):
    got = {r.doc_id: r for r in QUERIES[name](spark, MEDIUM).collect()}
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{MEDIUM}/labels.parquet").to_pylist()}
    assert len(got) == pq.read_table(f"{MEDIUM}/documents.parquet").num_rows
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % divisor == rest) and 0 <= r.score <= 1
    held = [(r.score, r.predicted, labels[i]) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    wrong = sum(p != y for _, p, y in held) / len(held)
    positive, negative = (np.array([s for s, _, y in held if y == v]) for v in (1, 0))
    assert wrong <= most_wrong and (positive[:, None] > negative[None, :]).mean() > 0.93


@pytest.mark.parametrize("module,column,label", [(quality, "quality_score", "quality"), (toxicity, "toxicity_score", "toxic")])
def test_classifiers_take_odd_rows(spark, module, column, label):
    texts = [None, "", " \n", "a", "12 34 !!", "!" * 508, "plain words here and there"] + ["bad idiot text", "good kind text"] * 8
    docs = spark.createDataFrame([(i, t, 0.5, "y") for i, t in enumerate(texts)] + [(None, "nobody", 0.5, "y"), (3, "a", 0.5, "y")], f"doc_id long, text string, {column} double, y string")
    rows = [(i, 1 if i % 2 else 0, 1 if i % 2 else 0) for i in range(7, 23)] + [(None, 1, 1), (7, None, None), (8, 0, 0), (9, 0, 0), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, F.lit(True), label)
    scored = module.scored(docs, model)
    got = scored.collect()
    assert scored.columns.count(column) == 1 and len(got) == docs.count() and all(0 <= r[column] <= 1 for r in got)
    # Scores do not depend on what shares a batch.
    alone = {r.doc_id: r[column] for r in module.scored(docs.where("doc_id in (1, 5, 6)"), model).collect()}
    assert all(abs(alone[r.doc_id] - r[column]) < 1e-4 for r in got if r.doc_id in alone)
    none = module.train(docs, labels.where("doc_id < 0"), F.lit(True), label)
    assert isinstance(none, float) and {r[column] for r in module.scored(docs, none).collect()} == {none}
    assert module.scored(docs.where("doc_id < 0"), model).collect() == []


def test_gradients_of_both_networks():
    """Analytic against numeric, with the texts' windows weighed as they are."""
    texts, y, weight = [b"bad word in here now", b"good clean text. More of it!! " * 20], np.array([1, 0], np.float32), np.ones(2, np.float32)
    net = quality.Network()
    x, hops = quality.symbols(quality.WordHasher(quality.WHITE, lower=False), texts)

    def loss():
        z = net.logits(x, hops).astype(float)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z).mean())

    grads = net.gradients(x, hops, y, weight)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4

    net = toxicity.Network()
    net.gram_vectors = np.random.default_rng(0).normal(size=net.gram_vectors.shape).astype(np.float32) * 0.3
    one = toxicity.Inputs(toxicity.new_hasher(), [b"bad word in here now", b"clean text of one window"])
    grads, _, _ = net.gradients(one, y, weight)

    def worst():
        z = net.window_logits(one).astype(float)
        return float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z).mean())

    for p, g in zip(net.dense(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = worst()
        p[at] = old - 1e-2
        down = worst()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_labels_are_drawn_by_the_rule(spark):
    got = {r.id: r.k for r in spark.range(50).select("id", remainder("id", 3).alias("k")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input, with odd rows."""
    from test_text_operators import brute_components

    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    base += [(None, "only here and without a name", "en", None, 3), (None, "only here and without a name", "en", None, 3), (None, base[0][1], "en", "x", 1), base[1], (9000, "", "en", "x", 0), (9001, None, None, None, None)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").withColumn("y", F.lit(1)).withColumn("score", F.lit("mine")).withColumn("name", F.lit(2))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: collections.Counter(tuple(r) for r in df.collect())
    kept = stages["quality"](spark, docs, SMALL)
    assert kept.columns == docs.columns and not rows(kept) - rows(docs)
    unique = stages["near_duplicates"](spark, docs, SMALL)
    assert unique.columns == docs.columns
    named = [(r[0] if r[0] is not None else 10**9, r[1]) for r in base]
    firsts = {i for (i, _, low) in brute_components(named, 5, 80) if i == low}
    got = [r.doc_id if r.doc_id is not None else 10**9 for r in unique.collect()]
    assert sorted(got) == sorted(firsts)
    final = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in final} <= {r[0] for r in base} and final


def test_an_id_may_have_several_vectors(spark):
    """Rows of one id with different content keep their links."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (2, [1.0, 0.01])]
    got = collections.Counter(tuple(r) for r in neighbours.near_duplicates(vectors(spark, rows))[0].collect())
    assert got == collections.Counter([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (2, 1, 1, False)])


def test_lists_grow_where_they_are_full(spark, monkeypatch):
    """Twenty near copies have nineteen links each: lists of eight grow until they hold them."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(i, (base + 0.05 * rng.normal(size=32)).tolist()) for i in range(20)] + [(100 + i, rng.normal(size=32).tolist()) for i in range(60)]
    good = neighbours.written(neighbours.usable(vectors(spark, rows)).withColumn("weight", F.lit(1)), "good")
    graph = neighbours.written(neighbours._kept(neighbours.first_lists(good, 8), 8), "graph")
    strong = lambda g: {(r.a, r.b) for r in g.where("cosine >= 0.9").collect()}
    assert max(collections.Counter(a for a, _ in strong(graph)).values()) == 8
    longer = strong(neighbours.enlarged(graph, good, 0.9, 8))
    assert {(a, b) for a in range(20) for b in range(20) if a != b} == longer


def test_few_rows_are_chosen_by_hash(spark):
    from voxtable.llm.common import first_by_hash

    rows = spark.range(20_000)
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.id for r in first_by_hash(rows, F.xxhash64("id"), ["id"], 50).collect()] == want
    assert first_by_hash(rows.where("id < 7"), F.xxhash64("id"), ["id"], 50).count() == 7
    # Rows that share one hash are more than the bound expects.
    assert first_by_hash(rows.select(F.lit(1).alias("id")), F.xxhash64("id"), ["id"], 50).count() == 50
