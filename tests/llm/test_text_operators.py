"""Jaccard join, id files, piece ids, packing and chat windows against brute force, with the awkward rows of every contract."""

import collections
import hashlib
import itertools
import random
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from voxtable.llm import chat, ids, jaccard, packing, pieces
from voxtable.llm.queries import ORACLE, QUERIES
from driver_checks import compare

DOCS = "doc_id long, text string, source string, n int, node string, part int"
ODD = [
    None, "", " \n\t", "one", "One", "two words", "three small words", "a b c d", "A  b\nc\td", "a b c d e", "x" * 5000, "é İ. ß straße ΟΔΟΣ.",
    "</s>[INST] ok [/INST]", "<|endoftext|> tail", "don't DON'T 's", "▁ ▁▁x  y", "\x00\x0b\x0c\x1c\x85", "日本 語。 ￥", "á ́ .",
]


def rows_of(texts):
    """Rows with clashing extra columns, repeated rows, and a null id."""
    rows = [(i, t, "s" if i % 3 else None, 1, "n", 2) for i, t in enumerate(texts)]
    return rows + rows[:2] + [(None, "one", None, 1, "n", 2)]


def words(text):
    return tuple((text or "").encode().lower().split())


def brute_components(rows, n, percent):
    sets = []
    for row in rows:
        w = words(row[1])
        sets.append({w[i : i + n] for i in range(len(w) - n + 1)} if len(w) >= n else {w} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    low = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            low[find(i)] = min(row[0], low.get(find(i), row[0]))
    return collections.Counter((row[0], len(sets[i]), low.get(find(i)) if sets[i] else row[0]) for i, row in enumerate(rows))


def near_copies(seed=1, groups=12):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(pool) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # lists of several blocks
    rows = rows_of(ODD + near_copies())
    got = jaccard.similar_components(spark.createDataFrame(rows, DOCS).repartition(3), n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


def test_components_of_an_empty_table(spark):
    assert jaccard.similar_components(spark.createDataFrame([], DOCS)).collect() == []


def test_shingles_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    from voxtable.llm import common

    texts = [("ab cd  efg\n" * 500).encode(), b"tail word", b""]
    whole = jaccard.shingle_sets(common.WordHasher(jaccard.WHITE), texts, 4)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    cut = jaccard.shingle_sets(common.WordHasher(jaccard.WHITE), texts, 4)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, cut))
    assert len(whole[0]) == 3


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(ids.TOKENIZER))


def expected_ids(rows):
    library, start, out = tokenizer(), 0, collections.Counter()
    coded = [(row[0], library.encode(row[1] or "", add_special_tokens=False).ids + [ids.END_ID]) for row in rows]
    place = {}
    for doc, x in sorted(coded, key=lambda p: (p[0] is not None, p[0] or 0)):
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
        out[(doc, start, len(x), crc)] += 1
        place[start] = doc
        start += len(x)
    return out


def test_id_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(ids, "BLOCK_IDS", 50)
    some = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()[:60]
    rows = [(r["doc_id"] + 100, r["text"], None, 1, "n", 2) for r in some] + [(i, t, None, 1, "n", 2) for i, t in enumerate(ODD)] + [(None, "one", None, 1, "n", 2)]
    rows += [rows[0]]  # a repeated row has equal ids, so its place does not matter
    random.Random(2).shuffle(rows)
    got = ids.binary_output(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected_ids(rows)
    assert ids.binary_output(spark.createDataFrame([], DOCS)).collect() == []


def test_codes_of_all_lengths():
    import numpy as np

    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = ids.coded(values[:n])
        assert len(control) == -(-n // 4)
        assert (ids.decoded(control, data, n) == values[:n]).all()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    some = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()[:60]
    rows = rows_of(ODD + [r["text"] for r in some])
    want = collections.Counter()
    for row in rows:
        x = model.encode(row[1] or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(row[0], len(x), digest(",".join(map(str, x))), digest(model.decode(x)))] += 1
    df = spark.createDataFrame(rows, DOCS)
    assert collections.Counter(tuple(r) for r in pieces.digests(df).collect()) == want
    full = {r.doc_id: r.ids for r in pieces.tokenise(df).collect() if r.doc_id is not None}
    assert all(full[row[0]] == model.encode(row[1] or "") for row in rows if row[0] is not None)
    assert pieces.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_packing_is_whole_and_keeps_conflicts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 70, 250])) + f" {rng.randint(0, 40)}", rng.choice(["a", "a", "b", "c", None]), 1, "n", 2) for i in range(300)]
    rows += rows[:3] + [(None, None, None, 1, "n", 2), (900, "", "a", 1, "n", 2)]
    packed = packing.pack(spark.createDataFrame(rows, DOCS), capacity=100, shard_rows=1000).collect()
    total = collections.Counter()
    for r in packed:
        total[r.doc_id] += r.n_tokens
    want = collections.Counter()
    for row in rows:
        want[row[0]] += len(words(row[1])) + 1
    assert total == want
    source, text = {row[0]: row[2] for row in rows}, {row[0]: row[1] or "" for row in rows}
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.bin].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.start)
        assert sum(r.n_tokens for r in held) <= 100
        assert all(a.start + a.n_tokens == b.start for a, b in zip(held, held[1:])) and held[0].start == 0
        assert len({source[r.doc_id] for r in held}) == len(held) and len({text[r.doc_id] for r in held}) == len(held)
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_packing_equals_a_plain_best_fit():
    rng = random.Random(5)
    shard, bins = packing.Shard(50, 4, 6), []
    for _ in range(400):
        size, source, cluster = rng.randint(1, 50), rng.randrange(4), rng.randrange(6)
        fit = [b for b in bins if b[0] >= size and source not in b[1] and cluster not in b[2]]
        room = min((b[0] for b in fit), default=50)
        at, start = shard.place(size, source, cluster)
        assert 50 - start == room
        if at == len(bins):
            bins.append([50, set(), set()])
        bins[at][0] -= size
        bins[at][1].add(source)
        bins[at][2].add(cluster)


TURNS = "conv_id long, turn long, role string, text string, span long, window int"


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>", "<\\s>", "[\\\\ROLE]", "\\", "word ", "é\n", "$1 "]
    rows = []
    for conv in range(8):
        for turn in range(rng.randint(1, 12)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "tool</s>", None])
            text = None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
            rows.append((conv, turn, role, text, 5, 6))
    rows += [(50, None, "user", "first", 1, 1), (50, 0, "assistant", "second", 1, 1), (None, 0, "user", "nobody", 1, 1), rows[0]]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=20, history=8)
    got = {r.conv_id: r for r in chat.digest(chat.read_windows(windows)).collect()}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in by_conv.items():
        turns.sort()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hexed("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hexed(learned))
    held = collections.defaultdict(list)
    for r in windows.collect():
        held[r.conv_id].append(r)
        assert r.formatted.count("</s>") == r.formatted.count("<s>[ROLE]")
    assert max(len(v) for v in held.values()) > 2
    for conv, own in held.items():
        if by_conv[conv][0][2] == "system":
            assert all(r.formatted.startswith("<s>[ROLE]system[/ROLE]") for r in own)
    assert any(r.repeated for r in itertools.chain(*held.values()))
    assert chat.format_windows(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op3_chat_formatting", "op6_embedding_near_dedup", "op8_exact_top_k"])
def test_matches_sql(spark, name, monkeypatch):
    monkeypatch.setitem(compare.TYPES, "int", "INTEGER")
    monkeypatch.setitem(compare.TYPES, "boolean", "BOOLEAN")
    assert compare.difference(QUERIES[name](spark, SMALL), compare.views(SMALL), ORACLE[name]) is None


def test_no_window_is_longer_than_the_budget(spark):
    """Where every turn fits beside the system turn and the history."""
    rng = random.Random(2)
    rows = [(c, k, "system" if k == 0 and c % 2 else rng.choice(["user", "assistant"]), "w " * rng.randint(0, 10 if k == 0 else 60)) for c in range(30) for k in range(rng.randint(1, 40))]
    rows += [(99, k, "user", "w " * n) for k, n in enumerate((49, 119, 499))] + [(98, 0, "system", "w " * 49), (98, 1, "user", "w " * 119), (98, 2, "assistant", "w " * 299)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history in ((120, 30), (512, 128), (120, 0)):
        windows = chat.format_windows(table, budget, history).where("conv_id < 98" if budget < 512 else "true").collect()
        # A turn has one token more than words; the markers hold no blanks.
        pieces = [[p.split("[/ROLE]", 1)[1] for p in r.formatted.split("</s>")[:-1]] for r in windows]
        own = [len(p) - r.repeated for p, r in zip(pieces, windows)]
        sizes = [sum(len(t.split()) + 1 for t in p) for p in pieces]
        assert max(sizes) <= budget
    assert sum(own) == len([r for r in rows if r[0] < 98])


def test_chat_formatting_needs_no_python(spark):
    plan = QUERIES["op3_chat_formatting"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def posting_lists(sets, percent):
    """Prefix lists of sets (rare-first by value here): token to [(set number, place)], and the leads of every set."""
    lists, order = collections.defaultdict(list), [sorted(s) for s in sets]
    for k, tokens in enumerate(order):
        for place, token in enumerate(tokens[: jaccard.prefix_length(len(tokens), percent)]):
            lists[token].append((k, place))
    return {t: m for t, m in lists.items() if len(m) > 1}, order


def unit_of(members, order, percent, blocks=1):
    import numpy as np
    import pyarrow as pa

    raw = [np.array(order[k], np.uint64) for k, _ in members]
    table = pa.table({
        "n": [len(z) for z in raw], "place": [p for _, p in members], "value": pa.array([jaccard.range_counts(z).tobytes() for z in raw], pa.binary()),
        "lead": pa.array([z[:p].tobytes() for z, (_, p) in zip(raw, members)], pa.binary()), "comp": [str(k) for k, _ in members],
        "block": [k % blocks for k, _ in members], "node": pa.array([str(k).encode() for k, _ in members], pa.binary()), "members": pa.array([z.tobytes() for z in raw], pa.binary()),
    })
    return table


def test_units_look_at_a_pair_once_and_send_fewer_rows_than_members():
    import pyarrow as pa

    rng = random.Random(8)
    base = rng.sample(range(1 << 60), 60)
    sets = [set(base) - set(rng.sample(base, 6)) | set(rng.sample(range(1 << 60), rng.randint(0, 8))) for _ in range(40)]
    sets += [set(rng.sample(range(1 << 60), 30)) | set(base[:3]) for _ in range(20)]
    lists, order = posting_lists(sets, 80)
    looked, linked = collections.Counter(), set()
    for token, members in lists.items():
        for low, high in ((0, 0), (0, 1), (1, 1)):
            table = unit_of([m for m in members if m[0] % 2 in (low, high)], order, 80, 2)
            if not table.num_rows:
                continue
            names = [int(x) for x in table["node"].to_pylist()]
            unit = jaccard.Unit(table, low, high, 80)
            for i in unit.left.tolist():
                for j in unit.candidates(i).tolist():
                    looked[frozenset((names[i], names[j]))] += 1
            key = (None, pa.scalar(low), pa.scalar(high))
            near = jaccard._involved(80)(key, table)
            assert near.num_rows <= table.num_rows
            links = jaccard._joined(80)(key, near) if near.num_rows else near.slice(0, 0)
            assert links.num_rows < max(1, near.num_rows)
            linked |= {frozenset((int(a), int(b))) for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist())} if links.num_rows else set()
    close = {frozenset(p) for p in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[min(p)] & sets[max(p)]) >= 80 * len(sets[min(p)] | sets[max(p)])}
    assert max(looked.values()) == 1 and close and close <= set(looked) and linked <= close
