"""Near-duplicates, repeated passages, components and nearest vectors against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from scansio.llm import components, deepshallow, neighbours, repeats, simhash, topk
from scansio.session import stage


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 5, [1]) for i, t in rows],
                                 "doc_id bigint, text string, hash int, kept string, component int, row array<int>")


def reachable(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = [e for e in edges if e[0] != e[1]]
    assert got == reachable({n for e in linked for n in e}, linked)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# fingerprints

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    parts = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "two words"), (7, "É É é"), (8, "a b c d e f g h"),
         (9, "A B C D E F G H"), (10, "x " * 5000), (11, "x " * 5000), (12, "a\x0bb\x0cc\x85d"), (None, "one"), (4, "One")]


def test_fingerprints():
    for _, text in TEXTS:
        assert int.from_bytes(simhash.fingerprint(text, 3)) == plain_fingerprint(text)


def test_trie_join_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "WHOLE", 2)
    monkeypatch.setattr(simhash, "STEP", 64)
    draw = np.random.default_rng(4)
    for depth in (0, 2):
        centres = draw.integers(0, 1 << 62, 12, dtype=np.uint64)
        values = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << draw.integers(0, 64, 12, dtype=np.uint64))
                                                       ^ (np.uint64(1) << draw.integers(0, 64, 12, dtype=np.uint64)) for _ in range(6)]))
        groups = {}
        for v in values:
            groups.setdefault(int(v) >> (64 - depth) if depth else 0, []).append(v)
        found = set()
        for x, a in groups.items():
            for y, b in groups.items():
                if x <= y:
                    a_, b_ = np.array(a), np.array(b)
                    for i, j in simhash.trie_join(a_, None if x == y else b_, depth, 3):
                        found |= {(int(a_[p]), int(b_[q])) for p, q in zip(i, j)}
        want = {(int(a), int(b)) for a in values for b in values if a < b and int(a ^ b).bit_count() <= 3}
        assert found == want and len(want) > 50


def near_texts():
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for k in range(12):
        base = draw.choices(words, k=300)
        rows.append((100 + k, " ".join(base)))
        for copy in range(5):
            changed = list(base)
            changed[draw.randrange(300)] = "changed"
            rows.append((200 + 10 * k + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("subtree", [1 << 15, 4])
def test_simhash_against_brute_force(spark, monkeypatch, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    rows = TEXTS + near_texts()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    values = {f for _, f in prints}
    linked = [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3]
    group = reachable(values, linked)
    least = {}
    for i, f in prints:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in prints), key=repr)
    got = sorted(map(tuple, simhash.digests(frame(spark, rows)).collect()), key=repr)
    assert got == want
    assert len({g[2] for g in got}) < len(values)
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.keep_one(frame(spark, rows).limit(0)).count() == 0


# repeated passages

def passages():
    draw = random.Random(12)

    def text(n):
        return "".join(draw.choices("abcdefghijklmno é", k=n))

    shared = [text(n) for n in (99, 100, 101, 180, 400)]
    rows = [(1, text(500)), (2, None), (3, ""), (4, "short")]
    for k in range(5, 60):
        parts = [text(draw.randint(0, 150)) for _ in range(3)]
        rows.append((k, parts[0] + draw.choice(shared) + parts[1] + draw.choice(shared) + parts[2]))
    rows += [(60, rows[0][1]), (61, rows[0][1][30:480]), (62, "z" * 350), (63, "zy" * 200), (64, rows[8][1][::-1])]
    return rows


def test_repeats_against_brute_force(spark):
    rows = passages()
    want = repeats.brute_force([(i, (t or "").encode()) for i, t in rows])
    got = {r[0]: tuple(r)[1:] for r in repeats.digests(frame(spark, rows)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 10_000
    assert repeats.digests(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    got = sorted(map(tuple, repeats.digests(frame(spark, [(1, text), (1, text), (None, text), (2, "x")])).collect()), key=repr)
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 0), (None, 300)]


def test_texts_without_ids_are_told_apart(spark):
    """Thousands of texts share the null id, and some one id; the order among them is that of their hashes."""
    draw = random.Random(13)

    def text(n):
        return "".join(draw.choices("abcdefghijklmno é", k=n))

    shared = [text(n) for n in (100, 130, 200)]
    made = list(dict.fromkeys(text(draw.randint(0, 20)) + (draw.choice(shared) if k % 3 else text(120)) + text(draw.randint(0, 30))
                              for k in range(4000)))
    rows = [(None, t) for t in made[:3000]] + [(7, t) for t in made[3000:3500]] + [(100 + k, t) for k, t in enumerate(made[3500:])]
    docs = frame(spark, rows)
    tags = {r["text"]: r["tag"] for r in docs.selectExpr("text", "xxhash64(text) as tag").collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, tags[r[1]]))
    brute = repeats.brute_force([(k, t.encode()) for k, (_, t) in enumerate(order)])
    want = sorted(((i, *brute[k]) for k, (i, _) in enumerate(order)), key=repr)
    got = sorted(map(tuple, repeats.digests(docs).collect()), key=repr)
    assert got == want and len(got) > 3900


def test_deep_shallow_sort():
    draw = np.random.default_rng(2)
    group = np.sort(draw.integers(0, 6, 400))
    rows = draw.integers(97, 99, (400, 24), dtype=np.uint8)
    rows[draw.integers(0, 400, 100)] = rows[3]
    rows[:200, :8] = 97
    for shallow in (0, 8, 24):
        order, shared = deepshallow.sort_strings(group, rows, shallow)
        keys = [(group[k], rows[k].tobytes()) for k in order]
        assert keys == sorted(keys)
        for p in range(1, 400):
            a, b = keys[p - 1], keys[p]
            same = next((x for x in range(24) if a[1][x] != b[1][x]), 24)
            assert shared[p] == (same if a[0] == b[0] else -1)


# vectors

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, node int, score double")


ODD = [(1000, None), (1001, [None, 1.0, 2.0, 3.0]), (1002, [float("nan")] * 4), (1003, [float("inf"), 1.0, 1.0, 1.0]),
       (1004, [0.0] * 4), (1005, []), (None, [1.0, 0.0, 0.0, 0.0]), (1006, [0.5, 0.5])]


def test_topk_against_brute_force(spark, monkeypatch):
    for name, size in (("SHARD_ROWS", 15), ("BLOCK_ROWS", 4), ("STRIP", 3), ("FAN", 2)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(0, 0.05, 4).astype(np.float32).tolist()) for i in range(90)] + ODD[:6]
    got = sorted(map(tuple, topk.search(vectors(spark, rows), every=20, k=7).collect()))
    whole = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v in rows[:90]] + [(1005, np.zeros(0, int))]
    want = []
    for q, x in whole:
        if q % 20 == 0:
            near = sorted((-int(x @ y), i) for i, y in whole if i != q and len(x) == len(y))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert got == sorted(want)
    assert topk.search(vectors(spark, ODD[:4])).count() == 0


def test_products_of_large_numbers_are_exact():
    a = np.array([[2 ** 40, 3]])
    assert topk.products(a, np.array([[2 ** 15, 1]])).tolist() == [[2 ** 55 + 3]]
    assert topk.products(a, np.array([[2 ** 40, 1]])).tolist() == [[topk.LONG]]


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "SHARD", 100)
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 1, (40, 16))
    rows = [c + draw.normal(0, 0.12, 16) for c in centres for _ in range(6)]
    rows += [centres[0] + draw.normal(0, 0.1, 16) for _ in range(150)] + [centres[1]] * 30
    given = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    matrix = np.array([v for _, v in given], np.float64)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    least = reachable(range(len(rows)), list(zip(*np.nonzero(near))))
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(vectors(spark, given + ODD)).collect()}
    assert len(got) == len(given) + len(ODD)
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= near.sum(1)).all() and mine.sum() >= 0.97 * near.sum()
    assert np.mean([got[i]["component_id"] == least[i] for i in range(len(rows))]) > 0.97
    for i, _ in ODD:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    nodes = stage(neighbours.nodes_of(vectors(spark, given).selectExpr("vec_id", "embedding as vector")), "nodes")
    assert neighbours.recall(nodes, neighbours.links(nodes), every=2) >= 0.9


def test_neighbours_of_nothing(spark):
    assert neighbours.near_duplicates(vectors(spark, ODD).limit(0)).count() == 0
    assert neighbours.near_duplicates(vectors(spark, ODD[:6])).count() == 6


def test_recall_does_not_fall_with_the_number_of_pivots(spark, monkeypatch):
    """Hundreds of pivots part many pairs of one search; the audit sees it, and more searches bring them together."""
    monkeypatch.setattr(neighbours, "SHARD", 40)
    draw = np.random.default_rng(6)
    rows = draw.normal(size=(8000, 32))
    for i in range(0, 1000, 2):  # planted partners of a cosine of 0.90 to 0.95
        unit = rows[i] / np.linalg.norm(rows[i])
        side = rows[i + 1] - (rows[i + 1] @ unit) * unit
        angle = np.arccos(draw.uniform(0.905, 0.95))
        rows[i + 1] = np.cos(angle) * unit + np.sin(angle) * side / np.linalg.norm(side)
    nodes = stage(spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(rows)], "node bigint, n bigint, vector array<double>"), "nodes")
    true = neighbours.degrees(nodes, 0.9)
    assert sum(true.values()) >= 1000
    once = neighbours.audited(true, stage(neighbours.links_once(nodes, 0.9, 0), "once"))
    whole = neighbours.links(nodes)
    assert once < 0.97 <= neighbours.audited(true, whole)
    pairs = {(r["a"], r["b"]) for r in whole.collect()}
    assert len(pairs & {(i, i + 1) for i in range(0, 1000, 2)}) >= 480 and whole.count() == len(pairs)


def test_rows_of_one_id_with_different_vectors(spark):
    """They are one vector of several places: each row has the links of all."""
    given = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.99, 0.01]), (9, [0.01, 0.99])]
    got = sorted(tuple(r) for r in neighbours.near_duplicates(vectors(spark, given)).collect())
    assert len(got) == 4 and [r[:2] for r in got] == [(5, 2), (5, 2), (7, 1), (9, 1)] and {r[2] for r in got} == {5}


def test_topk_of_ties_and_repeated_ids(spark, monkeypatch):
    """Equal scores in different shards go by id; all rows of the asked id are left out, others count each."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 4)
    given = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), *[(i, [1.0, 0.0]) for i in range(30, 0, -1)], (7, [1.0, 0.0])]
    got = sorted(tuple(r) for r in topk.search(vectors(spark, given), every=100, k=9).collect())
    want = sorted([*range(1, 31), 7])[:9]
    assert [g[:3] for g in got] == [(0, r, v) for r, v in enumerate(want, 1)] and len({g[3] for g in got}) == 1
    # the lesser vector of the asked id is asked
    assert got[0][3] == 32 * 64
