import numpy as np
import pytest

from loamgraph.llm import neighbours as N

SCHEMA = "id string, v array<float>, h long, leaf int, key string, own boolean"


def brute(rows, k):
    seen, ids, vs = set(), [], []
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not np.isfinite(x) for x in v) or not any(v) or i in seen:
            continue
        seen.add(i)
        ids.append(i)
        vs.append(v)
    if not ids:
        return {}
    u = N._unit(np.array(vs, np.float32))
    c = np.round(u @ u.T, 10)
    return {i: [ids[j] for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-c[n, j], ids[j]))[:k]] for n, i in enumerate(ids)}


def run(spark, rows, **o):
    df = spark.createDataFrame([(i, v, 1, 2, "x", True) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(N.neighbours(df, "id", "v", k=3, dim=8, **o).collect(), key=lambda r: r.rank):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_exact_in_one_leaf(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{i:03}", [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(f"s{i}", [2 * x for x in rows[i][1]]) for i in range(5)]  # the same direction, another length
    rows += [("d1", rows[0][1]), ("d2", rows[0][1]), rows[3], (None, rows[1][1]), ("n", None), ("z", [0.0] * 8), ("short", [1.0]), ("nan", [float("nan")] * 8), ("null", [None] + [1.0] * 7), ("inf", [float("inf")] + [1.0] * 7)]
    assert run(spark, rows) == brute(rows, 3)


def test_crowd_of_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i:03}", [1.0] + [0.0] * 7) for i in range(40)] + [(f"p{i}", [float(x) for x in rng.standard_normal(8)]) for i in range(20)] + [("a", [3.0] + [0.0] * 7)]
    assert run(spark, rows) == brute(rows, 3)


def test_recall_of_the_forest(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8))
    rows = [(f"p{i:04}", [float(x) for x in centres[i % 40] + 0.15 * rng.standard_normal(8)]) for i in range(2000)]
    got, want = run(spark, rows, leaf_rows=200), brute(rows, 3)
    assert set(got) == set(want)
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) / sum(map(len, want.values())) > 0.9


def test_oversized_leaf_is_split():
    rng = np.random.default_rng(3)
    unit, every = N._unit(rng.standard_normal((2000, 8)).astype(np.float32)), np.arange(2000)
    order = np.append(every, 2000)
    best, cos = N.search_leaf(unit, order, every, every, 3, 100, 8, 0.5)
    assert (best >= 0).all() and (best != every[:, None]).all() and (np.diff(cos, axis=1) <= 0).all()
    exact, _ = N.search_leaf(unit, order, every, every, 3, 2000, 8, 0.5)
    assert np.mean([len(set(a) & set(b)) / 3 for a, b in zip(best, exact)]) > 0.9
    few, _ = N.search_leaf(unit, order, every[:7], every[:2], 3, 100, 8, 0.5)
    assert few[:3].tolist() == [[1, -1, -1], [0, -1, -1], sorted([0, 1], key=lambda j: -unit[2] @ unit[j]) + [-1]]


def test_route_of_empty_batch():
    f = N.Forest(np.random.default_rng(0).standard_normal((100, 8)).astype(np.float32), 4, 2, 1)
    assert [len(x) for x in f.route(np.zeros((0, 8), np.float32), 1, 0.1)] == [0, 0, 0]


@pytest.mark.parametrize("rows", [[], [("a", [1.0] * 8)], [("a", None)]])
def test_small(spark, rows):
    assert run(spark, rows) == {}


def test_pairs(spark):
    df = spark.createDataFrame([(i, v, 1, 2, "x", True) for i, v in [("b", [1.0] * 8), ("a", [2.0] * 8)]], SCHEMA)
    assert [tuple(r) for r in N.neighbour_pairs(df, "id", "v", dim=8).collect()] == [("a", "b")]


def test_queue_gives_out_several_leaves():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = N.Forest(x, 64, 2, 1)
    rows, leaves, own = f.route(x[:200], 14, 9.0)
    asked = [set(leaves[rows == i]) for i in range(200)]
    assert [len(s) for s in asked] == list(np.bincount(rows, minlength=200)) and min(map(len, asked)) == max(map(len, asked)) == 16  # no leaf twice
    near, places, _ = f.route(x[:200], 14, 9.0, 8, 1)
    assert all({*places[near == i]} <= asked[i] for i in range(200))
    groups = [{(p // 2 // 8, p % 2) for p in places[near == i]} for i in range(200)]
    assert max(map(len, groups)) == 3 and np.mean([len(places[near == i]) for i in range(200)]) > 4
    assert all((leaves[(rows == i) & own] % 2).tolist() == [0, 1] for i in range(200))
    every = f.route(x[:3], 2 * 64, 9.0)
    assert all(len(set(every[1][every[0] == i])) == 128 for i in range(3))


def test_recall_between_many_borders(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8)) * 0.5 + rng.standard_normal((30, 8)).repeat(100, 0)
    rows = [(f"p{i:04}", [float(y) for y in r]) for i, r in enumerate(x)]
    got, want = run(spark, rows, leaf_rows=50), brute(rows, 3)
    found = sum(len(set(got[i]) & set(w)) for i, w in want.items()) / 9000
    assert found > 0.9, found


def test_one_direction_with_many_lengths(spark):
    rng = np.random.default_rng(6)
    turn = rng.permutation(120)
    one = rng.integers(1, 9, 8)  # multiples of it are exact in single precision
    rows = [(f"c{turn[i]:03}", [float(x) for x in one * (i + 1)]) for i in range(120)]
    other = rng.standard_normal(8)  # multiples of this one are not
    rows += [(f"e{turn[i]:03}", [float(np.float32(x * 1.37**(i % 60 - 30))) for x in other]) for i in range(120)]
    rows += [(f"p{i}", [float(x) for x in rng.standard_normal(8)]) for i in range(30)]
    assert run(spark, rows) == brute(rows, 3)


def test_ties_beyond_the_preselection():
    rng = np.random.default_rng(7)
    v = np.concatenate([np.outer(rng.uniform(0.1, 9, 300), rng.integers(1, 9, 64)), rng.standard_normal((200, 64))]).astype(np.float32)
    ids = [f"{i:03}" for i in rng.permutation(500)]
    u = N._unit(v)
    best, _ = N.search_leaf(u, np.append(N._order(ids), 500), np.arange(500), np.arange(500), 5, 1000, 1, 0.1)
    c = np.round(u @ u.T, 10)
    for i in range(500):
        assert [ids[j] for j in best[i]] == [ids[j] for j in sorted((j for j in range(500) if j != i), key=lambda j: (-c[i, j], ids[j]))[:5]], i


def test_one_direction_makes_no_quadratic_leaf(spark, monkeypatch):
    asked, topk = [], N._topk
    monkeypatch.setattr(N, "_topk", lambda q, p, qi, pi, order, k: asked.append(len(qi)) or topk(q, p, qi, pi, order, k))
    n = 300
    unit = N._unit(np.outer(np.arange(1, n + 1), np.ones(8)).astype(np.float32))
    best, _ = N.search_leaf(unit, np.arange(n + 1), np.arange(4), np.arange(n), 3, 20, 8, 0.1)
    assert asked == [4] and best[3].tolist() == [0, 1, 2]


def test_keys_are_made_again_when_two_ids_share_one(spark, monkeypatch):
    """With keys of one bit ids share keys under every seed: no result instead of a wrong one. With more the next seed serves."""
    hash_ = N.F.xxhash64
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: hash_(*c) if isinstance(c[0], str) and c[0] == "v" else N.F.pmod(hash_(*c), N.F.lit(2)))
    rows = [(f"p{i}", [1.0 + i] * 7 + [1.0]) for i in range(9)]
    with pytest.raises(RuntimeError):
        run(spark, rows)
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: N.F.lit(5).cast("long") if len(c) == 1 and isinstance(c[0], str) and c[0] == "id" else hash_(*c))
    assert run(spark, rows) == brute(rows, 3)
