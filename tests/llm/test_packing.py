import itertools
import random

import pytest

from loamgraph.llm import packing as P
from loamgraph.llm.tokens import count_tokens

SCHEMA = "doc_id long, text string, size int, piece string, rank string, n_tokens string"


def fewest(sizes, capacity):
    """By trying all ways."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def packed_right(plan, sizes, capacity):
    used = sorted(itertools.chain.from_iterable(list(f) * n for f, n in plan))
    return used == sorted(sizes) and all(sum(f) <= capacity for f, _ in plan)


def test_plan_is_the_fewest():
    """Three thousand random cases against trying all ways."""
    rng = random.Random(3)
    for _ in range(3000):
        capacity = rng.choice([10, 20, 30, 50, 100])
        low = rng.choice([1, 1, capacity // 6])
        sizes = [rng.randint(max(1, low), rng.choice([capacity, capacity * 2 // 3, capacity // 2])) for _ in range(rng.randint(1, 9))]
        plan, proven = P.solve({s: sizes.count(s) for s in sizes}, capacity)
        assert proven and packed_right(plan, sizes, capacity)
        assert sum(n for _, n in plan) == fewest(sorted(sizes, reverse=True), capacity), (capacity, sizes)


@pytest.mark.parametrize("capacity,sizes,want", [(30, [3, 5, 8, 10, 10, 10, 16, 16, 19, 19], 4), (100, [51, 27, 26, 23, 23, 24, 49, 2, 2, 34, 33, 33], None), (60, [20, 20, 20, 15] * 3 + [7, 11, 13, 29, 31] * 2, None)])
def test_exact_mode_runs_to_the_proof(capacity, sizes, want):
    plan, proven = P.solve({s: sizes.count(s) for s in sizes}, capacity, nodes=None)
    assert proven and packed_right(plan, sizes, capacity)
    assert sum(n for _, n in plan) == (want or fewest(sorted(sizes, reverse=True), capacity))


def test_many_items_and_a_limit():
    rng = random.Random(4)
    hist = {s: rng.randint(1, 100_000) for s in rng.sample(range(1, 2049), 700)}
    plan, proven = P.solve(hist)
    total = {}
    for f, n in plan:
        for s in f:
            total[s] = total.get(s, 0) + n
    assert total == hist and all(sum(f) <= 2048 for f, _ in plan) and len(plan) < 20_000
    assert sum(n for _, n in plan) <= P.lower_bound(hist, 2048) * 1.01
    assert P.solve({7: 5, 5: 3, 3: 4}, 12, nodes=0)[0] and P.solve({}, 12) == ([], True)


def test_table(spark):
    rows = [(i, "word " * (i % 40), 1, "p", "r", "n") for i in range(60)] + [(60, None, 1, "", "", ""), (61, "  \n", 1, "", "", ""), (62, "many words here " * 400, 1, "", "", ""), (5, "word " * 5, 1, "", "", ""), (None, "null id", 1, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = P.pack(df, capacity=64).collect()
    per = {}
    for r in out:
        per.setdefault(r.container, []).append((r.offset, r.size))
    for spans in per.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= 64
    assert sorted(per) == list(range(len(per)))
    sizes = {}
    for r in out:
        sizes.setdefault(r.id, []).append((r.piece, r.start, r.size))
    assert sum(s for _, _, s in sizes[62]) == count_tokens("many words here " * 400) and all(s == 64 for _, _, s in sorted(sizes[62])[:-1])
    assert len(sizes[5]) == 2 and None in sizes and 60 not in sizes and 61 not in sizes
    rep = P.pack_report(P.pack(df, capacity=64), 64).first()
    assert rep.containers == len(per) and rep.containers <= rep.least_containers * 1.05 + 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.pack(df).count() == 0 and P.pack_report(P.pack(df)).first().containers == 0
