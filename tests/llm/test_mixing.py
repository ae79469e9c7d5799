import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import mixing as M
from loamgraph.llm.tokens import count_tokens

DOCS = "doc_id long, text string, source string, block long, shard string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.one_of(st.none(), st.integers(1, 4))), min_size=1, max_size=6))
def test_quotas(rows):
    total = sum(s for _, s, _ in rows)
    tokens = {str(i): t for i, (t, _, _) in enumerate(rows)}
    goals = [(str(i), s / total, c) for i, (_, s, c) in enumerate(rows)]
    q = M.quotas(tokens, goals)
    assert sum(q.values()) <= sum(tokens.values())
    for s, share, cap in goals:
        assert cap is None or q[s] <= cap * tokens[s]
    free = [s for s, share, cap in goals if tokens[s] and (cap is None or q[s] < cap * tokens[s] - 1)]
    if free:  # whoever isn't at the cap has the same ratio of size to target, and nothing is left over
        r = [q[s] / dict((g[0], g[1]) for g in goals)[s] for s in free]
        assert max(r) - min(r) <= 1 + 0.05 * max(r) + 200
        assert sum(q.values()) >= sum(tokens.values()) - len(goals)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 500), st.integers(0, 99))
def test_permutation(n, key):
    assert sorted(M.permuted(np.arange(n), n, key)) == list(range(n))


def test_shards_add_up():
    blocks = np.array([5, 0, 100, 37], np.int64)
    shards, before = 15, np.zeros(4, np.int64)
    for j in range(shards):
        counts, b = M.shard_counts(blocks, shards, 10, j)
        assert (b == before).all() and (counts >= 0).all() and counts.sum() == (10 if j < 14 else 2)
        before = before + counts
    assert (before == blocks).all()


def test_large_splits_are_exact():
    c = M._draw(np.array([3 * 10**9, 10**9 + 1], np.int64), 10**9, (1, 2, 3))
    assert c.sum() == 10**9


def test_table(spark):
    rows = [(i, f"alpha beta {i} gamma delta " * 5, "a", 1, "s", "t") for i in range(40)] + [(100 + i, "small text", "b", 1, "s", "t") for i in range(3)] + [(200, None, "a", 1, "", ""), (201, " ", "b", 1, "", ""), (202, "never used", "c", 1, "", ""), (203, "no source", None, 1, "", ""), (7, "alpha beta 7 gamma delta " * 5, "a", 1, "", ""), (300, "long " * 3000, "d", 1, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.5, None), ("b", 0.3, 2), ("gone", 0.1, 3), ("d", 0.1, 1), (None, 0.1, 1), ("a", 0.5, None)], TARGETS)
    out = M.mix(docs, targets, block=32, shard_blocks=16).cache()
    got = out.collect()
    assert {r.source for r in got} == {"a", "b", "d"}
    slots = sorted((r.shard, r.slot) for r in got)
    assert slots == [(i // 16, i % 16) for i in range(len(got))]
    sizes = {}
    for i, text, s, *_ in rows:
        sizes.setdefault(s, []).append(count_tokens(text))
    for s, cap in (("b", 2), ("d", 1), ("a", 99)):
        uses = {}
        for r in got:
            if r.source == s:
                assert r.tokens == sum(p.n for p in r.pieces) and all(x.offset + x.n == y.offset for x, y in zip(r.pieces, r.pieces[1:]))
                uses[r.block] = uses.get(r.block, 0) + 1
        assert max(uses.values()) <= cap and max(uses.values()) - min(uses.get(b, 0) for b in range(-(-sum(sizes[s]) // 32))) <= 1
    rep = {r.source: r for r in M.mix_report(out, targets).collect()}
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9 and rep["gone"].tokens == 0 and rep["b"].repeats == 2
    again = sorted((r.shard, r.slot, r.source, r.block) for r in M.mix(docs, targets, block=32, shard_blocks=16).collect())
    assert again == sorted((r.shard, r.slot, r.source, r.block) for r in got)


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    some = spark.createDataFrame([("a", 1.0, None)], TARGETS)
    assert M.mix(docs, targets).count() == 0 and M.mix(docs, some).count() == 0
    assert M.mix_report(M.mix(docs, some), some).first().reached_share == 0


def test_draws_of_any_size():
    """Totals beyond numpy's bound are drawn, not split in proportion; sums and bounds always hold."""
    for colours, n in (([5, 0, 7], 6), ([3 * 10**9, 10**9, 5], 2 * 10**9), ([10**12, 10**12, 10**6], 10**9), ([0, 0], 0), ([4, 4], 8)):
        c = np.array(colours, np.int64)
        draws = [M._draw(c, n, (1, i)) for i in range(50)]
        assert all(d.sum() == n and (d >= 0).all() and (d <= c).all() for d in draws)
        if n > 10 and n < c.sum():
            assert len({tuple(d) for d in draws}) > 20
            p = float(c[0]) / float(c.sum())
            mean, sd = n * p, (n * p * (1 - p) * (1 - n / float(c.sum()))) ** 0.5
            assert abs(np.mean([d[0] for d in draws]) - mean) < sd and 0.5 < np.std([d[0] for d in draws]) / sd < 2
    blocks = np.array([6 * 10**9, 3 * 10**9], np.int64)
    counts, before = M.shard_counts(blocks, 9 * 10**9 // 256, 256, 12_345_678)
    assert counts.sum() == 256 and before.sum() == 256 * 12_345_678


def test_repeated_targets_agree(spark):
    goals = [("a", 0.5, 4), ("a", 0.5, 2), ("a", 0.2, None), ("b", 0.5, None)]
    assert M.goals_of(goals) == {"a": (0.5, 2), "b": (0.5, None)}
    rows = spark.createDataFrame(goals, "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "source string, pass int, tokens long")
    assert sorted(tuple(r)[:3] for r in M.mix_report(empty, rows).collect()) == [("a", 0.5, 2), ("b", 0.5, None)]
