import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loamgraph.operators import hierarchy as H

SCHEMA = "relation string, child string, parent string, root string, depth int, size int"


def links(spark, rows):
    return spark.createDataFrame([(*r, "junk", -7, 9) for r in rows], SCHEMA)  # columns whose names clash with the result's


def brute(rows):
    par = {}
    for r, c, p in rows:
        if None not in (r, c, p):
            par[r, c] = min(x for x in (p, par.get((r, c))) if x is not None)
            par.setdefault((r, p), None)
    out = {}
    for (r, x) in par:
        path, y = [x], par[r, x]
        while y is not None and y not in path:
            path.append(y)
            y = par[r, y]
        out[r, x] = ("", -1, None) if y is not None else (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, rows):
    labels = H.hierarchy(links(spark, rows)).cache()
    got = {(r.relation, r.id): (r.root, r.depth) for r in labels.collect()}
    want = brute(rows)
    assert got == {k: v[:2] for k, v in want.items()}
    paths = {(r.relation, r.id): r.path for r in H.paths(labels).collect()}
    assert paths == {k: v[2] for k, v in want.items()}
    tree = [r for r in labels.collect() if r.depth >= 0]
    for a in tree:
        below = {b.id for b in tree if b.relation == a.relation and b.root == a.root and a.pre < b.pre < a.pre + a.size}
        assert below == {x for (r, x), v in want.items() if r == a.relation and v[2] and a.id in v[2][:-1]}, a
    labels.unpersist()


def test_trees_cycles_and_dirt(spark):
    rows = [("c", "b", "a"), ("c", "c", "b"), ("c", "c", "b"), ("c", "d", "b"), ("c", "e", "a"), ("i", "x", "y"), ("i", "y", "x"), ("i", "z", "y"), ("i", "w", "z"), ("i", "s", "s"), ("c", None, "a"), ("c", "q", None), (None, "a", "b"), ("c", "m", "p2"), ("c", "m", "p1")]
    check(spark, rows)


def test_deep_chain_and_star(spark):
    check(spark, [("c", f"n{i:03}", f"n{i - 1:03}") for i in range(1, 70)] + [("c", f"k{i}", "n005") for i in range(40)])


def test_empty(spark):
    labels = H.hierarchy(spark.createDataFrame([], SCHEMA))
    assert labels.count() == 0 and H.paths(labels).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6))
def test_random(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(25)]
    check(spark, [(rng.choice("ci"), rng.choice(names), rng.choice(names)) for _ in range(22)])


def test_descendants(spark):
    labels = H.hierarchy(links(spark, [("c", "b", "a"), ("c", "c", "b")]))
    of = spark.createDataFrame([("c", "a"), ("c", "a")], "relation string, id string")
    assert sorted(r.descendant for r in H.descendants(labels, of).collect()) == ["b", "c"]


def test_no_bucket_holds_all_siblings(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS_PER_BUCKET", 5)
    check(spark, [("c", f"k{i}", "hub") for i in range(23)])


@pytest.mark.parametrize("resolved,kept", [(True, 1), (None, 1), (False, 0)])
def test_edge_links(spark, resolved, kept):
    e = spark.createDataFrame([("contains", "p", "c", resolved)], "relation string, source string, target string, resolved boolean")
    assert H.edge_links(e).count() == kept


def test_all_descendants_and_dropped_links(spark, monkeypatch):
    monkeypatch.setattr(H, "SPAN", 3)
    rows = [("c", f"k{i}", "hub") for i in range(8)] + [("c", f"m{i}", "k3") for i in range(5)] + [("c", "m1", "zz"), ("c", "m1", "zz"), ("i", "x", "y"), ("i", "y", "x")]
    labels = H.hierarchy(links(spark, rows))
    want = {(r, a, x) for (r, x), v in brute(rows).items() if v[2] for a in v[2][:-1]}
    got = [tuple(r) for r in H.descendants(labels).collect()]
    assert len(got) == len(want) and set(got) == want
    assert [tuple(r) for r in H.dropped_links(links(spark, rows)).collect()] == [("c", "m1", "zz", "k3")]
