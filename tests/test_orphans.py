import datetime as dt
import random

import pytest

from loamgraph.operators import orphans as O

EDGES = "edge_id long, source string, target string, relation string, resolved boolean, indexed_at timestamp_ntz, id string, ts string, k1 string"
NODES = "id string, indexed_at timestamp_ntz, removed_at timestamp_ntz, d int, x string"
T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def tables(spark, edges, nodes):
    return (
        spark.createDataFrame([(i, s, t, rel, res, day(at), "x", "y", "z") for i, s, t, rel, res, at in edges], EDGES),
        spark.createDataFrame([(i, day(a), day(b), 5, "x") for i, a, b in nodes], NODES),
    )


def brute(edges, nodes):
    out = set()
    for i, s, t, _, res, at in edges:
        if res is False or at is None:
            continue
        for side, x in (("source", s), ("target", t)):
            if x is not None and not any(n == x and a is not None and a <= at and (b is None or b > at) for n, a, b in nodes):
                out.add((i, side))
    return out


@pytest.mark.parametrize("few", [0, 1, 64])
def test_against_brute_force(spark, few):
    rng = random.Random(few)
    ids = [*"abcdef", " a", "A", None]
    nodes = [(rng.choice(ids), rng.choice([0, 100, 400, 900, None]), rng.choice([None, None, 150, 500, 1000, 50])) for _ in range(25)]
    edges = [(i % 70, rng.choice(ids), rng.choice([*ids, "zz"]), rng.choice(["calls", "contains"]), rng.choice([True, None, False]), rng.choice([None, 10, 120, 450, 800, 2000])) for i in range(70)]
    edges += edges[:9]
    e, n = tables(spark, edges, nodes)
    rows = O.orphans(e, n, few).collect()
    got = {(r.edge_id, r.side) for r in rows}
    assert got == brute(edges, nodes) and len(rows) == len(got)
    total = O.orphan_report(e, n).groupBy().sum("missing", "removed").first()
    assert total[0] + total[1] == len(got)


def test_state(spark):
    e, n = tables(spark, [(1, "gone", "later", "calls", True, 100)], [("gone", 0, 50), ("later", 200, None)])
    assert {(r.side, r.state) for r in O.orphans(e, n).collect()} == {("source", "removed"), ("target", "missing")}


def test_empty(spark):
    e, n = tables(spark, [], [])
    assert O.orphans(e, n).count() == 0 and O.orphan_report(e, n).count() == 0
    e, _ = tables(spark, [(1, "a", None, "calls", None, 5)], [])
    assert [(r.edge_id, r.side) for r in O.orphans(e, n).collect()] == [(1, "source")]


def test_plan_has_no_cross_join(spark, small):
    from loamgraph.session import table

    plan = O.orphans(table(spark, small, "edges"), table(spark, small, "nodes"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_state_in_any_batches(spark):
    """Deltas in one batch, in many, and in another order give the same state and the same current orphans."""
    rng = random.Random(5)
    nodes = [(rng.choice("abcdef"), rng.choice([0, 100, 400]), rng.choice([None, 150, 500])) for _ in range(12)]
    edges = [(i, rng.choice("abcdez"), rng.choice("abyz"), "calls", True, rng.choice([10, 120, 450])) for i in range(20)]
    edges += edges[:5]  # delivered again, in a later batch too

    def after(batches):
        state = O.no_state(spark)
        for e, n in batches:
            state = state.apply(*tables(spark, e, n))
        return sorted(map(tuple, state.keys.collect()), key=str), sorted(map(tuple, O.current(state.keys).collect()))

    once = after([(edges, nodes)])
    assert once == after([(edges[:9], nodes[:3]), (edges[9:], nodes[3:])]) == after([([], nodes[6:]), (edges[12:], []), (edges[:12], nodes[:6])])
    alive = {i for i, _, _ in nodes if sum(a is not None and (b is None or b > a) for x, a, b in nodes if x == i) > sum(b is not None and b > a for x, a, b in nodes if x == i)}
    want = {}
    for e in {e[0]: e for e in edges}.values():
        for x in e[1:3]:
            if x not in alive:
                want[x] = want.get(x, 0) + 1
    assert {r.id: r.refs for r in O.current_orphans(*tables(spark, edges, nodes)).collect()} == want and sorted(want.values()) == sorted(r[2] for r in once[1])


def test_references_taken_back(spark):
    refs = spark.createDataFrame([(1, 2, day(5))], "k1 long, k2 long, ts timestamp_ntz")
    assert O.current(O.merge(O.reference_deltas(refs))).count() == 1 and O.current(O.merge(O.reference_deltas(refs), O.reference_deltas(refs, -1))).count() == 0
