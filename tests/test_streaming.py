import datetime as dt

from loamgraph.operators import orphans as O
from loamgraph.operators import vector as V
from loamgraph.sources.store import VectorStore
from loamgraph.streaming import reindex as S

CHANGES = "edge_id long, source string, target string, relation string, resolved boolean, id string, indexed_at timestamp_ntz, removed_at timestamp_ntz"
T = dt.datetime(2024, 1, 1)


def edge(i, s, t):
    return (i, s, t, "calls", True, None, T, None)


def node(i, gone=None):
    return (None, None, None, None, None, i, T, gone)


def test_orphans_over_batches(spark, tmp_path):
    """Batches that come one after the other give the counts of all at once; a batch that is run again changes nothing."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    batches = [[edge(1, "a", "b"), edge(2, "a", "c"), node("a")], [edge(1, "a", "b"), node("b"), edge(3, "b", "c")], [node("c"), node("a", dt.datetime(2025, 1, 1)), edge(4, "z", None)]]
    for rows in batches:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(src)
        S.orphans_stream(spark.readStream.schema(CHANGES).parquet(src), out, cp).awaitTermination(120)
    got = S.orphan_state(spark, out)
    df = spark.createDataFrame([r for b in batches for r in b], CHANGES)
    once = O.no_state(spark).apply(df.where("edge_id is not null"), df.where("id is not null"))
    assert sorted(map(tuple, got.keys.collect()), key=str) == sorted(map(tuple, once.keys.collect()), key=str)
    assert [r.refs for r in O.current(got.keys).collect()] == [1] and got.seen.count() == 7  # z
    assert S._versions(spark, out) == [1, 2] and S.orphan_state(spark, out, 2).seen.count() == 6
    S.orphans_stream(spark.readStream.schema(CHANGES).parquet(src), out, cp).awaitTermination(120)
    assert S._versions(spark, out) == [1, 2]
    assert S.orphan_state(spark, str(tmp_path / "none")).keys.count() == 0


def test_vectors_over_batches(spark, tmp_path):
    schema = "chunk_id long, text string, file_path string, chunk_type string, symbol_name string"
    store = VectorStore(spark, str(tmp_path / "v"))
    store.create(V.DIM)
    for rows in ([(1, "alpha beta", "f", "class", "A"), (None, "x", "f", "class", "B")], [(1, "gamma", "f", "class", "A"), (2, None, "f", "class", "B")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        S.vectors_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.point_id: r.text for r in store.read().collect()} == {"1": "gamma", "2": None}
    assert store.search(list(V.hash_model(["gamma"])[0]), 1).first()["point_id"] == "1"
