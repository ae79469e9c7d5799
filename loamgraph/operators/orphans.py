"""References to records that do not exist, from signed counts per key that change deltas maintain.

Every `nodes` row is two deltas of its key's existence, +1 at `indexed_at` and -1 at `removed_at`; every end of an edge
is a delta of its key's references. The state of a key is what its deltas add up to: references, existence, the time of its
first reference and of its first beginning, and how often it ended. All of these merge by sums and minima (`merge`), so deltas may come in any
batches and in any order. Keys with positive references and no existence are the current orphans (`current`).

Which single references were orphans when they were made (`orphans`) is read from the state as well: a key that began
before its first reference and never ended has none, and its references are dropped by the join with the state. The others are
judged by the sum of their key's existence deltas up to the reference.
Keys travel as a 128-bit hash, so that a reference costs 16 bytes, however long the ids are. A key with at most
`FEW` deltas carries them as one short array, and its references find them by one join (the side with the references is
split by AQE where a key is hot). A key with more has its sums taken in two levels, whole periods before and the instants
inside the period, in groups of (key, period), with rows combined per (key, instant) before they are shuffled.

Defined results: rows of `nodes` with a null id or indexed_at assert nothing; a row whose `removed_at` is not after its
`indexed_at` never exists; an edge with `resolved` false is no reference; an end that is null is none; an edge without
`indexed_at` can't be placed in time and is left out; an edge delivered twice counts once; keys are compared exactly
(case, spaces); empty tables give an empty result or, without nodes, every reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import cut, drop_dir

PERIOD_DAYS = 7
FEW = 64
KEY = ["k1", "k2"]


def _key(c: str) -> list:
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(1), c).alias("k2")]


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, relation, ts, side, id): one row per non-null end of an edge that isn't unresolved."""
    return (
        edges.where(F.coalesce("resolved", F.lit(True)) & F.col("indexed_at").isNotNull())
        .select("edge_id", "relation", F.col("indexed_at").alias("ts"), F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target").alias("id")))).alias("x"))
        .select("edge_id", "relation", "ts", "x.side", "x.id")
        .where("id is not null")
    )


def deltas(nodes: DataFrame) -> DataFrame:
    """(k1, k2, ts, d): +1 where a record begins to exist, -1 where it ends."""
    ok = nodes.where("id is not null and indexed_at is not null and (removed_at is null or removed_at > indexed_at)")
    both = F.array(F.struct(F.col("indexed_at").alias("ts"), F.lit(1).cast("long").alias("d")), F.struct(F.col("removed_at").alias("ts"), F.lit(-1).cast("long").alias("d")))
    return ok.select(*_key("id"), F.explode(both).alias("x")).select(*KEY, "x.ts", "x.d").where("ts is not null")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """States of single references (k1, k2, ts); sign -1 takes them back."""
    none = F.lit(None).cast("timestamp_ntz")
    return refs.select(*KEY, F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"), F.col("ts").cast("timestamp_ntz").alias("first_ref"), none.alias("born"), F.lit(0).cast("long").alias("ended"))


def existence_deltas(changes: DataFrame) -> DataFrame:
    """States of single changes (k1, k2, ts, d)."""
    none, up = F.lit(None).cast("timestamp_ntz"), F.col("d") > 0
    return changes.select(*KEY, F.lit(0).cast("long").alias("refs"), F.col("d").alias("exists"), none.alias("first_ref"), F.when(up, F.col("ts").cast("timestamp_ntz")).alias("born"), (~up).cast("long").alias("ended"))


def merge(*states: DataFrame) -> DataFrame:
    """(k1, k2, refs, exists, first_ref, born, ended): one row per key from any number of states, deltas among them."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.min("first_ref").alias("first_ref"), F.min("born").alias("born"), F.sum("ended").alias("ended"))


def current(keys: DataFrame) -> DataFrame:
    """(k1, k2, refs): keys with positive references and no existence."""
    return keys.where("refs > 0 and exists <= 0").select(*KEY, "refs")


@dataclass(frozen=True)
class State:
    """What is maintained: a row per key, and the references counted so far (edge_id, side, k1, k2, ts), so that an edge that
    is delivered again in a later batch isn't counted again."""

    keys: DataFrame
    seen: DataFrame
    folders: tuple[str, ...] = ()

    def apply(self, edges: DataFrame, nodes: DataFrame) -> State:
        """The state after a batch of edges and nodes, written to the shared folder; this state's own tables are removed."""
        refs = _hashed(edges).dropDuplicates(["edge_id", "side"]).join(self.seen.select("edge_id", "side"), ["edge_id", "side"], "left_anti").select("edge_id", "side", *KEY, "ts")
        new, new_dir = cut(refs, "refs")
        keys, keys_dir = cut(merge(self.keys, reference_deltas(new), existence_deltas(deltas(nodes))), "keys")
        seen, seen_dir = cut(self.seen.unionByName(new), "seen")
        for f in (*self.folders, new_dir):
            drop_dir(edges.sparkSession, f)
        return State(keys, seen, (keys_dir, seen_dir))


def no_state(spark) -> State:  # noqa: ANN001
    return State(spark.createDataFrame([], "k1 long, k2 long, refs long, exists long, first_ref timestamp_ntz, born timestamp_ntz, ended long"), spark.createDataFrame([], "edge_id long, side string, k1 long, k2 long, ts timestamp_ntz"))


def current_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, refs): the keys that are referred to now and don't exist now, with the number of their references."""
    refs = references(edges).select("edge_id", "side", "id", "ts").dropDuplicates(["edge_id", "side"]).select("id", *_key("id"), "ts")
    found = current(merge(reference_deltas(refs), existence_deltas(deltas(nodes))))
    return found.join(refs.groupBy(*KEY).agg(F.min("id").alias("id")), KEY).select("id", "refs")


def _hashed(edges: DataFrame) -> DataFrame:
    return references(edges).select("edge_id", "relation", "ts", "side", *_key("id"))


def _few(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Orphans among references whose keys have few deltas, or none."""
    own = changes.groupBy(*KEY).agg(F.collect_list(F.struct("ts", "d")).alias("x"))
    past = F.filter("x", lambda c: c["ts"] <= F.col("ts"))
    count = F.aggregate(past, F.lit(0).cast("long"), lambda a, c: a + c["d"])
    return refs.join(own, KEY, "left").where(F.col("x").isNull() | (count <= 0)).withColumn("known", F.coalesce(F.size(past) > 0, F.lit(False))).drop("x")


def _many(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """The same for keys with many deltas."""
    period = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")) / PERIOD_DAYS).cast("int")
    zero = F.lit(0).cast("long")
    at = (
        refs.select(*KEY, "ts", zero.alias("d"), zero.alias("up"), F.lit(1).alias("r"))
        .unionByName(changes.select(*KEY, "ts", "d", F.greatest("d", zero).alias("up"), F.lit(0).alias("r")))
        .groupBy(*KEY, "ts", period.alias("period"))
        .agg(F.sum("d").alias("d"), F.sum("up").alias("up"), F.max("r").alias("r"))
    )
    w = Window.partitionBy(*KEY).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        at.groupBy(*KEY, "period").agg(F.sum("d").alias("d"), F.sum("up").alias("up"))
        .select(*KEY, "period", F.coalesce(F.sum("d").over(w), zero).alias("base"), F.coalesce(F.sum("up").over(w), zero).alias("ever"))
    )
    inside = Window.partitionBy(*KEY, "period").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = at.select(*KEY, "period", "ts", "r", F.sum("d").over(inside).alias("d"), F.sum("up").over(inside).alias("up")).where("r = 1")
    found = counted.join(base, [*KEY, "period"]).where("d + base <= 0").select(*KEY, "ts", (F.col("up") + F.col("ever") > 0).alias("known"))
    return refs.join(found, [*KEY, "ts"])


def orphans(edges: DataFrame, nodes: DataFrame, few: int = FEW) -> DataFrame:
    """(edge_id, side, relation, ts, state): each orphan reference once; state removed (existed before) or missing
    (never seen, or only later)."""
    changes = deltas(nodes)
    keys = merge(reference_deltas(_hashed(edges)), existence_deltas(changes))
    suspect, _ = cut(keys.where("refs > 0 and (born is null or born > first_ref or ended > 0)").select(*KEY), "suspects")
    refs = _hashed(edges).join(suspect, KEY, "left_semi")
    changes = changes.join(suspect, KEY, "left_semi")
    busy = changes.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > few).select(*KEY)
    if busy.isEmpty():
        found = _few(refs, changes)
    else:
        cols = ["edge_id", "relation", "ts", "side", *KEY, "known"]
        found = _few(refs.join(busy, KEY, "left_anti"), changes.join(busy, KEY, "left_anti")).select(cols).unionByName(_many(refs.join(busy, KEY, "left_semi"), changes.join(busy, KEY, "left_semi")).select(cols))
    return found.dropDuplicates(["edge_id", "side"]).select("edge_id", "side", "relation", "ts", F.when(F.col("known"), "removed").otherwise("missing").alias("state"))


def orphan_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per relation, side and month: references, orphans by state, and the share of orphans."""
    month = F.date_format("ts", "yyyy-MM")
    refs = references(edges).dropDuplicates(["edge_id", "side"]).groupBy("relation", "side", month.alias("month")).agg(F.count("*").alias("refs"))
    bad = orphans(edges, nodes).groupBy("relation", "side", month.alias("month")).agg(F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "removed").alias("removed"))
    zero = F.lit(0).cast("long")
    out = refs.join(bad, ["relation", "side", "month"], "left").select("relation", "side", "month", "refs", F.coalesce("missing", zero).alias("missing"), F.coalesce("removed", zero).alias("removed"))
    return out.withColumn("orphan_share", (F.col("missing") + F.col("removed")) / F.col("refs"))
