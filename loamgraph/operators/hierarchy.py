"""Parent-child links to full hierarchies, by heavy-path decomposition.

Input: links `(relation, child, parent)`, a multiset. Result of `hierarchy`: one row per relation and node with
`root`, `depth`, the heavy chain it lies on (`head`, `pos`), its subtree `size`, and `pre`, its number in a
heavy-child-first preorder of its tree, so that the descendants of a node are exactly the nodes of the same root whose
`pre` lies in `[pre + 1, pre + size - 1]`.

Plan, all in joins and aggregates whose number grows with the logarithm of the depth, never with the depth. Nodes without children,
most of all, stay out of the rounds: they count for their parents at the beginning and get their labels from them at the end.

1. cycle separation and subtree sizes: pointer doubling. After round k a node points 2^k ancestors up; those that point
   nowhere are in a tree and leave the rounds. If a round finishes no further node, the rest is on or below a cycle, because a node deeper
   than 2^(k+1) would have an ancestor at every smaller depth. The same pointers sum the sizes.
2. heavy child of each parent: the largest subtree (ties: largest key); chains by pointer jumping along heavy edges.
3. chains form a tree of depth <= log2(n); pointer jumping over it adds up depth and preorder offsets.

Names are long and every round moves them: parents are found by 16-byte keys (a hash of relation and name), nodes are then numbered,
the numbers written, and all rounds work on numbers; names come back in two joins at the end.

Defined results: rows with a null relation or end are ignored; repeated links count once; a node with several
parents keeps the smallest parent id; a node linked to itself is a cycle; nodes on or below a cycle get root '', depth -1
and null chain fields; an empty input gives an empty result; other columns are ignored.
Skew: parents with many children are only ever aggregation keys (combined map-side) or the many side of an equi-join
against one row (split by AQE); prefix sums over siblings go by hashed buckets of bounded expected size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import cut, drop_dir

MAX_ROUNDS = 64  # 2^64 is beyond any depth
SIBLINGS_PER_BUCKET = 50_000
SPAN = 1024


def _key(c: str) -> F.Column:
    return F.unhex(F.md5(F.concat("relation", F.lit("\0"), F.col(c))))


def parents(links: DataFrame) -> DataFrame:
    """(key, up, relation, id, parent): one row per node; up and parent null at a root."""
    links = links.select("relation", "child", "parent").where("relation is not null and child is not null and parent is not null")
    none = F.lit(None).cast("string")
    ends = F.array(F.struct(F.col("child").alias("id"), F.col("parent").alias("parent")), F.struct(F.col("parent").alias("id"), none.alias("parent")))  # links are read once
    return (
        links.select("relation", F.explode(ends).alias("x"))
        .groupBy("relation", F.col("x.id").alias("id"))
        .agg(F.min("x.parent").alias("parent"))
        .select(_key("id").alias("key"), _key("parent").alias("up"), "relation", "id", "parent")
    )


class _Tables:
    """The tables written on the way to one result; dropped together when it is written."""

    def __init__(self, spark) -> None:  # noqa: ANN001
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        out, path = cut(df, name)
        self.paths.append(path)
        return out

    def drop(self) -> None:
        for p in self.paths:
            drop_dir(self.spark, p)
        self.paths = []


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _sizes(nodes: DataFrame, t: _Tables) -> DataFrame:
    """(key, size) of the nodes that lie in a tree, from (key, up, size). Only nodes that still point somewhere are moved; what
    finished nodes are sent later is added up at the end."""
    parts = [nodes.where("up is null").select("key", "size")]
    open_ = nodes.where("up is not null").select("key", F.col("up").alias("anc"), "size")
    left = open_.count()
    for _ in range(MAX_ROUNDS):
        if not left:
            break
        sent = open_.groupBy(F.col("anc").alias("key")).agg(F.sum("size").alias("add"))
        over = open_.select(F.col("key").alias("anc"), F.col("anc").alias("anc2"))
        moved = open_.join(over, "anc", "left").select("key", F.col("anc2").alias("anc"), "size")
        zero = F.lit(0).cast("long")
        step = t.cut(moved.join(sent, "key", "full").select("key", "anc", (F.coalesce("size", zero) + F.coalesce("add", zero)).alias("size")), "sizes")
        parts.append(step.where("anc is null").select("key", "size"))
        open_ = step.where("anc is not null")
        before, left = left, open_.count()
        if left == before:
            break
    return _union(parts).groupBy("key").agg(F.sum("size").alias("size"))


def _jump(df: DataFrame, sums: list[str], t: _Tables) -> DataFrame:
    """Pointer jumping over (key, up): `up` null means the row is its own top. Gives `top` and the `sums` added on the way. A round
    writes only the rows that weren't at their top before."""
    own = F.col("up").isNull()
    state = t.cut(df.select("key", F.coalesce("up", "key").alias("top"), own.alias("done"), *[F.when(own, F.lit(0)).otherwise(F.col(s)).cast("long").alias(s) for s in sums]), "jump")
    done, open_ = [state.where("done")], state.where("not done")
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        over = _union([*done, open_]).select(F.col("key").alias("top"), F.col("top").alias("top2"), F.col("done").alias("done2"), *[F.col(s).alias(f"{s}2") for s in sums])
        state = t.cut(open_.join(over, "top").select("key", F.col("top2").alias("top"), F.col("done2").alias("done"), *[(F.col(s) + F.col(f"{s}2")).alias(s) for s in sums]), "jump")
        done.append(state.where("done"))
        open_ = state.where("not done")
    return _union(done).select("key", "top", *sums)


def _sibling_offsets(light: DataFrame, n: int) -> DataFrame:
    """For light children (key, up, size): the sizes of those before it under the same parent, by a two-level prefix sum, so
    that no task holds all children of one parent."""
    buckets = max(1, -(-n // SIBLINGS_PER_BUCKET))
    inside = Window.partitionBy("up", "b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    own = F.coalesce(F.sum("size").over(inside), F.lit(0))
    if buckets == 1:
        return light.select("key", own.alias("before"))
    before = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("up", "b").agg(F.sum("size").alias("bs")).select("up", "b", F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("base"))
    return light.withColumn("own", own).join(sums, ["up", "b"]).select("key", (F.col("base") + F.col("own")).alias("before"))


def hierarchy(links: DataFrame) -> DataFrame:
    """(relation, id, parent, root, depth, size, pos, pre, key, up, head); see the module's description. `key`, `up` and `head` are the
    numbers of the node, its parent and the head of its chain; they, and the order of siblings of equal size in `pre`, differ from run to run."""
    t = _Tables(links.sparkSession)
    nodes = t.cut(parents(links).withColumn("n", F.monotonically_increasing_id()), "nodes")
    number = nodes.select(F.col("key").alias("up"), F.col("n").alias("un"))
    none = F.lit(None).cast("long")
    narrow = t.cut(nodes.where("up is not null").join(number, "up").select(F.col("n").alias("key"), F.col("un").alias("up")).unionByName(nodes.where("up is null").select(F.col("n").alias("key"), none.alias("up"))), "numbers")
    inner = narrow.where("up is not null").select(F.col("up").alias("key")).distinct().withColumn("inner", F.lit(True))
    flagged = t.cut(narrow.join(inner, "key", "left").select("key", "up", (F.coalesce("inner", F.lit(False)) | F.col("up").isNull()).alias("inner")), "flagged")
    leaves = flagged.where("not inner").select("key", "up")
    one = F.lit(1).cast("long")
    below = leaves.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n"))
    inner = t.cut(flagged.where("inner").join(below, "key", "left").select("key", "up", (one + F.coalesce("n", F.lit(0))).alias("size")), "inner")
    rounds = _Tables(links.sparkSession)
    tree = t.cut(inner.select("key", "up").join(_sizes(inner, rounds), "key"), "tree")
    rounds.drop()

    kids = tree.where("up is not null").select("key", "up", "size").unionByName(leaves.select("key", "up", one.alias("size")))
    heavy = t.cut(kids.groupBy("up").agg(F.max(F.struct("size", "key")).alias("h")).select("up", F.col("h.key").alias("heavy"), F.col("h.size").alias("heavy_size")), "heavy")
    marked = tree.join(heavy.select(F.col("heavy").alias("key"), F.lit(True).alias("is_heavy")), "key", "left")
    on_chain = _jump(marked.select("key", F.when(F.col("is_heavy"), F.col("up")).alias("up"), F.lit(1).alias("pos")), ["pos"], rounds)
    chained = t.cut(tree.join(on_chain, "key").select("key", "up", "size", F.col("top").alias("head"), "pos"), "chained")
    rounds.drop()

    light = kids.join(heavy, "up").where("key <> heavy").select("key", "up", "size")
    offsets = t.cut(_sibling_offsets(light, light.count()), "offsets")
    at = chained.select(F.col("key").alias("up"), F.col("head").alias("chain"), F.col("pos").alias("ppos"))
    chains = (
        chained.where("key = head and up is not null").select("key", "up").join(at, "up").join(heavy.select("up", "heavy_size"), "up").join(offsets, "key")
        .select("key", F.col("chain").alias("up"), (F.col("ppos") + 1).alias("depth"), (F.col("ppos") + 1 + F.col("heavy_size") + F.col("before")).alias("pre"))
        .unionByName(chained.where("key = head and up is null").select("key", "up", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pre")))
    )
    tops = _jump(chains, ["depth", "pre"], rounds).select(F.col("key").alias("head"), F.col("top").alias("root_key"), F.col("depth").alias("hdepth"), F.col("pre").alias("hpre"))
    labels = t.cut(chained.join(tops, "head").select("key", "up", "root_key", (F.col("hdepth") + F.col("pos")).alias("depth"), "size", "pos", (F.col("hpre") + F.col("pos")).alias("pre"), "head"), "labels")
    rounds.drop()
    above = labels.select(F.col("key").alias("up"), "root_key", F.col("depth").alias("pdepth"), F.col("pos").alias("ppos"), F.col("pre").alias("ppre"), F.col("head").alias("phead"))
    last = F.col("key") == F.col("heavy")
    ends = (
        leaves.join(above, "up").join(heavy, "up").join(offsets, "key", "left")
        .select("key", "up", "root_key", (F.col("pdepth") + 1).alias("depth"), one.alias("size"), F.when(last, F.col("ppos") + 1).otherwise(F.lit(0)).alias("pos"), (F.col("ppre") + 1 + F.when(last, F.lit(0)).otherwise(F.col("heavy_size") + F.col("before"))).alias("pre"), F.when(last, F.col("phead")).otherwise(F.col("key")).alias("head"))
    )
    roots = labels.where("key = root_key").select("root_key").join(nodes.select(F.col("n").alias("root_key"), F.col("id").alias("root")), "root_key")
    whole = labels.unionByName(ends).join(roots, "root_key")
    named = nodes.drop("key", "up").withColumnRenamed("n", "key").join(whole, "key", "left").select("relation", "id", "parent", F.coalesce("root", F.lit("")).alias("root"), F.coalesce(F.col("depth").cast("int"), F.lit(-1)).alias("depth"), "size", F.col("pos").cast("int").alias("pos"), "pre", "key", "up", "head")
    out, _ = cut(named, "hierarchy")
    t.drop()
    return out


def paths(labels: DataFrame) -> DataFrame:
    """(relation, id, path array<string>): root first, the node last; null on or below a cycle. Each path joins the
    chain segments above the node; there are at most log2(n) of them, hence as many rounds."""
    labels, _ = cut(labels, "labels")
    tree = labels.where("depth >= 0")
    seg = tree.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("seg"))
    above = tree.select(F.col("key").alias("up"), F.col("head").alias("chain"), F.col("pos").alias("ppos"))
    heads = tree.where("key = head").select("head", "up")
    chains, _ = cut(heads.join(above, "up", "left").join(seg, "head").select("head", "chain", "ppos", "seg"), "chains")
    empty = F.array().cast("array<string>")
    level, _ = cut(chains.where("chain is null").select("head", "seg", empty.alias("prefix")), "level")
    whole = level
    for _ in range(MAX_ROUNDS):
        over = level.select(F.col("head").alias("chain"), F.col("prefix").alias("p"), F.col("seg").alias("s"))
        level, _ = cut(chains.where("chain is not null").join(over, "chain").select("head", "seg", F.concat("p", F.slice("s", F.lit(1), F.col("ppos") + 1)).alias("prefix")), "level")
        if level.isEmpty():
            break
        whole = whole.unionByName(level)
    return labels.select("relation", "id", "head", "pos").join(whole, "head", "left").select("relation", "id", F.when(F.col("pos").isNotNull(), F.concat("prefix", F.slice("seg", F.lit(1), F.col("pos") + 1))).alias("path"))


def descendants(labels: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(relation, id, descendant) of all nodes, or of the (relation, id) rows of `of`. The descendants of a node are an interval of
    preorder numbers of its tree. Intervals are cut into spans of at most `SPAN` numbers, each number of a span meets the one node
    that has it by an equi-join: what is moved has the size of the result, and no key is hot, as a number has one node."""
    tree = labels.where("depth >= 0").select("relation", "id", "root", "pre", "size")
    wanted = tree if of is None else tree.join(of.select("relation", "id").distinct(), ["relation", "id"])
    last = F.col("pre") + F.col("size") - 1
    spans = wanted.where("size > 1").select("relation", "id", "root", last.alias("last"), F.explode(F.sequence(F.col("pre") + 1, last, F.lit(SPAN).cast("long"))).alias("first"))
    spans = spans.repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relation", "id", "first")  # a large tree's spans to many tasks
    numbers = spans.select("relation", "id", "root", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + SPAN - 1, F.col("last")))).alias("pre"))
    return numbers.join(tree.select("relation", "root", "pre", F.col("id").alias("descendant")), ["relation", "root", "pre"]).select("relation", "id", "descendant")


def dropped_links(links: DataFrame) -> DataFrame:
    """(relation, child, parent, kept): the links that a hierarchy of single parents leaves out, each once, with the parent that
    was kept instead."""
    once = links.select("relation", "child", "parent").where("relation is not null and child is not null and parent is not null").distinct()
    kept = once.groupBy("relation", "child").agg(F.min("parent").alias("kept"))
    return once.join(kept, ["relation", "child"]).where("parent <> kept").select("relation", "child", "parent", "kept")


def edge_links(edges: DataFrame) -> DataFrame:
    """The contains and inherits links of an edge table: resolved is not false, neither end null."""
    c = F.col("relation") == "contains"
    return (
        edges.where(F.col("relation").isin("contains", "inherits") & F.coalesce("resolved", F.lit(True)) & F.col("source").isNotNull() & F.col("target").isNotNull())
        .select("relation", F.when(c, F.col("target")).otherwise(F.col("source")).alias("child"), F.when(c, F.col("source")).otherwise(F.col("target")).alias("parent"))
    )
