"""The k most similar vectors for every vector: a forest of random-projection trees.

1. Fit: a bounded sample of the usable vectors (`sample_rows`) grows `trees` trees; each split is the hyperplane between
   two random points, moved by a few steps of 2-means, cut at the sample's median. The depth follows the number of rows, so a leaf holds at most
   about `leaf_rows` of them, a few hundred. The trees are a few MB at most (sample_rows bounds them) and are sent to the tasks.
2. Route: every vector is stored in its own leaf of each tree. The leaves that it asks as well are those
   that a queue shared by all trees gives out first: the branches not taken, the one with the smallest margin first, `probes` of them.
   `block_leaves` neighbouring leaves of a tree are one group, which is one task, so that a vector moves once however many of
   them it asks; it goes to at most `away` groups beyond its own.
3. Search: in each leaf a block of exact cosines in single precision preselects, double precision reranks. A leaf that holds several times
   `leaf_rows`, as the sample allows no deeper trees, is a forest of its own: it is grown from its own rows and searched through a queue in the same way.
4. Merge: the lists of one vector from several leaves give its k best.

Every row is indexed and every row gets its neighbours. Copies: rows whose directions agree to 6 decimals have a cosine of
1 with each other, so of more than k + 1 such rows only the k + 1 smallest ids are searched for; the others have the same
neighbours as the last of those and get them by a join. Of more than k + 1 rows with exactly one direction, whatever
their lengths, only the k + 1 smallest ids are stored, as no list has room for more. So a direction that a third of all rows
share never makes a quadratic leaf.

Ids move as 64-bit keys. Whether two ids share a key is tested for all of them; if so, the keys are made again with
another seed.

Defined results: null vectors, vectors of another length than `dim`, with null, NaN or infinite entries or of norm 0
take no part, nor do null ids; a repeated id counts once (its smallest vector hash); order is by cosine rounded to 10
decimals, equal ones by smaller id; fewer than k other points give fewer rows; an empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
DIM = 64
TREES = 2
PROBES = 32
PROBE_MARGIN = 0.12
AWAY = 2
LEAF_ROWS = 600
BLOCK_LEAVES = 128
SAMPLE_ROWS = 131_072
MIN_SAMPLE_PER_LEAF = 8
MOST_SALTS = 64  # two ids of a billion share a key in one of 37 tries


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vec_col)
    big = F.lit(float("inf")).cast("float")
    return (
        df.select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("v"))
        .where(F.col("id").isNotNull() & (F.size("v") == dim))
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big)) & F.exists("v", lambda x: x != 0))
    )


class Forest:
    """Trees as arrays: node i has the plane `w[i]`, `b[i]` and the children 2i + 1 and 2i + 2; all trees have one depth."""

    def __init__(self, sample: np.ndarray, leaves: int, trees: int, seed: int) -> None:
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        rng = np.random.default_rng(seed)
        inner, dim = 2**self.depth - 1, sample.shape[1]
        self.w = np.zeros((trees, inner, dim), np.float32)
        self.b = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for i in range(inner):
                own = rows.pop(i)
                w, b = split(sample[own], rng)
                self.w[t, i], self.b[t, i] = w, b
                right = sample[own] @ w > b
                rows[2 * i + 1], rows[2 * i + 2] = own[~right], own[right]

    def descend(self, x: np.ndarray, tree: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves reached from `node`; for each level the margin and the branch not taken (infinite above `node`)."""
        inner, node = len(self.w[0]), node.copy()
        margins, others = np.full((len(x), self.depth), np.inf, np.float32), np.zeros((len(x), self.depth), np.int64)
        for level in range(self.depth):
            at = np.nonzero((node < inner) & (node < 2 ** (level + 1) - 1))[0]
            own, t = node[at], tree[at]
            m = np.einsum("ij,ij->i", x[at], self.w[t, own]) - self.b[t, own]
            right = m > 0
            margins[at, level], others[at, level] = np.abs(m), 2 * own + 2 - right
            node[at] = 2 * own + 1 + right
        return node, margins, others

    def route(self, x: np.ndarray, probes: int, margin: float, block: int = 1, away: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own): `own` marks the leaves that store the row, the others are only asked. The queue of a row
        holds the branches not taken in any tree; the one with the smallest margin comes out, and the branches not taken
        below it go in, none before the branch that led there. `block` neighbouring leaves of a tree lie together; a leaf that comes out counts as a
        probe, but is asked only while it lies with one asked before, or is in one of the first `away` further blocks."""
        n, trees, inner = len(x), len(self.w), 2**self.depth - 1
        rows, leaves, own, margins, others, met = [], [], [], [], [], []
        for t in range(trees):
            leaf, m, o = self.descend(x, np.full(n, t), np.zeros(n, np.int64))
            rows.append(np.arange(n))
            leaves.append((leaf - inner) * trees + t)
            own.append(np.ones(n, bool))
            margins.append(m)
            others.append(o * trees + t)
            met.append((leaf - inner) // block * trees + t)
        if self.depth and n:
            m, o, blocks = np.concatenate(margins, 1), np.concatenate(others, 1), np.stack(met, 1)
            left = np.full(n, probes if away is None else away)
            for _ in range(probes):
                at = m.argmin(1)
                least = m[np.arange(n), at]
                near = np.nonzero(least <= margin)[0]
                if not len(near):
                    break
                branch = o[near, at[near]]
                m[near, at[near]] = np.inf
                leaf, below, off = self.descend(x[near], branch % trees, branch // trees)
                place = (leaf - inner) // block * trees + branch % trees
                new = ~(blocks[near] == place[:, None]).any(1)
                asked = ~new | (left[near] > 0)
                left[near[new & asked]] -= 1
                rows.append(near[asked])
                leaves.append(((leaf - inner) * trees + branch % trees)[asked])
                own.append(np.zeros(int(asked.sum()), bool))
                added = np.full(n, -1)
                added[near[asked]] = place[asked]
                blocks = np.concatenate([blocks, added[:, None]], 1) if away is None or (new & asked).any() else blocks
                more, where = np.full((n, self.depth), np.inf, np.float32), np.zeros((n, self.depth), np.int64)
                more[near], where[near] = np.maximum(below, least[near, None]), off * trees + (branch % trees)[:, None]
                m, o = np.concatenate([m, more], 1), np.concatenate([o, where], 1)
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(own)


def split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A hyperplane between the centres that a few steps of 2-means make of two random points, cut at the median."""
    if len(x) < 2:
        w = rng.standard_normal(x.shape[1]).astype(np.float32)
        return w / np.linalg.norm(w), 0.0
    some = x if len(x) <= 2048 else x[rng.integers(0, len(x), 2048)]
    a, b = some[rng.integers(len(some))], some[rng.integers(len(some))]
    for _ in range(4):
        near = some @ (b - a) > (b - a) @ (a + b) / 2
        if near.all() or not near.any():
            break
        a, b = some[~near].mean(0), some[near].mean(0)
    w = b - a
    norm = np.linalg.norm(w)
    if norm < 1e-9:
        w = rng.standard_normal(x.shape[1]).astype(np.float32)
        norm = np.linalg.norm(w)
    w = (w / norm).astype(np.float32)
    return w, float(np.median(some @ w))


def _vectors(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Fixed-length lists or binaries of float32 as a matrix."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_binary(a.type):
        off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
        return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(len(a), dim) if len(a) else np.zeros((0, dim), np.float32)
    return np.asarray(a.flatten(), dtype=np.float32).reshape(len(a), dim)


def _streams(*tables: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    for t in tables:
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
    return sink.getvalue().to_pybytes()


def _pack(key: np.ndarray, ids: pa.Array, v: np.ndarray, asks: np.ndarray, row: np.ndarray, leaf: np.ndarray, own: np.ndarray) -> bytes:
    """Vectors of one group, whether they ask, and the leaves of the group that store them or are asked (`row` numbers the vectors, `leaf`
    the leaves of the group), compressed; bytes of equal weight together, a small number for a leaf."""
    planes = np.ascontiguousarray(v, np.float32).view(np.uint8).reshape(len(v), -1, 4)
    cols = [pa.Array.from_buffers(pa.binary(v.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(planes[:, :, i]))]) for i in range(4)]
    home = np.full(len(v), -1, np.int16)
    home[row[own]] = leaf[own]
    row, leaf = row[~own], leaf[~own]
    order = np.lexsort((leaf, row))
    others = np.bincount(row, minlength=len(v)).astype(np.uint16)
    small = np.uint8 if not len(leaf) or leaf.max() < 256 else np.uint16
    return _streams(pa.table([pa.array(key), ids, *cols, pa.array(asks), pa.array(home), pa.array(others)], ["key", "id", "0", "1", "2", "3", "asks", "home", "others"]), pa.table([pa.array(leaf[order].astype(small))], ["leaf"]))


def _unpack(block: bytes, dim: int) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, vectors, and for each leaf that stores or is asked by a vector: row, leaf, own, asks)."""
    source = pa.BufferReader(block)
    t, leaf = pa.ipc.open_stream(source).read_all().combine_chunks(), pa.ipc.open_stream(source).read_all().column("leaf")
    planes = [np.frombuffer(c.buffers()[1], np.uint8)[: len(c) * dim].reshape(len(c), dim) for c in (t.column(str(i)).chunk(0) for i in range(4))]
    v = np.ascontiguousarray(np.stack(planes, 2)).view(np.float32)[:, :, 0]
    home, asks = np.asarray(t.column("home")), np.asarray(t.column("asks"))
    stored, asking = np.flatnonzero(home >= 0), np.repeat(np.arange(len(v)), np.asarray(t.column("others")))
    own = np.arange(len(stored) + len(asking)) < len(stored)
    return np.asarray(t.column("key")), t.column("id").to_pylist(), v, np.concatenate([stored, asking]), np.concatenate([home[stored], np.asarray(leaf).astype(np.int16)]), own, np.concatenate([asks[stored], np.ones(len(asking), bool)])


def _unit(v: np.ndarray) -> np.ndarray:
    d = v.astype(np.float64)
    d /= np.abs(d).max(1, keepdims=True)
    return d / np.sqrt((d * d).sum(1, keepdims=True))


def _topk(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows `qi` of q their k best of the rows `pi` of p (never themselves): indexes into p, cosines. `order` ranks
    points by id. Preselection in single precision takes the best of each group of columns, so that the selection reads
    the block once. Where the last one kept is within the error of single precision of the k-th best (many ties), the row
    is done in double precision over all columns."""
    pf = p[pi].astype(np.float32)
    best, cos = np.full((len(qi), k), -1, np.int64), np.full((len(qi), k), -2.0)
    keep, g = min(len(pi), k + 4), 8
    error = 2 * ((q.shape[1] + 4) * 2.0**-24 + 1e-10)  # of a difference of two cosines, at most
    exact = None
    step = max(1, min(512, 12_000_000 // max(1, len(pi))))
    cols = -(-len(pi) // g) * g
    for lo in range(0, len(qi), step):
        rows = qi[lo : lo + step]
        s = np.full((len(rows), cols), -9, np.float32)
        s[:, : len(pi)] = q[rows].astype(np.float32) @ pf.T
        if cols // g > 2 * keep:  # the groups with the keep largest maxima hold the keep largest entries
            blocks = s.reshape(len(rows), g, cols // g)
            top = np.argpartition(-blocks.max(1), keep - 1, axis=1)[:, :keep]
            idx = (np.arange(g)[None, :, None] * (cols // g) + top[:, None, :]).reshape(len(rows), -1)
            s = np.take_along_axis(s, idx, 1)
        else:
            idx = np.broadcast_to(np.arange(cols), (len(rows), cols))
        n = min(s.shape[1], keep + 1)
        part = np.argpartition(-s, n - 1, axis=1)[:, :n]
        cand = np.take_along_axis(idx, part, 1)
        kept = np.take_along_axis(s, part, 1)
        there, high = kept > -5, -np.sort(-kept, axis=1)
        cand = np.where(there, pi[np.minimum(cand, len(pi) - 1)], -1)
        c = np.round(np.einsum("ij,ikj->ik", q[rows], p[cand]), 10)
        c = np.where((cand < 0) | (cand == rows[:, None]), -9.0, c)
        o = np.lexsort((order[cand], -c), axis=1)[:, :k]
        m = o.shape[1]
        best[lo : lo + step, :m], cos[lo : lo + step, :m] = np.take_along_axis(cand, o, 1), np.take_along_axis(c, o, 1)
        if len(pi) > keep:
            wide = np.nonzero(high[:, keep - 1] >= high[:, k] - error)[0]
            exact = p[pi] if exact is None and len(wide) else exact
            for i in range(0, len(wide), 64 if len(pi) < 60_000 else 4):
                some = wide[i : i + (64 if len(pi) < 60_000 else 4)]
                cs = np.round(q[rows[some]] @ exact.T, 10)
                cs[pi[None, :] == rows[some][:, None]] = -9.0
                least = -np.partition(-cs, k - 1, axis=1)[:, k - 1]
                for w, c1, low in zip(some, cs, least):
                    at = np.nonzero(c1 >= low)[0]
                    at = at[np.lexsort((order[pi[at]], -c1[at]))[:k]]
                    best[lo + w], cos[lo + w] = pi[at], c1[at]
    best[cos < -2] = -1
    return best, cos


def _order(ids: list[str] | np.ndarray) -> np.ndarray:
    """Ranks of ids."""
    order = np.empty(len(ids), np.int64)
    order[np.argsort(ids if isinstance(ids, np.ndarray) else np.array(ids, dtype=object), kind="stable")] = np.arange(len(ids))
    return order


def _merge(best: np.ndarray, cos: np.ndarray, at: np.ndarray, more: np.ndarray, more_cos: np.ndarray, order: np.ndarray) -> None:
    """The rows `at` of two lists of k are joined in place; no point is in both."""
    b, c = np.concatenate([best[at], more], 1), np.concatenate([cos[at], more_cos], 1)
    o = np.lexsort((order[b], -c), axis=1)[:, : best.shape[1]]
    best[at], cos[at] = np.take_along_axis(b, o, 1), np.take_along_axis(c, o, 1)


def search_leaf(unit: np.ndarray, order: np.ndarray, asking: np.ndarray, stored: np.ndarray, k: int, leaf_rows: int, probes: int, margin: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For the rows `asking` their k best of the rows `stored`, never themselves: (rows, cosines), -1 where there are fewer. More than four
    times `leaf_rows` stored rows are searched through a tree of their own."""
    best, cos = np.full((len(asking), k), -1, np.int64), np.full((len(asking), k), -2.0)
    if not len(asking) or not len(stored):
        return best, cos
    if len(stored) > 4 * leaf_rows:
        x = unit[stored].astype(np.float32)
        tree = Forest(x, -(-len(stored) // leaf_rows), 1, seed)
        _, home, _ = tree.route(x, 0, margin)
        if len(np.unique(home)) > 1:
            row, leaf, _ = tree.route(unit[asking].astype(np.float32), probes, margin)
            for g in np.unique(leaf):
                own = row[leaf == g]
                some = search_leaf(unit, order, asking[own], stored[home == g], k, len(stored), probes, margin, seed)
                _merge(best, cos, own, *some, order)
            return best, cos
    return _topk(unit, unit, asking, stored, order, k)


def _search(
    df: DataFrame, id_col: str, vec_col: str, k: int = K, dim: int = DIM, trees: int = TREES, probes: int = PROBES, margin: float = PROBE_MARGIN, away: int | None = AWAY, leaf_rows: int = LEAF_ROWS, block_leaves: int = BLOCK_LEAVES, sample_rows: int = SAMPLE_ROWS, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """(key, near_key, rank, cosine) and (key, id): the lists by 64-bit keys of the ids, and what the keys stand for."""
    spark = df.sparkSession
    base = usable(df, id_col, vec_col, dim).withColumn("h", F.xxhash64("v"))
    for salt in range(MOST_SALTS):
        own_key = lambda c, salt=salt: F.xxhash64(c) if not salt else F.xxhash64(F.lit(salt), c)
        again = base.groupBy(own_key("id").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
        if again.isEmpty():
            break
        keyed = base.withColumn("key", own_key("id"))
        if keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").isEmpty():
            once = keyed.join(again, "key", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("h"))).where("r = 1")
            base = keyed.join(again, "key", "left_anti").select("id", "v", "h").unionByName(once.select("id", "v", "h"))
            break
    else:
        raise RuntimeError("no seed gives each id a key of its own")
    # directions: exactly, and to so many decimals that the cosine of two equal ones is 1 at 10 decimals
    scale, odd = 1e6 if dim < 100 else 1e7, np.random.default_rng(seed).integers(-(2**62), 2**62, dim) * 2 + 1

    def direction(batches):
        for b in batches:
            d = _vectors(b.column("v"), dim).astype(np.float64)
            d /= np.abs(d).max(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array((np.rint(d * scale).astype(np.int64) * odd).sum(1))], [*b.schema.names[1:], "h"])

    counts = base.select("v").mapInArrow(direction, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    total, many = counts.agg(F.sum("n"), F.count_if(F.col("n") > k + 1)).first()
    if not total:
        return spark.createDataFrame([], "key bigint, near_key bigint, rank int, cosine double"), spark.createDataFrame([], "key bigint, id string")
    searched, rest = base.select("id", "v", F.lit(True).alias("asks")), None
    if many:
        crowded = counts.where(F.col("n") > k + 1).select("h")
        turned = base.select("v", "id", F.col("v").alias("w")).mapInArrow(direction, "id string, w array<float>, h bigint").withColumnRenamed("w", "v")
        top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
        exact = F.transform("v", lambda x: x.cast("double") / F.col("top") + F.lit(0.0))
        near = F.transform("d", lambda x: F.rint(x * F.lit(scale)) + F.lit(0.0))
        rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        crowd = turned.join(crowded, "h", "left_semi").withColumn("top", top).withColumn("d", exact).withColumn("near", near).withColumn("r", rank("h", "near")).withColumn("stored", rank("h", "d") <= k + 1)
        rest = crowd.where(F.col("r") > k + 1).select("id", "h", "near")
        last = crowd.where(F.col("r") == k + 1).select("h", "near", F.col("id").alias("like"))
        searched = turned.join(crowded, "h", "left_anti").select("id", "v", F.lit(True).alias("asks")).unionByName(crowd.where("stored").select("id", "v", (F.col("r") <= k + 1).alias("asks")))

    leaves = max(1, -(-total // leaf_rows))
    share = min(1.0, sample_rows / total)
    sampled = base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(2 * sample_rows).toArrow()  # the limit is a bound that the share keeps away from
    sample = _unit(_vectors(sampled.column(0), dim)).astype(np.float32) if sampled.num_rows else np.zeros((0, dim), np.float32)
    leaves = min(leaves, max(1, len(sample) // MIN_SAMPLE_PER_LEAF))
    forest = spark.sparkContext.broadcast(Forest(sample, leaves, trees, seed))

    def route(batches):
        f = forest.value
        for b in batches:
            v, ids, key = _vectors(b.column("v"), dim), b.column("id"), np.asarray(b.column("key"))
            asks = np.asarray(b.column("asks").to_numpy(zero_copy_only=False))
            row, leaf, own = f.route(_unit(v).astype(np.float32), probes, margin, block_leaves, away)
            row, leaf, own = (x[own | asks[row]] for x in (row, leaf, own))
            group = leaf // trees // block_leaves * trees + leaf % trees
            blocks = []
            for g in np.unique(group):
                at = np.nonzero(group == g)[0]
                rows, again = np.unique(row[at], return_inverse=True)
                stored = np.zeros(len(rows), bool)
                stored[again[own[at]]] = True
                names = ids.take(pa.array(rows, mask=~stored))  # only stored rows are put in order
                blocks.append((int(g), _pack(key[rows], names, v[rows], asks[rows], again, leaf[at] // trees % block_leaves, own[at])))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["group", "block"])

    def search(t: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_buffer(), dim) for x in t.column("block")]
        start = np.cumsum([0] + [len(p[0]) for p in parts])
        key, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        row = np.concatenate([p[3] + n for p, n in zip(parts, start)])
        leaf, own, asks = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
        order = _order([x or "" for p in parts for x in p[1]])
        order = np.append(order, len(order))  # for places that hold no row
        unit = _unit(v)
        best, cos = np.full((len(key), k), -1, np.int64), np.full((len(key), k), -2.0)
        by = np.argsort(leaf, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            asking = row[at[asks[at]]]
            # a tree stores a point in one leaf, so no list has it twice
            some = search_leaf(unit, order, asking, row[at[own[at]]], k, leaf_rows, probes, margin)
            _merge(best, cos, asking, *some, order)
        rows, rank = np.nonzero(best >= 0)
        nears, coss = best[rows, rank], cos[rows, rank]
        asked, n = np.unique(rows, return_counts=True)
        off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        near = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(-coss), pa.array(rank.astype(np.int32)), pa.array(key[nears])], ["c", "r", "key"]))
        return pa.Table.from_arrays([pa.array(key[asked]), near], ["key", "near"])

    routed = searched.select("id", own_key("id").alias("key"), "v", "asks").mapInArrow(route, "group int, block binary")
    hits = routed.groupBy("group").applyInArrow(search, "key bigint, near array<struct<c double, r int, key bigint>>")
    merged = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    # one entry per neighbour, the best k: lists hold at most k times the leaves asked
    distinct = F.aggregate("near", F.array().cast("array<struct<c:double,r:int,key:bigint>>"), lambda acc, x: F.when((F.size(acc) >= k) | F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))))
    found = merged.select("key", F.posexplode(distinct).alias("rank0", "x")).select("key", F.col("x.key").alias("near_key"), (F.col("rank0") + 1).alias("rank"), (-F.col("x.c")).alias("cosine"))
    if rest is not None:
        like = rest.join(last, ["h", "near"]).select(own_key("id").alias("copy"), own_key("like").alias("key"))
        found = found.unionByName(like.join(found, "key").select(F.col("copy").alias("key"), "near_key", "rank", "cosine"))
    return found, base.select(own_key("id").alias("key"), "id")


def neighbours(df: DataFrame, id_col: str, vec_col: str, **options) -> DataFrame:
    """(id, neighbour, rank, cosine): for every usable row its k most similar other rows, as far as the forest finds
    them (approximate; the README has the measured recall)."""
    found, names = _search(df, id_col, vec_col, **options)
    near = names.select(F.col("key").alias("near_key"), F.col("id").alias("neighbour"))
    return found.join(names, "key").join(near, "near_key").select("id", "neighbour", "rank", "cosine")


def neighbour_pairs(df: DataFrame, id_col: str, vec_col: str, **options) -> DataFrame:
    """(point_lo, point_hi): each pair of which one is among the other's neighbours, once. Pairs are made unique while
    they are still pairs of keys."""
    found, names = _search(df, id_col, vec_col, **options)
    pairs = found.select(F.least("key", "near_key").alias("key"), F.greatest("key", "near_key").alias("near_key")).distinct()
    near = names.select(F.col("key").alias("near_key"), F.col("id").alias("other"))
    return pairs.join(names, "key").join(near, "near_key").select(F.least("id", "other").alias("point_lo"), F.greatest("id", "other").alias("point_hi"))
