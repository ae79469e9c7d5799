"""Filling fixed-capacity containers with items, by bin completion.

Sizes are whole numbers up to the capacity, so however many items there are, they form at most `capacity` kinds. The
histogram of sizes (bounded by the capacity) goes to the driver; there, `solve` searches: the better of best fit, in falling order of size, and of completing the largest size again and again is the first
incumbent. If it has more containers than the lower bound, branch and bound follows: a branch takes the largest size left and each undominated
filling around it in turn, those that waste least first, as often as the counts allow and then once; it ends where the
waste so far, or the bound of what is left, shows that it can't have fewer containers than the incumbent, or where the same
counts were met before with as few containers. The search ends with a proof, or after `nodes` steps, when the incumbent stands; with
`nodes` None it always runs to the proof. The plan, again bounded by the
capacity, is then spread: every item gets its index among the items of its size, and the plan says which container has
that index. No item is moved to a group by anything but its size and a hash.

Defined results: null and blank texts have no tokens and get no container; an item larger than the capacity is cut into
pieces of the capacity and a rest; repeated rows are items of their own; ties go by id, then by the text's hash; an empty
input gives no containers; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.tokens import VOCABULARY, buckets, running, with_tokens
from loamgraph.session import cut

CAPACITY = 2048
NODES = 200_000  # steps of the search; beyond them the incumbent stands, unless nodes is None
BREADTH = 64  # fillings tried around one item in a search with a limit
Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer containers. For each threshold: items that share no container with items of the threshold or more, items
    over half the capacity, and what the rest needs beyond the room that those leave."""
    sizes = np.array(sorted(counts, reverse=True), np.int64)
    if not len(sizes):
        return 0
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    half = sizes * 2 > capacity
    for k in (0, *sizes[~half].tolist()):
        alone, big, small = sizes > capacity - k, half & (sizes <= capacity - k), ~half & (sizes >= k)
        room = int(n[big].sum()) * capacity - int((sizes * n)[big].sum())
        best = max(best, int(n[alone].sum() + n[big].sum()) + max(0, -(-(int((sizes * n)[small].sum()) - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Items in falling order, each into the fullest container that has room; equal containers are kept as one row."""
    free: dict[int, Counter] = {}  # room left -> fillings and how many containers have them
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room not in free:
            free[room] = Counter()
            insort(rooms, room)
        free[room][filling] += n

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                put(capacity, (), -(-n // (capacity // s)))
                continue
            room = rooms[i]
            filling, m = free[room].popitem()
            if not free[room]:
                del free[room], rooms[i]
            each = room // s
            whole = min(m, n // each)
            if whole:
                put(room - each * s, filling + (s,) * each, whole)
                n -= whole * each
            elif n:
                put(room - n * s, filling + (s,) * n, 1)
                n, whole = 0, 1
            if m > whole:
                put(room, filling, m - whole)
    return [(f, n) for c in free.values() for f, n in c.items() if f]


def fillings(room: int, counts: dict[int, int], slack: int, steps: list[int], most: int | None = None) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` that waste at most `slack`, least waste first. One is dominated if an item left still fits, if
    a larger item left fits in place of one of its own, or an item left in place of two that are together no larger. `steps` is
    what may still be spent."""
    sizes = [s for s in sorted(counts, reverse=True) if s <= room]
    n = len(sizes)
    after = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        after[i] = after[i + 1] + sizes[i] * min(counts[sizes[i]], room // sizes[i])
    out: list[tuple[int, tuple[int, ...]]] = []
    rising = sizes[::-1]

    def fits(low: int, high: int, used: tuple[int, ...]) -> bool:
        """Whether an item of low to high is left."""
        for s in rising[bisect_left(rising, low) : bisect_right(rising, high)]:
            if counts[s] > used.count(s):
                return True
        return False

    def dominated(f: tuple[int, ...], waste: int) -> bool:
        kinds = list(dict.fromkeys(f))
        if fits(1, waste, f) or any(fits(a + 1, a + waste, f) for a in kinds):
            return True
        return any(fits(a + b, a + b + waste, f) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or f.count(a) > 1)

    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and steps[0] > 0 and (most is None or len(out) < most):
        i, rest, chosen = stack.pop()
        steps[0] -= 1
        while i < n and sizes[i] > rest:
            i += 1
        if rest - after[i] > slack:
            continue
        if i == n:
            if not dominated(chosen, rest):
                out.append((rest, chosen))
            continue
        s = sizes[i]
        for k in range(min(counts[s], rest // s) + 1):  # the most of the largest is tried first
            stack.append((i + 1, rest - k * s, chosen + (s,) * k))
    return [f for _, f in sorted(out, key=lambda x: (x[0], len(x[1])))]


def completed(counts: dict[int, int], capacity: int, steps: int = 500) -> Plan:
    """The largest size left gets the first filling found that wastes little (at most `steps` steps for each of a few allowances of
    waste, else the largest that fit), as often as the counts allow, which uses up a size each time."""
    left, out = dict(counts), []
    while left:
        big = max(left)
        rest = dict(left)
        rest[big] -= 1
        if not rest[big]:
            del rest[big]
        room, found = capacity - big, []
        for slack in (0, 1, 4, 16, 64):
            found = found or fillings(room, rest, min(slack, room), [steps], 1)
        # else the fullest of the containers that best fit would make of the room
        filling = (big, *(found[0] if found else max((f for f, _ in best_fit({s: n for s, n in rest.items() if s <= room}, room)), key=sum, default=())))
        times = min(left[s] // filling.count(s) for s in set(filling))
        for s in set(filling):
            left[s] -= filling.count(s) * times
            if not left[s]:
                del left[s]
        out.append((filling, times))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> tuple[Plan, bool]:
    """([(sizes of a container, number of such containers)], whether no packing has fewer containers) for {size: count}."""
    start = {int(s): int(n) for s, n in histogram.items() if n > 0}
    best, bound = best_fit(start, capacity), lower_bound(start, capacity)
    if sum(n for _, n in best) > bound:
        best = min(best, completed(start, capacity), key=lambda plan: sum(n for _, n in plan))
    total = sum(s * n for s, n in start.items())
    fewest = sum(n for _, n in best)
    steps = [nodes if nodes is not None else 1 << 62]
    seen: dict[tuple, int] = {}

    def children(counts: dict[int, int], used: int):
        """(filling, times) around the largest item."""
        big = max(counts)
        left = dict(counts)
        left[big] -= 1
        if not left[big]:
            del left[big]
        rest = sum(s * n for s, n in counts.items())
        slack = (fewest - 1 - used) * capacity - rest  # what all further containers may waste together
        if slack < 0:
            return
        some = [(big, *f) for f in fillings(capacity - big, left, slack, steps, None if nodes is None else BREADTH)]
        most = [min(counts[s] // f.count(s) for s in set(f)) for f in some]
        yield from zip(some, most)
        yield from ((f, 1) for f, t in zip(some, most) if t > 1)

    path: list[tuple[tuple[int, ...], int]] = []
    stack = [(start, 0, children(start, 0))] if start and fewest > bound else []
    while stack and fewest > bound and steps[0] > 0:
        counts, used, more = stack[-1]
        child = next(more, None)
        if child is None:
            stack.pop()
            if path:
                path.pop()
            continue
        filling, times = child
        steps[0] -= 1
        left = dict(counts)
        for s in set(filling):
            left[s] -= filling.count(s) * times
            if not left[s]:
                del left[s]
        now = used + times
        if not left:
            if now < fewest:
                fewest, best = now, [*path, (filling, times)]
            continue
        rest = sum(s * n for s, n in left.items())
        if now + (lower_bound(left, capacity) if len(left) <= 64 else -(-rest // capacity)) >= fewest:
            continue
        key = tuple(sorted(left.items()))
        if seen.get(key, fewest) <= now:
            continue
        seen[key] = now
        path.append((filling, times))
        stack.append((left, now, children(left, now)))
    assert sum(sum(f) * n for f, n in best) == total
    return [(tuple(sorted(f, reverse=True)), n) for f, n in best], fewest <= bound or (not stack and steps[0] > 0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> Plan:
    """[(sizes of a container, number of such containers)] for {size: count}."""
    return solve(histogram, capacity, nodes)[0]


def slots(filled: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by size: for size s the entries `at[s] .. at[s + 1]` of (first index, first container, items per
    container, offset in the container)."""
    per: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for sizes, times in filled:
        offset = 0
        for s in dict.fromkeys(sizes):
            n = sizes.count(s)
            per.setdefault(s, []).append((used.get(s, 0), first, n, offset))
            used[s] = used.get(s, 0) + n * times
            offset += n * s
        first += times
    at = np.zeros(capacity + 2, np.int64)
    rows = []
    for s in range(capacity + 1):
        at[s] = len(rows)
        rows += per.get(s, [])
    at[capacity + 1] = len(rows)
    return at, np.array(rows, np.int64).reshape(-1, 4)


def pieces(items: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """Items cut at the capacity: id, text_hash, piece, start, size."""
    n = F.col("n_tokens")
    return (
        items.where(n > 0)
        .select(F.col(id_col).alias("id"), "text_hash", n, F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece"))
        .select("id", "text_hash", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("size"))
    )


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, nodes: int | None = NODES) -> DataFrame:
    """(container, id, piece, start, size, offset): tokens [start, start + size) of the text lie at `offset` of the
    container."""
    spark = df.sparkSession
    counted, _ = cut(pieces(with_tokens(df, text_col, [id_col], vocabulary), id_col, capacity), "pieces")
    histogram = {r["size"]: r["n"] for r in counted.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    at, rows = slots(plan(histogram, capacity, nodes), capacity)
    shared = spark.sparkContext.broadcast((at, rows))
    ranked = running(counted, ["size"], ["id", "text_hash", "piece"], F.lit(1), buckets(sum(histogram.values())), "rank")

    def place(batches):
        at, rows = shared.value
        for b in batches:
            size, rank = np.asarray(b.column("size")), np.asarray(b.column("rank"))
            container, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
            for s in np.unique(size):
                m = size == s
                own = rows[at[s] : at[s + 1]]
                k = np.searchsorted(own[:, 0], rank[m], side="right") - 1
                d = rank[m] - own[k, 0]
                container[m] = own[k, 1] + d // own[k, 2]
                offset[m] = own[k, 3] + (d % own[k, 2]) * s
            yield pa.RecordBatch.from_arrays([pa.array(container), b.column("id"), b.column("piece"), b.column("start"), b.column("size"), pa.array(offset)], ["container", "id", "piece", "start", "size", "offset"])

    kind = counted.schema["id"].dataType.simpleString()
    return ranked.select("id", "piece", "start", "size", "rank").mapInArrow(place, f"container bigint, id {kind}, piece int, start int, size int, offset int")


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the share of space used, and the fewest containers that could do."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    total = F.sum("used")
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("pieces"), F.coalesce(total, F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"), F.coalesce(F.ceil(total / capacity), F.lit(0)).alias("least_containers")).withColumn("used_share", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
