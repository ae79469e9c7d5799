"""Mixing sources to target weights.

Each source is one stream of tokens (its documents in hashed order), cut into blocks of `block` tokens. The size of the
mix and the caps fix how many blocks each source gives (`quotas`). Output shards have `shard_blocks` slots; their source
counts are a multinomial draw given those totals, made by halving the range of shards again and again, so that any task
finds the counts of its shard, and of all before it, by itself in logarithmic time. A slot's number within its source is
taken through a pseudorandom permutation of the source's blocks (one per pass over it), and blocks are joined by index.

Defined results: only sources with a target are used, names compared exactly; null and blank texts have no tokens; a
source without documents, or whose capped size is below its target, gives what it has, the others share the rest in
proportion to their targets (never beyond their caps); repeated target rows count once (the largest share, then the tightest cap); shares that are null or not
positive give nothing; `max_repeats` null is no cap, below 1 gives nothing; the last block of a source may be shorter;
empty tables give an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm.tokens import VOCABULARY, buckets, running, with_tokens
from loamgraph.session import cut

BLOCK = 512
SHARD_BLOCKS = 256
SEED = 97
EXACT = 10**9  # numpy draws hypergeometric numbers below it


def goals_of(targets: list[tuple[str, float, int | None]]) -> dict[str, tuple[float, int | None]]:
    """(share, cap) of each source: of repeated targets the largest share counts, of equal ones the tightest cap."""
    want: dict[str, tuple[float, int | None]] = {}
    tight = lambda cap: cap if cap is not None else float("inf")
    for s, share, cap in targets:
        if s is not None and share and share > 0 and (s not in want or (share, -tight(cap)) > (want[s][0], -tight(want[s][1]))):
            want[s] = (share, cap)
    return want


def quotas(tokens: dict[str, int], targets: list[tuple[str, float, int | None]], total: int | None = None) -> dict[str, int]:
    """Tokens that each source gives. `total` is the size of the mix; None: all tokens of the sources with a target."""
    want = goals_of(targets)
    room = {s: (tokens.get(s, 0) * max(0, cap) if cap is not None else (float("inf") if tokens.get(s, 0) else 0)) for s, (_, cap) in want.items()}
    total = sum(tokens.get(s, 0) for s in want) if total is None else total
    out, open_, rest = dict.fromkeys(want, 0.0), set(want), float(total)
    while open_ and rest > 0:
        weight = sum(want[s][0] for s in open_)
        full = {s for s in open_ if rest * want[s][0] / weight >= room[s]}
        if not full:
            for s in open_:
                out[s] = rest * want[s][0] / weight
            break
        for s in full:
            out[s] = room[s]
            rest -= room[s]
        open_ -= full
    return {s: int(n) for s, n in out.items()}


def _draw(colours: np.ndarray, n: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each colour are among n of all, drawn without putting back: colour by colour, each a hypergeometric number
    given those before it. Beyond numpy's bound its normal limit is drawn, whose error there is below that of rounding."""
    rng, out, total = np.random.default_rng(seed), np.zeros(len(colours), np.int64), int(colours.sum())
    for i, good in enumerate(map(int, colours)):
        bad = total - good
        if good < EXACT and bad < EXACT:
            x = int(rng.hypergeometric(good, bad, n)) if total and n else 0
        else:
            p = good / total
            x = round(rng.normal(n * p, (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5))
        out[i] = min(max(x, n - bad, 0), n, good)
        n -= int(out[i])
        total = bad
    return out


def shard_counts(blocks: np.ndarray, shards: int, shard_blocks: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the shard, counts of all shards before it) by source."""
    lo, hi, colours, before = 0, shards, blocks.astype(np.int64), np.zeros(len(blocks), np.int64)
    total = int(blocks.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(colours, min(mid * shard_blocks, total) - lo * shard_blocks, (seed, lo, hi))
        if shard < mid:
            hi, colours = mid, left
        else:
            lo, before, colours = mid, before + left, colours - left
    return colours, before


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places i: a Feistel network on the next power of four, walked until
    it is below n."""
    if n <= 1:
        return np.zeros_like(i)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> np.uint64(half), y & mask
        for r in range(4):
            h = (b + np.uint64((key * 4 + r + 1) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (h >> np.uint64(32))) & mask
        x[todo] = (a << np.uint64(half)) | b
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def block_table(items: DataFrame, block: int, n_buckets: int) -> DataFrame:
    """(source, block, tokens, pieces array<struct<doc, start, n>>) from (source, id, text_hash, n_tokens)."""
    at = running(items, ["source"], ["id", "text_hash"], F.col("n_tokens"), n_buckets, "at")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    cutup = at.select("source", "id", "n_tokens", "at", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    end = F.least(F.col("n_tokens").cast("long"), (F.col("block") + 1) * block - F.col("at"))
    return (
        cutup.select("source", "block", F.struct((F.greatest(F.col("block") * block, F.col("at")) - F.col("block") * block).alias("offset"), F.col("id").alias("doc"), start.alias("start"), (end - start).alias("n")).alias("p"))
        .groupBy("source", "block")
        .agg(F.sum("p.n").alias("tokens"), F.sort_array(F.collect_list("p")).alias("pieces"))
    )


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(shard, slot, source, block, pass, tokens, pieces): the mix in reading order; `pieces` says which tokens of which
    document each slot holds."""
    spark = docs.sparkSession
    goals = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect()]  # a small fixed table
    names = sorted({g[0] for g in goals if g[0] is not None})
    items = with_tokens(docs.where(F.col(source_col).isin(names)) if names else docs.limit(0), text_col, [id_col, source_col], vocabulary)
    items, _ = cut(items.where("n_tokens > 0").select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), "text_hash", "n_tokens"), "sized")
    sums = {r["source"]: (r["t"], r["c"]) for r in items.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).collect()}  # a row per target
    tokens = {s: t for s, (t, _) in sums.items()}
    give = quotas(tokens, goals, total)
    names = [s for s in names if give.get(s)]
    have = np.array([-(-tokens[s] // block) for s in names], np.int64)
    caps = {s: c for s, (_, c) in goals_of(goals).items()}
    # whole passes of a source end with its short block, so a count of blocks follows from passes and what is left
    blocks = np.array([give[s] // tokens[s] * h + round((give[s] % tokens[s]) / block) for s, h in zip(names, have)], np.int64)
    blocks = np.array([min(b, h * caps[s]) if caps.get(s) is not None else b for s, b, h in zip(names, blocks, have)], np.int64)
    shards = int(-(-blocks.sum() // shard_blocks)) if len(names) else 0

    def draw(batches):
        for b in batches:
            rows: dict[str, list[np.ndarray]] = {k: [] for k in ("shard", "slot", "s", "block", "pass")}
            for j in b.column(0).to_pylist():
                counts, before = shard_counts(blocks, shards, shard_blocks, j, seed)
                s = np.repeat(np.arange(len(names)), counts)
                d = np.concatenate([before[k] + np.arange(counts[k]) for k in range(len(names))])
                i = np.zeros(len(d), np.int64)
                for k in range(len(names)):
                    m = s == k
                    for e in np.unique(d[m] // have[k]):
                        mm = m & (d // have[k] == e)
                        i[mm] = permuted(d[mm] % have[k], int(have[k]), seed * 1_000_003 + k * 7919 + int(e))
                order = np.random.default_rng((seed, j)).permutation(len(d))
                for key, v in (("shard", np.full(len(d), j)), ("slot", np.arange(len(d))), ("s", s[order]), ("block", i[order]), ("pass", (d // have[s])[order])):
                    rows[key].append(v)
            if rows["s"]:
                s = np.concatenate(rows["s"])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows["shard"])), pa.array(np.concatenate(rows["slot"]).astype(np.int32)), pa.array([names[k] for k in s], pa.string()), pa.array(np.concatenate(rows["block"])), pa.array(np.concatenate(rows["pass"]).astype(np.int32))], ["shard", "slot", "source", "block", "pass"])

    wanted = spark.range(shards).mapInArrow(draw, "shard bigint, slot int, source string, block bigint, pass int")
    n = buckets(max([c for _, c in sums.values()], default=1))
    return wanted.join(block_table(items, block, n), ["source", "block"]).select("shard", "slot", "source", "block", "pass", "tokens", "pieces")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: share wanted and reached, tokens, blocks and the most often that a block occurs."""
    by = mixed.groupBy("source", "pass").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks")).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("blocks").alias("blocks"), F.count("*").cast("int").alias("repeats"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # as many rows as targets
    zero = F.lit(0)
    top = F.struct("target_share", F.coalesce(-F.col("max_repeats"), F.lit(-(2**31) + 1)).alias("m"), "max_repeats")  # as in `quotas`: the largest share counts, of equal ones the tightest cap
    goals = targets.where("source is not null").groupBy("source").agg(F.max(top).alias("t")).select("source", "t.target_share", "t.max_repeats")
    return (
        goals.join(by, "source", "left").withColumn("total", total)
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), F.coalesce("blocks", zero).alias("blocks"), F.coalesce("repeats", zero).alias("repeats"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"))
    )
