"""Embeddings and exact vector search.

`hash_embed` is lexical, not semantic: words are hashed to dimensions, counted and normalised. Real models can be put in
through `embed_with`. Searches compare a stated set of queries, in blocks, with all rows: each task keeps its own k best per
query, so what is shuffled is queries x partitions x k, never all pairs. Vectors that are null, of another length than
the queries', or of norm 0 or not finite, are left out; equal cosines (to 10 decimals) go by id."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.search import first

DIM = 384
BLOCK = 2048
WORDS = re.compile(r"[a-z0-9]+")


def hash_counts(low: str | None, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of the words of a text in lower case."""
    at = np.fromiter((_bucket(w, dim) for w in WORDS.findall(low or "")), np.int64)
    return np.unique(at, return_counts=True)


@functools.lru_cache(maxsize=200_000)
def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim


def hash_model(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Dense vectors of texts (lower-cased here); without words the vector is 0."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        at, n = hash_counts((t or "").lower(), dim)
        out[i, at] = n / max(1.0, np.sqrt((n * n).sum()))
    return out


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, bucket, weight): the nonzero entries of each text's vector, row by row: nothing is shuffled."""
    src = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))

    def run(batches):
        for b in batches:
            found = [hash_counts(t, dim) for t in b.column("low").to_pylist()]
            sizes = np.array([len(n) for _, n in found], np.int64)
            weights = [n / np.sqrt((n * n).sum()) for _, n in found]
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(flat([x for x, _ in found], np.int32)), pa.array(flat(weights, np.float64))], ["key", "bucket", "weight"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, bucket int, weight double")


def hash_topk(corpus: DataFrame, key: str, text: str, queries: DataFrame, k: int, dim: int = DIM) -> DataFrame:
    """(query, rank, key, cosine) for a stated, short list of queries (query, question): the k rows of largest cosine (to 6
    decimals, then by key) among those that share a dimension. Each batch keeps its own k best per query."""
    asked = [(r["query"], r["question"]) for r in queries.select("query", "question").collect()]  # a stated list
    names, q = [n for n, _ in asked], hash_model([t for _, t in asked], dim)
    src = corpus.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    kind = src.schema["key"].dataType.simpleString()

    def best(batches):
        for b in batches:
            lows = b.column("low").to_pylist()
            c = np.zeros((len(names), len(lows)))
            for j, t in enumerate(lows):
                at, n = hash_counts(t, dim)
                if len(n):
                    c[:, j] = q[:, at] @ (n / np.sqrt((n * n).sum()))
            c = np.round(c, 6)
            rows, cols = [], []
            for i in range(len(names)):
                order = np.nonzero((c[i] > 0) & (c[i] >= (np.partition(c[i], -k)[-k] if c.shape[1] > k else 0)))[0]
                rows += [i] * len(order)
                cols += list(order)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows], pa.int64()), b.column("key").take(pa.array(cols, pa.int64())), pa.array(c[rows, cols] if rows else [], pa.float64())], ["query", "key", "cosine"])

    hits = src.mapInArrow(best, f"query bigint, key {kind}, cosine double")
    return first(hits, "query", [F.col("cosine").desc(), "key"], k).select("query", "rank", F.col("key").alias(key), "cosine")


def embed_with(df: DataFrame, text: str, model: Callable[[list[str]], Sequence[Sequence[float]]] = hash_model) -> DataFrame:
    """Adds `embedding` by a model that takes and gives batches (the lexical hash, if none is given); null texts are embedded as empty ones."""

    def run(batches):
        for b in batches:
            v = model([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.asarray(x, np.float32) for x in v], pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, embedding array<float>")


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = v.astype(np.float64)
    n = np.sqrt((d * d).sum(1))
    ok = np.isfinite(n) & (n > 0)
    return d[ok] / n[ok, None], ok


def _first(at: np.ndarray, cosines: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the places `at`, which hold all that can be among the k best, the k best: by cosine, then by id."""
    own = ids[at]
    return at[np.lexsort((own.astype(str) if isinstance(own[0], str) else own.astype(np.int64), -cosines[at]))[:k]]


def topk(corpus: DataFrame, id_col: str, vec_col: str, queries: list[tuple[str, list[float]]], k: int = 5) -> DataFrame:
    """(query, rank, id, cosine) for a stated list of (name, vector)."""
    spark = corpus.sparkSession
    out = None
    for lo in range(0, len(queries), BLOCK):
        names = [q for q, _ in queries[lo : lo + BLOCK]]
        q, ok = _unit(np.array([v for _, v in queries[lo : lo + BLOCK]], np.float32))
        shared = spark.sparkContext.broadcast((q, [n for n, o in zip(names, ok) if o]))

        def best(batches, shared=shared):
            q, names = shared.value
            keep_c = np.full((len(q), 0), -2.0)
            keep_i = np.zeros((len(q), 0), object)
            for b in batches:
                lists = b.column(1)
                v, good = _unit(np.asarray(lists.flatten(), np.float32).reshape(len(lists), q.shape[1])) if len(lists) else (np.zeros((0, q.shape[1])), np.zeros(0, bool))
                ids = np.array(b.column(0).to_pylist(), object)[good]
                c = np.concatenate([keep_c, np.round(q @ v.T, 10)], 1)
                i = np.concatenate([keep_i, np.broadcast_to(ids, (len(q), len(ids)))], 1)
                if c.shape[1]:
                    least = np.partition(c, -min(k, c.shape[1]), 1)[:, -min(k, c.shape[1])]
                    o = np.stack([_first(np.nonzero(c[r] >= least[r])[0], c[r], i[r], min(k, c.shape[1])) for r in range(len(q))])
                    keep_c, keep_i = np.take_along_axis(c, o, 1), np.take_along_axis(i, o, 1)
            rows = [(names[r], keep_i[r, j], keep_c[r, j]) for r in range(len(q)) for j in range(keep_c.shape[1])]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], id_type), pa.array(cols[2], pa.float64())], ["query", "id", "cosine"])

        kind = corpus.schema[id_col].dataType.simpleString()
        id_type = pa.string() if kind == "string" else pa.int64()
        usable = corpus.where((F.size(vec_col) == q.shape[1]) & F.col(id_col).isNotNull() & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x)))
        got = first(usable.select(id_col, F.col(vec_col).cast("array<float>")).mapInArrow(best, f"query string, id {'string' if kind == 'string' else 'bigint'}, cosine double"), "query", [F.col("cosine").desc(), "id"], k)
        out = got if out is None else out.unionByName(got)
    return out.select("query", "rank", "id", "cosine") if out is not None else spark.createDataFrame([], "query string, rank int, id string, cosine double")
