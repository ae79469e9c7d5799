"""Sizes in tokens of a public tokenizer, and running positions over large groups."""

from __future__ import annotations

import base64
import functools
import os
import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # parameter of every operator that counts tokens
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the public pattern that belongs to the vocabulary
ROWS_PER_BUCKET = 200_000
PARTITION_BYTES = 4_000_000


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, once per worker."""
    import tiktoken

    with open(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a text; 0 for null and blank ones. Lone surrogates count as the replacement character."""
    if not text or text.isspace():
        return 0
    try:
        return len(encoding(vocabulary).encode_ordinary(text))
    except UnicodeEncodeError:
        return len(encoding(vocabulary).encode_ordinary(text.encode("utf-8", "replace").decode()))


def ship(spark: SparkSession, vocabulary: str) -> None:
    """On a cluster the driver's vocabulary file goes to the workers, once a session; they read it there unless they have the path themselves."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_vocabularies", set())
    if vocabulary not in sent and not re.match(r"local(\[|$)", sc.master):
        sc.addFile(vocabulary)
        sent.add(vocabulary)


def with_tokens(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep`, `n_tokens` (int) and `text_hash` of every row; the text itself goes no further than the Python worker."""
    ship(df.sparkSession, vocabulary)
    src = df.select(*[F.col(c) for c in keep], F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("__text"))

    def run(batches):
        for b in batches:
            n = pa.array([count_tokens(t, vocabulary) for t in b.column(b.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "text_hash", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens int"
    return src.mapInArrow(run, schema)


def buckets(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // per_bucket))


def running(df: DataFrame, group: list[str], order: list[str], value, n_buckets: int, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before. The order is by a hashed bucket,
    then by `order`; each window holds one bucket of one group, and only bucket sums are put in order per group."""
    df = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(n_buckets))).withColumn("__v", value.cast("long"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group, "__b").agg(F.sum("__v").alias("s")).select(*group, "__b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("__v").over(inside), F.lit(0))
    if n_buckets == 1:
        return df.withColumn(out, own).drop("__b", "__v")
    return df.withColumn("__own", own).join(base, [*group, "__b"]).withColumn(out, F.col("__base") + F.col("__own")).drop("__b", "__v", "__base", "__own")
