"""Incremental indexing: new rows become facts, vectors and reference counts, as streams.

Each stream may be run again from its checkpoint after a failure: facts are appended once by the sink, vectors replace those of the same id,
and the counts of a batch are written under its number, from those of the batch before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamgraph.operators import orphans as O
from loamgraph.operators import parse
from loamgraph.operators import vector as V
from loamgraph.session import drop_dir
from loamgraph.sources.store import VectorStore

KEEP = 2  # versions of the counts: the newest, and the one that a batch run again starts from


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:  # noqa: ANN001
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def facts_stream(files: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parses each new file once (exactly once by the sink's checkpoint) and appends its facts to the table at `out`."""
    return _start(parse.facts(files).writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, available_now)


def vectors_stream(chunks: DataFrame, store: VectorStore, checkpoint: str, embed: Callable[[list[str]], Sequence[Sequence[float]]] = V.hash_model, available_now: bool = True) -> StreamingQuery:
    """Embeds new chunks (chunk_id, text, file_path, chunk_type, symbol_name) and puts them into the store, which has to be there."""
    points = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("string").alias("point_id"), "text", "file_path", "chunk_type", "symbol_name")
    return _start(points.writeStream.foreachBatch(lambda batch, _: store.upsert(V.embed_with(batch, "text", embed))), checkpoint, available_now)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose counts are there whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/keys/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if n[:1] == "b" and n[1:].isdigit() and whole(n))


def orphan_state(spark: SparkSession, path: str, before: int | None = None) -> O.State:
    """The counts after the newest batch, or after the newest one before the given number."""
    known = [n for n in _versions(spark, path) if before is None or n < before]
    if not known:
        return O.no_state(spark)
    return O.State(*(spark.read.parquet(f"{path}/b{known[-1]}/{t}") for t in ("keys", "seen")))


def orphans_stream(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps reference and existence counts of keys under `path` from a stream of changes: rows with the columns of edges (edge_id, source, target,
    relation, resolved, indexed_at) and of nodes (id, indexed_at, removed_at); `id` is null for an edge, `edge_id` for a node."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = orphan_state(spark, path, number).apply(batch.where("edge_id is not null"), batch.where("id is not null"))
        for name, t in (("seen", state.seen), ("keys", state.keys)):  # the keys last: they say that the version is whole
            t.write.mode("overwrite").parquet(f"{path}/b{number}/{name}")
        for f in state.folders:
            drop_dir(spark, f)
        for old in _versions(spark, path)[:-KEEP]:
            drop_dir(spark, f"{path}/b{old}")

    return _start(changes.writeStream.foreachBatch(apply), checkpoint, available_now)
