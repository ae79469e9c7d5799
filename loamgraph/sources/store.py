"""Where graphs, indexes and vectors are kept: parquet tables, exchanged for JSON where wanted.

A store writes each version to a folder of its own and then moves a pointer, so a reader never sees half of an index and a
job that dies leaves the old version in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.session import drop_dir

NODES = "id string, type string, file_path string"
EDGES = "source string, target string, relation string, resolved boolean, confidence string, file_path string, ord long"
INDEXES = {
    "symbols": "fqn string, name string, type string, module string, file string, line int, visibility string, docstring string, ord long, chunk_id long, text string",
    "imports": "file string, imported_fqn string, local_name string, ord long, edge_id long",
    "decorators": "decorator string, target string, type string, file string, line int, ord long, chunk_id long",
    "class_hierarchy": "fqn string, base_classes array<string>, subclasses array<string>",
    "files": "rel_path string, ord long",
    "functions": "fqn string, name string, file string, line int",
}


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def export_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines, a file per partition; a single document would have to pass one machine."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_graph(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the first path that has one. A path ending in .json is one document with the lists nodes and edges."""
    for p in paths:
        try:
            if p.endswith(".json"):
                doc = spark.read.schema(f"nodes array<struct<{_fields(NODES)}>>, edges array<struct<{_fields(EDGES)}>>").json(p, multiLine=True)
                doc.limit(0).collect()
                return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode("edges").alias("x")).select("x.*")
            return spark.read.parquet(f"{p}/nodes"), spark.read.parquet(f"{p}/edges")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
    raise FileNotFoundError(f"no graph at {', '.join(paths)}")


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in ddl.split(", "))


def save_indexes(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_indexes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All six indexes; those that were never written are empty."""
    out = {}
    for name, ddl in INDEXES.items():
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = spark.createDataFrame([], ddl)
    return out


POINTS = "point_id string, embedding array<float>, text string, file_path string, chunk_type string, symbol_name string"


class VectorStore:
    """Vectors under a folder: create, upsert by point id, search, drop. An upsert writes its points only, as a further part; of a point that
    is in several parts the last one counts. `compact` makes one part of them, and an upsert does so by itself when there are `PARTS`.
    A pointer names the parts of the current version, so a reader never sees half of one."""

    PARTS = 16

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def connect(cls, spark: SparkSession, *paths: str) -> VectorStore:
        """A store at the first of the paths whose file system answers; a later one is what to fall back to."""
        why: Exception | None = None
        for path in paths:
            store = cls(spark, path)
            try:
                p, fs = store._pointer()
                fs.exists(p)
                return store
            except Exception as e:  # noqa: BLE001
                why = e
        raise ConnectionError(f"no connection to any of {', '.join(paths)}") from why

    def _pointer(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> tuple[int, list[str]] | None:
        """(dimensions, parts of the current version, oldest first)."""
        p, fs = self._pointer()
        if not fs.exists(p):
            return None
        dim, *parts = self.spark.read.text(f"{self.path}/CURRENT").first()[0].split()
        return int(dim), parts

    def _move(self, dim: int, parts: list[str]) -> None:
        p, fs = self._pointer()
        out = fs.create(p, True)
        out.write(bytearray(" ".join([str(dim), *parts]).encode()))
        out.close()

    def create(self, dim: int) -> None:
        """Nothing happens if it is there already."""
        if self.current() is None:
            self._move(dim, [])

    def drop(self) -> None:
        p, fs = self._pointer()
        fs.delete(p.getParent(), True)

    def read(self) -> DataFrame:
        now = self.current()
        if not now or not now[1]:
            return self.spark.createDataFrame([], POINTS)
        parts = [self.spark.read.parquet(f"{self.path}/{x}") for x in now[1]]
        if len(parts) == 1:
            return parts[0]
        whole = parts[0].withColumn("__n", F.lit(0))
        for i, x in enumerate(parts[1:], 1):
            whole = whole.unionByName(x.withColumn("__n", F.lit(i)))
        w = Window.partitionBy("point_id").orderBy(F.col("__n").desc())
        return whole.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")

    def upsert(self, points: DataFrame) -> None:
        """Adds points; those with an id that is there replace it. Of several new points with one id the one with the largest text, then
        path, counts. Vectors of other dimensions are refused."""
        now = self.current()
        if now is None:
            raise ValueError("create the store first")
        new = points.where("point_id is not null").select("point_id", F.col("embedding").cast("array<float>").alias("embedding"), "text", "file_path", "chunk_type", "symbol_name")
        if not new.where(F.coalesce(F.size("embedding"), F.lit(-1)) != now[0]).isEmpty():
            raise ValueError(f"vectors must have {now[0]} dimensions")
        w = Window.partitionBy("point_id").orderBy(*[F.col(c).desc_nulls_last() for c in ("text", "file_path", "symbol_name", "chunk_type", "embedding")])
        name = f"v_{uuid.uuid4().hex}"
        new.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").write.parquet(f"{self.path}/{name}")
        self._move(now[0], [*now[1], name])
        if len(now[1]) + 1 >= self.PARTS:
            self.compact()

    def compact(self) -> None:
        """One part instead of several; the old ones are removed once the pointer has moved."""
        now = self.current()
        if now is None or len(now[1]) < 2:
            return
        name = f"v_{uuid.uuid4().hex}"
        self.read().write.parquet(f"{self.path}/{name}")
        self._move(now[0], [name])
        for old in now[1]:
            drop_dir(self.spark, f"{self.path}/{old}")

    def search(self, vector: list[float], k: int = 5) -> DataFrame:
        from loamgraph.operators.vector import topk

        points = self.read()
        hits = topk(points, "point_id", "embedding", [("q", vector)], k)
        return points.drop("embedding").join(F.broadcast(hits.select(F.col("id").alias("point_id"), "rank", F.col("cosine").alias("score"))), "point_id")  # k rows

    def by_symbol(self, name: str, limit: int = 5) -> DataFrame:
        return self.read().where(F.col("symbol_name") == name).orderBy("point_id").limit(limit)
