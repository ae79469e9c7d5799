"""Session defaults, the shared folder for cut lineage, and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "loamgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` overrides them. On a cluster the submitter sets the master."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """What may be set: the warehouse, the shared folder, and the name of a language model's key variable."""

    warehouse: str
    shared: str | None
    model_key: str


def settings(spark: SparkSession) -> Settings:
    """From the session's configuration, keys spark.loamgraph.*, else defaults."""
    get = spark.conf.get
    return Settings(get("spark.loamgraph.warehouse", get("spark.sql.warehouse.dir")), get("spark.checkpoint.dir", None), get("spark.loamgraph.modelKey", "MODEL_API_KEY"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`. Only a local master may fall back to a temporary one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="loamgraph_")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder made by `cut`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Writes `df` as a table in the shared folder and reads it back: lineage ends there and a lost executor costs
    nothing that was written. Returns the table and its folder, for `drop_dir` once nothing reads it; a folder that a result
    still reads when a function returns goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
