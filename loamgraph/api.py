"""The engine as one object: index a source tree or given tables, search, and answer questions."""

from __future__ import annotations

import os
import re
import shutil
import stat
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import names as N
from loamgraph.operators import answer as A
from loamgraph.operators import graph as G
from loamgraph.operators import index as I
from loamgraph.operators import parse as P
from loamgraph.operators import resolve as RS
from loamgraph.operators import retrieve as R
from loamgraph.operators import search as S
from loamgraph.operators import text as T
from loamgraph.operators import vector as V
from loamgraph.session import drop_dir, settings, table
from loamgraph.sources.store import VectorStore
from loamgraph.sources.tree import read_tree


TABLES = ("files", "chunks", "nodes", "edges")
CLONE_SECONDS = 600


def remove_tree(path: str) -> None:
    """Removes a folder, read-only files in it too."""

    def again(func, name, _):  # noqa: ANN001
        os.chmod(name, stat.S_IWRITE)
        func(name)

    if os.path.exists(path):
        try:
            shutil.rmtree(path, onexc=again)
        except OSError as e:
            raise RuntimeError(f"Could not remove the folder {path}: {e}") from e


def clone(url: str, to: str) -> str:
    """Clones a repository (needs git and a network) into `to`, which is emptied first. Only addresses of the supported host are
    taken."""
    if not re.match(N.URL_PATTERN, url.strip()):
        raise ValueError(f"Invalid GitHub URL: '{url}'")
    remove_tree(to)
    os.makedirs(os.path.dirname(os.path.abspath(to)), exist_ok=True)
    try:
        subprocess.run(["git", "clone", "--depth", "1", url.strip(), to], check=True, capture_output=True, text=True, timeout=CLONE_SECONDS)
    except FileNotFoundError as e:
        raise RuntimeError("git is not available on this machine") from e
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"Git clone failed. {(e.stderr or e.stdout or '').strip()}") from e
    except subprocess.TimeoutExpired as e:
        raise RuntimeError(f"Git clone failed. It took more than {CLONE_SECONDS} seconds") from e
    return to


class Engine:
    """Tables of one or many repositories. `embed` makes vectors of texts and questions; the same one that made the index's."""

    def __init__(self, spark: SparkSession, files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, model: Callable[[str], str] | None = None, embed: R.Embed = V.hash_model) -> None:
        self.spark, self.files, self.chunks, self.nodes, self.edges, self.model, self.embedder = spark, files, chunks, nodes, edges, model, embed
        self.symbols, self.imports, self.decorators = I.symbols(chunks), I.imports(edges), I.decorators(chunks)
        self.vectors: VectorStore | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str, model: Callable[[str], str] | None = None, embed: R.Embed = V.hash_model) -> Engine:
        return cls(spark, *[table(spark, folder, t) for t in TABLES], model=model, embed=embed)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, model: Callable[[str], str] | None = None, embed: R.Embed = V.hash_model) -> Engine:
        """An index that `from_tree` or `build` has written: symbols, imports, decorators and edges are there once each, and vectors."""
        e = cls.from_tables(spark, folder, model, embed)
        e.symbols, e.imports, e.decorators = (spark.read.parquet(f"{folder}/index/{t}") for t in ("symbols", "imports", "decorators"))
        e.vectors = VectorStore(spark, f"{folder}/vectors")
        return e

    def build(self, folder: str) -> Engine:
        """Writes the index over this engine's tables under `folder`: its de-duplicated tables and the vectors of its symbols."""
        for t in TABLES:
            df = getattr(self, t)
            (I.latest_edges(df) if t == "edges" else df).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        e = Engine.from_tables(self.spark, folder, self.model, self.embedder)
        for t in ("symbols", "imports", "decorators"):
            getattr(e, t).write.mode("overwrite").parquet(f"{folder}/index/{t}")
        symbols, store = self.spark.read.parquet(f"{folder}/index/symbols"), VectorStore(self.spark, f"{folder}/vectors")
        store.drop()
        store.create(len(self.embedder([""])[0]))
        store.upsert(V.embed_with(symbols.select(F.col("chunk_id").cast("string").alias("point_id"), "text", F.col("file").alias("file_path"), F.col("type").alias("chunk_type"), F.col("name").alias("symbol_name")), "text", self.embedder))
        return Engine.open(self.spark, folder, self.model, self.embedder)

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, out: str, repo: str = "repo", model: Callable[[str], str] | None = None, embed: R.Embed = V.hash_model) -> Engine:
        """Scans and parses a source tree once, writes the index as tables under `out` and opens it."""
        now = F.current_timestamp().cast("timestamp_ntz")
        files = read_tree(spark, root).select(F.col("ord").cast("long").alias("file_id"), F.lit(repo).alias("repo"), F.concat(F.lit(f"repositories/{repo}/"), "rel_path").alias("file_path"), "rel_path", "ext", F.col("content").alias("text"), F.col("ord").cast("long").alias("ord"), now.alias("indexed_at"))
        scan = f"{out}/scan"
        files.write.mode("overwrite").parquet(f"{scan}/files.parquet")
        P.facts(table(spark, scan, "files")).write.mode("overwrite").parquet(f"{out}/facts.parquet")
        facts = table(spark, out, "facts")
        key = F.xxhash64("file_path", "pos")
        ch = facts.where("kind = 'chunk'").select(key.alias("chunk_id"), "text", F.col("type").alias("chunk_type"), F.col("name").alias("symbol_name"), "module", "fqn", "file_path", F.col("line").alias("line_number"), "docstring", N.visibility(N.last_part(F.col("name"))).alias("visibility"), F.col("pos").cast("long").alias("ord"), now.alias("indexed_at"))
        nodes = RS.nodes(facts).withColumn("indexed_at", now).withColumn("removed_at", F.lit(None).cast("timestamp_ntz"))
        edges = RS.edges(facts).select(F.xxhash64("file_path", "pos", "relation", "target").alias("edge_id"), "source", "target", "relation", "resolved", "confidence", "file_path", F.col("pos").cast("long").alias("ord"), now.alias("indexed_at"))
        built = cls(spark, table(spark, scan, "files"), ch, nodes, edges, model, embed).build(out)
        drop_dir(spark, scan)
        return built

    @classmethod
    def index(cls, spark: SparkSession, url: str, work: str, out: str, fetch: Callable[[str, str], str] = clone, **options) -> dict:
        """The whole way of a repository: fetch, scan, parse, vectors, graph, index. Gives what was counted, or what class of error it was."""
        try:
            repo = spark.createDataFrame([(url,)], "u string").select(N.repo_identifier(F.col("u"))).first()[0]
            e = cls.from_tree(spark, fetch(url, work), out, repo, **options)
            n = {r["what"]: r["n"] for r in e.summary().collect()}
            return {"success": True, "repository": repo, "documents": n["files"], "chunks": n["chunks"], "indexed": e.vectors.read().count(), "graph_nodes": n["nodes"], "graph_edges": n["edges"]}
        except Exception as e:  # noqa: BLE001
            kind = spark.createDataFrame([(str(e),)], "m string").select(N.error_category(F.col("m"))).first()[0]
            return {"success": False, "error": kind, "details": str(e)}

    def health(self) -> dict:
        """Status and settings."""
        return {"status": "ok", **settings(self.spark).__dict__}

    def documents(self, n: int = 10) -> tuple[int, list[tuple[str, int]]]:
        """How many files there are, and path and length of the first ones."""
        rows = self.files.orderBy("ord", "file_id").select("rel_path", F.length("text").alias("n")).limit(n).collect()
        return self.files.count(), [(r["rel_path"], r["n"]) for r in rows]

    def text_pieces(self) -> dict:
        """Files, text chunks of them, and the beginning of the first."""
        c = T.text_chunks(self.files, "file_id")
        first = c.orderBy("file_id", "chunk_id").select(F.substring("text", 1, 300).alias("t")).first()
        return {"documents": self.files.count(), "chunks": c.count(), "preview": first["t"] if first else None}

    def code_chunks(self, path: str | None = None, n: int = 5) -> tuple[int, list[dict]]:
        """How many chunks there are (of one file, if given), and the first ones."""
        c = self.symbols if path is None else self.symbols.where(F.col("file") == path)
        return c.count(), [r.asDict() for r in c.orderBy("ord", "chunk_id").limit(n).collect()]

    def embed(self, text: str, n: int = 10) -> tuple[int, list[float]]:
        """Dimensions, and the first entries of a text's vector."""
        rows = V.hash_embed(self.spark.createDataFrame([(0, text)], "k int, t string"), "k", "t").collect()
        v = [0.0] * V.DIM
        for r in rows:
            v[r["bucket"]] = r["weight"]
        return V.DIM, v[:n]

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return G.graph_nodes(self.nodes), I.latest_edges(self.edges)

    def summary(self) -> DataFrame:
        return I.index_summary(self.files, self.chunks, self.nodes, self.edges)

    def neighbours(self, symbol: str, limit: int = 20) -> DataFrame:
        return G.neighbours(self.edges, self.spark.createDataFrame([(symbol,)], "symbol string"), limit)

    def search(self, kind: str, term: str) -> DataFrame:
        """kind: symbols, files, imports, decorators, classes, functions or text."""
        if kind == "symbols":
            return S.search_symbols(self.symbols, [term])
        if kind == "files":
            return S.search_files(self.files, [term])
        if kind == "imports":
            return S.search_imports(self.imports, [term])
        if kind == "decorators":
            return S.search_decorators(self.decorators, [term])
        if kind == "text":
            return S.keyword_search(self.files, [term])
        return S.search_kind(self.symbols, [term], {"classes": ["class"], "functions": ["function", "method"]}[kind])

    def retrieve(self, asked: list[str], size: int = R.SIZE) -> tuple[DataFrame, DataFrame]:
        """(questions, ranked context) for a batch."""
        q = R.questions(self.spark, asked)
        rows = self.context(q)
        return q, R.ranked(rows, q, size)

    def context(self, q: DataFrame) -> DataFrame:
        once = self.vectors is not None
        vectors = self.vectors.read().select("point_id", "embedding") if once else None
        return R.context(R.Tables(self.files, self.symbols, self.imports, self.decorators, self.edges, once, vectors, self.embedder), q)

    def hybrid(self, question: str) -> list[dict]:
        """The ranked context of one question."""
        return [r.asDict() for r in self.retrieve([question])[1].orderBy("rank").collect()]

    def symbol(self, name: str) -> list[dict]:
        """The definitions of exactly this own name."""
        return [r.asDict() for r in S.symbol_chunks(self.symbols, [name]).orderBy("rank").collect()]

    def chat(self, question: str) -> dict:
        """Answer, intent, confidence and sources (at most a dozen rows) of one question."""
        q = R.questions(self.spark, [question])
        rows = self.context(q).cache()
        ranked = R.ranked(rows, q).cache()
        try:
            meta = R.confidence(q, rows).first()
            prompt, default = A.prompts(ranked, q).first()["prompt"], A.fallback(ranked, q).first()["answer"]
            return {"answer": A.answer_one(prompt, default, self.model), "intent": meta["intent"], "strategies": meta["strategies"], "confidence": meta["confidence"], "sources": [r.asDict() for r in A.sources(ranked).orderBy("rank").collect()]}
        finally:
            ranked.unpersist()
            rows.unpersist()
