"""The structural index over the tables of an indexer: symbols, files, imports, decorators, class hierarchy.

Rows of `chunks` that came twice count once (the last indexed); a symbol that is defined again keeps its last definition.
Null keys are left out; empty tables give empty indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import names as N


def latest_chunks(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("ord").desc_nulls_last())
    return chunks.where("chunk_id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def symbols(chunks: DataFrame) -> DataFrame:
    """(fqn, name, type, module, file, line, visibility, docstring, ord, chunk_id, text)."""
    kind = F.lower("chunk_type")
    w = Window.partitionBy("fqn").orderBy(F.col("ord").desc_nulls_last(), F.col("chunk_id").desc())
    return (
        latest_chunks(chunks).where(kind.isin("class", "method", "function") & F.col("fqn").isNotNull())
        .withColumn("__r", F.row_number().over(w)).where("__r = 1")
        .select("fqn", F.col("symbol_name").alias("name"), kind.alias("type"), "module", F.col("file_path").alias("file"), F.col("line_number").alias("line"), "visibility", "docstring", "ord", "chunk_id", "text")
    )


def file_index(files: DataFrame) -> DataFrame:
    """Scanned files: extension and folders as the source scan takes them."""
    skipped = "(^|/)(" + "|".join(x.replace(".", r"\.") for x in N.SKIPPED_FOLDERS) + ")/"
    return files.where(F.col("ext").isin(N.SCANNED) & ~F.col("rel_path").rlike(skipped)).select("file_id", "repo", "rel_path", "file_path", "ext", "ord")


def latest_edges(edges: DataFrame) -> DataFrame:
    """Each delivered edge once (the first arrival). Edges stay a multiset: a link written again is another edge."""
    w = Window.partitionBy("edge_id").orderBy("ord")
    return edges.where("edge_id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def imports(edges: DataFrame) -> DataFrame:
    """(file, imported_fqn, local_name, ord, edge_id)."""
    return latest_edges(edges).where("relation = 'imports' and source is not null and target is not null").select(F.col("source").alias("file"), F.col("target").alias("imported_fqn"), N.last_part(F.col("target")).alias("local_name"), "ord", "edge_id")


def decorators(chunks: DataFrame) -> DataFrame:
    """(decorator, target, type, file, line, ord, chunk_id): decorators written above a definition, by key."""
    head = F.regexp_extract("text", r"(?s)^(.*?)(?:^|\n)[ \t]*(?:async[ \t]+def|def|class)[ \t]", 1)
    found = F.regexp_extract_all(head, F.lit(r"(?m)^[ \t]*(@[^\r\n]+)"), 1)
    return (
        symbols(chunks).where(F.endswith("file", F.lit(".py")) & F.contains("text", F.lit("@")))
        .select("name", "type", "file", "line", "ord", "chunk_id", F.explode(found).alias("raw"))
        .select(N.decorator_key(F.col("raw")).alias("decorator"), F.col("name").alias("target"), "type", "file", "line", "ord", "chunk_id")
    )


def class_links(edges: DataFrame) -> DataFrame:
    """(fqn, role, other): role base for what a class's inherits edges name; role subclass for the classes of which it is the
    first class (by arrival) that is called as their base, or whose dotted name ends so. One row per link, so that a base of
    millions of classes is no row or task of its own. The suffix test is an equi-join on all dotted suffixes of the names."""
    inh = latest_edges(edges).where("relation = 'inherits' and source is not null and target is not null").select("source", "target", "ord").groupBy("source", "target").agg(F.min("ord").alias("ord"))
    classes = inh.groupBy(F.col("source").alias("fqn")).agg(F.min("ord").alias("first"))
    parts = F.split("fqn", r"\.")
    suffixes = classes.select("fqn", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    owner = suffixes.groupBy("suffix").agg(F.min_by("fqn", F.struct("first", "fqn")).alias("owner"))
    subs = inh.join(owner, inh.target == owner.suffix).select(F.col("owner").alias("fqn"), F.lit("subclass").alias("role"), F.col("source").alias("other")).distinct()
    return inh.select(F.col("source").alias("fqn"), F.lit("base").alias("role"), F.col("target").alias("other")).unionByName(subs)


def class_hierarchy(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(fqn, base_classes, subclasses) as sorted arrays for the classes (fqn) of `of`, a stated list."""
    wanted = class_links(edges).join(of.select("fqn").distinct(), "fqn")
    own = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("other"))))
    return wanted.groupBy("fqn").agg(own("base").alias("base_classes"), own("subclass").alias("subclasses"))


def index_summary(files: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of an index run, one row per table."""
    one = lambda df, what, c: df.agg(c.alias("n")).select(F.lit(what).alias("what"), "n")
    return (
        one(files, "files", F.count("*")).unionByName(one(chunks, "chunks", F.count_distinct("chunk_id"))).unionByName(one(nodes, "nodes", F.count_distinct("id"))).unionByName(one(edges, "edges", F.count_distinct("edge_id")))
    )
