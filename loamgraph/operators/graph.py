"""The knowledge graph: nodes, edge statistics, neighbours, reverse dependencies, graph context. Batches of symbols are
DataFrames and meet the edges by equi-joins; the first edges per symbol are kept by a partial limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators.index import latest_edges
from loamgraph.operators.search import first


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """(id, type, file_path): each id once, as first indexed."""
    w = Window.partitionBy("id").orderBy(F.col("indexed_at").asc_nulls_last(), "type", "file_path")
    return nodes.where("id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").select("id", "type", "file_path")


def edge_stats(edges: DataFrame) -> DataFrame:
    """Per relation: edges, resolved and unresolved ones, and different ends."""
    return latest_edges(edges).groupBy("relation").agg(
        F.count("*").alias("edges"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets")
    )


def neighbours(edges: DataFrame, symbols: DataFrame, limit: int | None = 20, once: bool = False) -> DataFrame:
    """(symbol, rank, node, relation, direction, ord): undirected neighbours in the order of arrival; duplicates stay, an
    edge from a symbol to itself counts once. `once`: the edges are known to hold each edge_id once."""
    e = (edges if once else latest_edges(edges)).where("source is not null or target is not null")
    s = symbols.select("symbol").distinct()
    out = e.join(s, e.source == s.symbol).select("symbol", F.col("target").alias("node"), "relation", F.lit("out").alias("direction"), "ord", "edge_id")
    into = e.where("not (source <=> target)").join(s, F.col("target") == s.symbol).select("symbol", F.col("source").alias("node"), "relation", F.lit("in").alias("direction"), "ord", "edge_id")
    both = out.unionByName(into)
    if limit is None:
        return both
    return first(both, "symbol", ["ord", "edge_id"], limit).select("symbol", "rank", "node", "relation", "direction", "ord")


def connected(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, node): different neighbours."""
    return neighbours(edges, symbols, None).where("node is not null").select("symbol", "node").distinct()


def reverse_dependencies(edges: DataFrame, targets: DataFrame, symbols: DataFrame, once: bool = False) -> DataFrame:
    """(target, ord, fqn, type, file, line, relation): the definitions of all sources of edges to the targets."""
    e = edges if once else latest_edges(edges)
    t = targets.select(F.col("symbol").alias("target")).distinct()
    return e.join(t, "target").join(symbols, e.source == symbols.fqn).select("target", e.edge_id, e.ord, "fqn", "type", "file", "line", F.concat(F.lit("reverse_"), "relation").alias("relation"))


def graph_context(edges: DataFrame, symbols_wanted: DataFrame, symbols: DataFrame, limit: int = 10, per_neighbour: int = 5, once: bool = False) -> DataFrame:
    """(graph_source, rank, symbol_name, relation, file_path, chunk_type, text): code of the neighbours. Neighbours are
    found by full name, or by own name where the graph has only that; those without code are left out."""
    n = neighbours(edges, symbols_wanted, limit, once).where("node is not null")
    full = symbols.select(F.col("fqn").alias("node"), F.lit(0).alias("pref"), "chunk_id", "file", "type", "text")
    own = symbols.where("not (name <=> fqn)").select(F.col("name").alias("node"), F.lit(1).alias("pref"), "chunk_id", "file", "type", "text")
    found = n.join(full.unionByName(own), "node")
    kept = first(found, ["symbol", "rank"], ["pref", "chunk_id"], per_neighbour, "r2")
    return kept.select(F.col("symbol").alias("graph_source"), "rank", F.col("node").alias("symbol_name"), "relation", F.col("file").alias("file_path"), F.col("type").alias("chunk_type"), "chunk_id", "text")
