"""Searches over the index. A batch of terms is a stated, bounded list: each table is read once, every row is tested against
the list, and the first `limit` rows per term are kept by a partial limit before the shuffle. Terms are compared in lower
case without outer white space; an empty term matches everything; null columns match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.operators import index as I

BLOCK_TERMS = 1000


def _hits(df: DataFrame, terms: list[str], columns: list[Column]) -> DataFrame:
    """Adds `term` for each term that is a substring of one of the columns. Longer lists go in blocks, a scan for each."""
    terms = list(dict.fromkeys(terms))
    if len(terms) > BLOCK_TERMS:
        blocks = [_hits(df, terms[i : i + BLOCK_TERMS], columns) for i in range(0, len(terms), BLOCK_TERMS)]
        out = blocks[0]
        for x in blocks[1:]:
            out = out.unionByName(x)
        return out
    wanted = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    low = [F.lower(c) for c in columns]

    def test(t: Column) -> Column:
        clean = F.lower(F.trim(t))
        out = F.coalesce(F.contains(low[0], clean), F.lit(False))
        for c in low[1:]:
            out = out | F.coalesce(F.contains(c, clean), F.lit(False))
        return out

    return df.withColumn("term", F.explode(F.filter(wanted, test)))


def first(df: DataFrame, key: str | list[str], order: list, limit: int, rank: str = "rank") -> DataFrame:
    """The first rows per key, numbered from 1."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


SYMBOL = ["term", "rank", "fqn", "name", "type", "file", "line"]


def search_symbols(symbols: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Exact name if there is one (case counts), else substrings of the full or own name."""
    exact = symbols.where(F.col("fqn").isin(list(dict.fromkeys(terms)))).withColumn("term", F.col("fqn"))
    partial = _hits(symbols, terms, [F.col("fqn"), F.col("name")]).join(exact.select("term").distinct(), "term", "left_anti")
    return first(exact.unionByName(partial), "term", ["ord", "chunk_id"], limit).select(*SYMBOL, "ord", "chunk_id", "text")


def search_kind(symbols: DataFrame, terms: list[str], kinds: list[str], limit: int = 10) -> DataFrame:
    return first(_hits(symbols.where(F.col("type").isin(kinds)), terms, [F.col("fqn"), F.col("name")]), "term", ["ord", "chunk_id"], limit).select(*SYMBOL)


def search_files(files: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    return first(_hits(I.file_index(files), terms, [F.col("rel_path")]), "term", ["ord", "file_id"], limit).select("term", "rank", F.col("rel_path").alias("file_path"), F.concat(F.lit("# File: "), "rel_path").alias("text"), "ord")


def search_decorators(decorators: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    bare = [t.strip()[1:] if t.strip().startswith("@") else t for t in terms]
    return first(_hits(decorators, bare, [F.col("decorator")]), "term", ["ord", "chunk_id", "decorator"], limit).select("term", "rank", F.col("target").alias("symbol_name"), "type", F.col("file").alias("file_path"), "line", F.concat(F.lit("decorated_by_"), "decorator").alias("relation"), "ord")


def search_imports(imports: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    text = F.concat(F.lit("# File: "), "file", F.lit(" imports "), "imported_fqn", F.lit(" as "), "local_name")
    return first(_hits(imports, terms, [F.col("imported_fqn"), F.col("local_name")]), "term", ["ord", "edge_id"], limit).select("term", "rank", F.col("file").alias("file_path"), F.col("imported_fqn").alias("symbol_name"), text.alias("text"), "ord")


def keyword_search(files: DataFrame, terms: list[str], limit: int = 5) -> DataFrame:
    """The first line with the term in each Python file, with two lines before and fourteen after; the first files."""
    hits = first(_hits(files.where("ext = '.py'"), terms, [F.col("text")]), "term", ["ord", "file_id"], limit)
    lines = F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lower(F.trim("term")))), True).cast("int")
    start = F.greatest(at - 2, F.lit(1))
    snippet = F.array_join(F.slice(lines, start, at + 15 - start), "\n")
    return hits.select("term", "rank", F.col("rel_path").alias("file_path"), F.concat(F.lit("keyword_"), "term").alias("symbol_name"), at.alias("line"), snippet.alias("text"), "ord").where("line > 0")


def python_block(text: Column, line: Column) -> Column:
    """The block that begins at a line (from 1): up to the first later line that is not blank and is indented less, or as
    much and begins a definition, decorator or import. Empty if there is no such line."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    indent = lambda x: F.length(F.regexp_extract(x, r"^\s*", 0))
    rest = F.slice(lines, line + 1, F.size(lines))
    base = indent(F.get(lines, line - 1))
    stops = lambda x: (F.trim(x) != "") & ((indent(x) < base) | ((indent(x) == base) & x.rlike(r"^\s*(def |class |@|import |from )")))
    stop = F.array_position(F.transform(rest, lambda x: F.coalesce(stops(x), F.lit(False))), True).cast("int")
    n = F.when(stop > 0, stop).otherwise(F.size(rest) + 1)
    return F.when((line >= 1) & (line <= F.size(lines)), F.array_join(F.slice(lines, line, n), "\n")).otherwise("")


def symbol_chunks(symbols: DataFrame, names: list[str] | DataFrame, limit: int = 5) -> DataFrame:
    """Exact own names, scored 1. Names are a stated list, or a table with the column term of any size."""
    found = symbols.join(names.select("term").distinct(), F.col("name") == F.col("term")) if isinstance(names, DataFrame) else symbols.where(F.col("name").isin(list(dict.fromkeys(names)))).withColumn("term", F.col("name"))
    return first(found, "term", ["ord", "chunk_id"], limit).select(*SYMBOL, F.lit(1.0).alias("score"), "text")
