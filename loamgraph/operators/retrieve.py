"""Retrieval for a batch of questions: intent, routing to a strategy, scoring, de-duplication, ranking.

A batch is a stated list of questions (a user's, or a fixed set). Intent and term come from the same Column
expressions for one question and for many; each strategy is one plan for all its questions, and all are one union. Context
rows carry `seq`, their place in what the strategy gave, which decides ties as insertion order would."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import intent as IN
from loamgraph.functions import names as N
from loamgraph.operators import graph as G
from loamgraph.operators import search as S
from loamgraph.operators import vector as V
from loamgraph.operators.index import latest_edges
from loamgraph.session import cut

CONTEXT = ["qid", "file_path", "symbol_name", "chunk_type", "relation", "graph_source", "score", "line", "text", "seq"]
ALIGNED = {
    "CALL_FLOW": ["calls", "instantiates"],
    "ARCHITECTURE": ["inherits", "imports"],
    "DEPENDENCY": ["calls", "inherits", "imports", "reverse_calls", "reverse_inherits", "reverse_imports"],
}  # fixed values: relations that earn a bonus, by intent
STRATEGY = {
    "FILE_LOOKUP": ("File Index", 0.99, 0.2), "IMPORT_LOOKUP": ("Import Index", 0.99, 0.2), "DECORATOR_LOOKUP": ("Decorator Index", 0.99, 0.2), "KEYWORD_SEARCH": ("Repository Search", 0.9, 0.1),
    "SYMBOL_LOOKUP": ("Symbol Index", 0.95, 0.1), "CALL_FLOW": ("Semantic Call Graph", 0.9, 0.4), "ARCHITECTURE": ("Knowledge Graph", 0.85, 0.85), "DEPENDENCY": ("Reverse Graph Traversal", 0.9, 0.3), "GENERAL": ("Vector Search", 0.7, 0.7),
}  # fixed values: access path and confidence with and without results, by intent
FURTHER = {"SYMBOL_LOOKUP": "Vector Search (Fallback)", "CALL_FLOW": "Graph Expansion (Calls)", "ARCHITECTURE": "Vector Search", "GENERAL": "Graph Expansion"}  # fixed values: what a strategy adds; the first two only when no symbol, or one, was found
SIZE = 12


def questions(spark, asked: Iterable[str]) -> DataFrame:
    """(qid, question, intent, term) of a stated list."""
    df = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    return analysed(df)


def analysed(df: DataFrame) -> DataFrame:
    q = F.col("question")
    return df.withColumn("intent", IN.detect_intent(q)).withColumn("term", IN.query_term(F.col("intent"), q))


def _row(df: DataFrame, **cols) -> DataFrame:
    kinds = {"file_path": "string", "symbol_name": "string", "chunk_type": "string", "relation": "string", "graph_source": "string", "score": "double", "line": "int", "text": "string", "seq": "long"}
    return df.select("qid", *[(cols.get(c) if c in cols else F.lit(None)).cast(kinds[c]).alias(c) for c in CONTEXT[1:]])


Embed = Callable[[list[str]], Sequence[Sequence[float]]]


class Tables:
    """What retrieval reads. Symbols and edges are read by many strategies: their de-duplicated form is written once to the
    shared folder instead of being made again in each plan, or was written when the index was made (`once`). `vectors` (point_id, embedding) are the
    embeddings made then, by `embed`, of the chunks with these ids; without them the lexical hash is made on the way."""

    def __init__(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, decorators: DataFrame, edges: DataFrame, once: bool = False, vectors: DataFrame | None = None, embed: Embed = V.hash_model) -> None:
        self.files, self.imports, self.decorators, self.vectors, self.embed = files, imports, decorators, vectors, embed
        self.symbols = symbols if once else cut(symbols, "symbols")[0]
        self.edges = edges if once else cut(latest_edges(edges).select("edge_id", "source", "target", "relation", "ord"), "edges")[0]


def retrieve_context(symbols: DataFrame, q: DataFrame, vectors: DataFrame | None = None, embed: Embed = V.hash_model) -> DataFrame:
    """(qid, rank, fqn, name, type, file, line, score, text) for questions (qid, question, k): definitions whose own name is
    the first capitalised word, with score 1; where there are none, the k nearest by vector."""
    named = q.withColumn("term", F.regexp_extract("question", "[A-Z][A-Za-z0-9_]*", 0))
    names = [r["term"] for r in named.where("term <> ''").select("term").distinct().collect()]  # of a stated list of questions
    cols = ["qid", "rank", "fqn", "name", "type", "file", "line", "score", "text"]
    exact = S.symbol_chunks(symbols, names).join(F.broadcast(named), "term").select(cols)
    rest = q.join(F.broadcast(exact.select("qid").distinct()), "qid", "left_anti").select(F.col("qid").alias("query"), "question", "k")
    if vectors is None:
        hits = V.hash_topk(symbols, "chunk_id", "text", rest.select("query", "question"), 5)
    else:
        asked = [(r["query"], r["question"]) for r in rest.collect()]  # of a stated list of questions
        dense = embed([t for _, t in asked]) if asked else []
        hits = V.topk(vectors, "point_id", "embedding", [(str(i), list(map(float, v))) for (i, _), v in zip(asked, dense)], 5).select(F.col("query").cast("long").alias("query"), "rank", F.col("id").cast("long").alias("chunk_id"), "cosine")
    near = hits.join(F.broadcast(rest.select("query", "k")), "query").where("rank <= k")
    vector = symbols.join(F.broadcast(near), "chunk_id").select(F.col("query").alias("qid"), "rank", "fqn", "name", "type", "file", "line", F.col("cosine").alias("score"), "text")  # at most k rows a question
    return exact.unionByName(vector)


def context(t: Tables, q: DataFrame) -> DataFrame:
    """All context rows of all questions (columns `CONTEXT`). The list of questions is small and stated; their terms are
    read to the driver once and stand as constants in the plans."""
    rows = q.select("qid", "question", "intent", "term").collect()
    spark = q.sparkSession
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["intent"], []).append(r)

    def asked(*intents: str) -> tuple[list[str], DataFrame]:
        own = [(r["qid"], r["term"]) for i in intents for r in by.get(i, [])]
        return [x for _, x in own], spark.createDataFrame(own, "qid long, term string")

    out = []
    c = F.col
    terms, df = asked("FILE_LOOKUP")
    if terms:
        out.append(_row(S.search_files(t.files, terms).join(F.broadcast(df), "term"), file_path=c("file_path"), symbol_name=c("file_path"), chunk_type=F.lit("file"), text=c("text"), seq=c("rank")))
    terms, df = asked("IMPORT_LOOKUP")
    if terms:
        out.append(_row(S.search_imports(t.imports, terms).join(F.broadcast(df), "term"), file_path=c("file_path"), symbol_name=c("symbol_name"), chunk_type=F.lit("import"), relation=F.lit("imports"), text=c("text"), seq=c("rank")))
    terms, df = asked("DECORATOR_LOOKUP")
    if terms:
        bare = df.withColumn("term", F.when(F.startswith(F.trim("term"), F.lit("@")), F.substring(F.trim("term"), F.lit(2), F.length("term"))).otherwise(c("term")))
        out.append(_row(S.search_decorators(t.decorators, terms).join(F.broadcast(bare), "term"), file_path=c("file_path"), symbol_name=c("symbol_name"), chunk_type=c("type"), relation=c("relation"), line=c("line"), seq=c("rank")))
    terms, df = asked("KEYWORD_SEARCH")
    if terms:
        out.append(_row(S.keyword_search(t.files, terms).join(F.broadcast(df), "term"), file_path=c("file_path"), symbol_name=c("symbol_name"), chunk_type=F.lit("keyword_match"), text=c("text"), seq=c("rank")))
    # symbol rows, for every strategy that begins with a symbol
    terms, df = asked("SYMBOL_LOOKUP", "CALL_FLOW", "ARCHITECTURE", "DEPENDENCY")
    if terms:
        hits, _ = cut(S.search_symbols(t.symbols, terms).join(F.broadcast(df), "term"), "hits")
        out.append(_row(hits, file_path=c("file"), symbol_name=c("fqn"), chunk_type=c("type"), line=c("line"), text=c("text"), seq=c("rank")))
        first = hits.where("rank = 1").select("qid", "term", "fqn")
        around = [("CALL_FLOW", 8), ("ARCHITECTURE", 10)]
        for name, limit in around:
            ids = [r["qid"] for r in by.get(name, [])]
            if ids:
                own = first.where(c("qid").isin(ids)).select("qid", c("fqn").alias("graph_source"))
                ctx = G.graph_context(t.edges, own.select(c("graph_source").alias("symbol")), t.symbols, limit, once=True)
                out.append(_row(own.join(ctx, "graph_source"), file_path=c("file_path"), symbol_name=c("symbol_name"), chunk_type=c("chunk_type"), relation=c("relation"), graph_source=c("graph_source"), text=c("text"), seq=F.lit(1_000_000) + c("rank") * 1000))
        ids = [r["qid"] for r in by.get("DEPENDENCY", [])]
        if ids:
            own = first.where(c("qid").isin(ids)).select("qid", "term", c("fqn").alias("graph_source"))
            targets = own.select("qid", "graph_source", F.explode(F.array_distinct(F.array("graph_source", "term"))).alias("target"))
            deps = G.reverse_dependencies(t.edges, targets.select(c("target").alias("symbol")), t.symbols, once=True)
            out.append(_row(targets.join(deps, "target"), file_path=c("file"), symbol_name=c("fqn"), chunk_type=c("type"), relation=c("relation"), graph_source=c("graph_source"), line=c("line"), seq=F.lit(2_000_000) + c("ord")))
    # by exact own name, else by vector: GENERAL and ARCHITECTURE three rows, a symbol lookup without symbols two
    wanted = [(r["qid"], r["question"], 3) for i in ("GENERAL", "ARCHITECTURE") for r in by.get(i, [])]
    lookups = {r["qid"]: r for r in by.get("SYMBOL_LOOKUP", [])}
    if lookups:
        met = {r["qid"] for r in hits.where(c("qid").isin(list(lookups))).select("qid").distinct().collect()}
        wanted += [(i, r["question"], 2) for i, r in lookups.items() if i not in met]
    if wanted:
        found, _ = cut(retrieve_context(t.symbols, spark.createDataFrame(wanted, "qid long, question string, k int"), t.vectors, t.embed), "hits")
        out.append(_row(found, file_path=c("file"), symbol_name=c("name"), chunk_type=c("type"), score=c("score"), line=c("line"), text=c("text"), seq=F.lit(3_000_000) + c("rank")))
        ids = [r["qid"] for r in by.get("GENERAL", [])]
        if ids:
            own = found.where(c("qid").isin(ids)).select("qid", c("fqn").alias("graph_source"), c("rank").alias("hit"))
            ctx = G.graph_context(t.edges, own.select(c("graph_source").alias("symbol")), t.symbols, 3, once=True)
            out.append(_row(own.join(ctx, "graph_source"), file_path=c("file_path"), symbol_name=c("symbol_name"), chunk_type=c("chunk_type"), relation=c("relation"), graph_source=c("graph_source"), text=c("text"), seq=F.lit(4_000_000) + c("hit") * 100_000 + c("rank") * 1000))
    empty = spark.createDataFrame([], "qid long, file_path string, symbol_name string, chunk_type string, relation string, graph_source string, score double, line int, text string, seq long")
    for x in out:
        empty = empty.unionByName(x)
    return empty


def score(question: Column, intent: Column, symbol: Column, relation: Column, base: Column) -> Column:
    """Similarity or 0.5, 0.4 more if the question has the symbol (or its last part), 0.3 more if the relation suits the
    intent."""
    q = F.lower(question)
    named = (F.length(symbol) > 0) & (F.contains(q, F.lower(symbol)) | F.contains(q, F.lower(N.last_part(symbol))))
    aligned = F.lit(False)
    for name, relations in ALIGNED.items():
        aligned = aligned | ((intent == name) & relation.isin(relations))
    zero = F.lit(0.0)
    return F.coalesce(base, F.lit(0.5)) + F.when(named, 0.4).otherwise(zero) + F.when(aligned, 0.3).otherwise(zero)


def ranked(ctx: DataFrame, q: DataFrame, size: int | None = SIZE, stated: bool = True) -> DataFrame:
    """Context rows scored, each (file, symbol, relation) of a question once (the first), best first; nulls are equal."""
    key = Window.partitionBy("qid", "file_path", "symbol_name", "relation").orderBy("seq", "text", "line")
    once = ctx.withColumn("__k", F.row_number().over(key)).where("__k = 1").drop("__k")
    asked = q.select("qid", "question", "intent")
    scored = once.join(F.broadcast(asked) if stated else asked, "qid")  # a stated list of questions is small, a table may not be
    scored = scored.withColumn("ranking_score", F.round(score(F.col("question"), F.col("intent"), F.col("symbol_name"), F.col("relation"), F.col("score")), 6))
    if size is None:
        return scored
    return S.first(scored, "qid", [F.col("ranking_score").desc(), "seq", "file_path", "symbol_name", "relation"], size)


def metrics(rows: DataFrame) -> DataFrame:
    """Per question: context rows by kind."""
    kind = F.when(F.col("chunk_type") == "file", "file").when(F.contains("relation", F.lit("decorated")), "decorator").when(F.coalesce("line", F.lit(0)) != 0, "symbol").otherwise("vector")
    k = rows.withColumn("__k", kind)
    return k.groupBy("qid").agg(*[F.count_if(F.col("__k") == x).alias(f"{x}_rows") for x in ("file", "decorator", "symbol", "vector")])


def confidence(q: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, intent, strategies array<string>, confidence): confidence depends on whether the strategy found anything (for dependencies: more
    than one row, for call flows: graph rows). Rows from symbols have `seq` below a million."""
    found = rows.groupBy("qid").agg(F.count("*").alias("n"), F.count("graph_source").alias("g"), F.count_if(F.col("seq") < 1_000_000).alias("s"))
    j = q.select("qid", "intent").join(found, "qid", "left")
    n, g, s = (F.coalesce(c, F.lit(0)) for c in ("n", "g", "s"))
    ok = F.when(F.col("intent") == "CALL_FLOW", g > 0).when(F.col("intent") == "DEPENDENCY", n > 1).otherwise(n > 0)
    pick = lambda i: F.coalesce(*[F.when(F.col("intent") == k, F.lit(v[i])) for k, v in STRATEGY.items()])
    adds = F.when(F.col("intent") == "SYMBOL_LOOKUP", s == 0).when(F.col("intent") == "CALL_FLOW", s > 0).otherwise(True)
    further = F.coalesce(*[F.when((F.col("intent") == k) & adds, F.lit(v)) for k, v in FURTHER.items()])
    return j.select("qid", "intent", F.array_compact(F.array(pick(0), further)).alias("strategies"), F.when(ok, pick(1)).otherwise(pick(2)).alias("confidence"))
