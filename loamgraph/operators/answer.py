"""From ranked context to an answer: budget, prompt, a language model if one is given, else a deterministic answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, PER_CHUNK, EXCERPT = 7000, 1200, 600


def block(c: str = "") -> Column:
    """A context row as text."""
    part = lambda label, col, default: F.concat(F.lit(f"{label}: "), F.coalesce(col, F.lit(default)), F.lit("\n\n"))
    return F.concat(
        F.lit("\n"), part("FILE", F.col("file_path"), "None"), part("TYPE", F.col("chunk_type"), "None"), part("SYMBOL", F.col("symbol_name"), "None"), part("RELATION", F.col("relation"), "none"),
        F.lit("CODE:\n\n"), F.substring(F.coalesce("text", F.lit("")), 1, PER_CHUNK), F.lit("\n"),
    )


def within_budget(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The leading rows of each question whose blocks fit the budget together; adds `block` and `used`."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("block", block()).withColumn("used", F.sum(F.length("block")).over(w)).where(F.col("used") <= budget)


def prompts(ranked: DataFrame, q: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(qid, prompt): one per question, also for those without context."""
    ctx = within_budget(ranked, budget).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))
    text = F.concat(
        F.lit("Answer a question about a source-code repository from the context only.\nIntent: "), F.col("intent"), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion:\n"), F.col("question"),
        F.lit("\n\nName files and symbols as they are written in the context. Say so where the context does not tell. Parts: Definition, Files, Call Flow, Related Components, Summary.\n"),
    )
    return q.select("qid", "question", "intent").join(ctx, "qid", "left").select("qid", text.alias("prompt"))


def fallback(ranked: DataFrame, q: DataFrame) -> DataFrame:
    """(qid, answer): a deterministic answer from the context rows of a question (at most a dozen)."""
    tick = lambda col: F.concat(F.lit("`"), F.coalesce(col, F.lit("None")), F.lit("`"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "file_path", "symbol_name", "chunk_type", "relation", "graph_source", F.substring(F.coalesce("text", F.lit("")), 1, EXCERPT).alias("excerpt"))))
    g = ranked.groupBy("qid").agg(rows.alias("r"), F.sort_array(F.collect_set(F.when(F.col("file_path") != "", F.col("file_path")))).alias("files"))
    top = F.get("r", 0)
    flow = F.filter("r", lambda x: (x["relation"] != "") & (x["graph_source"] != ""))
    flow_lines = F.transform(flow, lambda x: F.concat(F.lit("- "), tick(x["graph_source"]), F.lit(" **"), x["relation"], F.lit("** "), tick(x["symbol_name"]), F.lit(" (in "), tick(x["file_path"]), F.lit(")")))
    body = F.concat(
        F.lit("### Definition:\n"), tick(top["symbol_name"]), F.lit(" in "), tick(top["file_path"]), F.lit("\n\n### Files:\n"), F.array_join(F.transform("files", lambda f: F.concat(F.lit("- "), tick(f))), "\n"),
        F.lit("\n\n### Call Flow:\n"), F.when(F.size(flow_lines) > 0, F.array_join(flow_lines, "\n")).otherwise("- No relations in the context."),
        F.lit("\n\n### Related Components:\n- "), tick(top["symbol_name"]), F.lit(" (type: "), tick(top["chunk_type"]), F.lit(")\n"), top["excerpt"], F.lit("\n\n### Summary:\n"), F.size("files").cast("string"), F.lit(" file(s) of context.\n"),
    )
    none = F.concat(F.lit("### Definition:\nNo context for the query: **"), F.col("question"), F.lit("**.\n"))
    return q.select("qid", "question").join(g, "qid", "left").select("qid", F.when(F.col("r").isNull(), none).otherwise(body).alias("answer"))


def sources(ranked: DataFrame) -> DataFrame:
    """(qid, rank, file_path, symbol_name, chunk_type, relation, graph_source, score): what an answer cites."""
    return ranked.select("qid", "rank", "file_path", "symbol_name", "chunk_type", "relation", "graph_source", F.coalesce(F.col("score").cast("string"), F.lit("graph")).alias("score"))


def answer_one(prompt: str, default: str, model: Callable[[str], str] | None) -> str:
    """The model's answer; the deterministic one without a model or when it fails."""
    if model is None:
        return default
    try:
        return model(prompt)
    except Exception:  # noqa: BLE001
        return default
