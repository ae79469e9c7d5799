"""Intent and search term of a question, as Column expressions that stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that decide an intent, in the order of the rules.
LOCATE = ["where is", "find", "locate", "which file", "what file"]
ASK = ["who", "where", "which", "what"]
SEARCH = ["search for", "find keyword", "contains string", "contains keyword"]
DEPEND = ["depends on", "who calls", "which classes use", "where is ... used", "used by", "caller of", "calls of"]
DEFINED = ["defined", "implemented", "located"]
FLOW = ["call flow", "trace", "lifecycle", "execution flow", "calls", "calling", "flow of", "call"]
NOT_FLOW = ["routing", "auth", "authentication", "connection", "database", "db"]
DESIGN = ["architecture", "relationship", "interact", "registered", "registration", "structure", "design", "interaction", "dependency injection"]
DEFINITION = ["defined", "definition", "implemented", "located", "show class", "where is"]
BROAD = ["routing", "auth", "authentication", "connection", "flow", "architecture", "database"]
STOP = ["what", "where", "how", "who", "find", "locate", "search", "explain", "defined"]


def has(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def detect_intent(question: Column) -> Column:
    """The first rule that holds for the question in lower case; all tests are for substrings."""
    q = F.lower(question)
    return (
        F.when(has(q, ["@"]), "DECORATOR_LOOKUP")
        .when(has(q, [".py", "file"]) & has(q, LOCATE), "FILE_LOOKUP")
        .when(has(q, ["import"]) & has(q, ASK), "IMPORT_LOOKUP")
        .when(has(q, SEARCH), "KEYWORD_SEARCH")
        .when(has(q, DEPEND) & ~(has(q, ["where is"]) & has(q, DEFINED)), "DEPENDENCY")
        .when(has(q, FLOW), "CALL_FLOW")
        .when(has(q, ["how does"]) & ~has(q, NOT_FLOW), "CALL_FLOW")
        .when(has(q, DESIGN), "ARCHITECTURE")
        .when(has(q, DEFINITION), "SYMBOL_LOOKUP")
        .when(has(q, ["explain"]), F.when(has(q, BROAD), "GENERAL").otherwise("SYMBOL_LOOKUP"))
        .when(question.isNotNull(), "GENERAL")
    )


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _restored(term: Column, question: Column) -> Column:
    """The term with the case of its first occurrence in the question."""
    at = F.instr(F.lower(question), term)
    return F.when(at > 0, F.substring(question, at, F.length(term))).otherwise(term)


def query_term(intent: Column, question: Column) -> Column:
    """What to look for: by the intent's pattern, else the first word of three letters or more that is no stop word,
    else the question itself."""
    low = F.lower(question)
    word = r"\b([A-Za-z0-9_\.\-\/]+)\b"
    words = F.regexp_extract_all(question, F.lit(word), 1)
    file_word = F.get(F.filter(words, lambda w: F.endswith(F.lower(w), F.lit(".py"))), 0)
    file = F.coalesce(file_word, _nonempty(F.regexp_extract(low, r"(?:find|locate|where is|file)\s+([A-Za-z0-9_\.\-\/]+)", 1)))
    imported = F.coalesce(_nonempty(F.regexp_extract(low, r"imports?\s+([A-Za-z0-9_\.]+)", 1)), _nonempty(F.regexp_extract(low, r"([A-Za-z0-9_\.]+)\s+imported", 1)))
    decorator = _nonempty(F.regexp_extract(question, r"@[A-Za-z0-9_\.\/]+(?:\(\)?)?", 0))
    keyword = _nonempty(F.regexp_extract(low, r"(?:search for|keyword|string)\s+([A-Za-z0-9_\.\-]+)", 1))
    first = F.get(F.filter(F.transform(words, F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(STOP)), 0)
    own = (
        F.when(intent == "FILE_LOOKUP", file).when(intent == "IMPORT_LOOKUP", imported).when(intent == "DECORATOR_LOOKUP", decorator)
        .when(intent == "KEYWORD_SEARCH", _restored(keyword, question))
    )
    return F.coalesce(own, _restored(first, question), question)
