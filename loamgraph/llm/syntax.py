"""Source files that do not parse, by derivatives of their token streams.

Defined results: the language follows the extension (lower-cased; from the path where `ext` is null), files of other
extensions and null texts are not judged; an empty or blank code file is valid, an empty JSON text isn't; a byte order
mark at the start is ignored; brackets and elements more than 200 deep are taken as invalid (the limit of Python's own
tokenizer, used for scripts as well); repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import ast
import functools
import re
import sys
import warnings
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import grammars, lexers
from loamgraph.llm.derivatives import EMPTY, Grammar

LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".json": "json"}
CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")
GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")  # beside elements, type parameters of a function show themselves so
ANGLES = re.compile(r">{1,3}=?")
CALLS_PER_CHARACTER = 40  # more than one token of any grammar nests
RESTRICTED = frozenset(("return", "break", "continue", "yield"))


@dataclass(frozen=True)
class Verdict:
    valid: bool
    reason: str = ""  # token, truncated, conflict
    at: int = 0


@functools.cache
def grammar(language: str) -> Grammar:
    if language == "python":
        return Grammar(grammars.PYTHON, "file")
    if language == "json":
        return Grammar(grammars.JSON, "value")
    return Grammar(grammars.ecmascript(language in ("typescript", "tsx"), language in ("jsx", "tsx")), "module")


def _stream(g: Grammar, tokens, start: int) -> tuple[int, int]:
    """(last derivative, place of the token that emptied it or -1)."""
    state, memo, ids = start, g.memo, g.tokens
    for kind, at in tokens:
        t = ids.get(kind)
        if t is None:
            return EMPTY, at
        nxt = memo.get(state << 10 | t)
        if nxt is None:
            nxt = g.derive(state, t)
        if nxt == EMPTY:
            return EMPTY, at
        state = nxt
    return state, -1


def _python(text: str) -> Verdict:
    g = grammar("python")
    lex = lexers.Python(text)
    state, at = _stream(g, lex.tokens(), g.fresh())
    if at >= 0:
        return Verdict(False, "token", at)
    if not g.nullable(state):
        return Verdict(False, "truncated", len(text))
    done = 0
    while done < len(lex.parts):  # nested ones are added as they are found
        a, b = lex.parts[done]
        done += 1
        inner = lexers.Python(text)
        state, at = _stream(g, inner.tokens(a, b, True), g.ref("fexpr"))
        if at >= 0 or not g.nullable(state):
            return Verdict(False, "token", at if at >= 0 else b)
    return Verdict(True)


def _json(text: str) -> Verdict:
    g = grammar("json")
    state, at = _stream(g, lexers.json_tokens(text), g.fresh())
    if at >= 0:
        return Verdict(False, "token", at)
    return Verdict(True) if g.nullable(state) else Verdict(False, "truncated", len(text))


class _Script:
    """ECMAScript needs the state to read its text: whether a slash divides or begins an expression, whether a `<` compares
    or opens an element, and where a semicolon is inserted, is what the derivative of the language so far allows."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.g = text, grammar(language)
        self.jsx = language in ("jsx", "tsx")

    def try_(self, state: int, kind: str) -> int:
        t = self.g.tokens.get(kind)
        if t is None:
            return EMPTY
        v = self.g.memo.get(state << 10 | t)
        return self.g.derive(state, t) if v is None else v

    def angles(self, state: int, op: str) -> int:
        """Closing angle brackets may be one operator or the ends of several type lists: the union of both languages."""
        ways = [self.try_(state, op)]
        for i in range(1, len(op)):
            s = self.try_(state, op[:i])
            if s:
                ways.append(self.angles(s, op[i:]))
        return self.g.alt(ways)

    def verdict(self) -> Verdict:
        text, n, g, try_ = self.text, len(self.text), self.g, self.try_
        state, at, newline, last = g.fresh(), 0, False, ""
        braces: list[str] = []  # "" an ordinary brace, "`" one of a template
        tags: list[str] = []
        opening = None  # OPEN or CLOSE while its name is awaited
        if text.startswith("﻿"):
            at = 1
        if text.startswith("#!", at):
            at = max(text.find("\n", at), 0) or n
        while True:
            if self.jsx and try_(state, "TEXT"):
                m = lexers.JSX_TEXT.match(text, at)
                if m:
                    state, at = try_(state, "TEXT"), m.end()
                if at >= n:
                    return Verdict(False, "truncated", n)
                if text.startswith("</", at):
                    state, last, opening, at, newline = try_(state, "CLOSE"), "CLOSE", "CLOSE", at + 2, False
                    continue
                if text[at] == "<":
                    state, last, opening, at, newline = try_(state, "OPEN"), "OPEN", "OPEN", at + 1, False
                    continue
                if text[at] != "{":
                    return Verdict(False, "token", at)
            # white space and comments
            while at < n:
                c = text[at]
                if c in "\n\r  ":
                    newline = True
                    at += 1
                elif c == "/" and text.startswith("/*", at):
                    end = text.find("*/", at + 2)
                    if end < 0:
                        return Verdict(False, "truncated", at)
                    newline = newline or "\n" in text[at:end]
                    at = end + 2
                else:
                    m = lexers.JS_SPACE.match(text, at)
                    if not m or m.end() == at:
                        break
                    at = m.end()
            if at >= n:
                break
            c, kind, end, ahead = text[at], "", at + 1, []
            if self.jsx and try_(state, "TAG"):
                m = lexers.JSX_TAG.match(text, at)
                if m:
                    kind, end = "TAG", m.end()
                    if opening == "OPEN":
                        tags.append(m[0])
                    elif opening == "CLOSE" and (not tags or tags.pop() != m[0]):
                        return Verdict(False, "token", at)
                    opening = None
            if not kind and opening and c == ">":
                if opening == "OPEN":
                    tags.append("")
                elif not tags or tags.pop() != "":
                    return Verdict(False, "token", at)
                kind, opening = ">", None
            if not kind and self.jsx and c in "\"'" and try_(state, "ATTR"):
                m = lexers.JSX_ATTR.match(text, at)
                if m:
                    kind, end = "ATTR", m.end()
            if not kind and self.jsx and c == "/" and last in ("TAG", "ATTR", "}") and text.startswith("/>", at) and try_(state, "/"):
                kind = "/"
                if tags and try_(try_(state, "/"), ">"):
                    tags.pop()
            if not kind and c == "`":
                m = lexers.TEMPLATE.match(text, at + 1)
                if not m:
                    return Verdict(False, "truncated", at)
                kind, end = ("TEMPLATE" if m[1] == "`" else "HEAD"), m.end()
            if not kind and c == "}" and braces and braces[-1] == "`":
                m = lexers.TEMPLATE.match(text, at + 1)
                if not m:
                    return Verdict(False, "truncated", at)
                kind, end = ("TAIL" if m[1] == "`" else "MIDDLE"), m.end()
            if not kind and c == "/":
                ahead = ["/=", "/"] if text.startswith("/=", at) else ["/"]
                m = lexers.REGEX.match(text, at)
                if m and (len(set(m[1])) < len(m[1]) or not set(m[1]) <= set("dgimsuvy")):
                    m = None
                kind = next((k for k in ahead if try_(state, k)), "")
                if not kind and m:
                    kind, end = "REGEX", m.end()
                elif kind:
                    end = at + len(kind)
                else:
                    kind = "ERR"
            if not kind and c == ">":
                kind = ANGLES.match(text, at)[0]
                if len(kind) > 1 and not self.angles(state, kind):
                    kind = ">"
                end = at + len(kind)
            if not kind and c == "<" and self.jsx and (not try_(state, "<") or (try_(state, "OPEN") and not GENERIC.match(text, at))):
                s = state
                if not try_(s, "OPEN") and newline:
                    s = try_(s, "ASI")
                if s and try_(s, "OPEN"):
                    state, at, last, opening, newline = try_(s, "OPEN"), at + 1, "OPEN", "OPEN", False
                    continue
            if not kind:
                m = lexers.JS_TOKEN.match(text, at)
                if not m:
                    kind = "ERR"
                else:
                    end, group = m.end(), m.lastgroup
                    if group == "name":
                        w = m[0]
                        kind = "PRIVATE" if w[0] == "#" else w if w in lexers.JS_WORDS else "NAME"
                    elif group == "number":
                        b = lexers.JS_BIGINT.match(text, at)
                        end = max(end, b.end()) if b else end
                        kind = "NUMBER" if not re.compile(r"[\w$]").match(text, end) else "ERR"
                    elif group == "string":
                        kind = "STRING" if not re.search(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?!\{[0-9a-fA-F]+\}|[0-9a-fA-F]{4})|[1-9]|0\d)", m[0]) else "ERR"
                    else:
                        kind = m[0]
            # semicolons that the newline rule puts in
            nxt = EMPTY
            if newline and (last in RESTRICTED or (kind in ("++", "--") and try_(state, "ASI"))):
                s = try_(state, "ASI")
                nxt = try_(s, kind) if s else EMPTY
            if not nxt and not (newline and last == "throw") and not (newline and kind == "=>"):
                nxt = self.angles(state, kind) if c == ">" and len(kind) > 1 else try_(state, kind)
            if not nxt and (newline or kind == "}") and (s := try_(state, "ASI")):
                nxt = try_(s, kind)
                if not nxt and kind in ("/", "ERR") and c == "/":
                    m = lexers.REGEX.match(text, at)
                    if m and (nxt := try_(s, "REGEX")):
                        kind, end = "REGEX", m.end()
            if not nxt:
                return Verdict(False, "token", at)
            if kind in ("{", "HEAD"):
                braces.append("`" if kind == "HEAD" else "")
            elif kind == "TAIL" or (kind == "}" and braces):
                braces.pop()
            state, at, last, newline = nxt, end, kind, False
        if g.nullable(state) or g.nullable(try_(state, "ASI")):
            return Verdict(True)
        return Verdict(False, "truncated", n)


def _judged(text: str, language: str) -> Verdict:
    if language == "python":
        return _python(text)
    if language == "json":
        return _json(text)
    return _Script(text, language).verdict()


def check(text: str, language: str) -> Verdict:
    """Whether a text belongs to a language, and where it leaves it. Derivatives of texts nested very deep nest as many calls of
    the interpreter, which are then allowed; the terms of the attempt are forgotten, as it may have left some half done."""
    try:
        v = _judged(text, language)
    except RecursionError:
        grammar(language)._reset()
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(usual + CALLS_PER_CHARACTER * (len(text) + 1000))
        try:
            v = _judged(text, language)
        finally:
            sys.setrecursionlimit(usual)
            grammar(language)._reset()
    if not v.valid and v.reason == "token" and CONFLICT.match(text[text.rfind("\n", 0, v.at) + 1 :]):
        return Verdict(False, "conflict", v.at)
    return v


def confirmed(text: str, language: str, v: Verdict) -> Verdict:
    """The exact check that follows for Python: what the running interpreter parses isn't flagged."""
    if v.valid or language != "python":
        return v
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return v
    return Verdict(True)


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, language, valid, reason, line_no, token): one row per judged file."""
    ext = F.lower(F.coalesce("ext", F.regexp_extract("file_path", r"(\.[^./]+)$", 1)))
    src = files.select("file_id", "repo", "file_path", ext.alias("ext"), "text").where(F.col("ext").isin(*LANGUAGES) & F.col("text").isNotNull())

    def run(batches):
        for b in batches:
            langs, ok, reasons, lines, toks = [], [], [], [], []
            for ext, text in zip(b.column("ext").to_pylist(), b.column("text").to_pylist()):
                lang = LANGUAGES[ext]
                v = confirmed(text, lang, check(text, lang))
                langs.append(lang)
                ok.append(v.valid)
                reasons.append(v.reason or None)
                lines.append(None if v.valid else text.count("\n", 0, v.at) + 1)
                toks.append(None if v.valid else text[v.at : v.at + 40].split("\n")[0])
            keep = [b.column(c) for c in ("file_id", "repo", "file_path")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs), pa.array(ok), pa.array(reasons, pa.string()), pa.array(lines, pa.int32()), pa.array(toks, pa.string())], ["file_id", "repo", "file_path", "language", "valid", "reason", "line_no", "token"])

    return src.mapInArrow(run, "file_id bigint, repo string, file_path string, language string, valid boolean, reason string, line_no int, token string")


def report(judged: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones by reason, and their share."""
    bad = ~F.col("valid")
    return judged.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(bad).alias("invalid"), F.count_if(bad & (F.col("reason") == "truncated")).alias("truncated"), F.count_if(bad & (F.col("reason") == "conflict")).alias("conflicts"), (F.count_if(bad) / F.count("*")).alias("invalid_share")
    )


def broken_chunks(judged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per chunk_type (lower case): chunks, and how many were cut from files that don't parse."""
    bad = judged.where("not valid").select("file_path").distinct().withColumn("bad", F.lit(True))
    kinds = chunks.select("chunk_id", "file_path", F.lower("chunk_type").alias("chunk_type")).dropDuplicates(["chunk_id"])
    return kinds.join(bad, "file_path", "left").groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("bad", F.lit(False))).alias("broken"))
