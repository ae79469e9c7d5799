"""From Python source to facts: one parse per file, all facts of a file in one narrow pass.

A fact is a row tagged by `kind`:
chunk (class, method `Class.m`, top-level function), symbol, import, decorator, base, contains, call, assign, return. A file that
doesn't parse gives the classes, functions and imports that can be read line by line, and a row of kind error. Null texts
give an error row as well. Defs under if/try count, those inside functions don't (their calls do, as the inner name's).
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import names as N

FIELDS = ["kind", "fqn", "name", "type", "parent", "line", "pos", "text", "docstring", "value", "items", "returns"]
DDL = "kind string, fqn string, name string, type string, parent string, line int, pos int, text string, docstring string, value string, items array<string>, returns string"
TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
KINDS = frozenset(("chunk", "symbol", "import", "decorator", "base", "contains", "call", "assign", "return", "error"))
USES = frozenset(("call", "assign", "return"))
NAMED = USES | {"base", "decorator"}  # with imports wanted, `returns` of these is what the last import of the name's first part names, `text` the last wildcard import's module
LINE = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)|^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+([\w, \t*]+)|import[ \t]+([\w., \t]+))")
#: Lines that are one call without arguments, perhaps bound to a name; a run of them is cut out before the parse (see `_Visitor.folded`).
_NAME = rf"(?!(?:__debug__|{'|'.join(keyword.kwlist)})\b)[A-Za-z_]\w*"
PLAIN = re.compile(rf"^(?P<indent>[ \t]+)(?:{_NAME} = )?{_NAME}(?:\.{_NAME})*\(\)\n(?:(?P=indent)(?:{_NAME} = )?{_NAME}(?:\.{_NAME})*\(\)\n)+", re.M | re.A)
STATEMENTS = (ast.Module, ast.stmt, ast.excepthandler, ast.match_case)
LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del))
STAND_IN = "_folded_calls_"
BATCH_ROWS = 20_000


def relative(module: str, dots: int, rest: str) -> str:
    """The module that a relative import names, counted from the importing module's own parts."""
    parts = [p for p in module.split(".") if p]
    kept = parts[: max(0, len(parts) - dots)]
    return ".".join([*kept, *([rest] if rest else [])])


class _Visitor:
    def __init__(self, source: str, module: str, kinds: frozenset[str]) -> None:
        self.source, self.module, self.kinds, self.rows = source.encode("utf-8", "replace"), module, kinds, []
        self.under = 0  # compound statements around the place
        lines = source.split("\n")
        lengths = map(len, lines) if source.isascii() else (len(line.encode("utf-8", "replace")) for line in lines)
        self.starts = list(accumulate((n + 1 for n in lengths), initial=0))
        self.n = 0
        self.runs: dict[int, list[str]] = {}  # by first line, the lines that a stand-in stands for
        self.ends: dict[int, int] = {}  # by first line, the offset where they end
        self.via: dict[str, str] = {}
        self.wild: str | None = None
        self.met: set[int] = set()

    def folded(self, source: str) -> str | None:
        """The source with a stand-in for each run of plain call lines of one indent, its other lines left empty; None if
        that isn't safe or pays nothing. Where the stand-in is a statement of its own on its line, so is each line of the
        run; `scope` counts those it meets as such, and if it doesn't meet all, the whole source is parsed. A file with line
        joining, form feeds or a declared encoding isn't folded."""
        if "\\\n" in source or "\f" in source or STAND_IN in source or any("coding" in x for x in source.split("\n", 2)[:2]):
            return None

        def fold(m: re.Match) -> str:
            run = m[0].split("\n")[:-1]
            first = fold.line = fold.line + source.count("\n", fold.at, m.start())
            fold.at = m.start()
            self.runs[first] = run
            self.ends[first] = self.starts[first + len(run) - 1] - 1
            return f"{m['indent']}{STAND_IN}()" + "\n" * len(run)

        fold.line, fold.at = 1, 0
        whole = PLAIN.sub(fold, source)
        return whole if self.runs else None

    def run(self, lines: list[str], line: int, fn: str, cls: str | None) -> None:
        """What `scope` finds in such lines: a binding where there is one, then the call."""
        call, assign, n, add = "call" in self.kinds, "assign" in self.kinds, self.n, self.rows.append
        via, wild = self.via, self.wild
        for i, x in enumerate(lines, line):
            var, eq, name = x.strip().rpartition(" = ")
            name = name[:-2]
            if eq:
                n += 1
                if assign:
                    add(("assign", fn, var, None, cls, i, n, wild, None, name, None, via.get(name.partition(".")[0])))
            n += 1
            if call:
                add(("call", fn, None, None, cls, i, n, wild, None, name, None, via.get(name.partition(".")[0])))
        self.n = n

    def text(self, node: ast.AST) -> str:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.ends.get(node.end_lineno) or self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.source[a:b].decode("utf-8", "ignore")

    def add(self, kind: str, fqn=None, name=None, type=None, parent=None, line=None, text=None, docstring=None, value=None, items=None, returns=None) -> None:  # noqa: A002
        self.n += 1
        if kind in self.kinds:
            if kind in NAMED:
                text, returns = self.wild, self.via.get((name if kind == "decorator" else value).partition(".")[0])
            elif kind == "import":
                if name == "*":
                    self.wild = value
                else:
                    self.via[name] = value
            self.rows.append((kind, fqn, name, type, parent, line, self.n, text, docstring, value, items, returns))

    def imports(self, tree: ast.AST) -> None:
        todo = [tree]
        for node in todo:  # level by level; expressions hold no statements
            todo += [x for f in ("body", "handlers", "orelse", "finalbody", "cases") for x in getattr(node, f, None) or () if isinstance(x, STATEMENTS)] if isinstance(node, STATEMENTS) else []
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.add("import", name=a.asname or a.name, value=a.name, type="module", line=node.lineno)
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                base = relative(self.module, node.level, node.module or "") if node.level else node.module or ""
                for a in node.names:
                    if a.name == "*":
                        self.add("import", name="*", value=base, type="wildcard", line=node.lineno)
                    else:
                        self.add("import", name=a.asname or a.name, value=f"{base}.{a.name}" if base else a.name, type="symbol", line=node.lineno)

    def body(self, nodes: list[ast.stmt], path: list[str], cls: str | None) -> None:
        """Definitions at module or class level, also under compound statements, however many follow each other as elif."""
        stack = [(n, 0) for n in reversed(nodes)]
        while stack:
            node, under = stack.pop()
            self.under += under
            if isinstance(node, ast.ClassDef):
                self.klass(node, path, cls)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(node, path, cls)
            else:
                inner = [x for field in ("body", "orelse", "finalbody") for x in getattr(node, field, []) or []] + [x for h in getattr(node, "handlers", []) or [] for x in h.body]
                stack += [(x, 1) for x in reversed(inner)]
            self.under -= under

    def fqn(self, path: list[str]) -> str:
        return ".".join([*([self.module] if self.module else []), *path])

    def decorators(self, node, fqn: str, kind: str) -> list[str]:
        raw = ["@" + self.text(d) for d in node.decorator_list]
        for r in raw:
            self.add("decorator", name=r.split("(")[0].strip().removeprefix("@"), fqn=fqn, type=kind, line=node.lineno, value=r)
        return raw

    def docstring(self, node) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            raw = self.text(first.value)
            for q in ('"""', "'''", '"', "'"):
                if raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
                    return raw[len(q) : -len(q)].strip()
            return raw
        return None

    def told(self, node) -> tuple[str | None, str | None]:
        """Documentation and text of a definition, where a kind that is wanted has them."""
        chunk = "chunk" in self.kinds
        return self.docstring(node) if chunk or "symbol" in self.kinds else None, self.text(node) if chunk else None

    def klass(self, node: ast.ClassDef, path: list[str], cls: str | None) -> None:
        own = [*path, node.name]
        fqn = self.fqn(own)
        bases = [self.text(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        decs = self.decorators(node, fqn, "class")
        plain = not decs and not self.under and not path
        doc, text = self.told(node)
        self.add("symbol", fqn=fqn, name=node.name, type="class", parent=cls, line=node.lineno, docstring=doc, items=bases)
        self.add("chunk", fqn=fqn, name=".".join(own), type="class", line=node.lineno, text=text, docstring=doc, items=decs, value="direct" if plain else None)
        self.add("contains", fqn=fqn, parent=cls, type="class")
        for b in bases:
            self.add("base", fqn=fqn, value=b, line=node.lineno)
        self.body(node.body, own, fqn)

    def function(self, node, path: list[str], cls: str | None) -> None:
        own = [*path, node.name]
        fqn, kind = self.fqn(own), "method" if cls else "function"
        a = node.args
        plain = [*a.posonlyargs, *a.args, *a.kwonlyargs]
        params = [self.text(p) for p in plain] if "symbol" in self.kinds else []
        doc, text = self.told(node)
        decs = self.decorators(node, fqn, kind)
        direct = not decs and not self.under and len(path) < 2
        returns = self.text(node.returns) if node.returns else None
        self.add("symbol", fqn=fqn, name=node.name, type=kind, parent=cls, line=node.lineno, docstring=doc, items=params, returns=returns)
        self.add("chunk", fqn=fqn, name=".".join(own), type=kind, line=node.lineno, text=text, docstring=doc, items=decs, returns=returns, value="direct" if direct else None)
        self.add("contains", fqn=fqn, parent=cls, type=kind)
        if self.kinds & USES:
            self.scope(node.body, fqn, cls)

    def scope(self, nodes: list, fn: str, cls: str | None) -> None:
        """Calls, assignments of calls and returns in order: an assignment binds before the call on its right side. The nodes
        to visit are kept in a list, so that long chains of operators don't nest calls."""
        defs = (ast.FunctionDef, ast.AsyncFunctionDef)
        stack = [(n, fn) for n in reversed(nodes)]
        while stack:
            node, at = stack.pop()
            if self.runs and isinstance(node, ast.Expr) and (run := self.runs.get(node.lineno)) and node.end_lineno == node.lineno:
                self.met.add(node.lineno)
                self.run(run, node.lineno, at, cls)
                continue
            if isinstance(node, defs):
                inner = f"{cls}.{node.name}" if cls else self.fqn([node.name])
                stack += [(n, inner) for n in reversed(node.body)]
                continue
            if isinstance(node, ast.ClassDef):
                stack += [(n, at) for n in reversed(node.body) if not isinstance(n, defs)]
                continue
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call):
                self.add("assign", fqn=at, name=node.targets[0].id, value=self.text(node.value.func), parent=cls, line=node.lineno)
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and isinstance(node.value, ast.Call):
                self.add("assign", fqn=at, name=node.target.id, value=self.text(node.value.func), parent=cls, line=node.lineno)
            elif isinstance(node, ast.Return) and node.value is not None:
                self.add("return", fqn=at, value=self.text(node.value), parent=cls, line=node.lineno)
            elif isinstance(node, ast.Call):
                self.add("call", fqn=at, value=self.text(node.func), parent=cls, line=node.lineno)
            inside = []
            for f in node._fields:
                x = getattr(node, f, None)
                if x.__class__ is list:
                    inside += [(n, at) for n in x if isinstance(n, ast.AST) and n.__class__ not in LEAVES]
                elif isinstance(x, ast.AST) and x.__class__ not in LEAVES:
                    inside.append((x, at))
            stack += reversed(inside)


def _walk(v: _Visitor, tree: ast.Module) -> None:
    if "import" in v.kinds and b"import" in v.source:
        v.imports(tree)
    v.body(tree.body, [], None)


def facts_of(source: str | None, module: str, kinds: frozenset[str] = KINDS) -> list[tuple]:
    """The facts of one file, of the kinds wanted. A file beyond what the interpreter's parser can nest gives what one gives
    that doesn't parse."""
    whole = (source or "").replace("\r\n", "\n").replace("\r", "\n")
    v = _Visitor(whole, module, kinds)
    if source is None:
        v.add("error", value="no text")
        return v.rows
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if kinds & USES and (short := v.folded(whole)):
                try:
                    _walk(v, ast.parse(short.encode("utf-8", "replace")))
                    if len(v.met) == len(v.runs):
                        return v.rows
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    pass
                v = _Visitor(whole, module, kinds)
            tree = ast.parse(v.source)
        _walk(v, tree)
        return v.rows
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        v.rows, v.n, v.under = [], 0, 0
        v.add("error", value=str(e)[:200], line=getattr(e, "lineno", None))
        stack: list[tuple[int, str, str]] = []
        for i, line in enumerate(v.source.decode().split("\n"), 1):
            m = LINE.match(line)
            if m and m[3]:
                depth = len(m[1].expandtabs())
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                if m[2] == "class" or not any(k == "def" for _, k, _ in stack):
                    kind = "class" if m[2] == "class" else "method" if stack else "function"
                    path = [n for _, _, n in stack] + [m[3]]
                    cls = v.fqn(path[:-1]) if stack else None
                    v.add("symbol", fqn=v.fqn(path), name=m[3], type=kind, parent=cls, line=i, items=[])
                    v.add("contains", fqn=v.fqn(path), parent=cls, type=kind)
                stack.append((depth, m[2], m[3]))
            elif m and m[4]:
                dots = len(m[4]) - len(m[4].lstrip("."))
                base = relative(module, dots, m[4].lstrip(".")) if dots else m[4]
                for x in m[5].split(","):
                    w = x.split()
                    if w:
                        v.add("import", name=w[-1], value=base if w[0] == "*" else f"{base}.{w[0]}", type="wildcard" if w[0] == "*" else "symbol", line=i)
            elif m and m[6]:
                for x in m[6].split(","):
                    w = x.split()
                    if w:
                        v.add("import", name=w[-1], value=w[0], type="module", line=i)
        return v.rows


def fact_batches(batches: Iterable[pa.RecordBatch], kinds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (path, module, text) to batches of facts. Texts become Python strings one at a time, and facts leave before they are many."""
    paths, mods, rows = [], [], []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in FIELDS]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(mods, pa.string()), *[pa.array(c, t) for c, t in zip(cols, TYPES)]], ["file_path", "module", *FIELDS])

    for b in batches:
        for i in range(b.num_rows):
            p, m, t = (c[i].as_py() for c in b.columns)
            found = facts_of(t, m, kinds)
            rows += found
            paths += [p] * len(found)
            mods += [m] * len(found)
            if len(rows) >= BATCH_ROWS:
                yield batch()
                paths, mods, rows = [], [], []
    yield batch()


def facts(files: DataFrame, kinds: Iterable[str] = KINDS) -> DataFrame:
    """(file_path, module, FIELDS...) of the Python rows of (rel_path, file_path, repo, ext, text), of the kinds wanted; modules
    begin with the repository's name, so that names of different repositories differ."""
    kinds = frozenset(kinds)
    module = F.concat_ws(".", "repo", N.module_name(F.col("rel_path")))
    src = files.where("ext = '.py' and file_path is not null").select("file_path", module.alias("module"), "text")

    return src.mapInArrow(lambda batches: fact_batches(batches, kinds), f"file_path string, module string, {DDL}")


def chunks(facts_: DataFrame, mode: str = "full") -> DataFrame:
    """Chunks of code. `reference` keeps only what stands directly in a module or a top-level class and has no decorators."""
    c = facts_.where("kind = 'chunk'")
    return c.where("value = 'direct'") if mode == "reference" else c


def legacy_graph(code: str, path: str) -> list[tuple]:
    """Facts of one piece of code on its own, as a module named legacy."""
    return facts_of(code, "legacy")


def raw_calls(facts_: DataFrame) -> DataFrame:
    """Unresolved calls by the bare function name."""
    return facts_.where("kind = 'call'").select("file_path", N.last_part(F.col("fqn")).alias("source"), F.col("value").alias("target"), F.lit("calls").alias("relation"), F.lit("low").alias("confidence"), "line", "pos")
