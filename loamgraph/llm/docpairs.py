"""Functions paired with their documentation.

1. Own documentation: a scanner reads each function or method row: the comment block directly above the definition (above
   its decorators, or between them and it) and, in Python, its docstring. It works on broken code too, as it parses no
   more than the signature and the first statement.
2. Class hierarchies: the rows of classes give each class its bases; methods without usable documentation of their own
   take that of the method they override, by joins that climb one level a round, through all bases, until nothing is left
   to resolve. The nearest level counts, within a level the bases in the order they are written.
3. What then has no documentation that says more than the name is dropped.

Defined results: rows are taken by `chunk_type` in any letter case; null chunk_type, null text or null chunk_id give
nothing; of repeated rows of one chunk_id the last indexed one counts (ties: the smaller text hash); a null symbol_name
is read from the text; `docstring` is not trusted and not used; bases that can't be told apart are not climbed;
a method visits
each class once, which ends cyclic bases; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import cut

# Words and forms that document nothing.
PLACEHOLDER = re.compile(
    r"^\W*+(?:to-?dos?|fix-?me|xxx|tb[da]|n/?a|none|null|wip|hack|placeholder|stub|lorem ipsum.*|\.{2,}|"
    r"(?:todo|fixme|xxx)?\W*(?:please )?(?:write|add|insert|fill in|complete) ?(?:the |some |a |your )?(?:docs?|docstrings?|documentation|descriptions?|summary|comments?|text|me|this)?(?: here| later)?|"
    r"(?:todo|fixme|xxx)?\W*(?:please )?(?:document|describe|explain) ?(?:me|this|it)?(?: function| method)?(?: here| later)?|"
    r"(?:the |your |a )?(?:docstring|doc ?string|documentation|description|doc|docs|comment|summary|text)(?: line)?(?: goes| comes| belongs)?(?: here)?|"
    r"(?:one[- ]line )?summary(?: line)?|see above|see below|missing (?:docstring|docs|documentation)|no (?:docs|docstring|documentation|description)(?: yet| available)?|"
    r"(?:auto[- ]?(?:added|generated)|generated|empty|default) (?:stub|method stub|docstring|comment|doc)\W*(?:please (?:describe|document) this)?)\W*$",
    re.I,
)
DIRECTIVE = re.compile(
    r"^\W*+(?:noqa\b|type:\s*ignore|pylint\s*:|fmt\s*:|flake8|mypy\s*:|isort\s*:|ruff\s*:|yapf\s*:|black\s*:|pyright\s*:|pragma\b|nosec\b|nosonar\b|eslint\b|eslint-|@ts-|ts-(?:ignore|expect|nocheck)|tslint\s*:|jshint\b|jslint\b|globals?\s|"
    r"prettier-|istanbul\b|c8\b|v8\b|webpack|@formatter|@format\b|@flow|@jsx|@__PURE__|#__PURE__|sourceMappingURL|region\b|endregion\b|-\*-|!/|vim?\s*:|coding[:=]|cspell|biome-|deno-|stylelint)",
    re.I,
)
TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|parameter|returns?|throws|exception|raises?|type|typedef|see|since|version|author|private|public|protected|internal|override|deprecated|template|property|async|static|inheritdoc)\b|:(?:param|arg|type|returns?|rtype|raises?|keyword|var|ivar|cvar)\b[^:]*:)\s*(?:\{[^}]*\})?\s*", re.I)
SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword args|other parameters|see also|references)\s*:?\s*$", re.I)
UNDERLINE = re.compile(r"^\W*$")
FILLER = frozenset("a an the this that of for to in on and or with from by is it its as at be do does function functions method methods func def class helper handler implementation wrapper routine procedure returns return get gets".split())
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
CODE_LINE = re.compile(
    r"^\s*(?:(?:const|let|var)\s+[\w{\[$].*|[\w.$\[\]'\"]+\s*(?:[-+*/|&]|//|\*\*)?=(?!=)\s*\S.*|(?:return|yield|await|raise|throw|del|assert|print|delete)\b[ (]?[\w.$'\"()\[\]{}, :%+*/=-]*;?|"
    r"[\w.$]+\(.*\)\s*[;{:]?|(?:if|elif|else if|while|for|with|switch|try|except|catch|else|def|class|function|async)\b.*[:{;)]|(?:import|from|export)\s+[\w.{*].*|[{}()\[\];,]+|@[\w.]+(?:\(.*\))?|(?:pass|break|continue)\s*;?|.*[;{}]\s*)$"
)
PROSE_RETURN = re.compile(r"^\s*(?:return|yield|raise|throw|print|delete|assert)s?\s+(?:the|a|an|all|its|each|whatever|this|that|if|when|true|false|every|any|how)\b.*\w", re.I)
STRING = re.compile(r"([A-Za-z]{0,2})(\"\"\"|'''|\"|')")
DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)", re.M)
JS_DEF = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:public[ \t]+|private[ \t]+|protected[ \t]+|static[ \t]+|readonly[ \t]+|abstract[ \t]+|override[ \t]+)*(?:async[ \t]+)?(?:function\b[ \t]*\*?[ \t]*([\w$]*)|(?:const|let|var)[ \t]+([\w$]+)|(?:get[ \t]+|set[ \t]+|\*[ \t]*)?([\w$#]+)[ \t]*(?:<|\(|[=:]))")


def is_code(line: str) -> bool:
    return bool(CODE_LINE.match(line)) and not PROSE_RETURN.match(line)


def meaningful(doc: str | None, name: str | None, comment: bool = False) -> bool:
    """Whether a documentation text says more than the name of what it documents."""
    if not doc:
        return False
    lines, skip, base = [], False, 0
    for raw in doc.split("\n"):
        line = raw.strip()
        if UNDERLINE.match(line):
            if not line:
                continue
            skip = False if not skip else skip
            continue
        indent = len(raw) - len(raw.lstrip())
        if SECTION.match(line):
            skip, base = True, indent
            continue
        if skip and indent > base:
            m = re.match(r"\*{0,2}[\w.]+\s*(?:\([^)]*\))?\s*:\s*(.*)$", line)
            line = m[1] if m else line
        else:
            skip = False
        if DIRECTIVE.match(line):
            continue
        tag = TAG.match(line)
        if tag:
            line = line[tag.end() :]
            if re.match(r"[@\\](?:param|arg|argument|parameter|property|template)", tag[0].strip(), re.I):
                line = re.sub(r"^\[?[\w.$=]+\]?\s*[-:]?\s*", "", line)
        if PLACEHOLDER.match(line) or (comment and is_code(line)):
            continue
        lines.append(line)
    text = " ".join(lines).strip()
    if not text or PLACEHOLDER.match(text):
        return False
    own = {w.lower() for w in PART.findall(re.split(r"\.", name or "")[-1])}
    stems = own | {w + "s" for w in own} | {w + "es" for w in own} | {w[:-1] for w in own if w.endswith("s")}
    words = [w.lower() for w in WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text))]
    more = [w for w in words if w not in stems and w not in FILLER]
    return len(more) >= 2 or (len(more) == 1 and len(more[0]) > 24)


def _string_at(s: str, i: int) -> tuple[str, str, int] | None:
    """(prefix, content, end) of the literal at i."""
    m = STRING.match(s, i)
    if not m or m[1].lower() not in ("", "r", "u", "b", "f", "br", "rb", "fr", "rf", "t", "tr", "rt"):
        return None
    q, j = m[2], m.end()
    while j < len(s):
        if s[j] == "\\":
            j += 2
        elif s.startswith(q, j):
            return m[1].lower(), s[m.end() : j], j + len(q)
        elif len(q) == 1 and s[j] == "\n":
            return None
        else:
            j += 1
    return None


def _after_signature(s: str, i: int) -> int:
    """Index after the colon that ends the signature beginning at i; -1 if there is none."""
    depth = 0
    while i < len(s):
        c = s[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#":
            i = s.find("\n", i)
            if i < 0:
                return -1
            continue
        elif c in "\"'":
            lit = _string_at(s, i)
            if not lit:
                return -1
            i = lit[2]
            continue
        elif c == ":" and depth <= 0:
            return i + 1
        elif c == "\n" and depth <= 0:
            return -1
        i += 1
    return -1


BLANK = re.compile(r"(?:[ \t\r\f]*(?:#[^\n]*)?(?:\\\r?)?\n)*[ \t\f]*")


def docstring(s: str, i: int) -> str | None:
    """The docstring of the Python definition whose signature ends at i: string literals alone, neither formatted nor
    bytes, as the first statement."""
    m = BLANK.match(s, i)
    i, parens, parts = m.end(), 0, []
    while i < len(s):
        c = s[i]
        if c == "(":
            if parts:
                return None
            parens, i = parens + 1, i + 1
        elif c in "\"'" or (c.isalpha() and STRING.match(s, i)):
            lit = _string_at(s, i)
            if not lit or "f" in lit[0] or "b" in lit[0] or "t" in lit[0]:
                return None
            parts.append(lit[1])
            i = lit[2]
        elif c == ")" and parens:
            parens, i = parens - 1, i + 1
        elif c in " \t\r\f" or (c == "\n" and parens):
            i += 1
        elif c == "\\" and s.startswith(("\\\n", "\\\r\n"), i):
            i = s.index("\n", i) + 1
        elif c == "#" and parens:
            i = s.find("\n", i)
            if i < 0:
                return None
        else:
            break
    if not parts or parens or (i < len(s) and s[i] not in "\n;#"):
        return None
    return "".join(parts) if len(parts) > 1 else parts[0]


def python_docs(text: str) -> tuple[str | None, str | None, str | None]:
    """(name, docstring, comment block above)."""
    m = DEF.search(text)
    if not m:
        return None, None, None
    above, block = text[: m.start()].split("\n")[:-1], []
    # decorators may span lines; what stands above them, or between them and the definition, documents the function
    best, inside = [], 0
    for line in above:
        s = line.strip()
        if inside:
            inside += sum(s.count(c) for c in "([{") - sum(s.count(c) for c in ")]}")
        elif s.startswith("#"):
            block.append(s.lstrip("#!:").rstrip())
        elif s.startswith("@"):
            inside = max(0, sum(s.count(c) for c in "([{") - sum(s.count(c) for c in ")]}"))
            best, block = best + block, []
        else:
            best, block = [], []
    comment = "\n".join(x[1:] if x.startswith(" ") else x for x in best + block)
    at = _after_signature(text, m.end())
    return m[1], docstring(text, at) if at >= 0 else None, comment


def js_docs(text: str) -> tuple[str | None, str | None]:
    """(name, comment block above)."""
    lines, i, blocks, name = text.split("\n"), 0, [], None
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith("//"):
            blocks.append(s.lstrip("/!").rstrip())
            i += 1
        elif s.startswith("/*"):
            j = i
            while j < len(lines) and "*/" not in (lines[j] if j > i else lines[j].strip()[2:]):
                j += 1
            body = "\n".join(lines[i : j + 1]).strip()
            end = body.find("*/", 2)
            blocks += [re.sub(r"^\s*\*+ ?", "", x) for x in body[2 : end if end > 0 else len(body)].lstrip("*!").split("\n")]
            rest = body[end + 2 :].strip() if end > 0 else ""
            i = j + 1
            if rest:
                m = JS_DEF.match(rest)
                name = m and (m[1] or m[2] or m[3])
                break
        elif not s:
            blocks, i = [], i + 1
        elif s.startswith("@"):
            i += 1
        else:
            m = JS_DEF.match(lines[i])
            name = m and (m[1] or m[2] or m[3])
            break
    return name, "\n".join(x[1:] if x.startswith(" ") else x for x in blocks)


INHERIT = re.compile(r"^\W*+(?:[{@\\]*inherit_?doc\b|(?:docs?|documentation|docstring)? ?(?:is |are )?(?:inherited|see) (?:from |in )?(?:the |its )?(?:base|parent|super)[ -]?class)\W*$", re.I)


def inherits(doc: str | None) -> bool:
    """Whether all that a text says, apart from tags and tool directives, is that the documentation stands in a base class."""
    lines = [x for x in (doc or "").split("\n") if INHERIT.match(x) or not (UNDERLINE.match(x) or TAG.match(x) or DIRECTIVE.match(x))]
    return bool(lines) and all(map(INHERIT.match, lines))


def own_documentation(text: str | None, symbol: str | None, path: str | None) -> tuple[str | None, str | None]:
    """(kind, documentation) of a function row: docstring or comment, whichever says something; None if neither does."""
    if not text:
        return None, None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if (path or "").endswith((".js", ".jsx", ".ts", ".tsx")) or not ((path or "").endswith(".py") or DEF.search(text)):
        name, comment = js_docs(text)
        doc = None
    else:
        name, doc, comment = python_docs(text)
    name = symbol or name
    if not inherits(doc) and meaningful(doc, name):
        return "docstring", doc.strip()
    if not inherits(comment) and meaningful(comment, name, True):
        return "comment", comment.strip()
    return None, None


BASES_PY = re.compile(r"^[ \t]*class\s+\w+\s*\(([^)]*)\)\s*:", re.M)
BASES_JS = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+[\w$]+(?:\s*<[^{]*?>)?\s+extends\s+([\w$.]+)", re.M)


def bases(text: str | None) -> list[str]:
    """Names of a class's bases, without arguments such as metaclass=."""
    if not text:
        return []
    m = BASES_PY.search(text)
    if m:
        return [x.strip().split("[")[0] for x in m[1].split(",") if x.strip() and "=" not in x and "(" not in x and "*" not in x]
    m = BASES_JS.search(text)
    return [m[1]] if m else []


def latest(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per chunk_id: the last indexed."""
    w = Window.partitionBy(key).orderBy(F.col("indexed_at").desc_nulls_last(), F.xxhash64("text"))
    return chunks.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, symbol_name, chunk_type, file_path, kind, documentation, documented_by, levels, text): code with its
    documentation. `levels` 0: its own; otherwise it comes from the method it overrides, so many classes up."""
    kind = F.lower(F.trim("chunk_type"))
    rows = latest(chunks.select("chunk_id", "text", "chunk_type", "symbol_name", "fqn", "file_path", "indexed_at").where(kind.isin("function", "method", "class")))
    src = rows.select("chunk_id", "symbol_name", kind.alias("chunk_type"), "fqn", "file_path", "text")

    def scan(batches):
        for b in batches:
            kinds, docs, supers = [], [], []
            for kind, sym, path, text in zip(*(b.column(c).to_pylist() for c in ("chunk_type", "symbol_name", "file_path", "text"))):
                k, d = own_documentation(text, sym, path) if kind != "class" else (None, None)
                kinds.append(k)
                docs.append(d)
                supers.append(bases(text) if kind == "class" else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(docs, pa.string()), pa.array(supers, pa.list_(pa.string()))], [*b.schema.names, "kind", "documentation", "bases"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    scanned, _ = cut(src.mapInArrow(scan, ddl + ", kind string, documentation string, bases array<string>"), "docs")
    out = ["chunk_id", "symbol_name", "chunk_type", "file_path", "kind", "documentation", "documented_by", "levels", "text"]
    own = scanned.where("kind is not null").select(*out[:6], F.col("chunk_id").alias("documented_by"), F.lit(0).alias("levels"), "text")

    # classes by place: the same file first, then the only class of that name in the repository
    repo = F.split("file_path", "/")[1]
    classes = scanned.where("chunk_type = 'class' and symbol_name is not null and fqn is not null").select(F.element_at(F.split("symbol_name", "\\."), -1).alias("name"), "fqn", "file_path", repo.alias("repo"), "bases").dropDuplicates(["fqn"])
    here = classes.groupBy("file_path", F.col("name").alias("base")).agg(F.min("fqn").alias("f1"))
    only = classes.groupBy("repo", F.col("name").alias("base")).agg(F.min("fqn").alias("f2"), F.count("*").alias("n")).where("n = 1").drop("n")
    up = (
        classes.select("fqn", "file_path", "repo", F.posexplode("bases").alias("i", "b")).withColumn("base", F.element_at(F.split("b", "\\."), -1))
        .join(here, ["file_path", "base"], "left").join(only, ["repo", "base"], "left")
        .withColumn("super", F.coalesce("f1", "f2")).where("super is not null and super <> fqn")
        .groupBy("fqn", "super").agg(F.min("i").alias("i"))
    )
    up, _ = cut(up, "supers")
    method = scanned.where("chunk_type = 'method' and fqn is not null and fqn like '%.%'")
    cls, name = F.regexp_replace("fqn", "\\.[^.]*$", ""), F.regexp_extract("fqn", "[^.]*$", 0)
    given = method.where("kind is not null").select(cls.alias("at"), name.alias("name"), F.struct("chunk_id", "kind", "documentation").alias("g")).groupBy("at", "name").agg(F.min("g").alias("g"))
    open_ = method.where("kind is null").select("chunk_id", cls.alias("cls"), name.alias("name"), cls.alias("at"), F.array().cast("array<int>").alias("way"))
    found, visited, level = [], None, 0
    while True:
        level += 1
        step = open_.join(up.withColumnRenamed("fqn", "at"), "at").select("chunk_id", "cls", "name", F.col("super").alias("at"), F.concat("way", F.array("i")).alias("way")).where("at <> cls")
        step = step.groupBy("chunk_id", "cls", "name", "at").agg(F.min("way").alias("way"))
        if visited is not None:
            step = step.join(visited, ["chunk_id", "at"], "left_anti")
        step, _ = cut(step.join(given, ["at", "name"], "left"), "climb")
        if step.isEmpty():
            break
        hit = step.where("g is not null").groupBy("chunk_id").agg(F.min_by("g", "way").alias("g"))
        found.append(hit.select("chunk_id", F.col("g.kind").alias("kind"), F.col("g.documentation").alias("documentation"), F.col("g.chunk_id").alias("documented_by"), F.lit(level).alias("levels")))
        open_ = step.where("g is null").join(hit, "chunk_id", "left_anti").select("chunk_id", "cls", "name", "at", "way")
        seen = step.select("chunk_id", "at")
        visited = seen if visited is None else visited.unionByName(seen)
    if found:
        inherited = found[0]
        for f in found[1:]:
            inherited = inherited.unionByName(f)
        own = own.unionByName(scanned.drop("kind", "documentation").join(inherited, "chunk_id").select(*out))
    return own
