"""Queries of the engine's operators over whole tables, each with the same thing in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions import intent as IN
from loamgraph.functions import names as N
from loamgraph.operators import answer as A
from loamgraph.operators import graph as G
from loamgraph.operators import history as H
from loamgraph.operators import index as I
from loamgraph.operators import parse as P
from loamgraph.operators import resolve as RS
from loamgraph.operators import retrieve as R
from loamgraph.operators import search as S
from loamgraph.operators import text as T
from loamgraph.operators import vector as V
from loamgraph.session import table

TERMS = ["tessera", "merge_cursor", "Cache", "quota", "fernhttp", "normalize", "core.log", "object", "views"]  # a stated set of search terms
QUESTIONS = [
    "Find @retry", "Where is @trace.span used", "Where is cache.py?", "find quota.ts file", "Where is tessera imported?", "Who imports fernhttp?", "Which modules import get_logger", "Search for password", "find keyword Lantern",
    "who calls get_logger", "what depends on BaseModel", "where is object used", "trace merge_cursor", "call flow of normalize", "How does Cache work?", "architecture of the quota module", "relationship between Cache and quota",
    "where is rebuild_profile defined", "Explain Cache", "show class Ledger", "Tell me about Widget", "What is it for", "explain the database connection", "How does routing work?", "structure of views", "definition of tessera",
]  # a stated set of questions

# SQL for the index, shared
_SYM = """ch as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by indexed_at desc nulls last, ord desc nulls last) = 1),
sym as (select fqn, symbol_name as name, lower(chunk_type) as type, module, file_path as file, line_number as line, visibility, docstring, ord, chunk_id, text from ch
 where lower(chunk_type) in ('class', 'method', 'function') and fqn is not null qualify row_number() over (partition by fqn order by ord desc nulls last, chunk_id desc) = 1)"""
_EDG = "edg as (select * from edges where edge_id is not null qualify row_number() over (partition by edge_id order by ord) = 1)"
_TERMS = "terms as (select unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) as term)"
_Q = "q as (select i - 1 as qid, l[i] as question from (select [" + ", ".join("'" + x.replace("'", "''") + "'" for x in QUESTIONS) + f"] as l), unnest(range(1, {len(QUESTIONS) + 1})) as u(i))"


def _any(words: list[str], q: str = "q") -> str:
    return "(" + " or ".join(f"contains({q}, '{w}')" for w in words) + ")"


_INTENT = f"""ask as (select qid, question, lower(question) as q from q),
it as (select qid, question, q, case when contains(q, '@') then 'DECORATOR_LOOKUP' when {_any(['.py', 'file'])} and {_any(IN.LOCATE)} then 'FILE_LOOKUP'
 when contains(q, 'import') and {_any(IN.ASK)} then 'IMPORT_LOOKUP' when {_any(IN.SEARCH)} then 'KEYWORD_SEARCH' when {_any(IN.DEPEND)} and not (contains(q, 'where is') and {_any(IN.DEFINED)}) then 'DEPENDENCY'
 when {_any(IN.FLOW)} then 'CALL_FLOW' when contains(q, 'how does') and not {_any(IN.NOT_FLOW)} then 'CALL_FLOW' when {_any(IN.DESIGN)} then 'ARCHITECTURE' when {_any(IN.DEFINITION)} then 'SYMBOL_LOOKUP'
 when contains(q, 'explain') then case when {_any(IN.BROAD)} then 'GENERAL' else 'SYMBOL_LOOKUP' end else 'GENERAL' end as intent from ask)"""
_W = r"regexp_extract_all(question, '\b([A-Za-z0-9_\.\-\/]+)\b', 1)"
_REST = "case when instr({q}, {t}) > 0 then substring(question, instr({q}, {t}), length({t})) else {t} end"
_TERM = rf"""w as (select *, nullif(list_filter({_W}, lambda x: lower(x) like '%.py')[1], '') as pyw,
 nullif(regexp_extract(q, '(?:find|locate|where is|file)\s+([A-Za-z0-9_\.\-\/]+)', 1), '') as f2, coalesce(nullif(regexp_extract(q, 'imports?\s+([A-Za-z0-9_\.]+)', 1), ''), nullif(regexp_extract(q, '([A-Za-z0-9_\.]+)\s+imported', 1), '')) as im,
 nullif(regexp_extract(question, '@[A-Za-z0-9_\.\/]+(?:\(\)?)?', 0), '') as de, nullif(regexp_extract(q, '(?:search for|keyword|string)\s+([A-Za-z0-9_\.\-]+)', 1), '') as kw,
 list_filter(list_transform({_W}, lambda x: lower(x)), lambda x: length(x) >= 3 and x not in ({", ".join(f"'{s}'" for s in IN.STOP)}))[1] as fw from it),
qt as (select qid, question, intent, coalesce(case intent when 'FILE_LOOKUP' then coalesce(pyw, f2) when 'IMPORT_LOOKUP' then im when 'DECORATOR_LOOKUP' then de when 'KEYWORD_SEARCH' then {_REST.format(q='q', t='kw')} end, {_REST.format(q='q', t='fw')}, question) as term from w)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sym(spark, d):
    return I.symbols(table(spark, d, "chunks"))


# scalars over whole columns -------------------------------------------------------------------------------------------
@query(r"""select file_id, url, regexp_matches(regexp_replace(regexp_replace(url, '^\s+', ''), '\s+$', ''), '^https?://(www\.)?github\.com/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+/?$') as valid,
 array_to_string(list_slice(string_split(regexp_replace(url, '/+$', ''), '/'), -2, -1), '/') as repo_id from (select file_id, case file_id % 4 when 0 then 'https://github.com/acme/' || repo when 1 then ' http://www.github.com/acme/' || repo || '/ ' when 2 then 'https://example.com/' || repo else 'https://github.com/acme/' || rel_path end as url from files)""")
def url_validate(spark, d):
    f = table(spark, d, "files")
    gh = F.lit("https://github.com/acme/")
    m = F.col("file_id") % 4
    url = F.when(m == 0, F.concat(gh, "repo")).when(m == 1, F.concat(F.lit(" http://www.github.com/acme/"), "repo", F.lit("/ "))).when(m == 2, F.concat(F.lit("https://example.com/"), "repo")).otherwise(F.concat(gh, "rel_path"))
    return f.select("file_id", url.alias("url")).select("file_id", "url", N.url_valid(F.col("url")).alias("valid"), N.repo_identifier(F.col("url")).alias("repo_id"))


_MSG = ["Git clone failed: exit 128", "no GitHub URL given", "git not found", "file not available", "Qdrant refused", "lost Connection", "other"]


@query("select event_id, case when contains(m, 'Git clone failed') or contains(m, 'GitHub URL') then 'clone_failed' when contains(lower(m), 'not found') or contains(lower(m), 'not available') then 'git_missing' when contains(m, 'Qdrant') or contains(lower(m), 'connection') then 'store_unavailable' else 'indexing_failed' end as category from (select event_id, [" + ", ".join(f"'{m}'" for m in _MSG) + "][event_id % 7 + 1] || ' ' || event_type as m from events)")
def error_category(spark, d):
    e = table(spark, d, "events")
    m = F.concat(F.element_at(F.array(*[F.lit(x) for x in _MSG]), (F.col("event_id") % 7 + 1).cast("int")), F.lit(" "), "event_type")
    return e.select("event_id", m.alias("m")).select("event_id", N.error_category(F.col("m")).alias("category"))


@query(r"select file_id, regexp_replace(replace(regexp_replace(rel_path, '\.py$', ''), '/', '.'), '(^|\.)__init__$', '') as module from files where ext = '.py'")
def module_name(spark, d):
    return table(spark, d, "files").where("ext = '.py'").select("file_id", N.module_name(F.col("rel_path")).alias("module"))


@query(r"""select chunk_id, rel, case when suffix = '' then base when base = '' then suffix else base || '.' || suffix end as resolved from (select chunk_id, rel, regexp_replace(rel, '^\.+', '') as suffix,
 array_to_string(list_slice(string_split(module, '.'), 1, greatest(len(string_split(module, '.')) - length(regexp_extract(rel, '^\.*', 0)), 0)), '.') as base
 from (select distinct chunk_id, module, repeat('.', cast(chunk_id % 4 + 1 as integer)) || case when chunk_id % 3 = 0 then '' else 'core.log' end as rel from chunks where module is not null and chunk_id is not null))""")
def relative_import(spark, d):
    c = table(spark, d, "chunks").where("module is not null and chunk_id is not null")
    rel = F.concat(F.expr("repeat('.', cast(chunk_id % 4 + 1 as int))"), F.when(F.col("chunk_id") % 3 == 0, "").otherwise("core.log"))
    return c.select("chunk_id", "module", rel.alias("rel")).distinct().select("chunk_id", "rel", N.relative_module(F.col("module"), F.col("rel")).alias("resolved"))


@query(f"with {_SYM} select chunk_id, name, case when starts_with(name, '_') then 'private' when name is not null then 'public' end as visibility from sym")
def visibility(spark, d):
    return _sym(spark, d).select("chunk_id", "name", N.visibility(F.col("name")).alias("visibility"))


@query(r"""with t as (select distinct chunk_id, case chunk_id % 4 when 0 then '\"\"\"' || docstring || ' \"\"\"' when 1 then '''' || docstring || '''' when 2 then 'r\"' || docstring || '\"' else docstring end as lit from chunks where docstring is not null and chunk_id is not null)
 select chunk_id, lit, case when lit like '\"\"\"%' and lit like '%\"\"\"' or lit like '''''''%' and lit like '%''''''' then regexp_replace(regexp_replace(substring(lit, 4, greatest(length(lit) - 6, 0)), '^\s+', ''), '\s+$', '')
 when lit like '\"%' and lit like '%\"' or lit like '''%' and lit like '%''' then regexp_replace(regexp_replace(substring(lit, 2, greatest(length(lit) - 2, 0)), '^\s+', ''), '\s+$', '') else lit end as doc from t""".replace('\\"', '"'))
def docstring_strip(spark, d):
    c = table(spark, d, "chunks").where("docstring is not null and chunk_id is not null")
    m = F.col("chunk_id") % 4
    lit = F.when(m == 0, F.concat(F.lit('"""'), "docstring", F.lit(' """'))).when(m == 1, F.concat(F.lit("'"), "docstring", F.lit("'"))).when(m == 2, F.concat(F.lit('r"'), "docstring", F.lit('"'))).otherwise(F.col("docstring"))
    return c.select("chunk_id", lit.alias("lit")).distinct().select("chunk_id", "lit", N.docstring_strip(F.col("lit")).alias("doc"))


@query("select file_id, string_split(file_path, '/')[-1] as base, length(text) as chars from files")
def doc_stats(spark, d):
    return table(spark, d, "files").select("file_id", N.basename(F.col("file_path")).alias("base"), F.length("text").cast("long").alias("chars"))


@query("select i.id as intent, regexp_replace(i.id, '^([^_]*)_', '\\1 ') as label, printf('%.0f%%', i.c * 100) as confidence from (select unnest([" + ", ".join(f"{{'id': '{k}', 'c': {v[1]}::double}}" for k, v in R.STRATEGY.items()) + "], recursive := true)) i")
def display_format(spark, d):
    rows = spark.createDataFrame([(k, v[1]) for k, v in R.STRATEGY.items()], "intent string, c double")
    return rows.select("intent", N.intent_label(F.col("intent")).alias("label"), F.format_string("%.0f%%", F.col("c") * 100).alias("confidence"))


@query("select 'nodes' as what, type as kind, count(*) as n from nodes group by 2 union all select 'edges', relation, count(*) from edges group by 2")
def graph_scan(spark, d):
    n = table(spark, d, "nodes").groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "kind", "n")
    return n.unionByName(table(spark, d, "edges").groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "kind", "n"))


# scans and index --------------------------------------------------------------------------------------------------------
@query("select file_id, rel_path, ext from files where ext in ('.py', '.js', '.ts', '.tsx', '.jsx') and not regexp_matches(rel_path, '(^|/)(" + "|".join(x.replace(".", r"\.") for x in N.SKIPPED_FOLDERS) + ")/')")
def scan_filter(spark, d):
    return I.file_index(table(spark, d, "files")).select("file_id", "rel_path", "ext")


@query("select 'files' as what, count(*) as n from files union all select 'chunks', count(distinct chunk_id) from chunks union all select 'nodes', count(distinct id) from nodes union all select 'edges', count(distinct edge_id) from edges")
def index_summary(spark, d):
    return I.index_summary(*[table(spark, d, t) for t in ("files", "chunks", "nodes", "edges")])


@query(f"with {_SYM} select fqn, name, type, module, file, line, visibility from sym")
def symbol_index(spark, d):
    return _sym(spark, d).select("fqn", "name", "type", "module", "file", "line", "visibility")


@query(f"with {_SYM} select fqn, name, file, line from sym where type = 'function'")
def function_index(spark, d):
    return _sym(spark, d).where("type = 'function'").select("fqn", "name", "file", "line")


@query(f"with {_EDG} select source as file, target as imported_fqn, string_split(target, '.')[-1] as local_name, edge_id from edg where relation = 'imports' and source is not null and target is not null")
def import_index(spark, d):
    return I.imports(table(spark, d, "edges")).select("file", "imported_fqn", "local_name", "edge_id")


_DEC = rf"""dec as (select name as target, type, file, line, ord, chunk_id, unnest(regexp_extract_all(regexp_extract(text, '(?s)^(.*?)(?:^|\n)[ \t]*(?:async[ \t]+def|def|class)[ \t]', 1), '(?m)^[ \t]*(@[^\r\n]+)', 1)) as raw from sym where file like '%.py' and contains(text, '@')),
dkey as (select regexp_replace(regexp_replace(regexp_replace(string_split(raw, '(')[1], '^\s+', ''), '\s+$', ''), '^@', '') as decorator, target, type, file, line, ord, chunk_id from dec)"""


@query(f"with {_SYM}, {_DEC} select decorator, target, type, file, line, chunk_id from dkey")
def decorator_index(spark, d):
    return I.decorators(table(spark, d, "chunks")).select("decorator", "target", "type", "file", "line", "chunk_id")


@query(f"""with {_EDG}, inh as (select source, target, min(ord) as ord from edg where relation = 'inherits' and source is not null and target is not null group by 1, 2), cls as (select source as fqn, min(ord) as first from inh group by 1),
 suf as (select fqn, first, array_to_string(list_slice(p, i, len(p)), '.') as suffix from (select fqn, first, string_split(fqn, '.') as p, unnest(range(1, len(string_split(fqn, '.')) + 1)) as i from cls)),
 own as (select suffix, fqn as owner from suf qualify row_number() over (partition by suffix order by first, fqn) = 1),
 sub as (select distinct owner as fqn, source as other from inh join own on target = suffix)
 select source as fqn, 'base' as role, target as other from inh union all select fqn, 'subclass', other from sub""")
def class_hierarchy(spark, d):
    return I.class_links(table(spark, d, "edges"))


# searches ---------------------------------------------------------------------------------------------------------------
def _top(hits: str, order: str, limit: int, cols: str) -> str:
    return f"select {cols} from ({hits}) qualify row_number() over (partition by term order by {order}) <= {limit}"


_SUB = "contains(lower(fqn), lower(trim(term))) or contains(lower(name), lower(trim(term)))"


@query(f"with {_SYM}, {_TERMS}, e as (select t.term, s.* from terms t join sym s on s.fqn = t.term), h as (select * from e union all select t.term, s.* from terms t join sym s on ({_SUB}) where t.term not in (select term from e)) " + _top("select * from h", "ord, chunk_id", 10, "term, fqn, type, file, line"))
def search_symbols_partial(spark, d):
    return S.search_symbols(_sym(spark, d), TERMS).select("term", "fqn", "type", "file", "line")


@query(f"with {_SYM}, names as (select distinct fqn as term from sym where type = 'class') select n.term, s.name, s.file, s.line from names n join sym s on s.fqn = n.term")
def search_symbols_exact(spark, d):
    s = _sym(spark, d)
    return s.where("type = 'class'").select(F.col("fqn").alias("term")).distinct().join(s, F.col("term") == s.fqn).select("term", "name", "file", "line")


@query(f"with {_SYM}, {_TERMS} " + _top(f"select t.term, s.* from terms t join sym s on ({_SUB}) where type = 'class'", "ord, chunk_id", 10, "term, fqn, file"))
def search_classes(spark, d):
    return S.search_kind(_sym(spark, d), TERMS, ["class"]).select("term", "fqn", "file")


@query(f"with {_SYM}, {_TERMS} " + _top(f"select t.term, s.* from terms t join sym s on ({_SUB}) where type in ('function', 'method')", "ord, chunk_id", 10, "term, fqn, file"))
def search_functions(spark, d):
    return S.search_kind(_sym(spark, d), TERMS, ["function", "method"]).select("term", "fqn", "file")


@query(f"with {_TERMS}, fi as ({SQL['scan_filter'].replace('select file_id, rel_path, ext', 'select file_id, rel_path, ord')}) " + _top("select t.term, f.* from terms t join fi f on contains(lower(rel_path), lower(trim(term)))", "ord, file_id", 10, "term, rel_path as file_path, '# File: ' || rel_path as text"))
def search_files(spark, d):
    return S.search_files(table(spark, d, "files"), TERMS).select("term", "file_path", "text")


@query(f"with {_SYM}, {_DEC}, t as (select unnest(['retry', 'trace', '@cached', 'property']) as raw_term), terms as (select ltrim(raw_term, '@') as term from t) " + _top("select t.term, k.* from terms t join dkey k on contains(lower(decorator), lower(term))", "ord, chunk_id, decorator", 10, "term, target as symbol_name, type, file as file_path, line, 'decorated_by_' || decorator as relation"))
def search_decorators(spark, d):
    return S.search_decorators(I.decorators(table(spark, d, "chunks")), ["retry", "trace", "@cached", "property"]).select("term", "symbol_name", "type", "file_path", "line", "relation")


@query(f"with {_EDG}, {_TERMS}, imp as (select source as file, target as imported_fqn, string_split(target, '.')[-1] as local_name, ord, edge_id from edg where relation = 'imports' and source is not null and target is not null) " + _top("select t.term, i.* from terms t join imp i on contains(lower(imported_fqn), lower(trim(term))) or contains(lower(local_name), lower(trim(term)))", "ord, edge_id", 10, "term, file as file_path, imported_fqn as symbol_name, '# File: ' || file || ' imports ' || imported_fqn || ' as ' || local_name as text"))
def search_imports(spark, d):
    return S.search_imports(I.imports(table(spark, d, "edges")), TERMS).select("term", "file_path", "symbol_name", "text")


@query(f"""with {_TERMS}, h as (select t.term, f.rel_path, f.ord, f.file_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as l from terms t join files f on ext = '.py' and contains(lower(text), lower(trim(term))) qualify row_number() over (partition by term order by ord, file_id) <= 5),
 p as (select *, list_position(list_transform(l, lambda x: contains(lower(x), lower(trim(term)))), true) as pos from h) select term, rel_path as file_path, cast(pos as integer) as line, array_to_string(list_slice(l, greatest(pos - 2, 1), pos + 14), chr(10)) as text from p where pos > 0""")
def keyword_search(spark, d):
    return S.keyword_search(table(spark, d, "files"), TERMS).select("term", "file_path", "line", "text")


@query(rf"""with {_SYM}, j as (select fqn, file as file_path, line, string_split(replace(f.text, chr(13) || chr(10), chr(10)), chr(10)) as l from sym join (select file_path, text from files where ext = '.py') f on f.file_path = sym.file where sym.file like '%.py'),
 r as (select *, list_slice(l, line + 1, len(l)) as rest, length(regexp_extract(l[line], '^[ \t\n\x0B\f\r]*')) as base from j),
 p as (select *, list_position(list_transform(rest, lambda x: trim(x) <> '' and (length(regexp_extract(x, '^[ \t\n\x0B\f\r]*')) < base or length(regexp_extract(x, '^[ \t\n\x0B\f\r]*')) = base and regexp_matches(x, '^\s*(def |class |@|import |from )'))), true) as stop from r)
 select fqn, file_path, line, case when line between 1 and len(l) then array_to_string(list_slice(l, line, line - 1 + case when stop > 0 then stop else len(rest) + 1 end), chr(10)) else '' end as block from p""")
def python_block(spark, d):
    s = _sym(spark, d).where(F.endswith("file", F.lit(".py"))).select("fqn", F.col("file").alias("file_path"), "line")
    f = table(spark, d, "files").where("ext = '.py'").select("file_path", F.col("text").alias("source"))
    return s.join(f, "file_path").select("fqn", "file_path", "line", S.python_block(F.col("source"), F.col("line")).alias("block"))


@query(f"with {_SYM} select name as term, fqn, file, cast(1.0 as double) as score from sym where name in (select name from sym where type = 'class') qualify row_number() over (partition by name order by ord, chunk_id) <= 5")
def symbol_lookup(spark, d):
    s = _sym(spark, d)
    return S.symbol_chunks(s, s.where("type = 'class'").select(F.col("name").alias("term"))).select("term", "fqn", "file", "score")


# vectors ------------------------------------------------------------------------------------------------------------------
_COS = "round(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 10)"


@query(f"with c as (select point_id as id, cast(vector as double[]) as v from vectors where len(vector) = 64 and point_id is not null and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0), q as (select * from c order by id limit 1) select c.id, {_COS} as cosine from c, q order by cosine desc, c.id limit 5")
def vector_topk(spark, d):
    v = table(spark, d, "vectors")
    ok = v.where((F.size("vector") == 64) & F.col("point_id").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    one = ok.orderBy("point_id").select("point_id", "vector").limit(1).collect()
    return V.topk(v, "point_id", "vector", [(r[0], list(r[1])) for r in one]).select("id", "cosine")


@query(f"with c as (select vec_id as id, cast(embedding as double[]) as v from embeddings where len(embedding) = 64), q as (select * from c where id % 100 = 0) select cast(q.id as varchar) as query, c.id, {_COS} as cosine from c, q qualify row_number() over (partition by q.id order by {_COS} desc, c.id) <= 5")
def vector_topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    asked = [(str(r[0]), list(r[1])) for r in e.where("vec_id % 100 = 0").select("vec_id", "embedding").toLocalIterator()]  # the stated query set, in blocks
    return V.topk(e, "vec_id", "embedding", asked).select("query", "id", "cosine")


@query("with t as (select doc_id as key, cast(('0x' || substr(md5(w), 1, 8)) as bigint) % 384 as bucket from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from documents where text is not null) where w <> ''), f as (select key, bucket, count(*) as tf from t group by 1, 2), n as (select key, sqrt(sum(tf * tf)) as norm from f group by 1) select key, cast(bucket as integer) as bucket, round(tf / norm, 6) as weight from f join n using (key)")
def hash_embed(spark, d):
    return V.hash_embed(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("key", "bucket", F.round("weight", 6).alias("weight"))


@query("select coalesce(len(vector), -1) as dims, count(*) as n, count(distinct chunk_id) as chunks from vectors group by 1")
def embedding_stats(spark, d):
    return table(spark, d, "vectors").groupBy(F.coalesce(F.when(F.col("vector").isNotNull(), F.size("vector")), F.lit(-1)).cast("long").alias("dims")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


# graph --------------------------------------------------------------------------------------------------------------------
_SYMS = "s as (select distinct id as symbol from nodes where type = 'class')"


def _classes(spark, d):
    return table(spark, d, "nodes").where("type = 'class'").select(F.col("id").alias("symbol"))


_NB = "nb as (select symbol, target as node, relation, 'out' as direction, ord, edge_id from edg join s on source = symbol union all select symbol, source, relation, 'in', ord, edge_id from edg join s on target = symbol where source is distinct from target)"


@query(f"with {_EDG}, {_SYMS}, {_NB} select symbol, node, relation, direction from nb qualify row_number() over (partition by symbol order by ord, edge_id) <= 20")
def graph_neighbors(spark, d):
    return G.neighbours(table(spark, d, "edges"), _classes(spark, d)).select("symbol", "node", "relation", "direction")


@query(f"with {_EDG}, {_SYMS}, {_NB} select distinct symbol, node from nb where node is not null")
def connected_symbols(spark, d):
    return G.connected(table(spark, d, "edges"), _classes(spark, d))


@query("select id, type, file_path from nodes where id is not null qualify row_number() over (partition by id order by indexed_at nulls last, type, file_path) = 1")
def graph_nodes(spark, d):
    return G.graph_nodes(table(spark, d, "nodes"))


@query(f"with {_EDG} select relation, count(*) as edges, count(*) filter (where resolved) as resolved, count(*) filter (where not resolved) as unresolved, count(distinct source) as sources, count(distinct target) as targets from edg group by 1")
def graph_edge_stats(spark, d):
    e = G.edge_stats(table(spark, d, "edges"))
    return e.select("relation", "edges", "resolved", "unresolved", "sources", "targets")


@query(f"with {_EDG}, {_SYM}, {_SYMS} select edg.target, edge_id, fqn, type, file, 'reverse_' || relation as relation from edg join s on edg.target = s.symbol join sym on edg.source = sym.fqn")
def reverse_dependencies(spark, d):
    return G.reverse_dependencies(table(spark, d, "edges"), _classes(spark, d), _sym(spark, d)).select("target", "edge_id", "fqn", "type", "file", "relation")


@query(f"""with {_EDG}, {_SYM}, {_SYMS}, {_NB}, top as (select *, row_number() over (partition by symbol order by ord, edge_id) as rank from nb qualify row_number() over (partition by symbol order by ord, edge_id) <= 10),
 code as (select fqn as node, 0 as pref, chunk_id, file, type from sym union all select name, 1, chunk_id, file, type from sym where name is distinct from fqn)
 select symbol as graph_source, rank, node as symbol_name, relation, file as file_path, type as chunk_type from (select top.symbol, top.rank, top.relation, code.* from top join code using (node)) qualify row_number() over (partition by symbol, rank order by pref, chunk_id) <= 5""")
def graph_context(spark, d):
    return G.graph_context(table(spark, d, "edges"), _classes(spark, d), _sym(spark, d)).select("graph_source", F.col("rank").cast("long").alias("rank"), "symbol_name", "relation", "file_path", "chunk_type")


# questions ----------------------------------------------------------------------------------------------------------------
def _asked(spark):
    return R.questions(spark, QUESTIONS)


@query(f"with {_Q}, {_INTENT} select qid, question, intent from it")
def detect_intent(spark, d):
    return _asked(spark).select("qid", "question", "intent")


@query(f"with {_Q}, {_INTENT}, {_TERM} select qid, intent, term from qt")
def query_term(spark, d):
    return _asked(spark).select("qid", "intent", "term")


@query("""with q as (select chunk_id as qid, 'who calls ' || symbol_name || ' and is it private' as question, symbol_name, lower(chunk_type) as t from chunks where chunk_id is not null and symbol_name is not null group by all)
 select qid, cast(round(0.5 + 0.4 + case when t = 'function' then 0.3 else 0 end, 6) as double) as ranking_score from q""")
def score_chunks(spark, d):
    c = table(spark, d, "chunks").where("chunk_id is not null and symbol_name is not null").select(F.col("chunk_id").alias("qid"), F.concat(F.lit("who calls "), "symbol_name", F.lit(" and is it private")).alias("question"), "symbol_name", F.lower("chunk_type").alias("t")).distinct()
    rel = F.when(F.col("t") == "function", "reverse_calls").otherwise("contains")
    return c.select("qid", F.round(R.score(F.col("question"), F.lit("DEPENDENCY"), F.col("symbol_name"), rel, F.lit(None).cast("double")), 6).alias("ranking_score"))


def _tables(spark, d):
    chunks, edges = table(spark, d, "chunks"), table(spark, d, "edges")
    return R.Tables(table(spark, d, "files"), I.symbols(chunks), I.imports(edges), I.decorators(chunks), edges)


def _ranked(spark, d):
    q = _asked(spark)
    return q, R.ranked(R.context(_tables(spark, d), q), q)


_NULLS = "cast(null as varchar)"


def _listed(source: str, test: str, order: str, limit: int, intents: str, cols: str, term: str = "term") -> str:
    """Context rows of the list strategies."""
    own = f"select qid, {term} as term from qt where intent in ({intents})"
    return f"select qid, {cols}, rank as seq from (select o.qid, x.*, row_number() over (partition by o.qid order by {order}) as rank from ({own}) o join {source} x on {test}) where rank <= {limit}"


def _around(name: str, limit: int, own: str, seq: str) -> tuple[str, str]:
    """Graph context around own(qid, graph_source, hit)."""
    cte = f"""{name}_s as (select distinct graph_source as symbol from {own}), {name}_n as (select symbol, target as node, relation, ord, edge_id from edg join {name}_s on source = symbol union all select symbol, source, relation, ord, edge_id from edg join {name}_s on target = symbol where source is distinct from target),
 {name}_t as (select *, row_number() over (partition by symbol order by ord, edge_id) as rank from {name}_n qualify row_number() over (partition by symbol order by ord, edge_id) <= {limit}),
 {name}_c as (select * from (select t.symbol, t.rank, t.node, t.relation, code.* exclude (node) from {name}_t t join code on t.node = code.node) qualify row_number() over (partition by symbol, rank order by pref, chunk_id) <= 5)"""
    rows = f"select o.qid, file as file_path, node as symbol_name, type as chunk_type, relation, o.graph_source, cast(null as double) as score, cast(null as integer) as line, text, {seq} as seq from {own} o join {name}_c c on c.symbol = o.graph_source"
    return cte, rows


_COLS = "{f} as file_path, {s} as symbol_name, {t} as chunk_type, {r} as relation, {g} as graph_source, {sc} as score, {l} as line, {x} as text"


def _cols(f, s, t, r=_NULLS, g=_NULLS, sc="cast(null as double)", line="cast(null as integer)", x=_NULLS) -> str:
    return _COLS.format(f=f, s=s, t=t, r=r, g=g, sc=sc, l=line, x=x)


_TOK = "cast(('0x' || substr(md5(w), 1, 8)) as bigint) % 384"
_FLOW = _around("cf", 8, "cf_own", "1000000 + c.rank * 1000")
_ARCH = _around("ar", 10, "ar_own", "1000000 + c.rank * 1000")
_GEN = _around("ge", 3, "ge_own", "4000000 + o.hit * 100000 + c.rank * 1000")
_CTX = f"""{_EDG}, {_SYM}, {_DEC}, {_Q}, {_INTENT}, {_TERM},
fi as ({SQL['scan_filter'].replace('select file_id, rel_path, ext', 'select file_id, rel_path, ord')}),
imp as (select source as file, target as imported_fqn, string_split(target, '.')[-1] as local_name, ord, edge_id from edg where relation = 'imports' and source is not null and target is not null),
pyf as (select file_id, rel_path, ord, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as l from files where ext = '.py'),
code as (select fqn as node, 0 as pref, chunk_id, file, type, text from sym union all select name, 1, chunk_id, file, type, text from sym where name is distinct from fqn),
st as (select qid, term, intent from qt where intent in ('SYMBOL_LOOKUP', 'CALL_FLOW', 'ARCHITECTURE', 'DEPENDENCY')), ex as (select st.qid, s.* from st join sym s on s.fqn = st.term),
sh as (select *, row_number() over (partition by qid order by ord, chunk_id) as rank from (select * from ex union all select st.qid, s.* from st join sym s on ({_SUB.replace('term', 'st.term')}) where st.qid not in (select qid from ex)) qualify row_number() over (partition by qid order by ord, chunk_id) <= 10),
cf_own as (select qid, fqn as graph_source, 0 as hit from sh where rank = 1 and qid in (select qid from qt where intent = 'CALL_FLOW')), ar_own as (select qid, fqn as graph_source, 0 as hit from sh where rank = 1 and qid in (select qid from qt where intent = 'ARCHITECTURE')),
rc as (select qid, question, case intent when 'SYMBOL_LOOKUP' then 2 else 3 end as k, regexp_extract(question, '[A-Z][A-Za-z0-9_]*', 0) as cap from qt where intent in ('GENERAL', 'ARCHITECTURE') or intent = 'SYMBOL_LOOKUP' and qid not in (select qid from sh)),
rex as (select rc.qid, s.*, cast(1.0 as double) as score, row_number() over (partition by rc.qid order by ord, chunk_id) as rank from rc join sym s on s.name = rc.cap and rc.cap <> '' qualify row_number() over (partition by rc.qid order by ord, chunk_id) <= 5),
rre as (select * from rc where qid not in (select qid from rex)),
tq as (select qid, {_TOK} as b, count(*) as tf from (select qid, unnest(regexp_split_to_array(lower(question), '[^a-z0-9]+')) as w from rre) where w <> '' group by 1, 2), nq as (select qid, sqrt(sum(tf * tf)) as n from tq group by 1),
tc as (select chunk_id, {_TOK} as b, count(*) as tf from (select chunk_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w from sym) where w <> '' group by 1, 2), nc as (select chunk_id, sqrt(sum(tf * tf)) as n from tc group by 1),
vh as (select qid, chunk_id, round(sum((tc.tf / nc.n) * (tq.tf / nq.n)), 6) as cosine from tq join nq using (qid) join tc using (b) join nc using (chunk_id) group by 1, 2),
vt as (select vh.*, row_number() over (partition by qid order by cosine desc, chunk_id) as rank from vh),
rv as (select vt.qid, s.*, vt.cosine as score, vt.rank from vt join rre using (qid) join sym s using (chunk_id) where vt.rank <= rre.k),
rh as (select qid, rank, fqn, name, type, file, line, score, text from rex union all select qid, rank, fqn, name, type, file, line, score, text from rv),
ge_own as (select qid, fqn as graph_source, rank as hit from rh where qid in (select qid from qt where intent = 'GENERAL')),
{_FLOW[0]}, {_ARCH[0]}, {_GEN[0]},
dt as (select distinct qid, graph_source, target from (select qid, fqn as graph_source, unnest([fqn, term]) as target from sh join qt using (qid) where rank = 1 and intent = 'DEPENDENCY')),
kx as (select o.qid, x.*, row_number() over (partition by o.qid order by x.ord, x.file_id) as rank, list_position(list_transform(l, lambda y: contains(lower(y), lower(trim(o.term)))), true) as pos, o.term from (select qid, term from qt where intent = 'KEYWORD_SEARCH') o join pyf x on contains(lower(x.text), lower(trim(o.term))) qualify row_number() over (partition by o.qid order by x.ord, x.file_id) <= 5),
ctx as ({_listed('fi', 'contains(lower(x.rel_path), lower(trim(o.term)))', 'x.ord, x.file_id', 10, "'FILE_LOOKUP'", _cols('rel_path', 'rel_path', "'file'", x="'# File: ' || rel_path"))}
 union all {_listed('imp', 'contains(lower(x.imported_fqn), lower(trim(o.term))) or contains(lower(x.local_name), lower(trim(o.term)))', 'x.ord, x.edge_id', 10, "'IMPORT_LOOKUP'", _cols('file', 'imported_fqn', "'import'", r="'imports'", x="'# File: ' || file || ' imports ' || imported_fqn || ' as ' || local_name"))}
 union all {_listed('dkey', 'contains(lower(x.decorator), lower(trim(o.term)))', 'x.ord, x.chunk_id, x.decorator', 10, "'DECORATOR_LOOKUP'", _cols('file', 'target', 'type', r="'decorated_by_' || decorator", line='line'), "case when starts_with(trim(term), '@') then substring(trim(term), 2) else term end")}
 union all select qid, {_cols('rel_path', "'keyword_' || term", "'keyword_match'", x="array_to_string(list_slice(l, greatest(pos - 2, 1), pos + 14), chr(10))")}, rank from kx where pos > 0
 union all select qid, {_cols('file', 'fqn', 'type', line='line', x='text')}, rank from sh
 union all {_FLOW[1]} union all {_ARCH[1]} union all {_GEN[1]}
 union all select dt.qid, {_cols('s.file', 's.fqn', 's.type', r="'reverse_' || e.relation", g='dt.graph_source', line='s.line')}, 2000000 + e.ord from dt join edg e on e.target = dt.target join sym s on s.fqn = e.source
 union all select qid, {_cols('file', 'name', 'type', sc='score', line='line', x='text')}, 3000000 + rank from rh),
once as (select * from ctx qualify row_number() over (partition by qid, file_path, symbol_name, relation order by seq nulls first, text nulls first, line nulls first) = 1),
scored as (select o.*, question, intent, cast(round(coalesce(score, 0.5) + case when length(symbol_name) > 0 and (contains(lower(question), lower(symbol_name)) or contains(lower(question), lower(string_split(symbol_name, '.')[-1]))) then 0.4 else 0 end
 + case when intent = 'CALL_FLOW' and relation in ('calls', 'instantiates') or intent = 'ARCHITECTURE' and relation in ('inherits', 'imports') or intent = 'DEPENDENCY' and relation in ('calls', 'inherits', 'imports', 'reverse_calls', 'reverse_inherits', 'reverse_imports') then 0.3 else 0 end, 6) as double) as ranking_score from once o join qt using (qid)),
ranked as (select *, cast(row_number() over (partition by qid order by ranking_score desc, seq, file_path nulls first, symbol_name nulls first, relation nulls first) as integer) as rank from scored qualify row_number() over (partition by qid order by ranking_score desc, seq, file_path nulls first, symbol_name nulls first, relation nulls first) <= 12)"""
_TICK = "'`' || coalesce({0}, 'None') || '`'"
_BLOCK = "chr(10) || 'FILE: ' || coalesce(file_path, 'None') || chr(10) || chr(10) || 'TYPE: ' || coalesce(chunk_type, 'None') || chr(10) || chr(10) || 'SYMBOL: ' || coalesce(symbol_name, 'None') || chr(10) || chr(10) || 'RELATION: ' || coalesce(relation, 'none') || chr(10) || chr(10) || 'CODE:' || chr(10) || chr(10) || substring(coalesce(text, ''), 1, 1200) || chr(10)"
_BUD = f"blk as (select qid, rank, {_BLOCK} as block from ranked), bud as (select qid, rank, block, cast(sum(length(block)) over (partition by qid order by rank) as bigint) as used from blk)"


@query(f"with {_CTX} select qid, rank, intent, file_path, symbol_name, chunk_type, relation, graph_source, ranking_score from ranked")
def orchestrate_rank(spark, d):
    return _ranked(spark, d)[1].select("qid", "rank", "intent", "file_path", "symbol_name", "chunk_type", "relation", "graph_source", "ranking_score")


@query(f"""with {_CTX}, n as (select qid, count(*) as n, count(graph_source) as g, count(*) filter (where seq < 1000000) as s from ctx group by 1), j as (select qid, intent, coalesce(n, 0) as n, coalesce(g, 0) as g, coalesce(s, 0) as s from qt left join n using (qid))
 select qid, intent, case intent {' '.join(f"when '{k}' then '{v[0]}'" for k, v in R.STRATEGY.items())} end || case when intent = 'SYMBOL_LOOKUP' and s = 0 then '|Vector Search (Fallback)' when intent = 'CALL_FLOW' and s > 0 then '|Graph Expansion (Calls)' when intent = 'ARCHITECTURE' then '|Vector Search' when intent = 'GENERAL' then '|Graph Expansion' else '' end as strategies,
 cast(case intent {' '.join(f"when '{k}' then case when {'g > 0' if k == 'CALL_FLOW' else 'n > 1' if k == 'DEPENDENCY' else 'n > 0'} then {v[1]} else {v[2]} end" for k, v in R.STRATEGY.items())} end as double) as confidence from j""")
def intent_strategy(spark, d):
    q = _asked(spark)
    return R.confidence(q, R.context(_tables(spark, d), q)).withColumn("strategies", F.array_join("strategies", "|"))


@query(f"""with {_CTX}, k as (select qid, case when chunk_type = 'file' then 'file' when contains(relation, 'decorated') then 'decorator' when coalesce(line, 0) <> 0 then 'symbol' else 'vector' end as kind from once)
 select qid, count(*) filter (where kind = 'file') as file_rows, count(*) filter (where kind = 'decorator') as decorator_rows, count(*) filter (where kind = 'symbol') as symbol_rows, count(*) filter (where kind = 'vector') as vector_rows from k group by 1""")
def context_metrics(spark, d):
    q = _asked(spark)
    return R.metrics(R.ranked(R.context(_tables(spark, d), q), q, None))


@query(f"with {_CTX}, {_BUD} select qid, rank, used from bud where used <= 7000")
def context_budget(spark, d):
    return A.within_budget(_ranked(spark, d)[1]).select("qid", "rank", "used")


@query(f"""with {_CTX}, {_BUD}, c as (select qid, string_agg(block, chr(10) || chr(10) order by rank) as context from bud where used <= 7000 group by 1)
 select qid, 'Answer a question about a source-code repository from the context only.' || chr(10) || 'Intent: ' || intent || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10)
 || 'Name files and symbols as they are written in the context. Say so where the context does not tell. Parts: Definition, Files, Call Flow, Related Components, Summary.' || chr(10) as prompt from qt left join c using (qid)""")
def prompt_text(spark, d):
    q, r = _ranked(spark, d)
    return A.prompts(r, q)


@query(f"""with {_CTX}, g as (select qid, list_sort(list(distinct file_path) filter (where file_path <> '')) as files, string_agg('- ' || {_TICK.format('graph_source')} || ' **' || relation || '** ' || {_TICK.format('symbol_name')} || ' (in ' || {_TICK.format('file_path')} || ')', chr(10) order by rank) filter (where relation <> '' and graph_source <> '') as flow from ranked group by 1),
 t as (select * from ranked where rank = 1), n as (select chr(10) || chr(10) as nn)
 select qid, case when t.rank is null then '### Definition:' || chr(10) || 'No context for the query: **' || qt.question || '**.' || chr(10) else '### Definition:' || chr(10) || {_TICK.format('symbol_name')} || ' in ' || {_TICK.format('file_path')} || nn || '### Files:' || chr(10) || array_to_string(list_transform(g.files, lambda f: '- `' || f || '`'), chr(10))
 || nn || '### Call Flow:' || chr(10) || coalesce(flow, '- No relations in the context.') || nn || '### Related Components:' || chr(10) || '- ' || {_TICK.format('symbol_name')} || ' (type: ' || {_TICK.format('chunk_type')} || ')' || chr(10) || substring(coalesce(text, ''), 1, 600) || nn || '### Summary:' || chr(10) || len(g.files) || ' file(s) of context.' || chr(10) end as answer
 from qt cross join n left join g using (qid) left join t using (qid)""")
def fallback_answer(spark, d):
    q, r = _ranked(spark, d)
    return A.fallback(r, q)


@query(f"with {_CTX} select qid, rank, file_path, symbol_name, chunk_type, relation, graph_source, case when score is null then 'graph' else cast(score as varchar) end as score from ranked")
def answer_sources(spark, d):
    return A.sources(_ranked(spark, d)[1])


@query(f"with {_CTX} select qid, cast(rank as integer) as rank, fqn, name, round(score, 6) as score from rh")
def retrieve_context(spark, d):
    q = _asked(spark).where(F.col("intent").isin("GENERAL", "ARCHITECTURE"))
    own = _asked(spark).where("intent = 'SYMBOL_LOOKUP'")
    sym = _sym(spark, d)
    terms = [r["term"] for r in own.collect()]
    met = S.search_symbols(sym, terms, 1).select("term").distinct()
    q = q.select("qid", "question", F.lit(3).alias("k")).unionByName(own.join(met, "term", "left_anti").select("qid", "question", F.lit(2).alias("k")))
    return R.retrieve_context(sym, q).select("qid", "rank", "fqn", "name", F.round("score", 6).alias("score"))


# one strategy at a time, in SQL too
@query(f"""with {_EDG}, {_SYM}, {_SYMS}, dep as (select edg.target, 'reverse_' || relation as relation, sym.file as file_path, sym.fqn as symbol_name, sym.type as chunk_type, edg.ord from edg join s on edg.target = s.symbol join sym on edg.source = sym.fqn),
 once as (select * from dep qualify row_number() over (partition by target, file_path, symbol_name, relation order by ord) = 1), sc as (select *, round(0.5 + case when contains('who calls ' || lower(target), lower(symbol_name)) or contains('who calls ' || lower(target), lower(string_split(symbol_name, '.')[-1])) then 0.4 else 0 end + case when relation in ('reverse_calls', 'reverse_inherits', 'reverse_imports') then 0.3 else 0 end, 6) as ranking_score from once)
 select target, file_path, symbol_name, relation, cast(ranking_score as double) as ranking_score from sc qualify row_number() over (partition by target order by ranking_score desc, ord, file_path, symbol_name, relation) <= 12""")
def dependency_rank(spark, d):
    """Who depends on each class of the graph: a question per class."""
    q = _classes(spark, d).distinct().where("symbol is not null").select(F.col("symbol").alias("qid"), F.concat(F.lit("who calls "), "symbol").alias("question"), F.lit("DEPENDENCY").alias("intent"))
    deps = G.reverse_dependencies(table(spark, d, "edges"), q.select(F.col("qid").alias("symbol")), _sym(spark, d))
    none = F.lit(None)
    ctx = deps.select(F.col("target").alias("qid"), F.col("file").alias("file_path"), F.col("fqn").alias("symbol_name"), F.col("type").alias("chunk_type"), "relation", none.cast("string").alias("graph_source"), none.cast("double").alias("score"), "line", none.cast("string").alias("text"), F.col("ord").alias("seq"))
    return R.ranked(ctx, q, stated=False).select(F.col("qid").alias("target"), "file_path", "symbol_name", "relation", "ranking_score")


# texts and clients --------------------------------------------------------------------------------------------------------
@query("select doc_id, count(distinct w) as words, true as within_size, true as numbered, case when length(t) <= 1000 then md5(t) end as whole from (select doc_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as t, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents) group by doc_id, t")
def text_chunks(spark, d):
    """What the chunks of each document hold: all its words, none beyond the size, numbered from 0; a short text is one chunk."""
    c = T.text_chunks(table(spark, d, "documents"), "doc_id")
    words = c.select("doc_id", "chunk_id", F.length("text").alias("n"), F.when(F.col("chunk_id") == 0, F.md5("text")).alias("first"), F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    both = F.size(F.array_distinct(F.flatten(F.collect_list("w"))))  # the words of one document
    return words.groupBy("doc_id").agg(both.cast("long").alias("words"), (F.max("n") <= T.SIZE).alias("within_size"), (F.max("chunk_id") + 1 == F.count("*")).alias("numbered"), F.when(F.max("chunk_id") == 0, F.max("first")).alias("whole"))


@query("select count(*) as short_documents, cast(sum(length(t)) as bigint) as chars from (select regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') as t from documents where regexp_matches(text, '\\S')) where length(t) <= 1000")
def text_chunk_stats(spark, d):
    """Documents of one chunk, and their characters."""
    c = T.text_chunks(table(spark, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    return c.where("n = 1").agg(F.count("*").alias("short_documents"), F.sum("chars").alias("chars"))


@query("select count(*) as documents, cast(count(*) filter (where trim(text) <> '') as bigint) as with_text, cast(sum(length(text)) as bigint) as chars from documents")
def text_stats(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("with_text"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("with o as (select user_id, event_type, min(ts) as first from events where event_type is not null group by 1, 2) select user_id, cast(position as integer) as position, event_type from (select *, row_number() over (partition by user_id order by first desc, event_type) as position from o) where position <= 15")
def question_history(spark, d):
    return H.question_history(table(spark, d, "events"), "user_id", "event_type", "ts").select("user_id", "position", "event_type")


@query("select user_id, event_id, value from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def last_assistant_turn(spark, d):
    return H.last_turn(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type", "purchase").select("user_id", "event_id", "value")


# parsing ------------------------------------------------------------------------------------------------------------------
# over the files themselves; SQL can't parse, so the same operators are compared over rendered sources (`rendered_queries`)
@query()
def files_chunks(spark, d):
    return P.chunks(P.facts(table(spark, d, "files"), ["chunk"])).select("file_path", "fqn", "name", "type", "line", "text", "docstring")


@query()
def files_edges(spark, d):
    return RS.edges(P.facts(table(spark, d, "files"), RS.kinds_for()))


# names of edges, resolved against the table of symbols: SQL says the same
_FILES = "fs as (select file_path, min(module) as module from ch where module is not null and file_path is not null group by 1)"


@query(f"""with {_EDG}, {_SYM}, {_FILES}, imp as (select source as file_path, string_split(target, '.')[-1] as head, max_by(target, ord) as imported_fqn from edg where relation = 'imports' and source is not null and target is not null group by 1, 2),
 nm as (select distinct e.file_path, module, string_split(target, '.')[-1] as name from edg e join fs using (file_path) where relation in ('calls', 'instantiates', 'inherits') and target is not null),
 suf as (select name, min(fqn) as only_, count(*) as owners from (select fqn, array_to_string(list_slice(p, i, len(p)), '.') as name from (select fqn, string_split(fqn, '.') as p, unnest(range(2, len(string_split(fqn, '.')) + 1)) as i from sym)) group by 1 having count(*) = 1),
 j as (select n.*, a.fqn as a, i.imported_fqn as b, d.fqn as d, s.only_ as e from nm n left join sym a on a.fqn = n.name left join imp i on i.file_path = n.file_path and i.head = n.name left join sym d on d.fqn = n.module || '.' || n.name left join suf s on s.name = n.name)
 select file_path, name, coalesce(a, b, d, e, name) as target, coalesce(a, b, d, e) is not null as resolved, case when coalesce(a, b, d) is not null then 'high' when e is not null then 'medium' else 'low' end as confidence from j""")
def resolve_simple(spark, d):
    chunks, edges = I.latest_chunks(table(spark, d, "chunks")), I.latest_edges(table(spark, d, "edges"))
    modules = chunks.where("module is not null and file_path is not null").groupBy("file_path").agg(F.min("module").alias("module"))
    names = edges.where(F.col("relation").isin("calls", "instantiates", "inherits") & F.col("target").isNotNull()).select("file_path", N.last_part(F.col("target")).alias("name")).join(modules, "file_path")
    imports = edges.where("relation = 'imports' and source is not null and target is not null").groupBy(F.col("source").alias("file_path"), N.last_part(F.col("target")).alias("local_name")).agg(F.max_by("target", "ord").alias("imported_fqn"))
    return RS.resolve_simple(names, _sym(spark, d), imports).select("file_path", "name", "target", "resolved", "confidence")


@query(f"""with recursive {_EDG}, {_SYM}, base as (select cls, min_by(target, ord) as base from (select source as cls, target, ord from edg where relation = 'inherits' and source is not null and target in (select fqn from sym where type = 'class') and target <> source) group by 1),
 meth as (select regexp_replace(fqn, '\\.[^.]*$', '') as owner, regexp_extract(fqn, '[^.]*$') as attr from sym where type = 'method'), cls as (select distinct fqn from sym where type = 'class'),
 want as (select fqn as cls, attr from cls join meth on owner = fqn union select b.cls, attr from cls join base b on b.cls = fqn join meth on owner = b.base union select b.cls, attr from cls join base b on b.cls = fqn join base c on c.cls = b.base join meth on owner = c.base union select fqn, 'no_such_method' from cls),
 walk as (select cls, attr, cls as place, [cls] as seen from want union all select w.cls, w.attr, b.base, list_append(w.seen, b.base) from walk w join base b on b.cls = w.place where not list_contains(w.seen, b.base) and not exists (select 1 from sym x where x.fqn = w.place || '.' || w.attr)),
 hit as (select w.cls, w.attr, min_by(x.fqn, len(w.seen)) as target from walk w join sym x on x.fqn = w.place || '.' || w.attr group by 1, 2)
 select w.cls, w.attr, coalesce(h.target, w.cls || '.' || w.attr) as target from want w left join hit h using (cls, attr)""")
def resolve_self_method(spark, d):
    """self.x in every class, for the methods that it, its base and the base's base define, and for one that nobody has."""
    sym, edges = _sym(spark, d), I.latest_edges(table(spark, d, "edges"))
    classes = sym.where("type = 'class'").select(F.col("fqn").alias("cls"))
    bases = edges.where("relation = 'inherits' and source is not null and target <> source").join(classes.select(F.col("cls").alias("target")), "target").groupBy(F.col("source").alias("cls")).agg(F.min_by("target", "ord").alias("base"))
    methods = sym.where("type = 'method'").select(F.regexp_replace("fqn", "\\.[^.]*$", "").alias("at"), N.last_part(F.col("fqn")).alias("attr"))
    one = bases.join(classes, "cls").select("cls", F.col("base").alias("at"))
    two = one.join(bases.select(F.col("cls").alias("at"), F.col("base").alias("up")), "at").select("cls", F.col("up").alias("at"))
    around = classes.select("cls", F.col("cls").alias("at")).unionByName(one).unionByName(two)
    wanted = around.join(methods, "at").select("cls", "attr").unionByName(classes.withColumn("attr", F.lit("no_such_method")))
    return RS.resolve_self(wanted, sym, bases)
