"""The parser and the resolver against a graph that is known beforehand.

The star schema is rendered as Python source: a class per region, nation, supplier (inheriting in that order) and order, a
function per part and customer, with calls, bindings, imports and decorators that follow from the rows. Files are small
whatever the size of the data (a supplier's lines, 500 parts, 50 customers, 500 orders). The pieces of the files are one SQL text that both engines
run; what the parser must find in them is said in SQL over the same rows, without parsing anything."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import parse as P
from loamgraph.operators import resolve as RS
from loamgraph.session import cut, table

TABLES = ("region", "nation", "supplier", "part", "customer", "orders", "lineitem")


def _div(c: str, n: int) -> str:
    return f"cast(floor({c} / {n}) as bigint)"


_REG = "'region/r' || r_regionkey || '.py'"
_RC = "'region.r' || r_regionkey || '.R' || r_regionkey"
_NAT = "'nation/n' || n_nationkey || '.py'"
_NC = "'nation.n' || n_nationkey || '.N' || n_nationkey"
_SUP = "'supplier/s' || s_suppkey || '.py'"
_SC = "'supplier.s' || s_suppkey || '.S' || s_suppkey"
_PM = f"'part.m' || {_div('p_partkey', 500)}"
_PF = f"'part/m' || {_div('p_partkey', 500)} || '.py'"
_CM = f"'customer.g' || {_div('c_custkey', 50)}"
_CF = f"'customer/g' || {_div('c_custkey', 50)} || '.py'"
_OM = f"'orders.o' || {_div('o_orderkey', 500)}"
_OF = f"'orders/o' || {_div('o_orderkey', 500)} || '.py'"
_OC = f"{_OM} || '.O' || o_orderkey"


def _piece(source: str, path: str, ord_: str, cls: str, fn: str, line: str, define: str = "null", name: str = "null", doc: str = "null", distinct: bool = False) -> str:
    s = lambda x: f"cast({x} as string)"
    return f"select {'distinct ' if distinct else ''}{path} as file_path, cast({ord_} as bigint) as ord, {s(cls)} as cls, {s(fn)} as fn, {line} as line, {s(define)} as def, {s(name)} as name, {s(doc)} as doc from {source}"


def _order_lines() -> list[str]:
    """Two orders of a customer after each other bind one variable again."""
    at = "100000 + (c_custkey % 50) * 100000000000 + 10 * o_orderkey"
    fn = f"{_CM} || '.c' || c_custkey"
    src = "{orders} join {customer} on o_custkey = c_custkey"
    return [
        _piece(src, _CF, at + " + 1", "null", fn, f"'    x = o' || {_div('o_orderkey', 500)} || '.O' || o_orderkey || '()'"),
        _piece(src, _CF, at + " + 2", "null", fn, "'    x.total()'"),
    ]


_SM = f"{_SC} || '.run'"
PIECES = "\nunion all ".join(
    [
        # part/wild.py, found by a wildcard import and by its full name
        _piece("(select 1 as one)", "'part/wild.py'", "1", "null", "'part.wild.star'", "'def star():'", "'function'", "'star'"),
        _piece("(select 1 as one)", "'part/wild.py'", "2", "null", "'part.wild.star'", "'    pass'"),
        # a class per region
        _piece("{region}", _REG, "1", _RC, "null", "'class R' || r_regionkey || ':'", "'class'", "'R' || r_regionkey", "'Region ' || r_regionkey || '.'"),
        _piece("{region}", _REG, "2", _RC, "null", "'    \"\"\"Region ' || r_regionkey || '.\"\"\"'"),
        _piece("{region}", _REG, "3", _RC, f"{_RC} || '.describe'", "'    def describe(self):'", "'method'", "'R' || r_regionkey || '.describe'", "'Says it.'"),
        _piece("{region}", _REG, "4", _RC, f"{_RC} || '.describe'", "'        \"\"\" Says it. \"\"\"'"),
        _piece("{region}", _REG, "5", _RC, f"{_RC} || '.describe'", "'        return self.label'"),
        _piece("{region}", _REG, "6", _RC, "null", "'    @property'"),
        _piece("{region}", _REG, "7", _RC, f"{_RC} || '.label'", "'    def label(self):'", "'method'", "'R' || r_regionkey || '.label'"),
        _piece("{region}", _REG, "8", _RC, f"{_RC} || '.label'", "'        return str(self)'"),
        # a class per nation, by a relative import where the key is odd
        _piece("{nation}", _NAT, "1", "null", "null", "case when n_nationkey % 2 = 1 then 'from ..region.r' else 'from region.r' end || n_regionkey || ' import R' || n_regionkey"),
        _piece("{nation}", _NAT, "2", _NC, "null", "'class N' || n_nationkey || '(R' || n_regionkey || ', Missing):'", "'class'", "'N' || n_nationkey"),
        _piece("{nation}", _NAT, "3", _NC, f"{_NC} || '.own'", "'    def own(self):'", "'method'", "'N' || n_nationkey || '.own'"),
        _piece("{nation}", _NAT, "4", _NC, f"{_NC} || '.own'", "'        self.describe()'"),
        _piece("{nation}", _NAT, "5", _NC, f"{_NC} || '.own'", "'        describe()'"),  # the short name of several: unresolved
        # a class per supplier; calls for all its lines
        _piece("{supplier}", _SUP, "1", "null", "null", "'from nation.n' || s_nationkey || ' import N' || s_nationkey"),
        _piece("{supplier}", _SUP, "2", "null", "null", "'from part.wild import *'"),
        _piece("{supplier}", _SUP, "3", "null", "null", "'from part.wild import star as glow'"),
        _piece("{supplier}", _SUP, "4", "null", "null", "'import math as glow, os.path'"),  # the last import of a name counts
        _piece("{supplier}", _SUP, "5", "null", "null", "'@part.wild.star'"),
        _piece("{supplier}", _SUP, "6", "null", "null", "'@registered(True)'"),
        _piece("{supplier}", _SUP, "7", _SC, "null", "'class S' || s_suppkey || '(N' || s_nationkey || '):'", "'class'", "'S' || s_suppkey"),
        _piece("{supplier}", _SUP, "8", _SC, _SM, "'    def run(self):'", "'method'", "'S' || s_suppkey || '.run'"),
        _piece("{supplier}", _SUP, "9", _SC, _SM, "'        self.describe()'"),  # of the region, two bases up
        _piece("{supplier}", _SUP, "10", _SC, _SM, "'        self.nothing()'"),  # of nobody: stays with the class
        _piece("{supplier}", _SUP, "11", _SC, _SM, "'        star()'"),
        _piece("{supplier}", _SUP, "12", _SC, _SM, "'        part.wild.star()'"),
        _piece("{supplier}", _SUP, "13", _SC, _SM, "'        glow.floor(1)'"),
        _piece("{lineitem} join {supplier} on l_suppkey = s_suppkey", _SUP, "100 + l_orderkey * 10 + l_linenumber", _SC, _SM, "'        p' || l_partkey || '()'"),  # the only name that ends so
        # a function per part
        _piece("{part}", _PF, "1", "null", f"{_PM} || '.helper' || {_div('p_partkey', 500)}", f"'def helper' || {_div('p_partkey', 500)} || '(x): return x'", "'function'", f"'helper' || {_div('p_partkey', 500)}", distinct=True),
        _piece("{part}", _PF, "10 * p_partkey + 2", "null", f"{_PM} || '.p' || p_partkey", "'def p' || p_partkey || '(size: int = ' || p_size || ', *rest, key=None) -> str:'", "'function'", "'p' || p_partkey", "'Part ' || p_partkey || '.'"),
        _piece("{part}", _PF, "10 * p_partkey + 3", "null", f"{_PM} || '.p' || p_partkey", "'    ''Part ' || p_partkey || '.'''"),
        _piece("{part}", _PF, "10 * p_partkey + 4", "null", f"{_PM} || '.p' || p_partkey", f"'    return helper' || {_div('p_partkey', 500)} || '(size)'"),
        # a class per order, a function per customer
        _piece("{orders}", _OF, "10 * o_orderkey + 2", _OC, "null", "'class O' || o_orderkey || ':'", "'class'", "'O' || o_orderkey"),
        _piece("{orders}", _OF, "10 * o_orderkey + 3", _OC, f"{_OC} || '.total'", "'    def total(self): return 1'", "'method'", "'O' || o_orderkey || '.total'"),
        _piece("{customer} join {orders} on o_custkey = c_custkey", _CF, _div("o_orderkey", 500), "null", "null", f"'import orders.o' || {_div('o_orderkey', 500)} || ' as o' || {_div('o_orderkey', 500)}", distinct=True),
        _piece("{customer}", _CF, "100000 + (c_custkey % 50) * 100000000000", "null", f"{_CM} || '.c' || c_custkey", "'async def c' || c_custkey || '():'", "'function'", "'c' || c_custkey"),
        *_order_lines(),
        _piece("{customer}", _CF, "100000 + (c_custkey % 50) * 100000000000 + 99999999999", "null", f"{_CM} || '.c' || c_custkey", "'    return x.total'"),
    ]
)


def files(spark, d):
    """(repo, rel_path, file_path, ext, text, n): the source files."""
    pieces = spark.sql(PIECES, **{t: table(spark, d, t) for t in TABLES})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return pieces.groupBy("file_path").agg(text.alias("text")).select(F.lit(None).cast("string").alias("repo"), F.col("file_path").alias("rel_path"), "file_path", F.lit(".py").alias("ext"), "text")


def _facts(spark, d, *kinds):
    return P.facts(files(spark, d), kinds or P.KINDS)


# what must be found, in SQL
_P = "pieces as (" + PIECES.format(**{t: t for t in TABLES}) + ")"
_SYM = f"""{_P}, sym as (select coalesce(fn, cls) as fqn, name as short, string_split(name, '.')[-1] as name, def as type, file_path, case when def = 'method' then cls end as parent, doc, ord from pieces where def is not null)"""
_E = "cast({r} as boolean) as resolved, {c} as confidence"
_ON = "true as resolved, 'high' as confidence"
_LAST = "last as (select o_custkey, max_by(o_orderkey, o_orderkey) as o_orderkey from orders join customer on o_custkey = c_custkey group by 1)"
_EDGES = {
    "contains": f"with {_SYM} select coalesce(parent, file_path) as source, fqn as target, 'contains' as relation, cast(null as boolean) as resolved, cast(null as varchar) as confidence, file_path from sym",
    "imports": f"""select {_NAT} as source, 'region.r' || n_regionkey || '.R' || n_regionkey as target, 'imports' as relation, {_ON}, {_NAT} as file_path from nation
 union all select {_SUP}, 'nation.n' || s_nationkey || '.N' || s_nationkey, 'imports', {_ON}, {_SUP} from supplier""",
    "inherits": f"""select {_NC} as source, 'region.r' || n_regionkey || '.R' || n_regionkey as target, 'inherits' as relation, {_ON}, {_NAT} as file_path from nation
 union all select {_NC}, 'Missing', 'inherits', false, 'low', {_NAT} from nation union all select {_SC}, 'nation.n' || s_nationkey || '.N' || s_nationkey, 'inherits', {_ON}, {_SUP} from supplier""",
    "decorates": f"""select 'part.wild.star' as source, {_SC} as target, 'decorates' as relation, {_ON}, {_SUP} as file_path from supplier union all select 'registered', {_SC}, 'decorates', false, 'low', {_SUP} from supplier
 union all select 'property', {_RC} || '.label', 'decorates', false, 'low', {_REG} from region""",
    "instantiates": f"select {_CM} || '.c' || c_custkey as source, {_OC} as target, 'instantiates' as relation, {_ON}, {_CF} as file_path from orders join customer on o_custkey = c_custkey",
    "returns": f"""with {_LAST} select {_CM} || '.c' || c_custkey as source, {_OC} || '.total' as target, 'returns' as relation, {_ON}, {_CF} as file_path from last join customer on o_custkey = c_custkey
 union all select {_RC} || '.describe', {_RC} || '.label', 'returns', {_ON}, {_REG} from region""",
    "calls": f"""with part_names as (select distinct p_partkey from part), many as (select count(*) as regions from region),
 home as (select n_nationkey, n_regionkey from nation) select {_SC} || '.run' as source, 'region.r' || n_regionkey || '.R' || n_regionkey || '.describe' as target, 'calls' as relation, {_ON}, {_SUP} as file_path from supplier join home on s_nationkey = n_nationkey
 union all select {_SC} || '.run', {_SC} || '.nothing', 'calls', {_ON}, {_SUP} from supplier union all select {_SC} || '.run', t, 'calls', {_ON}, {_SUP} from supplier, (select unnest(['part.wild.star', 'part.wild.star', 'math.floor']) as t)
 union all select {_SC} || '.run', case when p_partkey is null then 'p' || l_partkey else {_PM} || '.p' || p_partkey end, 'calls', p_partkey is not null, case when p_partkey is null then 'low' else 'medium' end, {_SUP} from lineitem join supplier on l_suppkey = s_suppkey left join part_names on l_partkey = p_partkey
 union all select {_NC} || '.own', 'region.r' || n_regionkey || '.R' || n_regionkey || '.describe', 'calls', {_ON}, {_NAT} from nation union all select {_NC} || '.own', 'describe', 'calls', false, 'low', {_NAT} from nation
 union all select {_RC} || '.label', 'str', 'calls', false, 'low', {_REG} from region
 union all select {_PM} || '.p' || p_partkey, {_PM} || '.helper' || {_div('p_partkey', 500)}, 'calls', {_ON}, {_PF} from part
 union all select {_CM} || '.c' || c_custkey, {_OC} || '.total', 'calls', {_ON}, {_CF} from orders join customer on o_custkey = c_custkey""",
}

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {_SYM}, own as (select coalesce(fn, cls) as fqn, cls, fn, file_path, ord, line, def, 1 + coalesce(sum(length(line) - length(replace(line, chr(10), '')) + 1) over (partition by file_path order by ord, line rows between unbounded preceding and 1 preceding), 0) as line_no from pieces),
 code as (select fqn, string_agg(line, chr(10) order by ord, line) as text from (select fn as fqn, line, ord from own where fn is not null union all select cls, line, ord from own where cls is not null) group by 1)
 select s.file_path, s.fqn, s.short as name, s.type, cast(o.line_no as integer) as line, ltrim(code.text) as text, s.doc as docstring from sym s join own o on o.fqn = s.fqn and o.def is not null join code on code.fqn = s.fqn""")
def ast_chunks(spark, d):
    return P.chunks(_facts(spark, d, "chunk")).select("file_path", "fqn", "name", "type", "line", "text", "docstring")


@query(f"""select {_NAT} as file_path, 'R' || n_regionkey as local_name, 'region.r' || n_regionkey || '.R' || n_regionkey as imported_fqn, 'symbol' as type from nation union all select {_SUP}, 'N' || s_nationkey, 'nation.n' || s_nationkey || '.N' || s_nationkey, 'symbol' from supplier
 union all select {_SUP}, l, i, t from supplier, (values ('*', 'part.wild', 'wildcard'), ('glow', 'math', 'module'), ('os.path', 'os.path', 'module')) v(l, i, t)
 union all select distinct {_CF}, 'o' || {_div('o_orderkey', 500)}, {_OM}, 'module' from orders join customer on o_custkey = c_custkey""")
def import_extract(spark, d):
    return RS.import_table(_facts(spark, d, "import")).select("file_path", "local_name", "imported_fqn", "type")


@query(f"with {_SYM} select fqn, name, type, file_path, parent from sym")
def symbol_table(spark, d):
    return RS.symbol_table(_facts(spark, d, "symbol")).select("fqn", "name", "type", "file_path", "parent")


@query(f"""with {_SYM} select fqn, case when starts_with(fqn, 'part.m') and starts_with(name, 'p') then 'size: int,key' when starts_with(name, 'helper') then 'x' when type = 'method' then 'self' when starts_with(name, 'N') then (select 'R' || n_regionkey || ',Missing' from nation where fqn = {_NC})
 when starts_with(name, 'S') then (select 'N' || s_nationkey from supplier where fqn = {_SC}) else '' end as items, case when starts_with(fqn, 'part.m') and starts_with(name, 'p') then 'str' end as returns, doc as docstring from sym""")
def signatures(spark, d):
    """Parameters of functions, bases of classes, the annotation of what is returned, and the documentation."""
    s = _facts(spark, d, "symbol")
    return s.select("fqn", F.array_join("items", ",").alias("items"), "returns", "docstring")


@query(f"with {_SYM} select fqn as id, type, file_path from sym union all select distinct file_path, 'file', file_path from pieces")
def parsed_nodes(spark, d):
    return RS.nodes(_facts(spark, d, "contains", "symbol"))


@query(f"""select c_custkey, cast(row_number() over (partition by c_custkey order by o_orderkey) as integer) as nth, 'x' as var, {_OC} as cls from orders join customer on o_custkey = c_custkey""")
def var_types(spark, d):
    """Bindings of variables to classes, in order."""
    from pyspark.sql import Window

    facts, _ = cut(_facts(spark, d, "symbol", "import", "assign").drop("docstring"), "facts")
    sym, _ = cut(RS.symbol_table(facts), "symtab")
    named, _ = cut(RS.resolved_uses(facts, ["assign"], sym), "named")
    b = RS.bindings(named, sym)
    nth = F.row_number().over(Window.partitionBy("file_path", "fn").orderBy("pos"))
    return b.select(F.regexp_extract("fn", r"\.c(\d+)$", 1).cast("long").alias("c_custkey"), nth.alias("nth"), "var", "cls")


@query(f"""select 'run' as source, 'p' || l_partkey as target, {_SUP} as file_path from lineitem join supplier on l_suppkey = s_suppkey union all select 'run', t, {_SUP} from supplier, (select unnest(['self.describe', 'self.nothing', 'star', 'part.wild.star', 'glow.floor']) as t)
 union all select 'own', t, {_NAT} from nation, (select unnest(['self.describe', 'describe']) as t) union all select 'label', 'str', {_REG} from region union all select 'p' || p_partkey, 'helper' || {_div('p_partkey', 500)}, {_PF} from part
 union all select 'c' || c_custkey, unnest(['o' || {_div('o_orderkey', 500)} || '.O' || o_orderkey, 'x.total']), {_CF} from orders join customer on o_custkey = c_custkey""")
def raw_calls(spark, d):
    return P.raw_calls(_facts(spark, d, "call")).select("source", "target", "file_path")


@query(f"with e as ({_EDGES['calls']} union all {_EDGES['instantiates']}) select relation, count(*) as calls, count(*) filter (where resolved) as resolved, count(*) filter (where not resolved) as unresolved from e group by 1")
def call_resolution_stats(spark, d):
    wanted = ["calls", "instantiates"]
    return RS.call_stats(RS.edges(_facts(spark, d, *RS.kinds_for(wanted)), wanted))


def _edges_of(relation):
    def f(spark, d):
        return RS.edges(_facts(spark, d, *RS.kinds_for([relation])), [relation]).select("source", "target", "relation", "resolved", "confidence", "file_path")

    f.__name__ = f"edges_{relation}"
    return f


for _r, _sql in _EDGES.items():
    query(_sql)(_edges_of(_r))
