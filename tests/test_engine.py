import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import intent as IN
from loamgraph.functions import names as N
from loamgraph.operators import answer as A
from loamgraph.operators import parse as P
from loamgraph.operators import resolve as RS
from loamgraph.operators import retrieve as R
from loamgraph.operators import search as S
from loamgraph.operators import text as T
from loamgraph.operators import vector as V

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols)).select(f(*[F.col(c) for c in cols])).first()[0]


@pytest.mark.parametrize(
    "question,intent",
    [
        ("Find @app.get", "DECORATOR_LOOKUP"), ("Where is core.py?", "FILE_LOOKUP"), ("Who imports x?", "IMPORT_LOOKUP"), ("Search for Password", "KEYWORD_SEARCH"), ("who calls f", "DEPENDENCY"),
        ("where is it used by and defined", "SYMBOL_LOOKUP"), ("trace f", "CALL_FLOW"), ("How does X work?", "CALL_FLOW"), ("How does dependency injection work?", "CALL_FLOW"), ("How does routing work?", "GENERAL"),
        ("relationship between A and B", "ARCHITECTURE"), ("Explain Foo", "SYMBOL_LOOKUP"), ("explain the database", "GENERAL"), ("Tell me about x", "GENERAL"), ("profile, find it", "FILE_LOOKUP"), ("", "GENERAL"), (None, None),
    ],
)
def test_intent(spark, question, intent):
    assert one(spark, IN.detect_intent, question) == intent


@pytest.mark.parametrize(
    "intent,question,term",
    [
        ("FILE_LOOKUP", "Where is Core.py?", "Core.py"), ("FILE_LOOKUP", "find app/Main", "app/main"), ("IMPORT_LOOKUP", "Who imports Foo.bar?", "foo.bar"), ("IMPORT_LOOKUP", "where is X imported", "x"),
        ("DECORATOR_LOOKUP", 'Find @app.get("/")', "@app.get("), ("KEYWORD_SEARCH", "Search for PassWord", "PassWord"), ("CALL_FLOW", "How does APIRouter work?", "does"), ("SYMBOL_LOOKUP", "is it", "is it"), ("GENERAL", "is Widget", "Widget"),
    ],
)
def test_term(spark, intent, question, term):
    assert one(spark, IN.query_term, intent, question) == term


def test_names(spark):
    assert one(spark, N.url_valid, " https://github.com/a/b/ ") and not one(spark, N.url_valid, "https://github.com/a/b/c")
    assert one(spark, N.repo_identifier, "https://github.com/a/b//") == "a/b"
    assert one(spark, N.module_name, "a/b/__init__.py") == "a.b" and one(spark, N.module_name, "__init__.py") == ""
    assert one(spark, N.relative_module, "a.b.c", "..x") == "a.x" and one(spark, N.relative_module, "a", "...") == ""
    assert one(spark, N.decorator_key, " @a.b(c) ") == "a.b"
    assert one(spark, N.docstring_strip, '"""\n x """') == "x" and one(spark, N.docstring_strip, 'r"""x"""') == 'r"""x"""'
    assert one(spark, N.error_category, "Git clone failed: not found") == "clone_failed"
    assert one(spark, N.basename, "a\\b/c.py") == "c.py" and one(spark, N.intent_label, "CALL_FLOW_X") == "CALL FLOW_X"


def block_model(text, line):
    lines = text.replace("\r\n", "\n").split("\n")
    if not 1 <= line <= len(lines):
        return ""
    ind = lambda x: len(x) - len(x.lstrip())
    out = [lines[line - 1]]
    for x in lines[line:]:
        if x.strip(" ") and (ind(x) < ind(out[0]) or (ind(x) == ind(out[0]) and re.match(r"\s*(def |class |@|import |from )", x))):
            break
        out.append(x)
    return "\n".join(out)


@settings(max_examples=15, deadline=None)
@given(lines=st.lists(st.sampled_from(["def f():", "  x = 1", "", "x = 1", "@d", "  def g():", "async def h():", "import a"]), min_size=1, max_size=9), at=st.integers(0, 10))
def test_block(spark, lines, at):
    text = "\n".join(lines)
    got = spark.createDataFrame([(text, at)], "t string, n int").select(S.python_block(F.col("t"), F.col("n"))).first()[0]
    assert got == block_model(text, at)


def tree(spark):
    from loamgraph.sources.tree import read_tree

    return read_tree(spark, FIX)


def test_scan(spark):
    rows = {r.rel_path: r for r in tree(spark).collect()}
    assert set(rows) == {"pkg/__init__.py", "pkg/core.py", "pkg/app.js", "pkg/sub/_private.py", "pkg/sub/broken.py"}  # underscores stay; tests, text and bad bytes go
    from loamgraph.sources.tree import read_tree

    assert "pkg/tests/test_x.py" in {r.rel_path for r in read_tree(spark, FIX, prune=False).collect()}
    for n in (1, 2, 50):  # from one task for all to one for each folder
        got = [(r.rel_path, r.content) for r in read_tree(spark, "file://" + FIX, True, n).orderBy("ord").collect()]
        assert [p for p, _ in got] == sorted(rows) and all(c == rows[p].content for p, c in got)


@pytest.fixture(scope="module")
def facts(spark):
    files = tree(spark).select(F.lit("").alias("r"), F.lit("").alias("repo"), "rel_path", F.col("rel_path").alias("file_path"), "ext", F.col("content").alias("text"))
    return P.facts(files.withColumn("repo", F.lit(None).cast("string"))).cache()


def test_facts(facts):
    rows = facts.collect()
    symbols = {(r.fqn, r.type) for r in rows if r.kind == "symbol"}
    assert {("pkg.core.Base", "class"), ("pkg.core.Base.Inner", "class"), ("pkg.core.Base.Inner.deep", "method"), ("pkg.core.guarded", "function"), ("pkg.sub._private.run", "function"), ("pkg.sub.broken.Ok.m", "method")} <= symbols
    assert {r.name for r in rows if r.kind == "decorator"} == {"decorate", "plain"}
    doc = next(r for r in rows if r.kind == "chunk" and r.name == "run")
    assert doc.docstring == "Döc." and doc.text.startswith("async def run(é")
    assert any(r.kind == "error" and "broken" in r.file_path for r in rows)


def test_reference_chunks(facts):
    names = {r.name for r in P.chunks(facts, "reference").collect()}
    assert {"helper", "Child", "Child.go", "run"} <= names and not names & {"Base", "guarded", "Base.Inner", "Base.Inner.deep"}
    assert {"Base", "guarded", "Base.Inner"} <= {r.name for r in P.chunks(facts).collect()}
    assert any(r[0] == "call" for r in P.legacy_graph("def f(): g()", "x.py"))


def test_edges(spark, facts):
    got = {(r.relation, r.source, r.target, r.resolved, r.confidence) for r in RS.edges(facts).collect()}
    for want in [
        ("inherits", "pkg.sub._private.Child", "pkg.core.Base", True, "high"), ("calls", "pkg.sub._private.Child.go", "pkg.core.Base.ping", True, "high"), ("calls", "pkg.sub._private.Child.go", "pkg.sub._private.Child.missing", True, "high"),
        ("instantiates", "pkg.sub._private.Child.go", "pkg.core.Base", True, "high"), ("calls", "pkg.sub._private.Child.go", "pkg.core.Base.pong", True, "high"), ("calls", "pkg.core.guarded", "pkg.core.Base.ping", True, "high"),
        ("calls", "pkg.sub._private.run", "pkg.sub._private.unique_name", True, "high"), ("calls", "pkg.core.nested", "pkg.core.helper", True, "high"), ("decorates", "plain", "pkg.core.Base", False, "low"),
        ("imports", "pkg/__init__.py", "core.Base", True, "high"), ("contains", "pkg.core.Base", "pkg.core.Base.ping", None, None), ("contains", "pkg/core.py", "pkg.core.helper", None, None), ("calls", "pkg.core.Base.ping", "pkg.core.Base.pong", True, "high"),
    ]:
        assert want in got, want


def test_imports(facts):
    got = {(r.local_name, r.imported_fqn, r.type) for r in RS.import_table(facts).where("file_path = 'pkg/core.py'").collect()}
    assert got == {("os", "os", "module"), ("a.b", "a.b", "module"), ("c", "a.b", "module"), ("sub", "pkg.sub", "symbol"), ("z", "other.y", "symbol"), ("*", "m2", "wildcard")}


def test_simple_names(spark):
    sym = spark.createDataFrame([("a.C", "class"), ("b.C", "class"), ("b.only", "function"), ("w.star", "function"), ("m.own", "function")], "fqn string, type string")
    imp = spark.createDataFrame([("f", "j", "json", "module", 1), ("f", "*", "w", "wildcard", 2)], "file_path string, local_name string, imported_fqn string, type string, ord int")
    names = spark.createDataFrame([("f", "m", n) for n in ["a.C", "j.loads", "star", "own", "only", "C", "nothing"]], "file_path string, module string, name string")
    df = RS.resolve_simple(names, sym, imp)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    got = {r.name: (r.target, r.resolved, r.confidence) for r in df.collect()}
    assert got == {"a.C": ("a.C", True, "high"), "j.loads": ("json.loads", True, "high"), "star": ("w.star", True, "high"), "own": ("m.own", True, "high"), "only": ("b.only", True, "medium"), "C": ("C", False, "low"), "nothing": ("nothing", False, "low")}


def test_rank_keeps_first_and_is_stable(spark):
    q = spark.createDataFrame([(0, "who calls Foo", "DEPENDENCY")], "qid long, question string, intent string")
    none = None
    rows = [(0, none, none, none, none, none, none, none, "a", 1), (0, none, none, none, none, none, none, none, "b", 2), (0, "f", "x.Foo", "class", "reverse_calls", "g", none, 3, "c", 3), (0, "f", "y", "class", none, none, 0.9, none, "d", 4), (0, "f", "z", "class", none, none, 0.5, none, "e", 5)]
    ctx = spark.createDataFrame(rows, "qid long, file_path string, symbol_name string, chunk_type string, relation string, graph_source string, score double, line int, text string, seq long")
    got = [(r.text, r.ranking_score) for r in R.ranked(ctx, q).orderBy("rank").collect()]
    assert got == [("c", 1.2), ("d", 0.9), ("a", 0.5), ("e", 0.5)]


def test_budget_and_answers(spark):
    q = spark.createDataFrame([(0, "q0", "GENERAL"), (1, "q1", "GENERAL")], "qid long, question string, intent string")
    rows = [(0, i, f"f{i}.py", "s", "class", "calls" if i == 1 else None, "g" if i == 1 else None, None, None, "x" * 5000) for i in range(1, 9)]
    ranked = spark.createDataFrame(rows, "qid long, rank int, file_path string, symbol_name string, chunk_type string, relation string, graph_source string, score double, line int, text string")
    kept = A.within_budget(ranked).collect()
    assert len(kept) == 5 and max(r.used for r in kept) <= A.BUDGET
    assert A.prompts(ranked, q).count() == 2
    answers = {r.qid: r.answer for r in A.fallback(ranked, q).collect()}
    assert "**calls**" in answers[0] and "No context" in answers[1]
    assert A.answer_one("p", "d", None) == "d" and A.answer_one("p", "d", lambda p: 1 / 0) == "d" and A.answer_one("p", "d", str.upper) == "P"


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_split(text):
    chunks = T.split_text(text, 50, 10) if text.strip() else []
    assert all(len(c) <= 50 and c.strip() == c for c in chunks)
    assert "".join(sorted(set("".join(chunks)) - set(" \n"))) == "".join(sorted(set(text) - set(" \n")))


def test_topk(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0]), ("g", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    assert [(r.id, r.cosine) for r in V.topk(df, "id", "v", [("q", [1.0, 0.0])], 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.0)]
    assert V.topk(df.limit(0), "id", "v", [("q", [1.0, 0.0])], 3).count() == 0


def test_plans(spark, small):
    from loamgraph.plans import engine_queries as E

    plan = E.QUERIES["detect_intent"](spark, small)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    plan = E.QUERIES["graph_neighbors"](spark, small)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan


def test_engine_end_to_end(spark, tmp_path):
    from loamgraph.api import Engine

    e = Engine.from_tree(spark, FIX, str(tmp_path), "demo")
    assert {r.what: r.n for r in e.summary().collect()}["files"] == 5
    a = e.chat("demo.pkg.core.helper used by whom")
    assert a["intent"] == "DEPENDENCY" and a["strategies"] == ["Reverse Graph Traversal"] and any(s["relation"] == "reverse_calls" for s in a["sources"])
    assert e.search("symbols", "Base").count() >= 1 and e.search("files", "core").count() == 1 and e.search("text", "helper").count() >= 1
    assert e.neighbours("demo.pkg.core.Base").count() > 2
    assert e.documents(2)[0] == 5 and len(e.documents(2)[1]) == 2 and e.text_pieces()["chunks"] >= 4 and e.code_chunks(n=2)[0] > 8
    assert e.vectors.read().count() == e.symbols.count() and any((x["score"] or 0) > 0 for x in e.hybrid("Tell me about helper")) and [x["name"] for x in e.symbol("Base")] == ["Base"]
    again = Engine.open(spark, str(tmp_path))
    assert [x["symbol_name"] for x in again.hybrid("Tell me about helper")] == [x["symbol_name"] for x in e.hybrid("Tell me about helper")]
    plain = Engine.from_tables(spark, str(tmp_path))  # without stored vectors: hashed on the way, with the same result
    assert [x["symbol_name"] for x in plain.hybrid("Tell me about helper")] == [x["symbol_name"] for x in e.hybrid("Tell me about helper")]
    assert e.embed("a b")[0] == V.DIM and e.health()["status"] == "ok" and e.graph()[0].count() > 5


def test_stream(spark, tmp_path):
    from loamgraph.streaming.reindex import facts_stream

    schema = "repo string, rel_path string, file_path string, ext string, text string"
    spark.createDataFrame([("r", "a.py", "r/a.py", ".py", "def f(): pass")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        facts_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'symbol'").count() == 1


def test_queries_match_sql(spark, small):
    """A few queries of each kind against SQL on the smallest data; the driver compares all."""
    import glob

    import duckdb

    from loamgraph.plans import core_queries, engine_queries

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for m, name in [(core_queries, "p5_found"), (core_queries, "p7_found"), (engine_queries, "search_imports"), (engine_queries, "graph_context"), (engine_queries, "class_hierarchy"), (engine_queries, "query_term"), (engine_queries, "resolve_simple")]:
        got = m.QUERIES[name](spark, small)
        cols = sorted(got.columns)
        want = c.sql(f"select {', '.join(cols)} from ({m.SQL[name]})").fetchall()
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want)), name


def test_stores(spark, tmp_path):
    from loamgraph.sources import store as ST

    nodes = spark.createDataFrame([("a", "file", "a.py")], ST.NODES)
    edges = spark.createDataFrame([("a", "b", "calls", True, "high", "a.py", 1)], ST.EDGES)
    with pytest.raises(FileNotFoundError):
        ST.load_graph(spark, str(tmp_path / "none"))
    ST.save_graph(nodes, edges, str(tmp_path / "g"))
    assert [x.count() for x in ST.load_graph(spark, str(tmp_path / "none"), str(tmp_path / "g"))] == [1, 1]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "type": "file"}, {"id": "b"}], "edges": [{"source": "a", "target": "b", "relation": "calls"}]}')
    assert [x.count() for x in ST.load_graph(spark, str(tmp_path / "g.json"))] == [2, 1]
    ST.export_graph_json(nodes, edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "edges")).count() == 1
    ix = ST.load_indexes(spark, str(tmp_path / "i"))
    assert set(ix) == set(ST.INDEXES) and ix["symbols"].count() == 0
    v = ST.VectorStore(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        v.upsert(spark.createDataFrame([], "point_id string, embedding array<float>, text string, file_path string, chunk_type string, symbol_name string"))
    v.create(2)
    v.create(3)
    point = lambda i, e, t: (i, e, t, "f", "class", "S")
    schema = "point_id string, embedding array<float>, text string, file_path string, chunk_type string, symbol_name string"
    v.upsert(spark.createDataFrame([point("1", [1.0, 0.0], "one"), point("2", [0.0, 1.0], "two")], schema))
    v.upsert(spark.createDataFrame([point("2", [1.0, 0.1], "new")], schema))
    assert [(r.point_id, r.text) for r in v.search([1.0, 0.0], 2).orderBy("rank").collect()] == [("1", "one"), ("2", "new")]
    with pytest.raises(ValueError):
        v.upsert(spark.createDataFrame([point("3", [1.0], "bad")], schema))
    assert v.by_symbol("S").count() == 2
    v.drop()
    assert v.current() is None and v.read().count() == 0


def test_long_expressions(spark):
    """Chains far deeper than the interpreter's own calls may nest give all their calls; nothing fails."""
    chain = "def f():\n    return " + " + ".join(f"g{i}()" for i in range(5000)) + "\n"
    elifs = "if a:\n    pass\n" + "".join(f"elif b{i}:\n    def h{i}(): pass\n" for i in range(1500))
    closed = "def g():\n    return " + "(" * 3000 + "x()" + ")" * 3000 + "\n"
    rows = [(None, f"{n}.py", f"{n}.py", ".py", t) for n, t in [("chain", chain), ("elifs", elifs), ("closed", closed), ("odd", "def h(): return 'x\ud800'.encode('utf-8', 'surrogatepass') if False else 1\n".encode("utf-8", "replace").decode())]]
    files = spark.createDataFrame(rows, "repo string, rel_path string, file_path string, ext string, text string")
    facts = P.facts(files).cache()
    n = {(r.file_path, r.kind): r["count"] for r in facts.groupBy("file_path", "kind").count().collect()}
    assert n["chain.py", "call"] == 5000 and n["elifs.py", "chunk"] == 1500 and n["closed.py", "error"] == 1 and n["closed.py", "symbol"] == 1
    assert RS.edges(facts).where("relation = 'calls' and file_path = 'chain.py'").count() == 5000
    assert {r.kind for r in P.facts(files, ["import", "contains"]).select("kind").distinct().collect()} == {"contains"}


def test_deep_bases(spark):
    """Methods are found however many bases up; cycles of bases end."""
    src = "class C0:\n    def m(self): pass\n" + "".join(f"class C{i}(C{i - 1}):\n    pass\n" for i in range(1, 150)) + "class C150(C149):\n    def go(self):\n        self.m()\nclass X(Y):\n    def a(self):\n        self.b()\nclass Y(X):\n    def b(self):\n        self.c()\n"
    files = spark.createDataFrame([(None, "a.py", "a.py", ".py", src)], "repo string, rel_path string, file_path string, ext string, text string")
    got = {(r.source, r.target) for r in RS.edges(P.facts(files), ["calls"]).collect()}
    assert got == {("a.C150.go", "a.C0.m"), ("a.X.a", "a.Y.b"), ("a.Y.b", "a.Y.c")}


def test_many_terms(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_TERMS", 2)
    sym = spark.createDataFrame([(f"m.f{i}", f"f{i}", "function", "f", 1, i, i, "") for i in range(5)], "fqn string, name string, type string, file string, line int, ord long, chunk_id long, text string")
    assert {(r.term, r.fqn) for r in S.search_symbols(sym, [f"F{i}" for i in range(5)]).collect()} == {(f"F{i}", f"m.f{i}") for i in range(5)}


def test_class_hierarchy(spark):
    from loamgraph.operators import index as I

    e = spark.createDataFrame([(1, "m.A", "Base", "inherits", 1), (2, "m.B", "m.A", "inherits", 2), (3, "m.C", "A", "inherits", 3)], "edge_id long, source string, target string, relation string, ord long")
    rows = I.class_hierarchy(e, spark.createDataFrame([("m.A",)], "fqn string")).collect()
    assert [(r.fqn, r.base_classes, r.subclasses) for r in rows] == [("m.A", ["Base"], ["m.B", "m.C"])]


def test_rendered_sources(spark, small):
    import glob

    import duckdb

    from loamgraph.plans import rendered_queries as Q

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name in ("ast_chunks", "edges_calls", "var_types"):
        got = Q.QUERIES[name](spark, small)
        cols = sorted(got.columns)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, c.sql(f"select {', '.join(cols)} from ({Q.SQL[name]})").fetchall())), name


def test_index_pipeline(spark, tmp_path):
    """Counts of a run; classes of its errors; vectors of another model are searched with that model."""
    import shutil as sh

    from loamgraph import api

    def fetch(url, to):
        sh.copytree(FIX, to)
        return to

    two = lambda texts: [[1.0 + t.count("helper"), 1.0] for t in texts]
    got = api.Engine.index(spark, "https://github.com/acme/demo/", str(tmp_path / "w"), str(tmp_path / "o"), fetch, embed=two)
    assert got["success"] and got["repository"] == "acme/demo" and got["documents"] == 5 and got["indexed"] == got["chunks"] > 8 and got["graph_nodes"] > 8 and got["graph_edges"] > 8
    e = api.Engine.open(spark, str(tmp_path / "o"), embed=two)
    assert e.vectors.current()[0] == 2 and "helper" in e.hybrid("tell of helper, helper, helper")[0]["text"]
    assert api.Engine.index(spark, "https://example.com/a/b", "w", "o")["error"] == "clone_failed"
    for message, kind in [("git is not available on this machine", "git_missing"), ("lost connection", "store_unavailable"), ("odd", "indexing_failed")]:

        def fail(url, to, message=message):
            raise RuntimeError(message)

        assert api.Engine.index(spark, "https://github.com/a/b", "w", "o", fail) == {"success": False, "error": kind, "details": message}
    (tmp_path / "ro").mkdir()
    (tmp_path / "ro" / "f").write_text("x")
    os.chmod(tmp_path / "ro" / "f", 0o400)
    api.remove_tree(str(tmp_path / "ro"))
    api.remove_tree(str(tmp_path / "ro"))
    assert not (tmp_path / "ro").exists()


def test_store_parts(spark, tmp_path, monkeypatch):
    """Of a point in several parts the last counts; many parts become one."""
    from loamgraph.sources import store as ST

    assert ST.VectorStore.connect(spark, "nosuch://host/v", str(tmp_path / "w")).path == str(tmp_path / "w")
    with pytest.raises(ConnectionError):
        ST.VectorStore.connect(spark, "nosuch://host/v")
    monkeypatch.setattr(ST.VectorStore, "PARTS", 3)
    v = ST.VectorStore(spark, str(tmp_path / "v"))
    v.create(1)
    for i in range(4):
        v.upsert(spark.createDataFrame([("a", [float(i)], f"t{i}", "f", "c", "s"), ("a", [9.0], None, "f", "c", "s"), (f"b{i}", [1.0], "x", "f", "c", "s"), (None, [1.0], "x", "f", "c", "s")], ST.POINTS))
    assert {r.point_id: r.text for r in v.read().collect()} == {"a": "t3", "b0": "x", "b1": "x", "b2": "x", "b3": "x"}
    assert len(v.current()[1]) == 2 and len([x for x in os.listdir(tmp_path / "v") if x.startswith("v_")]) == 2
