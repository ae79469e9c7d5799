import datetime as dt

import pytest

from loamgraph.llm import docpairs as D

SCHEMA = "chunk_id long, text string, chunk_type string, symbol_name string, fqn string, file_path string, indexed_at timestamp_ntz, kind string, documentation string, bases string"
DOC = "Walks the queue and drops what is stale."
YES = [
    ("a.py", f'def f(x):\n    """{DOC}"""\n    return x'), ("a.py", f"def f(x):\n    r'''{DOC}'''"), ("a.py", f'def f(x): "{DOC}"; return x'), ("a.py", f"# {DOC}\n@retry(\n  3)\nasync def f(x): pass"), ("a.py", f'def f(\n    x="):",\n):\n    # note\n\n    ("Walks the queue"\n     " and drops what is stale.")\n    pass'), ("a.py", f"# TODO\n# {DOC}\ndef f(): pass"),
    ("a.py", 'def f(x):\n    """\n    Args:\n        x: The queue whose stale entries go.\n    """'), ("a.js", f"/** {DOC} */\nfunction f() {{}}"), ("a.ts", f"// {DOC}\nexport const f = () => 1;"), ("a.js", f"/* eslint-disable no-console */\n/*\n  {DOC}\n*/\nf() {{}}"), ("a.py", f'def broken(:\n   pass\n\ndef f():\n    """{DOC}"""') if False else ("a.py", f'def f():\r\n    """{DOC}"""\r\n'), ("a.js", "/**\n * @param queue The entries to look through first.\n */\nf(queue) {}"),
    ("a.py", '    def f(self):\n        """Liest die Zeilen der Reihe nach und bricht ab."""'),
]
NO = [
    ("a.py", "def f(x):\n    return x"), ("a.py", f'def f(x):\n    f"""{DOC}"""'), ("a.py", f'def f(x):\n    b"""{DOC}"""'), ("a.py", f'def f(x):\n    print(1)\n    """{DOC}"""'), ("a.py", f'def f(x):\n    note = """{DOC}"""'), ("a.py", f'def f(x):\n    def g():\n        """{DOC}"""\n    return g'), ("a.py", 'def merge_cache(x):\n    """Merge the cache."""'), ("a.py", 'def merge_cache(x):\n    """merge_cache()"""'),
    ("a.py", 'def f(x):\n    """TODO: write docs"""'), ("a.py", 'def f(x):\n    """Docstring goes here."""'), ("a.py", 'def f(x):\n    """ """'), ("a.py", 'def f(x):\n    """\n    :param x:\n    :return:\n    """'), ("a.py", "# noqa: C901\ndef f(): pass"), ("a.py", "# ------\ndef f(): pass"), ("a.py", "# x = refresh_ledger(x)\n# return x\ndef f(x): pass"), ("a.js", "// const a = split(b);\nfunction f() {}"),
    ("a.js", "/** */\nfunction f() {}"), ("a.js", "/**\n * @param x\n * @returns\n */\nfunction f(x) {}"), ("a.ts", "// @ts-ignore\nf(): any {}"), ("a.js", f"f() {{\n  /** {DOC} */\n  function g() {{}}\n}}"), ("a.py", f"# {DOC}\n\nx = 1\ndef f(): pass"), ("a.py", f'def f(x):\n    """{DOC}""" % x'), ("a.py", ""), ("a.py", None), ("a.py", "# fmt: off\n@cached\ndef f(): pass"),
]


@pytest.mark.parametrize("path,text", YES)
def test_documented(path, text):
    assert D.own_documentation(text, None, path)[0]


@pytest.mark.parametrize("path,text", NO)
def test_not_documented(path, text):
    assert D.own_documentation(text, "merge_cache", path)[0] is None


def test_table(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    base = f'class Base:\n    def f(self):\n        """{DOC}"""'
    rows = [
        (1, f'def f(self):\n    """{DOC}"""', "Method", "Base.f", "r.m.Base.f", "repositories/r/m.py", t(1)), (2, "def f(self): pass", "METHOD", "Child.f", "r.n.Child.f", "repositories/r/n.py", t(1)), (3, base, "class", "Base", "r.m.Base", "repositories/r/m.py", t(1)), (4, "class Child(Base): pass", "class", "Child", "r.n.Child", "repositories/r/n.py", t(1)),
        (5, "class Grand(Child): pass", "class", "Grand", "r.n.Grand", "repositories/r/n.py", t(1)), (6, "def f(self): pass", "method", "Grand.f", "r.n.Grand.f", "repositories/r/n.py", t(1)), (7, "def g(): pass", "function", "g", "r.g", "repositories/r/g.py", t(2)), (7, f'def g():\n    """{DOC}"""', "function", "g", "r.g", "repositories/r/g.py", t(1)),
        (8, f'def h():\n    """{DOC}"""', None, "h", "r.h", "repositories/r/g.py", t(1)), (9, f'def i():\n    """{DOC}"""', "function", None, None, None, None), (None, f'def j():\n    """{DOC}"""', "function", "j", "r.j", None, None), (10, "class A(B): pass", "class", "A", "r.c.A", "repositories/r/c.py", t(1)), (11, "class B(A): pass", "class", "B", "r.c.B", "repositories/r/c.py", t(1)), (12, "def f(self): pass", "method", "A.f", "r.c.A.f", "repositories/r/c.py", t(1)),
    ]
    df = spark.createDataFrame([(*r, "k", "d", "b") for r in rows], SCHEMA)
    got = {(r.chunk_id, r.documented_by, r.levels) for r in D.pairs(df).collect()}
    assert got == {(1, 1, 0), (9, 9, 0), (2, 1, 1), (6, 1, 2)}
    assert D.pairs(spark.createDataFrame([], SCHEMA)).count() == 0


INHERITED = [
    ("a.py", 'def f(x):\n    """{@inheritDoc}"""'), ("a.py", 'def f(x):\n    """See the base class."""'), ("a.py", "# see base class\ndef f(x): pass"), ("a.js", "/** {@inheritDoc} */\nfunction f() {}"), ("a.ts", "/**\n * @inheritdoc\n */\nf(): any {}"), ("a.ts", "/**\n * {@inheritDoc}\n * @param x\n * @override\n */\nf(x): any {}"), ("a.js", "// See the parent class.\nfunction f() {}"),
]


@pytest.mark.parametrize("path,text", INHERITED)
def test_a_reference_to_the_base_is_no_documentation(path, text):
    assert D.own_documentation(text, "merge_cache", path)[0] is None


@pytest.mark.parametrize("text", [f"{{@inheritDoc}}\n\n{DOC}", f"See the base class.\n{DOC}", "See the base class for how stale entries are dropped."])
def test_a_reference_and_more_is_documentation(text):
    assert D.own_documentation(f'def f(x):\n    """{text}"""', None, "a.py")[0] == "docstring"


def table(spark, rows):
    return spark.createDataFrame([(*r, f"repositories/r/{r[4].split('.')[1]}.py", dt.datetime(2024, 1, 1), "k", "d", "b") for r in rows], SCHEMA)


def test_reference_takes_the_documentation_of_the_base(spark):
    rows = [(1, "class Base: pass", "class", "Base", "r.m.Base"), (2, f'def f(self):\n    """{DOC}"""', "method", "Base.f", "r.m.Base.f"), (3, f'def g(self):\n    """{DOC}"""', "method", "Base.g", "r.m.Base.g"), (4, "class Child(Base): pass", "class", "Child", "r.m.Child")]
    rows += [(5, 'def f(self):\n    """{@inheritDoc}"""', "method", "Child.f", "r.m.Child.f"), (6, 'def g(self):\n    """See the base class."""', "method", "Child.g", "r.m.Child.g")]
    got = {r.chunk_id: (r.documented_by, r.levels, r.documentation) for r in D.pairs(table(spark, rows)).collect()}
    assert got == {2: (2, 0, DOC), 3: (3, 0, DOC), 5: (2, 1, DOC), 6: (3, 1, DOC)}


def test_all_bases_are_climbed(spark):
    cls = lambda i, n, b="": (i, f"class {n}{b}: pass", "class", n, f"r.m.{n}")
    doc = lambda i, n: (i, f'def f(self):\n    """{DOC}"""', "method", n, f"r.m.{n}")
    bare = lambda i, n: (i, "def f(self): pass", "method", n, f"r.m.{n}")
    rows = [cls(1, "Mixin"), cls(2, "Base"), doc(3, "Base.f"), cls(4, "A", "(Mixin, Base)"), bare(5, "A.f")]  # only the second base
    rows += [cls(10, "Other"), doc(11, "Other.f"), cls(12, "B", "(Other, Base)"), bare(13, "B.f")]  # the first of two
    rows += [cls(20, "Deep", "(Other)"), cls(21, "C", "(Deep, Base)"), bare(22, "C.f")]  # the nearest level
    rows += [cls(30, "X", "(Y)"), cls(31, "Y", "(X, Z)"), cls(32, "Z", "(Base)"), bare(33, "X.f")]  # out of a cycle
    got = {r.chunk_id: (r.documented_by, r.levels) for r in D.pairs(table(spark, rows)).where("levels > 0").collect()}
    assert got == {5: (3, 1), 13: (11, 1), 22: (3, 1), 33: (3, 3)}


def test_no_level_is_too_deep(spark):
    rows = [(i, f"class C{i}{f'(C{i - 1})' if i else ''}: pass", "class", f"C{i}", f"r.m.C{i}") for i in range(36)]
    rows += [(100, f'def f(self):\n    """{DOC}"""', "method", "C0.f", "r.m.C0.f"), (101, "def f(self): pass", "method", "C35.f", "r.m.C35.f")]
    assert [(r.chunk_id, r.documented_by, r.levels) for r in D.pairs(table(spark, rows)).where("levels > 0").collect()] == [(101, 100, 35)]
