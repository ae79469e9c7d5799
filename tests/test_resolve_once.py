"""Names are resolved where they stand, with what their file imports; relations take only the facts they are made of."""

from pyspark.sql import functions as F

from loamgraph.operators import parse as P
from loamgraph.operators import resolve as RS

FILES = [
    ("w.py", "def go():\n    pass\nclass K:\n    pass\n"),
    ("a.py", "from w import *\nimport b as c\nclass K:\n    pass\ndef go():\n    pass\ndef f():\n    K()\n    c.go()\n    one()\n    x = K()\n    x.go()\n    return x.go\n"),
    ("b.py", "from w import *\nclass K:\n    pass\ndef go():\n    pass\n"),
    ("d.py", "from w import *\ndef one():\n    go()\n    K()\n    none()\n"),
    ("e.py", "def g():\n    go()\n    one()\n"),
]


def _facts(spark, kinds):
    return P.facts(spark.createDataFrame([(None, p, p, ".py", t) for p, t in FILES], "repo string, rel_path string, file_path string, ext string, text string"), kinds)


def test_names_are_resolved_in_one_move(spark):
    facts = _facts(spark, RS.kinds_for(["calls"]))
    got = {(r.file_path, r.name, r.target, r.confidence, r.is_class) for r in RS.resolved_uses(facts, ["call"], RS.symbol_table(facts)).collect()}
    assert got == {
        ("a.py", "K", "w.K", "high", True), ("a.py", "c.go", "b.go", "high", None), ("a.py", "one", "d.one", "medium", False), ("a.py", "x.go", "x.go", "low", False),
        ("d.py", "go", "w.go", "high", False), ("d.py", "K", "w.K", "high", True), ("d.py", "none", "none", "low", False), ("e.py", "go", "go", "low", False), ("e.py", "one", "d.one", "medium", False),
    }


def test_returns_need_no_calls(spark):
    assert "call" not in RS.kinds_for(["returns"]) and "return" not in RS.kinds_for(["calls"])
    alone, among = RS.edges(_facts(spark, RS.kinds_for(["returns"])), ["returns"]), RS.edges(_facts(spark, P.KINDS)).where(F.col("relation") == "returns")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, among.collect())) != []
