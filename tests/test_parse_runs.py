"""Runs of plain call lines, and the size of what the parser hands on."""

import pyarrow as pa

from loamgraph.operators import parse as P

CALLS = "    a()\n    x = b.C()\n    x.d()\n"


def test_facts_leave_in_small_batches():
    text = "def f():\n" + "    p1()\n" * 3000
    given = pa.RecordBatch.from_arrays([pa.array([f"f{i}.py" for i in range(40)]), pa.array(["m"] * 40), pa.array([text] * 40)], ["file_path", "module", "text"])
    sizes = [b.num_rows for b in P.fact_batches([given], frozenset(["call"]))]
    assert sum(sizes) == 120_000 and max(sizes) < P.BATCH_ROWS + 3000


def test_folded_runs_give_the_same_facts(monkeypatch):
    sources = [
        "def f():\n" + CALLS + "    return x.d()\n",
        "class A(B):\n  def g(self):\n" + CALLS + "\n  def h(self):\n" + CALLS,
        "def f():\n    z = (\n    a()\n    )\n" + CALLS,
        'def f():\n    """\n' + CALLS + '    """\n' + CALLS,
        "def f():\n    z = (\n" + CALLS + "    )\n",
        "def f():\n    if z: \\\n" + CALLS,
        "class A:\n" + CALLS,
        "def f():\n    not()\n    None()\n" + CALLS,
        "def \u00e9():\n" + CALLS + "    \u00e9(1)\n",
    ]
    parsed = []
    monkeypatch.setattr(P.ast, "parse", lambda s, f=P.ast.parse: (parsed.append(s), f(s))[1])
    got = [P.facts_of(s, "m") for s in sources]
    assert b"x.d()\n    x" not in parsed[0] and P.STAND_IN.encode() in parsed[0]
    monkeypatch.setattr(P._Visitor, "folded", lambda self, source: None)
    assert got == [P.facts_of(s, "m") for s in sources]
