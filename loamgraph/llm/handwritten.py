"""Generated, minified or vendored source files, from layout statistics with thresholds per language.

The statistics (`layout`) are line lengths, shares of white space, letters and digits, the density of numeric literals and of
numbered names, long encoded runs, and how few distinct line shapes there are; `LIMITS` has the thresholds of each
language. What layout can't show is looked up: a generator's notice in the comments before the first statement or after all code, and the names of
known packages (a bounded table) in the path or in a notice of origin. Copies without either are
found by a hash of the body (without white space and comment lines) among the files of the packages' own repositories and
the copies already known.

Texts are read once, in one narrow pass, which gives a row of statistics, marks and a 128-bit hash of the body; those rows are written and
meet each other, the texts go nowhere.

Defined results: null text is no code and is kept as hand-written; files of other extensions than `LIMITS` has are
configuration and hand-written, as are tests; empty files are hand-written; a package without home_repo, or with one that
isn't in `files`, is only recognised by path and notice; bodies shorter than `LEAST_COPY` are not compared, nor are texts shorter than
`LEAST_DATA` called data, as they agree or look so by chance; repeated rows are judged each; empty tables give an
empty result. The kinds are tried in the order vendored, generated (by notice), minified, data, generated (by layout).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm import layout
from loamgraph.session import cut

LEAST_COPY = 200
LEAST_DATA = 400


@dataclass(frozen=True)
class Limits:
    """Thresholds of a language. Generated: at least so large a share of numbered names, at most so many shapes a line. Minified: lines at
    least so long, at most and on average, with at most so much white space. Data: shares of numbers, digits, encoded runs, escapes."""

    numbered: float
    shapes: float
    longest: int
    mean: float
    space: float
    numbers: float = 0.35
    digits: float = 0.3
    encoded: float = 0.5
    escapes: float = 0.5
    data: bool = True  # whether data is saved as files of this language


# markup repeats the shapes of its lines, types repeat those of fields; Python can't be put on one line
LIMITS = {".py": Limits(0.2, 0.42, 500, 200, 0.08), ".js": Limits(0.17, 0.4, 300, 110, 0.12), ".ts": Limits(0.15, 0.38, 300, 110, 0.12), ".jsx": Limits(0.2, 0.32, 300, 110, 0.12, data=False), ".tsx": Limits(0.2, 0.32, 300, 110, 0.12, data=False)}
LEAST_LINES = 8
TEST = re.compile(r"(?i)(?:^|/)(?:tests?|__tests__|specs?)/|(?:^|/)(?:test_[^/]*|[^/]*_test|[^/]*\.(?:test|spec))\.[a-z]+$")

# Words of generators' notices, in the languages they are written in.
NOTICE = (
    r"(?i)(?:^|\W)(?:code generated\b.*\bdo not edit|@generated\b|auto-?generated (?:file|code|by|from)|automatically (?:generated|produced|created) (?:by|from|with|using)|"
    r"(?:this )?(?:file|code|module) (?:was |is |has been )?(?:auto-?|automatically )?(?:generated|produced|created) (?:automatically )?(?:by|from|with|using)\b|"
    r"machine[- ](?:written|generated|made)\b|generated by (?:the )?[\w.-]+(?: compiler| v?\d|\W*$)|produced by [\w.-]+ from\b|do not (?:edit|modify)\b.*\bgenerat|generat.*\bdo not (?:edit|modify)\b|"
    r"automatisch (?:mit|von|durch|aus) .{1,60} (?:erzeugt|erstellt|generiert)|nicht (?:bearbeiten|ändern)|(?:produit|généré|créé) automatiquement|ne pas (?:modifier|éditer)|"
    r"generado automáticamente|no (?:editar|modificar))"
)
NOT_NOTICE = r"(?i)\b(?:not|isn't|never|instead of being) (?:auto-?|automatically )?generated\b"



NOTICES, NOT_NOTICES = re.compile(NOTICE), re.compile(NOT_NOTICE)


def noticed(*blocks: str) -> bool:
    """Whether one of the comment blocks holds a generator's notice."""
    return any(b and NOTICES.search(b) and not NOT_NOTICES.search(b) for b in blocks)


def origins(packages: list[str]) -> tuple[re.Pattern, re.Pattern] | None:
    """(folders in a path, notices of origin) that name one of the packages; all in one alternation each."""
    if not packages:
        return None
    q = "|".join(re.escape(p) for p in sorted(packages, key=lambda p: (-len(p), p)))
    folder = re.compile(rf"(?:^|(?<=/))({q})(?=/[^/]*(?:/|\.|$))")
    notice = re.compile(
        rf"(?i)(?:vendored|copied|taken|imported|upstream|derived|adapted|bundled)\b[^\n]*\b({q})\b|\b({q}) v?\d+\.\d+[^\n]*(?:\(c\)|©|copyright|licen[cs]e)|\bpart of ({q})\b|(?:\(c\)|©|copyright)[^\n]*\b({q}) (?:developers|authors|contributors|team)"
    )
    return folder, notice


def kinds(ext: list[str], s: dict[str, np.ndarray], notice: np.ndarray) -> list[str | None]:
    """generated, minified, data or None, by the limits of each file's language."""
    lim = lambda f: np.array([getattr(LIMITS[x], f) if x in LIMITS else 0 for x in ext])
    code = np.array([x in LIMITS for x in ext], bool)
    generated = ((s["numbered"] > lim("numbered")) & (s["lines"] >= LEAST_LINES) & (s["shapes"] < lim("shapes")))
    minified = (s["max_line"] > lim("longest")) & (s["mean_line"] > lim("mean")) & (s["space"] < lim("space")) & (s["statements"] > 2)
    dense = (s["numbers"] > lim("numbers")) | (s["digits"] > lim("digits")) | (s["encoded"] > lim("encoded")) | (s["escapes"] > lim("escapes")) | (s["statements"] == -1)
    data = lim("data").astype(bool) & (s["statements"] <= 1) & (s["chars"] > LEAST_DATA) & dense
    return [("generated" if n else "minified" if m else "data" if d else "generated" if g else None) if c else None for c, n, g, m, d in zip(code, notice, generated, minified, data)]


LITERAL = re.compile(r"\s*[\[{]\s*[\"\[{\d].*[\]}]\s*;?\s*\Z", re.S)  # one list or mapping is the whole text


def classify(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file_id, repo, file_path, ext, kind, s): kind vendored, generated, minified or data, null for hand-written."""
    known = {r["package"]: r["home_repo"] for r in packages.select("package", "home_repo").distinct().collect() if r["package"]}  # a small fixed table
    forms, homes = origins(list(known)), {h for h in known.values() if h}
    ext = F.lower(F.coalesce("ext", F.regexp_extract("file_path", r"(\.[^./]+)$", 1)))
    rel = F.coalesce("rel_path", F.regexp_replace("file_path", "^repositories/[^/]*/", ""))
    src = files.select("file_id", "repo", "file_path", ext.alias("ext"), F.coalesce(rel, F.lit("")).alias("rel"), "text")

    def away(names, repo: str | None) -> bool:  # noqa: ANN001
        return any(known.get(x) is None or known[x] != repo for x in names)

    def run(batches):
        for batch in batches:
            done = 0
            for texts in layout.slices(batch.column("text")):
                b = batch.slice(done, len(texts))
                done += len(texts)
                repos, exts, rels = (b.column(c).to_pylist() for c in ("repo", "ext", "rel"))
                found = layout.measured(texts)
                code = [x in LIMITS for x in exts]
                foreign = [bool(c and forms and (away(forms[0].findall(r), repo) or away([g for m in forms[1].findall(p) for g in m if g], repo))) for c, r, repo, p in zip(code, rels, repos, found.preambles)]
                s = dict(found.stats)
                literal = [n > LEAST_DATA and st == 0 and bool(LITERAL.match(t or "")) for n, st, t in zip(s["chars"], s["statements"], texts.to_pylist())]
                own = kinds(exts, s | {"statements": np.where(literal, -1, s["statements"])}, np.array([c and noticed(p, t) for c, p, t in zip(code, found.preambles, found.tails)], bool))
                kind = [None if TEST.search(r) else k for r, k in zip(rels, own)]
                has = np.array(code, bool) & (s["chars"] >= LEAST_COPY)
                halves = np.frombuffer(b"".join(found.bodies), np.int64).reshape(-1, 2) if len(texts) else np.zeros((0, 2), np.int64)
                cols = [pa.array(s[f].astype(np.int64 if t == "bigint" else np.float64)) for f, t in layout.FIELDS.items()]
                flags = [pa.array(foreign, pa.bool_()), pa.array(kind, pa.string()), pa.array(has), pa.array([r in homes for r in repos], pa.bool_()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file_id", "repo", "file_path", "ext")), *cols, *flags], ["file_id", "repo", "file_path", "ext", *layout.FIELDS, "foreign", "kind", "has", "home", "b1", "b2"])

    kept = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("file_id", "repo", "file_path", "ext"))
    judged, _ = cut(src.mapInArrow(run, kept + ", " + ", ".join(f"{f} {t}" for f, t in layout.FIELDS.items()) + ", foreign boolean, kind string, has boolean, home boolean, b1 bigint, b2 bigint"), "layout")
    copies = judged.where("has and (foreign or home)").select("b1", "b2").distinct().withColumn("copied", F.lit(True))
    # rows without a body to compare can't match
    keyed = judged.withColumn("k1", F.when(F.col("has") & ~F.col("home"), F.col("b1"))).withColumn("k2", F.col("b2"))
    found = keyed.join(copies.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), "copied"), ["k1", "k2"], "left")
    vendored = F.col("foreign") | F.coalesce("copied", F.lit(False))
    return found.select("file_id", "repo", "file_path", "ext", F.when(vendored, "vendored").otherwise(F.col("kind")).alias("kind"), F.struct(*layout.FIELDS).alias("s"))
