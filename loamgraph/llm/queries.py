"""Queries of the operators for language-model data. SQL is given where SQL can say the same over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.llm import credentials, docpairs, handwritten, mixing, neighbours, packing, planted, subjects, syntax
from loamgraph.session import table


def p1_found(spark, d):
    return syntax.verdicts(table(spark, d, "files")).where("not valid").select("file_id")


def p1_report(spark, d):
    return syntax.report(syntax.verdicts(table(spark, d, "files")))


def p1_chunks(spark, d):
    return syntax.broken_chunks(syntax.verdicts(table(spark, d, "files")), table(spark, d, "chunks"))


def p2_found(spark, d):
    return neighbours.neighbour_pairs(table(spark, d, "vectors"), "point_id", "vector")


def p2_neighbours(spark, d):
    return neighbours.neighbours(table(spark, d, "vectors"), "point_id", "vector")


def p3_found(spark, d):
    return credentials.credentials(table(spark, d, "files")).select("file_id", "line_no").distinct()


def p3_redacted(spark, d):
    return credentials.redacted(table(spark, d, "files"))


def p3_index(spark, d):
    return credentials.index_report(table(spark, d, "files"))


def p4_found(spark, d):
    return docpairs.pairs(table(spark, d, "chunks")).where("levels = 0").select("chunk_id")


def p4_pairs(spark, d):
    return docpairs.pairs(table(spark, d, "chunks"))


def p6_found(spark, d):
    return handwritten.classify(table(spark, d, "files"), table(spark, d, "packages")).where("kind is not null").select("file_id")


def p6_files(spark, d):
    return handwritten.classify(table(spark, d, "files"), table(spark, d, "packages")).select("file_id", "file_path", "kind", "s.*")


def p8_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p8_report(spark, d):
    return packing.pack_report(packing.pack(table(spark, d, "documents")))


def p8_check(spark, d):
    """What must hold of the containers, counted: fuller than the capacity, items that overlap or leave gaps, texts not whole or cut
    where they needn't be, and the texts packed."""
    capacity = packing.CAPACITY
    packed = packing.pack(table(spark, d, "documents"))
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.max(F.col("offset") + F.col("size")).alias("end"), F.min("offset").alias("first"), F.count("*").alias("n"), F.count_distinct("offset").alias("places"))
    box = per.agg(F.count_if(F.col("used") > capacity).alias("too_full"), F.count_if((F.col("end") != F.col("used")) | (F.col("first") != 0) | (F.col("n") != F.col("places"))).alias("misplaced"))
    texts = packed.groupBy("id").agg(F.sum("size").alias("tokens"), F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n"), F.count_distinct("start").alias("places"))
    text = texts.agg(F.count_if((F.col("tokens") != F.col("end")) | (F.col("n") != F.col("places"))).alias("not_whole"), F.count_if(F.col("n") != F.ceil(F.col("tokens") / capacity)).alias("cut_too_often"), F.count("*").alias("documents"))
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("x")).select("x.*")
    return rows(box).unionByName(rows(text))


def p9_check(spark, d):
    """Per source with a target and texts: whether it stays within its cap, and whether each of its blocks occurs once in a pass."""
    targets = table(spark, d, "mix_targets")
    m = mixing.mix(table(spark, d, "documents"), targets)
    once = m.groupBy("source", "block", "pass").agg(F.count("*").alias("n")).groupBy("source").agg((F.max("n") == 1).alias("each_once"), (F.max("pass") + 1).alias("passes"))
    caps = targets.groupBy("source").agg(F.max("max_repeats").alias("cap"))
    return once.join(caps, "source").select("source", "each_once", F.coalesce(F.col("passes") <= F.col("cap"), F.lit(True)).alias("within_cap"))


def p1_json(spark, d):
    """The verdicts on data files, which SQL can judge too; beside the files, their first halves, which are cut off."""
    f = table(spark, d, "files").where(F.lower("ext") == ".json")
    half = f.withColumn("file_id", -F.col("file_id") - 1).withColumn("text", F.left("text", F.floor(F.length("text") / 2).cast("int")))
    return syntax.verdicts(f.unionByName(half)).select("file_id", "valid")


def p4_inherited(spark, d):
    """Documentation that comes from an overridden method: the star schema as classes, a region's method documented, those of nations and suppliers
    below it not, or only by a reference to the base class."""
    t = {x: table(spark, d, x) for x in ("region", "nation", "supplier")}
    chunks = spark.sql(_CLASSES, **t)
    return docpairs.pairs(chunks).where("levels > 0").select("chunk_id", "levels", "documented_by", "documentation")


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.mix_report(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")), table(spark, d, "mix_targets"))


def _subjects(spark, d):
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p10_found(spark, d):
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark, d):
    return subjects.composition(_subjects(spark, d))


_AT = "cast('2024-01-01' as timestamp) as indexed_at"
# runs in both engines; ids: 1,000,000,000 * kind + key, classes in even kinds, their methods in odd ones
_CLASSES = f"""select cast(r_regionkey as bigint) as chunk_id, 'class R' || r_regionkey || ':' as text, 'class' as chunk_type, 'R' || r_regionkey as symbol_name, 'z.R' || r_regionkey as fqn, 'repositories/z/z.py' as file_path, {_AT} from {{region}}
 union all select 1000000000 + r_regionkey, 'def describe(self):\n    ''Tells the customs officer about region ' || r_regionkey || '.''', 'Method', 'R' || r_regionkey || '.describe', 'z.R' || r_regionkey || '.describe', 'repositories/z/z.py', {_AT} from {{region}}
 union all select 2000000000 + n_nationkey, 'class N' || n_nationkey || '(Plain, R' || n_regionkey || ', metaclass=M):', 'class', 'N' || n_nationkey, 'z.N' || n_nationkey, 'repositories/z/z.py', {_AT} from {{nation}}
 union all select 3000000000 + n_nationkey, 'def describe(self):\n    ''See the base class.''\n    return 1', 'method', 'N' || n_nationkey || '.describe', 'z.N' || n_nationkey || '.describe', 'repositories/z/z.py', {_AT} from {{nation}}
 union all select 4000000000 + s_suppkey, 'class S' || s_suppkey || '(N' || s_nationkey || '):', 'class', 'S' || s_suppkey, 'z.S' || s_suppkey, 'repositories/z/z.py', {_AT} from {{supplier}}
 union all select 5000000000 + s_suppkey, 'def describe(self):\n    return ' || s_suppkey, 'method', 'S' || s_suppkey || '.describe', 'z.S' || s_suppkey || '.describe', 'repositories/z/z.py', {_AT} from {{supplier}}
 union all select 6000000000 + s_suppkey, 'def lonely(self):\n    return ' || s_suppkey, 'method', 'S' || s_suppkey || '.lonely', 'z.S' || s_suppkey || '.lonely', 'repositories/z/z.py', {_AT} from {{supplier}}"""

QUERIES = {
    "p10_found": p10_found, "p10_composition": p10_composition,
    "p1_found": p1_found, "p1_json": p1_json, "p1_report": p1_report, "p1_chunks": p1_chunks,
    "p2_found": p2_found, "p2_neighbours": p2_neighbours,
    "p3_found": p3_found, "p3_redacted": p3_redacted, "p3_index": p3_index,
    "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_inherited": p4_inherited,
    "p6_found": p6_found, "p6_files": p6_files,
    "p8_containers": p8_containers, "p8_report": p8_report, "p8_check": p8_check, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_check": p9_check,
}
_VEC = """with c as (select point_id as id, cast(vector as double[]) as v from vectors where len(vector) = 64 and point_id is not null and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
 n as (select id, v, sqrt(list_dot_product(v, v)) as n from c), p as (select a.id, b.id as other, round(list_dot_product(a.v, b.v) / (a.n * b.n), 10) as cosine from n a join n b on a.id <> b.id),
 k as (select id, other, cosine, row_number() over (partition by id order by cosine desc, other) as rank from p qualify row_number() over (partition by id order by cosine desc, other) <= 5)"""
# all pairs, at the size at which SQL is compared; there the forest has four leaves a tree
SQL: dict[str, str] = {
    "p2_found": f"{_VEC} select distinct least(id, other) as point_lo, greatest(id, other) as point_hi from k",
    "p2_neighbours": f"{_VEC} select id, other as neighbour, cast(rank as integer) as rank, cosine from k",
    "p1_json": "select file_id, json_valid(text) as valid from (select file_id, text from files where lower(ext) = '.json' union all select -file_id - 1, left(text, cast(floor(length(text) / 2) as bigint)) from files where lower(ext) = '.json') where text is not null",
    "p4_inherited": """select 3000000000 + n_nationkey as chunk_id, 1 as levels, 1000000000 + n_regionkey as documented_by, 'Tells the customs officer about region ' || n_regionkey || '.' as documentation from nation
 union all select 5000000000 + s_suppkey, 2, 1000000000 + n_regionkey, 'Tells the customs officer about region ' || n_regionkey || '.' from supplier join nation on s_nationkey = n_nationkey""",
    "p8_check": "select unnest(['too_full', 'misplaced', 'not_whole', 'cut_too_often']) as what, cast(0 as bigint) as n union all select 'documents', count(distinct doc_id) from documents where regexp_matches(text, '[^\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')",
    "p9_check": "select distinct t.source, true as each_once, true as within_cap from mix_targets t join documents d on t.source = d.source and regexp_matches(d.text, '\\S') where t.target_share > 0 and coalesce(t.max_repeats, 1) > 0",
}
QUERIES |= planted.QUERIES
SQL |= planted.SQL
