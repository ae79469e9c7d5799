"""Name resolution as joins: simple names in five tiers, methods of self along the bases, variables by their last binding,
and the edges that follow. No tier is a nested loop: the suffix tier is an equi-join on all proper dotted suffixes of the
symbols. Inherited methods are looked up with the imports of the file that defines each class."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import cut, drop_dir


def symbol_table(facts: DataFrame) -> DataFrame:
    """(fqn, name, type, file_path, parent, bases): a symbol that is defined again keeps its last definition."""
    s = facts.where("kind = 'symbol'").select("fqn", F.struct("file_path", "pos", "name", "type", "parent", "items").alias("s"))
    return s.groupBy("fqn").agg(F.max("s").alias("s")).select("fqn", "s.name", "s.type", "s.file_path", "s.parent", F.col("s.items").alias("bases"))


def import_table(facts: DataFrame) -> DataFrame:
    """(file_path, local_name, imported_fqn, type): the last import of a local name wins, in its first place."""
    i = facts.where("kind = 'import'")
    return i.groupBy("file_path", F.col("name").alias("local_name")).agg(F.max_by("value", "pos").alias("imported_fqn"), F.max_by("type", "pos").alias("type"), F.min("pos").alias("ord"))


def resolve_simple(names: DataFrame, symtab: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, module, name) -> target, resolved, confidence. In order: a full name; an import of the first part; a
    wildcard import; the own module; the only symbol whose dotted name ends so; else the name itself, unresolved."""
    n = names.select("file_path", "module", "name").distinct().withColumn("head", F.substring_index("name", ".", 1))
    plain = imports.where("local_name <> '*'").select("file_path", F.col("local_name").alias("head"), F.col("imported_fqn").alias("via"))
    wild = imports.where("local_name = '*'").select("file_path", F.col("imported_fqn").alias("wild"))
    j = n.join(plain, ["file_path", "head"], "left").join(wild, "file_path", "left")
    return _tiers(j, symtab.select("fqn", F.lit(None).cast("string").alias("type"))).select("file_path", "module", "name", "target", "resolved", "confidence")


def suffixes(symtab: DataFrame) -> DataFrame:
    """(name, whole, owners, low, high): for each full name and proper dotted suffix of one, whether it is a full name, how many
    symbols end so, and the first and the last of them. `whole`, `low` and `high` are (fqn, is_class)."""
    parts = F.split("fqn", r"\.")
    it = F.struct("fqn", F.coalesce(F.col("type") == "class", F.lit(False)).alias("is_class"))
    each = symtab.select(it.alias("s"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("name"), (i > 1).alias("part")))).alias("e"))
    mine = lambda x: F.when(F.col("e.part"), x)
    return (
        each.where("e.name <> '' or not e.part").groupBy(F.col("e.name").alias("name"))
        .agg(F.max(F.when(~F.col("e.part"), F.col("s"))).alias("whole"), F.count(mine(F.col("s"))).alias("owners"), F.min(mine(F.col("s"))).alias("low"), F.max(mine(F.col("s"))).alias("high"))
    )


def _tiers(names: DataFrame, symtab: DataFrame) -> DataFrame:
    """Adds target, resolved, confidence and is_class (null where unknown) to (module, name, head, via, wild, ...) and takes head, via and
    wild away. Each row moves once: what the wildcard's or the own module has is a symbol that ends with the name, so up to two such symbols
    tell it; only names that end more symbols are looked up in full."""
    c_name, d_name = F.concat_ws(".", "wild", "name"), F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "name")
    j = names.join(suffixes(symtab), "name", "left")
    open_ = F.coalesce((F.col("owners") > 2) & F.col("whole").isNull() & F.col("via").isNull(), F.lit(False))
    at = lambda x: F.when(F.col("low.fqn") == x, F.col("low")).when(F.col("high.fqn") == x, F.col("high"))
    few = j.where(~open_).withColumn("c", F.when(F.col("wild").isNotNull(), at(c_name))).withColumn("d", at(d_name))
    sym = symtab.select(F.col("fqn").alias("at"), F.struct("fqn", F.coalesce(F.col("type") == "class", F.lit(False)).alias("is_class")).alias("s"))
    many = j.where(open_)
    for at_, full in (("c", F.when(F.col("wild").isNotNull(), c_name)), ("d", d_name)):
        many = many.withColumn("at", F.coalesce(full, F.concat(F.lit("."), "name", F.lit(".")))).join(sym.withColumnRenamed("s", at_), "at", "left").drop("at")
    both = few.unionByName(many)
    b = F.concat(F.col("via"), F.substring(F.col("name"), F.length("head") + 1, F.length("name")))
    only = F.when(F.col("owners") == 1, F.col("low"))
    imported = F.col("via").isNotNull()
    own = F.coalesce("c", "d")
    target = F.when(F.col("whole").isNotNull(), F.col("name")).when(imported, b).otherwise(F.coalesce(own["fqn"], only["fqn"]))
    high = F.col("whole").isNotNull() | imported | own.isNotNull()
    known = F.when(F.col("whole").isNotNull(), F.col("whole.is_class")).when(~imported, F.coalesce(own["is_class"], only["is_class"], F.lit(False)))
    return both.select(
        *[c for c in names.columns if c not in ("head", "via", "wild")], F.coalesce(target, F.col("name")).alias("target"), target.isNotNull().alias("resolved"),
        F.when(high, "high").when(target.isNotNull(), "medium").otherwise("low").alias("confidence"), known.alias("is_class"),
    )


def uses(facts: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, file_path, module, fqn, parent, pos, var, name, via, wild): places where a name is used. `var` is what an assignment
    binds; via and wild are what the file's imports say of the name's first part."""
    f = facts.where(F.col("kind").isin(kinds))
    own = F.when(F.col("kind") == "decorator", F.col("name")).otherwise(F.col("value"))
    return f.select("kind", "file_path", "module", "fqn", "parent", "pos", F.when(F.col("kind") == "assign", F.col("name")).alias("var"), own.alias("name"), F.col("returns").alias("via"), F.col("text").alias("wild"))


def with_class(named: DataFrame, symtab: DataFrame) -> DataFrame:
    """Fills is_class where it isn't known yet: whether the target is a known class."""
    classes = symtab.where("type = 'class'").select(F.col("fqn").alias("target"), F.lit(True).alias("k"))
    asked = named.where("is_class is null").join(classes, "target", "left").withColumn("is_class", F.coalesce("k", F.lit(False))).drop("k")
    return named.where("is_class is not null").unionByName(asked)


def first_bases(named: DataFrame, symtab: DataFrame) -> DataFrame:
    """(cls, base): the first base of each class that is a known class; `named` are resolved uses."""
    r = named.where("kind = 'base'").join(symtab.where("type = 'class'").select(F.col("fqn").alias("target")), "target").where("target <> fqn")
    return r.groupBy(F.col("fqn").alias("cls")).agg(F.min_by("target", "pos").alias("base"))


def ancestors(bases: DataFrame) -> DataFrame:
    """(cls, up array<string>): the chain of first bases, nearest first, to its end or up to where it would come back to one
    that it has. Chains double each round until none grows, however deep they are."""
    done = lambda: (F.size("up") < F.lit(length)) | F.col("closed")
    chain, path = cut(bases.select("cls", F.array("base").alias("up"), (F.col("cls") == F.col("base")).alias("closed")), "chain")
    length = 1
    while not chain.where(~done()).isEmpty():
        more = chain.select(F.col("cls").alias("tail"), F.col("up").alias("rest"))
        joined = chain.withColumn("tail", F.when(~done(), F.element_at("up", -1))).join(more, "tail", "left").withColumn("all", F.when(F.col("rest").isNull(), F.col("up")).otherwise(F.concat("up", "rest")))
        old = path
        chain, path = cut(joined.select("cls", F.array_distinct("all").alias("up"), (F.col("closed") | (F.size(F.array_distinct("all")) < F.size("all"))).alias("closed")), "chain")
        drop_dir(bases.sparkSession, old)
        length *= 2
    back = F.array_position("up", F.col("cls")).cast("int")
    return chain.select("cls", F.when(back > 0, F.slice("up", F.lit(1), back - 1)).otherwise(F.col("up")).alias("up"))


def resolve_self(wanted: DataFrame, symtab: DataFrame, bases: DataFrame) -> DataFrame:
    """(cls, attr) -> target: the attribute of the class or of the nearest base that has it, else of the class itself."""
    w = wanted.select("cls", "attr").distinct()
    chain = F.concat(F.array("cls"), F.coalesce("up", F.array().cast("array<string>")))
    tries = w.join(ancestors(bases), "cls", "left").select("cls", "attr", F.posexplode(chain).alias("level", "at")).withColumn("candidate", F.concat_ws(".", "at", "attr"))
    nearest = tries.join(symtab.select(F.col("fqn").alias("candidate")), "candidate").groupBy("cls", "attr").agg(F.min_by("candidate", "level").alias("target"))
    return w.join(nearest, ["cls", "attr"], "left").select("cls", "attr", F.coalesce("target", F.concat_ws(".", "cls", "attr")).alias("target"))


def bindings(named: DataFrame, symtab: DataFrame) -> DataFrame:
    """(file_path, fn, var, pos, cls): assignments of calls that make an object of a known class; `named` are resolved uses."""
    r = with_class(named.where("kind = 'assign'"), symtab).where("is_class")
    return r.select("file_path", F.col("fqn").alias("fn"), "var", "pos", F.col("target").alias("cls"))


def bound(uses_: DataFrame, bound_: DataFrame) -> DataFrame:
    """Adds `cls` to (file_path, fn, var, pos, ...): the last binding of the variable at or before the use."""
    both = uses_.withColumn("cls0", F.lit(None).cast("string")).withColumn("use", F.lit(1)).unionByName(bound_.select("file_path", "fn", "var", "pos", F.col("cls").alias("cls0"), F.lit(0).alias("use")), allowMissingColumns=True)
    w = Window.partitionBy("file_path", "fn", "var").orderBy("pos", "use").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("cls", F.last("cls0", ignorenulls=True).over(w)).where("use = 1").drop("cls0", "use")


def in_context(named: DataFrame, symtab: DataFrame) -> DataFrame:
    """The calls and returns among resolved uses, with what self, cls and bound variables make of them: self and cls first,
    then variables, then what the plain name gave."""
    rest = F.substring(F.col("name"), F.length(F.substring_index("name", ".", 1)) + 2, F.length("name"))
    s = named.where("kind in ('call', 'return')").withColumn("var", F.substring_index("name", ".", 1)).withColumn("attr", rest)
    own = F.col("var").isin("self", "cls") & (F.col("attr") != "")
    selves = s.where(own).drop("target", "resolved", "confidence").withColumn("is_class", F.lit(None).cast("boolean"))
    known = resolve_self(selves.where("parent is not null").select(F.col("parent").alias("cls"), "attr"), symtab, first_bases(named, symtab)).select(F.col("cls").alias("parent"), "attr", "target")
    inside = F.col("parent").isNotNull()
    a = selves.join(known, ["parent", "attr"], "left").withColumn("resolved", inside).withColumn("confidence", F.when(inside, "high").otherwise("low")).withColumn("target", F.coalesce("target", "name"))
    others = bound(s.where(~own & (F.col("attr") != "")).withColumnRenamed("fqn", "fn"), bindings(named, symtab)).withColumnRenamed("fn", "fqn")
    via = F.col("cls").isNotNull()
    b = others.withColumn("is_class", F.when(~via, F.col("is_class"))).withColumn("target", F.when(via, F.concat_ws(".", "cls", "attr")).otherwise(F.col("target"))).withColumn("resolved", F.col("resolved") | via).withColumn("confidence", F.when(via, "high").otherwise(F.col("confidence")))
    cols = ["kind", "file_path", "fqn", "pos", "target", "resolved", "confidence", "is_class"]
    return a.select(cols).unionByName(b.select(cols)).unionByName(s.where(~own & (F.col("attr") == "")).select(cols))  # a name without parts has no variable before it


NEEDS = {"contains": ["contains"], "imports": ["import"], "inherits": ["base"], "decorates": ["decorator"], "returns": ["base", "assign", "return"]}
SEMANTIC = ("calls", "instantiates", "returns")
RELATIONS = ("contains", "imports", "inherits", "decorates", *SEMANTIC)


def kinds_for(relations: Iterable[str] = RELATIONS) -> list[str]:
    """The kinds of facts that these relations are made of."""
    kinds = {k for r in relations for k in NEEDS.get(r, ["base", "assign", "call"])}
    return sorted(kinds | ({"symbol", "import"} if kinds - {"contains", "import"} else set()))


def resolved_uses(facts: DataFrame, kinds: list[str], symtab: DataFrame) -> DataFrame:
    """The uses of these kinds with target, resolved and confidence of their plain names, and is_class where it is known by then."""
    named = uses(facts, kinds).withColumn("head", F.substring_index("name", ".", 1))
    own = F.expr("(name like 'self.%' or name like 'cls.%') and kind not in ('base', 'decorator', 'assign')")
    return _tiers(named.where(~own), symtab).unionByName(named.where(own).drop("head", "via", "wild"), allowMissingColumns=True)


def edges(facts: DataFrame, relations: Iterable[str] = RELATIONS) -> DataFrame:
    """(source, target, relation, resolved, confidence, file_path, pos): the wanted relations of the graph."""
    relations = list(relations)
    kinds = kinds_for(relations)
    facts, _ = cut(facts.where(F.col("kind").isin(kinds)).drop("docstring"), "facts")
    cols = ["source", "target", "relation", "resolved", "confidence", "file_path", "pos"]
    none_b, none_s = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    out = []
    if "contains" in relations:
        out.append(facts.where("kind = 'contains'").select(F.coalesce("parent", "file_path").alias("source"), F.col("fqn").alias("target"), F.lit("contains").alias("relation"), none_b.alias("resolved"), none_s.alias("confidence"), "file_path", "pos"))
    imports = import_table(facts)
    if "imports" in relations:
        out.append(imports.where("type = 'symbol'").select(F.col("file_path").alias("source"), F.col("imported_fqn").alias("target"), F.lit("imports").alias("relation"), F.lit(True).alias("resolved"), F.lit("high").alias("confidence"), "file_path", F.col("ord").alias("pos")))
    used = [k for k in kinds if k in ("base", "decorator", "assign", "call", "return")]
    if used:
        symtab, _ = cut(symbol_table(facts), "symtab")
        named, _ = cut(resolved_uses(facts, used, symtab), "named")
        base = F.col("kind") == "base"
        if "inherits" in relations or "decorates" in relations:
            heads = named.where("kind in ('base', 'decorator')").select(F.when(base, F.col("fqn")).otherwise(F.col("target")).alias("source"), F.when(base, F.col("target")).otherwise(F.col("fqn")).alias("target"), F.when(base, "inherits").otherwise("decorates").alias("relation"), "resolved", "confidence", "file_path", "pos")
            out.append(heads.where(F.col("relation").isin(relations)))
        if set(SEMANTIC) & set(relations):
            done = in_context(named, symtab)
            if {"calls", "instantiates"} & set(relations):
                done = with_class(done, symtab)
            relation = F.when(F.col("kind") == "return", "returns").when(F.col("is_class"), "instantiates").otherwise("calls")
            out.append(done.where("kind = 'call' or resolved").select(F.col("fqn").alias("source"), "target", relation.alias("relation"), "resolved", "confidence", "file_path", "pos").where(F.col("relation").isin(relations)))
    whole = out[0].select(cols)
    for x in out[1:]:
        whole = whole.unionByName(x.select(cols))
    return whole


def call_stats(edges_: DataFrame) -> DataFrame:
    """How many calls were resolved."""
    calls = edges_.where("relation in ('calls', 'instantiates')")
    return calls.groupBy("relation").agg(F.count("*").alias("calls"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def nodes(facts: DataFrame) -> DataFrame:
    """(id, type, file_path): a node per file and definition, each id once (the first by path and place)."""
    f = facts.select(F.col("file_path").alias("id"), F.lit("file").alias("type"), "file_path", F.lit(0).alias("pos")).distinct()
    s = facts.where("kind = 'contains'").select(F.col("fqn").alias("id"), "type", "file_path", "pos")
    return f.unionByName(s).groupBy("id").agg(F.min_by(F.struct("type", "file_path"), F.struct("file_path", "pos")).alias("x")).select("id", "x.type", "x.file_path")
