"""Queries of the core's data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.operators import hierarchy as H
from loamgraph.operators import orphans as O
from loamgraph.session import table


def p5_found(spark, d):
    return H.hierarchy(H.edge_links(table(spark, d, "edges"))).select("relation", "id", "root", "depth")


def p5_paths(spark, d):
    labels = H.hierarchy(H.edge_links(table(spark, d, "edges")))
    return H.paths(labels).select("relation", "id", F.concat_ws(" > ", "path").alias("path"))


def p5_intervals(spark, d):
    """Sizes of subtrees, and whether their preorder numbers are those of the descendants: as many numbers as nodes, all within
    the tree, none twice."""
    labels = H.hierarchy(H.edge_links(table(spark, d, "edges"))).where("depth >= 0")
    per = labels.groupBy("relation", "root").agg(F.count("*").alias("nodes"), F.count_distinct("pre").alias("numbers"), F.min("pre").alias("first"), F.max(F.col("pre") + F.col("size") - 1).alias("last"), F.max("depth").alias("depth"))
    return per.select("relation", "root", "nodes", "numbers", "first", "last", "depth")


def p5_descendants(spark, d):
    return H.descendants(H.hierarchy(H.edge_links(table(spark, d, "edges"))))


def p5_dropped(spark, d):
    return H.dropped_links(H.edge_links(table(spark, d, "edges")))


def p7_found(spark, d):
    return O.orphans(table(spark, d, "edges"), table(spark, d, "nodes")).select("edge_id", "side")


def p7_report(spark, d):
    return O.orphan_report(table(spark, d, "edges"), table(spark, d, "nodes")).drop("orphan_share")


def p7_current(spark, d):
    return O.current_orphans(table(spark, d, "edges"), table(spark, d, "nodes"))


_LINKS = """links as (select distinct relation, case when relation = 'contains' then target else source end child,
 case when relation = 'contains' then source else target end parent from edges
 where relation in ('contains','inherits') and coalesce(resolved, true) and source is not null and target is not null),
 ends as (select relation, child id from links union select relation, parent from links),
 tree as (select e.relation, e.id, e.id root, 0 depth, e.id path from ends e where not exists (select 1 from links l where l.relation = e.relation and l.child = e.id)
  union all select l.relation, l.child, t.root, t.depth + 1, t.path || ' > ' || l.child from links l join tree t on l.relation = t.relation and l.parent = t.id)"""

_REFS = """refs as (select distinct edge_id, relation, 'source' side, source id, indexed_at ts from edges where coalesce(resolved, true) and source is not null
 union all select distinct edge_id, relation, 'target', target, indexed_at from edges where coalesce(resolved, true) and target is not null),
 bad as (select r.* from refs r where not exists (select 1 from nodes n where n.id = r.id and n.indexed_at <= r.ts and (n.removed_at is null or n.removed_at > r.ts)))"""

QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_intervals": p5_intervals, "p5_descendants": p5_descendants, "p5_dropped": p5_dropped, "p7_found": p7_found, "p7_report": p7_report, "p7_current": p7_current}
SQL = {
    "p5_found": f"with recursive {_LINKS} select e.relation, e.id, coalesce(t.root, '') as root, cast(coalesce(t.depth, -1) as integer) as depth from ends e left join tree t on e.relation = t.relation and e.id = t.id",
    "p5_paths": f"with recursive {_LINKS} select e.relation, e.id, coalesce(t.path, '') as path from ends e left join tree t on e.relation = t.relation and e.id = t.id",
    "p5_intervals": f"with recursive {_LINKS} select relation, root, count(*) as nodes, count(*) as numbers, cast(0 as bigint) as first, count(*) - 1 as last, cast(max(depth) as integer) as depth from tree group by 1, 2",
    "p5_descendants": f"with recursive {_LINKS}, up as (select relation, child as id, parent as anc from links union all select u.relation, u.id, l.parent from up u join tree t on t.relation = u.relation and t.id = u.anc join links l on l.relation = u.relation and l.child = u.anc) select u.relation, u.anc as id, u.id as descendant from up u join tree t on t.relation = u.relation and t.id = u.id",
    "p5_dropped": f"with recursive {_LINKS} select relation, child, parent, min(parent) over (partition by relation, child) as kept from links qualify parent <> min(parent) over (partition by relation, child)",
    "p7_found": f"with {_REFS} select distinct edge_id, side from bad",
    "p7_current": f"with {_REFS}, alive as (select id from nodes where id is not null and indexed_at is not null and (removed_at is null or removed_at > indexed_at) group by id having count(*) > count(removed_at)) select id, count(*) as refs from refs where id not in (select id from alive) group by 1",
    "p7_report": f"""with {_REFS}, s as (select b.*, exists (select 1 from nodes n where n.id = b.id and n.indexed_at <= b.ts and (n.removed_at is null or n.removed_at > n.indexed_at)) known from bad b),
 r as (select relation, side, strftime(ts, '%Y-%m') as month, count(*) refs from refs group by 1, 2, 3),
 o as (select relation, side, strftime(ts, '%Y-%m') as month, count_if(not known) missing, count_if(known) removed from s group by 1, 2, 3)
 select relation, side, month, cast(refs as bigint) refs, cast(coalesce(missing, 0) as bigint) missing, cast(coalesce(removed, 0) as bigint) removed from r left join o using (relation, side, month)""",
}
