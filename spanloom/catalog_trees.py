"""Queries of the operators on JSON trees, over orders with their items as JSON, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.catalog import orders_json, query
from spanloom.functions import json_tree
from spanloom.operators import trees

ITEMS = "i as (select l_orderkey k, l_linenumber, l_partkey, cast(l_quantity as bigint) q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1 as p from lineitem where l_orderkey in (select o_orderkey from orders))"
LEAVES_SQL = f"""{ITEMS}, leaves as (select k, 'items.' || p || '.l_linenumber' as path, 'items.' || p as item, l_linenumber as v from i union all select k, 'items.' || p || '.l_partkey', 'items.' || p, l_partkey from i union all select k, 'items.' || p || '.l_quantity', 'items.' || p, q from i
union all select o_orderkey, 'o_orderkey', null, o_orderkey from orders where o_orderkey in (select k from i) union all select o_orderkey, 'o_orderstatus', null, null from orders where o_orderkey in (select k from i))"""


def _leaves(spark, sf_dir, *only):
    return json_tree.leaves(orders_json(spark, sf_dir), "o_orderkey", "json", *only)


def _trees(spark, sf_dir, least=1, *only):
    """o_orderkey, o_orderstatus, json, l: the tree's leaves, all their fields or those named, of trees with so many at least. A condition on what is computed from them would be pushed down, and compute it twice."""
    return json_tree.leaf_arrays(orders_json(spark, sf_dir), "json", "l", *only).where(F.size("l") >= least)


@query(f"with {ITEMS} select k as o_orderkey, 'items' as path, 3 * count(*) as leaves from i group by k union all select k, 'items.' || p, 3 from i")
def json_inner_paths(spark, sf_dir):
    return json_tree.inner_paths(orders_json(spark, sf_dir), "o_orderkey", "json")


@query(f"with {ITEMS} select k as o_orderkey, cast(3 as int) as depth, 3 * count(*) + 2 as leaves, count(*) as list_items from i group by k")
def json_shapes(spark, sf_dir):
    return _trees(spark, sf_dir).select("o_orderkey", trees.shape_of(F.col("l")).alias("s")).select("o_orderkey", "s.*")


@query(f"with {LEAVES_SQL} select k as o_orderkey, path, coalesce(item, '') as parent, item as list_item, cast(3 as bigint) as n_siblings from leaves")
def json_siblings(spark, sf_dir):
    return _leaves(spark, sf_dir, "path", "parent", "list_item", "n_siblings").select("o_orderkey", "path", "parent", "list_item", "n_siblings")


@query(f"""with {LEAVES_SQL}, w as (select k, case k % 4 when 0 then l_partkey when 1 then q when 2 then -7 end as v from i where p = 0) select w.k as o_orderkey, case w.k % 4 when 0 then '"' || w.v || '.0"' when 1 then cast(w.v as varchar) when 2 then '-7' else o_orderstatus end as raw,
case when w.k % 4 = 3 then 1 else (select count(*) from leaves l where l.k = w.k and l.v = w.v) end as times from w join orders on o_orderkey = w.k""")
def json_occurrences(spark, sf_dir):
    d, way = orders_json(spark, sf_dir), F.col("o_orderkey") % 4
    first = lambda f: F.get_json_object("json", f"$.items[0].{f}")
    raw = F.when(way == 0, F.concat(F.lit('"'), first("l_partkey"), F.lit('.0"'))).when(way == 1, first("l_quantity")).when(way == 2, "-7").otherwise(F.col("o_orderstatus"))
    return trees.occurrences(_leaves(spark, sf_dir, "kind", "value"), d.select("o_orderkey", raw.alias("raw")), "o_orderkey")


@query(f"""with {LEAVES_SQL}, w as (select k, l_partkey as v from i where p = 0) select l.k as o_orderkey, path, cast(l.v as varchar) as before, '1234567' as after from leaves l join w on l.k = w.k and l.v = w.v""")
def json_replacements(spark, sf_dir):
    d = orders_json(spark, sf_dir).withColumns({"gone": F.lit(None).cast("array<string>"), "old": F.concat(F.lit(" '"), F.get_json_object("json", "$.items[0].l_partkey"), F.lit(".00'")), "new": F.lit("1,234,567.0")})
    return json_tree.edited(d, "o_orderkey", "json", "gone", "old", "new", "changes").select("o_orderkey", F.inline("changes")).drop("change")


@query(f"with {ITEMS}, f as (select k, p, l_partkey, row_number() over (partition by k order by l_partkey desc, 'items.' || p || '.l_partkey') as r, count(*) over (partition by k) as n from i) select k as o_orderkey, 'items.' || p as path, (select count(*) * 3 from i where i.k = f.k) - 3 as left_leaves from f where r = 1")
def json_deletions(spark, sf_dir):
    """The item with the greatest part number goes."""
    order = lambda x: F.when(x["path"].endswith("l_partkey"), -x["value"].cast("bigint")).otherwise(0)
    d = _trees(spark, sf_dir, 2).withColumn("path", trees.chosen_part_of(F.col("l"), order))
    none = F.lit(None).cast("string")
    d = d.select(F.struct("o_orderkey", "path").alias("id"), "json", F.array("path").alias("gone"), none.alias("old"), none.alias("new"))
    after = json_tree.leaf_arrays(json_tree.edited(d, "id", "json", "gone", "old", "new", "json"), "json", "l").where(F.size("l") > 0)
    return after.select("id.*", (trees.shape_of(F.col("l"))["leaves"] - 2).alias("left_leaves"))


@query(f"""with {LEAVES_SQL}, r as (select k, path, row_number() over (partition by k order by path desc) as r, count(*) over (partition by k) as n from leaves) select k as o_orderkey, count(*) as n, min(path) as first from r where r <= greatest(n // 2, 1) group by k""")
def json_targets(spark, sf_dir):
    """Half of each tree's leaves, the last by path."""
    order = lambda x: F.translate(x["path"], "".join(map(chr, range(46, 123))), "".join(map(chr, range(122, 45, -1))))
    d = _trees(spark, sf_dir).select("o_orderkey", trees.chosen_leaves_of(F.col("l"), order).alias("p"))
    return d.select("o_orderkey", F.size("p").cast("bigint").alias("n"), F.array_min("p").alias("first"))


@query(f"""with {ITEMS}, f as (select k, p, row_number() over (partition by k order by q desc, 'items.' || p || '.l_quantity') as r from i) select k as o_orderkey, case when k % 2 = 0 then ['items.' || p || '.l_linenumber', 'items.' || p || '.l_partkey', 'items.' || p || '.l_quantity'] else ['o_orderkey', 'o_orderstatus'] end as paths, case when k % 2 = 0 then 3 * (select count(*) from i where i.k = f.k) - 1 else 3 * (select count(*) from i where i.k = f.k) end as locked from f where r = 1""")
def json_cascades(spark, sf_dir):
    """Even orders free the item with the greatest quantity, odd ones the two leaves at the root; locked counts the leaves that stay fixed."""
    greatest = lambda x: F.when(x["path"].endswith("l_quantity"), -x["value"].cast("bigint")).otherwise(0)
    order = lambda x: F.when(F.col("o_orderkey") % 2 == 0, greatest(x)).otherwise(F.when(x["list_item"].isNull(), -1).otherwise(0))
    freed = trees.cascades_of(_trees(spark, sf_dir, 2), "l", order, "paths")
    schema = freed.select("o_orderkey", F.array_sort("paths").alias("paths"), json_tree.lock("json", "paths").alias("schema"))
    return schema.select("o_orderkey", "paths", F.regexp_count("schema", F.lit('"enum"')).cast("bigint").alias("locked"))


_U = "(('0x' || left(md5({0}), 13))::bigint + 0.5) / 4503599627370496.0"
_DRAW = "-ln(" + _U.format("'{0}|' || k || '|' || path") + ") / {1}"
_NODE = """'{"type": "object", "properties": {"l_linenumber": {"type": "integer"' || case when free then '' else ', "enum": [' || l_linenumber || ']' end || '}, "l_partkey": {"type": "integer"' || case when free then '' else ', "enum": [' || l_partkey || ']' end || '}, "l_quantity": {"type": "integer"' || case when free then '' else ', "enum": [' || q || ']' end || '}}, "required": ["l_linenumber", "l_partkey", "l_quantity"], "additionalProperties": false}'"""


def _schema_sql(freed: str) -> str:
    """freed(k, item: number of the freed item or null, root: whether the root's own leaves are free, listed: whether the list is)."""
    return f"""x as (select i.*, root, listed, coalesce(listed or i.p = item, false) as free from i join ({freed}) f on i.k = f.k), g as (select k, any_value(root) as root, any_value(listed) as listed, count(*) as c, string_agg({_NODE}, ', ' order by p) as parts from x group by k)
select k as o_orderkey, '{{"type": "object", "properties": {{"o_orderkey": {{"type": "integer"' || case when root then '' else ', "enum": [' || k || ']' end || '}}, "o_orderstatus": {{"type": "string"' || case when root then '' else ', "enum": ["' || o_orderstatus || '"]' end || '}}, "items": {{"type": "array", "prefixItems": [' || parts || ']' || case when listed then '' else ', "minItems": ' || c || ', "maxItems": ' || c end || '}}}}, "required": ["o_orderkey", "o_orderstatus", "items"], "additionalProperties": false}}' as schema from g join orders on o_orderkey = k"""


@query(f"""with {LEAVES_SQL}, d as (select k, path, item, row_number() over (partition by k order by {_DRAW.format("cascade", "(case when item is null then 1 else 3 end)")}) as r from leaves), {_schema_sql("select k, cast(substr(item, 7) as int) as item, item is null as root, item is null as listed from d where r = 1")}""")
def random_cascade_schemas(spark, sf_dir):
    """A leaf drawn by its depth, and the schema in which its item, or all that stands beside it, is free."""
    freed = trees.random_cascades_of(_trees(spark, sf_dir, 1, "path", "list_item"), "l", "o_orderkey", "cascade", "paths", "leaf")
    return freed.select("o_orderkey", json_tree.lock("json", "paths").alias("schema"))


@query(f"""with {ITEMS}, n as (select k, 'items' as path, 1 as w, null as p from i group by k union all select k, 'items.' || p, 2, p from i), d as (select *, row_number() over (partition by k order by {_DRAW.format("focus", "w")}) as r from n), {_schema_sql("select k, p as item, false as root, p is null as listed from d where r = 1")}""")
def random_focus_schemas(spark, sf_dir):
    """A list or an item drawn by its depth, and the schema in which it is free."""
    d = orders_json(spark, sf_dir)
    freed = trees.random_focus(json_tree.leaves(d, "o_orderkey", "json", "path"), "o_orderkey", "focus")
    return d.join(freed.hint("merge"), "o_orderkey").select("o_orderkey", json_tree.lock("json", F.array("path")).alias("schema"))
