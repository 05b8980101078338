"""Operators on leaf tables of JSON trees (key, pos, path, list_item, kind, value): paths, neighbours, occurrences, choices for edits.

The trees are decoded once, by json_tree.leaves; all here is joins and aggregates on paths, and chosen paths go back to json_tree.edited
or json_tree.unlock. What is decided tree by tree has a second form, `..._of`, over the arrays of json_tree.leaf_arrays: rows stay where
they are, with their texts, so that leaves are neither shuffled nor joined back. Leaf tables outgrow what Spark knows of their size, so they are joined by merge: a broadcast would go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text


def parent(path: Column) -> Column:
    """The path without its last part; empty for one part."""
    return F.regexp_replace(path, r"(?s)(?:\A|\.)[^.]*\z", "")


def last_part(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def inner_paths(leaves: DataFrame, key: str) -> DataFrame:
    """key, path, leaves: every object and list inside a tree, and how many leaves it holds. The root is left out."""
    parts = F.split("path", r"\.")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return leaves.where(F.col("path").contains(".")).select(key, F.explode(inner).alias("path")).groupBy(key, "path").agg(F.count("*").alias("leaves"))


def shapes(leaves: DataFrame, key: str) -> DataFrame:
    """key, depth (parts of the longest path), leaves, list_items (innermost ones) of each tree."""
    return leaves.groupBy(key).agg(F.max(F.size(F.split("path", r"\."))).alias("depth"), F.count("*").alias("leaves"), F.count_distinct("list_item").alias("list_items"))


def shape_of(leaves: Column) -> Column:
    """struct(depth, leaves, list_items) of a tree's leaves, as shapes() has them; null without leaves."""
    items = F.array_distinct(F.filter(F.transform(leaves, lambda x: x["list_item"]), lambda p: p.isNotNull()))
    depth = F.array_max(F.transform(leaves, lambda x: _depth(x["path"])))
    return F.when(F.size(leaves) > 0, F.struct(depth.alias("depth"), F.size(leaves).cast("bigint").alias("leaves"), F.size(items).cast("bigint").alias("list_items")))


def value_at(leaves: DataFrame, key: str, path: str) -> DataFrame:
    """key, kind, value of the leaf at a path."""
    return leaves.where(F.col("path") == path).select(key, "kind", "value")


def siblings(leaves: DataFrame, key: str) -> DataFrame:
    """leaves with parent and n_siblings: the parts under the same parent, the leaf's own too; a root part `name` counts for itself only."""
    d = leaves.withColumn("parent", parent(F.col("path")))
    parts = F.split("path", r"\.")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), ".").alias("parent"), F.get(parts, n - 1).alias("part")))
    held = leaves.select(key, F.explode(ways).alias("w")).select(key, "w.*").where("parent <> '' or part <> 'name'")
    counts = held.groupBy(key, "parent").agg(F.count_distinct("part").alias("n_siblings"))
    return d.join(counts.hint("merge"), [key, "parent"], "left").withColumn("n_siblings", F.coalesce("n_siblings", F.lit(1).cast("bigint")))


#: Texts that are values rather than content: numbers, percentages, dates, coordinates.
VALUES = (r"-?\d+(?:\.\d+)?$", r"[+-]?\d+(?:\.\d+)?%$", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"-?\d{1,3}\.\d+$")


def content_strings(leaves: DataFrame) -> DataFrame:
    """Leaves that are texts with content: fields of objects, no bare list items, not blank, and no number, date or percentage."""
    plain = r"\A(?:" + "|".join(VALUES) + ")"
    item = F.coalesce(F.col("list_item") == F.col("path"), F.lit(False))
    return leaves.where((F.col("kind") == "string") & ~item & F.col("value").rlike(r"\S") & ~F.trim("value").rlike(plain))


def matches(leaves: DataFrame, raw: Column) -> Column:
    """Whether a leaf is the raw value in whatever writing, or a text that holds it at word bounds."""
    quoted = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(raw, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    inside = (F.col("kind") == "string") & (F.length(raw) > 0) & F.col("value").contains(raw) & F.regexp_like("value", quoted)
    return (text.canonical(F.col("value")) == text.canonical(raw)) | inside


def occurrences(leaves: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """wanted(key, raw) -> key, raw, times: in how many leaves of its tree a value stands; 0 too. One shuffle on the key."""
    d = wanted.select(key, "raw").join(leaves.select(key, "kind", "value").hint("merge"), key, "left")
    return d.groupBy(key, "raw").agg(F.count_if(F.col("value").isNotNull() & matches(leaves, F.col("raw"))).alias("times"))


def chosen_leaves(leaves: DataFrame, key: str, order: Column, share: float = 0.5, most: int | None = None) -> DataFrame:
    """key, path: the first leaves of each tree in an order, a share of its leaves at most (one at least), and at most `most`."""
    w = W.partitionBy(key)
    d = leaves.withColumn("place", F.row_number().over(w.orderBy(order, "path"))).withColumn("all", F.count("*").over(w))
    bound = F.greatest(F.floor(F.col("all") * share), F.lit(1))
    return d.where(F.col("place") <= (bound if most is None else F.least(bound, F.lit(most)))).select(key, "path")


def chosen_leaves_of(leaves: Column, order: Callable[[Column], Column], share: float = 0.5, most: int | None = None) -> Column:
    """The paths that chosen_leaves() takes of a tree, in order; order takes a leaf."""
    bound = F.greatest(F.floor(F.size(leaves) * share), F.lit(1))
    ranked = F.array_sort(F.transform(leaves, lambda x: F.struct(order(x).alias("o"), x["path"].alias("path"))))
    return F.transform(F.slice(ranked, F.lit(1), (bound if most is None else F.least(bound, F.lit(most))).cast("int")), lambda x: x["path"])


def chosen_parts(leaves: DataFrame, key: str, order: Column) -> DataFrame:
    """key, path: what to delete of each tree: the whole list item around the first leaf in an order, or the leaf itself in a tree without lists. Trees with one leaf are left out."""
    first = leaves.groupBy(key).agg(F.min_by(F.coalesce("list_item", "path"), F.struct(order, "path")).alias("path"), F.count("*").alias("n"))
    return first.where("n > 1").select(key, "path")


def chosen_part_of(leaves: Column, order: Callable[[Column], Column]) -> Column:
    """The path that chosen_parts() takes of a tree, or null; order takes a leaf."""
    first = F.array_min(F.transform(leaves, lambda x: F.struct(order(x).alias("o"), x["path"].alias("path"), F.coalesce(x["list_item"], x["path"]).alias("part"))))
    return F.when(F.size(leaves) > 1, first["part"])


def cascades(leaves: DataFrame, key: str, order: Column) -> DataFrame:
    """key, paths: what to free together of each tree: all leaves of the list item around the first leaf in an order, or, outside lists, the first half (rounded up, two at least) of the leaves beside it. Trees with one leaf are left out."""
    w = W.partitionBy(key)
    d = leaves.withColumn("up", parent(F.col("path"))).withColumn("n", F.count("*").over(w))
    d = d.withColumn("first", F.first(F.struct("list_item", "up")).over(w.orderBy(order, "path").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    together = F.when(F.col("first.list_item").isNotNull(), F.col("list_item") == F.col("first.list_item")).otherwise(F.col("list_item").isNull() & (F.col("up") == F.col("first.up")))
    held = d.where((F.col("n") > 1) & F.coalesce(together, F.lit(False))).groupBy(key, F.col("first.list_item").isNotNull().alias("listed")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "path"))).alias("l"))
    taken = F.when(F.col("listed"), F.size("l")).otherwise(F.greatest(F.ceil(F.size("l") / 2).cast("int"), F.lit(2)))
    return held.select(key, F.transform(F.slice("l", F.lit(1), taken), lambda x: x["path"]).alias("paths"))


def cascades_of(rows: DataFrame, leaves: str, order: Callable[[Column], Column], into: str) -> DataFrame:
    """rows with into: the paths that cascades() frees in each tree, or null; order takes a leaf."""
    first = F.array_min(F.transform(leaves, lambda x: F.struct(order(x).alias("o"), x["path"].alias("path"), x["list_item"].alias("item"))))
    d = rows.withColumn("_first", first).withColumn("_up", parent(F.col("_first.path")))
    item = F.col("_first.item")
    beside = lambda x: x["list_item"].isNull() & (parent(x["path"]) == F.col("_up"))
    held = F.filter(leaves, lambda x: F.when(item.isNotNull(), F.coalesce(x["list_item"] == item, F.lit(False))).otherwise(beside(x)))
    d = d.withColumn("_held", F.array_sort(F.transform(held, lambda x: F.struct(order(x).alias("o"), x["path"].alias("path")))))
    taken = F.when(item.isNotNull(), F.size("_held")).otherwise(F.greatest(F.ceil(F.size("_held") / 2).cast("int"), F.lit(2)))
    paths = F.transform(F.slice("_held", F.lit(1), taken), lambda x: x["path"])
    return d.withColumn(into, F.when(F.size(leaves) > 1, paths)).drop("_first", "_up", "_held")


def chance(*parts: Column | str) -> Column:
    """A number between 0 and 1, without both, that depends on nothing but the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def weighted_order(weight: Column, *parts: Column | str) -> Column:
    """Of several, the one with the least of these is drawn with a probability in proportion to its weight."""
    return -F.ln(chance(*parts)) / weight


def _depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def random_cascades(leaves: DataFrame, key: str, seed: str) -> DataFrame:
    """key, leaf, paths: of each tree a leaf drawn by its depth, and what is freed with it.

    The leaf stands in a list item: all that the innermost one holds. Else up to three parts under its parent: all; of more, the leaf's own
    and others by chance, two to half of them together. The root's `name` is neither drawn nor freed unless it is the only leaf.
    """
    d = leaves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "path", "list_item"))).alias("_l"))
    return random_cascades_of(d, "_l", key, seed, "paths", "leaf").select(key, "leaf", "paths")


def random_cascades_of(rows: DataFrame, leaves: str, key: str, seed: str, into: str, drawn: str) -> DataFrame:
    """rows with into and drawn: the paths and the leaf that random_cascades() takes of each tree; null without leaves."""
    d = rows.withColumn("_l", F.col(leaves))
    own = lambda x: F.struct(weighted_order(_depth(x["path"]), F.lit(seed), F.col(key), x["path"]).alias("o"), x["path"].alias("path"), x["list_item"].alias("item"))
    unnamed = lambda x: x["path"] != "name"
    d = d.withColumn("_leaf", F.array_min(F.transform(F.when(F.exists("_l", unnamed), F.filter("_l", unnamed)).otherwise(F.col("_l")), own)))
    up, leaf, item = parent(F.col("_leaf.path")), F.col("_leaf.path"), F.col("_leaf.item")
    # What the paths in the leaf's list item, or else those beside it, start with: found once a tree, not once a leaf.
    d, start = d.withColumn("_start", F.when(item.isNotNull(), F.concat(item, F.lit("."))).when(up == "", "").otherwise(F.concat(up, F.lit(".")))), F.col("_start")
    held = F.filter(F.transform("_l", lambda x: x["path"]), lambda p: (p == item) | p.startswith(start))
    parts = F.array_distinct(F.transform(F.filter("_l", lambda x: x["path"].startswith(start)), lambda x: F.concat(start, F.substring_index(F.substring(x["path"], F.length(start) + 1, F.length(x["path"])), ".", 1))))
    d = d.withColumn("_parts", F.when(item.isNull(), F.when(start == "", F.filter(parts, lambda p: p != "name")).otherwise(parts)))
    n = F.size("_parts")
    more = 2 + F.floor(chance(F.lit(f"{seed} n"), F.col(key)) * (F.greatest(F.lit(2), F.ceil(n / 2)) - 1))
    others = F.transform(F.array_sort(F.transform(F.filter("_parts", lambda p: p != leaf), lambda p: F.struct(chance(F.lit(f"{seed} others"), F.col(key), p).alias("o"), p.alias("p")))), lambda x: x["p"])
    beside = F.when(n <= 3, F.col("_parts")).otherwise(F.concat(F.array(leaf), F.slice(others, F.lit(1), (more - 1).cast("int"))))
    paths = F.when(item.isNotNull(), held).otherwise(F.when(n > 0, beside).otherwise(F.array(leaf)))
    return d.withColumns({drawn: leaf, into: F.when(leaf.isNotNull(), paths)}).drop("_l", "_leaf", "_start", "_parts")


def random_focus(leaves: DataFrame, key: str, seed: str) -> DataFrame:
    """key, path: of each tree an object or list inside it, drawn by its depth; of a tree without any, one of its fields, all alike. The root's `name` is not drawn if there is another."""
    flat, places = F.when(F.col("path").contains("."), False).otherwise(True), F.sequence(F.lit(1), F.greatest(_depth(F.col("path")) - 1, F.lit(1)))
    # A tree's own fields count only where it holds nothing inside, so they come last; parts that hold many leaves are met as often, and drawn once.
    d = leaves.select(key, "path", flat.alias("flat"), F.explode(places).alias("w")).withColumn("path", F.call_function("substring_index", "path", F.lit("."), "w"))
    order = F.struct("flat", (F.col("path") == "name").alias("last"), weighted_order(F.col("w"), F.lit(seed), F.col(key), F.col("path")).alias("o"))
    return d.groupBy(key).agg(F.min_by("path", order).alias("path"))


def tool_names(c: Column) -> Column:
    """The names in a tool response: of an object, or of each object of a list. Anything else has none."""
    v = F.try_parse_json(c)
    listed = F.call_function("try_variant_get", v, F.lit("$"), F.lit("array<variant>"))
    names = F.transform(listed, lambda x: F.call_function("try_variant_get", x, F.lit("$.name"), F.lit("string")))
    own = F.call_function("try_variant_get", v, F.lit("$.name"), F.lit("string"))
    return F.when(listed.isNotNull(), F.array_compact(names)).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
