"""What must grow no faster than the tables: no table of leaves or orders goes through the driver, Python holds few rows at a time."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom import catalog, catalog_editing, catalog_labels, catalog_tools, catalog_trees  # noqa: F401
from spanloom.functions import json_tree
from spanloom.operators import editing, trees

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["changed_values", "json_occurrences", "json_siblings", "json_deletions", "json_cascades", "json_edits"])
def test_no_broadcast_of_what_grows(spark, name):
    assert "Broadcast" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "passes"), [("budgeted_deletions", 2), ("unambiguous_places", 1), ("deletion_labels", 4), ("mismatch_labels", 2), ("mismatch_spans", 1), ("quoted_paths", 1), ("tags_of_repeated_keys", 1), ("tagged_answers", 1), ("deletion_spans", 2)])
def test_texts_are_read_in_few_passes(spark, name, passes):
    """Each pass is one more Python worker a task; leaves aren't handed from one to the next."""
    plan = _plan(spark, name)
    assert plan.count("MapInArrow") == passes and plan.count("Exchange hashpartitioning") == 2


def test_a_focus_is_drawn_from_leaves_made_once(spark):
    plan = _plan(spark, "random_focus_schemas")
    assert plan.count("MapInArrow") == 1 and "Broadcast" not in plan


def test_python_holds_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pydict({"a": list(range(1201))})
    cut = [b.num_rows for b in json_tree.pieces(iter([batch]))]
    assert max(cut) <= json_tree.ROWS and sum(cut) == 1201


def test_flat_arrow_columns():
    kind = pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.int32()))]))
    rows = [[("x", [1, 2]), None, (None, None)], None, [], [("y", [])], [("z", [3])]]
    made = json_tree.as_arrow(rows, kind)
    assert made.to_pylist() == [[{"a": "x", "b": [1, 2]}, None, {"a": None, "b": None}], None, [], [{"a": "y", "b": []}], [{"a": "z", "b": [3]}]]
    assert json_tree.from_arrow(made) == rows and json_tree.from_arrow(made.slice(2, 3)) == rows[2:] and json_tree.from_arrow(made.slice(1, 1)) == [None]
    assert json_tree.as_arrow([], kind).to_pylist() == []


def test_many_values_are_placed_like_few():
    leaves = [("number", str(n)) for n in range(1000, 1040)] + [("string", "Rome"), ("null", "None"), ("string", "ab"), ("number", "-1234567.5")]
    answer = "rome, ROME; 1,003 and €1,004, 1005 1005, -1,234,567.5 or so"
    few = editing._spots(answer, leaves)
    assert editing._spots(answer, leaves * 2) == few * 2
    assert [x[0] for x in few[3:6]] == [1, 1, 2] and few[40] == (2, 0, 4) and few[41:43] == [(0, None, None)] * 2 and few[43][0] == 1
    assert list(editing.number_forms("12")) == ["12", "12"] + [c + f for c in editing.CURRENCIES for f in ("12", "12", "12")] + ["12%", "12 %"]


@pytest.mark.parametrize("text", ['{"a": [1, {"b": "x, }"', '{"a":[1,{"b":2}', '[{"a": "q\\"]"}, ', '{"a": 1}, {', '{"a": "open', '{"a": tru', '{"a": [1}', "", "x", '{"a"'])
def test_a_cut_text_is_closed_at_once_or_searched(text):
    """What closes at its end is read as a whole, once; anything else is searched for its longest prefix."""
    want = {'{"a": [1, {"b": "x, }"': '{"a": [1, {"b": "x, }"}]}', '{"a":[1,{"b":2}': '{"a":[1,{"b":2}]}', '[{"a": "q\\"]"}, ': '[{"a": "q\\"]"}]'}.get(text)
    assert json_tree._closed(text) == want and (want is None or json_tree.recovered(text) == want)


def test_a_schema_is_written_without_the_schema_as_objects(spark):
    tree = '{"a": {"x": 1, "y": [1.50, null]}, "b": [true, {"c": "d\\"e"}, []], "1": {}}'
    for paths in ([], ["a"], ["a.y"], ["b.1.c", "a.x"], ["b.-1", "b.7", "b.x", "1.z", ""], ["b.0", "b"]):
        old = json_tree.encode(json_tree.unlocked(json_tree.locked_schema(json_tree.decode(tree)), paths))
        assert json_tree.schema_text(json_tree.decode(tree), [p.split(".") for p in paths]) == old
    assert spark.createDataFrame([(tree, ["b"]), ("no", ["b"]), (tree, None)], "j string, p array<string>").select(json_tree.lock("j", "p")).collect()[1][0] is None


def test_leaves_leave_python_with_the_columns_asked_for(spark):
    d = spark.createDataFrame([(1, '{"a": [1, "x"]}'), (2, None)], "k int, j string")
    assert [tuple(r) for r in json_tree.leaves(d, "k", "j", "path", "value").collect()] == [(1, "a.0", "1"), (1, "a.1", "x")]


def test_few_values_are_found_without_an_automaton(monkeypatch):
    monkeypatch.setattr(editing.ahocorasick, "Automaton", None)
    assert editing.places("aaba ba", {"a", "aa", "ba", "c", ""}) == {"a": [0, 1, 3, 6], "aa": [0], "ba": [2, 5]}
    assert editing.places("", {"a"}) == {} and editing.places("a", set()) == {}


def test_quoted_paths_leave_python_as_paths(spark):
    d = spark.createDataFrame([(1, '{"results": {"a": 1.50, "b": false, "c": 0.00, "d": "Rome", "e": 123, "f": 123}}', "1.5 False 0.0 rome 123"), (2, '"Rome"', "Rome"), (3, None, "x"), (4, '{"d": "Rome"}', None)], "k int, r string, a string")
    d = editing.quoted_paths(d, "r", "a", "p")
    assert [r["p"] for r in d.orderBy("k").collect()] == [["results.a", "results.d", "results.e", "results.f"], [], [], []]
    assert "_spots" not in _plan(spark, "quoted_paths")


@pytest.mark.parametrize("name", ["json_shapes", "json_targets", "json_cascades", "json_deletions", "random_cascade_schemas"])
def test_what_is_decided_tree_by_tree_shuffles_no_leaves(spark, name):
    """Two shuffles make the orders; leaves are neither shuffled nor joined back, and no condition computes a choice again."""
    plan = _plan(spark, name)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1


def test_choices_of_arrays_are_those_of_leaf_tables(spark):
    trees_ = ['{"name": "n", "a": [{"x": 1, "y": 2}, {"x": 3}], "b": 4, "c": 5, "d": {"e": 6}}', '{"name": "n"}', "7", "no", '{"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}', "[[1, 2], [3]]"]
    d = spark.createDataFrame(list(enumerate(trees_)), "k int, j string")
    table, rows = json_tree.leaves(d, "k", "j"), json_tree.leaf_arrays(d, "j", "l")
    last, last_of = -F.col("pos"), lambda x: -x["pos"]
    read = lambda x: sorted(map(str, x.where("p is not null").collect()))
    assert read(trees.chosen_parts(table, "k", last).select("k", F.col("path").alias("p"))) == read(rows.select("k", trees.chosen_part_of(F.col("l"), last_of).alias("p")))
    assert read(trees.cascades(table, "k", last).select("k", F.col("paths").alias("p"))) == read(trees.cascades_of(rows, "l", last_of, "p").select("k", "p"))
    assert read(trees.random_cascades(table, "k", "s").select("k", F.col("paths").alias("p"))) == read(trees.random_cascades_of(rows, "l", "k", "s", "p", "leaf").select("k", "p"))
    assert read(trees.shapes(table, "k").select("k", F.struct("depth", "leaves", "list_items").alias("p"))) == read(rows.select("k", trees.shape_of(F.col("l")).alias("p")))
    chosen = trees.chosen_leaves(table, "k", last).groupBy("k").agg(F.array_sort(F.collect_list("path")).alias("p"))
    assert read(chosen) == read(rows.where(F.size("l") > 0).select("k", F.array_sort(trees.chosen_leaves_of(F.col("l"), last_of)).alias("p")))


ODD = ['{"name": "n", "a": [{"x": 1, "y": 2}, {"x": 3}], "b.c": 4, "": {"e": 6, "name": 7}, ".f": [[1], []]}', '{"name": {"name": 1}}', '{"name": 1}', "7", "no", "[[1, 2.50], [true, null]]", '{"items": [{"a.b": 1, "a": {"b": 2, "": 3}}]}']


@pytest.mark.parametrize("name", ["json_inner_paths", "json_siblings"])
def test_leaves_aren_t_shuffled_for_inner_paths_and_siblings(spark, name):
    plan = _plan(spark, name)
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("SortMergeJoin") == 1 and plan.count("MapInArrow") == 1


def test_inner_paths_are_those_of_leaf_tables(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "k int, j string")
    want = trees.inner_paths(json_tree.leaves(d, "k", "j"), "k")
    assert sorted(map(tuple, json_tree.inner_paths(d, "k", "j").collect())) == sorted(map(tuple, want.collect()))


def test_siblings_are_those_of_leaf_tables(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "k int, j string")
    names = ["path", "list_item", "parent", "n_siblings"]
    want = trees.siblings(json_tree.leaves(d, "k", "j"), "k").select("k", *names)
    assert sorted(map(str, json_tree.leaves(d, "k", "j", *names).select("k", *names).collect())) == sorted(map(str, want.collect()))


def test_leaves_without_list_items_are_walked_plainly(spark):
    for text in [*ODD, "[" * 400 + "1" + "]" * 400]:
        tree = json_tree.decode(text)
        assert [(p, v) for p, _, v in json_tree.walk(tree)] == json_tree.walk_plain(tree)
        assert json_tree.leaf_list(text) == (None if tree is None else [(p, n, json_tree.kind_of(v), json_tree.printed(v)) for p, _, n, v in json_tree.walk_named(tree)])


def test_orders_as_json_are_dealt_over_all_cores(spark):
    assert "REPARTITION_BY_NUM" in _plan(spark, "json_leaves")


def test_a_pattern_is_made_only_for_texts_that_hold_the_value(monkeypatch):
    made, bounded = [], json_tree.bounded
    monkeypatch.setattr(json_tree, "bounded", lambda old: made.append(old) or bounded(old))
    assert json_tree.replaced(json_tree.decode('{"a": [7, "x", 70], "b": "7.0"}'), "7", "8") == ({"a": ["8", "x", "70"], "b": "8"}, 2) and made == []
    assert json_tree.replaced(["no 7", "7 of 7", "77"], "7", "8") == (["no 8", "8 of 8", "77"], 3) and made == ["7"]


def test_edits_leave_python_with_the_columns_asked_for(spark):
    rows = [(i, t, *x) for i, (t, x) in enumerate((t, x) for t in ODD for x in [(None, "2.5", "9"), (["a.0", "name"], "1", "5"), (["", "items.0.a"], None, None), (None, None, "1"), ([], "n", "m"), ([], "3", None)])]
    d = spark.createDataFrame(rows, "k int, j string, g array<string>, o string, w string")
    whole = json_tree.edited(d, "k", "j", "g", "o", "w")
    changes = json_tree.edited(d, "k", "j", "g", "o", "w", "changes", "replaced")
    assert changes.columns == ["k", "replaced", "changes"] and sorted(map(str, changes.collect())) == sorted(map(str, whole.drop("json").collect()))
    assert json_tree.edited(d, "k", "j", "g", "o", "w", "json").columns == ["k", "json"] and sum(len(r["changes"]) > 0 for r in whole.collect()) > 5


def test_deletion_spans_are_placed_in_python(spark):
    assert "regexp_extract_all" not in _plan(spark, "deletion_spans") and "aggregate(" not in _plan(spark, "deletion_spans")
    assert editing.written_forms("-1234.5") == ["-1234.5", "-1,234.5", *[c + "-1,234.5" for c in editing.CURRENCIES]]
    assert editing.written_forms("12") == ["12", *[c + "12" for c in editing.CURRENCIES]] and editing.written_forms("x1") == ["x1"]
    taken = editing.Taken()
    assert [taken.take(*x) for x in [(5, 8), (2, 5), (4, 6), (5, 5), (6, 6), (8, 8), (8, 9), (0, 20), (9, 12), (0, 2)]] == [True, True, False, True, False, True, True, False, True, True]


def test_few_values_are_tagged_like_many(monkeypatch):
    leaves = [(f"a.{i}", "a", "string", v) for i, v in enumerate(["Rome", "rom", "me", "Romeo", "o", "Rome", "x y", "gone", "go", "ON"])]
    answer = "romeo in Rome, x y and gone; rome"
    few = editing._tagged(answer, leaves)
    monkeypatch.setattr(editing, "FEW", 0)
    assert editing._tagged(answer, leaves) == few and few[1] == 5 and few[0].startswith("[a]romeo[/a] in [a]Rome[/a]")


def test_tags_are_not_made_where_nobody_reads_them(spark):
    d = spark.createDataFrame([('{"a": 12}', "12")], "r string, a string")
    assert "tags" not in editing.tag_answers(d, "r", "a", tags=False).columns and "leaf:int" not in _plan(spark, "tagged_answers")


@pytest.mark.parametrize("name", ["tagged_deletions", "dialogue_labels"])
def test_rows_are_worked_on_once(spark, name):
    plan = _plan(spark, name)
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2 and (name != "tagged_deletions" or "aggregate(" not in plan)


def test_a_focus_is_drawn_from_paths_alone(spark):
    """Of the leaves only paths leave Python, and the parts above a leaf are cut from its path without arrays of parts."""
    plan = _plan(spark, "random_focus_schemas")
    assert "list_item" not in plan and "transform(" not in plan and plan.count("Exchange hashpartitioning") == 5


def _chance(*parts):
    return (int(hashlib.md5("|".join([str(p) for p in parts if p is not None]).encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def _focus(key, paths):
    """What random_focus draws for a key, one path after the other."""
    found = {}
    for path in paths:
        parts = path.split(".")
        for n in range(1, max(len(parts), 2)):
            part = ".".join(parts[:n])
            found[part, len(parts) < 2] = (len(parts) < 2, part == "name", -math.log(_chance("s", key, part)) / n)
    return min(found, key=found.get)[0]


def test_a_focus_is_drawn_once_a_key(spark):
    """Rows with the same key are one tree, null keys too; texts without leaves have none."""
    rows = [(k, t) for k in range(40) for t in (ODD[k % len(ODD)],)] + [(0, ODD[0]), (1, '{"z": {"y": {"x": 1}}}'), (None, ODD[0]), (None, ODD[1]), (50, None), (51, ""), (52, "{}"), (53, '{"a": {}}'), (54, '{"": {"": {"": 1}}}'), (55, '{"a.": [".", {"..": 1}]}')]
    d = spark.createDataFrame(rows, "k int, j string")
    held = defaultdict(list)
    for k, t in rows:
        held[k] += [] if (tree := json_tree.decode(t)) is None else [p for p, _ in json_tree.walk_plain(tree)]
    for leaves in (json_tree.leaves(d, "k", "j", "path"), json_tree.leaves(d, "k", "j")):
        got = [tuple(r) for r in trees.random_focus(leaves, "k", "s").collect()]
        assert sorted(got, key=str) == sorted(((k, _focus(k, paths)) for k, paths in held.items() if paths), key=str)


def _cascade(key, leaves):
    """What random_cascades_of draws and frees of a tree, one leaf after the other."""
    drawn = [x for x in leaves if x[0] != "name"] or leaves
    leaf, item = min(drawn, key=lambda x: -math.log(_chance("s", key, x[0])) / len(x[0].split(".")))
    if item is not None:
        return leaf, [p for p, _ in leaves if p == item or p.startswith(f"{item}.")]
    up = leaf.rpartition(".")[0]
    start = f"{up}." if up else ""
    parts = [p for p in dict.fromkeys(start + p[len(start) :].split(".")[0] for p, _ in leaves if p.startswith(start)) if up or p != "name"]
    if len(parts) <= 3:
        return leaf, parts or [leaf]
    more = 2 + math.floor(_chance("s n", key) * (max(2, math.ceil(len(parts) / 2)) - 1))
    return leaf, [leaf, *sorted([p for p in parts if p != leaf], key=lambda p: _chance("s others", key, p))[: more - 1]]


def test_a_cascade_is_drawn_tree_by_tree(spark):
    """Rows with the same key, without one or without leaves keep what they had."""
    wide = '{"name": "n", "a": 1, "b": 2, "c": {"d": 3, "e": 4, "f": {"g": 5}, "h": 6, "i": 7}, "j": 8, "k": 9}'
    rows = [(k, t) for k in range(60) for t in ([*ODD, wide][k % (len(ODD) + 1)],)] + [(0, wide), (0, ODD[0]), (None, wide), (None, ODD[0]), (70, None), (71, ""), (72, "{}"), (73, '{"": {"": 1}, "b": ".", "c": []}')]
    d = spark.createDataFrame(rows, "k int, j string")
    want = []
    for k, t in rows:
        tree = json_tree.decode(t)
        leaves = [] if tree is None else [(p, g) for p, g, _ in json_tree.walk(tree)]
        want.append((k, t, *(_cascade(k, leaves) if leaves else (None, None))))
    for fields in ((), ("path", "list_item")):
        made = trees.random_cascades_of(json_tree.leaf_arrays(d, "j", "l", *fields), "l", "k", "s", "p", "leaf")
        assert sorted(map(str, map(tuple, made.select("k", "j", "leaf", "p").collect()))) == sorted(map(str, want))


def test_a_path_above_a_leaf_is_found_once_a_tree(spark):
    """No pattern is matched for each leaf, and what stands beside a leaf is sought only where it isn't in a list."""
    assert 0 < _plan(spark, "random_cascade_schemas").count("regexp_replace") <= 2


def test_leaf_arrays_have_the_fields_asked_for(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", "{}", "[" * 400 + "1" + "]" * 400])]
    d = spark.createDataFrame(rows, "k int, j string").repartition(1)
    whole = json_tree.leaf_arrays(d, "j", "l")
    few = json_tree.leaf_arrays(d, "j", "l", "list_item", "path")
    assert few.schema["l"].dataType.simpleString() == "array<struct<path:string,list_item:string>>"
    assert whole.schema["l"].dataType.simpleString() == "array<struct<pos:int,path:string,list_item:string,kind:string,value:string>>"
    made = {r["k"]: [tuple(x) for x in r["l"]] for r in whole.collect()}
    table = json_tree.leaves(d, "k", "j").orderBy("k", "pos").collect()
    assert made == {k: [tuple(r)[1:] for r in table if r["k"] == k] for k, _ in rows}
    assert {r["k"]: [tuple(x) for x in r["l"]] for r in few.collect()} == {k: [x[1:3] for x in own] for k, own in made.items()}


def test_a_schema_takes_each_freed_path_once(monkeypatch):
    """Paths are dealt to the parts they name, not tried for each part: a wide tree of which much is freed takes time with its width alone."""
    looked, place = [], json_tree._place
    monkeypatch.setattr(json_tree, "_place", lambda key, n: looked.append(key) or place(key, n))
    for text, paths in [(str([*range(60)]), [str(i) for i in range(-60, 70, 2)]), ("{" + ", ".join(f'"{i}": [{i}, {{"a": -{i}.50, "b": "x"}}]' for i in range(60)) + "}", [f"{i}.{j}" for i in range(50) for j in ("0", "1.a", "1.a.b", "2", "x")])]:
        looked.clear()
        old = json_tree.encode(json_tree.unlocked(json_tree.locked_schema(json_tree.decode(text)), paths))
        assert json_tree.schema_text(json_tree.decode(text), [p.split(".") for p in paths]) == old
        assert len(looked) == len(paths)
