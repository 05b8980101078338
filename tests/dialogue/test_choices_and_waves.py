"""Weighted choices, schemas with types, filler, and completion in waves."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from spanloom.functions import json_tree, text
from spanloom.operators import trees
from spanloom.plans import completion

TREE = '{"name":"t","a":1,"b":{"c":2,"d":{"e":3}},"l":[{"x":1,"y":2}]}'


def test_leaves_are_drawn_by_depth(spark):
    d = spark.range(6000).select(F.col("id").alias("k"), F.lit(TREE).alias("j"))
    got = trees.random_cascades(json_tree.leaves(d, "k", "j"), "k", "s").groupBy("leaf").count().collect()
    share = {r["leaf"]: r["count"] / 6000 for r in got}
    weight = {"a": 1, "b.c": 2, "b.d.e": 3, "l.0.x": 3, "l.0.y": 3}
    assert set(share) == set(weight)
    assert all(share[p] == pytest.approx(w / 12, abs=0.025) for p, w in weight.items())
    inner = {r["path"]: r["count"] / 6000 for r in trees.random_focus(json_tree.leaves(d, "k", "j"), "k", "s").groupBy("path").count().collect()}
    assert {p: round(s * 6) for p, s in inner.items()} == {"b": 1, "b.d": 2, "l": 1, "l.0": 2}


def test_what_is_freed_with_a_leaf(spark):
    wide = json.dumps({"name": "t", **{f"f{i}": i for i in range(9)}})
    rows = [(1, '{"name":"only"}'), (2, '{"a":1,"b":2,"name":"x"}'), (3, '{"l":[[1,2],[3]]}'), (4, "no json")] + [(i, wide) for i in range(10, 300)]
    d = spark.createDataFrame(rows, "k int, j string")
    got = {r["k"]: (r["leaf"], r["paths"]) for r in trees.random_cascades(json_tree.leaves(d, "k", "j"), "k", "s").collect()}
    assert got[1] == ("name", ["name"]) and sorted(got[2][1]) == ["a", "b"] and 4 not in got
    assert got[3][1] == [got[3][0]]  # a scalar in a list is its own item
    for k in range(10, 300):
        leaf, paths = got[k]
        assert paths[0] == leaf and len(set(paths)) == len(paths) and 2 <= len(paths) <= 5 and "name" not in paths
    assert {len(got[k][1]) for k in range(10, 300)} == {2, 3, 4, 5}
    flat = {r["path"] for r in trees.random_focus(json_tree.leaves(d.where("k = 2 or k = 1"), "k", "j"), "k", "s").collect()}
    assert "name" in flat and flat & {"a", "b"}


def test_schemas_keep_their_types(spark):
    tree = '{"a":true,"b":1,"c":1.5,"d":"x","e":null,"f":[1]}'
    d = spark.createDataFrame([(tree,)], "j string").select(json_tree.lock("j").alias("s"), json_tree.unlock(json_tree.lock("j"), F.array(F.lit("b"), F.lit("c"), F.lit("f"))).alias("u")).first()
    leaves = {"a": {"type": "boolean", "enum": [True]}, "b": {"type": "integer", "enum": [1]}, "c": {"type": "number", "enum": [1.5]}, "d": {"type": "string", "enum": ["x"]}, "e": {"type": "null"}}
    leaves["f"] = {"type": "array", "prefixItems": [{"type": "integer", "enum": [1]}], "minItems": 1, "maxItems": 1}
    assert json.loads(d["s"])["properties"] == leaves
    free = leaves | {"b": {"type": "integer"}, "c": {"type": "number"}, "f": {"type": "array", "prefixItems": [{"type": "integer"}]}}
    assert json.loads(d["u"])["properties"] == free


def test_filler_goes_until_none_is_left(spark):
    rows = [
        ("Done. ", "Done."),
        ("Done.\n\nFeel free to ask.", "Done."),
        ("A is 1.  B is 2. Let me know! I am here to help.", "A is 1. B is 2."),
        ('He said "stop." Ask me.', 'He said "stop."'),
        ("Ask me", ""),
        ("One.\n\nTwo ask me.\n\nThree", "One.\n\nTwo ask me.\n\nThree"),
        ("One\n\nTwo ask me\n\nThree", ""),  # one sentence, as nothing ends it
        ("", ""),
        (None, None),
    ]
    d = spark.createDataFrame(rows, "t string, w string")
    assert [r[0] for r in d.select(text.without_filler(F.col("t"))).collect()] == [w for _, w in rows]
    long = spark.range(1).select(text.without_filler(F.concat(F.repeat(F.lit("It is. "), 100_000), F.lit("Ask me."))).alias("t")).first()["t"]
    assert len(long) == 699_999
    fit = spark.createDataFrame([("Sixteen letters!", "x"), ("Fifteen letter", ""), (None, "x"), ("IS IT THE same as here", "so is it the SAME as here"), ("Aaaa. Bbbb. Cccc. Dddd.", ""), ("Can I help with all", "")], "c string, a string")
    assert [r[0] for r in fit.select(text.comment_is_fit(F.col("c"), F.col("a"))).collect()] == [True, False, False, False, False, False]


def test_waves_ask_only_failed_rows_again(spark, tmp_path):
    class Stored:
        """Responses by prompt and temperature; each call leaves a file."""

        def __init__(self, folder):
            self.folder = folder

        def complete(self, prompt, temperature):
            with open(f"{self.folder}/{prompt}-{temperature:.1f}-{time.time_ns()}", "w"):
                pass
            if prompt == "raises" and temperature < 1:
                raise ValueError("busy")
            return {"first": "good", "second": "good" if temperature > 0.9 else "bad", "never": "bad", "empty": ""}.get(prompt, "good")

    calls, folder = tmp_path / "calls", f"file://{tmp_path}/waves"
    calls.mkdir()
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["first", "second", "never", "empty", "raises", None])], "k int, prompt string")
    run = lambda n: {r["k"]: r for r in completion.waves(rows, ["k"], "prompt", Stored(str(calls)), F.col("raw_response") == "good", folder, attempts=n).collect()}
    made = lambda: sorted(x.rsplit("-", 1)[0] for x in os.listdir(calls))
    got = run(2)
    assert [(got[k]["status"], got[k]["attempt"]) for k in range(6)] == [("ok", 0), ("ok", 1), ("error", 1), ("error", 1), ("ok", 1), ("error", 1)]
    assert made() == ["empty-0.8", "empty-1.0", "first-0.8", "never-0.8", "never-1.0", "raises-0.8", "raises-1.0", "second-0.8", "second-1.0"]
    # A later run goes on where this one ended, hotter up to the limit, and repeats no call.
    got = run(6)
    assert [x for x in made() if x.startswith(("first", "second", "raises"))] == ["first-0.8", "raises-0.8", "raises-1.0", "second-0.8", "second-1.0"]
    assert [x for x in made() if x.startswith("never")] == ["never-0.8", "never-1.0", "never-1.2", "never-1.4", "never-1.4", "never-1.4"]
    assert (got[2]["raw_response"], got[2]["error"], got[2]["attempt"]) == ("bad", "refused", 5) and got[5]["error"] == "no prompt"
    # A round that broke off, without its mark of success, is made again; the others are read.
    os.remove(tmp_path / "waves" / "attempt=5" / "_SUCCESS")
    before = len(made())
    run(6)
    assert len(made()) == before + 2  # never and empty
