"""Edited answers against plain versions, on random rows and worked ones."""

import json
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F
from spanloom import catalog_editing
from spanloom.functions import json_tree
from spanloom.operators import editing


def _tree(chance, depth=0):
    kind = chance.random()
    if depth < 3 and kind < 0.35:
        return {chance.choice("abcde"): _tree(chance, depth + 1) for _ in range(chance.randint(0, 4))}
    if depth < 3 and kind < 0.6:
        return [_tree(chance, depth + 1) for _ in range(chance.randint(0, 3))]
    return chance.choice([None, True, False, 1, 12, 121, 1500, 2.5, 1200.0, "Rome", "rom", " ", "", "me in", "aa", "aaa", "121"])


def _leaves(tree, path=(), names=()):
    if isinstance(tree, dict):
        return [x for k, v in tree.items() for x in _leaves(v, (*path, k), (*names, k))]
    if isinstance(tree, list):
        return [x for i, v in enumerate(tree) for x in _leaves(v, (*path, str(i)), names)]
    return [(".".join(path), ".".join(names), tree)]


def _rows(n, seed):
    chance = random.Random(seed)
    words = ["Rome", "ROM", "me in", "aaaa", "121", "1,500", "$1,500", "12", "true", "none", "2.5", "1200", "False", "x", "é"]
    return [(i, json.dumps({"name": "t", "results": _tree(chance)}) if i % 9 else "no json", " ".join(chance.choice(words) for _ in range(chance.randint(0, 12)))) for i in range(n)]


def _tag_plainly(response, answer):
    """Each value, longest first, at the first place where no character is taken."""
    leaves = [(n, str(v).lower() if isinstance(v, bool) else str(v)) for _, n, v in _leaves(response) if v is not None]
    taken, mask = [], set()
    order = sorted((x for x in leaves if x[1].strip()), key=lambda x: -len(x[1]))
    for names, value in order:
        for at in range(len(answer) - len(value) + 1):
            place = set(range(at, at + len(value)))
            if answer[at : at + len(value)].lower() == value.lower() and not place & mask:
                mask |= place
                taken.append((at, at + len(value), names.split(".")[-1]))
                break
    unmatched = [n for n, v in order if not any(v.lower() in answer[s:e].lower() for s, e, _ in taken)]
    tagged = answer
    for s, e, k in sorted(taken, reverse=True):
        tagged = f"{tagged[:s]}[{k}]{tagged[s:e]}[/{k}]{tagged[e:]}"
    return tagged, len(taken), unmatched


def test_tagging_equals_a_plain_matcher(spark):
    rows = _rows(400, 1)
    got = {r["i"]: (r["tagged_answer"], r["num_tags"], r["unmatched_keys"]) for r in editing.tag_answers(spark.createDataFrame(rows, "i int, r string, a string"), "r", "a").collect()}
    for i, r, a in rows:
        want = _tag_plainly(json.loads(r), a) if r != "no json" else (a, 0, [])
        assert got[i] == want, (r, a)


def test_tags_where_missing(spark):
    rows = [(1, '{"c":"Rome"}', "Rome", None), (2, '{"c":"Rome"}', "Rome", "kept"), (3, '{"c":"Rome"}', "Rome", "")]
    d = spark.createDataFrame(rows, "i int, r string, a string, tagged_answer string")
    assert [r[0] for r in editing.tag_where_missing(d, "r", "a").orderBy("i").select("tagged_answer").collect()] == ["[c]Rome[/c]", "kept", "[c]Rome[/c]"]
    assert {r[0] for r in editing.tag_where_missing(d, "r", "a", overwrite=True).select("tagged_answer").collect()} == {"[c]Rome[/c]"}


def test_case_folding_keeps_offsets():
    assert editing.lowered("İstanbul ROM") == "İstanbul rom" and editing.lowered("ÀB") == "àb"
    assert editing.places("aaaa", {"aa", "a", ""}) == {"a": [0, 1, 2, 3], "aa": [0, 1, 2]}


def test_tag_paths_go_on_behind_what_they_took(spark):
    tags = [{"key": k, "value": v} for k, v in [("p", "b"), ("p", "a"), ("q", "1"), ("p", "zz"), ("p", "c")]]
    leaves = [{"path": p, "value": v} for p, v in [("x.0.p", "a"), ("x.1.p", "b"), ("x.1.q", "12"), ("x.2.p", "c"), ("x.3.p", "d")]]
    d = spark.createDataFrame([(tags, leaves), (None, None)], "t array<struct<key:string,value:string>>, l array<struct<path:string,value:string>>")
    got = [r[0] for r in editing.tag_paths(d, "t", "l", "p").select("p").collect()]
    assert got == [["x.1.p", "x.2.p", "x.1.q", "x.3.p", None], []]


def test_spots_prefer_the_value_and_then_its_forms(spark):
    answer = "1,500 of Rome; ROME. $2,043.09 and 50 % or 7"
    values = [("number", "1500"), ("string", "rome"), ("number", "2043.09"), ("string", "50"), ("string", "050"), ("number", "7"), ("null", "None"), ("string", "absent"), ("string", " of ")]
    d = spark.createDataFrame([(answer, [("p", "p", k, v) for k, v in values])], "a string, l array<struct<path:string,names:string,kind:string,value:string>>")
    got = [tuple(x) for x in editing.spots(d, "a", "l", "s").first()["s"]]
    at = lambda x: (1, answer.index(x), answer.index(x) + len(x))
    none = (0, None, None)
    assert got == [at("1,500"), (2, 9, 13), at("2,043.09"), none, none, none, none, none, none]


def _subtree(tree, path):
    for k in path.split("."):
        tree = tree[int(k)] if isinstance(tree, list) else tree[k]
    return tree


def test_deletions_keep_their_budget(spark):
    rows = _rows(500, 2)
    d = spark.createDataFrame(rows, "i int, r string, a string")
    found = {r["i"]: r["deletion"] for r in editing.budgeted_deletions(d, "r", "a", lambda p: F.xxhash64(p)).collect()}
    done = 0
    for i, r, a in rows:
        x = found[i]
        if x is None:
            continue
        done += 1
        tree = json.loads(r)
        before, after = len(_leaves(tree["results"])), len(_leaves(json.loads(x["reduced"])["results"]))
        gone = _leaves(_subtree(tree, x["path"]))
        assert 2 * len(gone) <= before and x["pct_deleted"] == pytest.approx(100 * len(gone) / before, abs=0.51)
        assert before - after in (len(gone), len(gone) - 1)  # a list or object that is left empty is no leaf
        assert x["n_spans"] == len(x["spans"]) >= 1 and 2 * sum(s["end"] - s["start"] for s in x["spans"]) <= len(a)
        assert all(a[s["start"] : s["end"]] == s["text"] for s in x["spans"])
        for _, _, v in gone:
            assert v is None or len(str(v).strip()) < 3 or a.lower().count(str(v).strip().lower()) <= 1
        assert [y["value"] for y in x["leaves"]] == [str(v) for _, _, v in gone] and x["cascade"] == isinstance(_subtree(tree, x["path"]), (dict, list))
    assert done > 20
    one = editing.budgeted_deletions(spark.createDataFrame([(1, '{"results":{"a":"Rome"}}', "Rome is a city of many hills")], "i int, r string, a string"), "r", "a", lambda p: p).first()
    assert one["deletion"] is None  # a tree with one leaf


def test_each_stage_of_mismatch_spans(spark):
    before = '{"city":"Rome","n":1234,"q":"same","m":"old words","z":"gone"}'
    rows = [
        ("tag", '{"city":"Oslo","n":1234,"q":"same","m":"old words","z":"gone"}', "In [city]Rome[/city] 1234"),
        ("old text", '{"city":"Oslo","n":1234,"q":"same","m":"old words","z":"gone"}', "In Rome, Rome"),
        ("new text", '{"city":"Rome","n":"12","q":"same","m":"old words","z":"gone"}', "There are 12 of them"),
        ("deleted", '{"city":"Rome","n":1234,"q":"same","m":"old words"}', "It is gone"),
        ("implicit", '{"city":"Oslo","n":1234,"q":"same","m":"old words","z":"gone"}', "A capital"),
        ("fits", '{"city":"Oslo","n":1234,"q":"Rome and same","m":"old words","z":"gone"}', "In [city]Rome[/city]"),
        ("same", before, "In [city]Rome[/city]"),
        ("overlap", '{"city":"Oslo","n":1234,"q":"same","m":"new","z":"x"}', "[m]old words[/m] in Rome or gone"),
        ("blank", '{"city":"Oslo"}', " "),
    ]
    d = spark.createDataFrame([(n, before, h, t) for n, h, t in rows], "w string, r string, h string, t string")
    got = {r["w"]: [(s["start"], s["end"], s["text"], s["label_type"], s["implicit_true"]) for s in r["labels"]] for r in editing.mismatch_spans(d, "r", "h", "t").collect()}
    clash, baseless = editing.CONFLICT, editing.BASELESS
    assert got["tag"] == got["old text"] == [(3, 7, "Rome", clash, False)]
    assert got["new text"] == [(10, 12, "12", clash, False)]
    assert got["deleted"] == [(6, 10, "gone", baseless, False)]
    assert got["implicit"] == [(0, 9, "A capital", clash, True)]
    assert got["same"] == got["blank"] == []
    assert got["fits"] == [(0, 7, "In Rome", clash, True)]  # only the change of q is left, and nothing of it is quoted
    assert got["overlap"] == [(0, 9, "old words", clash, False), (13, 17, "Rome", clash, False), (21, 25, "gone", clash, False)]


def test_deletion_spans_join_over_white_space(spark):
    rows = [
        ("forms", "It cost [n]45000[/n], $45,000 or 45000  45000.", [("n", "n", "45000")], ["n"]),
        ("other tag", "[n]about[/n] it", [("n", "n", "45000")], ["n"]),
        ("path only", "rome and ROME", None, ["city"]),
        ("nothing", "unknown", None, ["city"]),
        ("no deletion", "unknown", None, None),
    ]
    d = spark.createDataFrame([(n, '{"city":"Rome","n":45000}', *x) for n, *x in rows], "w string, r string, t string, m array<struct<tag:string,path:string,original_value:string>>, g array<string>")
    got = {r["w"]: [(s["text"], s["implicit_true"], s["due_to_null"]) for s in r["labels"]] for r in editing.deletion_spans(d, "r", "t", "m", "g").collect()}
    assert got["forms"] == [("45000", False, True), ("45,000", False, True), ("45000  45000", False, True)]
    assert got["other tag"] == [("about", False, True)] and got["path only"] == [("rome", False, True), ("ROME", False, True)]
    assert got["nothing"] == [("unknown", True, True)] and got["no deletion"] == []


def test_comments_at_the_end_or_last_place(spark):
    d = spark.createDataFrame([("A.\n\nB.", "B."), ("B. A.\nB. ", "B."), ("A.", ""), ("A.", None), ("A.", "C.")], "a string, c string")
    got = [[(s["start"], s["end"]) for s in r[0] or []] for r in d.select(editing.comment_spans(F.col("a"), F.col("c"), F.lit("t"))).collect()]
    assert got == [[(4, 6)], [(6, 8)], [], [], []]


def test_printed_leaves_are_as_python_prints_them(spark):
    d = spark.createDataFrame([('{"a":{"b":[1.50,1e3,true,null,"x"]}}',), ("no",)], "t string")
    got = [r["l"] and [(x["path"], x["names"], x["value"]) for x in r["l"]] for r in json_tree.printed_leaves(d, "t", "l").collect()]
    assert got == [[("a.b.0", "a.b", "1.5"), ("a.b.1", "a.b", "1000.0"), ("a.b.2", "a.b", "True"), ("a.b.3", "a.b", "None"), ("a.b.4", "a.b", "x")], None]


def test_nothing_shuffles_behind_the_responses(spark):
    d = catalog_editing.order_responses(spark, SF)
    before = d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert editing.tag_answers(d, "response", "answer")._jdf.queryExecution().executedPlan().toString().count("Exchange") == before


def test_quoted_paths_and_tagged_deletions(spark):
    response = '{"name":"n","results":{"city":"Rome","n":1234,"z":0.0,"f":false,"t":true,"l":[{"p":"alpha"},{"p":"beta"}],"twice":"abc"}}'
    d = spark.createDataFrame([(response, "Rome 1,234 0.0 False true alpha abc abc"), ("[]", "x"), ('"Rome"', "Rome"), ("no json", "x"), (None, None)], "r string, a string")
    got = [r["p"] for r in editing.quoted_paths(d, "r", "a", "p").collect()]
    assert got == [["results.city", "results.n", "results.t", "results.l.0.p"], [], [], [], []]
    tagged = "In [city]Rome[/city]: [p]alpha[/p] or [p]alphabet[/p], [l]beta[/l]"
    e = spark.createDataFrame([(response, tagged, ["results.city", "results.l.0.p", "results.l.1", "results.none", "0"]), (response, tagged, None)], "r string, t string, g array<string>")
    one, none = (r["x"] for r in editing.tagged_deletions(e, "r", "t", "g", "x").collect())
    assert [(x["path"], x["tag"], x["span_text"], x["original_value"]) for x in one] == [("results.city", "city", "[city]Rome[/city]", "Rome"), ("results.l.0.p", "p", "[p]alpha[/p]", "alpha"), ("results.l.0.p", "p", "[p]alphabet[/p]", "alpha"), ("results.l.1", "l", "[l]beta[/l]", "beta")]
    assert all(tagged[x["span_start"] : x["span_end"]] == x["span_text"] for x in one) and none == []
