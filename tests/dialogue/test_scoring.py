"""Worked examples of scoring, rows, text clean-up, token spans and JSON edits; expected values are worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF2
from spanloom.functions import cleanup, json_tree, text
from spanloom.operators import examples, metrics, reports, rows, scoring, spans, trees


def one(spark, column, **values):
    """The column's value over one row of texts, numbers and so on."""
    names = list(values)
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds.get(type(values[n]), 'string')}" for n in names) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


def test_types(spark):
    forms = {"Correct": "clean", " OK": "clean", "no-hallucination": "clean", "Missing Tool": "missing_tool", "singlehop_mt": "missing_tool", "AM": "answer_mismatch", "answer_missmatch": "answer_mismatch", "ug": "undergeneration", "over": "over", "": ""}
    d = spark.createDataFrame([(k,) for k in forms], "k string").select("k", metrics.normalize_type(F.col("k")).alias("v"))
    assert {r.k: r.v for r in d.collect()} == forms
    assert one(spark, metrics.normalize_type(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, []),
        ("[]", []),
        ("  ", []),
        ("bare text", [(None, None, "bare text", None)]),
        ('[{"start": 1, "end": 4, "text": "abc", "type": "og"}]', [(1, 4, "abc", "og")]),
        ('{"spans": [[2, 5], [2, 5, "xyz"], [7]]}', [(2, 5, None, None), (2, 5, "xyz", None)]),
        ('{"predictions": "one"}', [(None, None, "one", None)]),
        ('{"spans": null, "predictions": ["x"]}', []),
        ('["{\\"start\\": \\"3\\", \\"end\\": 9.7}", "", "word", 5, null, {"other": 1}]', [(3, 9, None, None), (None, None, "word", None)]),
        ('[{"start": 1, "end": "x", "span": "q", "category": 7}]', [(None, None, "q", "7")]),
        ('[{"start": 1, "text": ""}]', []),
        ("[not json", [(None, None, "[not json", None)]),
    ],
)
def test_span_lists(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "c string").select(scoring.parse_span_list("c").alias("v")).first().v
    assert [tuple(x) for x in got] == want


@pytest.mark.parametrize(
    "status, kind, classes, failed",
    [
        ("ok", "correct", ["clean"], False),
        ("ok", '["og", "mt", "overgen", "nonsense"]', ["overgeneration", "missing_tool"], False),
        ("ok", "nonsense", ["other"], False),
        ("ok", "unknown", None, True),
        ("ok", None, None, True),
        ("error", "clean", None, True),
    ],
)
def test_predicted_classes(spark, status, kind, classes, failed):
    got = spark.createDataFrame([(status, kind, "[]")], "s string, k string, p string").select(scoring.predicted("s", "k", "p").alias("v")).first().v
    assert (got.classes, got.failed) == (classes, failed)


@pytest.mark.parametrize(
    "parsed, errors, classes, n, failed",
    [
        (True, "[]", ["clean"], 0, False),
        (True, '[{"class": "am", "span": "x"}, {"class": "am"}]', ["answer_mismatch"], 1, False),
        (True, '[{"class": "strange", "span": "x"}]', ["other"], 1, False),
        (True, None, None, 0, True),
        (False, "[]", None, 0, True),
    ],
)
def test_verdicts_with_errors(spark, parsed, errors, classes, n, failed):
    got = spark.createDataFrame([(parsed, errors)], "p boolean, e string").select(scoring.verdict_errors(F.col("p"), "e").alias("v")).first().v
    assert (got.classes, len(got.spans), got.failed) == (classes, n, failed)


RAW = scoring.RAW


@pytest.mark.parametrize(
    "raw, placed, issues",
    [
        ([(2, 5, "cat", None)], [(2, 5, "cat", None)], []),
        ([(6, 9, "cat", None)], [(9, 12, "cat", None)], ["MOVED 0"]),
        ([(0, 3, "dog", None)], [(0, 3, "a c", "dog")], ["OFFSETS_USED 0"]),
        ([(None, None, "dog", None), (None, None, None, "x")], [(None, None, "dog", None)], ["UNPLACED 0", "DROPPED 1"]),
        ([(2, 5, None, None), (5, 99, None, None)], [(2, 5, "cat", None)], ["DROPPED 1"]),
    ],
)
def test_anchoring(spark, raw, placed, issues):
    got = spark.createDataFrame([("a cat, a cat", raw)], f"t string, r {RAW}").select(scoring.anchored(F.col("t"), F.col("r")).alias("v")).first().v
    assert [tuple(x) for x in got.spans] == placed and got.issues == issues


def test_validated(spark):
    d = spark.createDataFrame([("clean", [(2, 5, "cat", None)]), ("strange", [(2, 5, "cat", None)])], f"k string, r {RAW}")
    got = [r.v for r in d.select(scoring.validated(F.col("k"), F.col("r"), F.lit("a cat")).alias("v")).collect()]
    assert (got[0].type, got[0].spans, got[0].issues) == ("clean", [], ["SPANS_CLEARED"])
    assert (got[1].type, len(got[1].spans), got[1].issues) == ("unknown", 1, ["UNKNOWN_TYPE"])


@pytest.mark.parametrize(
    "raw, locate, kept, lost",
    [
        ([(6, 9, "cat", None)], True, [(9, 12, "cat")], 0),
        ([(6, 9, "cat", None)], False, [(6, 9, " a ")], 0),
        ([(None, None, "dog", None)], True, [], 1),
        ([(None, None, "cat", None)], True, [(2, 5, "cat")], 0),
        ([(None, None, "cat", None)], False, [], 1),
        ([(0, 3, "dog", None), (10, 50, None, None)], True, [(0, 3, "a c"), (10, 12, "at")], 0),
        ([(40, 50, None, None)], True, [], 1),
        ([(40, 50, None, None)], False, [], 0),
    ],
)
def test_final_spans(spark, raw, locate, kept, lost):
    got = spark.createDataFrame([("a cat, a cat", raw)], f"t string, r {RAW}").select(spans.finalize(F.col("t"), F.col("r"), locate).alias("v")).first().v
    assert [tuple(x) for x in got.spans] == kept and got.unlocatable == lost


def test_occurrences_and_nearest_place(spark):
    rng = random.Random(4)
    cases = [("aaaa", "aa", 1), ("", "a", 0), ("a", "", 0), ("x\\E.y\\E", "\\E", 3), ("😀a😀a", "a", 3)]
    cases += [("".join(rng.choice("ab.(") for _ in range(60)), "".join(rng.choice("ab.(") for _ in range(rng.randint(1, 3))), rng.randint(0, 60)) for _ in range(60)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p string, a int")
    got = {r.i: (r.o, r.n) for r in d.select("i", spans.occurrences(F.col("t"), F.col("p")).alias("o"), spans.nearest_occurrence(F.col("t"), F.col("p"), F.col("a")).alias("n")).collect()}
    for i, (t, p, a) in enumerate(cases):
        places = [k for k in range(len(t)) if p and t.startswith(p, k)]
        assert got[i] == (places, min(places, key=lambda k: (abs(k - a), k), default=-1))


def test_anchoring_over_whole_documents(spark):
    from spanloom import catalog

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    for r in catalog.span_anchoring(spark, SF2).collect():
        t = docs[r.doc_id]
        part, anchor = t[(s := r.doc_id * 13 % (len(t) - 5)) : s + 4], r.doc_id * 31 % len(t)
        places, at = [], t.find(part)
        while at >= 0:
            places.append(at)
            at = t.find(part, at + 1)
        assert (r.times, r["at"]) == (len(places), min(places, key=lambda k: (abs(k - anchor), k)))


def test_label_rules(spark):
    d = spark.createDataFrame([("clean", 1, 0, False), ("missing_tool", 1, 1, False), ("missing_tool", 0, 0, False), ("overgeneration", 2, 1, True), ("overgeneration", 0, 1, False)], "g string, p int, n int, o boolean")
    got = d.select(reports.detection_label(F.col("g"), F.col("p") > 0).alias("a"), reports.overlap_label(F.col("g"), F.col("p"), F.col("n"), F.col("o")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("clean", "clean"), ("missing_tool", "clean"), ("clean", "missing_tool"), ("overgeneration", "overgeneration"), ("clean", "clean")]


SCALARS = {"1,840": "1840", "2.0": "2", "None": "null", '"TRUE"': "true", "1.50": "1.5", "1e3": "1000", "'a  b'": "a b", '"abc': '"abc', " x\ty ": "x y", "-0.25": "-0.25", "0.00001": "1e-05", "1.2.3": "1.2.3", "1,2": "12", ".5": "0.5", "": ""}


def test_scalars_in_one_form(spark):
    d = spark.createDataFrame([(k,) for k in SCALARS], "k string")
    assert {r.k: r.v for r in d.select("k", text.canonical(F.col("k")).alias("v")).collect()} == SCALARS
    assert {k: json_tree.one_form(k) for k in SCALARS} == SCALARS


def test_punctuation_is_complete_and_keeps_places():
    assert len(text.VARIANTS) == len(text.PLAIN) == len(set(text.VARIANTS)) == 26


@pytest.mark.parametrize(
    "tree, old, new, want, n",
    [
        ('{"a": 18, "b": "18", "c": "1840 or 18."}', "18", "20", '{"a": 20, "b": "20", "c": "1840 or 20."}', 3),
        ('{"a": 2.5, "b": [2.5, "2.50"]}', "2.5", "3", '{"a": 3.0, "b": [3.0, "3"]}', 3),
        ('{"a": true}', "True", "nonsense", '{"a": true}', 1),
        ('{"a": true}', "true", "FALSE", '{"a": false}', 1),
        ('{"a": 7}', "7", "many", '{"a": "many"}', 1),
        ('{"a": 7}', " 7.0 ", "1,000", '{"a": 1000}', 1),
        ('{"a": null, "b": "x"}', "none", "y", '{"a": "y", "b": "x"}', 1),
    ],
)
def test_replacements(tree, old, new, want, n):
    got, times = json_tree.replaced(json_tree.decode(tree), old, new)
    assert (json_tree.encode(got), times) == (want, n)


def test_recovery_of_cut_json():
    whole = json.dumps({"a": [1, {"b": "x" * 300, "c": list(range(200))}], "d": "e"})
    for cut in (5, 60, 300, 600, len(whole) - 1):
        got = json_tree.recovered(whole[:cut])
        assert got is not None and json.loads(got) is not None
    late = '{"a": 1, "b": [' + "tru " * 500
    assert json.loads(json_tree.recovered(late)) == {"a": 1, "b": []} or json.loads(json_tree.recovered(late)) == {"a": 1}
    assert json_tree.recovered("no") is None and json_tree.recovered(None) is None


def test_edits_and_cascades(spark):
    d = spark.createDataFrame([(1, '{"n": {"x": 1, "y": 2}, "l": [{"p": 1}, {"p": 2}, {"p": 3}]}', ["l.0", "l.2", "n.x", "no.such"]), (2, "no json", ["a"]), (3, None, None)], "k int, j string, g array<string>").withColumns({"o": F.lit(None).cast("string"), "w": F.lit(None).cast("string")})
    got = {r.k: r for r in json_tree.edited(d, "k", "j", "g", "o", "w").collect()}
    assert got[1].json == '{"n": {"y": 2}, "l": [{"p": 2}]}' and got[2].json == "no json" and got[3].json is None
    leaves = json_tree.leaves(d, "k", "j")
    assert {(r.path, r.list_item, r.kind) for r in leaves.collect()} == {("n.x", None, "number"), ("n.y", None, "number"), ("l.0.p", "l.0", "number"), ("l.1.p", "l.1", "number"), ("l.2.p", "l.2", "number")}
    assert {(r.path, r.n_siblings) for r in trees.siblings(leaves, "k").collect()} == {("n.x", 2), ("n.y", 2), ("l.0.p", 1), ("l.1.p", 1), ("l.2.p", 1)}
    assert trees.cascades(leaves, "k", F.col("pos")).first().paths == ["n.x", "n.y"] and trees.cascades(leaves, "k", -F.col("pos")).first().paths == ["l.2.p"]
    names = spark.createDataFrame([('{"name": "f"}',), ('[{"name": "f"}, {"x": 1}, {"name": "g"}]',), ("no",)], "j string").select(trees.tool_names(F.col("j")).alias("v")).collect()
    assert [r.v for r in names] == [["f"], ["f", "g"], []]


def test_content_strings(spark):
    d = spark.createDataFrame([(1, json.dumps({"a": "word", "b": "12.5%", "c": "2024-01-02T1", "d": " ", "e": 5, "f": "1,200", "g": ["bare", {"h": "3 apples"}], "i": "-77.03", "j": "1/2/24 late"}))], "k int, j string")
    assert [r.value for r in trees.content_strings(json_tree.leaves(d, "k", "j")).orderBy("pos").collect()] == ["word", "1,200", "3 apples"]


@pytest.mark.parametrize(
    "answer, want",
    [
        ("It is 5.\n\nWould you like me to go on?", "It is 5."),
        ("It is 5. Feel free to ask! Can I help with anything else?", "It is 5."),
        ("It is 5.\n\n- If you want, I can add more.\n\n* Please let me know if so.", "It is 5."),
        ("Would you like tea?", "Would you like tea?"),
        ("Feel free to ask!", ""),
        ("It is 5. Is it?", "It is 5. Is it?"),
        ("", ""),
        ("Let me know if you need more. It is 5.", "Let me know if you need more. It is 5."),
    ],
)
def test_followups(spark, answer, want):
    assert cleanup.shortened(answer) == want
    got = one(spark, cleanup.without_followups(F.col("a")), a=answer)
    assert (got.cleaned, got.changed) == (want, len(want) < len(answer.rstrip()))


def test_asking_back(spark):
    cases = {"Is it?": True, "x" * 500 + "? " + "y" * 500: False, "I can also help.": True, "  ": False, "It is 5.": False, "You may also check it": True}
    d = spark.createDataFrame([(k,) for k in cases], "k string")
    assert {r.k: r.v for r in d.select("k", cleanup.asks_back(F.col("k")).alias("v")).collect()} == cases


def test_sentence_spans(spark):
    got = one(spark, text.sentence_spans(F.col("a")), a="One. Two!  Three? 3.5 four")
    assert [tuple(x) for x in got] == [(0, 4), (4, 9), (9, 17), (17, 26)]


@pytest.mark.parametrize("holes, least, want", [(0, 1, [(0, 2, 2), (3, 4, 1), (6, 7, 1)]), (1, 1, [(0, 4, 4), (6, 7, 1)]), (2, 3, [(0, 7, 7)]), (1, 5, [])])
def test_token_runs_count_their_holes(spark, holes, least, want):
    d = spark.createDataFrame([("a", i, x, float(i)) for i, x in enumerate([True, True, False, True, False, False, True, False])], "k string, i int, f boolean, s double")
    got = spans.token_runs(d, "k", "i", "f", "s", holes, least).collect()
    assert sorted((r.start, r.end, r.n) for r in got) == want
    assert all(r.mean_score == pytest.approx((r.start + r.end - 1) / 2) for r in got)


def test_merging_near_spans(spark):
    given = [(10, 12, 0.5), (0, 3, 0.9), (5, 6, 0.7), (20, 21, 0.1)]
    got = spark.createDataFrame([(given,)], "s array<struct<start:int,end:int,probability:double>>").select(spans.merge_near(F.col("s")).alias("v")).first().v
    assert [(x.start, x.end, round(x.probability, 6)) for x in got] == [(0, 6, 0.8), (10, 12, 0.5), (20, 21, 0.1)]


def test_rows_of_dialogues(spark):
    m = "array<struct<role:string,content:string>>"
    said = [("system", "s"), ("user", "q0"), ("assistant", "a0"), ("user", "q1"), ("assistant", "call"), ("tool", "r"), ("assistant", "a1")]
    d = spark.createDataFrame([(said,), ([("user", "q")],), ([("tool", "r"), ("assistant", "a")],)], f"m {m}")
    got = [r.v for r in d.select(rows.conversation_sample(F.col("m"), 1).alias("v")).collect()]
    assert (got[0].query, got[0].tool_call, got[0].tool_response, got[0].answer, len(got[0].full_history)) == ("q1", "call", "r", "a1", 2) and got[1:] == [None, None]
    turns = d.select(rows.marked_conversations(F.col("m")).alias("c"))
    assert [r.v for r in turns.select(rows.final_answer(F.col("c")).alias("v")).collect()] == ["a1", None, "a"]
    assert [r.v and (r.v.question, r.v.tool_values, r.v.answer) for r in turns.select(rows.exported_turn(F.col("c")).alias("v")).collect()] == [("q1", ["r"], "a1"), None, ("", ["r"], "a")]
    whole = d.limit(1).select(rows.full_dialogue(F.lit("sys"), F.slice("m", 2, 2), F.lit("q1"), F.lit("c"), F.lit("r"), F.lit("a")).alias("v")).first().v
    assert [x.role for x in whole] == ["system", "user", "assistant", "user", "assistant", "tool", "assistant"]
    flat = spark.createDataFrame([("1", "u", "c", "r", "", "old"), ("2", "", "c", "r", "a", None)], "id string, user_prompt string, tool_call string, tool_response string, original_answer string, answer string")
    assert [(r.sample_id, r.answer) for r in rows.flat_samples(flat).collect()] == [("1", "old")]


def test_reconciled_and_placed(spark):
    kind = "array<struct<start:int,end:int,text:string>>"
    d = spark.createDataFrame([([(0, 5, "co-op")],), ([(0, 5, "coxop")],), ([(9, 14, "shop.")],), ([(6, 10, "shop"), (1, 2, "?!")],)], f"s {kind}")
    got = [r.v for r in d.select(rows.reconciled(F.lit("co‑op shop."), F.col("s")).alias("v")).collect()]
    assert [(x.codes, x.broken) for x in got] == [(["PUNCT_DRIFT"], False), (["BROKEN"], True), (["REANCHORED"], False), (["OK", "BROKEN"], True)]
    assert got[0].spans[0].text == "co‑op" and tuple(got[2].spans[0]) == (6, 11, "shop.")
    words = spark.createDataFrame([(["one", "two"],), (["o"],), ([],)], "w array<string>").select(rows.placed_once(F.lit("one two"), F.col("w")).alias("v")).collect()
    assert [r.v and [tuple(x) for x in r.v] for r in words] == [[(0, 3, "one"), (4, 7, "two")], None, None]


def test_spans_apart_lines_and_words(spark):
    d = spark.createDataFrame([([(0, 4), (3, 6), (4, 8), (9, 9)],)], "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in d.select(examples.apart(F.col("s")).alias("v")).first().v] == [(0, 4), (4, 8), (9, 9)]
    answer = F.lit("one\ntwo three\nfour")
    assert tuple(one(spark, examples.whole_lines(answer, F.lit(5), F.lit(9)))) == (4, 13)
    assert tuple(one(spark, examples.whole_words(answer, F.lit(9), F.lit(10)))) == (8, 13)
    assert tuple(one(spark, examples.located(F.lit("it costs €1,234,567 now"), F.lit("1234567")))) == (10, 19, "1,234,567")
    assert one(spark, examples.located(answer, F.lit("five"))) is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "gold string, flagged boolean, n_pred int, n_gold int, matched int, unlocatable int, preds array<string>, failed boolean, char_f1 double, token_f1 double, exact boolean")
    assert {r.support for r in metrics.detection_report(empty).collect()} == {0}
    assert scoring.class_summary(empty).first().macro_f1 is None
    assert scoring.table_row(empty).count() == 1 and scoring.shown_table(scoring.table_row(empty)).first()["Type Acc."] == "—"
    assert scoring.span_scopes(empty).count() <= 1


def test_streamed_batches_are_written_once(spark, tmp_path):
    from spanloom.streaming import live

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    stream = lambda: spark.readStream.schema("k long").json(str(tmp_path / "in"))
    for _ in range(2):
        live.append_scored(stream(), lambda d: d.withColumn("s", F.col("k") * 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    # A batch whose commit is lost is written again to its own folder.
    (tmp_path / "check" / "commits" / "0").unlink()
    for crc in (tmp_path / "check" / "commits").glob(".0.crc"):
        crc.unlink()
    live.append_scored(stream(), lambda d: d.withColumn("s", F.col("k") * 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.s for r in spark.read.json(str(tmp_path / "out")).collect()) == [2, 4]


def test_tools_and_fixes(spark):
    from spanloom.operators import tools

    calls = {"[GetWeather(city='P', days=2)]": ("GetWeather", ["city", "days"]), '{"name": " f ", "arguments": {}}': ("f", []), '{"name": "g", "arg': ("g", []), "": ("", [])}
    d = spark.createDataFrame([(c,) for c in calls], "c string").select("c", tools.used_tool(F.col("c")).alias("n"), tools.call_parameters(F.col("c")).alias("p"))
    assert {r.c: (r.n, r.p) for r in d.collect()} == calls
    many = json.dumps([{"name": f"t{i}"} for i in range(20)])
    got = one(spark, tools.offered_tools(F.col("s"), F.lit("t3()"), most=8), s=many)
    assert len(got) == 8 and '{"name":"t3"}' not in got
    assert one(spark, tools.defined_tools(F.col("s")), s="no list [1, 2]") == []
    shown = one(spark, tools.few_shot_messages(F.lit("s"), [("q1", "a1")], F.lit("q")))
    assert [tuple(x) for x in shown] == [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "q")]
    assert one(spark, tools.coverage_fields(F.col("a")), a='["x", "y"]') == ["x", "y"] and one(spark, tools.coverage_fields(F.col("a")), a="oops") == []
    kind = "array<struct<start:int,end:int,text:string>>"
    rows_ = spark.createDataFrame([("clean", []), ("clean", [(0, 1, "i")]), ("overgeneration", []), ("overgeneration", [(0, 4, "it’s")]), ("overgeneration", [(9, 12, "x")])], f"k string, s {kind}")
    assert [r.v for r in rows_.select(tools.example_reason(F.col("k"), F.lit("it's so"), F.col("s")).alias("v")).collect()] == [None, "SPANS_NOT_ALLOWED", "SPANS_MISSING", None, "OUTSIDE"]
