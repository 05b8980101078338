"""Label builders on worked rows."""

from pyspark.sql import functions as F
from spanloom.operators import editing, labels

BEFORE = '{"city":"Rome","n":1234,"q":"same","m":5,"long":"x"}'
EVALUATED = "array<struct<meta:string,label_type:string,implicit_true:boolean,due_to_null:boolean>>"
MARKED = "array<struct<tag:string,path:string,original_value:string,label_type:string>>"


def _places(row):
    return [(s["text"], s["label_type"], s["implicit_true"]) for s in row["labels"]]


def _mismatch(spark, rows):
    d = spark.createDataFrame(rows, f"w string, a string, h string, e {EVALUATED}").withColumns({"r": F.lit(BEFORE), "t": F.lit(None).cast("string"), "q": F.lit("How much is 70?")})
    return {r["w"]: r for r in labels.mismatch_labels(d, "a", "r", "h", "t", "e", "q").collect()}


def test_mismatch_labels(spark):
    changed = '{"city":"Oslo","n":99,"q":"same","m":5,"long":"x"}'
    note = lambda old, new=None: f"NOTE\nOriginal: {old}" + ("" if new is None else f"\nGenerated: {new}")
    one = lambda meta, implicit=False: (meta, "Evident Conflict", implicit, False)
    long = "It rose from 70 to 81.5 and then to 903 within a short time, as all could see."
    rows = [
        ("all places", "Rome, 1,234. rome; Romes", changed, [one(note("Rome", "Oslo")), one(note("1234", "99"))]),
        ("same but for case", "Nothing", changed, [one(note("Rome", "ROME"))]),
        ("no new value, kept", "Nothing of it", changed, [one(note("same"))]),
        ("kept elsewhere", "same time, other same", '{"city":"Oslo","n":99,"q":"same"}', [one(note("same", "x"))]),
        ("short in a word", "A5B and 5.", changed, [one(note("5", "6"))]),
        ("prose", long, changed, [one(note(long, "Other words"))]),
        ("implicit only", "At Rome", changed, [one(note("Rome", "Oslo"), True)]),
    ]
    got = {k: _places(v) for k, v in _mismatch(spark, rows).items()}
    clash = editing.CONFLICT
    assert got["all places"] == [("Rome", clash, False), ("1,234", clash, False), ("rome", clash, False), ("Rome", clash, False)]
    assert got["same but for case"] == [("Nothing", clash, True)] and got["no new value, kept"] == [("Nothing of it", clash, True)]
    assert got["kept elsewhere"] == [("same", clash, False)]
    assert got["short in a word"] == [("A5B and 5.", clash, True)]  # the first 5 is part of a word
    assert got["prose"] == [("81.5", clash, False), ("903", clash, False)]  # 70 was asked for
    assert got["implicit only"] == [("Rome", clash, False)]  # from the spans of the edit itself


def test_deletion_labels(spark):
    response = '{"x":{"city":"Rome","n":45000,"d":"long description"},"q":"same"}'
    item = "- **Invented thing** costs a great deal of money"
    rows = [
        ("places", f"In Rome it cost $45,000.\n\n{item}\n- **same** thing, which is long enough\n\nromes", '{"x":{"d":"long description"},"q":"same"}', [("city", "x.city", "Rome", "Baseless Info")], ["x.city", "x.n"]),
        ("neighbour lost", "In Rome all is well.\n\nMore", '{"x":{},"q":"same"}', [("city", "x.city", "Rome", "Baseless Info")], ["x.city", "x.d"]),
        ("still there", "It is same", '{"q":"same"}', [("q", "q", "same", "Baseless Info")], []),
        ("detected", "It cost 45,000", '{"q":"same"}', [], ["x.n"]),
    ]
    d = spark.createDataFrame([(w, a, response, h, m, g) for w, a, h, m, g in rows], f"w string, a string, r string, h string, m {MARKED}, g array<string>")
    got = {r["w"]: _places(r) for r in labels.deletion_labels(d, "a", "r", "h", "a", "m", "g").collect()}
    none = "Baseless Info"
    assert got["places"] == [("Rome", none, False), ("$45,000", none, False), (item, none, False), ("rome", none, False)]
    assert got["neighbour lost"] == [("Rome all is well.", none, False)]
    assert got["still there"] == [] and got["detected"] == [("45,000", editing.BASELESS, False)]


def test_dialogue_rows(spark):
    tool = '{"city":"Oslo","n":"Rome"}'
    rows = [
        ("words", "type1_smart", ["a"], [("user", "Q"), ("tool", tool), ("assistant", "In <hall>Par</hall>is and paris, not <hall>Rome</hall>")]),
        ("kept", "type1", ["a"], [("user", "Q"), ("tool", tool), ("assistant", "In <hall>Rome</hall>")]),
        ("numbers", "type2", ["total.cost"], [("user", "Q"), ("tool", '{"n":12}'), ("assistant", "<hall>The cost is ¥50,000 and 12.</hall>")]),
        ("line", "type2", ["x.ratingOf"], [("user", "Q"), ("tool", '{"n":12}'), ("assistant", "<hall>Well.\nThe rating was excellent.\nBye</hall>")]),
        ("unnamed", "type2", ["x.weather"], [("user", "Q"), ("tool", '{"n":12}'), ("assistant", "<hall>The rating was 5000.</hall>")]),
        ("moved", "type2", ["x"], [("user", "Q"), ("tool", "Hotel Excelsior is open"), ("assistant", "<hall>Hotel Excelsior</hall> and Hotel Excelsior")]),
        ("short word", "type2", ["x"], [("user", "Q"), ("tool", "all open"), ("assistant", "<hall>open</hall> and <hall>live</hall>, deliver live")]),
        ("comment", "type3_tool", None, [("user", "Q"), ("tool", tool), ("assistant", "Done. <hall>I can fly.</hall>")]),
        ("none", "type1", None, [("user", "Q")]),
        ("first answer", "type3", None, [("user", "Q"), ("assistant", "<hall>A</hall>"), ("user", "R"), ("assistant", "B")]),
    ]
    d = spark.createDataFrame(rows, "w string, k string, t array<string>, m array<struct<role:string,content:string>>").withColumn("s", F.lit("sys"))
    got = {r["w"]: r for r in labels.dialogue_rows(d, "m", "k", "t", "s").collect()}
    texts = {w: [s["text"] for s in r["labels"]] for w, r in got.items()}
    assert texts["words"] == ["Paris", "paris"] and got["words"]["refused"] is None and got["words"]["query"] == "Q" and got["words"]["context"] == tool
    assert (texts["kept"], got["kept"]["refused"]) == ([], "no_labels")
    assert texts["numbers"] == ["¥50,000"] and texts["line"] == ["The rating was excellent."]
    assert (texts["unnamed"], got["unnamed"]["refused"]) == ([], "no_labels")
    assert [s["start"] for s in got["moved"]["labels"]] == [20]
    assert texts["short word"] == ["live", "live"]
    assert texts["comment"] == ["I can fly."] and got["comment"]["labels"][0]["label_type"] == "Overgeneration"
    assert got["none"]["refused"] == "no_answer"
    assert got["first answer"]["output"] == "A" and got["first answer"]["input_str"] == "System:\nsys\n\nUser:\nQ"


def test_blocks_and_numbers(spark):
    text = "Intro\n\n- **One** of a kind that nobody has ever seen\n2. **Two** of 1,500 and 77 that is long enough\n\nEnd"
    d = spark.createDataFrame([(text, ["kind"])], "t string, v array<string>")
    r = d.select(labels.blocks(F.col("t")).alias("b"), labels.fabricated_blocks(F.col("t"), F.col("v")).alias("f"), labels.unknown_numbers(F.col("t"), F.lit("has 1500 of")).alias("n"), labels.keywords(F.array(F.lit("results.hotelName_2.ratingOf"))).alias("k")).first()
    assert [text[b["start"] : b["end"]].split(" ")[0].strip() for b in r["b"]] == ["Intro", "-", "2.", "End"]
    assert [text[b["start"] : b["end"]][:10] for b in r["f"]] == ["2. **Two**"] and r["n"] == []
    assert r["k"] == ["results", "hotel", "name", "rating"]


def test_flat_examples_under_any_names(spark):
    from spanloom.operators import rows

    d = spark.createDataFrame([(1, None, "p", ['{"a":1}', "x"], "r", 1), (2, "q", "p", None, None, None)], "example_id int, question string, prompt string, contexts array<string>, response string, label int")
    one, two = rows.flat_examples(d).orderBy("dialogue_id").collect()
    assert (one["query"], one["contexts"], one["context"], one["output"], one["gold_label"], one["gold_spans"], one["gold_type"]) == ("p", ["a: 1", "x"], "a: 1\n\nx", "r", 1, [], None)
    assert (two["query"], two["contexts"], two["context"], two["output"], two["row_split"]) == ("q", [], "", "", None)
    e = spark.createDataFrame([('[{"b":1,"a":2},"t"]',), ('{"b":1}',), ("plain",), ("",), (None,)], "tool_response string")
    assert [r["contexts"] for r in rows.flat_examples(e).collect()] == [["b: 1\na: 2", "t"], ["b: 1"], ["plain"], [], []]
