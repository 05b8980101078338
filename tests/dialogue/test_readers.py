"""Readers of files as they are found in the wild."""

from pyspark.sql import functions as F

from spanloom.sources import readers


def test_json_of_any_layout(spark, tmp_path):
    texts = {"lines": '\n{"a": 1}\n{"a": 2}\n', "array": ' [\n {"a": 1},\n {"a": 2}]', "object": '{\n "a": 1\n}', "flat_array": '[{"a": 1}, {"a": 2}]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    schema = readers.T.StructType([readers.T.StructField("a", readers.T.LongType())])
    got = {name: sorted(r.a for r in readers.load_any_json(spark, str(tmp_path / name), schema).collect()) for name in texts}
    assert got == {"lines": [1, 2], "array": [1, 2], "object": [1], "flat_array": [1, 2]}


def test_merged_folder_and_splits(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "split": "dev"}\n\n{"a": 2}\n')
    (tmp_path / "y.jsonl").write_text('{"a": 3, "split": "test"}\n')
    (tmp_path / "z.json").write_text('{"a": 4}')
    schema = readers.T.StructType([readers.T.StructField("a", readers.T.LongType()), readers.T.StructField("split", readers.T.StringType())])
    d = readers.merge_folder(spark, str(tmp_path), schema)
    assert sorted((r.a, r.file) for r in d.where("a is not null").collect()) == [(1, "x.jsonl"), (2, "x.jsonl"), (3, "y.jsonl")]
    assert [r.a for r in readers.split_if_any(d, "test").collect()] == [3]
    assert readers.split_if_any(d.drop("split"), "test").count() == d.count()


def test_literal_cells(spark):
    cells = ["[{'a': None, 'b': True}]", '{"x": 1.50}', "plain", " ", None, "(1, 2)"]
    d = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r.c for r in readers.literal_cells(d, "c").collect()] == ['[{"a": null, "b": true}]', '{"x": 1.50}', "plain", None, None, "[1, 2]"]


def test_samples_of_both_layouts(spark):
    turns = "array<struct<from:string,value:string>>"
    talk = [("User", "q"), ("assistant", "call"), ("tool", "r"), ("assistant", "a")]
    d = spark.createDataFrame([("1", talk), ("2", talk[:1])], f"id string, conversations {turns}")
    assert [(r.sample_id, r.query, r.tool_call, r.tool_response, r.answer) for r in readers.load_samples(d).collect()] == [("1", "q", "call", "r", "a")]
    flat = spark.createDataFrame([("7", "q", "c", "r", "a")], "id string, user_query string, tool_call string, tool_response string, answer string")
    assert [(r.sample_id, r.query, r.answer) for r in readers.load_samples(flat).collect()] == [("7", "q", "a")]
    assert readers.load_samples(flat.where(F.lit(False))).count() == 0
