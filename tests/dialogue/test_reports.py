"""Class-aware reports on small rows, against counts by hand."""

from spanloom.operators import reports


def test_several_classes_and_unparseable_rows(spark):
    rows = spark.createDataFrame([("clean", ["clean"]), ("overgeneration", ["overgeneration", "missing_tool"]), ("missing_tool", None), (None, ["clean"])], "gold string, preds array<string>")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["support"]) for r in reports.class_metrics(rows).collect()}
    assert got["clean"] == (1, 1, 0, 1)
    assert got["overgeneration"] == (1, 0, 0, 1)
    assert got["missing_tool"] == (0, 1, 1, 1)
    assert got["undergeneration"] == (0, 0, 0, 0)


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "gold string, preds array<string>, pred string")
    assert {r["support"] for r in reports.class_metrics(rows).collect()} == {0}
    assert reports.top_predictions(rows, "gold", "pred").count() == 0


def test_composite_score(spark):
    rows = spark.createDataFrame([(True, True, 1, 1, 1), (True, False, 0, 0, 1), (False, False, 0, 0, 0), (False, True, 0, 1, 0)], "bad boolean, flagged boolean, matched int, n_pred int, n_gold int")
    r = reports.composite_score(rows, "bad", "flagged").first()
    assert (r["f1_positive"], r["f1_negative"], r["span_f1"], r["score"]) == (0.5, 0.5, 0.5, 0.5)


def test_table_order_puts_text_last(spark):
    rows = spark.createDataFrame([("a", "3"), ("b", "-"), ("c", "10")], "k string, m string")
    assert [r["k"] for r in reports.by_metric(rows, "m").collect()] == ["c", "a", "b"]


def test_guarded_positions(spark):
    left, right = spark.createDataFrame([(0, "x"), (1, "y")], "i int, id string"), spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "i int, id string")
    assert {r["i"]: r["matched"] for r in reports.aligned(left, right, "i", "id").collect()} == {0: True, 1: False}
