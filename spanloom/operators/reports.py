"""Reports over class-aware predictions: multi-label classes, collapsed and overlap-based labels, composite scores, ordering of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.metrics import CLASSES, prf


def class_metrics(rows: DataFrame, gold: str = "gold", preds: str = "preds") -> DataFrame:
    """One against the rest for each class, where a row may be given several: label, tp, fp, fn, support and rates.

    Null predictions (unparseable) count as none, so their rows stay in the denominators. One pass, no shuffle but of the counts.
    """
    has = lambda c: F.coalesce(F.array_contains(preds, c), F.lit(False))
    is_gold = lambda c: F.coalesce(F.col(gold) == c, F.lit(False))
    counts = [F.struct(F.lit(c).alias("label"), F.count_if(is_gold(c) & has(c)).alias("tp"), F.count_if(~is_gold(c) & has(c)).alias("fp"), F.count_if(is_gold(c) & ~has(c)).alias("fn"), F.count_if(is_gold(c)).alias("support")) for c in CLASSES]
    return prf(rows.agg(F.array(*counts).alias("c")).select(F.inline("c")))


def detection_label(gold: Column, flagged: Column) -> Column:
    """The label as mere detection gives it: the row's own class if any span is predicted, else clean."""
    return F.when(flagged, gold).otherwise("clean")


def overlap_label(gold: Column, n_pred: Column, n_gold: Column, overlaps: Column) -> Column:
    """The label as located spans give it: the row's own class if a predicted span overlaps a gold one, or if there are neither, else clean."""
    return F.when(((n_pred == 0) & (n_gold == 0)) | overlaps, gold).otherwise("clean")


def composite_score(rows: DataFrame, gold: str, flagged: str, key: str | None = None) -> DataFrame:
    """rows(gold and flagged booleans, matched, n_pred, n_gold) -> positive, negative and span F1, their means, share of flagged rows; for each key and for all ('ALL')."""
    g, f = F.col(gold), F.col(flagged)
    aggs = [
        F.count("*").alias("n"),
        *[F.count_if(c).alias(k) for k, c in {"tp": g & f, "fp": ~g & f, "fn": g & ~f, "tn": ~g & ~f}.items()],
        *[F.sum(c).alias(c) for c in ("matched", "n_pred", "n_gold")],
    ]
    d = rows.rollup(key).agg(F.grouping(key).alias("all_rows"), *aggs) if key else rows.agg(*aggs)
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    d = d.withColumns({"f1_positive": rate(2 * tp, 2 * tp + fp + fn), "f1_negative": rate(2 * tn, 2 * tn + fp + fn), "span_f1": rate(2 * F.col("matched"), F.col("n_pred") + F.col("n_gold")), "flag_rate": rate(tp + fp, F.col("n"))})
    d = d.withColumn("type_macro_f1", (F.col("f1_positive") + F.col("f1_negative")) / 2).withColumn("score", (F.col("type_macro_f1") + F.col("span_f1")) / 2)
    names = ["n", "f1_positive", "f1_negative", "span_f1", "flag_rate", "type_macro_f1", "score"]
    return d.select(F.when(F.col("all_rows") == 1, "ALL").otherwise(F.col(key)).alias(key), *names) if key else d.select(*names)


def top_predictions(rows: DataFrame, gold: str, pred: str, k: int = 4) -> DataFrame:
    """gold, pred, n, place: the k commonest predictions of each gold class, ties by name. The window runs over counts of label pairs only."""
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("gold").orderBy(F.desc("n"), "pred"))).where(F.col("place") <= k)


def judge_summary(rows: DataFrame, stored: str, judged: str) -> DataFrame:
    """stored, judged, n, agree: counts of verdicts against stored classes; a missing verdict is 'missing'."""
    v = F.coalesce(judged, F.lit("missing"))
    return rows.groupBy(F.col(stored).alias("stored"), v.alias("judged")).agg(F.count("*").alias("n")).withColumn("agree", F.coalesce(F.col("stored") == F.col("judged"), F.lit(False)))


def aligned(left: DataFrame, right: DataFrame, index: str, guard: str) -> DataFrame:
    """Rows of both sides with one index, and matched: whether the guard is equal too. Others are left out, as in a guarded positional join."""
    r = right.withColumnRenamed(guard, "other_guard")
    return left.join(r, index).withColumn("matched", F.col(guard).eqNullSafe(F.col("other_guard"))).drop("other_guard")


def by_metric(table: DataFrame, metric: str) -> DataFrame:
    """Greatest first; values that are no numbers last."""
    return table.orderBy(F.expr(f"try_cast(`{metric}` as double)").desc_nulls_last())
