"""Detection metrics as single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.scratch import written

CLASSES = ("clean", "answer_mismatch", "overgeneration", "missing_tool", "undergeneration")
DEFECTS, SPAN_CLASSES = CLASSES[1:], CLASSES[1:4]
#: Spellings of the classes.
ALIASES = {
    "correct": "clean", "clean": "clean", "ok": "clean", "none": "clean", "no_hallucination": "clean",
    "answer_mismatch": "answer_mismatch", "answer_missmatch": "answer_mismatch", "mismatch": "answer_mismatch", "contradiction": "answer_mismatch", "am": "answer_mismatch",
    "overgeneration": "overgeneration", "overgen": "overgeneration", "og": "overgeneration",
    "missing_tool": "missing_tool", "missing tool": "missing_tool", "mt": "missing_tool",
    "undergeneration": "undergeneration", "undergen": "undergeneration", "ug": "undergeneration",
}


def normalize_type(c: Column) -> Column:
    """Trimmed, lower case, hyphens as underscores, the hops' prefixes cut off one after the other, known spellings mapped; others stay. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c.cast("string"))), "-", "_"), "^singlehop_", ""), "^multihop_", "")
    pairs = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, plain), plain)


def prf(d: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds precision, recall and f1; 0 where a denominator is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return d.withColumns({"precision": share(t, t + p), "recall": share(t, t + n), "f1": share(2 * t, 2 * t + p + n)})


def detection_report(rows: DataFrame, gold: str = "gold", flagged: str = "flagged", undergeneration: str = "exclude") -> DataFrame:
    """class, tp, fp, fn, support, precision, recall, f1, flag_rate: for each defect, detection on its rows and the clean ones; for clean, of rows not flagged; and ALL, detection over all rows.

    Clean never counts undergeneration rows. Policies for undergeneration: exclude and positive leave its class without rates, with
    the share of its rows that are flagged; score makes it a class like the others. ALL leaves its rows out only under exclude.
    One pass over the rows; the rest is arithmetic on ten counts.
    """
    if undergeneration not in ("exclude", "positive", "score"):
        raise ValueError(f"unknown policy {undergeneration}")
    one = rows.agg(*[F.count_if((F.col(gold) == c) & (F.col(flagged) == yes)).alias(f"{c}_{yes}") for c in CLASSES for yes in (True, False)])
    yes, no = ({c: F.col(f"{c}_{side}") for c in CLASSES} for side in (True, False))
    total = lambda side, names: sum((side[c] for c in names), F.lit(0))
    pool = SPAN_CLASSES if undergeneration == "exclude" else DEFECTS

    def line(name: str, tp: Column | None, fp: Column | None, fn: Column | None, support: Column, rate: Column) -> Column:
        none = F.lit(None).cast("bigint")
        return F.struct(F.lit(name).alias("class"), *[(none if x is None else x).alias(k) for k, x in (("tp", tp), ("fp", fp), ("fn", fn))], support.alias("support"), rate.alias("flag_rate"))

    share = lambda c: F.try_divide(yes[c].cast("double"), yes[c] + no[c])
    lines = [line("clean", no["clean"], total(no, SPAN_CLASSES), yes["clean"], yes["clean"] + no["clean"], share("clean"))]
    for c in DEFECTS:
        scored = c != "undergeneration" or undergeneration == "score"
        lines.append(line(c, *((yes[c], yes["clean"], no[c]) if scored else (None, None, None)), yes[c] + no[c], share(c)))
    everything = total(yes, ("clean", *pool)) + total(no, ("clean", *pool))
    lines.append(line("ALL", total(yes, pool), yes["clean"], total(no, pool), total(yes, pool) + total(no, pool), F.try_divide(total(yes, ("clean", *pool)).cast("double"), everything)))
    out = prf(one.select(F.inline(F.array(*lines))))
    return out.select("class", "tp", "fp", "fn", "support", *[F.when(F.col("tp").isNotNull(), F.col(k)).alias(k) for k in ("precision", "recall", "f1")], "flag_rate")


def macro_detection(report: DataFrame) -> DataFrame:
    """mean_f1 over clean and the classes with spans that have rows."""
    return report.where(F.col("class").isin("clean", *SPAN_CLASSES) & (F.col("support") > 0)).agg(F.avg("f1").alias("mean_f1"))


def binary_report(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn, n, accuracy and the rest, of two boolean columns, in one row."""
    g, p = F.col(gold), F.col(pred)
    d = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return prf(d.withColumn("n", n).withColumn("accuracy", F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), n), F.lit(0.0))))


def classification_report(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row for each label seen: label, tp, fp, fn, support and rates. The counts are aggregated before they are dealt by label."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.when(F.col("g").eqNullSafe(F.col("p")), F.array(F.struct(F.col("g").alias("label"), F.lit("tp").alias("k")))).otherwise(F.array(F.struct(F.col("g").alias("label"), F.lit("fn").alias("k")), F.struct(F.col("p").alias("label"), F.lit("fp").alias("k"))))
    long = cells.select("n", F.explode(sides).alias("s")).select("n", "s.label", "s.k")
    out = long.groupBy("label").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    return prf(out.withColumn("support", F.col("tp") + F.col("fn")))


def confusion(rows: DataFrame, gold: str, pred: str, labels: tuple[str, ...] = CLASSES) -> DataFrame:
    """Dense matrix in long form, unknown labels as other: gold, pred, n."""
    known = lambda c: F.when(F.col(c).isin(*labels), F.col(c)).otherwise("other")
    spark = rows.sparkSession
    frame = spark.createDataFrame([(g, p) for g in (*labels, "other") for p in (*labels, "other")], "gold string, pred string")
    counts = rows.groupBy(known(gold).alias("gold"), known(pred).alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(frame).join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def macro(report: DataFrame) -> DataFrame:
    """Means over labels with support, means weighted by it, and accuracy."""
    w = F.sum("support")
    return report.where("support > 0").agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / w).alias("weighted_f1"), (F.sum("tp") / w).alias("accuracy"))


def span_report(rows: DataFrame, key: str = "gold") -> DataFrame:
    """rows(gold, n_pred, n_gold, matched, unlocatable, char_f1, token_f1, exact) -> one row for each class and one for all ('ALL')."""
    aggs = [
        F.sum("matched").alias("tp"),
        (F.sum("n_pred") - F.sum("matched") + F.sum("unlocatable")).alias("fp"),
        (F.sum("n_gold") - F.sum("matched")).alias("fn"),
        F.avg("char_f1").alias("mean_char_f1"),
        F.avg("token_f1").alias("mean_token_f1"),
        F.avg(F.col("exact").cast("double")).alias("exact_rate"),
        F.count("*").alias("n"),
    ]
    out = rows.rollup(key).agg(F.grouping(key).alias("all_rows"), *aggs)
    return prf(out.withColumn(key, F.when(F.col("all_rows") == 1, "ALL").otherwise(F.col(key))).drop("all_rows"))


def faithfulness(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """rows(labels array) -> mean, least and greatest share of supported sentences, rows that are all or less than half supported, totals."""
    share = F.try_divide(F.size(F.filter(labels, lambda x: x == "supported")).cast("double"), F.size(labels))
    d = rows.select(share.alias("s"), F.col(labels).alias("l"))
    total = lambda k: F.sum(F.size(F.filter("l", lambda x: x == k))).alias(k)
    return d.agg(F.avg("s").alias("mean_score"), F.min("s").alias("least"), F.max("s").alias("greatest"), F.count_if(F.col("s") == 1).alias("all_supported"), F.count_if(F.col("s") < 0.5).alias("below_half"), total("supported"), total("unsupported"), total("contradicted"))


def chance_level(rows: DataFrame, gold: str = "gold", steps: int = 1000) -> DataFrame:
    """Best expected mean F1 of a detector that flags a share q of all rows whatever they hold, and that q; over steps + 1 rates."""
    counts = rows.groupBy().agg(*[F.count_if(F.col(gold) == c).alias(c) for c in CLASSES])
    q = F.col("q")
    grid = counts.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("q", q / steps)
    clean, bad = F.col("clean"), [F.col(c) for c in CLASSES if c not in ("clean", "undergeneration")]
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    right = div(2 * (1 - q) * clean, (1 - q) * clean + (1 - q) * (clean + sum(bad)) + q * clean)
    each = [div(2 * q * c, 2 * q * c + q * clean + (1 - q) * c) for c in bad]
    return grid.withColumn("mean_f1", (right + sum(each)) / (1 + len(each))).agg(F.max("mean_f1").alias("mean_f1"), F.min_by("q", F.struct((-F.col("mean_f1")).alias("m"), q)).alias("flag_rate"))


def length_statistics(rows: DataFrame, value: str) -> DataFrame:
    """n, greatest, mean, and the value at place int(0.95 n) of the sorted ones, exactly.

    From counts of distinct values, dealt by ranges and written once (see flows.rank_by): counts of ranges tell the one that holds the
    place, and only that one is summed up.
    """
    from pyspark.sql import Window as W

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = written(counts.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "lengths")
    parts = parted.groupBy("part").agg(F.sum("c").alias("in_part"))  # one row a partition
    before = parts.select("part", (F.sum("in_part").over(W.orderBy("part")) - F.col("in_part")).alias("before"), F.sum("in_part").over(W.partitionBy()).alias("n"))
    d = parted.join(F.broadcast(before), "part").withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("part").orderBy("v")))
    return d.agg(F.max("n").alias("n"), F.max("v").alias("greatest"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.95), F.col("v"))).alias("p95"))
