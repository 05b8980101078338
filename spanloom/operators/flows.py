"""Keyed flows: verdict filters, gold look-up, resuming, splits, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.scratch import written


def last_of(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest order for each key; a map-side combined aggregate, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def filter_by_verdict(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], order: str, keep_uncertain: bool = False, keep_missing: bool = False) -> DataFrame:
    """rows with outcome (pass, fail, uncertain, missing) of the last verdict line, and keep."""
    last = last_of(verdicts, keys, order).select(*keys, "verdict")
    joined = rows.join(last, list(keys), "left").withColumn("outcome", F.coalesce("verdict", F.lit("missing"))).drop("verdict")
    keep = (F.col("outcome") == "pass") | (F.lit(keep_uncertain) & (F.col("outcome") == "uncertain")) | (F.lit(keep_missing) & (F.col("outcome") == "missing"))
    return joined.withColumn("keep", keep)


def look_up_gold(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """pred(uid, row_index, dialogue_id, type, ...) + how and gold_row: by uid, by place guarded by dialogue_id, by a unique dialogue_id, by a unique (dialogue_id, type)."""
    value = F.struct("uid", "row_index", "dialogue_id", "type")
    by_uid = gold.where("uid is not null").groupBy("uid").agg(F.min(value).alias("g1"))
    by_place = gold.groupBy("row_index", "dialogue_id").agg(F.min(value).alias("g2"))
    single = lambda keys, name: gold.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(name)).where("n = 1").drop("n")
    d = pred.join(by_uid, "uid", "left").join(by_place, ["row_index", "dialogue_id"], "left")
    d = d.join(single(["dialogue_id"], "g3"), "dialogue_id", "left").join(single(["dialogue_id", "type"], "g4"), ["dialogue_id", "type"], "left")
    how = F.when(F.col("g1").isNotNull(), "uid").when(F.col("g2").isNotNull(), "place").when(F.col("g3").isNotNull(), "dialogue").when(F.col("g4").isNotNull(), "type")
    return d.withColumn("how", how).withColumn("gold_row", F.coalesce("g1", "g2", "g3", "g4")["row_index"]).drop("g1", "g2", "g3", "g4")


def not_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the done ones."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, with the union of the columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def group_split(rows: DataFrame, group: str, order: Column, test: float = 0.1, dev: float = 0.1) -> DataFrame:
    """Adds split: whole groups go to test, then dev, at least one group each, in the given order of groups.

    Ranks of groups come from counts over ranges of the order (see rank_by), so no task sorts all groups.
    """
    groups = rows.select(group).distinct().withColumn("order", order)
    ranked = rank_by(groups, ["order", group])
    n = groups.count()
    n_test, n_dev = max(1, int(n * test)), max(1, int(n * dev))
    split = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_dev, "dev").otherwise("train")
    return rows.join(ranked.select(group, split.alias("split")), group)


def rank_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rank, 1 to n in the order of the keys, which must be unique: rows are range-partitioned, counted by partition, and numbered inside.

    The bounds of the ranges are drawn from a sample, so two readers of one range-partitioned plan may see different ranges. The rows are
    therefore written once with the number of their range, and both the counts and the numbering read what was written.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = written(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each range
    before = counts.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))
    return parted.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*keys))).drop("_part", "_before")


def sample_per_class(rows: DataFrame, label: str, k: int, order: Column) -> DataFrame:
    """k rows of each class, the first in the given order: a top-k, so only k rows of a class and task are shuffled."""
    w = W.partitionBy(label).orderBy("order")
    return rows.withColumn("order", order).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn", "order")


def shard(rows: DataFrame, index: str, k: int, n: int, total: int) -> DataFrame:
    """The k-th of n contiguous shards by row index; the last takes the remainder."""
    size = total // n
    return rows.where((F.col(index) >= k * size) & ((F.col(index) < (k + 1) * size) if k < n - 1 else F.lit(True)))


def issue_counts(rows: DataFrame, codes: str) -> DataFrame:
    """code, n over an array column of codes."""
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
