"""Operator 6: mixing sources to target weights.

Each document gets a hash-random key. The keys are uniform, so equal ranges of keys hold about equally many documents: a source's
range is cut into as many parts as it needs for ROWS_A_PART rows each. Prefix sums of sizes run over the parts (a small table) and,
apart, over the rows of each part, so no task holds a source. The budget of a source is its target, rounded: all its documents are
taken as often as that holds the whole source, and once more those whose prefix lies below the rest; the document on the cut gives
its first words only, so the budget is met exactly.

Null texts have size 0 and are never taken. Null sources are one source, the last. Equal rows have equal keys; which of them comes
first makes no difference to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, save

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
ROWS_A_PART = 5000


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes(source, source_size, n_rows) -> the same and target. One row for each source.

    Targets proportional to weights, none above limit * source_size, the excess dealt anew by weight: with the sources in ascending
    order of limit * source_size / weight, those up to some place stay at their limit and the others share the rest by weight.
    """
    turn = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.lit(float(limit)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    up = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    ranked = ranked.withColumn("below", F.coalesce(F.sum("most").over(up), F.lit(0.0))).withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.col("below")) / F.col("left")  # a unit of weight's part if all below are at their limit
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    shared = F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(all_rows)["level"]
    return ranked.withColumn("shared", shared).select("source", "source_size", "n_rows", F.when(F.col("free"), F.col("weight") * F.col("shared")).otherwise(F.col("most")).alias("target"))


def plan_mix(documents: DataFrame, seed: int = 23, share: float = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """documents(doc_id, text, source, ...) -> doc_id, source, key, size, source_size, target, taken. One row for each document."""
    key = F.xxhash64("doc_id", "source", "text", F.lit(seed))
    sized = save(documents.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), n_words(F.col("text")).alias("size")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    budgets = save(targets(sums, share, limit, weights), "targets")
    parts = F.ceil(F.col("n_rows") / rows_a_part)
    placed = sized.join(budgets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("part", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * parts).cast("bigint"))
    totals = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = save(totals.select(F.col("source").alias("of"), F.col("part").alias("of_part"), before.alias("part_start")), "offsets")
    within = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("start", F.col("inside") + F.col("part_start"))
    budget = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return summed.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, n at least 1; used for the few documents on a cut."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mix(documents: DataFrame, seed: int = 23, **settings: object) -> DataFrame:
    """The mixed corpus with the columns of documents: each document as often as it is taken; one that is taken in part last, cut after its words.

    Rows that are equal in id, source and text share their part of the plan: all of them together are taken as planned for each.
    """
    p = "mix_"  # columns of its own, whatever the documents' are called
    while any(c.lower().startswith(p) for c in documents.columns):
        p = f"_{p}"
    plan = save(plan_mix(documents, seed, **settings).where("taken > 0").groupBy("doc_id", "source", "key", "size").agg(F.collect_list("taken").alias("takes")), "plan")
    plan = plan.toDF(*[p + c for c in ("id", "source", "key", "size", "takes")])
    col = lambda name: F.col(p + name)
    keyed = documents.withColumn(f"{p}own", F.xxhash64("doc_id", documents["source"].cast("string"), "text", F.lit(seed)))
    order = W.partitionBy(f"{p}own", "doc_id").orderBy(f"{p}own")
    several = plan.where(F.size(f"{p}takes") > 1)
    joined = keyed.join(plan, (col("own") == col("key")) & F.col("doc_id").eqNullSafe(col("id")))
    if several.isEmpty():
        joined = joined.withColumn(f"{p}n", F.element_at(f"{p}takes", 1))
    else:
        joined = joined.withColumn(f"{p}at", F.row_number().over(order)).withColumn(f"{p}n", F.coalesce(F.try_element_at(f"{p}takes", f"{p}at"), F.lit(0)))
    joined = joined.where(col("n") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.ceil(col("n") / col("size")).cast("int"))))
    words = col("n") - (col("copy") - 1) * col("size")
    text = F.when(words >= col("size"), F.col("text")).otherwise(first_words(F.col("text"), words))
    out = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
