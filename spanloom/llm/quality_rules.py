"""Operator 7: quality rules with risk-controlled thresholds, by DataFrame functions only.

A few measures of each whole text are compared with cutoffs. The cutoffs are chosen for each stratum (language) from labelled texts:
for each measure a fixed ladder of cutoffs is walked from the loosest to the strictest, and walking stops at the first cutoff at which
falsely rejecting more than `risk` of the good texts cannot be excluded. That is so if the chance of at most as many false rejections
as seen, had each good text that risk, is not below the level (the exact binomial, or Clopper-Pearson, bound). The level is divided by
the number of measures and strata (Bonferroni); along one ladder the order is fixed beforehand, so no further correction is due. The
risk of a measure is the total divided by the number of measures, so a good text of a stratum is falsely rejected by any of them at
most at the total risk, with the given confidence in all strata at once. A ladder without a certified cutoff rejects nothing.

The labelled texts are parted by a hash of the id: a quarter says which ladders are of use (they must reject bad texts more often than
good ones), the rest is the holdout on which the bounds are computed.

Null and empty texts have no words, so they fail the base rules. Null languages are a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACES, fold, save

RISK, CONFIDENCE = 0.06, 0.95
MIN_WORDS, MOST_REPEATED = 50, 50
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Cutoffs from loose to strict; a text is rejected if the measure is above the cutoff.
LADDERS = {
    "symbols_a_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05),
    "duplicate_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "repeated_words": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "upper_case": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "exclamations_a_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05),
    "odd_word_length": (20.0, 12.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0),
}


def measures(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, the further columns named, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ladders' measures; no shuffle.

    Words found in repeated 3-word windows: windows are hashed to 64 bits and sorted with their places; where neighbours are equal,
    both windows' words are marked. Only texts in which some window is repeated take that path.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = documents.select("doc_id", *more, text.alias("text")).withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w))).withColumn("lines", lines)
    n = F.size("hashes")
    d = d.withColumn("n_words", n.cast("bigint"))
    two = F.zip_with(F.slice("hashes", 1, F.greatest(n - 2, F.lit(0))), F.slice("hashes", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("hashes", 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    d = d.withColumn("windows", F.when(n > 2, three).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("any_repeat", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.when(F.col("any_repeat"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    d = d.withColumn("placed", placed)
    pairs = F.zip_with(F.slice("placed", 1, F.size("placed") - 1), F.slice("placed", 2, F.size("placed") - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    d = d.withColumn("at", F.when(F.col("any_repeat"), F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    marked = F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)))
    chars, total = F.length("text"), F.greatest(F.col("n_words"), F.lit(1))
    word_chars = F.length(F.translate("text", SPACE_CHARS, ""))
    return d.select(
        "doc_id",
        *more,
        "n_words",
        word_chars.cast("bigint").alias("word_chars"),
        (chars - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("any_repeat"), F.size(marked)).otherwise(0).cast("bigint").alias("n_repeat_words"),
        ((chars - F.length(F.translate("text", "!", ""))) / total).alias("exclamations_a_word"),
        ((chars - F.length(F.regexp_replace("text", r"\p{Lu}", ""))) / F.greatest(word_chars, F.lit(1))).alias("upper_case"),
        (F.size("lines")).alias("n_lines"),
    ).withColumns({
        "symbols_a_word": F.col("n_symbols") / total,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / total,
        "odd_word_length": F.abs(F.col("word_chars") / total - 5.0),
    })


def at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with n trials of chance p, by the terms' recurrence, scaled by logarithms; stable for any n."""
    first = n * F.log(F.lit(1 - p))
    odds = p / (1 - p)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, step, lambda acc: acc["total"]))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """measured(doc_id, stratum, ladders...) and labels(doc_id, quality) -> stratum and one column for each ladder: its cutoff, or null.

    One row for each stratum. Labelled texts are counted for each stratum, ladder and cutoff in one pass.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").dropDuplicates(["doc_id"])
    joined = measured.where("not base_failed").join(own, "doc_id").withColumn("holdout", fold("doc_id", 4) != 0)
    cuts = F.array(*[F.struct(F.lit(m).alias("ladder"), F.lit(i).alias("rung"), F.lit(c).alias("cutoff"), (F.col(m) > c).alias("hit")) for m, ladder in LADDERS.items() for i, c in enumerate(ladder)])
    good, bad, held = F.col("quality") == 1, F.col("quality") == 0, F.col("holdout")
    counted = joined.select("stratum", "quality", "holdout", F.inline(cuts)).groupBy("stratum", "ladder", "rung", "cutoff").agg(
        F.count_if(good & held).alias("n"),
        F.count_if(good & held & F.col("hit")).alias("k"),
        F.count_if(good & ~held).alias("n_good"),
        F.count_if(good & ~held & F.col("hit")).alias("k_good"),
        F.count_if(bad & ~held).alias("n_bad"),
        F.count_if(bad & ~held & F.col("hit")).alias("k_bad"),
    )
    counted = save(counted, "counts")
    strata = max(counted.select("stratum").distinct().count(), 1)
    level = (1 - confidence) / (len(LADDERS) * strata)
    allowed = risk / len(LADDERS)
    useful = F.col("k_bad") * F.col("n_good") > F.col("k_good") * F.col("n_bad")
    # The ladder is walked as long as the bound holds; counts beyond twice the allowed share can't pass and are not summed.
    holds = F.when(F.col("k") > F.col("n") * 2 * allowed + 1, F.lit(False)).otherwise(at_most(F.col("k"), F.col("n"), allowed) <= level)
    failed = F.min(F.when(~F.col("holds"), F.col("rung")))
    rungs = counted.withColumn("holds", holds)
    stops = rungs.groupBy("stratum", "ladder").agg(F.coalesce(failed, F.lit(1 << 20)).alias("stop"), F.max(useful).alias("useful"))
    best = rungs.join(stops, ["stratum", "ladder"]).where("rung < stop and useful").groupBy("stratum").pivot("ladder", list(LADDERS)).agg(F.min("cutoff"))
    return save(best, "cutoffs")


def apply_quality_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """documents(doc_id, text, lang, ...), labels(doc_id, quality) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    named = documents.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = save(measures(named, "stratum").withColumn("base_failed", failed), "measures")
    cutoffs = certified_cutoffs(measured, labels, risk, confidence).select(F.col("stratum").alias("of"), *[F.col(m).alias(f"cut_{m}") for m in LADDERS])
    rejected = F.lit(False)
    for m in LADDERS:
        rejected = rejected | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    judged = measured.join(cutoffs, F.col("stratum") == F.col("of"), "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
