"""Span algebra as column expressions. A span is a struct with start and end, half-open offsets in code points, and optionally text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with 0-based offsets."""
    return F.substring(text, start + 1, end - start)


def valid(spans: Column, text: Column | None = None) -> Column:
    """Spans with start below end, and inside the text if one is given."""
    inside = lambda s: (s["start"] >= 0) & (s["end"] > s["start"])
    return F.filter(spans, inside if text is None else lambda s: inside(s) & (s["end"] <= F.length(text)))


def valid_order(spans: Column) -> Column:
    """Spans with both offsets and the end behind the start."""
    return F.filter(spans, lambda s: F.coalesce(s["end"] > s["start"], F.lit(False)))


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))


def length(a: Column) -> Column:
    return a["end"] - a["start"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of characters."""
    return F.coalesce(F.try_divide(overlap(a, b), length(a) + length(b) - overlap(a, b)), F.lit(0.0))


def hull_iou(a: Column, b: Column) -> Column:
    """Intersection over the hull of both spans."""
    return F.coalesce(F.try_divide(overlap(a, b), F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])), F.lit(0.0))


def _pairs(pred: Column, gold: Column, score: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(pred, lambda p, i: F.transform(gold, lambda g, j: F.struct(score(p, g).alias("v"), i.alias("i"), j.alias("j")))))


def _greedy(pairs: Column) -> Column:
    """How many of the ordered pairs a one-to-one assignment takes, first come first served."""
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("p"), empty.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["p"], x["i"]) & ~F.array_contains(acc["g"], x["j"])
        return F.when(free, F.struct(F.array_append(acc["p"], x["i"]).alias("p"), F.array_append(acc["g"], x["j"]).alias("g"))).otherwise(acc)

    return F.aggregate(pairs, start, step, lambda acc: F.size(acc["p"]))


def match_iou(pred: Column, gold: Column, threshold: float = 0.75) -> Column:
    """True positives: pairs in descending order of (IoU, pred, gold), greedily one to one, IoU strictly above the threshold."""
    return _greedy(F.sort_array(F.filter(_pairs(pred, gold, iou), lambda x: x["v"] > threshold), asc=False))


def match_hull(pred: Column, gold: Column, threshold: float = 0.5) -> Column:
    """True positives: each prediction in turn takes the first free gold span whose hull IoU reaches the threshold."""
    return _greedy(F.filter(_pairs(pred, gold, hull_iou), lambda x: x["v"] >= threshold))


def match_overlap(pred: Column, gold: Column) -> Column:
    """True positives: each prediction in turn takes the first free gold span that it overlaps."""
    return _greedy(F.filter(_pairs(pred, gold, lambda p, g: overlap(p, g)), lambda x: x["v"] > 0))


def any_overlap(pred: Column, gold: Column) -> Column:
    return F.exists(pred, lambda p: F.exists(gold, lambda g: overlap(p, g) > 0))


def merge(spans: Column) -> Column:
    """Sorted disjoint intervals; touching ones become one."""
    kind = "array<struct<start:bigint,end:bigint>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast(kind), step)


def covered_length(merged: Column) -> Column:
    return F.aggregate(merged, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def common_length(a: Column, b: Column) -> Column:
    """Characters in both of two lists of disjoint intervals."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(a, zero, lambda acc, x: acc + F.aggregate(b, zero, lambda inner, y: inner + overlap(x, y)))


def set_f1(common: Column, a: Column, b: Column) -> Column:
    """F1 of two sets by their sizes; 1 if both are empty."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * common, (a + b).cast("double")), F.lit(0.0)))


def char_f1(pred: Column, gold: Column, text: Column | None = None) -> Column:
    """F1 of covered characters, by merged intervals; spans that are not inside the text, if one is given, cover none."""
    p, g = (merge(x if text is None else valid(x, text)) for x in (pred, gold))
    return set_f1(common_length(p, g), covered_length(p), covered_length(g))


def tokens(text: Column, spans: Column) -> Column:
    """Distinct lower-case words of the spans' texts."""
    return F.array_remove(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.split(F.lower(cut(text, s["start"], s["end"])), r"\s+")))), "")


def token_f1(text: Column, pred: Column, gold: Column) -> Column:
    p, g = tokens(text, pred), tokens(text, gold)
    return set_f1(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def exact(pred: Column, gold: Column) -> Column:
    """Whether both hold the same set of offsets."""
    ends = lambda spans: F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return ends(pred) == ends(gold)


def occurrences(text: Column, part: Column) -> Column:
    """0-based places of all occurrences, overlapping ones too: the text is split before each, so that it is read once. None of an empty part."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, quoted, -1)
    start = F.struct(F.lit(0).alias("at"), F.when(F.startswith(text, part), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("found"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["found"], acc["at"] + F.length(p)).alias("found"))
    places = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda acc: acc["found"])
    return F.when((F.length(part) > 0) & text.contains(part), places).otherwise(F.array().cast("array<int>"))


def nearest_occurrence(text: Column, part: Column, anchor: Column) -> Column:
    """The occurrence closest to the anchor, the first of equals; -1 if there is none."""
    best = F.array_min(F.transform(occurrences(text, part), lambda p: F.struct(F.abs(p - anchor).alias("d"), p.alias("p"))))
    return F.coalesce(best["p"], F.lit(-1))


def finalize(text: Column, spans: Column, locate: bool = True) -> Column:
    """struct(spans, unlocatable) of raw spans (start, end, text, and label_type if they have it; null where missing).

    Ends beyond the text are clipped. With locate, a span whose offsets don't give its text moves to the text's nearest occurrence if
    there is one, and without offsets to its first; what still has no place is dropped and counted. Without locate, spans without
    offsets are dropped and counted, others without a place are only dropped.
    """
    def fix(s: Column) -> Column:
        offsets = s["start"].isNotNull() & s["end"].isNotNull()
        said = F.coalesce(F.length(s["text"]), F.lit(0)) > 0
        moves = F.lit(locate) & said & (F.length(text) > 0) & ~(offsets & F.coalesce(cut(text, s["start"], s["end"]) == s["text"], F.lit(False)))
        at = F.when(moves, nearest_occurrence(text, s["text"], F.coalesce(s["start"], F.lit(0)))).otherwise(-1)
        start = F.when(at >= 0, at).when(offsets, s["start"])
        end = F.when(at >= 0, at + F.length(s["text"])).when(offsets, F.when(F.length(text) > 0, F.least(s["end"], F.length(text))).otherwise(s["end"]))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), offsets.alias("offsets"), s["text"].alias("text"))

    fixed = F.transform(spans, fix)
    good = lambda x: F.coalesce((x["start"] >= 0) & (x["end"] > x["start"]), F.lit(False))
    lost = F.filter(fixed, lambda x: ~good(x) & (F.lit(locate) | ~x["offsets"]))
    kept = F.filter(F.zip_with(fixed, spans, lambda x, s: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(F.length(text) > 0, cut(text, x["start"], x["end"])).otherwise(x["text"]).alias("text"), s.alias("raw"))), good)
    return F.struct(F.transform(kept, lambda x: F.struct(x["start"], x["end"], x["text"])).alias("spans"), F.size(lost).alias("unlocatable"), F.transform(kept, lambda x: x["raw"]).alias("raw"))


def punctuation_drift(a: Column, b: Column) -> Column:
    """Equal length, and each place equal or free of letters and digits on both sides."""
    sign = lambda c: ~c.rlike(r"[\p{L}\p{N}]")
    same = F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y) | (sign(x) & sign(y))), lambda x: x)
    return (F.length(a) == F.length(b)) & same


def reconcile_code(text: Column, s: Column) -> Column:
    """OK, PUNCT_DRIFT, REANCHORED (one occurrence elsewhere) or BROKEN."""
    here = cut(text, s["start"], s["end"])
    once = F.size(occurrences(text, s["text"])) == 1
    return F.when(here == s["text"], "OK").when(punctuation_drift(here, s["text"]), "PUNCT_DRIFT").when(once, "REANCHORED").otherwise("BROKEN")


def token_runs(rows: DataFrame, key: str, place: str, flag: str, score: str, holes: int = 0, least: int = 1) -> DataFrame:
    """Runs of flagged tokens with up to `holes` others in a row between: key, start, end (exclusive), n and mean score of all tokens from the first flagged to the last, holes too. One shuffle on the key."""
    w = W.partitionBy(key).orderBy(place)
    last = F.last(F.when(F.col(flag), F.col(place)), ignorenulls=True)
    marked = rows.withColumn("before", last.over(w.rowsBetween(W.unboundedPreceding, -1)))
    new = F.col(flag) & (F.col("before").isNull() | (F.col(place) - F.col("before") > holes + 1))
    numbered = marked.withColumn("run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w)).where("run > 0")
    ends = numbered.withColumn("last", F.max(F.when(F.col(flag), F.col(place))).over(W.partitionBy(key, "run"))).where(F.col(place) <= F.col("last"))
    out = ends.groupBy(key, "run").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end"), F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    return out.where(F.col("n") >= least).drop("run")


def merge_near(spans: Column, within: int = 2) -> Column:
    """Token spans struct(start, end inclusive, probability) in order of start: one that starts at most `within` tokens behind the end of the last one joins it, with the mean of both probabilities."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["probability"].cast("double").alias("probability"))))
    head = lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), ((last["probability"] + s["probability"]) / 2).alias("probability"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + within, F.concat(head(acc), F.array(joined))).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,probability:double>>"), step)


def candidate_spans(rows: DataFrame, key: str, tokens: str, longest: int = 50, most: int = 5000) -> DataFrame:
    """key, start, end (inclusive): all token spans up to a length; of more than `most`, every k-th so that about `most` stay."""
    n = F.col(tokens)
    total = F.expr(f"cast({tokens} as bigint) * least({longest}, {tokens}) - cast(least({longest}, {tokens}) as bigint) * (least({longest}, {tokens}) - 1) div 2")
    step = F.when(total > most, F.floor(total / most)).otherwise(1)
    d = rows.where(n > 0).select(key, n.alias("n"), step.alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    # The number of candidates before those of a start: full ones of `longest`, then a falling row.
    s, full = F.col("start").cast("bigint"), F.greatest(F.col("n") - longest + 1, F.lit(0)).cast("bigint")
    falling = F.greatest(s - full, F.lit(0).cast("bigint"))
    top = F.when(F.col("n") >= longest, F.lit(longest - 1)).otherwise(F.col("n"))
    before = F.least(s, full) * longest + falling * top - (falling * (falling - 1) / 2).cast("bigint")
    d = d.withColumn("before", before).withColumn("length", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))))
    return d.where((F.col("before") + F.col("length") - 1) % F.col("step") == 0).select(key, "start", (F.col("start") + F.col("length") - 1).alias("end"))


def span_features(spans: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """spans(key, start, end inclusive), tokens(key, place, feature, value) -> key, start, end, feature, value: the mean of each feature over a span's tokens."""
    inside = spans.join(tokens, key).where(F.col("place").between(F.col("start"), F.col("end")))
    return inside.groupBy(key, "start", "end", "feature").agg(F.avg("value").alias("value"))


def character_spans(text: Column, offsets: Column, runs: Column) -> Column:
    """Token spans (start, end inclusive) -> struct(start, end, text, start_token, end_token) by the tokens' offsets struct(start, end); those beyond the tokens are dropped."""
    known = F.filter(runs, lambda r: (r["start"] < F.size(offsets)) & (r["end"] < F.size(offsets)))

    def one(r: Column) -> Column:
        a, b = F.get(offsets, r["start"])["start"], F.get(offsets, r["end"])["end"]
        return F.struct(a.alias("start"), b.alias("end"), cut(text, a, b).alias("text"), r["start"].alias("start_token"), r["end"].alias("end_token"))

    return F.transform(known, one)


def window_votes(rows: DataFrame, key: str, place: str, value: str, size: int = 8, threshold: float = 0.5) -> DataFrame:
    """Mean of the value over each full sliding window; each token gets the share of windows over it that reach the threshold. Tokens in no full window count as flagged."""
    w = W.partitionBy(key).orderBy(place)
    ahead = w.rowsBetween(0, size - 1)
    hit = rows.withColumn("full", F.count("*").over(ahead) == size).withColumn("hit", F.when(F.col("full"), (F.avg(value).over(ahead) >= threshold).cast("int")))
    over = w.rowsBetween(-(size - 1), 0)
    return hit.select(key, place, value, F.coalesce(F.avg("hit").over(over), F.lit(1.0)).alias("share")).withColumn("flagged", F.col("share") >= 0.5)


def window_probabilities(rows: DataFrame, key: str, place: str, value: str, size: int = 8, threshold: float = 0.5) -> DataFrame:
    """The mean of the value over each full sliding window is that window's probability to be factual. Each token gets the mean probability of the windows over it, and is factual if more than half of them exceed the threshold. A token in no full window has 0 and isn't."""
    w = W.partitionBy(key).orderBy(place)
    ahead = w.rowsBetween(0, size - 1)
    windows = rows.withColumn("p", F.when(F.count("*").over(ahead) == size, F.avg(value).over(ahead)))
    over = w.rowsBetween(-(size - 1), 0)
    share = F.avg((F.col("p") > threshold).cast("int")).over(over)
    return windows.select(key, place, F.coalesce(F.avg("p").over(over), F.lit(0.0)).alias("probability"), F.coalesce(share > 0.5, F.lit(False)).alias("factual"))
