"""From raw predictions to scores: tolerant span lists, classes, anchoring, and the tables of span and class figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import spans
from spanloom.operators.metrics import CLASSES, DEFECTS, SPAN_CLASSES, normalize_type, prf

RAW = "array<struct<start:int,end:int,text:string,label_type:string>>"
OTHER = "other"


def _kind(x: str) -> str:
    """What a variant holds: A, O or S for array, object and string, else the first letter of its type."""
    return f"substr(schema_of_variant({x}), 1, 1)"


def _json(text: str) -> str:
    """The variant of a text that looks like a JSON array or object and is one, else null."""
    return f"if(trim({text}) rlike '^[\\\\[{{]', try_parse_json({text}), null)"


def _first(x: str, names: tuple[str, ...]) -> str:
    """The first of an object's fields that is there, null ones too."""
    return f"coalesce({', '.join(f'''try_variant_get({x}, "$.{n}", "variant")''' for n in names)})"


def _span(x: str) -> str:
    """A raw span of a variant that is no JSON text: a string, a list of two or three, or an object; null if it is none."""
    text = lambda v: f"if({_kind(v)} = 'S' and cast({v} as string) <> '', cast({v} as string), null)"
    row = lambda s, e, t, label: f"named_struct('start', if({s} is null or {e} is null, null, {s}), 'end', if({s} is null or {e} is null, null, {e}), 'text', {t}, 'label_type', {label})"
    part = lambda place: f"try_variant_get({x}, '{place}', 'int')"
    listed = row(part("$[0]"), part("$[1]"), text(f"try_variant_get({x}, '$[2]', 'variant')"), "cast(null as string)")
    label = f"nullif(cast({_first(x, ('label_type', 'type', 'category', 'class'))} as string), 'null')"
    field = row(part("$.start"), part("$.end"), text(_first(x, ("text", "span"))), label)
    bare = row("cast(null as int)", "cast(null as int)", f"if(cast({x} as string) rlike '\\\\S', cast({x} as string), null)", "cast(null as string)")
    return f"case {_kind(x)} when 'S' then {bare} when 'A' then if(size(cast({x} as array<variant>)) >= 2, {listed}, null) when 'O' then {field} end"


def parse_span_list(column: str) -> Column:
    """Raw spans struct(start, end, text, label_type) of a text column, by variants, without Python.

    Takes a JSON list, an object with spans or predictions, or a bare text (one span of that text). Elements are texts, texts that hold
    JSON, lists of start, end and perhaps a text, or objects; numbers may be texts and are cut to whole ones. A span with neither both
    offsets, a text nor a label is left out. Null and anything else give an empty array.
    """
    value = _json(column)
    inner = _first("v", ("spans", "predictions"))
    items = f"""case {_kind('v')} when 'A' then cast(v as array<variant>) when 'O' then
        case {_kind(inner)} when 'A' then cast({inner} as array<variant>) when 'S' then array({inner}) end end"""
    bare = f"array(try_parse_json(to_json(named_struct('x', {column}))))"
    found = f"if(v is null, transform({bare}, b -> try_variant_get(b, '$.x', 'variant')), {items})"
    opened = f"transform({found}, x -> if({_kind('x')} = 'S', coalesce({_json('cast(x as string)')}, x), x))"
    spans_of = f"transform({opened}, x -> {_span('x')})"
    kept = f"filter({spans_of}, s -> s is not null and (s.start is not null or s.text is not null or s.label_type is not null))"
    return F.expr(f"if({column} is null, cast(array() as {RAW}), coalesce(transform(array({value}), v -> {kept})[0], cast(array() as {RAW})))")


def class_list(column: str) -> Column:
    """The known classes in a text column, in order and once each: a JSON list of names or objects, an object, or a bare name. Null gives an empty array."""
    value = _json(column)
    name = lambda x: f"case {_kind(x)} when 'O' then cast({_first(x, ('class', 'type'))} as string) when 'A' then cast(try_variant_get({x}, '$[0]', 'variant') as string) else cast({x} as string) end"
    single = _first("v", ("type", "class"))
    names = f"transform(array({value}), v -> case {_kind('v')} when 'A' then transform(cast(v as array<variant>), x -> {name('x')}) when 'O' then array(cast({single} as string)) else array({column}) end)[0]"
    return F.array_distinct(F.filter(F.transform(F.expr(f"if({column} is null, cast(array() as array<string>), {names})"), normalize_type), lambda c: c.isin(*CLASSES)))


def predicted(status: str, kind: str, span_text: str) -> Column:
    """struct(classes, spans, failed) of a prediction with a class column and a span column.

    A status other than ok, or no class at all (null, empty, unknown, null), is a failure with null classes; a class outside the known ones is `other`.
    """
    classes, raw = class_list(kind), normalize_type(F.expr(f"nullif({kind}, '')"))
    ok = F.coalesce(F.col(status), F.lit("ok")) == "ok"
    unknown = (F.size(classes) == 0) & (raw.isNull() | raw.isin("", "unknown", "null"))
    known = F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit(OTHER)))
    found = F.when(ok, parse_span_list(span_text)).otherwise(F.array().cast(RAW))
    return F.struct(F.when(ok & ~unknown, known).alias("classes"), found.alias("spans"), (~ok | unknown).alias("failed"))


def verdict_errors(parsed: Column, errors: str) -> Column:
    """struct(classes, spans, failed) of a verdict that lists errors of class and span: none is clean, unknown classes are `other`, null or unparsed fails."""
    classes = class_list(errors)
    raw = F.filter(parse_span_list(errors), lambda s: s["text"].isNotNull())
    empty = F.trim(F.col(errors)).rlike(r"^\[\s*\]$")
    bad = F.col(errors).isNull() | ~F.coalesce(parsed, F.lit(True))
    named = F.when(empty, F.array(F.lit("clean"))).when(F.size(classes) == 0, F.array(F.lit(OTHER))).otherwise(classes)
    return F.struct(F.when(~bad, named).alias("classes"), F.when(bad, F.array().cast(RAW)).otherwise(raw).alias("spans"), bad.alias("failed"))


def anchored(text: Column, raw: Column) -> Column:
    """struct(spans, issues): predicted spans placed by their quoted text, the nearest occurrence; by their offsets where it isn't there.

    A quote that has no place is kept without offsets, a span with neither is dropped. Issues name what was done: MOVED, OFFSETS_USED,
    UNPLACED, DROPPED, each with the span's number.
    """

    def one(s: Column, i: Column) -> Column:
        inside = F.coalesce((s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)), F.lit(False))
        said = F.coalesce(F.length(s["text"]), F.lit(0)) > 0
        here = inside & (spans.cut(text, s["start"], s["end"]) == s["text"])
        at = F.when(said & ~here, spans.nearest_occurrence(text, s["text"], F.when(s["start"].isNotNull() & s["end"].isNotNull(), s["start"]).otherwise(0))).otherwise(-1)
        code = F.when(~said & ~inside, "DROPPED").when(~said | here, None).when(at >= 0, "MOVED").when(inside, "OFFSETS_USED").otherwise("UNPLACED")
        start = F.when(at >= 0, at).when(inside, s["start"])
        end = F.when(at >= 0, at + F.length(s["text"])).when(inside, s["end"])
        quoted = F.when(said & ~(inside & (at < 0)), s["text"]).when(inside, spans.cut(text, s["start"], s["end"]))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), quoted.alias("text"), F.when(code == "OFFSETS_USED", s["text"]).alias("model_text"), code.alias("code"), i.alias("i"))

    placed = F.transform(raw, one)
    kept = F.transform(F.filter(placed, lambda x: ~F.coalesce(x["code"] == "DROPPED", F.lit(False))), lambda x: F.struct(x["start"], x["end"], x["text"], x["model_text"]))
    return F.struct(kept.alias("spans"), F.transform(F.filter(placed, lambda x: x["code"].isNotNull()), lambda x: F.concat(x["code"], F.lit(" "), x["i"])).alias("issues"))


def validated(kind: Column, raw: Column, text: Column) -> Column:
    """struct(type, spans, issues) of a prediction: unknown classes become unknown, spans of clean and undergeneration are cleared, others anchored."""
    known, bare = kind.isin(*CLASSES), kind.isin("clean", "undergeneration")
    cleared = F.coalesce(bare, F.lit(False)) & (F.size(raw) > 0)
    a = anchored(text, F.when(cleared, F.slice(raw, 1, 0)).otherwise(raw))
    issues = F.array_compact(F.array(F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN_TYPE"), F.when(cleared, "SPANS_CLEARED")))
    return F.struct(F.when(known, kind).otherwise("unknown").alias("type"), a["spans"].alias("spans"), F.concat(issues, a["issues"]).alias("issues"))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_summary(rows: DataFrame, gold: str = "gold", preds: str = "preds", failed: str = "failed") -> DataFrame:
    """One row: macro_f1 over classes with rows, type accuracy of all defects and of each, rows with several classes, parse failures. Rows with null preds are not typed and left out."""
    typed = rows.where(F.col(preds).isNotNull())
    g, has = F.col(gold), lambda c: F.array_contains(preds, c)
    d = typed.agg(
        *[F.count_if((g == c) & has(c)).alias(f"tp_{c}") for c in CLASSES],
        *[F.count_if((g != c) & has(c)).alias(f"fp_{c}") for c in CLASSES],
        *[F.count_if(g == c).alias(f"n_{c}") for c in CLASSES],
        F.count_if(F.size(preds) > 1).alias("several"),
        F.count_if(failed).alias("parse_failures"),
    )
    f1 = [F.when(F.col(f"n_{c}") > 0, _rate(2 * F.col(f"tp_{c}"), F.col(f"tp_{c}") + F.col(f"fp_{c}") + F.col(f"n_{c}"))) for c in CLASSES]
    n_scored = sum((F.when(F.col(f"n_{c}") > 0, 1).otherwise(0) for c in CLASSES), F.lit(0))
    macro = F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in f1), F.lit(0.0)), n_scored)
    hits, bad = (sum((F.col(f"{k}_{c}") for c in DEFECTS), F.lit(0)) for k in ("tp", "n"))
    each = [F.try_divide(F.col(f"tp_{c}").cast("double"), F.col(f"n_{c}")).alias(f"type_accuracy_{c}") for c in DEFECTS]
    return d.select(macro.alias("macro_f1"), F.try_divide(hits.cast("double"), bad).alias("type_accuracy"), *each, F.col("several").alias("several_classes"), "parse_failures")


def span_scopes(rows: DataFrame, gold: str = "gold") -> DataFrame:
    """rows(gold, n_pred, n_gold, matched, unlocatable, char_f1, token_f1, exact) -> scope, tp, fp, fn, rates, rows, gold_spans, pred_spans, unlocatable, means.

    One scope for each defect, `clean(FP source)`, and ALL; means of characters, tokens and exactness only for classes with spans.
    """
    scope = F.when(F.col(gold) == "clean", "clean(FP source)").otherwise(F.col(gold))
    d = rows.withColumn("scope", scope).rollup("scope").agg(
        F.grouping("scope").alias("everything"),
        F.sum("matched").alias("tp"),
        F.sum(F.col("n_pred") - F.col("matched") + F.col("unlocatable")).alias("fp"),
        F.sum(F.col("n_gold") - F.col("matched")).alias("fn"),
        F.count("*").alias("support_rows"),
        F.sum("n_gold").alias("gold_spans"),
        F.sum(F.col("n_pred") + F.col("unlocatable")).alias("pred_spans"),
        F.sum("unlocatable").alias("unlocatable_spans"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ("char_f1", "token_f1", "exact")],
    )
    d = prf(d.withColumn("scope", F.when(F.col("everything") == 1, "ALL").otherwise(F.col("scope"))).drop("everything"))
    return d.withColumns({c: F.when(F.col("scope").isin(*SPAN_CLASSES), F.col(c)) for c in ("char_f1", "token_f1", "exact")})


TABLE = (
    ("Response-level Correct", "clean"), ("Response-level Mismatch", "answer_mismatch"), ("Response-level Overgen.", "overgeneration"),
    ("Response-level Missing Tool", "missing_tool"), ("Response-level Undergen.", "undergeneration"),
)
SPAN_TABLE = (("Span-level Mismatch", "answer_mismatch"), ("Span-level Overgen.", "overgeneration"), ("Span-level Missing Tool", "missing_tool"))


def table_row(rows: DataFrame, policy: str = "exclude", setting: str = "Transfer SFT", data: str = "default", model: str = "", detector: str = "span-only") -> DataFrame:
    """rows(gold, flagged, n_pred, n_gold, matched, unlocatable, and preds if class-aware) -> the one row of 18 columns of a results table, rounded to four places. One pass over the rows."""
    g = F.col("gold")
    aware = detector == "class-aware"
    aggs = []
    for c in CLASSES:
        aggs += [F.count_if((g == c) & F.col("flagged")).alias(f"yes_{c}"), F.count_if((g == c) & ~F.col("flagged")).alias(f"no_{c}")]
        aggs += [F.sum(F.when(g == c, F.col(k)).otherwise(0)).alias(f"{k}_{c}") for k in ("matched", "n_pred", "n_gold", "unlocatable")]
        aggs.append((F.count_if((g == c) & F.array_contains("preds", c)) if aware else F.lit(0).cast("bigint")).alias(f"hit_{c}"))
        aggs.append((F.count_if((g == c) & F.col("preds").isNotNull()) if aware else F.lit(0).cast("bigint")).alias(f"typed_{c}"))
    d = rows.agg(F.count("*").alias("all_rows"), *aggs)
    total = lambda k, names: sum((F.coalesce(F.col(f"{k}_{c}"), F.lit(0)) for c in names), F.lit(0))
    f1 = lambda tp, fp, fn: _rate(2 * tp, 2 * tp + fp + fn)
    response = {"clean": f1(F.col("no_clean"), total("no", SPAN_CLASSES), F.col("yes_clean"))}
    response |= {c: f1(F.col(f"yes_{c}"), F.col("yes_clean"), F.col(f"no_{c}")) for c in DEFECTS}
    if policy != "score":
        response["undergeneration"] = F.lit(None).cast("double")
    counted = ("clean", *SPAN_CLASSES)
    here = {c: (F.col(f"yes_{c}") + F.col(f"no_{c}")) > 0 for c in CLASSES}
    mean = lambda scores, names: F.try_divide(sum((F.when(here[c], scores[c]).otherwise(0.0) for c in names), F.lit(0.0)), sum((here[c].cast("int") for c in names), F.lit(0)))

    def span_f1(names: tuple[str, ...]) -> Column:
        return f1(total("matched", names), total("n_pred", names) - total("matched", names) + total("unlocatable", names), total("n_gold", names) - total("matched", names))

    by_span = {c: span_f1((c,)) for c in SPAN_CLASSES}
    rows_of = lambda names: total("yes", names) + total("no", names)
    under = rows_of(("undergeneration",)).cast("string")
    note = {"score": "scored (", "positive": "positive, not in columns (", "exclude": "excluded ("}[policy]
    accuracy = F.try_divide(total("hit", DEFECTS).cast("double"), total("typed", DEFECTS)) if aware else F.lit(None).cast("double")
    responded = rows_of(CLASSES if policy != "exclude" else counted)
    four = lambda c, name: F.round(c, 4).alias(name)
    return d.select(
        F.lit(setting).alias("Setting"),
        F.lit(data).alias("Data"),
        F.lit(model).alias("Model"),
        F.lit(detector).alias("Detector"),
        *[four(response[c], name) for name, c in TABLE],
        four(mean(response, counted), "Response-level Avg. (w/o Undergen.)"),
        four(accuracy, "Type Acc."),
        *[four(by_span[c], name) for name, c in SPAN_TABLE],
        four(mean(by_span, SPAN_CLASSES), "Span-level Avg. (macro)"),
        four(span_f1(CLASSES), "Span-level ALL (pooled)"),
        F.concat(F.lit(note), under, F.lit(")")).alias("Undergen. rows"),
        F.concat(responded.cast("string"), F.lit(" resp / "), F.col("all_rows").cast("string"), F.lit(" span")).alias("Scored rows"),
    )


def shown_table(row: DataFrame) -> DataFrame:
    """All columns as text: shares in per cent with two digits, a dash for null."""
    return row.select(*[F.coalesce(F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.2f", 100 * F.col(f"`{c}`"))) if t == "double" else F.col(f"`{c}`").cast("string"), F.lit("—")).alias(c) for c, t in row.dtypes])


def _lengths(pred: str, gold: str, text_length: Column | None = None) -> dict[str, Column]:
    """Covered characters of both sides and of their common part; clipped to a text's length if that is given."""
    clip = lambda c: F.transform(c, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).cast("bigint").alias("start"), F.least(s["end"], text_length).cast("bigint").alias("end")))
    good = lambda c: F.filter(c, lambda s: s["end"] > s["start"])
    p, g = (spans.merge(good(F.col(c) if text_length is None else clip(F.col(c)))) for c in (pred, gold))
    return {"p": p, "g": g}


def char_scopes(rows: DataFrame, gold: str = "gold", kind: str = "pred", pred_spans: str = "pred_spans", gold_spans: str = "gold_spans") -> DataFrame:
    """Character counts over rows with gold spans, pooled: scope (ALL, TYPE_CORRECT, each class), tp, fp, fn, rates, rows, exact (rows whose merged spans are equal)."""
    d = rows.where((F.col(gold) != "clean") & (F.size(gold_spans) > 0)).withColumns(_lengths(pred_spans, gold_spans))
    common = spans.common_length(F.col("p"), F.col("g"))
    d = d.select(F.col(gold).alias("class"), (F.col(gold) == F.col(kind)).alias("right"), common.alias("tp"), (spans.covered_length(F.col("p")) - common).alias("fp"), (spans.covered_length(F.col("g")) - common).alias("fn"), (F.col("p") == F.col("g")).alias("same"))
    scopes = F.array_compact(F.array(F.lit("ALL"), F.when(F.col("right"), "TYPE_CORRECT"), F.col("class")))
    counts = d.groupBy("class", "right").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")], F.count_if("same").alias("exact"), F.count("*").alias("n"))
    out = counts.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "exact", "n")])
    return prf(out)


def clean_flags(rows: DataFrame, gold: str = "gold", pred_spans: str = "pred_spans", gold_spans: str = "gold_spans", unplaceable: str = "unplaceable") -> DataFrame:
    """One row: n_clean (rows without gold spans), those of them with a predicted character, and all spans without a place."""
    bare = (F.col(gold) == "clean") | (F.size(gold_spans) == 0)
    some = F.exists(pred_spans, lambda s: s["end"] > s["start"])
    return rows.agg(F.count_if(bare).alias("n_clean"), F.count_if(bare & some).alias("clean_false_positive_rows"), F.sum(unplaceable).alias("unplaceable_spans"))


def mean_characters(rows: DataFrame, pred_spans: str = "pred_spans", gold_spans: str = "gold_spans") -> DataFrame:
    """Means over rows of character precision, recall and F1; a row without any span counts 1 in each."""
    d = rows.withColumns(_lengths(pred_spans, gold_spans)).select(spans.covered_length(F.col("p")).alias("a"), spans.covered_length(F.col("g")).alias("b"), spans.common_length(F.col("p"), F.col("g")).alias("c"))
    none = (F.col("a") == 0) & (F.col("b") == 0)
    mean = lambda x: F.avg(F.when(none, 1.0).otherwise(x))
    return d.agg(mean(_rate(F.col("c"), F.col("a"))).alias("mean_precision"), mean(_rate(F.col("c"), F.col("b"))).alias("mean_recall"), mean(_rate(2 * F.col("c"), F.col("a") + F.col("b"))).alias("mean_f1"), F.count("*").alias("n"))


def overall_score(rows: DataFrame, gold: str = "gold", pred: str = "pred", parsed: str = "parsed", length: str = "length", pred_spans: str = "pred_spans", gold_spans: str = "gold_spans") -> DataFrame:
    """One row: exact and balanced accuracy, macro F1 over all classes, the clean-or-not decision, pooled characters and mean IoU over rows with gold characters. A null class counts as clean; spans are clipped to the text."""
    d = rows.withColumns(_lengths(pred_spans, gold_spans, F.col(length)))
    g, p = F.col(gold), F.coalesce(F.col(pred), F.lit("clean"))
    common = spans.common_length(F.col("p"), F.col("g"))
    d = d.select(g.alias("gold"), p.alias("pred"), F.col(parsed).alias("parsed"), common.alias("c"), spans.covered_length(F.col("p")).alias("a"), spans.covered_length(F.col("g")).alias("b"))
    g, p = F.col("gold"), F.col("pred")
    bad, said = g != "clean", p != "clean"
    d = d.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("parsed")).alias("parse_fail"),
        *[F.count_if((g == c) & (p == c)).alias(f"tp_{c}") for c in CLASSES],
        *[F.count_if((g != c) & (p == c) & g.isin(*CLASSES)).alias(f"fp_{c}") for c in CLASSES],
        *[F.count_if((g == c) & (p != c) & p.isin(*CLASSES)).alias(f"fn_{c}") for c in CLASSES],
        *[F.count_if(x).alias(k) for k, x in {"btp": bad & said, "bfp": ~bad & said, "bfn": bad & ~said, "btn": ~bad & ~said}.items()],
        *[F.sum(x).alias(k) for k, x in {"ctp": F.col("c"), "cfp": F.col("a") - F.col("c"), "cfn": F.col("b") - F.col("c")}.items()],
        F.avg(F.when(F.col("b") > 0, F.col("c") / (F.col("a") + F.col("b") - F.col("c")))).alias("span_mean_iou"),
        F.count_if(F.col("b") > 0).alias("span_iou_rows"),
    )
    tp, fp, fn = ({c: F.col(f"{k}_{c}") for c in CLASSES} for k in ("tp", "fp", "fn"))
    k = len(CLASSES)
    one = lambda a: F.col(a)
    return d.select(
        "n", "parse_fail",
        _rate(sum(tp.values(), F.lit(0)), one("n")).alias("fine_accuracy"),
        (sum((_rate(tp[c], tp[c] + fn[c]) for c in CLASSES), F.lit(0.0)) / k).alias("balanced_accuracy"),
        (sum((_rate(2 * tp[c], 2 * tp[c] + fp[c] + fn[c]) for c in CLASSES), F.lit(0.0)) / k).alias("macro_f1"),
        _rate(one("btp") + one("btn"), one("n")).alias("binary_accuracy"),
        _rate(2 * one("btp"), 2 * one("btp") + one("bfp") + one("bfn")).alias("binary_f1"),
        _rate(one("ctp"), one("ctp") + one("cfp")).alias("char_precision"),
        _rate(one("ctp"), one("ctp") + one("cfn")).alias("char_recall"),
        _rate(2 * one("ctp"), 2 * one("ctp") + one("cfp") + one("cfn")).alias("char_f1"),
        F.coalesce("span_mean_iou", F.lit(0.0)).alias("span_mean_iou"), "span_iou_rows",
    )
