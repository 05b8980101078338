"""Labelled rows from edited ones: for each kind of edit which characters of the answer are labelled, and the exported row.

Each builder makes an array of proposed stretches in the order in which they count, of which a later one that overlaps an earlier one is
left out. All is row by row; places of many texts in one answer come from one pass over it (editing.found_in).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import json_tree
from spanloom.functions.text import bound, tag_spans
from spanloom.operators import editing, spans
from spanloom.operators.dialogue import last_index
from spanloom.operators.examples import CURRENCIES, apart, located, whole_words
from spanloom.operators.editing import BASELESS, CONFLICT, LABEL, grouped, label, lower_case

#: Characters to either side of a value by which its places are told apart.
WINDOW = 30
#: A value longer than this that covers most of the answer is labelled by its numbers.
PROSE, MOST = 50, 0.6
NONE = f"array<{LABEL}>"


def nothing() -> Column:
    return F.array().cast(NONE)


def line_of(meta: Column, name: str) -> Column:
    """What stands behind `name: ` in the first line of a note that begins so; null if none does."""
    return F.nullif(F.regexp_extract(meta, rf"(?:\A|\n){name}: ([^\n]*)", 1), F.when(~meta.rlike(rf"(?:\A|\n){name}: "), F.lit("")))


def grown(answer: Column, start: Column, end: Column, numbers: bool = True) -> Column:
    """struct(start, end): a stretch grown over the letters that touch it; with numbers, one of up to three characters also over signs of numbers behind it and digits before it."""
    def widened(w: Column) -> Column:
        behind = F.length(F.regexp_extract(F.substring(answer, w["end"] + 1, F.length(answer)), r"\A[%.,]*", 0))
        before = F.length(F.regexp_extract(F.substring(answer, F.lit(1), w["start"]), r"[0-9]*\z", 0))
        return F.when((w["end"] - w["start"]) <= 3, F.struct((w["start"] - before).cast("int").alias("start"), (w["end"] + behind).cast("int").alias("end"))).otherwise(w)

    return bound(whole_words(answer, start, end), widened) if numbers else whole_words(answer, start, end)


def all_places(found: Column, text: Column) -> Column:
    return F.coalesce(F.try_element_at(found, lower_case(text)), F.array().cast("array<int>"))


def note(kind: Column, name: str, text: Column) -> Column:
    return F.concat(F.upper(F.replace(kind, F.lit(" "), F.lit("_"))), F.lit(f"\n{name}: "), text)


def counted(labels: Column, kind: str) -> Column:
    return F.size(F.filter(labels, lambda x: x["label_type"] == kind))


def mismatch_labels(rows: DataFrame, answer: str, response: str, changed: str, tagged: str, evaluated: str, asked: str) -> DataFrame:
    """rows(answer, response, changed, tagged, evaluated: array of struct(meta, label_type, implicit_true, due_to_null), asked: the user's prompt) -> with labels and output (the text that they count in).

    Of each explicit evaluated change the original value is looked for in the answer, if it did change. One of up to three characters
    must stand alone. If the value also stands in a leaf of the changed response, the place counts whose surroundings don't stand there
    (else the last); if not, all its places count, or, for a long sentence that is most of the answer, those of its numbers that weren't
    asked for. Places grow to whole words. A row without labels gets those of editing.mismatch_spans, which count in its plain text.
    """
    d = editing.mismatch_spans(rows.withColumn("_t", F.coalesce(F.col(tagged), F.col(answer))), response, changed, "_t", values="_values").withColumnsRenamed({"labels": "_else", "plain": "_plain"})
    text, ctx = F.col(answer), F.lower(F.coalesce(F.col(changed), F.lit("")))
    d = d.withColumn("_kept", F.transform("_values", F.lower)).drop("_values")
    explicit = F.filter(evaluated, lambda x: ~F.coalesce(x["implicit_true"], F.lit(False)) & ~F.coalesce(x["due_to_null"], F.lit(False)))
    read = F.transform(explicit, lambda x: F.struct(line_of(x["meta"], "Original").alias("old"), line_of(x["meta"], "Generated").alias("new"), x["meta"].alias("meta"), F.coalesce(x["label_type"], F.lit(CONFLICT)).alias("kind")))
    same = lambda x: F.when(x["new"].isNotNull(), F.lower(x["new"]) == F.lower(x["old"])).otherwise(F.array_contains("_kept", F.lower(x["old"])))
    d = d.withColumn("_read", F.filter(read, lambda x: (F.length(x["old"]) > 0) & ~same(x)))
    d = d.withColumn("_at", F.filter(F.transform("_read", lambda x: F.struct(x.alias("x"), located(text, x["old"]).alias("l"))), lambda y: y["l"].isNotNull()))
    alone = lambda y: (F.length(y["x"]["old"]) > 3) | ~(spans.cut(text, y["l"]["start"] - 1, y["l"]["start"]).rlike(r"[\p{L}\p{N}]") & (y["l"]["start"] > 0) | spans.cut(text, y["l"]["end"], y["l"]["end"] + 1).rlike(r"[\p{L}\p{N}]"))
    d = d.withColumn("_at", F.filter("_at", alone)).withColumn("_words", F.transform("_at", lambda y: grown(text, y["l"]["start"], y["l"]["end"])))
    numbers = lambda y: F.regexp_extract_all(y["x"]["old"], F.lit(r"([0-9]+\.?[0-9]+|[0-9]+)"), F.lit(1))
    wanted = F.concat(F.transform("_at", lambda y: y["x"]["old"]), F.transform("_words", lambda w: spans.cut(text, w["start"], w["end"])), F.flatten(F.transform("_at", numbers)))
    d = editing.found_in(d.withColumn("_wanted", F.array_distinct(wanted)), answer, "_wanted", "_found")
    query = F.lower(F.coalesce(F.col(asked), F.lit("")))
    places = lambda t: all_places(F.col("_found"), t)
    made = lambda y, s: bound(s, lambda s: label(s["start"], s["end"], spans.cut(text, s["start"], s["end"]), y["x"]["meta"], y["x"]["kind"]))

    def unlike(y: Column) -> Column:
        """The first place whose surroundings aren't in the changed response, or the last."""
        size = F.length(y["x"]["old"])
        around = lambda p: F.lower(spans.cut(text, F.greatest(p - WINDOW, F.lit(0)), p + size + WINDOW))
        best = lambda own: F.coalesce(F.get(F.filter(own, lambda p: ~ctx.contains(around(p))), 0), F.try_element_at(own, F.lit(-1)))
        return bound(bound(places(y["x"]["old"]), best), lambda p: F.when(p.isNotNull(), F.array(made(y, grown(text, p, p + size)))).otherwise(nothing()))

    def everywhere(y: Column, w: Column) -> Column:
        each = lambda part: F.when(F.length(part) > 2, F.transform(places(part), lambda p: made(y, F.struct(p.alias("start"), (p + F.length(part)).alias("end"))))).otherwise(nothing())
        usual = F.concat(F.array(made(y, w)), bound(spans.cut(text, w["start"], w["end"]), each))
        own = F.filter(numbers(y), lambda t: ~query.contains(t) & (F.size(places(t)) > 0))
        by_number = lambda own: F.transform(own, lambda t: bound(places(t)[0], lambda p: made(y, grown(text, p, p + F.length(t)))))
        long = (F.length(y["x"]["old"]) > PROSE) & ((w["end"] - w["start"]) > F.length(text) * MOST)
        return F.when(long, bound(own, lambda own: F.when(F.size(own) > 0, by_number(own)).otherwise(usual))).otherwise(usual)

    proposed = F.flatten(F.zip_with("_at", "_words", lambda y, w: F.when(F.array_contains("_kept", F.lower(y["x"]["old"])), unlike(y)).otherwise(everywhere(y, w))))
    d = d.withColumn("_all", F.coalesce(proposed, nothing())).withColumn("_labels", F.array_sort(apart(F.col("_all")), lambda a, b: a["start"] - b["start"]))
    found = F.size("_labels") > 0
    d = d.withColumn("labels", F.when(found, F.col("_labels")).otherwise(F.col("_else"))).withColumn("output", F.when(found | (F.size("_else") == 0), text).otherwise(F.col("_plain")))
    return d.drop("_t", "_else", "_plain", "_kept", "_read", "_at", "_words", "_wanted", "_found", "_all", "_labels")


#: A blank line, or the place before a list item in bold.
BLOCK = r"\n\s*\n+|(?<=\n)(?=(?:[-*]\s+|[0-9]+\.\s+)\*\*)"
ITEM = r"\A\s*(?:[-*]\s+|[0-9]+\.\s+)\*\*"


def blocks(answer: Column) -> Column:
    """struct(start, end) of the parts of an answer between blank lines and before bold list items."""
    parts = F.arrays_zip(F.split(answer, BLOCK, -1).alias("part"), F.regexp_extract_all(answer, F.lit(f"({BLOCK})"), F.lit(1)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["part"])
        return F.struct((end + F.coalesce(F.length(p["gap"]), F.lit(0))).alias("at"), F.array_append(acc["found"], F.struct(acc["at"].alias("start"), end.alias("end"))).alias("found"))

    return F.filter(F.aggregate(parts, zero, step, lambda acc: acc["found"]), lambda b: b["end"] > b["start"])


def fabricated_blocks(answer: Column, values: Column) -> Column:
    """struct(start, end) of the bold list items of 30 characters or more that hold none of some values (lower case), without white space around them. None for answers up to 50 characters or without values."""
    body = lambda b: spans.cut(answer, b["start"], b["end"])
    made = lambda b: (F.length(F.trim(F.regexp_replace(body(b), r"\A\s+|\s+\z", ""))) >= 30) & body(b).rlike(ITEM) & ~F.exists(values, lambda v: F.lower(body(b)).contains(v))
    left = lambda b: F.length(F.regexp_extract(body(b), r"\A\s*", 0))
    right = lambda b: F.length(F.regexp_extract(body(b), r"\s*\z", 0))
    found = F.transform(F.filter(blocks(answer), made), lambda b: F.struct((b["start"] + left(b)).cast("int").alias("start"), (b["end"] - right(b)).cast("int").alias("end")))
    return F.when((F.length(answer) > 50) & (F.size(values) > 0), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def signed_forms(value: Column) -> Column:
    """Forms of a deleted number in the order in which they are looked for: behind currency signs with commas, with commas, as it is."""
    whole = grouped(value)
    decimal = F.when(value.rlike(r"\A[+-]?[0-9]{1,18}\..*"), F.concat(grouped(F.substring_index(value, ".", 1)), F.substring(value, F.instr(value, "."), F.length(value))))
    ways = [x for form in (whole, decimal) for x in (*[F.concat(F.lit(s), form) for s in CURRENCIES], F.when(form != value, form))]
    return F.array_compact(F.array(*ways, value))


def deletion_labels(rows: DataFrame, answer: str, response: str, reduced: str, tagged: str, marked: str, deleted: str) -> DataFrame:
    """rows(answer, response, reduced: the response without what was deleted, tagged, marked: array of struct(tag, path, original_value, label_type), deleted: array of paths) -> with labels and output.

    Each marked value that is no leaf of the reduced response is labelled at its place and at all others, as whole words. Then deleted
    values that no mark names, in the first of signed_forms that the answer holds, unless they still stand in the reduced response; one
    that is not there lengthens the label of a mark of the same parent to the end of its paragraph. Last, list items of the answer that
    hold no value of the original response. If no marked value has a place, the labels are those of editing.deletion_spans.
    """
    d = editing.deletion_spans(rows, response, tagged, marked, deleted).withColumnsRenamed({"labels": "_else", "plain": "_plain"})

    def one(r: str | None, left: str | None, gone: list[str | None] | None) -> tuple:
        before = json_tree.leaf_list(r)
        return editing.long_values(before), editing.long_values(json_tree.leaf_list(left)), editing.values_of(before, gone)

    d = json_tree.with_columns(d, {"_known": "array<string>", "_kept": "array<string>", "_gone": "array<struct<path:string,value:string>>"}, [response, reduced, deleted], one)
    text, ctx = F.col(answer), F.lower(F.coalesce(F.col(reduced), F.lit("")))
    d = d.withColumns({"_kept": F.transform("_kept", F.lower), "_known": F.array_distinct(F.transform("_known", F.lower))})
    at = F.transform(marked, lambda x: F.struct(x["path"].alias("path"), x["original_value"].alias("value"), F.coalesce(x["label_type"], F.lit("")).alias("kind"), located(text, x["original_value"]).alias("l")))
    d = d.withColumn("_at", F.filter(F.coalesce(at, F.array().cast("array<struct<path:string,value:string,kind:string,l:struct<start:int,end:int,text:string>>>")), lambda y: y["l"].isNotNull()))
    d = d.withColumn("_any", F.size("_at") > 0)
    d = d.withColumn("_at", F.filter("_at", lambda y: ~((F.length(y["value"]) > 2) & F.array_contains("_kept", F.lower(y["value"])))))
    d = d.withColumn("_words", F.transform("_at", lambda y: grown(text, y["l"]["start"], y["l"]["end"], numbers=False)))
    named = F.coalesce(F.transform(marked, lambda x: x["path"]), F.array().cast("array<string>"))
    lost = F.filter("_gone", lambda x: ~F.coalesce(F.array_contains(named, x["path"]), F.lit(False)) & ~ctx.contains(F.lower(x["value"])))
    d = d.withColumn("_lost", lost)
    wanted = F.concat(F.transform("_words", lambda w: spans.cut(text, w["start"], w["end"])), F.flatten(F.transform("_lost", lambda x: signed_forms(x["value"]))))
    d = editing.found_in(d.withColumn("_wanted", F.array_distinct(wanted)), answer, "_wanted", "_found")
    places = lambda t: all_places(F.col("_found"), t)
    cut = lambda s, e: spans.cut(text, s, e)

    owned = lambda x, path=None: x.withField("path", (F.lit(None) if path is None else path).cast("string"))

    def of_mark(y: Column, w: Column) -> Column:
        def both(part: Column) -> Column:
            others = F.transform(places(part), lambda p: owned(label(p, p + F.length(part), cut(p, p + F.length(part)), note(y["kind"], "Span", part), y["kind"], null=True)))
            main = F.array(owned(label(w["start"], w["end"], part, note(y["kind"], "Span", y["value"]), y["kind"]), y["path"]))
            return F.when(F.length(part) > 2, F.concat(main, others)).otherwise(main)

        return bound(cut(w["start"], w["end"]), both)

    form = lambda x: F.get(F.filter(signed_forms(x["value"]), lambda v: F.size(places(v)) > 0), 0)
    first_of = lambda x: bound(form(x), lambda v: F.when(v.isNotNull(), bound(places(v)[0], lambda p: F.struct(p.alias("start"), (p + F.length(v)).alias("end")))))
    d = d.withColumn("_lost", F.transform("_lost", lambda x: F.struct(x["path"].alias("path"), first_of(x).alias("s"))))
    kind = f"array<{LABEL[:-1]},path:string>>"
    d = d.withColumn("_first", F.coalesce(apart(F.flatten(F.zip_with("_at", "_words", of_mark))), F.array()).cast(kind))
    until = lambda s: (s["end"] + F.length(F.substring_index(F.substring(text, s["end"] + 1, F.length(text)), "\n\n", 1))).cast("int")

    def of_lost(acc: Column, x: Column) -> Column:
        """Its own label if it has a free place; without a place, the first mark of its parent reaches to the end of its paragraph."""
        new = owned(label(x["s"]["start"], x["s"]["end"], cut(x["s"]["start"], x["s"]["end"]), F.concat(F.lit("BASELESS_INFO\nPath (deleted): "), x["path"]), F.lit("Baseless Info"), null=True))
        up = F.regexp_replace(x["path"], r"\.[^.]+\z", "")
        owner = F.get(F.filter(acc, lambda s: F.coalesce((s["path"] == up) | s["path"].startswith(F.concat(up, F.lit("."))), F.lit(False))), 0)["path"]
        grow = F.transform(acc, lambda s: F.when(F.coalesce(s["path"] == owner, F.lit(False)), s.withField("text", cut(s["start"], until(s))).withField("end", until(s))).otherwise(s))
        return F.when(x["s"].isNull(), grow).when(editing.free(acc, x["s"]["start"], x["s"]["end"]), F.array_append(acc, new)).otherwise(acc).cast(kind)

    d = d.withColumn("_marks", F.aggregate("_lost", F.col("_first"), of_lost))
    plain = lambda x: F.struct(*[x[n].alias(n) for n in ("start", "end", "text", "meta", "label_type", "implicit_true", "due_to_null")]).cast(LABEL)
    made_up = F.transform(fabricated_blocks(text, F.col("_known")), lambda b: label(b["start"], b["end"], cut(b["start"], b["end"]), F.lit("BASELESS_INFO\nFabricated block — no value from original tool response"), F.lit("Baseless Info"), null=True))
    free = F.filter(made_up, lambda b: editing.free(F.col("_marks"), b["start"], b["end"]))
    own = F.array_sort(F.concat(F.transform("_marks", plain), free), lambda a, b: a["start"] - b["start"])
    d = d.withColumn("labels", F.when(F.col("_any"), own).otherwise(F.col("_else"))).withColumn("output", F.when(F.col("_any") | (F.size("_else") == 0), text).otherwise(F.col("_plain")))
    return d.drop("_else", "_plain", "_gone", "_kept", "_known", "_at", "_any", "_words", "_lost", "_wanted", "_found", "_first", "_marks")


def comment_labels(answer: Column, comment: Column) -> Column:
    """The label of a comment added to an answer."""
    made = editing.comment_spans(answer, comment, F.lit(""))
    return F.transform(made, lambda s: label(s["start"], s["end"], s["text"], F.concat(F.lit("OVERGENERATION\n"), s["text"]), F.lit("Overgeneration")))


def stored_labels(labels: Column, text: Column) -> Column:
    """Labels made before (start, end, text, meta, label_type, implicit_true, due_to_null), with their defaults; those without a place and those over more than half of the text go."""
    good = F.filter(labels, lambda x: (F.coalesce(x["start"], F.lit(-1)) >= 0) & ((F.length(text) == 0) | (2 * (x["end"] - x["start"]) <= F.length(text))))
    return F.transform(good, lambda x: label(x["start"], x["end"], F.coalesce(x["text"], F.lit("")), F.coalesce(x["meta"], F.lit("")), F.coalesce(x["label_type"], F.lit(CONFLICT))).withField("implicit_true", F.coalesce(x["implicit_true"], F.lit(False))).withField("due_to_null", F.coalesce(x["due_to_null"], F.lit(False))))


def placed_labels(found: Column) -> Column:
    """Labels of a budgeted deletion's spans, which have their places."""
    return F.transform(found, lambda s: label(s["start"], s["end"], s["text"], F.concat(F.lit("BASELESS_INFO\nSpan: "), s["text"]), F.lit("Baseless Info"), null=True))


# Dialogues

NUMBER = r"[¥$€£₹]?[0-9,]+(?:\.[0-9]+)?"


def unknown_numbers(text: Column, context: Column) -> Column:
    """struct(start, end) of numbers of over two digits, commas and signs aside, that a context doesn't hold in any writing."""
    plain = lambda c: F.regexp_replace(c, r"[,¥$€£₹]", "")
    known = F.transform(F.regexp_extract_all(context, F.lit(f"({NUMBER})"), F.lit(1)), plain)
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)).alias("n"), F.split(text, NUMBER, -1).alias("before"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,n:string>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        end = start + F.length(p["n"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"), p["n"].alias("n"))).alias("found"))

    found = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda acc: acc["found"])
    return F.transform(F.filter(found, lambda x: (F.length(plain(x["n"])) > 2) & ~F.array_contains(known, plain(x["n"]))), lambda x: F.struct(x["start"], x["end"]))


def keywords(targets: Column) -> Column:
    """Words of field paths: parts between dots, underscores, digits and humps; lower case, over three letters."""
    parts = F.flatten(F.transform(targets, lambda t: F.split(F.regexp_replace(t, r"([a-z])(?=[A-Z])|[._]|[0-9]+", "$1 "), r" +")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: F.length(p) > 3))


def keyword_lines(text: Column, words: Column, context: Column) -> Column:
    """struct(start, end) of the first line for each keyword that holds it and a word of five letters or more that the context doesn't."""
    lines = F.split(text, "\n", -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("found"))
    placed = F.aggregate(lines, zero, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["found"], F.struct(acc["at"].alias("start"), x.alias("line"))).alias("found")), lambda acc: acc["found"])
    new = lambda x: F.exists(F.regexp_extract_all(F.lower(x["line"]), F.lit(r"\b([a-z]{5,})\b"), F.lit(1)), lambda w: ~context.contains(w))
    first = lambda k: F.get(F.filter(placed, lambda x: F.lower(x["line"]).contains(k) & new(x)), 0)
    trimmed = lambda x: F.struct((x["start"] + F.length(F.regexp_extract(x["line"], r"\A\s*", 0))).cast("int").alias("start"), (x["start"] + F.length(F.regexp_replace(x["line"], r"\s+\z", ""))).cast("int").alias("end"))
    return F.transform(F.filter(F.transform(words, first), lambda x: x.isNotNull()), trimmed)


def _word(text: Column, context: Column) -> Column:
    """Whether a text stands in a context (lower case) as a whole word."""
    quoted = F.concat(F.lit("\\b\\Q"), F.replace(F.lower(text), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    return F.regexp_like(context, quoted)


#: Label of an edited dialogue by its kind.
DIALOGUE_LABELS = {"type1": CONFLICT, "type2": BASELESS, "type3": "Overgeneration"}


def dialogue_rows(rows: DataFrame, messages: str, kind: str, targets: str, system: str) -> DataFrame:
    """rows(messages: array of struct(role, content) whose last marked answer holds <hall> tags, kind: type1, type2 or type3 and what follows a _, targets: array of deleted or changed paths, system) -> with query, context, output, labels, input_str and refused.

    The last assistant message with tags (or else the last) is the answer, the tool message before it the context, the user's before
    that the query; tags are taken out and their places kept. type1: a tagged text that is still in the context as a word goes; others
    grow to whole words and count at all places. type2: the same, but a longer text that is still in the context moves to its last
    place, a short word that is goes, and texts that the context holds anywhere count at one place only. One tag around the whole answer
    stands for an edit that wasn't quoted: the answer's numbers that the context doesn't hold count instead, or (type2) the first line
    for each word of the targets' names with something new in it. refused: no_answer, or no_labels for a type1 or type2 that has none
    left; null for rows to export.
    """
    c = F.col(messages)
    tagged = last_index(c, lambda m: (m["role"] == "assistant") & m["content"].contains("<hall>"))
    at = F.coalesce(tagged, last_index(c, lambda m: m["role"] == "assistant"))
    d = rows.withColumn("_at", at)
    before = F.slice(c, F.lit(1), F.col("_at"))
    tool = last_index(before, lambda m: m["role"] == "tool")
    d = d.withColumn("_tool", tool).withColumn("_user", last_index(F.slice(c, F.lit(1), F.col("_tool")), lambda m: m["role"] == "user"))
    content = lambda i: F.coalesce(F.get(c, i)["content"], F.lit(""))
    d = d.withColumns({"query": content(F.col("_user")), "context": content(F.col("_tool")), "_r": tag_spans(content(F.col("_at")), "hall")})
    # What goes through found_in to Python and back is kept small.
    d = d.withColumns({"output": F.col("_r.text"), "_spans": F.col("_r.spans"), "_kind": F.substring_index(F.coalesce(F.col(kind), F.lit("")), "_", 1)}).drop("_r", "_tool", "_user")
    text, ctx = F.col("output"), F.lower(F.col("context"))
    d = d.withColumn("_words", F.transform("_spans", lambda s: whole_words(text, s["start"], s["end"])))
    wanted = F.array_distinct(F.concat(F.transform("_spans", lambda s: s["text"]), F.transform("_words", lambda w: spans.cut(text, w["start"], w["end"]))))
    d = editing.found_in(d.withColumn("_wanted", wanted), "output", "_wanted", "_found")
    places = lambda t: all_places(F.col("_found"), t)
    stretch = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    whole = (F.size("_spans") == 1) & (F.col("_spans")[0]["start"] == 0) & (F.col("_spans")[0]["end"] >= F.length(text) - 2)
    numbers = unknown_numbers(text, F.col("context"))
    words = keywords(F.coalesce(F.col(targets), F.array().cast("array<string>")))
    named = (F.size(words) == 0) | F.exists(words, lambda k: F.lower(text).contains(k))
    unquoted = F.when(F.col("_kind") == "type1", numbers).when(~named, empty).when(F.size(numbers) > 0, numbers).otherwise(keyword_lines(text, words, ctx))
    as_is = F.transform("_spans", lambda s: stretch(s["start"], s["end"]))
    each = lambda t: F.transform(places(t), lambda p: stretch(p, p + F.length(t)))

    def first(s: Column, w: Column) -> Column:
        part = spans.cut(text, w["start"], w["end"])
        gone = (F.length(s["text"]) > 2) & _word(s["text"], ctx)
        others = F.when(F.length(part) > 2, each(part)).otherwise(empty)
        return F.when(gone, empty).otherwise(F.concat(F.array(stretch(w["start"], w["end"])), others))

    def moved(s: Column, w: Column) -> Column:
        short = (F.length(s["text"]) <= 8) & s["text"].rlike(r"\A[a-zA-Z\s]+\z")
        last = F.element_at(places(s["text"]), -1)
        return F.when(_word(s["text"], ctx) & short, empty).when(_word(s["text"], ctx), F.array(stretch(last, last + F.length(s["text"])))).otherwise(F.array(stretch(w["start"], w["end"])))

    def again(s: Column) -> Column:
        lettered = (F.length(s["text"]) <= 8) & s["text"].rlike(r"\A[a-zA-Z ]+\z")
        edge = lambda x: spans.cut(text, x["start"] - 1, x["start"]).rlike(r"\A\w") & (x["start"] > 0) | spans.cut(text, x["end"], x["end"] + 1).rlike(r"\A\w")
        own = F.filter(each(s["text"]), lambda x: ~lettered | ~edge(x))
        return F.when((F.length(s["text"]) > 2) & ~ctx.contains(F.lower(s["text"])), own).otherwise(empty)

    moved_all = F.flatten(F.zip_with("_spans", "_words", moved))
    type2 = F.concat(F.when(F.size(moved_all) > 0, moved_all).otherwise(as_is), F.flatten(F.transform("_spans", again)))
    type1 = F.flatten(F.zip_with("_spans", "_words", first))
    marked = F.size("_spans") > 0
    chosen = F.when(~marked | ~F.col("_kind").isin("type1", "type2"), as_is).when(whole, unquoted).when(F.col("_kind") == "type1", type1).otherwise(type2)
    d = d.withColumn("_chosen", chosen).withColumn("_kept", F.array_sort(apart(F.col("_chosen"))))
    names = F.create_map(*[F.lit(x) for kv in DIALOGUE_LABELS.items() for x in kv])
    shown = F.coalesce(F.try_element_at(names, F.col("_kind")), F.lit(CONFLICT))
    made = F.transform("_kept", lambda s: label(s["start"], s["end"], spans.cut(text, s["start"], s["end"]), F.concat(F.upper(shown), F.lit("\nMultistep dialogue ("), F.col(kind), F.lit(")")), shown).withField("due_to_null", F.col(kind) == "type2"))
    refused = F.when(F.col("_at").isNull(), "no_answer").when(F.col("_kind").isin("type1", "type2") & (F.size("_kept") == 0), "no_labels")
    turns = F.transform(F.slice(c, F.lit(1), F.col("_at")), lambda m: F.concat(F.initcap(F.coalesce(m["role"], F.lit("?"))), F.lit(":\n"), F.coalesce(m["content"], F.lit(""))))
    head = F.when(F.coalesce(F.length(F.col(system)), F.lit(0)) > 0, F.array(F.concat(F.lit("System:\n"), F.col(system)))).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({"labels": made, "refused": refused, "input_str": F.array_join(F.concat(head, turns), "\n\n")})
    return d.drop("_at", "_spans", "_kind", "_words", "_wanted", "_found", "_chosen", "_kept")


def exported(rows: DataFrame, number: str, query: str, context: str, output: str, kind: Column, labels: str, history: Column, *keep: Column) -> DataFrame:
    """The eleven columns of an exported row: id, query, context, output, task_type, quality, model, temperature, hallucination_labels and hallucination_labels_processed (JSON), input_str; and behind them what of the row is to be kept."""
    counts = F.create_map(F.lit("evident_conflict"), counted(F.col(labels), CONFLICT), F.lit("baseless_info"), counted(F.col(labels), BASELESS) + counted(F.col(labels), "Baseless Info"), F.lit("overgeneration"), counted(F.col(labels), "Overgeneration"))
    return rows.select(F.col(number).alias("id"), F.col(query).alias("query"), F.col(context).alias("context"), F.col(output).alias("output"), kind.alias("task_type"), F.lit("good").alias("quality"), F.lit("").alias("model"), F.lit("").alias("temperature"), F.to_json(labels).alias("hallucination_labels"), F.to_json(counts).alias("hallucination_labels_processed"), history.alias("input_str"), *keep)
