"""Examples for training and export: transcripts, supervised messages, calls as text, located values, label filters and flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.json_tree import first_json
from spanloom.functions.text import bound
from spanloom.operators import spans
from spanloom.operators.dialogue import last_index

#: Headings of a transcript's turns.
HEADINGS = {"user": "User", "tool_call": "Assistant tool call", "tool_response": "Tool response", "final_answer": "Assistant (earlier turn)"}
CURRENCIES = ("$", "€", "£", "¥", "₹")


def history_text(conversations: Column) -> Column:
    """### heading and value of each turn, a blank line between; unknown roles are their own heading, empty ones a question mark."""
    names = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    heading = lambda t: F.coalesce(F.try_element_at(names, t["turn_role"]), F.nullif(t["turn_role"], F.lit("")), F.lit("?"))
    return F.array_join(F.transform(conversations, lambda t: F.concat(F.lit("### "), heading(t), F.lit("\n"), F.coalesce(t["value"], F.lit("")))), "\n\n")


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def target_json(kind: Column, labels: Column) -> Column:
    """{"type": ..., "spans": [{"start": ..., "end": ..., "text": ...}]} with a space behind commas and colons."""
    one = lambda s: F.concat(F.lit('{"start": '), s["start"].cast("string"), F.lit(', "end": '), s["end"].cast("string"), F.lit(', "text": '), _quoted(s["text"]), F.lit("}"))
    return F.concat(F.lit('{"type": '), _quoted(kind), F.lit(', "spans": ['), F.array_join(F.transform(labels, one), ", "), F.lit("]}"))


def supervised_examples(rows: DataFrame, system_prompt: str) -> DataFrame:
    """rows(dialogue_id, type, label, subset, system, conversations, span_labels) -> messages and the row's figures.

    History is what comes before the last final answer; without one, all turns are history and the answer is empty.
    """
    c = F.col("conversations")
    at = last_index(c, lambda t: t["turn_role"] == "final_answer")
    history = F.when(at.isNull(), c).otherwise(F.slice(c, F.lit(1), at))
    answer = F.coalesce(F.get(c, at)["value"], F.lit(""))
    asked = F.concat(F.lit("## Tool definitions (from the assistant's system prompt)\n"), F.coalesce("system", F.lit("")), F.lit("\n\n## Conversation history\n"), history_text(history), F.lit("\n\n## Assistant final answer (to analyze)\n"), answer, F.lit("\n\nAnalyze the final answer above for errors."))
    make = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    messages = F.array(make("system", F.lit(system_prompt)), make("user", asked), make("assistant", target_json(F.col("type"), F.col("span_labels"))))
    return rows.select(messages.alias("messages"), "dialogue_id", "type", F.col("label").cast("int").alias("label"), "subset", F.size("span_labels").alias("n_spans"), F.size(history).alias("n_history_turns"))


def call_text(c: Column) -> Column:
    """A JSON list of calls, or one call, as lines of name(arguments); any other text stays. Arguments are compact JSON."""
    v = F.try_parse_json(c)
    get = lambda x, path, kind: F.call_function("try_variant_get", x, F.lit(path), F.lit(kind))
    listed = get(v, "$", "array<variant>")
    line = lambda x: F.concat(F.coalesce(get(x, "$.name", "string"), F.lit("?")), F.lit("("), F.coalesce(get(x, "$.arguments", "string"), F.lit("{}")), F.lit(")"))
    calls = F.filter(F.coalesce(listed, F.array(v)), lambda x: F.call_function("schema_of_variant", x).startswith("OBJECT"))
    return F.when(v.isNotNull() & (F.size(calls) > 0), F.array_join(F.transform(calls, line), "\n")).otherwise(c)


def prediction_code(c: Column) -> Column:
    """Why a model's output has no verdict: empty_output, no_json_object_found, unbalanced_or_truncated_json, missing_type_field; null if it has one."""
    found = first_json(c)
    kind = F.call_function("try_variant_get", F.try_parse_json(found), F.lit("$.type"), F.lit("variant"))
    return F.when(~F.coalesce(c, F.lit("")).rlike(r"\S"), "empty_output").when(found.isNull() & c.contains("{"), "unbalanced_or_truncated_json").when(found.isNull(), "no_json_object_found").when(kind.isNull(), "missing_type_field")


def support_label(c: Column) -> Column:
    """Lower case and trimmed; label_0 is supported, label_1 unsupported."""
    plain = F.lower(F.trim(c))
    return F.when(plain == "label_0", "supported").when(plain == "label_1", "unsupported").otherwise(plain)


def sentence_table(rows: DataFrame, key: str, items: str) -> DataFrame:
    """rows(key, items: array of struct(label, score, sentence)) -> key, label (1 if any sentence isn't supported), score, counts, and the sentences as one text. A row without sentences has a null score."""
    count = lambda k: F.size(F.filter(items, lambda x: x["label"] == k))
    shown = F.array_join(F.transform(items, lambda x: F.concat(x["label"], F.lit(" ("), x["score"].cast("string"), F.lit("): "), x["sentence"])), "\n\n")
    bad = (count("unsupported") > 0) | (count("contradicted") > 0)
    return rows.select(key, bad.cast("int").alias("label"), F.try_divide(count("supported"), F.size(items)).alias("faithfulness_score"), *[count(k).alias(f"{k}_count") for k in ("supported", "unsupported", "contradicted")], shown.alias("faithfulness_eval_text"))


def paired(pred: DataFrame, gold: DataFrame, index: str, pred_spans: str, gold_spans: str) -> DataFrame:
    """index, pred and gold spans as JSON of the rows that both sides have: the shorter side's length counts."""
    left, right = pred.select(index, F.to_json(pred_spans).alias("pred")), gold.select(index, F.to_json(gold_spans).alias("gold"))
    return left.join(right, index)


def _tagged(c: Column, pattern: str, groups: tuple[str, ...], shown: int) -> Column:
    """struct(text, spans): the text with each match of the pattern replaced by one of its groups, and where these stand, with all groups by name."""
    found = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)) for i in range(len(groups))]
    fields = "".join(f",{g}:string" for g in groups)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<start:int,end:int{fields}>>").alias("spans"))
    # What stands before each match goes along with it: split inside the fold would be done again for every match.
    zipped = F.arrays_zip(*[x.alias(g) for x, g in zip(found, groups, strict=True)], F.split(c, pattern, -1).alias("before"))

    def step(acc: Column, m: Column) -> Column:
        part = m[groups[shown]]
        a = acc["at"] + F.length(m["before"])
        one = F.struct(a.alias("start"), (a + F.length(part)).alias("end"), *[m[g].alias(g) for g in groups])
        return F.struct((a + F.length(part)).alias("at"), F.array_append(acc["spans"], one).alias("spans"))

    matches = F.slice(zipped, F.lit(1), F.greatest(F.size(zipped) - 1, F.lit(0)))
    return F.struct(F.regexp_replace(c, F.lit(pattern), F.lit(f"${shown + 1}")).alias("text"), F.aggregate(matches, start, step, lambda acc: acc["spans"]).alias("spans"))


def data_spans(c: Column) -> Column:
    """struct(text, spans) of a text with <DATA val="value">shown</DATA>: spans hold start, end, source_value and text."""
    return _tagged(c, r'(?s)<DATA\s+val="([^"]*)">(.*?)</DATA>', ("source_value", "text"), 1)


def key_spans(c: Column) -> Column:
    """struct(text, spans) of a text with [key]value[/key]: spans hold start, end, key and value."""
    return _tagged(c, r"(?s)\[(\w+)\](.*?)\[/\1\]", ("key", "value"), 1)


def apart(labels: Column) -> Column:
    """Spans in their order, each only if it overlaps none taken before it."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), acc).otherwise(F.array_append(acc, s))

    return F.aggregate(labels, F.slice(labels, 1, 0), step)


def covers_half(labels: Column, answer: Column) -> Column:
    """Whether a span covers half of the answer or more; false for an empty answer."""
    return F.coalesce((F.length(answer) > 0) & F.exists(labels, lambda s: 2 * (s["end"] - s["start"]) >= F.length(answer)), F.lit(False))


def whole_lines(answer: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the lines that a span stands in."""
    before, behind = F.substring(answer, F.lit(1), start), F.substring(answer, end + 1, F.length(answer))
    first = start - F.length(F.substring_index(before, "\n", -1))
    return F.struct(first.cast("int").alias("start"), (end + F.length(F.substring_index(behind, "\n", 1))).cast("int").alias("end"))


def whole_words(answer: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a span grown over the letters that touch it."""
    before, behind = F.substring(answer, F.lit(1), start), F.substring(answer, end + 1, F.length(answer))
    grow = lambda c, pattern: F.length(F.regexp_extract(c, pattern, 0))
    return F.struct((start - grow(before, r"\p{L}*\z")).cast("int").alias("start"), (end + grow(behind, r"\A\p{L}*")).cast("int").alias("end"))


def located(answer: Column, value: Column) -> Column:
    """struct(start, end, text) of a value in an answer by the first way that finds it: as it is; a whole number with commas, also behind a currency sign; a decimal with commas; in any case; a date without its time. Null if none does."""
    whole = F.when(value.rlike(r"\A[+-]?[0-9]{1,18}\z"), F.format_number(value.try_cast("bigint"), 0))
    head, tail = F.substring_index(value, ".", 1), F.substring(value, F.instr(value, ".") + 1, F.length(value))
    decimal = F.when(value.rlike(r"\A[+-]?[0-9]{1,18}\.[0-9]+\z"), F.concat(F.format_number(head.try_cast("bigint"), 0), F.lit("."), tail))
    date = F.when(value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.substring(value, 1, 10))

    def at(part: Column, where: Column = answer) -> Column:
        place = F.instr(where, part) - 1
        return F.when((F.length(part) > 0) & (place >= 0), F.struct(place.alias("start"), (place + F.length(part)).alias("end")))

    low = F.when(F.length(F.lower(answer)) == F.length(answer), at(F.lower(value), F.lower(answer)))  # offsets hold only where case doesn't change the length
    ways = [at(value), at(whole), *[at(F.concat(F.lit(sign), whole)) for sign in CURRENCIES], at(decimal), low, at(date)]
    return bound(F.coalesce(*ways), lambda found: F.when(found.isNotNull(), F.struct(found["start"].alias("start"), found["end"].alias("end"), spans.cut(answer, found["start"], found["end"]).alias("text"))))


def explicit(labels: Column) -> Column:
    """Labels that are not implicit and not empty."""
    return F.filter(labels, lambda x: ~F.coalesce(x["implicit_true"], F.lit(False)) & (F.coalesce(x["end"], F.lit(0)) > F.coalesce(x["start"], F.lit(-1))))


def is_flawed(flag: Column, labels: Column) -> Column:
    """Whether a row counts as flawed: by its flag, or where it has none, by an explicit label."""
    return F.coalesce(flag == 1, F.size(explicit(labels)) > 0)


def ends_elsewhere(output: Column, labels: Column) -> Column:
    """Whether a label that is not implicit ends before the output does."""
    return F.exists(labels, lambda x: ~F.coalesce(x["implicit_true"], F.lit(False)) & ~x["end"].eqNullSafe(F.length(output)))


def tagger_samples(rows: DataFrame, dataset: str) -> DataFrame:
    """rows(query, context, output, labels, flag, task_type) -> prompt, answer, labels, split, task_type, dataset, language; rows without an output are left out, and so are labels that are implicit or not inside it."""
    query, context = (F.coalesce(c, F.lit("")) for c in ("query", "context"))
    prompt = F.when(query != "", F.trim(F.concat(query, F.lit("\n\n"), context))).otherwise(context)
    inside = F.filter(explicit(F.col("labels")), lambda x: (x["start"] >= 0) & (x["end"] <= F.length("output")))
    held = F.when(F.coalesce(F.col("flag") == 1, F.lit(True)), inside).otherwise(F.slice(inside, 1, 0))
    marked = F.transform(held, lambda x: F.struct(x["start"], x["end"], F.lit("hallucination").alias("label")))
    d = rows.where(F.coalesce(F.length("output"), F.lit(0)) > 0)
    return d.select(prompt.alias("prompt"), F.col("output").alias("answer"), marked.alias("labels"), F.lit("train").alias("split"), F.coalesce("task_type", F.lit("")).alias("task_type"), F.lit(dataset).alias("dataset"), F.lit("en").alias("language"))


def single_call(messages: Column, is_call) -> Column:
    """Whether a dialogue holds exactly one call."""
    return F.size(F.filter(messages, is_call)) == 1


def gold_spans(messages: Column) -> Column:
    """struct(start, end) of the spans in the first JSON object of the last message, if that is the assistant's: those with whole numbers and the end behind the start. Empty if there is none."""
    get = lambda x, path, kind: F.call_function("try_variant_get", x, F.lit(path), F.lit(kind))
    last = F.try_element_at(messages, F.lit(-1))
    listed = get(F.try_parse_json(first_json(F.when(last["role"] == "assistant", last["content"]))), "$.spans", "array<variant>")
    whole = lambda x, name: F.when(F.call_function("schema_of_variant", get(x, name, "variant")) == "BIGINT", get(x, name, "bigint"))
    read = F.transform(listed, lambda x: F.struct(whole(x, "$.start").alias("start"), whole(x, "$.end").alias("end")))
    return F.coalesce(F.filter(read, lambda s: F.coalesce(s["end"] > s["start"], F.lit(False))), F.array().cast("array<struct<start:bigint,end:bigint>>"))
