"""Rows in and out: dialogues to samples, unified rows, examples, verdict checks and gates. Messages are arrays of struct(role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.json_tree import flatten_all, flatten_items
from spanloom.operators import spans
from spanloom.operators.dialogue import last_index, trim_history
from spanloom.operators.metrics import CLASSES, SPAN_CLASSES

#: Names of the classes where rows are made, by their class in the data.
MADE_CLASSES = {"correct": "clean", "hallucination": "answer_mismatch", "overgeneration": "overgeneration", "missing_tool": "missing_tool", "undergeneration": "undergeneration"}


def normalized_messages(conversations: Column | None, messages: Column | None) -> Column:
    """struct(role, content, original_index) of conversations (from, value), or else of messages (role, content); roles trimmed and in lower case."""

    def taken(c: Column, role: str, content: str) -> Column:
        return F.transform(c, lambda m, i: F.struct(F.lower(F.trim(F.coalesce(m[role].cast("string"), F.lit("")))).alias("role"), F.coalesce(m[content].cast("string"), F.lit("")).alias("content"), i.alias("original_index")))

    found = [taken(c, *names) for c, names in ((conversations, ("from", "value")), (messages, ("role", "content"))) if c is not None]
    return F.coalesce(*found)


def marked_conversations(messages: Column) -> Column:
    """struct(from, value, turn_role); the last assistant message is the final answer."""
    last = F.coalesce(last_index(messages, lambda m: m["role"] == "assistant"), F.lit(-1))
    return F.transform(messages, lambda m, i: F.struct(F.coalesce(m["role"], F.lit("")).alias("from"), F.coalesce(m["content"], F.lit("")).alias("value"), F.when(i == last, "final_answer").otherwise("").alias("turn_role")))


def final_answer(conversations: Column, fallback: bool = True) -> Column:
    """The last final answer; with fallback, else the last assistant message. Null if there is none."""
    marked = last_index(conversations, lambda t: t["turn_role"] == "final_answer")
    last = F.coalesce(marked, last_index(conversations, lambda t: t["from"] == "assistant")) if fallback else marked
    return F.get(conversations, last)["value"]


def gold_answer(answer: Column, conversations: Column) -> Column:
    """The answer if it isn't empty, else the last final answer, else an empty text."""
    return F.coalesce(F.nullif(answer, F.lit("")), final_answer(conversations, fallback=False), F.lit(""))


def exported_turn(conversations: Column) -> Column:
    """struct(question, tool_values, answer): the last final answer, or without one the first assistant message; the user message before it and the tool values between. Null without an answer."""
    at = F.coalesce(last_index(conversations, lambda t: t["turn_role"] == "final_answer"), F.array_min(F.transform(conversations, lambda t, i: F.when(t["from"] == "assistant", i))))
    user = last_index(F.slice(conversations, F.lit(1), at), lambda t: t["from"] == "user")
    first = F.coalesce(user, F.lit(-1))
    tools = F.transform(F.filter(F.slice(conversations, first + 2, at - first - 1), lambda t: t["from"] == "tool"), lambda t: t["value"])
    return F.when(at.isNotNull(), F.struct(F.coalesce(F.get(conversations, user)["value"], F.lit("")).alias("question"), tools.alias("tool_values"), F.get(conversations, at)["value"].alias("answer")))


def target_examples(rows: DataFrame) -> DataFrame:
    """rows(dialogue_id, conversations, type, label, span_labels, split) -> dialogue_id, query, contexts, context, output, gold_type, gold_label, gold_spans, row_split.

    The last assistant message, the user message before it and the flattened tool values between. Rows without an assistant message have null texts.
    """
    c = F.col("conversations")
    at = last_index(c, lambda t: t["from"] == "assistant")
    user = last_index(F.slice(c, F.lit(1), at), lambda t: t["from"] == "user")
    first = F.coalesce(user, F.lit(-1))
    tools = F.transform(F.filter(F.slice(c, first + 2, at - first - 1), lambda t: t["from"] == "tool"), lambda t: t["value"])
    good = F.transform(spans.valid_order(F.coalesce("span_labels", F.array().cast(rows.schema["span_labels"].dataType))), lambda s: F.struct(s["start"], s["end"], F.coalesce(s["text"], F.lit("")).alias("text")))
    d = rows.withColumn("tool_values", F.when(at.isNotNull(), tools)).withColumn("contexts", F.when(F.size("tool_values") > 0, flatten_all("tool_values")).otherwise(F.col("tool_values")))
    query = F.when(at.isNotNull(), F.coalesce(F.get(c, user)["value"], F.lit("")))
    return d.select("dialogue_id", query.alias("query"), "contexts", F.array_join("contexts", "\n\n").alias("context"), F.get(c, at)["value"].alias("output"), F.col("type").alias("gold_type"), F.col("label").alias("gold_label"), good.alias("gold_spans"), F.col("split").alias("row_split"))


#: Columns that flat rows may use for each field of an example, the first that isn't null counts.
ALIASES = {
    "query": ("query", "question", "prompt", "user_prompt"),
    "output": ("output", "answer", "final_answer", "response"),
    "contexts": ("contexts", "context", "tool_contexts", "tool_response"),
    "dialogue_id": ("dialogue_id", "id", "example_id"),
    "gold_type": ("gold_type", "type", "task_type", "class"),
    "gold_label": ("gold_label", "label"),
    "gold_spans": ("gold_spans", "span_labels", "gold"),
    "row_split": ("split", "row_split"),
}


def flat_examples(rows: DataFrame) -> DataFrame:
    """Rows without conversations, under whatever of ALIASES they have -> the columns of target_examples.

    A context column is an array of texts, or a text; a text that is a JSON list has an item for each of its own. Items that are JSON are
    flattened; null and empty contexts have none. Fields without a column are null, texts empty. Spans are an array of structs.
    """
    def first(name: str) -> Column:
        return F.coalesce(*[F.col(c) for c in ALIASES[name] if c in rows.columns], F.lit(None))

    def listed(c: str) -> Column:
        many = rows.schema[c].dataType.simpleString().startswith("array")
        return flatten_all(F.col(c).cast("array<string>")) if many else flatten_items(F.col(c).cast("string"))

    none = F.array().cast("array<string>")
    d = rows.withColumn("_c", F.coalesce(*[listed(c) for c in ALIASES["contexts"] if c in rows.columns], none))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    held = [c for c in ALIASES["gold_spans"] if c in rows.columns]
    span = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), F.coalesce(s["text"].cast("string"), F.lit("")).alias("text"))
    gold = F.coalesce(*[F.transform(spans.valid_order(F.col(c)), span) for c in held], empty)
    text = lambda name: F.coalesce(first(name).cast("string"), F.lit(""))
    return d.select(first("dialogue_id").alias("dialogue_id"), text("query").alias("query"), F.col("_c").alias("contexts"), F.array_join("_c", "\n\n").alias("context"), text("output").alias("output"), first("gold_type").alias("gold_type"), first("gold_label").alias("gold_label"), gold.alias("gold_spans"), first("row_split").alias("row_split"))


def conversation_sample(messages: Column, turns: int = 2) -> Column:
    """struct(history, full_history, query, tool_call, tool_response, answer) of the last tool message that an assistant message follows.

    The call is the last assistant message before it, the query the last user message before the call; history is what came before the
    query, trimmed to its last turns. Only user, assistant and tool messages count. Null where one of them is missing.
    """
    m = F.filter(messages, lambda x: x["role"].isin("user", "assistant", "tool"))
    tool = F.array_max(F.transform(m, lambda x, i: F.when((x["role"] == "tool") & (F.get(m, i + 1)["role"] == "assistant"), i)))
    call = last_index(F.slice(m, F.lit(1), tool), lambda x: x["role"] == "assistant")
    query = last_index(F.slice(m, F.lit(1), call), lambda x: x["role"] == "user")
    before = F.slice(m, F.lit(1), query)
    text = lambda at: F.get(m, at)["content"]
    return F.when(query.isNotNull(), F.struct(trim_history(before, turns).alias("history"), before.alias("full_history"), text(query).alias("query"), text(call).alias("tool_call"), text(tool).alias("tool_response"), text(tool + 1).alias("answer")))


def flat_samples(rows: DataFrame) -> DataFrame:
    """Flat rows with either name of a field -> sample_id, system, query, tool_call, tool_response, answer; rows with an empty one of the last four are left out."""
    have = set(rows.columns)

    def pick(*names: str) -> Column:
        there = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have]
        return F.coalesce(*there, F.lit("")) if there else F.lit("")

    d = rows.select(pick("sample_id", "id").alias("sample_id"), pick("system").alias("system"), pick("user_prompt", "user_query").alias("query"), pick("tool_call").alias("tool_call"), pick("tool_response").alias("tool_response"), pick("original_answer", "answer").alias("answer"))
    return d.where("query <> '' and tool_call <> '' and tool_response <> '' and answer <> ''")


def full_dialogue(system: Column, history: Column, query: Column, call: Column, response: Column, answer: Column) -> Column:
    """All messages of a sample: the system prompt if it isn't empty, the whole history, query, call, response and answer."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    first = F.when(F.coalesce(F.length(system), F.lit(0)) > 0, F.array(one("system", system))).otherwise(F.slice(history, 1, 0))
    return F.concat(first, history, F.array(one("user", query), one("assistant", call), one("tool", response), one("assistant", answer)))


def reconciled(answer: Column, raw: Column) -> Column:
    """struct(spans, codes, broken): spans as they stand, with drifted punctuation taken from the answer, or moved to their only occurrence; any other makes the row's spans broken."""
    coded = F.transform(raw, lambda s: F.struct(spans.reconcile_code(answer, s).alias("code"), s.alias("s")))
    at = lambda s: F.get(spans.occurrences(answer, s["text"]), 0)

    def put(x: Column) -> Column:
        s = x["s"]
        moved = x["code"] == "REANCHORED"
        start = F.when(moved, at(s)).otherwise(s["start"])
        end = F.when(moved, at(s) + F.length(s["text"])).otherwise(s["end"])
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.when(moved, s["text"]).otherwise(spans.cut(answer, s["start"], s["end"])).alias("text"))

    broken = F.exists(coded, lambda x: x["code"] == "BROKEN")
    return F.struct(F.when(~broken, F.transform(coded, put)).alias("spans"), F.transform(coded, lambda x: x["code"]).alias("codes"), broken.alias("broken"))


def unified_rows(rows: DataFrame, subset: str) -> DataFrame:
    """rows(class, full: messages, spans, sample_id, id, system_prompt, tool_call, tool_response, original_tool_response, omitted_items) -> unified rows with code.

    code is null for rows that are kept, else UNKNOWN_CLASS, NO_FINAL_ANSWER or EMPTY_ANSWER; spans_broken marks rows whose spans can't be placed.
    """
    kinds = F.create_map(*[F.lit(x) for kv in MADE_CLASSES.items() for x in kv])
    kind = F.try_element_at(kinds, F.col("class"))
    d = rows.withColumn("made", kind).withColumn("turns", marked_conversations(F.col("full")))
    answer = final_answer(F.col("turns"), fallback=False)
    raw = F.when(F.col("made").isin(*SPAN_CLASSES), F.col("spans"))
    raw = F.coalesce(raw, F.slice("spans", 1, 0), F.array().cast(rows.schema["spans"].dataType))
    d = d.withColumn("answer_text", answer).withColumn("placed", reconciled(F.coalesce("answer_text", F.lit("")), raw))
    code = F.when(F.col("made").isNull(), "UNKNOWN_CLASS").when(F.col("answer_text").isNull(), "NO_FINAL_ANSWER").when(~F.col("answer_text").rlike(r"\S"), "EMPTY_ANSWER")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.coalesce(F.nullif(F.col("sample_id").cast("string"), F.lit("")), text("id"))
    return d.select(
        own.alias("dialogue_id"), text("id").alias("generation_id"), F.lit(subset).alias("subset"), F.col("made").alias("type"), F.when(F.col("made") == "clean", 0).when(F.col("made").isNotNull(), 1).alias("label"),
        text("system_prompt").alias("system"), F.col("turns").alias("conversations"), F.coalesce("placed.spans", F.slice("placed.spans", 1, 0), F.array().cast("array<struct<start:int,end:int,text:string>>")).alias("span_labels"),
        *[text(c).alias(c) for c in ("tool_call", "tool_response", "original_tool_response")], F.coalesce(F.nullif(text("omitted_items"), F.lit("")), F.lit("[]")).alias("omitted_items"),
        F.col("placed.broken").alias("spans_broken"), code.alias("code"),
    )


def placed_once(answer: Column, texts: Column) -> Column:
    """Suggested texts as spans, if each of them stands exactly once in the answer; else, or if there are none, null."""
    at = F.transform(texts, lambda t: spans.occurrences(answer, t))
    fits = (F.size(texts) > 0) & F.forall(at, lambda x: F.size(x) == 1)
    return F.when(fits, F.zip_with(texts, at, lambda t, x: F.struct(F.get(x, 0).alias("start"), (F.get(x, 0) + F.length(t)).alias("end"), t.alias("text"))))


def judged_rows(rows: DataFrame, verdicts: DataFrame, order: str, keep_fail: bool = False, keep_uncertain: bool = False, keep_missing: bool = True, rescue: bool = False) -> DataFrame:
    """rows(dialogue_id, type, label, answer, span_labels, ...), verdicts(dialogue_id, stored_type, row_judgment, type_is_correct, hallucination_present, suggested: texts, order) -> rows with outcome, keep and mended span_labels.

    The last verdict of a row counts. With rescue, a failed row whose class is right and whose suggested texts stand exactly once each
    gets these as spans. One shuffle on (dialogue_id, type).
    """
    fields = ("row_judgment", "type_is_correct", "hallucination_present", "suggested")
    last = verdicts.groupBy("dialogue_id", F.col("stored_type").alias("type")).agg(F.max_by(F.struct(*fields), F.col(order)).alias("verdict"))
    d = rows.join(last, ["dialogue_id", "type"], "left")
    v = F.col("verdict")
    may = F.lit(rescue) & ~F.col("type").isin("clean", "undergeneration") & v["type_is_correct"] & (F.coalesce(v["hallucination_present"], F.lit(False)) == (F.coalesce("label", F.lit(0)) == 1))
    d = d.withColumn("mended", F.when((v["row_judgment"] == "fail") & F.coalesce(may, F.lit(False)), placed_once(F.col("answer"), F.coalesce(v["suggested"], F.array().cast("array<string>")))))
    outcome = F.when(v["row_judgment"].isNull(), "missing_or_error").when(v["row_judgment"].isin("pass", "uncertain"), v["row_judgment"]).when(F.col("mended").isNotNull(), "fail_rescued_spans").otherwise("fail")
    keep = {"pass": True, "fail_rescued_spans": True, "uncertain": keep_uncertain, "fail": keep_fail, "missing_or_error": keep_missing}
    d = d.withColumn("outcome", outcome).withColumn("span_labels", F.coalesce("mended", "span_labels"))
    return d.withColumn("keep", F.col("outcome").isin(*[k for k, yes in keep.items() if yes])).drop("verdict", "mended")


def checked_verdict(v: Column, stored: Column, n_spans: Column) -> Column:
    """struct(valid, reason, span_labels_are_correct, suggested, recommended_type, warnings) of a verdict: values outside the known ones are invalid; an undergeneration row without spans can't have wrong ones."""
    kinds = [*CLASSES, "answer_missmatch", "none"]
    reason = F.when(~F.coalesce(v["row_judgment"].isin("pass", "fail", "uncertain"), F.lit(False)), "BAD_JUDGMENT").when(~F.coalesce(v["recommended_type"].isin(*kinds), F.lit(False)), "BAD_TYPE")
    reason = reason.when(v["hallucination_present"].isNull() | v["type_is_correct"].isNull() | v["span_labels_are_correct"].isNull(), "BAD_BOOLEAN")
    under = (stored == "undergeneration") & (n_spans == 0)
    warnings = F.array_compact(F.array(F.when(under & ~v["span_labels_are_correct"], "SPANS_SET_CORRECT"), F.when(under & (F.size(v["suggested"]) > 0), "SUGGESTED_CLEARED")))
    kind = F.when(v["recommended_type"] == "answer_missmatch", "answer_mismatch").otherwise(v["recommended_type"])
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), (under | v["span_labels_are_correct"]).alias("span_labels_are_correct"), F.when(under, F.slice(v["suggested"], 1, 0)).otherwise(v["suggested"]).alias("suggested"), kind.alias("recommended_type"), warnings.alias("warnings"))


def row_codes(kind: Column, label: Column, answer: Column, labels: Column) -> Column:
    """Codes of what is wrong with a unified row; a row without an answer gets no codes about spans, each span gets its own."""
    head = [
        F.when(~F.coalesce(kind.isin(*CLASSES), F.lit(False)), "BAD_TYPE"),
        F.when((label == 0) != (kind == "clean"), "LABEL_TYPE_MISMATCH"),
        F.when(answer.isNull(), "NO_FINAL_ANSWER"),
        F.when(answer.isNotNull() & kind.isin("clean", "undergeneration") & (F.size(labels) > 0), "EMPTY_SPANS_REQUIRED"),
        F.when(answer.isNotNull() & kind.isin(*SPAN_CLASSES) & (F.size(labels) == 0), "SPANS_REQUIRED"),
    ]

    def one(s: Column) -> Column:
        outside = s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] > F.length(answer)) | (s["start"] > s["end"])
        return F.when(outside, "SPAN_OOR").when(spans.cut(answer, s["start"], s["end"]) != F.coalesce(s["text"], F.lit("")), "SPAN_INVARIANT")

    each = F.when(answer.isNotNull(), F.transform(labels, one)).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(*head), each))


def export_codes(output: Column, labels: Column, suffix: bool = False) -> Column:
    """Codes of what is wrong with an exported row's output and labels struct(start, end, implicit_true): tags left in, no labels, offsets, and with suffix spans that are not at the end or over 1,000 characters."""

    def one(s: Column) -> Column:
        a, b = F.coalesce(s["start"], F.lit(-1)), F.coalesce(s["end"], F.lit(-1))
        wrong = F.when((a < 0) | (b < 0), "NEGATIVE_OFFSET").when(b > F.length(output), "BEYOND_OUTPUT").when(a > b, "START_AFTER_END")
        shown = F.lit(suffix) & ~F.coalesce(s["implicit_true"], F.lit(False))
        return F.array_compact(F.array(wrong, F.when(shown & (b != F.length(output)), "NOT_AT_END"), F.when(shown & (b - a > 1000), "TOO_LONG")))

    head = F.array_compact(F.array(F.when(output.rlike(r"(?i)</?hall\b[^>]*>"), "TAG_LEFT"), F.when(F.coalesce(F.size(labels), F.lit(0)) == 0, "NO_LABELS")))
    return F.concat(head, F.flatten(F.transform(F.coalesce(labels, F.slice(labels, 1, 0)), one)))
