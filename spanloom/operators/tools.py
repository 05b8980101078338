"""Tool calls and tool definitions of dialogues: turns as rows, offered tools, a registry of definitions, and checks of edited values and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import spans
from spanloom.operators.dialogue import is_answer, is_call, is_result
from spanloom.operators.metrics import SPAN_CLASSES

TOOL_LIST = r"(?s)(\[\s*\{.*\}\s*\])"


def turn_rows(rows: DataFrame, key: str, place: str, role: str, content: str) -> DataFrame:
    """Each completed tool turn as a row: key, turn (0-based), turns (of the dialogue), user_prompt, tool_call (the first), tool_response (the last, the first object of a list), original_answer, answer_index."""
    m = F.struct(F.lower(F.trim(F.col(role))).alias("role"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    d = rows.select(key, F.col(place).alias("pos"), m.alias("m")).withColumn("segment", F.sum((F.col("m.role") == "user").cast("int")).over(W.partitionBy(key).orderBy("pos"))).where("segment > 0")
    s = W.partitionBy(key, "segment")
    d = d.withColumn("first_call", F.min(F.when(is_call(F.col("m")), F.col("pos"))).over(s))
    d = d.withColumn("last_result", F.max(F.when(is_result(F.col("m")) & (F.col("pos") > F.col("first_call")), F.col("pos"))).over(s))
    at = lambda test: F.min_by("m.content", F.when(test, F.col("pos")))
    ended = is_answer(F.col("m")) & (F.col("pos") > F.col("last_result"))
    turns = d.groupBy(key, "segment").agg(
        F.min_by("m.content", "pos").alias("user_prompt"),
        at(F.col("pos") == F.col("first_call")).alias("tool_call"),
        at(F.col("pos") == F.col("last_result")).alias("raw"),
        at(ended).alias("original_answer"),
        F.min(F.when(ended, F.col("pos"))).alias("answer_index"),
    )
    done = turns.where("answer_index is not null and tool_call is not null and raw is not null")
    response = F.when(F.trim("raw").startswith("["), F.coalesce(F.get_json_object("raw", "$[0]"), F.col("raw"))).otherwise(F.col("raw"))
    numbered = done.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy("segment")) - 1).withColumn("turns", F.count("*").over(W.partitionBy(key)))
    return numbered.select(key, "turn", "turns", "user_prompt", "tool_call", response.alias("tool_response"), "original_answer", "answer_index")


def pruning_items(turns: DataFrame, key: str) -> DataFrame:
    """key, turn, keep: every turn but the first, and how many messages a dialogue keeps that is pruned after it."""
    return turns.where("turn > 0").select(key, "turn", (F.col("answer_index") + 1).alias("keep"))


def _bare(call: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(call), r"\A\[+", ""), r"\]+\z", ""))


def used_tool(call: Column) -> Column:
    """The name in a call, written as JSON, whole or broken, or as name(arguments)."""
    c = _bare(call)
    named = F.coalesce(F.nullif(F.get_json_object(c, "$.name"), F.lit("")), F.nullif(F.regexp_extract(c, r'"name"\s*:\s*"([^"]+)"', 1), F.lit("")))
    plain = F.regexp_extract(c, r"\A([^({\s]+)", 1)
    return F.trim(F.when(c.startswith("{"), F.coalesce(named, plain)).otherwise(plain))


def call_parameters(call: Column) -> Column:
    """The names of a call's arguments: of a JSON object of arguments, or of name(a=..., b=...). An empty array without any."""
    c = _bare(call)
    arguments = F.get_json_object(c, "$.arguments")
    inside = F.regexp_extract(c, r"(?s)\((.+)\)\z", 1)
    written = F.transform(F.filter(F.split(inside, r",\s*(?=[a-zA-Z_])"), lambda x: F.trim(x).rlike(r"\A[a-zA-Z_]\w*\s*=")), lambda x: F.regexp_extract(F.trim(x), r"\A([a-zA-Z_]\w*)", 1))
    return F.coalesce(F.when(c.startswith("{"), F.json_object_keys(arguments)).otherwise(written), F.array().cast("array<string>"))


def defined_tools(system: Column) -> Column:
    """struct(name, definition) of the tools in the first JSON list of objects of a prompt; definitions are compact JSON. An empty array without a list."""
    listed = F.call_function("try_variant_get", F.try_parse_json(F.regexp_extract(system, TOOL_LIST, 1)), F.lit("$"), F.lit("array<variant>"))
    named = F.transform(listed, lambda t: F.struct(F.call_function("try_variant_get", t, F.lit("$.name"), F.lit("string")).alias("name"), F.call_function("try_variant_get", t, F.lit("$"), F.lit("string")).alias("definition")))
    kind = "array<struct<name:string,definition:string>>"
    return F.coalesce(F.filter(named, lambda t: F.coalesce(F.length(t["name"]), F.lit(0)) > 0), F.array().cast(kind))


def offered_tools(system: Column, call: Column, most: int = 8, seed: int = 7) -> Column:
    """Definitions of the tools that a prompt offers beside the used one, all if it offers no other; of more than `most`, those with the smallest hashes."""
    tools = defined_tools(system)
    others = F.filter(tools, lambda t: t["name"] != used_tool(call))
    pool = F.when(F.size(others) > 0, others).otherwise(tools)
    drawn = F.slice(F.array_sort(F.transform(pool, lambda t: F.struct(F.xxhash64(t["name"], F.lit(seed)).alias("h"), t["definition"].alias("d")))), 1, most)
    return F.when(F.size(pool) > most, F.transform(drawn, lambda t: t["d"])).otherwise(F.transform(pool, lambda t: t["definition"]))


def tool_registry(rows: DataFrame, order: str) -> DataFrame:
    """rows(system, tool_call, order) -> name, definition, made: the first definition of each tool in the prompts, and one made of the call's arguments for tools that are only called. Two aggregates by name."""
    given = rows.select(F.col(order).alias("o"), F.posexplode(defined_tools(F.col("system"))).alias("i", "t"))
    real = given.groupBy(F.col("t.name").alias("name")).agg(F.min_by("t.definition", F.struct("o", "i")).alias("definition"))
    called = rows.select(F.col(order).alias("o"), used_tool(F.col("tool_call")).alias("name"), call_parameters(F.col("tool_call")).alias("p")).where("name <> ''")
    first = called.join(real.select("name"), "name", "left_anti").groupBy("name").agg(F.min_by("p", "o").alias("p"))
    quote = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    part = lambda c: F.concat(quote(c), F.lit(':{"type":"string","description":'), quote(c), F.lit("}"))
    about = F.concat(F.lit("Performs "), F.lower(F.replace(F.col("name"), F.lit("_"), F.lit(" "))), F.lit(" operations."))
    parameters = F.concat(F.lit(',"parameters":{"type":"dict","properties":{'), F.array_join(F.transform("p", part), ","), F.lit('},"required":'), F.to_json("p"), F.lit("}"))
    made = F.concat(F.lit('{"name":'), quote(F.col("name")), F.lit(',"description":'), quote(about), F.when(F.size("p") > 0, parameters).otherwise(""), F.lit("}"))
    return real.withColumn("made", F.lit(False)).unionByName(first.select("name", made.alias("definition"), F.lit(True).alias("made")))


def with_systems(rows: DataFrame, order: str, head: str, most_tools: int = 20_000) -> DataFrame:
    """The rows; those without a system prompt get one that lists all tools of the registry, by name. A registry of over `most_tools` is no prompt and raises an error."""
    found = tool_registry(rows, order).orderBy("name").limit(most_tools + 1).collect()
    if len(found) > most_tools:
        raise ValueError(f"more than {most_tools} tools")
    prompt = head + "[" + ",\n ".join(r.definition for r in found) + "]"
    return rows.withColumn("system", F.when(F.coalesce(F.length("system"), F.lit(0)) == 0, F.lit(prompt)).otherwise(F.col("system")))


def changed_values(before: DataFrame, after: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Leaf tables of two trees and the freed paths(key, path) -> key, path, label_type, original, generated, due_to_null of those that differ: Baseless Info where there was nothing or null, else Evident Conflict. All three grow alike and are joined by merge."""
    value = lambda d, name: d.select(key, "path", F.when(F.col("kind") != "null", F.col("value")).alias(name)).hint("merge")
    d = paths.select(key, "path").join(value(before, "original"), [key, "path"], "left").join(value(after, "generated"), [key, "path"], "left")
    kind = F.when(F.col("original").isNull(), "Baseless Info").otherwise("Evident Conflict")
    return d.where(~F.col("original").eqNullSafe(F.col("generated"))).select(key, "path", kind.alias("label_type"), "original", "generated", F.col("original").isNull().alias("due_to_null"))


def fixed_spans(answer: Column, labels: Column) -> Column:
    """struct(spans, codes, changed): spans whose text differs from the answer only in punctuation take the answer's; codes: MISSING_OFFSETS, NO_ANSWER, OUT_OF_RANGE, OK, FIXED, GENUINE."""

    def code(s: Column) -> Column:
        here = spans.cut(answer, s["start"], s["end"])
        outside = (s["start"] < 0) | (s["end"] > F.length(answer)) | (s["start"] > s["end"])
        return F.when(s["start"].isNull() | s["end"].isNull() | s["text"].isNull(), "MISSING_OFFSETS").when(answer.isNull(), "NO_ANSWER").when(outside, "OUT_OF_RANGE").when(here == s["text"], "OK").when(spans.punctuation_drift(here, s["text"]), "FIXED").otherwise("GENUINE")

    codes = F.transform(labels, code)
    mended = F.zip_with(labels, codes, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(c == "FIXED", spans.cut(answer, s["start"], s["end"])).otherwise(s["text"]).alias("text")))
    return F.struct(mended.alias("spans"), codes.alias("codes"), F.coalesce(F.array_contains(codes, "FIXED"), F.lit(False)).alias("changed"))


#: Signs that annotations and answers write differently.
ANNOTATED, STORED = "\u2018\u2019\u201c\u201d\u2011\u2013\u2014\u202f\u00a0", "''\"\"---  "


def example_reason(kind: Column, answer: Column, labels: Column) -> Column:
    """Why a row can't be a training example: NO_ANSWER, OUTSIDE, MISMATCH (of the first bad span), SPANS_NOT_ALLOWED, SPANS_MISSING; null if it can. Texts may differ in quotes, dashes and spaces."""
    plain = lambda c: F.translate(c, ANNOTATED, STORED)

    def code(s: Column) -> Column:
        here = spans.cut(answer, s["start"], s["end"])
        return F.when((here == s["text"]) | (plain(here) == plain(s["text"])), None).when(here == "", "OUTSIDE").otherwise("MISMATCH")

    bad = F.get(F.filter(F.transform(labels, code), lambda c: c.isNotNull()), 0)
    invariant = F.when(kind.isin("clean", "undergeneration") & (F.size(labels) > 0), "SPANS_NOT_ALLOWED").when(kind.isin(*SPAN_CLASSES) & (F.size(labels) == 0), "SPANS_MISSING")
    return F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, "NO_ANSWER").otherwise(F.coalesce(bad, invariant))


def few_shot_messages(system: Column, examples: list[tuple[str, str]], asked: Column) -> Column:
    """The system prompt, the examples' questions and answers in turn, and the question."""
    make = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    shown = [make(role, F.lit(x)) for pair in examples for role, x in zip(("user", "assistant"), pair, strict=True)]
    return F.array(make("system", system), *shown, make("user", asked))


def coverage_fields(c: Column) -> Column:
    """A JSON list of texts as an array; anything else is an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
