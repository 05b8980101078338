"""Readers and writers of dialogue files; paths are left to Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType()), T.StructField("turn_role", T.StringType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
#: The canonical row of a dialogue with spans.
UNIFIED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("dialogue_id", "generation_id", "subset", "type")]
    + [T.StructField("label", T.IntegerType()), T.StructField("system", T.StringType()), T.StructField("conversations", MESSAGES), T.StructField("span_labels", SPANS)]
    + [T.StructField(n, T.StringType()) for n in ("tool_call", "tool_response", "original_tool_response", "omitted_items")]
)


def load_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, JSON lines, JSON or CSV, by suffix; anything else is a folder of Parquet files."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "jsonl":
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    if end == "json":
        return (spark.read.schema(schema) if schema else spark.read).option("multiLine", True).json(path)
    if end == "csv":
        return load_csv(spark, path)
    return spark.read.parquet(path)


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The files of one split, by their names' prefix."""
    return spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder)


def load_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of the schema; reading fails at a line that is no JSON object. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that don't parse, with their files."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), parsed["_corrupt_record"].alias("bad"))
    return lines.where((F.trim("line") != "") & F.col("bad").isNotNull()).select("file", "line")


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quoted line breaks kept; an unnamed first column is an index and is dropped."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.drop("_c0")


def detect_format(columns: list[str]) -> str:
    """flat, dialogue, unified, coverage or unknown, by the columns."""
    have = set(columns)
    for name, need in (("unified", {"conversations", "span_labels", "type"}), ("coverage", {"used_fields", "unused_fields"}), ("flat", {"user_prompt", "tool_call", "tool_response", "original_answer"})):
        if need <= have:
            return name
    return "dialogue" if have & {"conversations", "messages"} else "unknown"


def text_columns(d: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return d.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in d.schema])


def write_jsonl(d: DataFrame, path: str, mode: str = "append") -> None:
    d.write.mode(mode).json(path)


def write_csv(d: DataFrame, path: str, mode: str = "overwrite") -> None:
    text_columns(d).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(d: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each split."""
    d.write.mode(mode).partitionBy("split").parquet(path)


def load_any_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, an array or a single object, told apart by the first sign that is no white space: an array needs the whole file at once, lines don't."""
    first = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("v")).first()
    reader = spark.read.schema(schema) if schema else spark.read
    lines = first is None or (not first.v.startswith("[") and first.v.rstrip().endswith("}"))
    return reader.json(path) if lines else reader.option("multiLine", True).json(path)


def merge_folder(spark: SparkSession, folder: str, schema: T.StructType, suffix: str = "jsonl") -> DataFrame:
    """All JSON lines of a folder's files of one suffix, with the file's name; other files are not read."""
    d = spark.read.schema(schema).option("pathGlobFilter", f"*.{suffix}").json(folder)
    return d.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def split_if_any(d: DataFrame, split: str) -> DataFrame:
    """The rows of one split, if there is a split column with a value in any row; else all rows."""
    if "split" not in d.columns or d.where("split is not null").isEmpty():
        return d
    return d.where(F.col("split") == split)


def literal_cells(d: DataFrame, *columns: str) -> DataFrame:
    """Columns of texts that hold JSON or Python literals as JSON texts; a text that is neither stays, blank ones are null."""
    from spanloom.functions.json_tree import decoded

    return d.withColumns({c: F.when(F.trim(c) != "", decoded(c)) for c in columns})


def load_samples(d: DataFrame) -> DataFrame:
    """Flat rows, or rows with conversations or messages, as samples: sample_id, system, query, tool_call, tool_response, answer; rows that hold none are left out."""
    from spanloom.operators import rows

    have = set(d.columns)
    if not have & {"conversations", "messages"}:
        return rows.flat_samples(d)
    messages = rows.normalized_messages(*(F.col(c) if c in have else None for c in ("conversations", "messages")))
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(""))
    s = d.select(pick("id", "dialogue_id").alias("sample_id"), pick("system").alias("system"), rows.conversation_sample(messages).alias("s")).where("s is not null")
    return s.select("sample_id", "system", "s.query", "s.tool_call", "s.tool_response", "s.answer")
