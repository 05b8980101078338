"""Drivers around a model: prompts, calls with retries, parsing, resuming. The model is any Completer."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.json_tree import first_json
from spanloom.operators.flows import not_done

#: How much hotter each further attempt is, and the hottest.
HOTTER, HOTTEST = 0.2, 1.4


class Completer(Protocol):
    """complete is called in tasks, by several threads at once, so the object must pickle and bear that."""

    def complete(self, prompt: str) -> str | None: ...


def complete(rows: DataFrame, prompt: str, model: Completer, tries: int = 3, pause: float = 0.0, together: int = 8) -> DataFrame:
    """rows + raw_response, status (ok or error) and error (what the last try failed with).

    Each task has up to `together` calls under way. Empty answers and exceptions are tried again, with a longer pause each time. Null
    prompts are errors without a call.
    """

    def asked(text: str | None) -> tuple[str | None, str | None]:
        error = "no prompt"
        for n in range(tries if text is not None else 0):
            if n:
                time.sleep(pause * n)
            try:
                if answer := model.complete(text):
                    return answer, None
                error = "empty answer"
            except Exception as x:  # whatever the model's client raises is told in the row, and the row is tried again
                error = f"{type(x).__name__}: {x}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(together) as pool:
            for batch in batches:
                answers = list(pool.map(asked, batch[prompt]))
                yield batch.assign(raw_response=[a for a, _ in answers], status=["error" if a is None else "ok" for a, _ in answers], error=[e for _, e in answers])

    return rows.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, raw_response string, status string, error string")


def refilled(rows: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """rows + raw_response and status from a table of stored responses; rows without one are errors, to be completed."""
    d = rows.join(responses.select(*keys, "raw_response"), keys, "left")
    return d.withColumn("status", F.when(F.coalesce(F.length("raw_response"), F.lit(0)) > 0, "ok").otherwise("error"))


def judge_prompt(query: Column, answer: Column) -> Column:
    """The question and the JSON-quoted answer."""
    return F.concat(F.lit("Question: "), query, F.lit("\nAnswer: "), F.to_json(F.struct(answer.alias("answer"))))


def parse_verdict(raw: Column | str) -> Column:
    """struct(type, span_labels) of the first JSON object; null if there is none."""
    return F.from_json(first_json(raw), "type string, span_labels array<struct<start:int,end:int,text:string>>")


def resume(rows: DataFrame, done: DataFrame, keys: list[str], prompt: str, model: Completer) -> DataFrame:
    """Completes the rows whose keys aren't done yet."""
    return complete(not_done(rows, done, keys), prompt, model)


class Warm:
    """A model whose calls carry a temperature, as a Completer at one temperature."""

    def __init__(self, model: object, temperature: float):
        self.model, self.temperature = model, temperature

    def complete(self, prompt: str) -> str | None:
        return self.model.complete(prompt, self.temperature)


def _is_written(rows: DataFrame, path: str) -> bool:
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(hadoop)


def waves(rows: DataFrame, keys: list[str], prompt: str, model: object, good: Column, folder: str, attempts: int = 5, temperature: float = 0.8) -> DataFrame:
    """rows + raw_response, status, error, attempt and temperature: the first attempt whose response is good (a condition on raw_response), else the last.

    Attempts are rounds. Each round calls model.complete(prompt, temperature) once for each row that no round before it has brought a good
    response, hotter by HOTTER each time, HOTTEST at most, and is written to folder/attempt=n. A round that is written is not called
    again, so a run after a crash goes on with the round that failed; the folder must lie where driver and executors share it, and belong
    to these rows. Rounds end when no row is left.
    """
    spark = rows.sparkSession
    done: DataFrame | None = None
    for n in range(attempts):
        path = f"{folder}/attempt={n}"
        heat = min(temperature + HOTTER * n, HOTTEST)
        if not _is_written(rows, path):
            left = rows if done is None else not_done(rows, done.where("status = 'ok'"), keys)
            if done is not None and left.isEmpty():
                break
            asked = complete(left.select(*keys, prompt), prompt, Warm(model, heat), tries=1).drop(prompt)
            fine = F.coalesce(good, F.lit(False)) & (F.col("status") == "ok")
            asked.withColumns({"status": F.when(fine, "ok").otherwise("error"), "error": F.when(~fine, F.coalesce("error", F.lit("refused"))), "temperature": F.lit(heat), "attempt": F.lit(n)}).write.mode("overwrite").parquet(path)
        part = spark.read.parquet(path)
        done = part if done is None else done.unionByName(part)
    # A row is in all rounds up to its first good response, so its last round has the result.
    rest = [c for c in done.columns if c not in keys]
    last = done.groupBy(*keys).agg(F.max_by(F.struct(*rest), "attempt").alias("r"))
    return rows.join(last.select(*keys, *[F.col("r")[c].alias(c) for c in rest]), keys)
