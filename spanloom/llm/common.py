"""Shared helpers of the corpus operators: reading tables, scratch tables, hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; bytes.split() cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch sent to Python: with very long texts the default of 10,000 would not fit a worker.
BATCH_ROWS = 400


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path is left to Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset: a local folder if the session is local, else an error, as executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local_folder()
    return f"{root}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, and lost executors cost nothing already written."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the rows in an Arrow batch to what long texts bear; never raises it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds that the queries fix. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(0)) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, seed: int) -> list[Any]:
    """At most per_class texts of each label, chosen by a hash of the id: the bounded training set. Only ids are sorted; texts are then joined to the chosen ids."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).where(keep)
    rows = rows.dropDuplicates(["doc_id"])
    order = F.xxhash64("doc_id", F.lit(seed))
    ids = rows.where("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(rows.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    picked = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
    # Of rows with one id, the one with the smallest text counts, so that repeated ids don't exceed the bound.
    single = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sorted(single.select("doc_id", "label", "text").toLocalIterator(), key=lambda r: (r.doc_id, r.text))


class WordHash(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it holds too many."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finisher of a multiply-xorshift hash)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of the whole text; of all its words together where it has fewer; none where it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = WORDS.of(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for j in range(min(size, len(h))):
        out = mix(out + h[j : j + n] * np.uint64(2 * j + 3))
    return out


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Each batch with its texts as Python strings."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("text").to_pylist()
