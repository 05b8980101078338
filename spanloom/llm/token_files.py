"""Operator 4: token ids in a bit-packed file format, and back.

Each id takes the fewest bits that hold the vocabulary's largest id. Documents are range-partitioned and sorted by doc_id; each
partition becomes a shard, each shard a run of blocks. A block holds whole documents: their ids packed one after another in one
binary value, with the documents' ids, and the offset of each document's first token. A document can be read alone: its block is
found by shard and doc_id, its bits by offset * width. Blocks are rows of Parquet files, so that any store Spark writes to can hold
them. A block also tells how many tokens its shard has before it; a reader gets the start of a shard from the token counts of the
shards before it.

Null texts are empty; each document ends with the end id. Null ids sort first. Repeated ids are kept, in the order of their texts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import scratch, small_batches

#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 15
#: A run between white space that is letters, then ASCII signs: the tokenizer parts these two as well, so they are encoded apart.
#: (An apostrophe isn't such a sign: it may begin a part of its own.)
LETTERS_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Runs, and letters or signs, whose ids are kept; once so many are, others are encoded once for each batch.
CACHED = 350_000
#: Parts encoded in one call.
TOGETHER = 1000
#: The bytes of Latin letters as byte-level models write them: a letter of its own for each byte.
BYTE_LETTERS = {**{b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}, **{b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}}
LATIN = {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(192, 256)}


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below the vocabulary's size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Fixed-width packing, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, start: int, count: int) -> np.ndarray:
    """ids[start : start + count] of a packed block; only the bytes that hold them are read."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    first, last = start * width // 8, -(-(start + count) * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")[start * width - first * 8 :][: count * width]
    return (bits.reshape(count, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Encoder:
    """Encodes texts with the tokenizers library; the ids of parts seen before are kept, up to a bound."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.lower = '"Lowercase"' in self.tokenizer.to_str()[:4000]
        self.seen: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # The model alone is used only if it gives what the tokenizer gives, for words of all Latin letters.
        trial = ["the", "benchmarking", "zqxjkvw", *("ab" + chr(c) + "cd" for c in [*range(223, 247), *range(248, 256)])]
        self.by_model = self.lower and self._letters(trial) == self._ids(trial)

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part. Where the tokenizer has a special token, parts are encoded in one call with it between them."""
        special = next((t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special), None)
        out = {p: np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in parts if special is None or "<" in p}
        if special is None:
            return out
        rest, mark = [p for p in parts if "<" not in p], self.tokenizer.token_to_id(special)
        for i in range(0, len(rest), TOGETHER):
            some = rest[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([special + special.join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, cuts = ids.tobytes(), np.append(np.flatnonzero(ids == mark), len(ids)) * 4
            out.update((p, data[a + 4 : b]) for p, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return out

    def _letters(self, names: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters in lower case, by the tokenizer's model alone: its other steps leave them as they are."""
        tokens = self.tokenizer.model.tokenize
        return {x: np.array([t.id for t in tokens(x if x.isascii() else x.translate(LATIN))], "<u4").tobytes() for x in names}

    def _runs(self, runs: list[bytes]) -> dict[bytes, bytes]:
        cut = {r: m.groups() if (m := LETTERS_AND_SIGNS.fullmatch(text := r.decode())) else ("", text) for r in runs}
        known = self.parts
        new = sorted({x for pair in cut.values() for x in pair if x}.difference(known))
        plain = [x for x in new if self.by_model and x.isalpha() and x.islower() and LETTERS_AND_SIGNS.fullmatch(x)]
        fresh = self._letters(plain) | self._ids(sorted(set(new).difference(plain)))
        fresh[""] = b""
        if len(known) < CACHED:
            known.update(fresh)
        return {r: (fresh[a] if a in fresh else known[a]) + (fresh[b] if b in fresh else known[b]) for r, (a, b) in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # The vocabulary is of lower case; what a capital sigma becomes depends on its place, and special tokens are found before.
        runs = [(x if not self.lower or "<" in x or "Σ" in x else x.lower()).encode().split() for x in texts]
        seen = self.seen
        new = self._runs(list(set().union(*runs).difference(seen)))
        if len(seen) < CACHED:
            seen.update(new)
            return [b"".join(map(seen.__getitem__, x)) for x in runs]
        return [b"".join([new[r] if r in new else seen[r] for r in x]) for x in runs]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of all documents(doc_id, text, ...) to path. Each task writes one shard; memory is a block and a batch."""
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["shard", "block", "width", "doc_ids", "offsets", "block_start", "n_ids", "payload"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, shard, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width, end = width_of(max(tool.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        docs: list[int] = []
        held: list[bytes] = []
        size = before = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            offsets = np.cumsum([0] + [len(x) // 4 for x in held])[:-1].tolist()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([docs], pa.list_(schema_type)), pa.array([offsets], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(ids, width)], pa.binary())], names)

        schema_type = pa.int64()
        for batch in batches:
            schema_type = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tool.encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                docs.append(doc)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS:
                    yield closed()
                    docs, held, size, block, before = [], [], 0, block + 1, before + size
        if docs:
            yield closed()

    ordered = documents.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(rows, f"shard int, block int, width int, doc_ids array<{kind}>, offsets array<bigint>, block_start bigint, n_ids bigint, payload binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, unpacked block by block."""
    small_batches(spark)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row a shard, so no more than there were writing tasks; the blocks themselves are not shuffled.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    placed = blocks.join(F.broadcast(starts), "shard").withColumn("base", F.col("shard_start") + F.col("block_start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, docs, offsets, n, payload, base = (batch.column(k)[i] for k in ("width", "doc_ids", "offsets", "n_ids", "payload", "base"))
                ids = unpack(payload.as_py(), width.as_py(), 0, n.as_py())
                at = np.r_[np.array(offsets.as_py(), np.int64), n.as_py()]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(at[:-1] + base.as_py()), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("width", "doc_ids", "offsets", "n_ids", "payload", "base").mapInArrow(rows, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id) -> doc_id, ids of these documents only: random access by block offsets, only the bits of a wanted document are unpacked.

    The blocks that hold one are found by their ids alone; payloads of others are not decoded. Null ids are not found; repeated documents
    come as often as they are in the files.
    """
    blocks = spark.read.parquet(path)
    ids = wanted.select(F.col("doc_id").alias("wanted")).where("wanted is not null").distinct()
    at = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, F.col("doc_id") == F.col("wanted"), "left_semi")
    places = at.groupBy("shard", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = [*r["offsets"][1:], r["n_ids"]]
                found = [(r["doc_ids"][i], unpack(r["payload"], r["width"], r["offsets"][i], ends[i] - r["offsets"][i]).tolist()) for i in r["places"]]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], batch.schema.field("doc_ids").type.value_type), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    small_batches(spark)
    return blocks.join(places, ["shard", "block"]).select("width", "doc_ids", "offsets", "n_ids", "payload", "places").mapInArrow(rows, f"doc_id {kind}, ids array<bigint>")


def encode_and_read(documents: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the token files to a new path of the shared folder and returns what they hold."""
    path = scratch(documents.sparkSession, "tokens")
    write_token_files(documents, path, tokenizer, end_id)
    return read_token_files(documents.sparkSession, path)
