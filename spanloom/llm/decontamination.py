"""Operator 10: benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every text is cut into overlapping passages, each twice as long as the longest item, at steps of half their length, so that any item
lies whole in some passage. A passage's distinct words are its query. Scores are BM25 sums divided by the item's own full score: 1 if
the passage has all words of the item. All items at or above a fixed threshold are retrieved. As in block-max WAND, a passage whose
words' highest impacts add up to less than the threshold is skipped; then each block of items whose words' block maxima add up to
less; only the items of the remaining blocks are scored. The sums are taken for many passages at once, in numpy; block maxima are kept
for the blocks that hold a term only, so the index grows with the items' words.

A retrieved item is verified: the passage must hold OVERLAP of its five-word shingles (all words of a shorter item), QUESTION of the
distinct words of its question and ANSWER of those of its answer. The answer is the last line or sentence, the rest the question.

Words are lower case, ASCII punctuation counts as space. Null and empty texts and items have no words and no hits. The index holds
INDEX_ITEMS items at most; a larger benchmark is searched in several passes over the texts, one index at a time, with document
frequencies and lengths of all items. Ids may be of any type, null too. Repeated items are separate items and repeated documents
separate rows; other columns don't matter; an empty benchmark finds nothing.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import WORDS, mix, save, small_batches

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, QUESTION, ANSWER = 0.6, 0.8, 0.8, 0.6
SHINGLE, BLOCK, SHORTEST = 5, 16, 64
INDEX_ITEMS = 20_000
#: Words of a text handled at once; pieces overlap by a passage.
PIECE = 1 << 16
#: Scores of queries on items held at once.
SCORES = 1 << 20
TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TABLE).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words before, and of, the last line; of a single line, the last sentence. An item of one sentence is a question only."""
    text = text.strip()
    cut = text.rfind("\n") + 1 or max((m.end() for m in re.finditer(r"[.!?]\s+", text)), default=0)
    return (words_of(text[:cut]), words_of(text[cut:])) if cut else (words_of(text), [])


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def gram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of n words."""
    if n > len(words) or not n:
        return np.zeros(0, np.uint64)
    h = WORDS.of(words)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out + h[j : j + len(out)] * np.uint64(2 * j + 3))
    return np.unique(out)


def _share(part: np.ndarray, whole: np.ndarray) -> float:
    return float(np.isin(part, whole, assume_unique=True).mean()) if len(part) else 1.0


class Statistics:
    """Of all items, where the index holds some: their number, mean length, and in how many a word is."""

    def __init__(self, n: int, mean: float, frequency: dict[bytes, int]) -> None:
        self.n, self.mean, self.frequency = n, mean, frequency


class Index:
    """Impacts of terms on items, their maxima over blocks of items, and over all."""

    def __init__(self, items: list[tuple[object, str | None]], of_all: Statistics | None = None) -> None:
        items = sorted(((i, t) for i, t in items if words_of(t)), key=lambda x: (len(words_of(x[1])), str(x[0]), x[1]))
        self.ids = [i for i, _ in items]
        bags = [Counter(words_of(text)) for _, text in items]
        lengths = np.array([sum(b.values()) for b in bags], float)
        own = Counter(w for b in bags for w in b)
        known = of_all or Statistics(len(items), lengths.mean() if len(items) else 1.0, own)
        self.terms = {w: k for k, w in enumerate(sorted(own))}
        number = lambda words: np.unique(np.array([self.terms[w] for w in words], np.int64))
        self.parts = []
        for _, text in items:
            words = words_of(text)
            question, answer = question_and_answer(text)
            size = min(SHINGLE, len(words))
            self.parts.append((size, gram_hashes(words, size), number(question), number(answer)))
        self.blocks = -(-len(items) // BLOCK)
        terms, places, values = [], [], []
        for i, bag in enumerate(bags):
            row = np.array([np.log(1 + (known.n - known.frequency[w] + 0.5) / (known.frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / known.mean)) for w, tf in bag.items()])
            terms += [self.terms[w] for w in bag]
            places += [i] * len(bag)
            values.append(row / row.sum())
        term, item = np.array(terms, np.int64), np.array(places, np.int64)
        order = np.lexsort((item, term))
        term, self.items = term[order], item[order].astype(np.int32)
        self.impact = (np.concatenate(values) if values else np.zeros(0))[order].astype(np.float32)
        count = np.arange(len(self.terms) + 1)
        self.first = np.searchsorted(term, count)
        # Block maxima: for each term, the blocks that hold it.
        cells = np.flatnonzero(np.diff(term * max(self.blocks, 1) + self.items // BLOCK, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.block, self.block_max = self.items[cells] // BLOCK, np.maximum.reduceat(self.impact, cells) if len(cells) else self.impact
        self.first_block = np.searchsorted(term[cells], count)
        self.term_max = np.zeros(len(self.terms), np.float32)
        np.maximum.at(self.term_max, term, self.impact)
        self.step = max(SHORTEST // 2, int(lengths.max(initial=0)))

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
        """For each text: (place of the item, highest score, highest overlap) of all items that a passage of the whole text holds."""
        best: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, max(1, len(words) - self.step), PIECE):
                group.append((k, words[start : start + PIECE + 2 * self.step]))
                held += len(group[-1][1])
                if held >= PIECE:
                    self._note(group, best)
                    group, held = [], 0
        self._note(group, best)
        return [[(i, *x[i]) for i in sorted(x)] for x in best]

    def _note(self, group: list[tuple[int, list[bytes]]], best: list[dict[int, tuple[float, float]]]) -> None:
        for k, i, score, overlap in self._search_pieces(group):
            old = best[k].get(i, (0.0, 0.0))
            best[k][i] = (max(old[0], score), max(old[1], overlap))

    def _search_pieces(self, group: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, float, float]]:
        words = [w for _, part in group for w in part]
        if not words or not self.ids:
            return
        terms = np.fromiter(map(self.terms.get, words, itertools.repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return
        sizes = np.array([len(part) for _, part in group])
        ends_at = np.cumsum(sizes)
        halves = np.cumsum(-(-sizes // self.step)) - -(-sizes // self.step)  # halves before each piece
        piece = np.searchsorted(ends_at, at, side="right")
        half = halves[piece] + (at - (ends_at - sizes)[piece]) // self.step
        count = len(self.terms)
        before = half > halves[piece]
        own = terms[at]
        queries = np.unique(np.concatenate([half * count + own, (half[before] - 1) * count + own[before]]))  # passage p: halves p and p + 1
        passage, term = queries // count, queries % count
        bound = np.bincount(passage, self.term_max[term])
        keep = bound[passage] >= THRESHOLD
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(term))
        for some in np.array_split(np.arange(len(starts)), -(-len(starts) * len(self.ids) // SCORES)):
            for k, found, scores in self._scored(some, term, starts, ends):
                p = int(passage[starts[k]])
                doc, part = group[(g := int(np.searchsorted(halves, p, side="right")) - 1)]
                here = part[(p - int(halves[g])) * self.step :][: 2 * self.step]
                bag = term[starts[k] : ends[k]]
                grams = {n: gram_hashes(here, n) for n in {self.parts[i][0] for i in found}}
                for i, score in zip(found.tolist(), scores.tolist(), strict=True):
                    size, grams_of, question, answer = self.parts[i]
                    overlap = _share(grams_of, grams[size])
                    if overlap >= OVERLAP and _share(question, bag) >= QUESTION and _share(answer, bag) >= ANSWER:
                        yield doc, i, score, overlap

    def _scored(self, some: np.ndarray, term: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of some queries: the items at or above the threshold, from the postings of their terms in the blocks that may hold such."""
        n = len(self.ids)
        query, own = np.repeat(np.arange(len(some)), ends[some] - starts[some]), term[_runs(starts[some], ends[some])]
        at = _runs(self.first_block[own], self.first_block[own + 1])
        cell = np.repeat(query, self.first_block[own + 1] - self.first_block[own]) * self.blocks + self.block[at]
        may = (np.bincount(cell, self.block_max[at], len(some) * self.blocks) >= THRESHOLD - 1e-6).reshape(-1, self.blocks)
        live = may.any(axis=1)[query]
        query, own = query[live], own[live]
        at = _runs(self.first[own], self.first[own + 1])
        query, item = np.repeat(query, self.first[own + 1] - self.first[own]), self.items[at]
        hit = may[query, item // BLOCK]
        scores = np.bincount(query[hit] * n + item[hit], self.impact[at[hit]], len(some) * n).reshape(-1, n)
        for k in np.flatnonzero(scores.max(axis=1, initial=0) >= THRESHOLD):
            found = np.flatnonzero(scores[k] >= THRESHOLD)
            yield int(some[k]), found, scores[k, found]


def _runs(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places from each first up to its last, one run after the other."""
    sizes = last - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _parted(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    """item_id, text and part of all items with a text, and the number of parts."""
    rows = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    passes = -(-rows.count() // most)
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(passes, 1))).cast("int")), passes


def _words_of_items(rows: DataFrame) -> DataFrame:
    """part, word, n: a row for each distinct word of an item, and one without a word for the item's length."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [(part, words_of(text)) for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            out = [(part, w, 1) for part, bag in bags if bag for w in [*set(bag), None]]
            lengths = [len(bag) if w is None else 1 for part, bag in bags if bag for w in [*set(bag), None]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array(lengths, pa.int64())], ["part", "word", "n"])

    return rows.select("part", "text").mapInArrow(words, "part int, word binary, n bigint")


def indexes(benchmark: DataFrame, most: int = INDEX_ITEMS) -> Iterator[Index]:
    """One index after the other, each of about `most` items; only one part's items and words are on the driver at a time."""
    rows, passes = _parted(benchmark, most)
    if passes == 1:
        yield Index([(r.item_id, r.text) for r in rows.collect()])
    elif passes:
        words = save(_words_of_items(rows), "item_words")
        total = words.where("word is null").agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
        counts = save(words.where("word is not null").groupBy("word").agg(F.count("*").alias("items")), "word_counts")
        for k in range(passes):
            own = words.where((F.col("part") == k) & F.col("word").isNotNull()).select("word").distinct().join(counts, "word")
            yield Index([(r.item_id, r.text) for r in rows.where(F.col("part") == k).collect()], Statistics(total.n, total["mean"], {bytes(r.word): r["items"] for r in own.toLocalIterator()}))


def find_contamination(documents: DataFrame, benchmark: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """documents(doc_id, text, ...), benchmark(item_id, text) -> doc_id, item_id, score, overlap: a row for each item found in a document."""
    small_batches(documents.sparkSession)
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    item = benchmark.schema["item_id"].dataType
    kinds = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {item.simpleString()}, score double, overlap double"
    out = None
    several = benchmark.where("text is not null").count() > index_items
    for index in indexes(benchmark, index_items):
        found = _found(source, index, kinds, to_arrow_type(item))
        found = save(found, "found") if several else found  # the next index takes this one's place
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], kinds) if out is None else out


def _found(source: DataFrame, index: Index, kinds: str, item: pa.DataType) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *hit) for k, hits in enumerate(shared.value.search(batch.column("text").to_pylist())) for hit in hits]
            if found:
                docs = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array([shared.value.ids[f[1]] for f in found], item), pa.array([f[2] for f in found]), pa.array([f[3] for f in found])], ["doc_id", "item_id", "score", "overlap"])

    return source.mapInArrow(rows, kinds)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, index_items: int = INDEX_ITEMS) -> DataFrame:
    """The documents, with all their columns, in which no item is found; no shuffle. Null and empty texts stay. With several indexes the rest is written after each."""
    small_batches(documents.sparkSession)
    several = benchmark.where("text is not null").count() > index_items
    for index in indexes(benchmark, index_items):
        documents = save(_clean(documents, index), "clean") if several else _clean(documents, index)
    return documents


def _clean(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not hits for hits in shared.value.search(batch.column("text").to_pylist())], pa.bool_()))

    return documents.mapInArrow(rows, documents.schema)
