"""Operator 5: near duplicates by improved consistent weighted sampling.

1. Shingles are runs of five words (all words of a shorter text). A shingle's weight is its count in the text times an inverse
   document frequency, which is 1 up to COMMON of all documents and falls logarithmically beyond: passages that many documents share
   weigh less. Frequencies come from two rows of counters over all documents, of which the lower counts, less the rows' median, which
   is what other shingles add to a counter: a fixed number of them, so that their table has a fixed size however large the corpus and
   however long its texts.
2. Each text gets SAMPLES consistent weighted samples: the chance that two texts agree in one is their weighted Jaccard similarity.
   Four samples make a band; texts that share a band are candidates. Two texts are similar if that similarity, or the one by counts
   alone, is high enough: the edits of the members of a large group of near copies are rare and what they share is not, so that
   weights alone would part them. A text with a shingle of lower weight has the bands of both measures; all others have only one.
3. Equal texts are one node, so that copies are never paired. In each band's bucket all members are compared with a leader, the
   member with the least weight of shingles that no other text has, so most likely the text that the others are copies of. A bucket
   that then still holds several classes makes its largest one a family with all its members; in a family, each text outside that
   class is compared with all texts of other classes, in blocks of bounded size that only links leave. Texts whose own shingles
   alone weigh too much to be similar to any other are left out of that. Comparing computes the weighted Jaccard similarity of the
   two whole texts.
4. Linked nodes form classes (smallest label over neighbours, with pointer jumping), each named by its smallest doc_id.

Null texts are classes of their own. Equal texts, empty ones too, are one class. Rows with equal ids stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import arrow_rows, mix, save, shingles, small_batches

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, ROWS = 64, 4
BANDS = SAMPLES // ROWS
#: Shingles of a text whose costs are held at once.
TOGETHER = 4096
#: Random triplets are drawn from so many rows; a shingle's hash picks its row.
POOL = 1 << 14
COUNTERS = 1 << 16
#: Texts in the blocks of a family that are compared with each other, and cells of a block's table of weights.
OUT_BLOCK, ALL_BLOCK, CELLS = 64, 256, 1 << 22
#: Counters that tell shingles of one text only from others.
WIDE = 1 << 22
COMMON = 0.02


class Sampler:
    """Consistent weighted samples (r and c gamma(2, 1), b uniform), and the weights they need."""

    def __init__(self, documents: int, frequent: dict[int, int], counters: int = COUNTERS, seed: int = 17) -> None:
        """frequent: counts of the counters above COMMON, those of the second row numbered from `counters` on."""
        self.seed, self.pool, self.counters = seed, None, counters
        self.idf = np.ones(2 * counters, np.float32)
        for counter, n in frequent.items():
            self.idf[counter] = min(1.0, np.log(1 + documents / n) / np.log(1 + 1 / COMMON))
        self.level = bool((self.idf == 1).all())  # all weights are counts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pool": None}

    def weights(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in ascending order, and their weights."""
        found, counts = np.unique(shingles(text, SHINGLE), return_counts=True)
        return found, counts * self.idf_of(found)

    def idf_of(self, found: np.ndarray) -> np.ndarray:
        """Of the two counters the one with the lower frequency, so the higher idf, counts."""
        if self.level:
            return np.ones(len(found), np.float32)
        first, second = counters_of(found, self.counters)
        return np.maximum(self.idf[first], self.idf[second])

    def bands(self, text: str | None) -> list[int] | None:
        found, counts = np.unique(shingles(text, SHINGLE), return_counts=True)
        if not len(found):
            return None
        idf = self.idf_of(found)
        keys = self._bands(found, counts * np.float32(1))
        return keys if (idf == 1).all() else list({*keys, *self._bands(found, counts * idf)})

    def _bands(self, found: np.ndarray, weights: np.ndarray) -> list[int]:
        if self.pool is None:
            rng = np.random.default_rng(self.seed)
            r, c = rng.gamma(2, 1, (POOL, SAMPLES)).astype(np.float32), rng.gamma(2, 1, (POOL, SAMPLES)).astype(np.float32)
            b = rng.random((POOL, SAMPLES), np.float32)
            self.pool = (r, b, np.log(c) - r, np.log(c) - r + r * b)
        r, b, base, at_one = self.pool
        least, best, t = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
        for at in range(0, len(found), TOGETHER):
            own, w = found[at : at + TOGETHER], weights[at : at + TOGETHER]
            rows = ((own >> np.uint64(20)) % np.uint64(POOL)).astype(np.int64)
            costs = at_one[rows]  # weight 1: t is 0
            other = np.flatnonzero(w != 1)
            steps = np.zeros((0, SAMPLES), np.float32)
            if len(other):
                mine = rows[other]
                steps = np.floor(np.log(w[other]).astype(np.float32)[:, None] / r[mine] + b[mine])
                costs[other] = base[mine] - r[mine] * (steps - b[mine])
            first = costs.argmin(axis=0)
            low = costs[first, np.arange(SAMPLES)]
            step = np.zeros(SAMPLES, np.int64)
            if len(other):
                place = np.searchsorted(other, first).clip(max=len(other) - 1)
                step = np.where(other[place] == first, steps[place, np.arange(SAMPLES)], 0).astype(np.int64)
            better = low < least
            least, best, t = np.where(better, low, least), np.where(better, first + at, best), np.where(better, step, t)
        drawn = mix(found[best] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            key = mix(key * np.uint64(31) + drawn[:, j])
        return key.view(np.int64).tolist()

    def similarity(self, a: str | None, b: str | None) -> float:
        """The higher of the similarities by weight and by count."""
        (x, u), (y, v) = (np.unique(shingles(t, SHINGLE), return_counts=True) for t in (a, b))
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return max(_jaccard(u * p, v * q, i, j) for p, q in self.measures(x, y))

    def measures(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray | float, np.ndarray | float]]:
        """Factors of the counts of two texts' shingles, for each of the two similarities that differ."""
        p, q = self.idf_of(x), self.idf_of(y)
        return [(1.0, 1.0)] if self.level or (p == 1).all() and (q == 1).all() else [(1.0, 1.0), (p, q)]


def _jaccard(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    both = float(np.minimum(u[i], v[j]).sum())
    return both / max(float(u.sum()) + float(v.sum()) - both, 1e-9)


def counters_of(found: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two counters of shingles."""
    n = np.uint64(counters)
    return (found % n).astype(np.int64), ((found >> np.uint64(40)) % n + n).astype(np.int64)


def fit_sampler(documents: DataFrame, counters: int = COUNTERS) -> Sampler:
    """Counts shingles over all documents into two rows of counters; only those above COMMON of the documents come to the driver, and each row's median."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(2 * counters, np.int64), 0
        for _, texts in arrow_rows(batches):
            n += len(texts)
            for text in texts:
                for row in counters_of(np.unique(shingles(text, SHINGLE)), counters):
                    counts[np.unique(row)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, counts[at]])], ["counter", "n"])

    small_batches(documents.sparkSession)
    sums = documents.select("text").mapInArrow(counted, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    total = documents.where("text is not null").count()
    sums = save(sums, "counters")
    both = sums.where("counter >= 0").withColumn("upper", F.col("counter") >= counters)
    own = both.groupBy("upper").agg(F.percentile("n", 0.5).alias("middle"), F.count("*").alias("filled"))
    # Where most counters are empty, the median of all is 0.
    middle = {r.upper: int(r.middle) if r.filled == counters else 0 for r in own.collect()}
    surplus = F.when(F.col("upper"), middle.get(True, 0)).otherwise(middle.get(False, 0))
    frequent = both.withColumn("n", F.col("n") - surplus).where(F.col("n") > COMMON * total).collect()  # at most 2 * counters rows
    return Sampler(total, {r.counter: r.n for r in frequent}, counters)


def _verified(pairs: DataFrame, texts: DataFrame, sampler: Sampler) -> DataFrame:
    """The pairs (a, b) whose texts are similar. The smaller table, pairs, carries the texts; a leader's many pairs are a skewed join that Spark splits."""
    shared = pairs.sparkSession.sparkContext.broadcast(sampler)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [shared.value.similarity(x, y) >= SIMILARITY for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    own, other = texts.select(F.col("h").alias("b"), F.col("text").alias("y")), texts.select(F.col("h").alias("a"), F.col("text").alias("x"))
    return pairs.join(own, "b").join(other, "a").select("a", "b", "x", "y").mapInArrow(rows, "a binary, b binary")


def _links_in_families(rows: DataFrame, texts: DataFrame, sampler: Sampler) -> DataFrame:
    """rows(family, h, root) -> the similar pairs (a, b) of a text outside a family's class and a text of another class in that family.

    A family is a class with the texts that share a bucket with it. Its texts outside the class, and all its texts, are dealt into
    blocks by a hash; each pair of blocks is one group, so no group grows with the family. Only links leave a group.
    """
    shared = rows.sparkSession.sparkContext.broadcast(sampler)
    outside = rows.where("root != family")
    counts = rows.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("family")).alias("n_out")).where("n_out > 0")
    blocks = counts.select("family", F.ceil(F.col("n_out") / OUT_BLOCK).cast("int").alias("na"), F.ceil(F.col("n") / ALL_BLOCK).cast("int").alias("nb"))

    def dealt(of: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        d = of.join(blocks, "family").join(texts, "h").withColumn(own, F.pmod(F.xxhash64("h"), F.col(own_n)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).select("family", "a", "b", "h", "root", "text")

    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        mine = [np.unique(shingles(t, SHINGLE), return_counts=True) for t in left["text"]]
        others = [np.unique(shingles(t, SHINGLE), return_counts=True) for t in right["text"]]
        at = 0
        while at < len(mine):
            end, held = at, 0
            while end < len(mine) and (end == at or (held + len(mine[end][0])) * (end - at + 1) < CELLS):
                held += len(mine[end][0])
                end += 1
            names = np.unique(np.concatenate([x for x, _ in mine[at:end]]))
            table = np.zeros((end - at, len(names)), np.float32)
            for k, (x, w) in enumerate(mine[at:end]):
                table[k, np.searchsorted(names, x)] = w
            idf = shared.value.idf_of(names)
            tables = [(table, lambda y: np.float32(1))] + ([] if (idf == 1).all() else [(table * idf, shared.value.idf_of)])
            sums = [t.sum(axis=1) for t, _ in tables]
            for (y, v), h, root, text in zip(others, right["h"], right["root"], right["text"], strict=True):
                place = np.searchsorted(names, y).clip(max=len(names) - 1)
                hit = names[place] == y
                near = np.zeros(end - at, bool)
                for (own, factor), total in zip(tables, sums, strict=True):
                    w = v.astype(np.float32) * factor(y)
                    both = np.minimum(own[:, place[hit]], w[hit]).sum(axis=1)
                    near |= both >= SIMILARITY * (total + w.sum() - both) * (1 - 1e-5)
                for k in np.flatnonzero(near):
                    i = at + int(k)
                    if left["root"].iat[i] != root and shared.value.similarity(left["text"].iat[i], text) >= SIMILARITY:
                        found.append((left["h"].iat[i], h))
            at = end
        return pd.DataFrame(found, columns=["a", "b"])

    mine, all_of = dealt(outside, "a", "na", "b", "nb"), dealt(rows, "b", "nb", "a", "na")
    all_of = all_of.toDF("family_2", "a_2", "b_2", "h", "root", "text")  # columns of its own, as both come from rows
    out = mine.groupBy("family", "a", "b").cogroup(all_of.groupBy("family_2", "a_2", "b_2")).applyInPandas(links, "a binary, b binary")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _may_link(other: Column) -> Column:
    """False where this text and the other can't be similar, by weight or by count: what they have in common weighs no more than either's shingles that other texts have."""

    def by(total: str, common: str) -> Column:
        most = F.least(F.col(common), other[common])
        return most >= SIMILARITY * (F.col(total) + other[total] - most) - 1e-6

    return by("total", "common") | by("count", "shared")


def _masses(texts: DataFrame, sampler: Sampler) -> DataFrame:
    """texts(h, text) -> h, total weight, the weight of shingles that may also be in another of these texts (those whose counter is 1 can't), and both by count."""
    shared = texts.sparkSession.sparkContext.broadcast(sampler)
    wide = np.uint64(WIDE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(WIDE, np.uint8)
        for _, rows in arrow_rows(batches):
            for text in rows:
                at = np.unique(np.unique(shingles(text, SHINGLE)) % wide)
                counts[at] = np.minimum(counts[at] + 1, 2)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63), pa.array(counts[at].astype(np.int64))], ["word", "bit", "n"])

    # A counter's bit is set where it is reached twice: words of 64 bits, WIDE / 64 of them at most, come to the driver.
    each = texts.select("text").mapInArrow(counted, "word bigint, bit bigint, n bigint")
    bits = each.groupBy("word", "bit").agg(F.sum("n").alias("n")).where("n > 1").groupBy("word").agg(F.collect_list("bit").alias("bits"))
    twice = np.zeros(WIDE, bool)
    for r in bits.toLocalIterator():
        twice[[r.word * 64 + b for b in r.bits]] = True
    table = texts.sparkSession.sparkContext.broadcast(np.packbits(twice))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.unpackbits(table.value).view(bool)
        for batch, rows in arrow_rows(batches):
            found = []
            for text in rows:
                x, n = np.unique(shingles(text, SHINGLE), return_counts=True)
                w, known = n * shared.value.idf_of(x), again[x % wide]
                found.append((float(w.sum()), float(w[known].sum()), float(n.sum()), float(n[known].sum())))
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), *columns], ["h", "total", "common", "count", "shared"])

    return texts.select("h", "text").mapInArrow(weighed, "h binary, total double, common double, count double, shared double")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> h, root: the smallest node that a node is linked with. Each round takes the smallest root among neighbours, then that root's own."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).toDF("h", "other").distinct(), "edges")
    roots = save(both.groupBy("h").agg(F.min("other").alias("least")).select("h", F.least("h", "least").alias("root")), "roots")
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("h").alias("other"), F.col("root").alias("near")), "other").groupBy("h").agg(F.min("near").alias("near"))
        lower = roots.join(near, "h").select("h", F.least("root", "near").alias("next"), "root")
        jump = lower.select(F.col("h").alias("next"), F.col("next").alias("far"))
        new = save(lower.join(jump, "next").select("h", F.least("next", "far").alias("new"), "root"), "roots")
        changed = not new.where("new != root").isEmpty()
        roots = new.select("h", F.col("new").alias("root"))
        if not changed:
            return roots
    raise RuntimeError("classes did not settle")


def _nodes_and_classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, h of each row (h: md5 of its text, null for a null text); and h, doc_id (smallest), root of each distinct text."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    sampler = fit_sampler(docs)
    shared = spark.sparkContext.broadcast(sampler)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([shared.value.bands(x) for x in texts], pa.list_(pa.int64()))], ["doc_id", "h", "bands"])

    hashed = docs.withColumn("h", F.unhex(F.md5("text")))
    drawn = save(hashed.mapInArrow(sampled, f"doc_id {kind}, h binary, bands array<bigint>"), "bands")
    nodes = save(drawn.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "nodes")
    members = nodes.where("bands is not null").select("h", F.explode("bands").alias("key"))
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = save(members.join(several, "key"), "members")

    wanted = members.select("h").distinct().join(nodes.select("h", "doc_id"), "h")
    same = (hashed["h"] == wanted["h"]) & hashed["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = save(hashed.join(wanted, same).select(hashed["h"], "text").dropDuplicates(["h"]), "texts")
    buckets = save(members.join(_masses(texts, sampler), "h"), "buckets")  # key, h, total, common, count, shared
    leader = F.min(F.struct((F.col("total") - F.col("common")).alias("own"), "h", "total", "common", "count", "shared"))
    leaders = buckets.groupBy("key").agg(leader.alias("l"))
    may = (F.col("h") != F.col("l.h")) & _may_link(F.col("l"))
    pairs = buckets.join(leaders, "key").where(may).select(F.col("l.h").alias("a"), F.col("h").alias("b")).distinct()
    edges = save(_verified(save(pairs, "pairs"), texts, sampler), "links")
    roots = components(edges)

    held = save(buckets.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "open")
    by_class = held.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = by_class.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("family"), F.count("*").alias("classes")).where("classes > 1").select("key", "family")
    open_rows = save(held.where((F.col("common") >= SIMILARITY * F.col("total") - 1e-6) | (F.col("shared") >= SIMILARITY * F.col("count") - 1e-6)).join(largest, "key").select("family", "h", "root").distinct(), "open_rows")
    new = save(_links_in_families(open_rows, texts, sampler), "links")
    if not new.isEmpty():
        edges = edges.union(new)
        roots = components(edges)

    named = nodes.select("h", "doc_id").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    return drawn.select("doc_id", "h"), save(named.select("h", "doc_id", "root"), "classes")


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, class_id, class_rows: one row for each row of documents; class_rows counts the class's rows."""
    rows, nodes = _nodes_and_classes(documents)
    copies = rows.where("h is not null").groupBy("h").agg(F.count("*").alias("copies"))
    classes = nodes.join(copies, "h").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    named = nodes.join(classes, "root").select("h", "class_id", "class_rows")
    class_id = F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return rows.join(named, "h", "left").select("doc_id", class_id, F.coalesce("class_rows", F.lit(1)).alias("class_rows"))


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that stay: all with a null text, and one of each class, the one with the smallest doc_id (of several, with the smallest hash of its text)."""
    rows, nodes = _nodes_and_classes(documents)
    kept = nodes.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    times = rows.groupBy("doc_id", "h").agg(F.count("*").alias("kept_rows"))
    kept = save(kept.join(times, F.col("kept_id").eqNullSafe(times["doc_id"]) & (F.col("kept_h") == times["h"])).select("kept_id", "kept_h", "kept_rows"), "kept")
    own = F.unhex(F.md5(documents["text"].cast("string")))

    def chosen(of: DataFrame) -> DataFrame:
        return documents.join(of, documents["doc_id"].eqNullSafe(of["kept_id"]) & (own == of["kept_h"]), "left_semi")

    again = kept.where("kept_rows > 1")
    out = documents.where("text is null").unionByName(chosen(kept.where("kept_rows = 1")))
    return out if again.isEmpty() else out.unionByName(chosen(again).dropDuplicates(["doc_id", "text"]))
