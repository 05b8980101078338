"""Operator 13: periodic runs of words, and texts with the repeats of each run taken out.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(SHORTEST, TIMES * q) words long, that no
neighbouring word extends. Words are numbered by the text's own vocabulary, so equal numbers are equal words.

Grid: the places i at which words i and i + q are equal are, within a run of period q, at least (TIMES - 1) * q in a row; so a grid with
that step, for each period q up to n / TIMES, meets every run. That is a harmonic sum of grid points, O(n log n). For all (period, grid
point) pairs with equal words the common extension to either side is found by one binary search over all pairs at once, on prefix hashes
of two primes held as numpy arrays. Of stretches with the same place the smallest period stays: a stretch whose smallest period is p < q
is p's own run, as both periods fit twice. What remains is compared word by word; if a hash lied, the text is searched again with another
base. Pairs are worked on PAIRS at a time, so that memory doesn't grow with the number of periods.

Null and empty texts have no runs and an empty collapsed text. Repeated rows and null ids stay, other columns are ignored, an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BATCH_ROWS, small_batches

SHORTEST, TIMES = 6, 4
PRIMES = (2_147_483_647, 2_147_483_629)
#: (period, grid point) pairs held at a time.
PAIRS = 1 << 20


class PrefixHashes:
    """Hashes of all prefixes of a sequence, modulo two primes: hash(i + n) - hash(i), times a power of the base, tells whether two stretches are equal."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        self.sums, self.powers = [], []
        for prime, b in zip(PRIMES, (base, base * 7 + 3), strict=True):
            p, powers, filled = np.uint64(prime), np.ones(n + 1, np.uint64), 1
            step = b % prime
            while filled < n + 1:  # powers by doubling
                more = min(filled, n + 1 - filled)
                powers[filled : filled + more] = powers[:more] * np.uint64(step) % p
                step, filled = step * step % prime, filled + more
            terms = (words.astype(np.uint64) + np.uint64(1)) * powers[:n] % p
            self.powers.append(powers)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % p]))

    def same(self, i: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at i and i + shift are equal, by their hashes."""
        equal = np.ones(len(i), bool)
        for prime, powers, sums in zip(PRIMES, self.powers, self.sums, strict=True):
            p = np.uint64(prime)
            left = (sums[i + length] + p - sums[i]) % p * powers[shift] % p
            equal &= left == (sums[i + shift + length] + p - sums[i + shift]) % p
        return equal


def _longest(hashes: PrefixHashes, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For each pair how many words from i on (back: up to i, without it) equal those q further on; most is the limit."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while (open_ := low < high).any():
        middle = np.where(open_, (low + high + 1) // 2, low)
        good = hashes.same(i - middle if back else i, q, middle)
        low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
    return low


def _pairs(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, grid points) that may be in a run: with equal words a period apart, there and beside; about PAIRS of the grid at a time."""
    n = len(words)
    periods = np.arange(1, n // TIMES + 1)
    steps = np.maximum((TIMES - 1) * periods, SHORTEST - periods)
    counts = (n - periods - 1) // steps + 1
    before = np.concatenate([[0], np.cumsum(counts)])
    first = 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS, "right")) - 1)
        own = slice(first, last)
        place = np.arange(before[first], before[last]) - np.repeat(before[first:last], counts[own])
        q, at = np.repeat(periods[own], counts[own]), place * np.repeat(steps[own], counts[own])
        equal = words[at] == words[at + q]
        q, at = q[equal], at[equal]
        # A run's grid point has an equal word beside it too: this leaves out most words that are equal by chance.
        beside = (words[np.maximum(at - 1, 0)] == words[np.maximum(at - 1, 0) + q]) & (at > 0)
        beside |= (words[np.minimum(at + 1, n - 1 - q)] == words[np.minimum(at + 1, n - 1 - q) + q]) & (at + 1 < n - q)
        if beside.any():
            yield q[beside], at[beside]
        first = last


def _smallest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with the same start and length the one with the smallest period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], period[first]


def _verified(words: np.ndarray, start: int, length: int, q: int) -> bool:
    end = start + length
    return (
        np.array_equal(words[start : end - q], words[start + q : end])
        and (start == 0 or words[start - 1] != words[start - 1 + q])
        and (end == len(words) or words[end] != words[end - q])
    )


def runs_of(words: np.ndarray, base: int = 1_000_003) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(words)
    if n < SHORTEST:
        return []
    hashes = None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, at in _pairs(words):
        hashes = hashes or PrefixHashes(words, base)
        ahead = _longest(hashes, at, q, n - q - at, back=False)
        behind = _longest(hashes, at, q, at, back=True)
        start, length = at - behind, behind + ahead + q
        long = (length >= TIMES * q) & (length >= SHORTEST)
        found.append(_smallest(start[long], length[long], q[long]))
    if not found:
        return []
    start, length, period = _smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    out = sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2]))
    return out if all(_verified(words, *r) for r in out) else runs_of(words, base * 31 + 17)


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number in the order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join([w for w, depth in zip(words, np.cumsum(change).tolist(), strict=False) if not depth])


def find_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents(key, text, ...) -> key, runs: array of struct(start, length, period) by start, then period, collapsed: the text without the repeats."""
    kind = documents.schema[key].dataType.simpleString()
    small_batches(documents.sparkSession, BATCH_ROWS)
    row = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for value in batch.column("_text"):
                words = (value.as_py() or b"").split()
                own = runs_of(numbered(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapsed(words, own).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "runs": pa.array(runs, row), "collapsed": pa.array(texts, pa.string())})

    return documents.select(key, F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(run, f"{key} {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, of equals the first by start, then period; null if there is none. Compared as products of whole numbers, so exactly."""

    def better(acc: Column, r: Column) -> Column:
        more = acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"])
        return F.when(more, r).otherwise(acc)

    return F.aggregate(runs, F.get(F.slice(runs, 1, 0), 0), better)
