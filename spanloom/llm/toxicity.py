"""Operator 2: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Units are words (letters and digits only, lower case), runs of single characters written apart, two short words that stand side by side
as one, and windows of overlong words. The kernel of two units is the sum over all common subsequences of 3 to 5 characters with the gaps of
PATTERNS, each occurrence weighted by its length and by decay for each character left out: inserted characters lower a match, but don't
end it. A word with a letter behind each of its letters still holds all that it has in a row. Landmarks give a Nystroem map of that
kernel; a squared hinge support vector machine is trained on it. Labels are of whole texts, so the machine is trained on bags: the units
of a toxic text that are likeliest to be why share that text's weight as positives, and the choice is repeated with the machine trained
so far; units of clean texts are negatives, and those scored highest are added each time. Units chosen for many texts are positives in
bent forms as well, with letters put in at random, of the same weight as the plain form: the machine then weighs the subsequences that
survive. A text's score is the logistic function of its highest unit, fitted to the training texts, toxic ones also with their known
units bent.

The decision of one unit is a sum over landmarks of weighted kernels. Each kernel is an inner product over subsequences, so the
landmarks' weights are added up once into one table over hashed subsequences, and a unit costs one look-up for each of its own.

Null and empty texts, and those without letters or digits, get the score of a text whose highest unit has the value of the bias.
"""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fold, labelled_sample, small_batches

DECAY, BITS, LONGEST = 0.85, 18, 24
#: A subsequence of 3 to 5 characters is in a row, has characters left out at one place (one, or two of 4 characters), or one left out
#: everywhere, also but for the first place (behind the start mark): the offsets of its second and later characters.
PATTERNS = sorted(
    {tuple(itertools.accumulate(gaps)) for n in (2, 3, 4) for gaps in [(1,) * n, (2,) * n, (1,) + (2,) * (n - 1), *((1,) * i + (2,) + (1,) * (n - 1 - i) for i in range(n))]}
    | {tuple(itertools.accumulate((1,) * i + (3,) + (1,) * (2 - i))) for i in range(3)},
    key=lambda o: (len(o), o),
)
SPAN = max(o[-1] for o in PATTERNS) + 1
#: Weight of a subsequence by its length, besides decay for each character left out: the longer, the less it says by chance.
BY_LENGTH = {3: 0.4, 4: 0.8, 5: 1.2}
#: Two words side by side are also taken as one if neither is longer than SHORT and both together have JOINED characters.
SHORT, JOINED = 7, (4, 10)
#: Labelled texts of either kind from which on a fifth is kept aside for the logistic function.
ENOUGH = 150
#: Words in that share of the clean training texts are common.
COMMON = 0.08
#: A unit's value beyond which no text gets likelier to be toxic.
SURE = 1.5
#: Characters in a row that landmarks hold beside whole units: what of a unit survives letters put in.
PIECES = (3, 4, 5)
OTHER = re.compile(r"[\W_]+")
APART = re.compile(r"(?<![^\W_])(?:[^\W_][\W_]+){2,}[^\W_](?![^\W_])")
CACHED = 300_000


def units(text: str | None, common: frozenset[str] = frozenset()) -> set[str]:
    """The units of a whole text. Common words aren't joined with others: they are no halves of a word."""
    lower = (text or "").lower()
    row = lower.split()
    plain = {w: w if w.isalnum() else OTHER.sub("", w) for w in set(row)}
    found = set()
    for word in plain.values():
        if len(word) <= LONGEST:
            found.add(word)
        else:
            found.update(word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2))
    halves = {w: x if 0 < len(x) <= SHORT and x not in common else "" for w, x in plain.items()}
    half = [halves[w] for w in row]
    least, most = JOINED
    found.update([a + b for a, b in set(zip(half, half[1:], strict=False)) if a and b and least <= len(a) + len(b) <= most])
    for run in APART.findall(lower) if APART.search(lower) else ():
        run = OTHER.sub("", run)
        found.update(run[i : i + LONGEST] for i in range(0, max(1, len(run) - LONGEST // 2), LONGEST // 2))
    found.discard("")
    return found


def _characters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units as rows of code points with a start mark, padded with zeros; their lengths."""
    sizes = np.array([len(x) + 1 for x in names])
    flat = np.frombuffer("".join("\x02" + x for x in names).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.zeros((len(names), sizes.max(initial=1) + SPAN), np.uint32)
    chars[np.arange(chars.shape[1]) < sizes[:, None]] = flat
    return chars, sizes


def weight_of(offsets: tuple[int, ...]) -> float:
    return BY_LENGTH[len(offsets) + 1] * DECAY ** (offsets[-1] - len(offsets))


def _subsequences(names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of offsets: hashes at each start, where the pattern fits, and its weight."""
    chars, sizes = _characters(names)
    width = chars.shape[1] - SPAN
    at = np.arange(width)
    for offsets in PATTERNS:
        h = chars[:, :width] * np.uint32(0x9E3779B1)
        for n, o in enumerate(offsets):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + chars[:, o : o + width] * np.uint32(0xC2B2AE35 + 2 * n)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
        yield h >> np.uint32(32 - BITS), at < (sizes - offsets[-1])[:, None], weight_of(offsets)


def table_of(names: list[str], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of the units' normalised maps, over hashed subsequences."""
    out, norms = np.zeros(1 << BITS), unit_norms(names)
    for h, fits, w in _subsequences(names):
        np.add.at(out, h[fits], np.broadcast_to((weights / norms * w)[:, None], h.shape)[fits])
    return out


def unit_norms(names: list[str]) -> np.ndarray:
    return np.sqrt(np.maximum(sum((fits.sum(axis=1) * w * w for _, fits, w in _subsequences(names)), np.zeros(len(names))), 1e-12))


def against(names: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of kernels of each unit with what the table holds; table may have several columns."""
    total = np.zeros((len(names), *table.shape[1:]), np.float32)
    norm = np.zeros(len(names))
    for h, fits, w in _subsequences(names):
        got = table[h]
        got[~fits] = 0
        total += np.float32(w) * got.sum(axis=1)
        norm += fits.sum(axis=1) * w * w
    return total / np.sqrt(np.maximum(norm, 1e-12)).reshape(-1, *[1] * (table.ndim - 1))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of the squared-hinge machine, by Newton steps over the support vectors."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a, c = x[inside], cost[inside]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(penalty), (a * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


class ToxicityModel:
    """table: the landmarks' weighted maps added up; slope and shift: of the logistic function over the highest unit."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, shift: float, common: frozenset[str] = frozenset()) -> None:
        self.common = common
        self.table, self.bias, self.slope, self.shift = table.astype(np.float32), bias, slope, shift
        self._seen: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def decide(self, names: list[str]) -> np.ndarray:
        return against(names, self.table) + self.bias

    def highest(self, texts: list[str | None]) -> np.ndarray:
        bags = [units(x, self.common) for x in texts]
        seen = self._seen
        if len(seen) > CACHED:
            seen.clear()
        new = sorted(set().union(*bags).difference(seen), key=len)  # units of like length waste no places
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            seen.update(zip(part, self.decide(part).tolist(), strict=True))
        return np.array([max(map(seen.__getitem__, bag), default=self.bias) for bag in bags])

    def value(self, unit: str) -> float:
        return self._seen[unit] if unit in self._seen else float(self.decide([unit])[0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(self.highest(texts), SURE) + self.shift, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic regression with Platt's targets."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (p - target)) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.1)), float(w[1])


#: Weight of a unit's forms with a letter behind each of its letters, which match least, by that of the unit.
SPREAD_WEIGHT = 8.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _bent(name: str) -> list[str]:
    """The unit with characters put in, so that the machine is trained to bear that: two letters by chance at each place inside, each character doubled, and letters behind all characters, by chance or all the same. Chance depends on the unit only."""
    if not 4 <= len(name) <= LONGEST // 2:
        return []
    chance = random.Random(_order(name))
    out = [name[:i] + c + name[i:] for i in range(1, len(name)) for c in (*chance.sample(LETTERS, 2), name[i])]
    return list(dict.fromkeys([*out, *_spread(name)]))


def _spread(name: str) -> list[str]:
    """The unit with letters behind all its characters, by chance or all the same. What such forms have in common are the subsequences of characters in a row."""
    chance = random.Random(~_order(name))
    by_chance = ["".join(c + chance.choice(LETTERS) for c in name) for _ in range(12)]
    return by_chance + [c.join(name) for c in chance.sample(LETTERS, 6)] if 4 <= len(name) <= LONGEST // 2 else []


def _order(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def train(texts: list[str | None], toxic: list[int], landmarks: int = 192, rounds: int = 3, negatives: int = 4000, mined: int = 120_000, cost: float = 30.0, near: float = 1.5) -> ToxicityModel:
    """Trains on labelled texts. With one label only, every text gets that label's score."""
    aside: list[str | None] = []
    aside_y: list[int] = []
    if sum(toxic) >= ENOUGH and len(toxic) - sum(toxic) >= ENOUGH:
        rest = [zlib.crc32(b"aside" + (x or "").encode("utf-8", "surrogatepass")) % 5 == 0 for x in texts]
        aside, aside_y = [x for x, r in zip(texts, rest, strict=True) if r], [t for t, r in zip(toxic, rest, strict=True) if r]
        texts, toxic = [x for x, r in zip(texts, rest, strict=True) if not r], [t for t, r in zip(toxic, rest, strict=True) if not r]
    counted = Counter(w for x, t in zip(texts, toxic, strict=True) if not t for w in {OTHER.sub("", w) for w in (x or "").lower().split()})
    common = frozenset(w for w, n in counted.items() if n >= max(2, COMMON * len(texts)))
    bags = [sorted(units(x, common)) for x in texts]
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS), 0.0, 0.0, -6.0 if not len(y) or not y.max() else 6.0)
    in_toxic = Counter(u for bag, t in zip(bags, toxic, strict=True) if t for u in bag)
    in_clean = Counter(u for bag, t in zip(bags, toxic, strict=True) if not t for u in bag)
    n1, n0 = y.sum(), (1 - y).sum()
    odds = {u: np.log((n + 0.5) / (n1 + 1)) - np.log((in_clean[u] + 0.5) / (n0 + 1)) for u, n in in_toxic.items()}
    positive_bags = [bag for bag, t in zip(bags, toxic, strict=True) if t and bag]
    chosen = _likeliest(positive_bags, odds, near)
    clean = sorted(in_clean, key=lambda u: (-in_clean[u], _order(u), u))[:mined]
    hard = clean[:negatives]
    model = None
    for _ in range(rounds):
        positives = chosen
        marks = sorted(positives, key=lambda u: (-positives[u], u))[: landmarks // 8]
        pieces: Counter[str] = Counter()
        for u, n in positives.items():
            pieces.update(dict.fromkeys((u[i : i + k] for k in PIECES for i in range(len(u) - k + 1)), n))
        marks += sorted(pieces, key=lambda v: (-pieces[v] * len(v), v))[: landmarks * 5 // 8]
        marks = list(dict.fromkeys([*marks, *hard[::-1]]))[:landmarks]
        maps = np.empty((1 << BITS, len(marks)), np.float32)
        for i, u in enumerate(marks):
            maps[:, i] = table_of([u], np.ones(1))
        value, vector = np.linalg.eigh(against(marks, maps).astype(float))
        root = vector[:, value > 1e-3] / np.sqrt(value[value > 1e-3])
        share = {v: SPREAD_WEIGHT * positives[u] / len(_spread(u)) if v in _spread(u) else positives[u] / len(_bent(u)) for u in _known(positives) for v in _bent(u)}
        bent = sorted(set(share).difference(positives, in_clean))
        names = sorted(positives) + bent + sorted(set(hard) - set(positives))
        sign = np.array([1.0] * (len(positives) + len(bent)) + [-1.0] * (len(names) - len(positives) - len(bent)))
        weight = np.array([float(positives[u] if u in positives else share[u] if u in share else in_clean[u] ** 0.7) for u in names])
        for s in (1, -1):
            weight[sign == s] *= cost * (100 if s > 0 else 400) / max(weight[sign == s].sum(), 1)
        k = np.concatenate([against(names[i : i + 512], maps) for i in range(0, len(names), 512)])
        w = _svm(k @ root, sign, weight)
        model = ToxicityModel(maps @ (root @ w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0, common)
        value_of = dict(zip(clean, np.concatenate([model.decide(clean[i : i + 4096]) for i in range(0, len(clean), 4096)]).tolist(), strict=True)) if clean else {}
        hardest = sorted(value_of, key=value_of.get)[-negatives // 2 :]
        hard = list(dict.fromkeys([*hard[:negatives // 2], *hardest]))
        rest = sorted(set(in_toxic).difference(value_of))
        value_of |= dict(zip(rest, np.concatenate([model.decide(rest[i : i + 4096]) for i in range(0, len(rest), 4096)]).tolist(), strict=True)) if rest else {}
        chosen = _likeliest(positive_bags, {u: odds[u] + 0.4 * min(max(value_of[u], -1.0), 1.0) for u in odds}, near)
    # The logistic function is fitted to texts that the machine has not seen, where there are enough of them.
    last_texts, last_y = (aside, aside_y) if aside else (texts, toxic)
    forms = {u: float(np.median(model.decide(v))) for u in _known(chosen) if (v := _bent(u))}
    plain = model.highest(last_texts)
    last_bags = [units(x, common) for x, t in zip(last_texts, last_y, strict=True) if t]
    bent = np.array([max((forms[u] if u in forms else model.value(u) for u in bag), default=model.bias) for bag in last_bags])
    y = np.array(last_y, float)
    values, weights = np.minimum(np.r_[plain, bent], SURE), np.r_[np.where(y == 1, 0.5, 1.0), np.full(len(bent), 0.5)]
    model.slope, model.shift = _logistic(values, np.r_[y, np.ones(len(bent))], weights)
    return model


def _likeliest(bags: list[list[str]], odds: dict[str, float], near: float) -> dict[str, float]:
    """Each text's weight of 1, shared by its units with odds near the best: a text with two insults teaches both."""
    out: dict[str, float] = {}
    for bag in bags:
        best = max(odds[u] for u in bag)
        own = [u for u in bag if odds[u] >= best - near]
        for u in own:
            out[u] = out.get(u, 0.0) + 1 / len(own)
    return out


def _known(positives: dict[str, float]) -> list[str]:
    """Units that stand for several texts: over 1, and a fiftieth of all."""
    least = max(1.0, sum(positives.values()) / 50)
    return sorted(u for u, n in positives.items() if n > least)


def fit(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = 1200, seed: int = 7) -> ToxicityModel:
    """Trains on at most per_class labelled texts of either kind, for which keep holds."""
    rows = labelled_sample(documents, labels, "toxic", keep, per_class, seed)
    return train([r.text for r in rows], [r.label for r in rows])


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, score, predicted. One row for each document, no shuffle; null ids and texts are kept."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out(modulus: int, rest: int) -> Column:
    return (fold("doc_id", modulus) == rest).alias("held_out")
