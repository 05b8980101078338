"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, convolved with learned filters (width 8, stride 4) and max-pooled over chunks of 512 bytes that
overlap by half and together cover the whole text. The chunks' pooled filters are combined by their mean and their maximum over all
chunks, and two dense layers give one probability. Training is plain numpy as well (Adam on the log loss).

Null and empty texts are one chunk of padding. Very long texts are convolved in pieces, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import labelled_sample, small_batches

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN, CHUNK = 8, 8, 4, 32, 16, 512
HALF = CHUNK // 2
STEPS = HALF // STRIDE  # filter positions in half a chunk
#: Half chunks convolved at once.
PIECE = 2048
PAD = 256


def _codes(text: str | None) -> np.ndarray:
    """Bytes of the text, padded to whole half chunks (two at least) and by what the last filter reaches beyond."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    halves = max(2, -(-len(raw) // HALF))
    out = np.full(halves * HALF + WIDTH - STRIDE, PAD, np.int64)
    out[: len(raw)] = raw
    return out


class QualityModel:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (257, EMBED)),
            "filters": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "w1": rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
            "b1": np.zeros(HIDDEN),
            "w2": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _windows(self, codes: np.ndarray) -> np.ndarray:
        """Embedded bytes under each position of the filters."""
        x = np.ascontiguousarray(self.p["embed"][codes]).reshape(-1)
        n = (len(codes) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))

    def _halves(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum of each filter in the half chunk at each start, before the rectifier. Products of one size each, so that no row's rounding depends on the others."""
        out = np.empty((len(starts), FILTERS), np.float32)
        for i in range(0, len(starts), PIECE):
            own = starts[i : i + PIECE]
            windows = self._windows(codes[own[0] : own[-1] + HALF + WIDTH - STRIDE])
            rows = (own[:, None] - own[0]) // STRIDE + np.arange(STEPS)
            out[i : i + PIECE] = (windows[rows] @ self.p["filters"]).max(axis=1)
        return out

    def _head(self, mean: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([mean, most], axis=1)
        hidden = np.maximum((x[:, None] @ self.p["w1"])[:, 0] + self.p["b1"], 0)  # row by row, as above
        return x, hidden, 1 / (1 + np.exp(-np.clip((hidden[:, None] @ self.p["w2"][:, None])[:, 0, 0] + self.p["b2"], -40, 40)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        mean, most = np.empty((len(texts), FILTERS), np.float32), np.empty((len(texts), FILTERS), np.float32)
        group: list[np.ndarray] = []
        held, start = 0, 0

        def settle(end: int) -> None:
            nonlocal start, held
            if not group:
                return
            counts = [len(c) // HALF for c in group]
            places = np.cumsum([0] + [len(c) for c in group[:-1]])  # each text keeps its own padding
            halves = self._halves(np.concatenate(group), np.concatenate([p + HALF * np.arange(n) for p, n in zip(places, counts, strict=True)]))
            at = 0
            for i, n in zip(range(start, end), counts, strict=True):
                mean[i], most[i] = self._pool(halves[at : at + n])
                at += n
            group.clear()
            start, held = end, 0

        for i, text in enumerate(texts):
            group.append(_codes(text))
            held += len(group[-1])
            if held > PIECE * HALF // 2:
                settle(i + 1)
        settle(len(texts))
        return self._head(mean, most)[2]

    def _pool(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunks = np.maximum(np.maximum(halves[:-1], halves[1:]) + self.p["bias"], 0)
        return chunks.mean(axis=0), chunks.max(axis=0)

    def train(self, texts: list[str | None], good: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.004, seed: int = 5) -> QualityModel:
        rng = np.random.default_rng(seed)
        codes = [_codes(x) for x in texts]
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        total = epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                grads = self._gradients([codes[i] for i in order[at : at + batch]], good[order[at : at + batch]])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def _gradients(self, codes: list[np.ndarray], good: np.ndarray) -> dict[str, np.ndarray]:
        p, parts, means, mosts = self.p, [], [], []
        for c in codes:
            windows = self._windows(c)
            z = (windows @ p["filters"]).reshape(-1, STEPS, FILTERS)
            where = z.argmax(axis=1)
            halves = np.take_along_axis(z, where[:, None], axis=1)[:, 0]
            second = halves[1:] > halves[:-1]  # which half holds the chunk's maximum
            chunks = np.maximum(np.maximum(halves[:-1], halves[1:]) + p["bias"], 0)
            best = chunks.argmax(axis=0)
            means.append(chunks.mean(axis=0))
            mosts.append(chunks.max(axis=0))
            parts.append((c, windows, where, second, chunks, best))
        x, hidden, out = self._head(np.array(means), np.array(mosts))
        d = ((out - good) / len(codes)).astype(np.float32)
        grads = {"w2": hidden.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * p["w2"] * (hidden > 0)
        grads |= {"w1": x.T @ dh, "b1": dh.sum(axis=0)}
        dx = dh @ p["w1"].T
        grads |= {"filters": np.zeros_like(p["filters"]), "bias": np.zeros_like(p["bias"]), "embed": np.zeros_like(p["embed"])}
        columns = np.arange(FILTERS)
        for (c, windows, where, second, chunks, best), dmean, dmost in zip(parts, dx[:, :FILTERS], dx[:, FILTERS:], strict=True):
            dc = np.repeat(dmean[None] / len(chunks), len(chunks), axis=0)
            dc[best, columns] += dmost
            dc *= chunks > 0
            grads["bias"] += dc.sum(axis=0)
            dhalf = np.zeros((len(chunks) + 1, FILTERS), np.float32)
            dhalf[:-1] += dc * ~second
            dhalf[1:] += dc * second
            row, col = np.nonzero(dhalf)
            at = row * STEPS + where[row, col]
            g = dhalf[row, col]
            grads["filters"] += np.stack([np.bincount(col, g * windows[at, k], FILTERS) for k in range(WIDTH * EMBED)]).astype(np.float32)
            back = g[:, None] * p["filters"][:, col].T
            code = c[at[:, None] * STRIDE + np.arange(WIDTH)]
            for e in range(EMBED):
                grads["embed"][:, e] += np.bincount(code.ravel(), back[:, e::EMBED].ravel(), 257).astype(np.float32)
        return grads


def fit(documents: DataFrame, labels: DataFrame, keep: Column, per_class: int = 1000, seed: int = 11) -> QualityModel:
    """Trains on at most per_class labelled texts of either kind, for which keep holds. With one label only, every text gets it."""
    rows = labelled_sample(documents, labels, "quality", keep, per_class, seed)
    counts = labels.where(keep).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).first()
    return train([r.text for r in rows], [r.label for r in rows], counts.good / max(counts.bad, 1))


def train(texts: list[str | None], good: list[int], odds: float = 1.0) -> QualityModel:
    """odds: of good to bad among all labelled texts; the logarithm of their ratio to the odds trained on is added to the last bias."""
    y, model = np.array(good, np.float32), QualityModel()
    if not len(y) or y.min() == y.max():
        model.p["w2"][:] = 0
        model.p["b2"][:] = -6 if len(y) and not y.max() else 6
        return model
    few = np.flatnonzero(y == (1 if y.mean() < 0.5 else 0))
    most = min(len(y) - len(few), 600)
    order = np.r_[np.arange(len(y)), np.resize(few, max(0, most - len(few)))]  # the rarer label is repeated up to balance
    model.train([texts[i] for i in order], y[order], epochs=max(6, min(40, 7000 // max(len(order), 1))))
    trained = float(y[order].sum() / (len(order) - y[order].sum()))
    model.p["b2"] += np.float32(np.log(min(max(odds, 0.05), 20.0) / trained))
    return model


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """documents(doc_id, text, ...) -> doc_id, score, predicted. One row for each document, no shuffle; null ids and texts are kept."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column("text").to_pylist()).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold; no shuffle."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column("text").to_pylist()) >= threshold))

    return documents.mapInArrow(rows, documents.schema)
