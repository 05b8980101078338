"""Whitening, nearest neighbours and periodic runs against plain versions, and their hard inputs."""

import hashlib
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from spanloom.llm import neighbours, periodic_runs, queries, whitening
from spanloom.llm.common import save


def _embeddings(spark, sf=SF):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id bigint, embedding array<double>, x bigint, vector string")


# Operator 11


def test_op11_equals_an_eigendecomposition(spark):
    ids, vectors = _embeddings(spark)
    x = np.floor(1024 * vectors).astype(np.int64) + 100000
    n = len(x)
    values, components = np.linalg.eigh(np.cov(x.T, bias=True))
    values, components = values[::-1][:8], components[:, ::-1][:, :8]
    want = (x - x.mean(axis=0)) @ components / np.sqrt(values)
    got = queries.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert (got["component"].to_numpy().reshape(n, 8) == np.arange(1, 9)).all()
    w = got["whitened"].to_numpy().reshape(n, 8)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:8] / (values / np.trace(np.cov(x.T, bias=True))) - 1).max() < 1e-10
    assert (got["deviation"].to_numpy()[::8] == ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert got["residual"].max() < 1e-13


@pytest.mark.parametrize("spectrum", ["even", "close", "steep", "low rank"])
def test_lobpcg_certifies_its_residuals(spectrum):
    rng = np.random.default_rng(3)
    d = 150
    e = {"even": np.linspace(1, 2, d), "close": 1 + 1e-6 * np.arange(d), "steep": 10.0 ** -np.arange(d), "low rank": np.r_[np.ones(3), np.zeros(d - 3)]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    values, vectors, residuals, products = whitening.lobpcg(lambda w: a @ w, d, 8)
    assert np.allclose(values, np.sort(e)[::-1][:8], rtol=1e-12, atol=1e-14)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * values[0] and residuals.max() < 1e-13
    assert products < 250


def test_op11_leaves_out_what_is_no_vector(spark):
    good = [(i, [float(np.sin(i * k)) for k in range(1, 4)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0])]
    plain = whitening.whiten_embeddings(_vectors(spark, good)).orderBy("vec_id", "component").collect()
    mixed = whitening.whiten_embeddings(_vectors(spark, good + bad).repartition(5)).orderBy("vec_id", "component").collect()
    assert len(plain) == 90  # three dimensions, three components
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in plain] == [(r.vec_id, r.component, r.n, r.deviation) for r in mixed]
    assert np.allclose([r.whitened for r in plain], [r.whitened for r in mixed], atol=1e-9)


def test_op11_without_variance(spark):
    assert whitening.whiten_embeddings(_vectors(spark, [])).collect() == []
    equal = whitening.whiten_embeddings(_vectors(spark, [(1, [0.5, 2.0]), (None, [0.5, 2.0])])).collect()
    assert len(equal) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in equal)
    line = whitening.whiten_embeddings(_vectors(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True] * 5
    huge = whitening.whiten_embeddings(_vectors(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and max(abs(r.whitened) for r in huge if r.whitened is not None) < 2


# Operator 12


def _exact(ids, vectors, asked, k=20):
    found = {}
    for q in asked:
        s = (vectors * vectors[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        found[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k] if np.isfinite(s[i])]
    return found


def _recall(got, want):
    for q, listed in got.items():
        assert [r["rank"] for r in listed] == list(range(1, len(listed) + 1)) and len(listed) == len(want[q])
        order = [(-r["score"], r["vec_id"]) for r in listed]
        assert order == sorted(order) and q not in {r["vec_id"] for r in listed}
    assert set(got) == set(want)
    return sum(len({r["vec_id"] for r in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def _grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_op12_recall_against_all_rows(spark, sf):
    ids, vectors = _embeddings(spark, sf)
    got, want = _grouped(queries.op12_neighbours(spark, sf)), _exact(ids, vectors, ids[ids % 20 == 0])
    assert _recall(got, want) >= 0.95
    exact = {(q, i): s for q, listed in want.items() for i, s in listed}
    for q, listed in got.items():
        for r in listed:
            assert r["score"] == pytest.approx((vectors[ids == q][0] * vectors[ids == r["vec_id"]][0]).sum(), abs=1e-14) and exact.get((q, r["vec_id"]), r["score"]) == r["score"]


def test_op12_clusters_copies_and_uneven_norms(spark):
    """Several chunks of queries, blocks of which each holds a part, groups of near and exact copies, and norms from 1e-3 to 1e3."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    v = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.standard_normal((3000, 24))
    v[:400] = v[0]
    v[400:800] = v[400] + 1e-3 * rng.standard_normal((400, 24))
    v *= 10.0 ** rng.uniform(-3, 3, 3000)[:, None] ** np.where(np.arange(3000) < 800, 0, 1)[:, None]
    ids = np.arange(3000)
    rows = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id bigint, embedding array<double>")
    vectors = neighbours.indexed(rows, "vec_id", "embedding")
    got = _grouped(neighbours.nearest(vectors, vectors.where("number % 20 = 0"), 20, chunk=64))
    assert _recall(got, _exact(ids, v, ids[ids % 20 == 0])) >= 0.95


def test_block_search_verifies_few_and_misses_little():
    """Planted neighbours in 8,192 random vectors: all found, a small share verified."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((8192, 64))
    q = v[:50] + 0.3 * rng.standard_normal((50, 64))
    for i in range(50):
        v[100 + 20 * i : 120 + 20 * i] = q[i] + 0.25 * rng.standard_normal((20, 64))
    best = neighbours.Best(q, list(range(-50, 0)), 20)
    verified = best.search(neighbours.Block(v, np.arange(8192)))
    scores = q @ v.T
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(want[i]) & set(best.numbers[i])) / 20 for i in range(50)]) >= 0.95
    assert verified < 0.35 * 50 * 8192


def test_collisions_count_windows_or_what_they_leave_out():
    rng = np.random.default_rng(7)
    block = neighbours.Block(rng.standard_normal((300, 8)), np.arange(300), 16)
    at = rng.standard_normal((5, 16)) * 0.3
    projected = np.take_along_axis(block.sorted, block.order.argsort(axis=1), axis=1)
    for half in (0.02, 0.2, 0.6):
        low, high = block.windows(at, np.full(5, half))
        for i in range(5):
            assert (block.collisions(low[i], high[i]) == (np.abs(projected - at[i][:, None]) <= half).sum(axis=0)).all()


def test_op12_hard_inputs(spark):
    ask = F.col("number") % 20 == 0
    assert neighbours.nearest_neighbours(_vectors(spark, []), ask).collect() == []
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [2.0, 1.0]), (9, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [0.5, 0.1]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0])]
    found = _grouped(neighbours.nearest_neighbours(_vectors(spark, rows), ask))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found[0]] == [(1, 7, 2.0), (2, 8, 0.5), (3, 9, 0.5), (4, None, 0.5), (5, 20, -1.0), (6, 20, -1.0)]
    assert [r["vec_id"] for r in found[20]] == [8, 9, None, 0, 7]  # its own rows are left out, and it asks once
    assert neighbours.nearest_neighbours(_vectors(spark, [(0, [1.0])]), ask).collect() == []


# Operator 13


def _plain_row(doc_id, text):
    words = brute.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute.periodic_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op13_equals_brute_force(spark):
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, SF).collect()))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(_plain_row(r[0], r[1]) for r in texts)
    assert sum(r[1] for r in got) > 20


def test_runs_of_random_words():
    rng = np.random.default_rng(8)
    for _ in range(1500):
        words = rng.integers(0, rng.integers(1, 4), rng.integers(0, 70))
        assert periodic_runs.runs_of(words) == brute.periodic_runs(words.tolist())


def test_runs_survive_hashes_that_lie(monkeypatch):
    """With a base of 1 a hash only tells which words a stretch holds; verification notices and another base is taken."""
    words = np.array([0, 1, 1, 0, 2, 0, 1, 1, 0, 1, 0, 0, 1] * 9 + [3, 1, 0] * 5)
    assert periodic_runs.runs_of(words, base=1) == brute.periodic_runs(words.tolist())
    monkeypatch.setattr(periodic_runs, "PAIRS", 3)
    assert periodic_runs.runs_of(words) == brute.periodic_runs(words.tolist())


def test_op13_hard_inputs(spark):
    long = " ".join(["a", "b", "c"] * 60_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 6), (5, "x " * 5), (6, long), (6, long), (None, "a b a b a b a b"), (7, "é ü " * 8), (8, "A a " * 2)]
    df = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], "doc_id bigint, text string, runs string, _text int")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(df).collect()}
    assert got[1] == got[2] == got[3] == ([], "")
    assert got[4] == ([(0, 6, 1)], "x") and got[5] == ([], "x x x x x")
    assert got[6] == ([(0, 180_000, 3)], "a b c") and got[None] == ([(0, 8, 2)], "a b")
    assert got[7] == ([(0, 8, 1)], "é ü") and got[8] == ([], "A a A a")
    assert periodic_runs.find_runs(df.where("false")).collect() == []
    top = df.sparkSession.createDataFrame([([(0, 9, 2), (20, 18, 4), (3, 4, 1)],), ([],)], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r[0] and tuple(r[0]) for r in top.select(periodic_runs.strongest(F.col("runs"))).collect()] == [(0, 9, 2), None]


def test_saved_rows_are_what_passes_read(spark):
    rows = save(whitening.whole_numbers(_vectors(spark, [(1, [0.1, -0.1])]), "vec_id", "embedding"), "whole")
    assert rows.collect()[0]["x"] == [100102, 99897]


def test_op13_loops_empty_and_short_texts(spark):
    """The texts that the query loops: null, empty, blank and one-word ones as they are; others as a plain version has them."""
    texts = [None, "", " \n", "a", "a b c d e f g h i j k l"]
    rows = [(i, texts[i % 5]) for i in range(400)] + [(None, "a b")]
    got = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", queries.looped_text(F.col("doc_id"), F.col("text")).alias("t")).collect()
    looped = 0
    for r in got:
        words = (r["text"] or "").split()
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(words)
        if r["doc_id"] is None or h % 10 or not n:
            assert r["t"] == r["text"]
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r["t"].split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        looped += n > 1
    assert looped > 3
