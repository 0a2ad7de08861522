"""Whitening against numpy's own decomposition, in exact arithmetic where that is asked for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import whitening

SMALL = "/root/testdata/sf0.001"


def brute(x, k=4):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_query_equals_brute_force(spark):
    got = whitening.op11_whitening(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, whitened, explained = brute(np.floor(256 * np.stack(rows.embedding).astype(float)).astype(np.int64))
    assert got.vec_id.tolist() == np.repeat(rows.vec_id, 4).tolist() and got.component.tolist() == [1, 2, 3, 4] * len(rows)
    assert (got.n == n).all() and got.deviation.tolist() == np.repeat(deviation, 4).tolist()
    mine = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(mine - whitened * np.sign((mine * whitened).sum(axis=0))).max() < 1e-10
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained[:4], rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10


@pytest.mark.parametrize("shape", [(40, 1), (40, 2), (200, 7), (64, 32), (5, 5)])
def test_rotations_decompose(shape):
    a = np.random.default_rng(3).normal(size=shape) @ np.diag(10.0 ** -np.arange(shape[1]))
    lengths, components = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(components @ components.T, np.eye(shape[1]), atol=1e-13)
    assert np.allclose((a @ components.T).T @ (a @ components.T), np.diag(lengths**2), atol=1e-12)
    assert (np.diff(lengths) <= 0).all() and np.allclose(lengths[:4], np.linalg.svd(a, compute_uv=False)[:4], rtol=1e-9)


def test_rotations_keep_the_digits_of_small_deviations():
    # columns of very different length, which a product of the matrix with itself would blur
    a = np.linalg.qr(np.random.default_rng(4).normal(size=(50, 5)))[0] @ np.diag([1.0, 1e-4, 1e-8, 1e-12, 1e-16])
    lengths, _ = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.allclose(lengths, [1.0, 1e-4, 1e-8, 1e-12, 1e-16], rtol=1e-10)


def test_blocks_and_tree_give_the_factor_of_the_whole():
    rows = np.random.default_rng(5).normal(size=(300, 6))
    whole = np.linalg.qr(rows, mode="r")
    parts = [whitening.fold(whitening.fold(None, rows[i : i + 30]), rows[i + 30 : i + 60]) for i in range(0, 300, 60)]
    joined = None
    for p in parts:
        joined = whitening.fold(joined, p)
    assert np.allclose(joined.T @ joined, whole.T @ whole)


def frame(spark, rows):
    clash = {c: F.lit("clash") for c in ("id", "x", "dim", "n", "sums", "r", "whitened", "deviation", "component", "at", "whitened_x")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(30)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [1.0, math.inf, 2.0])]
    more = [(0, good[0][1]), (None, good[1][1]), (None, good[1][1]), (7, [0.5, 0.25]), (8, [1.5, 0.25]), (109, [4.0])]
    got = whitening.whitened_components(frame(spark, good + odd + more).repartition(7)).toPandas()
    three = got[got.n == 30].sort_values(["id", "component"], kind="stable", na_position="last")
    assert len(three) == 33 * 3 and not set(got.id.dropna()) & {100, 101, 102, 103, 104, 109}
    x = np.floor(256 * np.array([np.float32(v) for _, v in good], float)).astype(np.int64)
    n, deviation, whitened, explained = brute(x, 3)
    once = three[three.id > 0].whitened.to_numpy().reshape(-1, 3)
    assert n == 30 and np.abs(np.abs(once) - np.abs(whitened[1:])).max() < 1e-9
    assert three[three.id == 0].groupby("component").deviation.apply(list).tolist() == [[deviation[0]] * 2] * 3
    assert (three[three.id.isna()].deviation == deviation[1]).all() and three.explained.sum() == pytest.approx(33)
    # two vectors that differ in one dimension have one component, a single vector has none
    assert sorted(zip(got[got.n == 2].id, got[got.n == 2].component, got[got.n == 2].whitened.abs())) == [(7, 1, 1.0), (8, 1, 1.0)]
    assert whitening.whitened_components(frame(spark, [])).count() == 0 and whitening.whitened_components(frame(spark, odd)).count() == 0


def test_slices_and_trees_of_tasks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=(5, 3)[i % 4 == 0])]) for i in range(300)]
    told = lambda: {(r.id, r.component): r for r in whitening.whitened_components(frame(spark, rows).repartition(9)).collect()}
    want = told()
    monkeypatch.setattr(whitening, "SLICE", 20), monkeypatch.setattr(whitening, "BLOCK", 8), monkeypatch.setattr(whitening, "FAN_IN", 2)
    got = told()
    assert got.keys() == want.keys() and len(got) == 75 * 3 + 225 * 4
    assert all(got[k].deviation == r.deviation and abs(got[k].whitened - r.whitened) < 1e-11 and abs(got[k].explained - r.explained) < 1e-13 for k, r in want.items())


def test_deviations_are_exact_beyond_doubles(spark):
    rows = [(i, [float(1 << 20) + i, float(i % 3)]) for i in range(50)]
    got = whitening.whitened_components(frame(spark, rows), k=1).collect()
    x = [[256 * int(v) for v in e] for _, e in rows]
    sums = [sum(c) for c in zip(*x)]
    assert {r.id: r.deviation for r in got} == {i: sum((50 * v - s) ** 2 for v, s in zip(x[i], sums)) for i in range(50)}
    fit = whitening.Whitening(10**9, [0, 0], np.eye(2), np.ones(2))
    assert fit.squared(np.array([[3 * 10**9, -7]])) == [(3 * 10**18) ** 2 + (7 * 10**9) ** 2]
