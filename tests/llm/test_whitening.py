"""Whitening against eigenvectors of another solver and exact integers, and on odd rows."""

import math

import numpy as np
import pytest

from tessellon.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], SCHEMA).repartition(parts)


def by_definition(vectors, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in np.float32(v)] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    dev = [int(((n * r - sums) ** 2).sum()) for r in x]
    c = (x - 1_000_000).astype(float)
    c -= c.mean(0)
    cov = c.T @ c / n
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    return dev, values, c @ found / np.sqrt(np.maximum(values, 1e-300)), np.trace(cov)


def test_symmetric_qr_against_another_solver():
    rng = np.random.default_rng(1)
    cases = [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.diag([3.0, -1, 3]), np.array([[2.0]])]
    cases += [a + a.T for a in (rng.normal(size=(n, n)) * 10.0 ** rng.integers(-6, 6) for n in (2, 3, 9, 33))]
    for a in cases:
        values, q = whitening.symmetric_qr(a)
        size = max(1e-300, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-12 * size * len(a))
        assert np.abs(q @ np.diag(values) @ q.T - a).max() <= 1e-12 * size * len(a) and np.abs(q.T @ q - np.eye(len(a))).max() < 1e-12


def test_states_merge_to_the_state_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (90, 5))
    one, parts = whitening.State.empty(5), []
    one.add(x.astype(float))
    one.add_exact(x)
    for piece in (x[:1], x[1:1], x[1:40], x[40:]):
        parts.append(whitening.State.empty(5))
        parts[-1].add(piece.astype(float))
        parts[-1].add_exact(piece)
    got = parts[0]
    for p in parts[1:]:
        got = got.merge(p)
    assert got.n == 90 and got.sums == one.sums == x.sum(0).tolist()
    assert np.allclose(got.covariance(), np.cov(x.T, bias=True), rtol=1e-12, atol=1e-12) and np.allclose(one.covariance(), got.covariance(), atol=1e-10)


@pytest.mark.parametrize("fan_in", [16, 2])
def test_whitening_by_definition(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 40)) * np.linspace(0.2, 3, 40)).astype(np.float32)
    got = whitening.whiten(frame(spark, [(k, v.tolist()) for k, v in enumerate(vectors)], 9)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 300 * 32
    dev, values, want, trace = by_definition(vectors)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(table * np.sign((table * want).sum(0)) - want).max() < 1e-9
    assert got[got.component == 5].sort_values("vec_id").deviation.tolist() == dev
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, values / trace, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9 and (got.n == 300).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [1.0, 2.5, -3.0], [1.0, 0.0, 3.0], [1.0, 0.0, 3.0]]
    rows = [(1, good[0]), (None, good[1]), (2, good[2]), (2, good[3]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [1.0, -inf, 0.0]), (8, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 12 and (got.n == 4).all() and sorted(got.vec_id.dropna()) == [1] * 3 + [2] * 6
    dev, values, want, _ = by_definition(good)
    assert sorted(got[got.component == 1].deviation) == sorted(dev)
    last = got[got.component == 3]
    assert last.whitened.isna().all() and (last.explained.abs() < 1e-12).all() and got[got.component < 3].whitened.notna().all()
    assert np.allclose(sorted(got[got.component == 1].whitened.abs()), sorted(np.abs(want[:, 0])), atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_left(spark, rows):
    got = whitening.whiten(frame(spark, rows))
    assert got.collect() == [] and got.columns[0] == "vec_id"


def test_one_vector_has_no_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]


def test_sums_and_deviations_beyond_64_bits():
    model = whitening.Whitening(1 << 40, [5 << 60, 1], np.eye(2), np.ones(2), np.ones(2))
    x = np.array([[1 << 49, 3], [(5 << 60) >> 40, 0]])
    want = [sum(((1 << 40) * int(v) - s) ** 2 for v, s in zip(r, model.sums, strict=True)) for r in x]
    assert model.deviations(x) == [w if w < 1 << 63 else None for w in want] and model.deviations(x)[1] is not None
    state = whitening.State.empty(1)
    state.add_exact(np.full((10_000, 1), 1 << 50))
    assert state.sums == [10_000 << 50]
