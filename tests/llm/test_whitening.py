"""Whitening against a dense eigendecomposition, and the iteration on hard spectra."""

import math
from decimal import Decimal

import numpy as np
import pytest

from veilscan.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, n long"


def table(spark, vectors, first=1):
    rows = [(i, v, 0, "kept", 5) for i, v in enumerate(vectors, first)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plainly(vectors, k=8):
    """Integers, exact deviations, and whitened values up to the sign."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    far = [[n * row[j] - sums[j] for j in range(d)] for row in x]
    deviations = [sum(v * v for v in row) for row in far]
    centred = np.array(far, float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    real = values > 1e-12 * max(values[0], 0)
    values, basis = values[real], basis[:, real]
    return deviations, centred @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(spark, vectors, frame=None, k=8):
    found = whitening.whiten(table(spark, vectors) if frame is None else frame, k=k).collect()
    deviations, white, explained = plainly(vectors, k)
    assert len(found) == white.size
    by_place = {(r.vec_id, r.component): r for r in found}
    mine = np.array([[by_place[i, c + 1].whitened for c in range(white.shape[1])] for i in range(1, len(vectors) + 1)])
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * signs).max() < 1e-8
    for r in found:
        assert r.n == len(vectors) and r.deviation == deviations[r.vec_id - 1]
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert r.identity_error < 1e-9
    return found


def vectors(n, d, seed=0, scale=1.0):
    made = np.random.default_rng(seed)
    shape = made.standard_normal((d, d)) * np.linspace(2, 0.2, d)
    return (scale * made.standard_normal((n, d)) @ shape).astype(np.float32).tolist()


@pytest.mark.parametrize(("n", "d", "k"), [(200, 12, 8), (60, 5, 8), (6, 12, 8), (2, 3, 8), (90, 24, 3)])
def test_same_as_dense(spark, n, d, k):
    check(spark, vectors(n, d), k=k)


def test_through_the_filter(spark):
    values = vectors(300, 40, seed=4)
    rows = whitening.usable(table(spark, values))
    model = whitening.fit(rows, k=3)
    assert model.block < 40 and model.passes > 5
    check(spark, values, k=3)


def test_odd_rows(spark):
    good = vectors(50, 4)
    rows = [(i, v, 0, "x", 5) for i, v in enumerate(good, 1)]
    rows += [
        (900, None, 0, "x", 5), (901, [], 0, "x", 5), (902, [1.0, None, 2.0, 3.0], 0, "x", 5),
        (903, [1.0, math.nan, 2.0, 3.0], 0, "x", 5), (904, [1.0, math.inf, 2.0, 3.0], 0, "x", 5),
        (905, [1.0, 2.0], 0, "x", 5), (906, [1e20, 0.0, 0.0, 0.0], 0, "x", 5),
    ]
    check(spark, good, spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_ids_pass_through(spark):
    values = vectors(10, 3)
    rows = [(None if i < 2 else 7, v, 0, "x", 5) for i, v in enumerate(values + values[:1])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.component) for r in found) == sorted(
        (i < 2, c) for i in range(11) for c in (1, 2, 3)
    )
    of_first = [[r.whitened for r in found if r.component == c] for c in (1, 2, 3)]
    assert all(len(x) - len(set(x)) == 1 for x in of_first)  # the repeated vector


def test_nothing_to_whiten(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [None, []], [[1.0, 2.0]] * 5, [[3.0, 4.0]]):
        found = whitening.whiten(table(spark, rows))
        assert found.columns == columns and found.count() == 0


def test_deviations_beyond_64_bits():
    far = np.array([[3_000_000_000, -4_000_000_001], [1, 2]])
    found = whitening._deviations(far).to_pylist()
    assert found == [Decimal(3_000_000_000**2 + 4_000_000_001**2), Decimal(5)]


def spectrum(values):
    made = np.random.default_rng(1)
    q = np.linalg.qr(made.standard_normal((len(values), len(values))))[0]
    v = (q * np.asarray(values, float)) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "falling": 1 / np.arange(1, 201) ** 2,
    "equal": np.ones(200),
    "almost equal": 1 + 1e-6 * np.random.default_rng(0).random(200),
    "few": np.r_[np.ones(5), np.zeros(195)],
    "one ahead": np.r_[1e6, np.linspace(2, 1, 199)],
    "steps": np.r_[1e9, 1e6, 1e3, np.linspace(2, 1, 197)],
    "ties at the edge": np.r_[[5] * 20, np.linspace(2, 1, 180)],
    "narrow band": np.linspace(1.1, 1, 200),
    "zero": np.zeros(200),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_hard_spectra(name):
    v = spectrum(SPECTRA[name])
    products = 0

    def times(q):
        nonlocal products
        products += 1
        return v @ q

    basis, values, _ = whitening.leading(times, 200, 8)
    expected = np.sort(SPECTRA[name])[::-1][:8]
    assert np.abs(values - expected).max() <= 1e-12 * max(expected[0], 1e-300)
    assert np.abs(basis.T @ basis - np.eye(8)).max() < 1e-12
    assert np.linalg.norm(v @ basis - basis * values, axis=0).max() <= 1e-12 * max(expected[0], 1e-300)
    assert products < 200
