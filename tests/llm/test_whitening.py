"""Whitening against numpy on whole tables, and by its own properties."""

import math

import numpy as np
import pytest

from tallyhouse.llm import whitening
from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.whitening import whiten
from tests.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<double>, mark int, place string, index string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    centred = apart.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, len(values))
    return (apart**2).sum(axis=1), centred @ (axes[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


def agrees(rows, vectors, near=1e-9):
    """Rows hold distinct ids 0, 1, ...; either sign of a component is right, the same for all rows."""
    deviation, white, shares = brute(vectors)
    rows = sorted(rows, key=lambda r: r.vec_id)
    assert [r.deviation for r in rows] == deviation.tolist()
    found = np.array([r.whitened for r in rows])
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found * signs - white).max() < near
    assert np.allclose([r.explained for r in rows], shares, rtol=1e-9)
    assert np.abs(found.T @ found / len(rows) - np.eye(found.shape[1])).max() < 1e-9
    assert all(r.identity_error < 1e-9 and r.n == len(vectors) for r in rows)


def test_whole_table(spark):
    found = QUERIES["op12_whitening"](spark, SMALL)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    deviation, white, shares = brute([vectors[i] for i in ids])
    got = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(got) == len(ids) * 32
    for j in range(32):
        column = np.array([got[i, j + 1].whitened for i in ids])
        assert min(np.abs(column - white[:, j]).max(), np.abs(column + white[:, j]).max()) < 1e-8
        assert got[ids[0], j + 1].explained == pytest.approx(shares[j], rel=1e-9)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert max(r.identity_error for r in got.values()) < 1e-9


def test_unusable_vectors(spark, folder):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(30, 4)) @ np.diag([5, 3, 2, 1]) + 900).tolist()
    bad = [None, [1.0, None, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0], [1.0, math.inf, 0.0, 0.0], [1.0, 2.0, -math.inf, 0.0], [], [1.0, 2.0]]
    found = whiten(frame(spark, [*enumerate(good), *((100 + i, v) for i, v in enumerate(bad))]), folder).collect()
    assert len(found) == len(good)
    agrees(found, good)


def test_repeated_and_null_ids(spark, folder):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(12, 3)).tolist()
    found = whiten(frame(spark, [(None if i < 3 else 7, v) for i, v in enumerate([*vectors, vectors[0], vectors[0]])]), folder).collect()
    assert sorted(str(r.vec_id) for r in found) == sorted(["None"] * 3 + ["7"] * 11)
    assert {r.n for r in found} == {14}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3])
def test_no_variance(spark, folder, vectors):
    found = whiten(frame(spark, list(enumerate(vectors))), folder).collect()
    assert len(found) == sum(v is not None for v in vectors)
    assert all(r.whitened == [] and r.explained == [] and r.identity_error == 0 and r.deviation == 0 for r in found)


def test_components_without_variance(spark, folder):
    """A constant dimension, and one that is the sum of others."""
    rng = np.random.default_rng(3)
    vectors = [[a, b, a + b, 5.0] for a, b in rng.integers(-50, 50, size=(40, 2)).astype(float).tolist()]
    found = whiten(frame(spark, list(enumerate(vectors))), folder).collect()
    assert {len(r.whitened) for r in found} == {2}
    white = np.array([r.whitened for r in found])
    assert np.abs(white.T @ white / 40 - np.eye(2)).max() < 1e-9


def test_many_blocks(spark, folder, monkeypatch):
    """Blocks that divide neither rows nor columns, and several columns of blocks."""
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    monkeypatch.setattr(whitening, "BLOCKS_IN_TASK", 2)
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(100, 8)) * np.arange(1, 9) + 1e4).tolist()
    agrees(whiten(frame(spark, list(enumerate(vectors))), folder).collect(), vectors)


def test_huge_entries(spark, folder):
    """Sums of squares beyond a bigint are NULL, those within stay exact."""
    vectors = [[0.0, 1.0], [1e9, 0.0], [1e300, 2.0], [-1e300, 1.0]]
    found = whiten(frame(spark, list(enumerate(vectors))), folder).collect()
    assert len(found) == 4 and all(r.deviation is None for r in found)
    middling = [[0.0, 1e6], [3e6, 0.0], [1e6, 2e6]]
    found = sorted(whiten(frame(spark, list(enumerate(middling))), folder).collect(), key=lambda r: r.vec_id)
    assert [r.deviation for r in found] == brute(middling, 1)[0].tolist()


def test_long_vectors(spark, folder):
    """More dimensions than vectors: no more components than vectors less one."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6, 1500)).tolist()
    found = whiten(frame(spark, list(enumerate(vectors))), folder).collect()
    assert {len(r.whitened) for r in found} == {5}
    assert found[0].identity_error < 1e-9
