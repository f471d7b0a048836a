"""Exact cosine pairs with blocks left out by angles, against brute force."""

import numpy as np
import pytest

from corpusmill.operators import vectors


def made(rng, groups, size, noise):
    centers = vectors.unit(rng.normal(size=(groups, 16)))
    return np.concatenate([c + noise * rng.normal(size=(size, 16)) for c in centers])


def brute(x, least):
    u = vectors.unit(x)
    sims = np.round(u @ u.T, 9)
    return {(i, j) for i, j in zip(*np.nonzero(sims >= least)) if i < j}


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.35, 0.92, 0.999999])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "PAIR_ROWS", 32)
    rng = np.random.default_rng(1)
    x = np.concatenate([made(rng, 6, 40, 0.05), rng.normal(size=(60, 16)), np.ones((20, 16))])
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(1000, None), (1001, [0.0] * 16), (1002, [1.0, 2.0]), (1003, [2.0, 4.0])]
    got = [(r["a"], r["b"]) for r in vectors.cosine_pairs(spark.createDataFrame(rows, "fact_id long, embedding array<double>"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x, threshold) | {(1002, 1003)}


def test_few_block_pairs_are_compared_for_tight_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_ROWS", 32)
    x = made(np.random.default_rng(2), 12, 60, 0.02)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "fact_id long, embedding array<double>")
    balls = vectors._balls(vectors._cells(rows, len(x)))
    n = balls.count()
    compared = [tuple(r) for r in vectors._near_blocks(balls, float(np.arccos(0.92))).collect()]
    assert len(compared) == len(set(compared)) and n >= 20 and len(compared) < 0.35 * n * (n + 1) / 2
    assert vectors.cosine_pairs(rows.limit(0), 0.9).count() == 0
