"""The recurrent model's arrays stay small, and targets of any kind go through its ragged softmax."""

import tracemalloc

import numpy as np
import pytest

from weftgraph.llm import gru


@pytest.fixture
def lay():
    return gru.Layout(np.sort(np.random.default_rng(0).integers(1, 5000, 3000))[::-1].astype(float), np.full(64, 50.0))


def test_scores_of_many_rows_take_little_memory(lay):
    rng, p = np.random.default_rng(1), lay.start()
    h, target = rng.standard_normal((16_384, gru.HIDDEN)).astype(np.float32), rng.integers(0, 3064, 16_384)
    tracemalloc.start()
    try:
        got = gru.log_probs(p, lay, h, target)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got < 0).all() and peak < 10e6


@pytest.mark.parametrize("only", [[0], [3010, 3063], [0, 2999, 3001]])
def test_targets_of_one_kind(lay, only):
    """Frequent words alone, spelling classes alone, and both."""
    p, rng = lay.start(), np.random.default_rng(2)
    docs = [rng.choice(only, 60) for _ in range(5)]
    moved, n = gru.train(p, lay, docs, streams=4, window=7)
    assert n == 300 and all(np.isfinite(x).all() for x in moved.values())
    assert gru.score(moved, lay, docs).sum() > gru.score(p, lay, docs).sum()
    total = np.exp(gru.log_probs(moved, lay, np.repeat(rng.standard_normal((1, gru.HIDDEN)).astype(np.float32), 3064, 0), np.arange(3064))).sum()
    assert total == pytest.approx(1, abs=1e-4)
