"""Keys that very many nodes share are compared in their bucket, as far as few of the nodes are near."""

import numpy as np
import pyarrow as pa

from weftgraph.llm.buckets import pairs_and_entries


def table(keys, nodes, checks):
    lists = [pa.array([np.asarray(x)]) for x in (np.asarray(keys, np.int32), nodes, checks)]
    return pa.table([pa.array([3], pa.int32()), *lists], ["bucket", "key", "node", "check"])


def test_large_keys_without_a_crowd_give_pairs():
    rng = np.random.default_rng(1)
    n = 900
    nodes, checks = np.arange(n), rng.integers(-(1 << 62), 1 << 62, n)
    checks[700], checks[899] = checks[3], checks[4] ^ 1
    entries = table(np.repeat([1, 2], [600, n]), np.concatenate([nodes[:600], nodes]), np.concatenate([checks[:600], checks]))
    kind, a, b = pairs_and_entries(entries, 2, block=100, step=5000)
    assert set(kind) == {1} and sorted(zip(a, b, strict=True)) == [(3, 700), (4, 899)]


def test_crowds_and_the_largest_keys_stay_entries():
    n = 500
    one = table(np.zeros(n), np.arange(n), np.zeros(n, np.int64))
    kind, _, b = pairs_and_entries(one, 2, block=100, step=5000)
    assert set(kind) == {2} and sorted(b) == list(range(n))
    far = table(np.zeros(n), np.arange(n), np.random.default_rng(2).integers(-(1 << 62), 1 << 62, n))
    kind, _, b = pairs_and_entries(far, 2, block=100, step=5000, large=400)
    assert set(kind) == {2} and sorted(b) == list(range(n))
    assert len(pairs_and_entries(far, 2, block=100, step=5000)[0]) == 0


def test_blocks_of_any_size_give_the_same():
    rng = np.random.default_rng(3)
    keys, nodes = rng.integers(0, 6, 4000), rng.integers(0, 700, 4000)
    checks = rng.integers(-(1 << 62), 1 << 62, 700)
    checks[rng.integers(0, 700, 60)] = checks[7]
    rows = [sorted(zip(*pairs_and_entries(table(keys, nodes, checks[nodes]), 2, block=k, step=3000), strict=True)) for k in (2000, 50, 2)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 100
