"""Links between nodes that share a key, without all pairs of a key's nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Nodes of a key that are compared in its bucket at most; what the pairs of one key take is a few seconds.
LARGE = 20_000
#: As many of a node's keys, the smallest, tell whether a pair is given under another key.
FEW = 8


def list_rows(keys: np.ndarray, nodes: np.ndarray, checks: np.ndarray, buckets: int, beside: dict, own: int) -> pa.RecordBatch:
    """(key, node, check) entries as one row for each bucket, and one row of bucket ``own`` with the columns ``beside``.

    A bucket holds 32 bits of its keys; its number has others.
    """
    bucket = (((keys & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, keys, nodes, checks = bucket[order], (keys[order] >> np.uint64(32)).astype(np.uint32).view(np.int32), nodes[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    ends = pa.array(np.concatenate([first, [len(bucket)] * 2]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, nodes, checks)]
    n = pa.array([0] * (len(first) + 1) + [len(next(iter(beside.values())))], pa.int32())
    number = pa.array(np.append(bucket[first], own).astype(np.int32))
    return pa.RecordBatch.from_arrays([number, *lists, *(pa.ListArray.from_arrays(n, x if isinstance(x, pa.Array) else pa.array(x)) for x in beside.values())], ["bucket", "key", "node", "check", *beside])


def pairs_and_entries(table: pa.Table, near_by: int | Callable, block: int = 2000, step: int = 300_000, large: int = LARGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, a and b of a bucket's rows of list_rows. Keys of a single node go.

    Kind 1: nodes of a key whose checks differ in ``near_by`` bits at most, or are near by the function ``near_by`` of two arrays of them. Kind 2: key and node, for keys of more
    than ``large`` nodes and those with more than four such pairs a node, a crowd. About ``step`` pairs are held at a time; nodes of a key of more than ``block`` are compared some rows at a time.
    """
    if isinstance(near_by, int):
        most, near_by = near_by, lambda x, y: np.bitwise_count((x ^ y).view(np.uint64)) <= most
    key, node, check = (np.concatenate([c.flatten().to_numpy() for c in table.column(x).chunks] or [np.zeros(0, np.int64)]) for x in ("key", "node", "check"))
    key = key.astype(np.int32).view(np.uint32)
    order = np.argsort(key)
    key, node, check = key[order], node[order], check[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    several = np.bincount(group, minlength=1)[group] > 1 if len(key) else new
    key, node, check = key[several], node[several], check[several]
    if not len(key):
        return np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((node, key))
    key, node, check = key[order], node[order], check[order]
    keep = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, check = key[keep], node[keep], check[keep]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    crowd, pairs = size > large, [np.zeros((0, 2), np.int64)]
    for g in np.flatnonzero((size > block) & ~crowd):
        n, held, own = size[g], 0, []
        nodes, checks = node[begin[g] : begin[g] + n], check[begin[g] : begin[g] + n]
        for k in range(0, n, width := max(1, step // n)):
            i, j = np.nonzero(near_by(checks[k : k + width, None], checks[None, k:]))
            i, j = i[j > i] + k, j[j > i] + k
            own.append(np.stack([nodes[i], nodes[j]], axis=1))
            held += len(i)
            if held > 4 * n:
                crowd[g] = True
                break
        else:
            pairs += own
    for n in np.unique(size[(size > 1) & (size <= block)]):
        x, y = np.triu_indices(n, 1)
        same = np.flatnonzero(size == n)
        for k in range(0, len(same), width := max(1, step // len(x))):
            at = begin[same[k : k + width], None]
            near = near_by(check[at + x], check[at + y])
            crowd[same[k : k + width]] = many = near.sum(axis=1) > 4 * n
            near[many] = False
            i, j = np.nonzero(near)
            pairs.append(np.stack([node[at[i, 0] + x[j]], node[at[i, 0] + y[j]]], axis=1))
    found = np.concatenate(pairs)
    found = np.unique(found, axis=0) if len(found) else found
    more = np.repeat(crowd, size)
    full = (key.astype(np.uint64) * _MIX ^ np.uint64(table.column("bucket")[0].as_py())) * _MIX
    kind = np.repeat(np.array([1, 2], np.int8), [len(found), more.sum()])
    return kind, np.concatenate([found[:, 0], full[more].view(np.int64)]), np.concatenate([found[:, 1], node[more]])


def _ranked(x: np.ndarray, near: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs are among the ``limit`` nearest of their entry in ``x``."""
    order = np.lexsort((near, x))
    new = np.ones(len(x), bool)
    new[1:] = x[order][1:] != x[order][:-1]
    rank = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    take = np.zeros(len(x), bool)
    take[order[rank < limit]] = True
    return take


def _centres(rows: np.ndarray, test: Callable, sample: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with a centre that they are alike to, of a key of many rows, without all pairs of it.

    The centre is the one of ``sample`` rows that most of the others are alike to; those go, and
    the next one is chosen from what is left. Rows that nothing is alike to go unpaired.
    """
    out = []
    while len(rows) > 1:
        some = rows[:sample]
        near = test(np.repeat(some, len(rows)), np.tile(rows, len(some))).reshape(len(some), -1) >= 0
        near[np.arange(len(some)), np.arange(len(some))] = False
        best = near.sum(axis=1).argmax()
        hit = near[best]
        if hit.any():
            out.append((np.full(hit.sum(), some[best]), rows[hit]))
            hit[best] = True
            rows = rows[~hit]
        else:
            rows = rows[sample:]
    return out


def crossing(table: pa.Table, sketch: list[str], alike: Callable, limit: int | None, most: int = 300_000) -> pa.Table:
    """(key, a, b, more): pairs of nodes of different components that share a key and may be alike.

    Of a key, each component's ``limit`` pairs with the nearest sketches are given; without a
    limit, pairs of each node with one that many are alike to, its centre. ``more`` says whether the
    key may have others. Of a key that was dealt into blocks l and r, those of both are
    compared. About ``most`` pairs are held at a time.

    With a column ``few``, some of each node's keys, a pair goes without its row if a smaller key
    is among those of both: it is given, or cut, there.
    """
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    key, node, c, own = (table.column(x).to_numpy()[order] for x in ("key", "node", "c", "own"))
    attr = {x: table.column(x).to_numpy()[order] for x in sketch}
    few = None
    if "few" in table.column_names:
        lists = table.column("few").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        few = np.full((len(key), FEW), np.iinfo(np.int64).max)
        few[np.repeat(np.arange(len(key)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
        few = few[order]
    l, r = (table.column(x)[0].as_py() for x in "lr")
    new = np.concatenate([[True], key[1:] != key[:-1]])
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    size, cut = np.diff(np.append(begin, len(key))), np.zeros(len(begin), bool)
    kept = [(np.zeros(0, np.int64),) * 3]

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return alike({x: v[i] for x, v in attr.items()}, {x: v[j] for x, v in attr.items()})

    def given(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for x in few.T:
            x, smaller = x[i], x[i] < key[i]
            for y in few.T:
                out |= smaller & (x == y[j])
        return out

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        differ = c[i] != c[j]
        i, j = i[differ], j[differ]
        near = test(i, j)
        hit = near >= 0
        i, j, near = i[hit], j[hit], near[hit]
        if few is not None and len(i):
            here = ~given(i, j)
            i, j, near = i[here], j[here], near[here]
        if limit and len(i) > limit:
            take = _ranked(i, near, limit)
            cut[group[i[~take]]] = True
            i, j, near = i[take], j[take], near[take]
        kept.append((i, j, near))

    for n in np.unique(size[size > 1]):
        same = begin[size == n]
        if n <= 128 and l == r:
            x, y = np.triu_indices(n, 1)
            step = max(1, most // len(x))
            for k in range(0, len(same), step):
                at = same[k : k + step, None]
                keep((at + x).ravel(), (at + y).ravel())
            continue
        for a in same:
            if limit is None:
                kept += [(i, j, np.zeros(len(i), np.int64)) for i, j in _centres(np.arange(a, a + n), test)]
                cut[group[a]] = True
                continue
            # the largest component last: its rows needn't be compared with each other
            kinds, of, count = np.unique(c[a : a + n], return_inverse=True, return_counts=True)
            rows = a + np.argsort(of == count.argmax(), kind="stable")
            first, step = n - count.max() if len(kinds) > 1 else 0, max(1, most // n)
            for k in range(0, first, step):
                x = np.arange(k, min(k + step, first))
                x, y = np.repeat(x, n - k), np.tile(np.arange(k, n), len(x))
                later = (y > x) if l == r else (y > x) & (own[rows[x]] != own[rows[y]])
                keep(rows[x[later]], rows[y[later]])
    i, j, near = (np.concatenate(x) for x in zip(*kept, strict=True))
    if limit is None:
        # of small keys, the best of a node's pairs: the one with most pairs on its other side
        many = np.bincount(np.concatenate([i, j]), minlength=len(key))
        best = np.full(len(key), -1, np.int64)
        for x, y in ((i, j), (j, i)):
            np.maximum.at(best, x, (many[y] << 32) | y)
        x = np.flatnonzero(best >= 0)
        y = best[x] & 0xFFFFFFFF
        found = np.bincount(group[i], minlength=len(begin))
        i, j = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else (x, y)
        cut |= found > np.bincount(group[i], minlength=len(begin))
    else:
        # components have numbers of their own in each key
        names = np.unique(np.stack([group, c]), axis=1, return_inverse=True)[1].ravel() if len(key) else c
        take = _ranked(names[i], near, limit) | _ranked(names[j], near, limit)
        cut[group[i[~take]]] = True
        i, j = i[take], j[take]
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return pa.table({"key": pa.array(key[i]), "a": pa.array(a), "b": pa.array(b), "more": pa.array(cut[group[i]])})


def linked(pairs: DataFrame, entries: DataFrame, nodes: DataFrame, alike: Callable, confirm: Callable, block: int = 2000) -> DataFrame:
    """(id, component) of the nodes that links join.

    ``pairs`` (a, b) are to be compared at any rate, ``entries`` (key, node) are the keys whose
    nodes are still to be paired, ``nodes`` a sketch of each node (node and the sketch's columns). A
    link needs a common key, sketches that are ``alike`` (a distance, or -1 if the nodes
    can't be linked) and confirmation: confirm(pairs) gives the pairs that hold.

    The nodes of a key are compared by their sketches, in blocks where a key has more than
    ``block`` of them. First each node is confirmed with the one that is alike to most. Of the keys that have
    other such pairs, what isn't in one component yet is then compared, and each component's 64
    nearest pairs are confirmed, 64 times as many in each further round until none is
    left. So a group of copies costs its size, and no link is lost. Nodes that are alike often share
    many keys; from the second round on, their pair is given once where it can be seen that it is.
    """
    sketch = [c for c in nodes.columns if c != "node"]
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        both = both.join(nodes.select(F.col("node").alias(f"_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in sketch)), F.col(x) == F.col(f"_{x}")).drop(f"_{x}")

    def may_be(batches):
        for batch in batches:
            x, y = ({c: batch.column(f"{c}_{i}").to_numpy() for c in sketch} for i in "ab")
            yield batch.select(["a", "b"]).filter(pa.array(alike(x, y) >= 0))

    both = both.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in sketch)).mapInArrow(may_be, "a long, b long")
    found = tested = limit = None
    while True:
        groups = max(64, entries.count() // 10_000)
        rows = entries.withColumn("c", F.col("node")) if found is None else entries.join(found, F.col("node") == F.col("id"), "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_many"), F.min("c").alias("_low"), F.max("c").alias("_high"))
        large = counts.where(F.col("_many") > block).select(F.col("key").alias("_key"), F.ceil(F.col("_many") / block).alias("_blocks"))
        if found is not None:
            rows = materialise(rows.join(counts.where("_low < _high").select("key"), "key", "left_semi"), "entries")
            few = rows.groupBy(F.col("node").alias("_f")).agg(F.slice(F.sort_array(F.collect_set("key")), 1, FEW).alias("few"))
            rows = rows.join(few, F.col("node") == F.col("_f")).drop("_f")
        rows = rows.join(large, F.col("key") == F.col("_key"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
        rows = rows.join(nodes.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        rows = rows.withColumn("l", F.least("own", "_other")).withColumn("r", F.greatest("own", "_other"))
        # small keys share groups, those in blocks have groups of their own
        rows = rows.withColumn("_group", F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")))
        rows = rows.select("_group", "l", "r", "key", "node", "c", "own", *sketch, *(["few"] if found is not None else []))
        at_most = limit
        near = materialise(rows.groupBy("_group", "l", "r").applyInArrow(lambda t: crossing(t, sketch, alike, at_most), "key long, a long, b long, more boolean"), "near")
        fresh = near.select("a", "b")
        fresh = fresh.unionByName(both).distinct() if tested is None else fresh.distinct().join(tested, ["a", "b"], "left_anti")
        fresh = materialise(fresh, "fresh")
        if found is None or not fresh.isEmpty():
            new = materialise(confirm(fresh), "links")
            tested = fresh if found is None else tested.unionByName(fresh)
            found = components(new, found)
        cut = near.where("more").select("key").distinct()
        if cut.isEmpty():
            return found
        # the keys of which not all pairs were given
        entries, limit = entries.join(cut, "key", "left_semi"), 64 * limit if limit else 64
