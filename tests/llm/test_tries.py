"""Source divergence against plain counting, and tries against sorted dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import tries

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 3), st.integers(1, 5)), max_size=60), st.integers(0, 60))
def test_trie_is_a_sorted_table(entries, at):
    one, two, whole = tries.Trie(), tries.Trie(), tries.Trie()
    expected: dict[bytes, list] = {}
    for k, (term, source, n) in enumerate(entries):
        for trie in (whole, one if k < at else two):
            trie.add(term, 1, [(source, n)])
        own = expected.setdefault(term, [0, Counter()])
        own[0] += 1
        own[1][source] += n
    one.merge(two)
    for trie in (whole, one):
        got = list(trie.walk())
        assert [t for t, _, _ in got] == sorted(expected) and trie.leaves == len(expected)
        assert all(n == expected[t][0] and c == expected[t][1] for t, n, c in got)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=12))
def test_terms_of_texts(texts):
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    codes, starts, vocab = tries.split_words(tries.only_terms(array))
    words = vocab.to_pylist()
    got = [[words[c] for c in codes[i:j]] for i, j in zip(starts, starts[1:])]
    assert got == [TERM.findall((t or "").translate(LOWER)) for t in texts]


def test_shares_of_any_size():
    counts = np.array([0, 1, 10**10, 10**15], np.int64)
    expected = [1 + (10**9 * (int(c) + 5)) // (10**16 + 5 * 7) for c in counts]
    assert tries.shares(counts, 10**16, 7).tolist() == expected
    assert tries.shares(counts[:2], 10, 7).tolist() == [1 + 10**9 * 5 // 45, 1 + 10**9 * 6 // 45]
    both = tries.shares(np.stack([counts, counts]).T, np.array([10**16, 10**17]), 3)
    assert both[3].tolist() == [1 + (10**9 * (10**15 + 5)) // (x + 15) for x in (10**16, 10**17)]


def by_hand(rows, least, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        sources = sorted({d[1] for d in own}, key=str.encode)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if seen[t] >= least) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(count[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            typical = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(typical[:top], 1)]
    return sorted(out)


def rows_of(make, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "there", "thé", "ther", "日本", "日本語", "𓀀", "ａ", "x", "naïve", "can't", "a1b", "under_score", "zz", "ﬀ", "\x00nul\x00", "tie", "tif"]
    rows = [(i % 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "日"]), rng.choice(["a", "b", "é", "ｚ", "𓀀", None, ""])) for i in range(260)]
    rows += [(1, "the " * 40000 + "x" * 70000, "en", "a"), (2, None, "en", "silent"), (3, "12 34", "none", "p"), (4, "", "none", "q"), (5, "alone", "one", "only")]
    return rows + rows[:30]


@pytest.mark.parametrize("leaves,block,slice_", [(100_000, 4096, 256), (3, 2, 2)])
def test_divergence(spark, make, leaves, block, slice_):
    rows = rows_of(make)
    docs = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit("clashes")).withColumn("value", F.lit(1)).repartition(5)
    got = tries.divergence(docs, least=9, top=6, leaves=leaves, block=block, slice_=slice_)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, 9, 6)


def test_query_and_nothing(spark, tmp_path, make):
    rows = rows_of(make, 4)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in tries.op13_source_divergence(spark, str(tmp_path)).collect()) == by_hand(rows, 30, 50)
    assert tries.divergence(spark.createDataFrame([], DOCS)).collect() == []
