"""Line deduplication of the queries finds all similar lines, those of few words too."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from weftgraph.llm import langid, linededup
from weftgraph.llm.components import components, contracted, stars

from .test_operators import near_lines, similar_lines


def test_no_similar_line_is_left(spark, make):
    rng = random.Random(31)
    texts = []
    for k in range(80):  # lines of five to nine words, one of which is another one
        line = make.prose(rng, 5 + k % 5).split()
        at = rng.randrange(len(line))
        texts += [" ".join(line), " ".join([*line[:at], f"other{chr(97 + k % 26)}word", *line[at + 1 :]])]
    texts += [x for p in near_lines(make, rng)[:24] for x in p]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = similar_lines(docs.collect(), 1)
    assert len(want) > 80
    for out in (linededup.without_repeated_lines(docs).where("n_removed > 0"), docs.join(linededup.drop_repeated_lines(spark, docs, ""), "doc_id", "left_anti")):
        assert {r.doc_id for r in out.collect()} == {d for d, _ in want}


def test_checks_let_all_similar_lines_pass(make):
    rng = random.Random(32)
    pairs = near_lines(make, rng)
    base = make.prose(rng, 400).split()
    pairs += [(" ".join(base), " ".join(base[:-m])) for m in range(1, 80, 9)] + [(" ".join(base[:n]), " ".join(base[: n - n // 5])) for n in range(240, 320, 5)]
    codes, starts, vocab, per_word = linededup.line_words(pa.array([x for p in pairs for x in p]))
    check = linededup.line_checks(linededup.parities(per_word[codes], starts), np.diff(starts))
    near = linededup.near_checks(0.8)
    assert near(check[::2], check[1::2]).all()
    assert near(check[::2], np.roll(check[1::2], -2)).mean() < 0.5


def test_a_long_line_sends_few_keys_and_takes_little_memory(make):
    rng = random.Random(33)
    codes, starts, vocab, per_word = linededup.line_words(pa.array([make.prose(rng, 57) for _ in range(8000)]))
    sizes = np.array([len(x) for x in vocab.to_pylist()], np.uint64)
    tracemalloc.start()
    try:
        at, _, _ = linededup.line_runs(per_word[codes], sizes[codes], starts, 0.8)
        linededup.parities(per_word[codes], starts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(at) < 25 * 8000  # 11 edits touch 22 runs of two words; one that comes again counts twice
    assert peak < 40e6


def test_a_group_of_many_links_is_contracted(spark):
    ids = np.arange(300) * 7
    a, b = (ids[x] for x in np.triu_indices(300, 1))
    x, y = stars(a, b)
    assert len(x) == 299 and set(y) == {0}
    rows = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)) + [(5, 6), (6, 8), (9, 8)], "a long, b long")
    assert contracted(rows.coalesce(1)).count() == 302
    got = {r.id: r.component for r in components(rows).collect()}
    assert got == dict.fromkeys(ids.tolist(), 0) | dict.fromkeys([5, 6, 8, 9], 5)


def test_texts_come_in_small_batches(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        langid.keep_identified(spark, docs, "")
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
