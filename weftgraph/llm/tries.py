"""Source divergence audit: how far the sources of a language differ in their terms, counted in mergeable radix tries.

Each task counts the terms of its documents in byte tries, one for each language, whose leaves
hold a counter for each source. Their leaves are dealt out by ranges of (language, term), that is by prefixes, and merged in tries
again; walked in UTF-8 order these give the terms in blocks. From the blocks come the distances
of each pair of sources and each group's most typical terms, ties in UTF-8 order.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, materialise, split_words

#: Documents of a language that have to have a term, added to each count, scale of shares, ranks of terms.
LEAST_DOCUMENTS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Leaves that a trie holds before it is given on, terms of a block, sources whose pairs are taken at once.
LEAVES, BLOCK, SLICE = 300_000, 4096, 256
LEAF = "lang string, term binary, docs long, sources array<string>, counts array<long>"

#: Bytes of terms: ASCII letters, lower-cased, and whatever isn't ASCII; others become spaces.
_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def only_terms(texts: pa.Array) -> pa.Array:
    """Texts in which all that isn't part of a term is a space, and A-Z are lower-cased. Null is an empty text."""
    texts = pa.array([], pa.large_string()) if not len(texts) else texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(_BYTES[data].tobytes()))


@contextmanager
def uncollected():
    """While it holds, Python doesn't look for cyclic garbage: tries have no cycles, and looking at each of their nodes again and again costs a third of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Trie:
    """A radix trie over bytes. A node is [label, children by first byte, documents, counts by source]; inner nodes have no counts.

    ``path`` leads to the term that was added last, so that terms in order need few steps.
    """

    def __init__(self):
        self.root = [b"", None, 0, None]
        self.path = [(b"", self.root)]
        self.leaves = 0

    def add(self, term: bytes, docs: int, counts: Iterable[tuple[int, int]]) -> None:
        """Adds to a term's documents and to its counter of each source."""
        path = self.path
        prefix, node = path[-1]
        while not term.startswith(prefix):
            path.pop()
            prefix, node = path[-1]
        at, n = len(prefix), len(term)
        while at < n:
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(term[at])
            if child is None:
                child = children[term[at]] = [term[at:], None, 0, None]
                at = n
            else:
                label = child[0]
                size = len(label)
                if term.startswith(label, at):
                    at += size
                else:
                    # the edge is split where the term leaves it
                    same, most = 1, min(size, n - at)
                    while same < most and label[same] == term[at + same]:
                        same += 1
                    middle = children[term[at]] = [label[:same], {label[same]: child}, 0, None]
                    child[0] = label[same:]
                    child, at = middle, at + same
            node = child
            path.append((term[:at], node))
        if node[3] is None:
            node[3] = {}
            self.leaves += 1
        node[2] += docs
        own = node[3]
        for source, count in counts:
            own[source] = own.get(source, 0) + count

    def merge(self, other: Trie) -> None:
        for term, docs, counts in other.walk():
            self.add(term, docs, counts.items())

    def walk(self) -> Iterator[tuple[bytes, int, dict[int, int]]]:
        """(term, documents, counts) in byte order, which for UTF-8 is that of code points."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            term = prefix + node[0]
            if node[3] is not None:
                yield term, node[2], node[3]
            children = node[1]
            if children:
                for first in sorted(children, reverse=True):
                    stack.append((term, children[first]))


def leaf_batches(lang: str, trie: Trie, names: list[str], least: int = 0, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """LEAF rows of a trie, in order; terms of fewer than ``least`` documents are left out, the empty term never is."""
    terms, docs, lengths, sources, counts = [], [], [0], [], []

    def batch():
        ends = pa.array(np.cumsum(lengths), pa.int32())
        named = pa.DictionaryArray.from_arrays(pa.array(sources, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
        columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64())]
        columns += [pa.ListArray.from_arrays(ends, named), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "docs", "sources", "counts"])

    for term, n, own in trie.walk():
        if n < least and term:
            continue
        terms.append(term)
        docs.append(n)
        lengths.append(len(own))
        sources.extend(own)
        counts.extend(own.values())
        if len(terms) == size:
            yield batch()
            terms, docs, lengths, sources, counts = [], [], [0], [], []
    if terms:
        yield batch()


def count_terms(docs: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """LEAF rows: terms of the documents (lang, source, text) of a task, with documents and occurrences by source.

    The empty term stands for the documents themselves: its counts are documents by source. A task's tries are given on, and begun anew, when
    they have ``leaves`` leaves together, so a term can come several times.
    """

    def counted(batches):
        tries: dict[str, Trie] = {}
        names: dict[str, int] = {}

        def given():
            for lang, trie in tries.items():
                yield from leaf_batches(lang, trie, list(names))

        for batch in chunks(batches, "text"):
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            own = np.array([names.setdefault(s, len(names)) for s in batch.column("source").to_pylist()], np.int64)
            codes, starts, vocab = split_words(only_terms(batch.column("text")))
            doc = np.repeat(np.arange(len(which)), np.diff(starts))
            # terms are numbered in their order, so that tries are filled in order
            order = pc.array_sort_indices(vocab).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes, words, width = place[codes], vocab.take(pa.array(order)).cast(pa.large_binary()).to_pylist(), max(1, len(vocab))
            # one document's term once, then documents of each language's terms
            pair = np.unique(doc * width + codes, return_counts=True)[0]  # with counts it sorts, which is faster
            cell, docs_of = np.unique(which[pair // width] * width + pair % width, return_counts=True)
            # occurrences of (language, term, source)
            wide = len(names)
            triple, times = np.unique((which[doc] * width + codes) * wide + own[doc], return_counts=True)
            begin = np.searchsorted(triple // wide, cell)
            end = np.append(begin[1:], len(triple)).tolist()
            source, times = (triple % wide).tolist(), times.tolist()
            for c, n, i, j in zip(cell.tolist(), docs_of.tolist(), begin.tolist(), end, strict=True):
                lang = langs[c // width]
                trie = tries.get(lang)
                if trie is None:
                    trie = tries[lang] = Trie()
                trie.add(words[c % width], n, zip(source[i:j], times[i:j], strict=True))
            group, n = np.unique(which * wide + own, return_counts=True)
            for g, k in zip(group.tolist(), n.tolist(), strict=True):
                tries.setdefault(langs[g // wide], Trie()).add(b"", k, [(g % wide, k)])
            if sum(t.leaves for t in tries.values()) >= leaves:
                yield from given()
                tries, names = {}, {}
        yield from given()

    def count(batches):
        with uncollected():
            yield from counted(batches)

    return docs.mapInArrow(count, LEAF)


def likely(batch: pa.RecordBatch, least: int) -> np.ndarray:
    """Which rows of a sorted batch belong to the empty term, to a term of ``least`` documents or to one that may go on in another batch."""
    n = batch.num_rows
    new = np.ones(n, bool)
    for c in ("lang", "term"):
        x = batch.column(c)
        differs = pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
        new[1:] = differs if c == "lang" else new[1:] | differs
    begin = np.flatnonzero(new)
    enough = np.add.reduceat(batch.column("docs").to_numpy(), begin) >= least if n else np.zeros(0, bool)
    enough[[0, -1][: len(enough)]] = True
    return np.repeat(enough, np.diff(np.append(begin, n))) | (pc.binary_length(batch.column("term")).to_numpy() == 0)


def merged(leaves: DataFrame, least: int, most: int = LEAVES, block: int = BLOCK) -> DataFrame:
    """LEAF rows of terms of at least ``least`` documents (and the empty term), each once, with ``block``, a number that neighbouring terms share.

    Leaves are dealt out by ranges of (lang, term) and come sorted; a trie is given on as soon as it is large and the next term is another.
    A term whose leaves all lie within a batch and have too few documents together needn't go into it.
    """

    def merge(batches):
        part, number, filled = TaskContext.get().partitionId(), 0, 0
        lang, last, trie, names = None, None, None, {}

        def given():
            nonlocal number, filled
            for b in leaf_batches(lang, trie, list(names), least):
                at = 0
                while at < b.num_rows:
                    n = min(block - filled, b.num_rows - at)
                    piece = b.slice(at, n)
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([(part << 32) + number] * n, pa.int64())], [*b.schema.names, "block"])
                    at, filled = at + n, filled + n
                    if filled == block:
                        number, filled = number + 1, 0

        for batch in batches:
            batch = batch.filter(pa.array(likely(batch, least)))
            sources, counts = batch.column("sources"), batch.column("counts")
            ends = (sources.offsets.to_numpy() - sources.offsets[0].as_py()).tolist()
            own, times = sources.flatten().to_pylist(), counts.flatten().to_pylist()
            for k, (l, term, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "docs")), strict=True)):
                if l != lang or (trie.leaves >= most and term != last):
                    if trie is not None:
                        yield from given()
                    if l != lang:
                        number, filled = number + 1, 0
                    lang, trie, names = l, Trie(), {}
                last = term
                i, j = ends[k], ends[k + 1]
                trie.add(term, n, zip([names.setdefault(s, len(names)) for s in own[i:j]], times[i:j], strict=True))
        if trie is not None:
            yield from given()

    order = ["lang", "term"]
    return leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(merge, f"{LEAF}, block long")


def shares(counts: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED terms)), exact for counts of any size."""
    if counts.size and int(counts.max()) > (1 << 62) // SCALE:
        total = np.asarray(total, object)
        return (1 + SCALE * (counts.astype(object) + ADDED) // (total + ADDED * terms)).astype(np.int64)
    return 1 + SCALE * (counts + ADDED) // (np.asarray(total, np.int64) + ADDED * terms)


FOUND = "lang string, source string, part string, item string, value long"


def compared(terms: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """FOUND rows of one block of a language's terms: sums of its distances for the pairs of the groups that are ``own``, and their ``top`` typical terms.

    ``groups`` has all sources of the language: source, n (its total), own; of_lang, total and v are the language's.
    """
    groups = groups.sort_by("source")
    names, n, own = groups.column("source").to_pylist(), groups.column("n").to_numpy(), groups.column("own").to_numpy()
    lang, total, v = (groups.column(c)[0].as_py() for c in ("of_lang", "total", "v"))
    mine = np.flatnonzero(own)
    sums = np.zeros((len(mine), len(names)), np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in mine]
    terms = terms.sort_by("term")
    step = max(1, 2_000_000 // len(names))
    for at in range(0, terms.num_rows, step):
        part = terms.slice(at, step)
        sources, counts = part.column("sources").combine_chunks(), part.column("counts").combine_chunks()
        row = np.repeat(np.arange(part.num_rows), sources.value_lengths().to_numpy())
        column = np.searchsorted(np.array(names, object), np.array(sources.flatten().to_pylist(), object))
        count = np.zeros((part.num_rows, len(names)), np.int64)
        count[row, column] = counts.flatten().to_numpy()
        p, q = shares(count, n, v), shares(count.sum(axis=1), total, v)
        words = part.column("term").to_pylist()
        for k, s in enumerate(mine):
            sums[k] += np.abs(p - p[:, [s]]).sum(axis=0)
            typical = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
            value = p[typical, s] - q[typical]
            first = np.argsort(-value, kind="stable")[:top]  # terms are in UTF-8 order
            new = [(-int(value[i]), words[typical[i]]) for i in first]
            best[k] = sorted(best[k] + new)[:top]
    i, j = np.nonzero(mine[:, None] != np.arange(len(names))[None, :])
    rows = [(names[mine[a]], "pair", names[b], int(sums[a, b])) for a, b in zip(i, j, strict=True)]
    rows += [(names[s], "term", word.decode(), -value) for k, s in enumerate(mine) for value, word in best[k]]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FOUND.split(", ")])


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, leaves: int = LEAVES, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language of ``docs`` (lang, source, text) differ.

    Part ``pair``: each other source of the language, with the sum of the differences of their shares over the language's terms of at least ``least`` documents. Part
    ``term``: the ``top`` terms whose share in the group is most above that in its language. Null text, lang
    and source are ''. Groups without terms take part; a language without terms gives pairs of value 0. Equal rows count each; extra columns aren't read.

    A language's pairs of sources are the result, so a row for each can't be avoided; they are summed by block of terms before they move, for at most about ``slice_`` sources a time.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = materialise(count_terms(docs.select(*text), leaves), "tries")
    kept = materialise(merged(counted, least, leaves, block), "terms")
    terms = kept.where(F.octet_length("term") > 0)
    each = lambda df: df.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    groups = each(kept.where(F.octet_length("term") == 0)).select("lang", "source").distinct()
    totals = each(terms).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("slices"))
    langs = langs.join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    langs = materialise(langs, "langs")
    # a block without terms for each language, so that each has its pairs
    blocks = terms.select("lang", "block").distinct().unionByName(langs.select("lang", F.lit(-1).cast("long").alias("block")))
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    blocks = blocks.join(langs, "lang").select("lang", "block", "total", "v", "slices", slices)
    groups = blocks.join(groups, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("slices")) == F.col("slice"))
    pieces = terms.join(langs.select("lang", "slices"), "lang").select("lang", "block", slices, "term", "sources", "counts")
    key = ["lang", "block", "slice"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return compared(left, right, top)

    named = [F.col(c).alias(f"of_{c}") for c in key]
    groups = groups.select(*named, "source", "n", "own", "total", "v").groupBy(*(f"of_{c}" for c in key))
    both = pieces.groupBy(*key).cogroup(groups)
    found = materialise(both.applyInArrow(compare, FOUND), "compared")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    typical = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(typical).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``divergence`` of all ``documents``: pairs of sources of a language and each group's 50 most typical terms."""
    return divergence(documents(spark, sf_dir))


#: The same by SQL.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
m AS (SELECT lang, sum(n) AS m FROM n GROUP BY lang),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {ADDED})) // (coalesce(n.n, 0) + {ADDED} * v.v) AS p
    FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c) + {ADDED})) // (any_value(m.m) + {ADDED} * any_value(v.v)) AS q FROM c JOIN m USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source WHERE a.source <> b.source),
typical AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM typical))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
