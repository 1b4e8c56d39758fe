"""Removal of repeated passages with a log-structured index of window hashes.

The index is a list of sorted, immutable runs of (hash, doc_id), bucketed by hash. A new
batch becomes a run of its own; it is merge-joined with the runs before it, what they
share is verified on the texts, and every few runs are compacted into one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, materialise, settings, shared_dir, shuffles_removed, split_words
from .neardup import gram_hashes, word_hashes


#: In a row's place: all windows of a text, or KNOWN - place of a window that is known to go.
WHOLE, KNOWN = -1, -2

#: Runs hold one sorted file a bucket: joins take their order as it is, and their buckets do for joins by more columns than the bucket's.
AS_STORED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}

MANIFEST = "version int, place int, run string, words int, gram int, buckets int, fan int"


def window_anchors(g: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` consecutive hashes the place of the smallest, of equal ones the rightmost."""
    n = len(g) - span + 1
    place, value, width = np.arange(len(g)), g, 1
    while width < span:
        step = min(width, span - width)
        left, right = value[:-step], value[step:]
        take = right <= left
        value, place = np.where(take, right, left), np.where(take, place[step:], place[:-step])
        width += step
    return place[:n]


class Windows:
    """The windows of ``words`` consecutive words of many texts, each with the anchor that its words decide on.

    The anchor is the smallest of the window's hashes of ``gram`` words, so equal windows
    have equal anchors: documents that share no anchor share no window.
    """

    def __init__(self, texts: pa.Array, words: int, gram: int):
        codes, self.starts, vocab = split_words(texts)
        self.h = word_hashes(vocab)[codes]
        n = len(self.h) - words + 1
        if n <= 0:
            self.at, self.anchor, self.doc = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, int)
            return
        g = gram_hashes(self.h, gram)
        place = window_anchors(g, words - gram + 1)
        doc = np.searchsorted(self.starts, np.arange(n), side="right") - 1
        inside = np.arange(n) + words <= self.starts[1:][doc]
        self.at, self.doc = np.flatnonzero(inside), doc[inside]
        self.anchor = g[place[inside]].view(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, anchor) pairs."""
        if not len(self.at):
            return self.doc, self.anchor
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        doc, anchor = self.doc[new], self.anchor[new]
        order = np.lexsort((anchor, doc))
        doc, anchor = doc[order], anchor[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
        return doc[first], anchor[first]


class FingerprintIndex:
    """Windows of all documents that were added so far, kept in a folder.

    ``path`` is a folder that driver and executors share, by default a new one below the
    shared folder. It holds the runs and a manifest, to which every change appends a
    version that names the runs which count from then on; a write that fails leaves the
    version before it. ``opened`` goes on from the last version, in any later session.
    ``fan`` runs are compacted into one before the next batch is joined with it.

    The documents that were added are read again to verify what is shared, so their table
    has to stay: an index that is opened gets it as ``texts`` (doc_id, text; further rows
    do no harm as long as their ids aren't in the index).
    """

    def __init__(self, spark: SparkSession, words: int = 13, gram: int = 6, buckets: int = 64, fan: int = 4, path: str | None = None):
        self.spark, self.words, self.gram, self.buckets, self.fan = spark, words, gram, buckets, fan
        self.path = path or f"{shared_dir(spark)}/tables/index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.version = 0
        self.texts: DataFrame | None = None

    @classmethod
    def opened(cls, spark: SparkSession, path: str, texts: DataFrame) -> FingerprintIndex:
        """The index that was kept in ``path``, with the documents that were added to it."""
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        last = manifest.where(F.col("version") == manifest.agg(F.max("version")).first()[0]).orderBy("place").collect()  # one row for each run
        index = cls(spark, last[0].words, last[0].gram, last[0].buckets, last[0].fan, path)
        index.runs, index.version = [r.run for r in last], last[0].version
        for run in index.runs:
            layout = f"CLUSTERED BY (h) SORTED BY (h, doc_id) INTO {index.buckets} BUCKETS"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (h BIGINT, doc_id BIGINT) USING parquet {layout} LOCATION '{path}/{run}'")
        index.texts = texts.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
        return index

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        with shuffles_removed(self.spark), settings(self.spark, AS_STORED):
            rows.write.bucketBy(self.buckets, "h").sortBy("h", "doc_id").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _keep(self, runs: list[str]) -> None:
        """From now on the index consists of ``runs``."""
        rows = [(self.version + 1, i, run, self.words, self.gram, self.buckets, self.fan) for i, run in enumerate(runs)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.runs, self.version = runs, self.version + 1

    def compact(self) -> None:
        """Merges all runs into one. They are bucketed and sorted alike, so nothing is shuffled, nor sorted before it is merged."""
        self._keep([self._write(self._merged())])

    def _merged(self) -> DataFrame:
        merged = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            merged = merged.join(self.spark.table(name), ["h", "doc_id"], "full_outer")
        return merged

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text) and returns (doc_id, at): starts of its windows that a smaller doc_id has too.

        A start of WHOLE stands for all windows of a text that a smaller doc_id has as a whole.

        Smaller ids are looked for in the batch and in all batches before; ids of later
        batches should be larger. Rows with null doc_id aren't indexed and lose nothing.
        """
        words, gram = self.words, self.gram
        docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")

        def anchors(batches):
            for batch in chunks(batches, "text"):
                doc, anchor = Windows(batch.column(1), words, gram).anchors()
                yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(doc))], ["h", "doc_id"])

        if len(self.runs) >= self.fan:
            self.compact()
        found = docs.mapInArrow(anchors, "h long, doc_id long")
        run = self._write(found.repartition(self.buckets, "h"))
        new = self.spark.table(run)
        ends = new.groupBy("h").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high")
        shared = new.join(ends.select("h"), "h", "left_semi")
        for name in self.runs:
            old = self.spark.table(name)
            shared = shared.unionByName(new.join(old, "h", "left_semi")).unionByName(old.join(new, "h", "left_semi"))
        lists = shared.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set("h").alias("anchors"))
        texts = docs if self.texts is None else self.texts.unionByName(docs)

        def expand(batches):
            for batch in chunks(batches, "text"):
                own = Windows(batch.column(1), words, gram)
                listed = batch.column(2)
                anchor = listed.flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
                # a window counts if its anchor is listed for its text; anchors are mixed with the text's number so that one lookup does
                mix = lambda a, d: a.view(np.uint64) ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keep = np.isin(mix(own.anchor, own.doc), mix(anchor, doc))
                # of equal texts in a task the one with the smallest id stands for all; the others lose every window, as one row
                ids, same = batch.column(0).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
                least = np.full(same.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, same, ids)
                copy = ids > least[same]
                gone = ids[copy & (np.diff(own.starts) >= words)]
                yield pa.RecordBatch.from_arrays([pa.array(gone), pa.array(np.zeros(len(gone), np.int32)), pa.array(gone), pa.array(np.full(len(gone), WHOLE, np.int32))], ["w", "c", "doc_id", "at"])
                keep &= ~copy[own.doc]
                at, doc = own.at[keep], own.doc[keep]
                if not len(at):
                    continue
                full = gram_hashes(own.h, words)[at].view(np.int64)
                check = (gram_hashes(own.h[::-1], words)[::-1][at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                who, start = ids[doc], (at - own.starts[doc]).astype(np.int32)
                # what a smaller id of the same batch has is known to go: such rows are dealt by their document, not by a window that many have
                order = np.lexsort((who, check, full))
                same = np.zeros(len(order), bool)
                same[1:] = (full[order][1:] == full[order][:-1]) & (check[order][1:] == check[order][:-1])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                known = np.zeros(len(order), bool)
                known[order] = who[order] > who[order][first]
                columns = np.where(known, who, full), np.where(known, 0, check), who, np.where(known, KNOWN - start, start)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["w", "c", "doc_id", "at"])

        windows = texts.join(lists, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "anchors").mapInArrow(expand, "w long, c int, doc_id long, at int")

        def repeated(batches):
            last = first = None
            for batch in batches:
                w, c, doc, at = (batch.column(i).to_numpy() for i in range(4))
                if not len(w):
                    continue
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
                new[0] = last != (w[0], c[0])
                new |= at < 0  # these rows only pass through
                owner = np.append(doc, first if first is not None else 0)[np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))]
                last, first = (w[-1], c[-1]), owner[-1]
                place = np.where(at <= KNOWN, KNOWN - at, at)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(place, pa.int32())], ["doc_id", "at"]).filter(pa.array((doc > owner) | (at < 0)))

        # equal windows meet in one task in order of doc_id, and stream through it
        dealt = windows.repartition(F.col("w"), F.col("c")).sortWithinPartitions("w", "c", "doc_id")
        hits = dealt.mapInArrow(repeated, "doc_id long, at int")
        with settings(self.spark, AS_STORED):
            hits = materialise(hits.groupBy("doc_id").agg(F.collect_list("at").alias("at")), "repeats")
        self._keep([*self.runs, run])
        hits = hits if self.texts is None else hits.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        self.texts = texts
        return hits


def cut_out(docs: DataFrame, hits: DataFrame, words: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every row, without the windows of ``words`` words that ``hits`` (doc_id, at) lists."""

    def cut(batches):
        for batch in chunks(batches, "text"):
            codes, starts, vocab = split_words(batch.column(1))
            entries = vocab.to_pylist()
            out = []
            for s, e, at in zip(starts[:-1], starts[1:], batch.column(2), strict=True):
                gone = np.zeros(e - s + 1, np.int64)
                if at.is_valid:
                    places = np.unique(at.values.to_numpy())
                    if places[0] == WHOLE:
                        places = np.arange(e - s - words + 1)
                    gone[places] += 1
                    np.subtract.at(gone, places + words, 1)
                keep = np.cumsum(gone)[:-1] == 0
                text = " ".join([entries[c] for c in codes[s:e][keep]])
                out.append((int(e - s), int((~keep).sum()), text, hashlib.sha256(text.encode()).hexdigest()))
            n_words, n_removed, text, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(text, pa.string()), pa.array(digest)],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    fields = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").join(hits, "doc_id", "left").select("doc_id", "text", "at").mapInArrow(cut, fields)


def without_repeats(docs: DataFrame, words: int = 13, batches: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every row: its text without repeated passages.

    A word goes if a window of ``words`` consecutive words that covers it also starts in a
    document with a smaller doc_id. Windows are those of the input, not of what is left;
    words are compared as they are, and kept ones are joined by one space. The documents
    are added to an index in ``batches`` ranges of doc_id, smallest first; its runs are
    compacted before the third and every later one.

    Null or empty text: no words, the hash of the empty string. Texts shorter than a
    window lose nothing. Rows with null doc_id lose nothing. Rows that repeat a doc_id are
    one document: they don't remove each other's words. Empty table: empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    index = FingerprintIndex(spark, words, buckets=max(16, 1 << (n // 4000).bit_length()), fan=2)
    cuts = sorted({low + (high - low + 1) * i // batches for i in range(batches)}) if low is not None else []
    hits = spark.createDataFrame([], "doc_id long, at array<int>")
    for i, cut in enumerate(cuts):
        batch = docs.where(F.col("doc_id") >= cut)
        hits = hits.unionByName(index.add(batch.where(F.col("doc_id") < cuts[i + 1]) if i + 1 < len(cuts) else batch))
    return cut_out(docs, hits, words)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without passages of 13 words and more that a document with a smaller id has."""
    return without_repeats(documents(spark, sf_dir)).drop("kept_text")
