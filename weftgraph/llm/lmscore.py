"""Scores of documents by a gated recurrent language model and by smoothed word counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import SMALL_BATCHES, bucket, chunks, documents, materialise, split_words

RARE = 64


def rare_class(words: list[bytes]) -> np.ndarray:
    """The spelling class of a word: its last three bytes, hashed."""
    return np.fromiter((zlib.crc32(w[-3:]) % RARE for w in words), np.int64, len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all documents' words, A-Z lower-cased, as bytes."""

    def run(batches):
        for batch in chunks(batches, "text"):
            codes, _, vocab = split_words(batch.column(0), lower=True)
            yield pa.RecordBatch.from_arrays([vocab.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(vocab)))], ["word", "c"])

    counted = docs.select("text").mapInArrow(run, "word binary, c long").where("c > 0")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


class Scorer:
    """Counts of the whole training corpus, and the recurrent model learned from it.

    ``frequent`` words have outputs of their own; the counts of all others are kept in the
    table ``counts`` alone. All training documents are counted, the model starts from
    these counts, and its other weights are learned from all of them too. Shards of about
    ``shard`` documents learn apart and their weights are averaged by Spark, in ``rounds``
    rounds, each on its own part of every shard. ``learned`` is the number of tokens that
    went through backpropagation.
    """

    def __init__(self, training: DataFrame, frequent: int = 4000, shard: int = 1000, rounds: int = 3):
        self.spark = training.sparkSession
        training = training.select("doc_id", "text")
        self.counts = materialise(word_counts(training), "counts")
        self.n_docs = training.count()
        total = self.counts.agg(F.count(F.lit(1)), F.sum("c")).first()
        self.n_tokens = (total[1] or 0) + self.n_docs
        self.n_types = total[0] + (self.n_docs > 0)
        top = self.counts.orderBy(F.desc("c"), "word").limit(frequent).collect()
        self.words = [bytes(r.word) for r in top]
        # places: the end, the frequent words, then the spelling classes of all other words
        places = F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")), F.lit(RARE))
        sums = self.counts.groupBy(places.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
        self.rare_c, self.rare_n = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for r in sums:
            self.rare_c[r.k], self.rare_n[r.k] = r.c, r.n
        for r, k in zip(top, rare_class(self.words), strict=True):
            self.rare_c[k] -= r.c
            self.rare_n[k] -= 1
        self.open_counts = np.array([max(self.n_docs, 1), *(r.c for r in top)], float)
        self.layout = gru.Layout(self.open_counts, self.rare_c + 0.5 * (self.rare_n + 1.0))
        self.params = self.layout.start()
        self.learned = 0
        if self.n_docs:
            draw = F.pmod(F.xxhash64(F.lit("gru"), "doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
            drawn = training.withColumn("u", draw)
            shards = max(1, round(self.n_docs / shard))
            for k in range(rounds):
                self._round(drawn.where((F.col("u") >= k / rounds) & (F.col("u") < (k + 1) / rounds)), shards)

    def _round(self, docs: DataFrame, shards: int) -> None:
        shared = self.spark.sparkContext.broadcast((self.params, self.layout, self.words))  # bounded by ``frequent``

        def learn(table: pa.Table) -> pa.Table:
            p, lay, words = shared.value
            p, n = gru.train(p, lay, to_ids(words, table.column("text").combine_chunks())[0])
            return pa.table({"weights": pa.array([gru.flat(p)], pa.list_(pa.float32())), "n": pa.array([n], pa.int64())})

        # the row's number in its task as well, so that equal rows don't meet in one shard
        dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))

        def weigh(batches):
            total, count = 0.0, 0
            for batch in batches:
                for weights, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    total, count = total + n * weights.values.to_numpy().astype(np.float64), count + n
            if count:  # one row for each task, however many shards it has learned
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64())), pa.array([count], pa.int64())], ["weights", "n"])

        learned = dealt.groupBy("shard").applyInArrow(learn, "weights array<float>, n long")
        learned = materialise(learned.mapInArrow(weigh, "weights array<double>, n long"), "learned")
        count = learned.agg(F.sum("n")).first()[0] or 0
        self.learned += count
        rows = learned.select(F.posexplode("weights").alias("at", "v")).groupBy("at").agg((F.sum("v") / F.lit(count)).alias("v"))
        got = rows.toPandas()  # as many rows as the model has weights
        if len(got):
            vector = np.empty(len(got), np.float32)
            vector[got["at"].to_numpy()] = got["v"].to_numpy()
            self.params = gru.unflat(vector, self.params)

    def score(self, docs: DataFrame, block_bytes: int = 4_000_000) -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

        The documents are dealt into blocks of about ``block_bytes``; each block gets the
        counts of the words it has, by a join.
        """
        docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block_bytes)))))

        def words(table: pa.Table) -> pa.Table:
            _, _, vocab = split_words(table.column("text"), lower=True)
            return pa.table({"block": pa.array(np.full(len(vocab), table.column("block")[0].as_py()), pa.int64()), "word": vocab.cast(pa.binary())})

        asked = materialise(dealt.select("block", "text").groupBy("block").applyInArrow(words, "block long, word binary"), "asked")
        known = materialise(asked.join(self.counts, "word").select("block", "word", "c"), "known")
        n_tokens, n_types, end = self.n_tokens, self.n_types, self.n_docs
        rare_c, rare_n = self.rare_c, self.rare_n
        shared = self.spark.sparkContext.broadcast((self.params, self.layout, self.words))

        def run(docs: pa.Table, known: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
            p, lay, frequent = shared.value
            ids, vocab, codes, starts = to_ids(frequent, docs.column("text").combine_chunks())
            found = pc.index_in(vocab, value_set=known.column("word").combine_chunks().cast(pa.binary())).to_numpy(zero_copy_only=False)
            c = np.zeros(len(vocab))
            hit = ~np.isnan(found.astype(float))
            c[hit] = known.column("c").to_numpy()[found[hit].astype(np.int64)]
            sums = lambda v: (lambda t: t[starts[1:]] - t[starts[:-1]])(np.concatenate([[0.0], np.cumsum(v[codes])]))
            room = n_tokens + 0.5 * (n_types + 1)
            base = sums(np.log10((c + 0.5) / room)) + np.log10((end + 0.5) / room)
            place = word_places(frequent, vocab)
            k = np.maximum(place - lay.n_words, 0)
            within = np.where(place >= lay.n_words, np.log10((c + 0.5) / (rare_c[k] + 0.5 * (rare_n[k] + 1))), 0.0)
            own = gru.score(p, lay, ids) / np.log(10) + sums(within)
            n = np.diff(starts) + 1
            columns = docs.column("doc_id").combine_chunks(), n, sums((c > 0).astype(float)).round().astype(np.int64) + (end > 0), np.full(len(n), n_tokens), base, own
            return pa.table({m: pa.array(x, t) if isinstance(x, np.ndarray) else x for m, x, t in zip(names, columns, kinds, strict=True)})

        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2
        fields = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, fields)


def word_places(frequent: list[bytes], vocab: pa.Array) -> np.ndarray:
    """Places of words as the model counts them: the end is 0, then the frequent ones, then spelling classes."""
    found = pc.index_in(vocab, value_set=pa.array(frequent, pa.binary())).to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(found), len(frequent) + 1 + rare_class(vocab.to_pylist()), found + 1).astype(np.int64)


def to_ids(frequent: list[bytes], texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
    """Each text's places with the end behind them; and the vocabulary, codes and offsets they were made from."""
    codes, starts, vocab = split_words(texts, lower=True)
    vocab = vocab.cast(pa.binary())
    place = word_places(frequent, vocab)[codes]
    return [np.append(place[a:b], 0) for a, b in zip(starts[:-1], starts[1:], strict=True)], vocab, codes, starts


def score_documents(docs: DataFrame, training: DataFrame | None = None, **options) -> DataFrame:
    """Scores every row of ``docs`` with a model of ``training`` (all of ``docs`` if not given).

    Null and empty texts are one token, the end. Repeated rows are each scored, alike.
    Texts of any length are scored whole, the model's state carried along. With no
    training rows all words are unknown, base_score and score are still defined. An empty
    table gives an empty one. Other columns are ignored.
    """
    return Scorer(docs if training is None else training, **options).score(docs)


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents; those in the second of five hash classes are held out. The session keeps SMALL_BATCHES."""
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)
    docs = documents(spark, sf_dir)
    held_out = lambda x: F.coalesce(bucket(x) % 5 == 1, F.lit(False))
    rows = score_documents(docs, docs.where(~held_out(F.col("doc_id"))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
