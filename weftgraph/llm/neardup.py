"""Near-duplicate documents by min-max hashing: bands of minima and of maxima, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import linked
from .common import chunks, documents, free_name, materialise, split_words

_MIX = np.uint64(0x9E3779B97F4A7C15)


#: A number for each byte, and an odd factor for each of a word's first places.
_BYTES, _PLACES = np.random.default_rng(64).integers(0, 1 << 64, (2, 256), np.uint64)
_PLACES = _PLACES[:64] | np.uint64(1)


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """64-bit hashes of words: the numbers of their bytes times their places' factors, summed and mixed; of longer words than there are places, xxHash."""
    vocab = pa.concat_arrays([vocab.cast(pa.large_binary())])
    out = np.zeros(len(vocab), np.uint64)
    if not len(vocab):
        return out
    offsets = np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset : vocab.offset + len(vocab) + 1]
    data = np.frombuffer(vocab.buffers()[2] or b"", np.uint8)
    for a in range(0, len(vocab), 1 << 14):  # words at a time, so that the arrays stay small
        begin, size = offsets[a : a + (1 << 14) + 1][:-1], np.diff(offsets[a : a + (1 << 14) + 1])
        head = np.minimum(size, len(_PLACES))
        ends = np.cumsum(head)
        place = np.arange(ends[-1]) - np.repeat(ends - head, head)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data[np.repeat(begin, head) + place]] * _PLACES[place])])
        out[a : a + len(size)] = sums[ends] - sums[ends - head] + size.astype(np.uint64) * _MIX
        for i in np.flatnonzero(size > len(_PLACES)):
            out[a + i] = xxhash.xxh64_intdigest(vocab[a + i].as_py())
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive entries."""
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += h[j : len(h) - k + 1 + j]
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of one text, given its words' hashes; with fewer words, of the whole sequence."""
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(k, len(h))) + np.uint64(0 if len(h) >= k else len(h)))


#: As many bytes of text are signed at a time: a worker stands beside an executor's full heap.
SIGNED_BYTES = 2_000_000
#: 64 low bytes of the signature, half of minima and half of maxima, as eight numbers.
SKETCH = [f"m{i}" for i in range(8)]
#: 256 parities of the set: each shingle flips one, so sets differ in at most as many as there are shingles that one of them alone has.
PARITIES = [f"p{i}" for i in range(4)]


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, t, n_shingles, set_hash (128 bits of the set), keys (the hashes of the bands), the sketch and the parities.

    Each of rows * bands / 2 permutations is evaluated once for each shingle; its minimum
    and its maximum both go into the signature. Half of the bands are of minima, half of
    maxima, so each agrees with the chance similarity ** rows.
    """
    n = rows * bands // 2
    if n < 32:
        raise ValueError("rows * bands must be 64 or more")
    rng = np.random.default_rng(9)
    a, b = (rng.integers(0, 1 << 63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))

    def key(values: np.ndarray) -> np.ndarray:
        return gram_hashes(values, rows)[::rows]

    def run(batches):
        for batch in chunks(batches, "text", SIGNED_BYTES):
            codes, starts, vocab = split_words(batch.column(2), lower=True)
            h = word_hashes(vocab)[codes]
            counts, digests, keys, sketch, odd = [], [], [], np.zeros((batch.num_rows, 8), np.int64), np.zeros((batch.num_rows, 4), np.int64)
            for i, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                found = shingles(h[s:e], k)
                counts.append(len(found))
                if not len(found):
                    digests.append(None)
                    keys.append([])
                    continue
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                low, high = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
                for part in range(0, len(found), 2048):
                    v = a * found[part : part + 2048]
                    v += b
                    v >>= np.uint64(32)
                    np.minimum(low, v.min(axis=1), out=low)
                    np.maximum(high, v.max(axis=1), out=high)
                own = np.concatenate([key(low), key(high)]) + np.arange(bands, dtype=np.uint64)
                keys.append((own * _MIX).view(np.int64))
                sketch[i] = np.concatenate([low[:32], high[:32]]).astype(np.uint8).view(np.int64)
                odd[i] = np.packbits((np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(bool)).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, sketch.T), *map(pa.array, odd.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_shingles", "set_hash", "keys", *SKETCH, *PARITIES])

    fields = "doc_id long, t long, n_shingles long, set_hash binary, keys array<long>" + "".join(f", {c} long" for c in [*SKETCH, *PARITIES])
    return docs.select("doc_id", "t", "text").mapInArrow(run, fields)


def alike(percent: int):
    """Whether sets may be similar by size, parities and agreement of the sketches, for arrays of the sketches' columns.

    Of 64 entries those of two sets at the threshold agree in 64 * similarity with a deviation of
    8 * sqrt(similarity * (1 - similarity)); six deviations below, a pair is left out (a chance of
    about 1e-8). Similar sets of n and m shingles differ in (1 - s) / (1 + s) * (n + m) shingles
    at most, so in no more parities: no similar pair is left out by these.
    """
    s = percent / 100
    least = 64 * s - 48 * (s * (1 - s)) ** 0.5

    def test(x: dict, y: dict) -> np.ndarray:
        near = 100 * np.minimum(x["n"], y["n"]) >= percent * np.maximum(x["n"], y["n"])
        same = np.zeros(len(near), np.int64)
        for c in SKETCH:
            same += ((x[c] ^ y[c]).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        flipped = sum(np.bitwise_count((x[c] ^ y[c]).view(np.uint64)).astype(np.int64) for c in PARITIES)
        near &= (100 + percent) * flipped <= (100 - percent) * (x["n"] + y["n"])
        return np.where(near & (same >= least), 64 - same, -1)

    return test


def shingle_ids(codes: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the distinct numbers of its k-word shingles, equal ones being equal words; with fewer words, of all its words."""
    size = np.int64(codes.max() + 2) if len(codes) else 1
    # a text's end is a word of its own, 0, so that shorter sequences are numbered as well
    ids = np.zeros(len(codes) + k * (len(starts) - 1), np.int64)
    place = starts[:-1] + k * np.arange(len(starts) - 1)
    ids[np.arange(len(codes)) + np.repeat(k * np.arange(len(starts) - 1), np.diff(starts))] = codes.astype(np.int64) + 1
    word = ids
    for j in range(1, k):
        _, ids = np.unique(ids[:-1] * size + word[j:], return_inverse=True)
    count = np.diff(starts)
    count = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return [np.unique(ids[a : a + n]) for a, n in zip(place, count, strict=True)]


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have 100 * intersection >= percent * union, counted on the full sets.

    Words are numbered within a batch, so shingles are compared as words, not as hashes.
    """
    left, right = (texts.select(F.col("node").alias(f"_{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    rows = pairs.join(left, F.col("a") == F.col("_a")).select("a", "b", "ta").join(right, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb")

    def run(batches):
        for whole in batches:
            for batch in chunks([whole], "ta", 2_000_000):
                # texts repeat within a batch: each is split once
                both = pa.concat_arrays([pa.array(batch.column(i)).cast(pa.string()) for i in (2, 3)]).dictionary_encode()
                codes, starts, _ = split_words(both.dictionary, lower=True)
                sets = shingle_ids(codes, starts, k)
                places = both.indices.to_numpy()
                keep = []
                for x, y in zip(places[: batch.num_rows], places[batch.num_rows :], strict=True):
                    p, q = sets[x], sets[y]
                    same = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, bands: int = 30) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Documents are linked if their sets of k-word shingles (A-Z lower-cased; with fewer
    words the whole sequence) have 100 * intersection >= percent * union; component_id is
    the smallest doc_id that links reach. Candidates share a band; a pair at 80 % is missed
    by 30 bands of 4 with a chance of 1.4e-7, one at 85 % by 24 bands of 5 with 8e-7.
    Every link is confirmed on the full sets, of texts of any length.

    Documents with the same set are one node; buckets.linked compares the others of a key
    without all pairs of it, and reads texts only for pairs that their sketches allow.

    Null or empty text, or no word: n_shingles 0, linked with nothing. Null doc_id: linked
    with nothing, component null. Rows that repeat a doc_id with another text are linked
    each for itself. Empty table: empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    signed = materialise(signatures(docs, k, rows, bands), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a set's node is a hash of it; of its texts the one with the smallest id is read
    once = [F.first(c).alias(c) for c in ("keys", *SKETCH, *PARITIES)]
    nodes = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "t")).alias("least"), F.first("n_shingles").alias("n"), *once)
    nodes = materialise(nodes.withColumn("node", F.xxhash64("set_hash")), "nodes")
    entries = nodes.select("node", F.explode("keys").alias("key"))
    centres = entries.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("many")).where("many > 1")
    # the centres are few beside the entries: hashing them spares the sort of both
    entries = materialise(entries.join(centres.hint("shuffle_hash"), "key"), "entries")
    pairs = entries.where("many = 2 AND node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = nodes.join(wanted, "node", "left_semi").select(F.col("least.doc_id").alias("_d"), F.col("least.t").alias("_t"), "node")
        texts = docs.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("node", "text")
        return confirmed(pairs, materialise(texts.dropDuplicates(["node"]), "texts"), k, percent)

    found = linked(pairs, entries.where("many > 2").select("key", "node"), nodes.select("node", "n", *SKETCH, *PARITIES), alike(percent), confirm)
    named = nodes.select("node", "set_hash", F.col("least.doc_id").alias("least")).join(found, F.col("node") == F.col("id"), "left")
    named = materialise(named.select("set_hash", "least", F.coalesce("component", "node").alias("c")), "named")
    least = named.groupBy("c").agg(F.min("least").alias("_c"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(named.join(least, "c").select("set_hash", "_c"), "set_hash", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 85 %."""
    out = near_duplicates(documents(spark, sf_dir), k=3, percent=85, rows=5, bands=24)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates (5-word shingles, 80 %) stays, the one with the smallest id.

    Rows without words and rows with null doc_id stay; rows that repeat the id of one that
    goes go with it. An empty table stays empty; all columns that came in go on unchanged.
    """
    found = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone := free_name(docs, "_gone"))).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti").select(*docs.columns)
