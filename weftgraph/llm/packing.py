"""Packing of tokenised documents into sequences: best fit, then swap-based local search."""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, materialise, split_words

_CACHED = 250_000


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of words in a vocabulary whose tokens never cross white space; remembered up to a bound, one for each Python worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words of Latin letters, digits and signs are lower-cased, split and looked up part by part; others, and
        # those that may hold one of the vocabulary's special tokens, go to the tokenizer whole
        self.simple = regex.compile("[!-~¡-¬®-įı-ſ]+")
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes the other bytes as letters from 256 on
        hidden = [b for b in range(256) if b not in visible]
        self.letter = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        # ids as bytes of four each, which take a third of an array's memory
        self.part: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.part.get(part)
        if ids is None:
            if len(self.part) > _CACHED:
                self.part.clear()
            text = part if part.isascii() else "".join(map(self.letter.__getitem__, part.encode()))
            ids = self.part[part] = _packed([t.id for t in self.tokenizer.model.tokenize(text)])
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # is one part
            return self._part(word.lower())
        if "<|" not in word and self.simple.fullmatch(word):
            return b"".join([self._part(part) for part in self.parts.findall(word.lower())])
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, words: list[str]) -> list[bytes]:
        """Each word's ids, little-endian unsigned numbers of 32 bits."""
        if len(self.known) > _CACHED:
            # words that come again stay known
            self.known, self.earlier = {}, self.known
        known, earlier, out = self.known, self.earlier, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = earlier.get(w) or self._word(w)
            out.append(ids)
        return out


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def tokenised_pieces(docs: DataFrame, size: int = 4096, end: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and salt: each document's ids and ``end``, cut every ``size`` ids.

    Null text is empty: one piece with ``end`` alone. ``salt`` numbers the rows of a task.
    """

    def run(batches):
        get, salt = word_ids(path), 0
        for batch in chunks(batches, "text"):
            codes, starts, vocab = split_words(batch.column(1))
            found = get(vocab.to_numpy(zero_copy_only=False).tolist())
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin = np.concatenate([[0], np.cumsum(n)])
            flat = np.frombuffer(b"".join(found), "<u4")
            rows = []
            for doc, a, b in zip(batch.column(0).to_pylist(), starts[:-1], starts[1:], strict=True):
                own = codes[a:b]
                k = n[own]
                stops = np.cumsum(k)
                total = int(stops[-1]) if len(stops) else 0
                ids = np.empty(total + 1, "<u4")
                ids[:total] = flat[np.repeat(begin[own] - (stops - k), k) + np.arange(total)]
                ids[total] = end
                rows += [(doc, p, p * size, min(size, total + 1 - p * size), zlib.crc32(ids[p * size : (p + 1) * size].tobytes())) for p in range(-(-(total + 1) // size))]
            columns = list(zip(*rows, strict=True))
            salts = np.arange(salt, salt + len(rows))
            salt += len(rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(salts)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Items by falling length, each into the bin with the least room that takes it; bins as lists of items."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left, k = size - lengths[i], len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            left -= lengths[i]
        if left:
            bisect.insort(room, (left, k))
    return bins


def _exchange(low: list[int], high: list[int], room: int, n: list[int]) -> tuple[list[int], list[int]] | None:
    """What to give from the emptier bin and take from the fuller one so that the fuller one gains most, at most ``room``."""
    best, gain = None, 0
    pair_up = lambda items: [[i, j] for k, i in enumerate(items) for j in items[k + 1 :]]
    singles = sorted((n[i], [i]) for i in high)
    pairs = sorted((n[i] + n[j], [i, j]) for i, j in pair_up(high))
    takes = [[(0, []), *singles], pairs]
    sums = [[x[0] for x in found] for found in takes]
    for give in [[i] for i in low] + pair_up(low):
        total = sum(n[i] for i in give)
        for found, own in list(zip(takes, sums, strict=True))[: 3 - len(give)]:
            at = bisect.bisect_left(own, total - room)  # the least that makes enough room
            if at < len(own) and (g := total - own[at]) > gain:
                best, gain = (give, found[at][1]), g
    return best


def local_search(bins: list[list[int]], n: list[int], size: int, tries: int = 400) -> list[list[int]]:
    """Empties underfull bins by moves, one-for-one and two-for-one exchanges, each of which raises the sum of squared fills.

    The emptiest bin gives to a fuller one: a document, or one or two for one or two
    smaller ones. It ends when no bin fewer is possible, nothing helps the emptiest bins,
    or after ``tries`` exchanges a bin.
    """
    fill = [sum(n[i] for i in b) for b in bins]
    least = -(-sum(fill) // size)
    live = sorted((k for k in range(len(bins)) if fill[k] < size), key=lambda k: fill[k])
    count, stuck = len(bins), 0
    while count > least and stuck < len(live) - 1 and stuck < 4:
        low, done = live[stuck], False
        for _ in range(tries):
            step = None
            for high in reversed(live[stuck + 1 :]):
                if fill[high] < size and fill[high] >= fill[low] and (step := _exchange(bins[low], bins[high], size - fill[high], n)):
                    break
            if not step:
                break
            give, take = step
            moved = sum(n[i] for i in give) - sum(n[i] for i in take)
            bins[low] = [i for i in bins[low] if i not in give] + take
            bins[high] = [i for i in bins[high] if i not in take] + give
            fill[low] -= moved
            fill[high] += moved
            if not bins[low]:
                done = True
                break
        if done:
            count -= 1
            live.pop(stuck)
            stuck = 0
        else:
            stuck += 1
        live.sort(key=lambda k: fill[k])
    return [b for b in bins if b]


def _pack_group(size: int, level: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        n = pdf["length"].tolist()
        bins = local_search(best_fit(n, size), n, size)
        order = np.array([i for b in bins for i in b])
        out = pdf.iloc[order].drop(columns="_group")
        out["sequence_id"] = np.repeat([(level << 56) + (int(key[0]) << 24) + k for k in range(len(bins))], [len(b) for b in bins])
        taken = out["length"].groupby(out["sequence_id"], sort=False)
        out["offset"] = taken.cumsum() - out["length"]
        out["fill"] = taken.transform("sum")
        return out

    return run


def pack(pieces: DataFrame, size: int = 4096, group_rows: int = 2000, full: float = 0.99) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, salt) read from storage.

    Pieces are dealt by a hash into groups of about ``group_rows``, each packed in one
    task. The pieces of bins that are filled to less than ``full`` are dealt again, to
    fewer groups, until one group holds all that is left; so the waste doesn't grow with
    the number of groups. It also ends when a level leaves as many pieces as it was given,
    in no fewer bins: pieces that nothing fits beside never fill a bin.
    """
    done, rest, level = None, pieces, 0
    before, n_rest, n_bins = None, rest.count(), None
    while True:
        groups = max(1, -(-n_rest // group_rows))
        keys = [F.lit(level), *(F.coalesce(F.col(c), F.lit(-1)) for c in ("doc_id", "piece", "start", "salt"))]
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))

        fields = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, fill long"
        packed = materialise(dealt.groupBy("_group").applyInPandas(_pack_group(size, level), fields), "packed")
        left = packed.where(F.col("fill") < full * size)
        n_left, left_bins = left.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        stuck = before is not None and n_left == n_rest and left_bins >= n_bins
        kept = packed if groups == 1 else before if stuck else packed.where(F.col("fill") >= full * size)
        done = kept if done is None else done.unionByName(kept)
        if groups == 1 or stuck:
            return done.drop("salt", "fill")
        rest, level = left.select(*pieces.columns), level + 1
        before, n_rest, n_bins = left, n_left, left_bins


def pack_documents(docs: DataFrame, size: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``docs``.

    Null text: one piece with the end id. Documents longer than ``size`` are cut, others
    never. Special tokens of the vocabulary that stand in a text are encoded as such, as
    the tokenizer does by default. Repeated rows and null ids are each packed. Empty table:
    empty result. Other columns are ignored.
    """
    return pack(materialise(tokenised_pieces(docs, size, path=path), "pieces"), size)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what the mix has taken, in sequences of 4096 tokens."""
    return pack_documents(docs)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack_documents(documents(spark, sf_dir))
