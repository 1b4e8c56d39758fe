"""Fuzzy line deduplication: word runs (or SimHashes) of normalised lines, edit similarity, connected groups."""

from __future__ import annotations

from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import linked, list_rows, pairs_and_entries
from .common import SMALL_BATCHES, chunks, documents, free_name, materialise, settings, split_words
from .neardup import word_hashes

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: 256 parities and eight counts of a line's words.
SKETCH = ["s0", "s1", "s2", "s3", "s4"]


def normalised(lines: pa.Array) -> pa.Array:
    """Lower case, digits as 0, without characters that aren't letters, digits or white space."""
    lines = pc.utf8_lower(lines)
    other = pc.invert(pc.ascii_is_alpha(lines))  # words of a to z alone are done
    changed = pc.replace_substring_regex(pc.replace_substring_regex(lines.filter(other), r"[^\p{L}\p{N}\s]", ""), r"\p{N}", "0")
    return pc.replace_with_mask(lines, other, changed)


def line_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The normalised words of lines, empty ones left out: codes, where each line's begin and end, vocabulary and its hashes."""
    codes, starts, vocab = split_words(lines)
    vocab = normalised(vocab)  # characters are normalised one by one, so each distinct word is enough
    keep = (pc.binary_length(vocab).to_numpy() > 0)[codes]
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[starts], vocab, word_hashes(vocab)


def ordered_hash(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's words in order, from the hashes of the words; 0 without words."""
    n = np.diff(starts)
    full = np.zeros(len(n), np.uint64)
    if not len(h):
        return full
    some = np.flatnonzero(n)
    begin = starts[:-1][some]
    place = np.arange(len(h)) - np.repeat(begin, n[some])
    power = np.cumprod(np.full(place.max() + 1, _MIX | np.uint64(1), np.uint64))
    mixed = (h ^ (h >> np.uint64(31))) * power[place]
    full[some] = np.add.reduceat(mixed, begin)
    full ^= full >> np.uint64(29)
    full *= _MIX
    return full


@lru_cache(maxsize=100_000)
def run_budget(n: int, q: int, share: float) -> int:
    """How many of its first runs of ``q`` words a line of ``n`` words needs as keys so that no similar line is missed.

    Between lines of n and m >= n words at most d = (1 - share) m edits are allowed, m - n of
    them insertions. An edit touches at most q runs of the shorter line, an insertion q - 1,
    so at most q d - (m - n) of its distinct runs aren't in the longer one, and of the first
    q d - (m - n) + 1 in any order that all lines use, one is among the first of both;
    likewise q d + 1 of the longer one. Lines have a run in common if the longer one has
    more than q d places; runs of two words are taken where that is true, else of one. Runs of
    three would take half as many keys again and bring no fewer other lines together.
    """
    need, m = 0, n
    while m - (d := int((1 - share) * m + 1e-9)) <= n:
        if d and q == (2 if m - 1 > 2 * d else 1):
            need = max(need, q * d - (m - n) + 1)
        elif need and q * d - (m - n) + 1 < need:
            break
        m += 1
    return need


def line_runs(h: np.ndarray, sizes: np.ndarray, starts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of word runs as (line, key, 0) columns: two lines whose edit similarity is at least ``share`` have one in common.

    ``h`` and ``sizes`` are the words' hashes and lengths. A line's runs are taken by
    falling number of characters, those of equal number by their hash: runs of long words
    are rare, so few other lines share one by chance. run_budget says how many it takes.
    """
    n = np.diff(starts)
    kinds, kind = np.unique(n, return_inverse=True)
    at, keys = [], []
    for q in (1, 2):
        budget = np.array([run_budget(int(k), q, share) for k in kinds], np.int64)[kind]
        chosen = np.flatnonzero((budget > 0) & (n >= q))
        for a in range(0, len(chosen), 1 << 11):  # lines at a time, so that the arrays stay small
            own = chosen[a : a + (1 << 11)]
            count = n[own] - q + 1
            line = np.repeat(np.arange(len(own)), count)
            place = np.arange(len(line)) + np.repeat(starts[:-1][own] - np.cumsum(count) + count, count)
            run, length = np.full(len(line), q, np.uint64), np.zeros(len(line), np.uint64)
            for k in range(q):
                run = (run ^ h[place + k]) * _MIX
                run ^= run >> np.uint64(29)
                length += sizes[place + k]
            # 20 bits of line, 6 of length (longest first) and 38 of hash sort as one number
            rank = (line.astype(np.uint64) << np.uint64(44)) | ((np.uint64(63) - np.minimum(length, np.uint64(63))) << np.uint64(38)) | (run >> np.uint64(26))
            ordered = np.sort(rank)
            ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
            ends = np.searchsorted(ordered, np.arange(len(own) + 1).astype(np.uint64) << np.uint64(44))
            last = ordered[np.minimum(ends[:-1] + budget[own], ends[1:]) - 1]
            keep = rank <= last[line]
            at.append(own[line[keep]])
            keys.append(run[keep])
    at, keys = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.uint64), *keys])
    return at, keys, np.zeros(len(at), np.int64)


#: Blocks of a line's SimHash and bits of a block. More bits suit more lines: with the same number of blocks each takes recall.
BLOCKS, BITS = 20, 16
#: Of 64 further bits, as many may differ between lines that are compared word by word.
CHECK_BITS = 16


def simhash_blocks(codes: np.ndarray, per_word: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each line's SimHash, as numbers (lines, BLOCKS), and 64 further bits of it.

    ``codes`` are the words as places in the vocabulary, whose hashes and lengths are ``per_word``
    and ``lengths``. A word votes on each bit; words of four letters and more, which are
    rarer, have two votes, those of 22 and more three, of 66 and more four. A bit is set if more than half of the votes are for it.
    """
    own, width = BLOCKS * BITS, BLOCKS * BITS + 64
    weight = np.clip(np.round(lengths.astype(float) ** 0.3), 1, 4).astype(np.uint8)
    votes = np.empty((len(per_word), width), np.uint8)
    for a in range(0, len(per_word), 1 << 12):  # words at a time, so that only the votes are held
        some = per_word[a : a + (1 << 12)]
        mixed = np.stack([_mixed(some + salt) for salt in np.arange(1, width // 64 + 2, dtype=np.uint64) * _MIX], axis=1) if len(some) else np.zeros((0, 1), np.uint64)
        votes[a : a + (1 << 12)] = np.unpackbits(mixed.view(np.uint8), axis=1)[:, :width] * weight[a : a + (1 << 12), None]
    n = np.diff(starts)
    half = np.zeros(len(n), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        half[some] = np.add.reduceat(weight[codes].astype(np.int64), starts[:-1][some])
    power = (1 << np.arange(BITS)).astype(np.float32)
    out, check = np.zeros((len(n), BLOCKS), np.uint32), np.zeros(len(n), np.int64)

    def pack(rows: np.ndarray, sums: np.ndarray) -> None:
        bits = 2 * sums.astype(np.int64) > half[rows, None]
        check[rows] = np.packbits(bits[:, own:], axis=1).view(np.int64).ravel()
        out[rows] = (bits[:, :own].reshape(-1, BITS).astype(np.float32) @ power).astype(np.uint32).reshape(-1, BLOCKS)

    # lines of about the same length together, a word of each at a time; very long ones by themselves
    order = np.argsort(-n, kind="stable")
    long = order[n[order] > 1024]
    for row in long:
        total = np.zeros(width, np.int64)
        for a in range(starts[row], starts[row + 1], 4096):
            total += votes[codes[a : min(a + 4096, starts[row + 1])]].sum(axis=0, dtype=np.int64)
        pack(np.array([row]), total[None])
    for a in range(len(long), len(order), 512):
        rows = order[a : a + 512]
        begin, left = starts[:-1][rows], len(rows) - np.searchsorted(n[rows][::-1], np.arange(n[rows[0]]), side="right")
        total, part = np.zeros((len(rows), width), np.uint16), np.zeros((len(rows), width), np.uint8)
        for k, m in enumerate(left):
            part[:m] += votes[codes[begin[:m] + k]]
            if k % 63 == 62:  # 63 votes of 4 at most fit into a byte
                total += part
                part[:] = 0
        pack(rows, total + part)
    return out, check


def _mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finish."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash_keys(codes: np.ndarray, per_word: np.ndarray, lengths: np.ndarray, starts: np.ndarray, share: float, slack: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, check) columns: each block of a line's SimHash with its place and a range of numbers of words.

    Lines differ in at most BLOCKS - 1 bits only if they have a block in common; most similar
    ones that differ in more have one, too. Ranges end at powers of 1 / share; a line within
    ``slack`` words of the next range is in both. Lines of so few words that no similar
    line but an equal one can be get no keys.
    """
    n = np.diff(starts)
    longest = np.floor(n / share + 1e-9)
    some = np.flatnonzero(np.floor((1 - share) * longest + 1e-9) >= 1)
    size = n[some]
    own = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(own[-1]) + np.repeat(starts[:-1][some] - own[:-1], size)
    blocks, check = simhash_blocks(codes[place], per_word, lengths, own)
    blocks = blocks.astype(np.uint64)
    kind = lambda m: np.floor(np.log(m) / -np.log(share) + 1e-9).astype(np.uint64)
    low, high = kind(size), kind(np.minimum(size + slack, longest[some]))
    number = np.arange(BLOCKS, dtype=np.uint64)
    keys = lambda rows, of: _mixed(((of[rows, None] * np.uint64(BLOCKS) + number) << np.uint64(BITS)) | blocks[rows])
    both = np.flatnonzero(low < high)
    at = np.concatenate([some, some[both]])
    return np.repeat(at, BLOCKS), np.concatenate([keys(np.arange(len(some)), low), keys(both, high)]).ravel(), np.repeat(np.concatenate([check, check[both]]), BLOCKS)


def parities(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Five 64-bit numbers a line, of which an edit changes little.

    Each word, by itself and as its second, third... occurrence, flips one of 256 bits, so an
    edit changes at most two; and is counted in one of eight bytes, up to 255, so an edit
    changes their sum of differences by two at most.
    """
    n = len(starts) - 1
    out = np.empty((n, 5), np.int64)
    for a in range(0, n, 1 << 12):  # lines at a time, so that the counts stay small
        b = min(a + (1 << 12), n)
        line = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1])).astype(np.uint64)
        # 14 bits of line and 50 of hash sort as one number
        ordered = np.sort((line << np.uint64(50)) | (h[starts[a] : starts[b]] >> np.uint64(14)))
        place = np.arange(len(ordered))
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        time = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        word = ((ordered & np.uint64((1 << 50) - 1)) + time * _MIX) * _MIX
        spot = ((ordered >> np.uint64(50)) << np.uint64(8)) | (word >> np.uint64(56))
        odd = (np.bincount(spot.astype(np.int64), minlength=256 * (b - a)) & 1).astype(bool).reshape(-1, 256)
        out[a:b, :4] = np.packbits(odd, axis=1).view(np.int64)
        kind = ((ordered >> np.uint64(50)) << np.uint64(3)) | (((ordered & np.uint64((1 << 50) - 1)) * _MIX) >> np.uint64(61))
        count = np.bincount(kind.astype(np.int64), minlength=8 * (b - a))
        out[a:b, 4] = np.minimum(count, 255).astype(np.uint8).view(np.int64)
    return out


def line_checks(sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number a line: 56 parities that an edit changes two of at most, those of the sketch laid over each other, and up to 255 words."""
    bits = np.bitwise_xor.reduce(np.ascontiguousarray(sketch[:, :4]).view(np.uint64), axis=1)
    bits = (bits >> np.uint64(8)) ^ (bits & np.uint64(255))
    return ((bits << np.uint64(8)) | np.minimum(n, 255).astype(np.uint64)).view(np.int64)


def near_checks(share: float):
    """Whether lines may be similar by their line_checks; no similar pair fails. Counts that were cut to 255 stand for more, of which a fifth and more may be edits: then all parities may differ."""
    most = np.floor((1 - share) * np.arange(256) + 1e-9).astype(np.int16)

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = (x & 255).astype(np.int16), (y & 255).astype(np.int16)
        large = np.maximum(n, m)
        edits = most[large]
        near = np.bitwise_count((x ^ y).view(np.uint64) >> np.uint64(8)) <= 2 * edits
        return ((np.abs(n - m) <= edits) & near) | (large == 255)

    return test


def alike(share: float):
    """Whether lines may be similar by number of words and parities; for arrays of the sketches' columns."""

    def test(x: dict, y: dict) -> np.ndarray:
        most = np.floor((1 - share) * np.maximum(x["n"], y["n"]) + 1e-9)
        near = np.abs(x["n"] - y["n"]) <= most
        flipped = sum(np.bitwise_count((x[c] ^ y[c]).view(np.uint64)).astype(np.int64) for c in SKETCH[:4])
        counts = [np.ascontiguousarray(v[SKETCH[4]]).view(np.uint8).reshape(-1, 8).astype(np.int16) for v in (x, y)]
        near &= (flipped <= 2 * most) & (np.abs(counts[0] - counts[1]).sum(axis=1) <= 2 * most)
        return np.where(near, flipped, -1)

    return test


def edit_similar(x: list, y: list, share: float) -> bool:
    """Whether the edit distance of two word lists is at most (1 - share) of the longer one."""
    most = int((1 - share) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    if len(x) == len(y) and sum(map(ne, x, y)) <= most:
        return True
    a, b = 0, 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    while b < min(len(x), len(y)) - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if max(len(x), len(y)) <= most:
        return True
    if not x or not y:
        return False
    # a column of the distance table at a time, as the bits where it rises (up) and falls (down) by one (Myers 1999, Hyyrö 2003)
    at: dict = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full, top, found = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
    up, down, left = full, 0, len(y)
    for w in y:
        same = at.get(w, 0)
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = down | (full & ~(across | up)), across & up
        found += bool(rise & top) - bool(fall & top)
        left -= 1
        if found - left > most:
            return False
        rise, fall = (rise << 1) | 1, fall << 1
        up, down = (fall | ~(across | rise)) & full, rise & across & full
    return found <= most


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of texts that were split at \\n, and where each text's lines end; null has none."""
    lists = pc.split_pattern(texts.cast(pa.string()), "\n")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return lists.flatten(), ends


def scanned(docs: DataFrame, min_words: int, share: float, exact: bool = True, bucket_bytes: int = 8_000_000) -> DataFrame:
    """One pass over docs (doc_id, t, text): rows of occurrences, of pairs to compare, and of keys.

    kind 0: the line ``a`` (its hash) of n words is at place ``line`` of document (doc_id b,
    text hash c), with its sketch where a task meets it first. Kinds 1 and 2: see
    buckets.pairs_and_entries. A task sends a line's keys once, dealt into buckets of about
    ``bucket_bytes`` of text each; what a key's bucket brings together is pairs and keys alone.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))

    def scan(batches):
        seen, turn = np.zeros(0, np.int64), 0
        for batch in chunks(batches, "text", 4_000_000):
            lines, ends = lines_of(batch.column(2))
            codes, starts, vocab, per_word = line_words(lines)
            words, n = per_word[codes], np.diff(starts)
            h = ordered_hash(words, starts).view(np.int64)
            keep = np.flatnonzero(n >= min_words)
            _, first = np.unique(h[keep], return_index=True)
            fresh = np.sort(keep[first])
            fresh = fresh[~np.isin(h[fresh], seen)]
            seen = np.union1d(seen, h[fresh])
            sketch = np.zeros((len(n), len(SKETCH)), np.int64)
            count = n[fresh]
            place = np.arange(count.sum()) + np.repeat(starts[:-1][fresh] - np.cumsum(count) + count, count)
            own = np.concatenate([[0], np.cumsum(count)])
            sketch[fresh] = parities(words[place], own)
            lengths = pc.utf8_length(vocab).to_numpy().astype(np.uint64)
            if exact:
                at, keys, _ = line_runs(words[place], lengths[codes[place]], own, share)
                check = line_checks(sketch[fresh], count)[at]
            else:
                at, keys, check = simhash_keys(codes[place], per_word, lengths, own, share)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))[keep]
            occurs = {"h": h[keep], "doc_id": batch.column(0).take(pa.array(doc)), "t": batch.column(1).take(pa.array(doc)), "line": (keep - ends[doc]).astype(np.int32), "n": n[keep].astype(np.int32)}
            occurs |= dict(zip(SKETCH, sketch[keep].T, strict=True))
            turn += 1
            yield list_rows(keys, h[fresh][at], check, buckets, occurs, int(seen[0] + turn) % buckets if len(seen) else 0)

    def reduce(table: pa.Table) -> pa.Table:
        flat = [table.column(c).combine_chunks().flatten() for c in ("h", "doc_id", "t", "line", "n", *SKETCH)]
        kind, a, b = pairs_and_entries(table, near_checks(share) if exact else CHECK_BITS)
        none = lambda t: pa.nulls(len(kind), t)
        columns = [pa.array(np.zeros(len(flat[0]), np.int8)), *flat], [pa.array(kind), pa.array(a), pa.array(b), none(pa.int64()), none(pa.int32()), none(pa.int32()), *(none(pa.int64()) for _ in SKETCH)]
        names = ["kind", "a", "b", "c", "line", "n", *SKETCH]
        return pa.concat_tables([pa.table(dict(zip(names, c, strict=True))) for c in columns])

    packed = "bucket int, key array<int>, node array<long>, check array<long>, h array<long>, doc_id array<long>, t array<long>, line array<int>, n array<int>" + "".join(f", {c} array<long>" for c in SKETCH)
    fields = "kind byte, a long, b long, c long, line int, n int" + "".join(f", {c} long" for c in SKETCH)
    return docs.mapInArrow(scan, packed).groupBy("bucket").applyInArrow(reduce, fields)


def repeated_lines(docs: DataFrame, min_words: int = 1, share: float = 0.8, exact: bool = True) -> DataFrame:
    """(doc_id, t, lines): the places, from 0, of the lines of each document that another occurrence stands for.

    ``docs`` has doc_id, t (a hash of the text) and text. Lines of fewer than ``min_words`` words
    are never removed. Two lines are linked if they are equal when normalised, or the edit
    distance of their words is at most 1 - share of the longer line. Of all lines that
    links connect, the occurrence with the smallest (doc_id, t, place) stays.

    Equal lines are one node, so a line that many documents have costs no pairs. Lines are
    compared that have a word run in common, see line_runs: all similar pairs have. Pairs of a
    run are told apart by line_checks where they meet, which no similar pair fails. With ``exact`` off blocks of
    SimHashes take the runs' place, see simhash_keys: about nine of ten similar pairs have one in common (the README has measurements).
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = materialise(scanned(docs, min_words, share, exact), "lines")
    found = rows.where("kind = 0").select(F.col("a").alias("h"), F.col("b").alias("doc_id"), F.col("c").alias("t"), "line", "n", *SKETCH)
    at = F.struct("doc_id", "t", "line")
    firsts = found.groupBy("h").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("n").alias("n"), *(F.max(F.when(F.col(c) != 0, F.col(c))).alias(c) for c in SKETCH))
    firsts = materialise(firsts.fillna(0, SKETCH), "firsts")

    def words_of(wanted: DataFrame) -> DataFrame:
        """(h, words) of the lines ``wanted`` (h)."""
        need = wanted.join(firsts.select("h", "first"), "h").groupBy(F.col("first.doc_id").alias("_d"), F.col("first.t").alias("_t"))
        need = materialise(need.agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h")).alias("want")), "need")
        # the texts stay where they are if the list is short enough to be sent to them
        need = F.broadcast(need) if need.count() <= 100_000 else need.hint("shuffle_hash")
        texts = docs.join(need, (F.col("doc_id") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("text", "want")

        def run(batches):
            for batch in chunks(batches, "text", 4_000_000):
                lines, ends = lines_of(batch.column(0))
                want = batch.column(1)
                place = np.repeat(ends[:-1], np.diff(want.offsets.to_numpy())) + want.flatten().field("line").to_numpy()
                yield pa.RecordBatch.from_arrays([want.flatten().field("h"), normalised(lines.take(pa.array(place)))], ["h", "words"])

        return texts.mapInArrow(run, "h long, words string").dropDuplicates(["h"])

    def confirm(pairs: DataFrame) -> DataFrame:
        lines = materialise(words_of(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()), "words")
        left, right = (lines.select(F.col("h").alias(f"_{x}"), F.col("words").alias(f"w{x}")) for x in "ab")

        def run(batches):
            for batch in batches:
                keep = [edit_similar(x.split(), y.split(), share) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")

    groups = linked(rows.where("kind = 1").select("a", "b"), rows.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("node")), firsts.select(F.col("h").alias("node"), "n", *SKETCH), alike(share), confirm)
    several = firsts.join(groups, F.col("h") == F.col("id"), "left").select("h", "first", "last", F.coalesce("component", "h").alias("group"))
    stays = several.groupBy("group").agg(F.min("first").alias("stays"), F.max("last").alias("last")).where("stays < last").drop("last")
    several = materialise(several.select("h", "group").join(stays, "group").select("h", "stays"), "groups")
    gone = found.join(several, "h").where(at != F.col("stays"))
    return gone.groupBy("doc_id", "t").agg(F.collect_set("line").alias("lines"))


def without_repeated_lines(docs: DataFrame, min_words: int = 1, share: float = 0.8, exact: bool = True) -> DataFrame:
    """The rows with their text without repeated lines, plus n_lines and n_removed.

    Null text: null, no lines. Empty text: one empty line, which stays. Rows with null
    doc_id and lines without a letter or digit (fewer than ``min_words`` words) keep
    everything. Rows that repeat a doc_id and text are one document; those with other texts
    are documents of their own. Very long lines are compared whole. Empty table: empty
    result. Columns of ``docs`` named n_lines or n_removed are replaced, all others are kept.
    ``exact``: see repeated_lines.
    """
    docs = docs.drop("n_lines", "n_removed")
    d, t, t2, gone = (free_name(docs, x) for x in ("_d", "_t", "_t2", "_gone"))
    keyed = docs.withColumn(t, F.xxhash64("text"))
    with settings(docs.sparkSession, SMALL_BATCHES):
        found = repeated_lines(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(t).alias("t"), "text"), min_words, share, exact)
    found = found.select(F.col("doc_id").alias(d), F.col("t").alias(t2), F.col("lines").alias(gone))
    rows = keyed.join(found.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(d)) & (F.col(t) == F.col(t2)), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    rows = rows.withColumn("n_removed", F.when(F.col("text").isNull() | F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    return rows.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))).select(*docs.columns, "n_lines", "n_removed")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's number of lines, how many of them are repeats, and the hash of the text without them."""
    out = without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and documents of which no word is left; n_chars follows the text.

    Nulls, empty and long texts, ties and repeated rows as in without_repeated_lines. An
    empty table stays empty, and every column that came in goes on, with its values.
    """
    kept = {c: free_name(docs, f"_own_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    out = without_repeated_lines(docs.withColumnsRenamed(kept)).where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumnsRenamed({v: k for k, v in kept.items()}).select(*docs.columns)
