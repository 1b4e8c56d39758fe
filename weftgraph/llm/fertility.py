"""Quality rules from tokeniser fertility: how public vocabularies break a text up."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, split_words

_LATIN = {"piece_chars": (1.2, 8.0), "byte_chars": (1.45, 8.0), "byte_share": (0.0, 0.25), "entropy": (0.25, 1.0)}
#: Bands by language or script: characters per token of either vocabulary, share of byte-fallback tokens, and token
#: entropy in bits divided by log2 of the number of tokens. A language's bands go before its script's.
BANDS = {
    "latin": _LATIN,
    "en": _LATIN | {"byte_chars": (1.85, 8.0)},
    "de": _LATIN | {"byte_chars": (1.85, 8.0)},
    "fr": _LATIN | {"byte_chars": (1.72, 8.0)},
    "es": _LATIN | {"byte_chars": (1.72, 8.0)},
    "cyrillic": {"piece_chars": (1.0, 8.0), "byte_chars": (0.5, 8.0), "byte_share": (0.0, 0.25), "entropy": (0.25, 1.0)},
    "other": {"piece_chars": (0.2, 8.0), "byte_chars": (0.2, 8.0), "byte_share": (0.0, 0.98), "entropy": (0.25, 1.0)},
}
SCRIPTS = ("latin", "cyrillic", "other")
MEASURES = ("piece_chars", "byte_chars", "byte_share", "entropy")
_CACHED = 600_000


class Pieces:
    """Token ids of words, remembered up to a bound; one for each Python worker."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self.model = sentencepiece.SentencePieceProcessor(model_file=place("piece_bpe_32k.model"))
        with open(place("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[str, tuple[np.ndarray, int]] = {}

    def __call__(self, words: list[str]) -> list[tuple[np.ndarray, int]]:
        """For each word: its ids in the piece vocabulary, and its number of tokens in the byte vocabulary."""
        if len(self.known) > _CACHED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            ids = self.model.encode(new, num_threads=1)
            for w, i in zip(new, ids, strict=True):
                self.known[w] = (np.array(i, np.int32), len(self.bpe.encode_ordinary(" " + w)))
        return [self.known[w] for w in words]


_pieces: dict = {}


def pieces(folder: str | None) -> Pieces:
    if folder not in _pieces:
        _pieces[folder] = Pieces(folder)
    return _pieces[folder]


def _repeat_words(codes: np.ndarray, bits: int = 21) -> int:
    """Words in 3-word windows that are found twice or more. Three codes of ``bits`` are one number; larger codes are numbered by pairs first."""
    if len(codes) < 4:
        return 0
    if int(codes.max()) >> bits:
        size = int(codes.max()) + 1
        key = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)[1] * size + codes[2:]
    else:
        key = (codes[:-2] << 2 * bits) | (codes[1:-1] << bits) | codes[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(codes), bool)
    for j in range(3):
        covered[at + j] = True
    return int(covered.sum())


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _script(words: pa.Array, starts: np.ndarray, codes: np.ndarray) -> list[str]:
    count = lambda p: pc.count_substring_regex(words, p).to_numpy(zero_copy_only=False)
    per_word = np.stack([count(r"\p{Latin}"), count(r"\p{Cyrillic}"), count(r"\p{L}")]).astype(np.int64) if len(words) else np.zeros((3, 0), np.int64)
    total = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(per_word[:, codes], axis=1)], axis=1)
    latin, cyrillic, letters = total[:, starts[1:]] - total[:, starts[:-1]]
    return list(np.where(letters <= 2 * latin, "latin", np.where(letters <= 2 * cyrillic, "cyrillic", "other")))


def measure(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, lang, script and the counts and fertility measures of each row's whole text.

    Null and empty texts have no words: counts 0, measures null. Repeated rows are each
    measured. Very long texts are measured whole, one row at a time. An empty table gives
    an empty one. Other columns are ignored.
    """
    fields = {"doc_id": "long", "lang": "string", "script": "string"}
    fields |= dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "piece_tokens", "byte_tokens"), "long")
    fields |= dict.fromkeys(MEASURES, "double")

    def run(batches):
        get = pieces(folder)
        for batch in chunks(batches, "text"):
            text = batch.column(1)
            codes, starts, vocab = split_words(text)
            codes = codes.astype(np.int64)
            words = vocab.to_pylist()
            found = get(words)
            n_piece, n_byte = (np.array([len(x[0]) for x in found], np.int64), np.array([x[1] for x in found], np.int64))
            begin = np.concatenate([[0], np.cumsum(n_piece)])
            flat = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int32)
            of_word = lambda v: (lambda t: t[starts[1:]] - t[starts[:-1]])(np.concatenate([[0], np.cumsum(v[codes])]))
            chars = of_word(pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64))
            symbols = of_word(pc.count_substring_regex(vocab, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64))
            tokens, byte_tokens = of_word(n_piece), of_word(n_byte)
            fallback = of_word(np.array([get.is_byte[x[0]].sum() for x in found], np.int64))
            entropy = np.zeros(batch.num_rows)
            repeated, dup = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(text.to_pylist()):
                own = codes[starts[i] : starts[i + 1]]
                if not len(own):
                    continue
                n = n_piece[own]
                stops = np.cumsum(n)
                ids = flat[np.repeat(begin[own] - (stops - n), n) + np.arange(stops[-1])]
                p = np.bincount(ids)
                p = p[p > 0] / len(ids)
                entropy[i] = -(p * np.log2(p)).sum() / np.log2(len(ids)) if len(ids) > 1 else 1.0
                repeated[i], dup[i] = _repeat_words(own), _dup_lines(t)
            none = tokens == 0
            ratio = lambda a, b: pa.array(a / np.maximum(b, 1), mask=none)
            n_words = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(_script(vocab, starts, codes)), *map(pa.array, (n_words, chars, symbols, dup, repeated, tokens, byte_tokens)),
                 ratio(chars, tokens), ratio(chars, byte_tokens), ratio(fallback, tokens), pa.array(entropy, mask=none)],
                list(fields),
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).mapInArrow(run, ", ".join(map(" ".join, fields.items())))


def verdict(measured: DataFrame, bands: dict | None = None) -> DataFrame:
    """Adds rejected: the measures outside the band of the row's language, else of its script, as an array of names."""
    bands = bands or BANDS
    outside = []
    for name in MEASURES:
        low = high = F.lit(None).cast("double")
        for key in sorted(bands, key=lambda k: k not in SCRIPTS):  # scripts first, so that languages go before them
            is_it = (F.col("script") == key) if key in SCRIPTS else (F.col("lang") == key)
            low, high = (F.when(is_it, F.lit(bands[key][name][j])).otherwise(x) for j, x in ((0, low), (1, high)))
        outside.append(F.when((F.col(name) < low) | (F.col(name) > high), F.lit(name)))
    return measured.withColumn("rejected", F.array_compact(F.array(*outside)))


def op5_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the fertility verdict for those that pass them."""
    rows = verdict(measure(documents(spark, sf_dir)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.size("rejected") == 0)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"),
        "script", "piece_tokens", "byte_tokens", *MEASURES, F.array_join("rejected", ",").alias("rejected"),
    )
