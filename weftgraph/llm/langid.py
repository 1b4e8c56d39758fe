"""Language identification: the family first, then linear support vector machines for pairs within it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SMALL_BATCHES, bucket, chunks, documents, free_name, materialise

#: Families of languages by ISO 639-1 code. A learned language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn ur mr ne pa gu",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id ms tl",
}
BUCKETS = 4096


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members.split()), f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: square roots of hashed counts of its characters, pairs and triples, of length 1.

    Whole texts, lower-cased; each is closed with a space on both sides.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 3
    code = np.frombuffer("".join(f" {t}  " for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.zeros((0, BUCKETS), np.float32)
    code = code * np.uint32(2654435761)
    two = (code[:-1] ^ (code[1:] >> np.uint32(7)) ^ (code[1:] << np.uint32(11))) * np.uint32(2246822519)
    three = (two[:-1] ^ (code[2:] >> np.uint32(5)) ^ (code[2:] << np.uint32(9))) * np.uint32(3266489917)
    grams = [(g >> np.uint32(20)).astype(np.int64) for g in (code, two, three)]
    out = np.empty((len(texts), BUCKETS), np.float32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        out[i] = sum(np.bincount(g[a : b - n], minlength=BUCKETS) for n, g in enumerate(grams))
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss for labels y of -1 and 1, by dual coordinate descent; the last column of x is 1, for the bias."""
    w, alpha, diag = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x, dtype=np.float64) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


class Model:
    """Family machines (one against the rest) and pair machines (one against one within a family)."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = [[k for k, x in enumerate(self.langs) if family(x) == f] for f in self.families]
        y = np.array([self.langs.index(x) for x in langs])
        of = np.array([self.families.index(family(x)) for x in langs])
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        machines: list[np.ndarray] = []
        if len(self.families) > 1:
            machines += [fit_svm(x, np.where(of == k, 1.0, -1.0)) for k in range(len(self.families))]
        self.pairs = []
        for members in self.members:
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    rows = (y == a) | (y == b)
                    self.pairs.append((a, b, len(machines)))
                    machines.append(fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0)))
        self.w = np.array(machines, np.float32).reshape(len(machines), x.shape[1])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``langs`` and scores. Ties go to the first family and the first language."""
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        squash = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -9, 9)))
        best, score = np.zeros(len(x), int), np.ones(len(x))
        if len(self.families) > 1:
            fam = margin[:, : len(self.families)]
            best, score = fam.argmax(1), squash(fam.max(1)).astype(float)
        out = np.zeros(len(x), int)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            votes, worst = np.zeros((len(rows), len(self.langs))), np.full((len(rows), len(self.langs)), np.inf)
            for a, b, m in self.pairs:
                if a in members:
                    d = margin[rows, m]
                    votes[:, a] += (d >= 0) + 1e-3 * squash(d)
                    votes[:, b] += (d < 0) + 1e-3 * squash(-d)
                    worst[:, a], worst[:, b] = np.minimum(worst[:, a], d), np.minimum(worst[:, b], -d)
            votes[:, members] += 1e-9
            out[rows] = votes.argmax(1)
            w = worst[np.arange(len(rows)), out[rows]]
            score[rows] *= np.where(np.isinf(w), 1.0, squash(np.where(np.isinf(w), 0, w)))
        return out, score


def fit(labelled: DataFrame, per_language: int = 400) -> Model | None:
    """Fits on at most ``per_language`` rows of each lang of ``labelled`` (doc_id, text, lang), chosen by a hash of the row.

    That bound is the only sample, and what reaches the driver is so many vectors for each
    language that the labels name. Rows without lang, or whose text is null or has no
    letter, aren't learned from. Every language that labels name is learned, from ``per_language`` rows or all that it has, also if its rows
    share an id or have none: id and text draw together, and rows that are equal are drawn one by one. None if nothing is left.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "text", "lang", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("_u"))
    least = Window.partitionBy("lang").orderBy("_u")  # Spark keeps so many of each task before it ranks them
    drawn = rows.select("lang", "_u").withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= per_language)
    last = materialise(drawn.groupBy("lang").agg(F.max("_u").alias("_last")), "languages")  # once written, Spark knows how few they are
    rows = rows.join(last, "lang").where(F.col("_u") <= F.col("_last"))
    rows = rows.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= per_language)

    def vectors(batches):
        for batch in batches:
            x = features(batch.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["lang", "x"])

    found = rows.select("lang", "text").mapInArrow(vectors, "lang string, x binary").orderBy("lang", "x").collect()
    if not found:
        return None
    return Model(np.array([np.frombuffer(r.x, np.float16) for r in found]).astype(np.float32), [r.lang for r in found])


def identify(docs: DataFrame, model: Model | None, with_text: bool = True) -> DataFrame:
    """Adds lang_pred and score to rows with a text, which goes unless ``with_text``.

    ``und`` with score 0.0 where the text is null or has no letter, or nothing was
    learned. Whole texts count, of any length; equal texts get equal results. Repeated
    rows are kept, an empty table gives an empty one, and columns that are named like the
    added ones are replaced. Nothing but the text is used.
    """
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most pairs of languages x 4097 weights
    names = [c for c in docs.columns if with_text or c != "text"]
    schema = StructType(list(docs.select(*names).schema.fields)).add("lang_pred", "string").add("score", "double")

    def predict(batches):
        m = shared.value
        for batch in chunks(batches, "text", 1_000_000):
            text = batch.column(batch.schema.get_field_index("text"))
            langs, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(letters)
            for part in np.array_split(rows, max(1, -(-len(rows) // 256))) if m is not None and len(rows) else []:
                best, score = m.predict(features(text.take(pa.array(part))))
                langs[part], scores[part] = np.array(m.langs, object)[best], score
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; documents in the third of four hash classes are held out of learning."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(bucket(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, with_text=False)


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents whose language can't be told (no text, or no letter in it).

    Null langs and ids, repeated rows and very long texts are predicted like any other; an
    empty table stays empty, and every column that came in goes on, with its values. The session
    keeps SMALL_BATCHES, as the rows are read when it has returned.
    """
    for key, value in SMALL_BATCHES.items():
        spark.conf.set(key, value)
    own = {c: free_name(docs, f"_own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    kept = identify(docs.withColumnsRenamed(own), fit(docs)).where("lang_pred <> 'und'").drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
