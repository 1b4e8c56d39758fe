"""Document fingerprints by winnowing, with DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

_POS = (1 << 31) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5) -> DataFrame:
    """Adds ``out``: the winnowed fingerprint of ``text`` as an array of longs, in order of position.

    Every run of k words is hashed to 32 bits. In each window of 8 consecutive hashes the
    smallest is chosen, of equal ones the rightmost, and kept with its position: an
    element is hash * 2**31 + (2**31 - 1 - position), so the smallest element of a window
    is the choice. Two texts that share 8 + k - 1 = 12 consecutive words share an element's
    hash. Texts of fewer than k words have one hash of all words; without words (null or
    empty text) the fingerprint is empty. Fewer than 8 hashes are one window.
    """
    words, packed = f"_{out}_words", f"_{out}_v"
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    gram = ", ".join(f"element_at({words}, i + {j})" for j in range(1, k + 1))
    pack = f"shiftleft(shiftrightunsigned(h, 32), 31) + ({_POS} - i)"
    df = df.withColumn(
        packed,
        F.expr(
            f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> {pack.replace('(h,', f'(xxhash64({gram}),')})"
            f" WHEN size({words}) > 0 THEN array(shiftleft(shiftrightunsigned(xxhash64(concat_ws(' ', {words})), 32), 31) + {_POS})"
            f" ELSE cast(array() AS array<bigint>) END"
        ),
    )
    for step in (1, 2, 4):  # minimum of 2, 4 and 8 neighbours; an array that is too short keeps its minimum
        v = packed
        packed = f"_{out}_m{step}"
        df = df.withColumn(packed, F.expr(f"CASE WHEN size({v}) > {step} THEN transform(sequence(0, size({v}) - 1 - {step}), i -> least({v}[i], {v}[i + {step}])) WHEN size({v}) > 0 THEN array(array_min({v})) ELSE {v} END"))
    df = df.withColumn(out, F.array_distinct(packed))
    return df.drop(words, f"_{out}_v", *(f"_{out}_m{s}" for s in (1, 2, 4)))


def hashes(fingerprint: str):
    """The distinct hashes of a fingerprint column."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def as_text(fingerprint: str):
    """hash:position, in order of position."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(_POS) - x.bitwiseAND(F.lit(_POS))).cast("string"))), " ")


def likeness(a: str, b: str):
    """Jaccard similarity of two columns of distinct hashes; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def spans(docs: DataFrame, span: int = 256, most: int = 1024) -> DataFrame:
    """Deals rows (doc_id, text) into ranges of their order: adds _key, _hash and _span.

    The order is by _key (doc_id, null below all) and then against _hash (of the text, complemented). Quantiles of the ids, ``most``
    at most, part them; an id that is a quantile is a part of its own, and so is null. A part of one id is divided evenly by _hash, others by
    _key, into ranges of ``span`` rows on average. So no range has many more than n / ``most`` rows, wherever single ids lie.
    """
    low, n = docs.agg(F.min("doc_id"), F.count(F.lit(1))).first()
    below = max(int(low) - 1, -(1 << 63)) if low is not None else -1
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(below).cast("long"))).withColumn("_hash", F.bitwise_not(F.xxhash64("text")))
    parts = min(most, -(-n // span))
    marks = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    marks = F.from_json(F.lit(json.dumps(sorted({float(m) for m in marks or []}))), "array<double>")  # quantiles are doubles, so ids are compared as such
    key = F.col("_key").cast("double")
    part = 2 * F.size(F.filter(marks, lambda m: m < key)) + F.array_contains(marks, key).cast("int")
    docs = docs.withColumn("_part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part).cast("long"))
    ends = docs.groupBy("_part").agg(*(f(c).alias(f"_{n}{c}") for c in ("_key", "_hash") for n, f in (("low", F.min), ("high", F.max))), F.count(F.lit(1)).alias("_n"))
    ends = materialise(ends, "parts").withColumnRenamed("_part", "_p")  # two rows for each quantile at most, as Spark sees once it is written
    one = F.col("_low_key") == F.col("_high_key")
    at, low, high = (F.when(one, F.col(h)).otherwise(F.col(k)).cast("double") for h, k in (("_hash", "_key"), ("_low_hash", "_low_key"), ("_high_hash", "_high_key")))
    docs = docs.join(ends, F.col("_part") == F.col("_p"))
    number = F.floor((at - low) / F.greatest((high - low + 1) * span / F.col("_n"), F.lit(1.0))).cast("long")
    return docs.withColumn("_span", F.col("_part") * (1 << 40) + number).drop("_part", "_p", "_low_key", "_high_key", "_low_hash", "_high_hash", "_n")


def dealt_for_next(docs: DataFrame, span: int = 256) -> DataFrame:
    """Deals rows so that a window over _span (by _extra, then _key and _hash descending) sees each row's follower.

    The follower is the row with the next smaller doc_id; after the last comes the first.
    Rows are dealt by ``spans``; the first row of each range is also sent to the range above it that isn't
    empty, once. Equal ids are ordered by their text's hash. Null ids count as the smallest.
    """
    docs = spans(docs, span)
    heads = docs.groupBy("_span").agg(F.max(F.struct("_key", "_hash")).alias("_head")).withColumn("_group", F.floor(F.col("_span") / 4096))
    groups = heads.groupBy("_group").agg(F.max("_head").alias("_first"))
    everything = Window.orderBy(F.col("_group").desc())
    groups = groups.select(F.col("_group").alias("_g"), F.coalesce(F.lead("_first").over(everything), F.max("_first").over(Window.partitionBy(F.lit(1)))).alias("_after"))
    heads = heads.withColumn("_lead", F.lead("_head").over(Window.partitionBy("_group").orderBy(F.col("_span").desc())))
    wanted = heads.join(groups, F.col("_group") == F.col("_g")).select(F.col("_span").alias("_to"), F.coalesce("_lead", "_after").alias("_want"))
    wanted = wanted.select("_to", F.col("_want._key").alias("_k"), F.col("_want._hash").alias("_h"))
    wanted = materialise(wanted, "heads")  # a row for each span: once it is written, Spark knows its size and needn't shuffle the texts for it
    copies = docs.join(wanted, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h")))
    copies = copies.groupBy("_to").agg(*(F.first(c).alias(c) for c in docs.columns if c != "_span")).withColumnRenamed("_to", "_span")
    return docs.withColumn("_extra", F.lit(0)).unionByName(copies.withColumn("_extra", F.lit(1)))


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses."""
    return fingerprint_pairs(documents(spark, sf_dir))


def fingerprint_pairs(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    Null text: empty, with an empty fingerprint, and alike (1.0) to another empty one.
    Repeated rows and ids: each row has its own result, ordered by doc_id and text hash.
    A table of one row: its next document is itself. Empty table: empty result. Other
    columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = dealt_for_next(docs)
    rows = with_fingerprint(rows, "text", "_fp", k)
    order = Window.partitionBy("_span").orderBy("_extra", F.col("_key").desc(), F.col("_hash").desc())
    following = F.lead(F.struct("text", "_fp")).over(order)
    rows = rows.withColumn("_next", following).where("_extra = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "_fp", "_edited", F.col("_next._fp").alias("_next_fp"))
    rows = with_fingerprint(rows, "_edited", "_efp", k)
    rows = rows.select("doc_id", "n_chars", "_edited", "_fp", "_efp", *(hashes(x).alias(y) for x, y in (("_fp", "_hashes"), ("_efp", "_ehashes"), ("_next_fp", "_next_hashes"))))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("_fp").alias("fingerprint"),
        as_text("_efp").alias("edited_fingerprint"),
        likeness("_hashes", "_ehashes").alias("near_edited"),
        likeness("_hashes", "_next_hashes").alias("near_next"),
    )
