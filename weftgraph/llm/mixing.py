"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_name, materialise, n_words

#: Expected copies are counted in units of 2**-SCALE, so that ranks times copies stay exact integers.
SCALE = 24


def source_targets(sources: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """Target of each source, given (source, source_size), one row a source.

    The sources in code point order, null last, have the weights in turn and share the
    sum of all sizes; no target is above ``cap`` times its source, and what is cut off is
    shared again by weight. A source is cut off if its cap per weight is below the level
    that the sources after it in that order would get, so prefix sums over the sources
    sorted by cap per weight give the level at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = sources.withColumn("_k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int")).cast("long")
    table = table.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k").asc())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    table = table.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
    level = F.min(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_k"), F.col("_level").alias("level")))).over(everything)["level"]
    table = table.withColumn("_common", level)
    return table.select("source", "source_size", F.when(F.col("_cap") / F.col("_w") <= F.coalesce(F.col("_common"), F.lit(float("inf"))), F.col("_cap").cast("double")).otherwise(F.col("_common") * F.col("_w")).alias("target"))


def _digits(text, n: int):
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def systematic_mix(docs: DataFrame, size: str = "size", weights=(1, 2, 3), cap: int = 3, seed: str = "mix", chunk_rows: int = 256) -> DataFrame:
    """Adds source_size, target and copies (how often the row is taken) to rows with doc_id, source and ``size``.

    Each row of a source has target / source_size expected copies. Rows of a source are
    put in the order of (bits of the size, chunk, size, doc_id); the running sum of
    expected copies plus one offset of the source is cut at each integer, and a row is
    taken once for each integer it crosses. The order puts sizes next to their like, so
    the words taken stay close to the target.

    A source may hold most of the rows: its rows are dealt to chunks of about
    ``chunk_rows`` by a hash of doc_id, ranked within the chunk, and the chunk's first
    rank comes from a running sum over the chunks.

    Null doc_id or source: kept, null is a source of its own, last. Size 0: copies follow
    the rank like any other, no words are taken. Repeated rows: each is taken for itself.
    Empty table: empty result. Columns named like the added ones are replaced.
    """
    docs = docs.drop("source_size", "target", "copies").withColumn("_bits", F.length(F.bin(size)))
    per_bits = docs.groupBy("source", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    per_bits = per_bits.select(F.col("source").alias("_s"), F.col("_bits").alias("_b"), F.ceil(F.col("_n") / chunk_rows).alias("_chunks"))
    rows = docs.join(per_bits, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bits") == F.col("_b"))).drop("_s", "_b")
    rows = rows.withColumn("_chunk", _digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 8) % F.col("_chunks")).drop("_chunks")

    chunk = rows.groupBy("source", "_bits", "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_size"))
    targets = source_targets(chunk.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, cap)
    running = Window.partitionBy("source").orderBy("_bits", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select("source", "_bits", "_chunk", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    chunk = chunk.join(targets.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    chunk = chunk.withColumn("_step", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * 2**SCALE + 0.5)).otherwise(0).cast("long"))
    chunk = chunk.withColumn("_offset", _digits(F.concat(F.lit(seed + "/"), F.coalesce(F.col("source"), F.lit(""))), SCALE // 4))
    chunk = chunk.withColumnsRenamed({"source": "_s", "_bits": "_b", "_chunk": "_c"})

    rank = F.row_number().over(Window.partitionBy("source", "_bits", "_chunk").orderBy(size, "doc_id")).cast("long")
    rows = rows.withColumn("_rank", rank).join(chunk, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bits") == F.col("_b")) & (F.col("_chunk") == F.col("_c")))
    upto = lambda n: F.shiftright(n * F.col("_step") + F.col("_offset"), SCALE)
    place = F.col("_before") + F.col("_rank")
    rows = rows.withColumn("copies", upto(place) - upto(place - 1))
    return rows.drop("_bits", "_b", "_chunk", "_c", "_s", "_rank", "_before", "_step", "_offset")


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix to the weights 1, 2, 3 takes it.

    Nulls, sizes of 0, ties and repeated rows as in systematic_mix, which gets ids, sources and
    sizes alone; the texts are dealt once, for the copies. Of rows that repeat an id, source
    and text each is taken as often as the others, or once more. An empty table stays empty,
    and every column that came in goes on, with its values.
    """
    key, d, copies, rows, copy = (free_name(docs, x) for x in ("_key", "_doc", "_copies", "_rows", "_copy"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", "text")).withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    sized = keyed.select(F.col(key).alias("k"), F.col(d).alias("d"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = systematic_mix(materialise(sized, "mixing-sizes")).groupBy("k", "d").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0)
    taken = keyed.join(materialise(mixed.withColumnsRenamed({"k": key, "d": d}), "mixed"), [key, d])
    place = F.row_number().over(Window.partitionBy(key, d).orderBy(key))  # as the join has dealt and sorted the rows
    times = F.floor(F.col(copies) / F.col(rows)) + F.when(place <= F.col(copies) % F.col(rows), 1).otherwise(0)
    taken = taken.withColumn(copies, times).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op7_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3 by source; words taken of each."""
    docs = documents(spark, sf_dir)
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mixing-sizes")
    mixed = systematic_mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), bits AS (
  SELECT *, length(bin(size)) AS b FROM sized
), chunked AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
            % ceil(count(*) OVER (PARTITION BY source, b) / 256.0)::BIGINT AS chunk FROM bits
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM src
), capped AS (
  SELECT *, k % 3 + 1 AS w, 3 * source_size AS cap FROM weighed
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM src)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), common AS (
  SELECT level AS common FROM levels WHERE cap / w > level ORDER BY cap / w, k LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap / w <= coalesce((SELECT common FROM common), 'infinity'::DOUBLE) THEN cap::DOUBLE
              ELSE (SELECT common FROM common) * w END AS target
  FROM levels
), stepped AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5) ELSE 0 END::BIGINT AS step,
         ('0x' || substr(md5('mix/' || coalesce(source, '')), 1, 6))::BIGINT AS off
  FROM targets
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, chunk, size, doc_id) AS place FROM chunked
)
SELECT doc_id, size, source_size, target,
       size * (((place * step + off) >> 24) - (((place - 1) * step + off) >> 24)) AS taken
FROM ranked JOIN stepped ON ranked.source IS NOT DISTINCT FROM stepped.source
"""
