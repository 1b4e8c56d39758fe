"""Ids that are null, equal or far off: nothing is lost and nothing meets in one task."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, winnowing

DE, EN, FR = "der hund und die katze schlafen nicht im garten", "the dog and the cat are sleeping in the garden", "le chien et le chat ne dorment pas dans le jardin"


@pytest.mark.parametrize("hot", [None, 7])
def test_a_language_of_equal_ids_is_learned(spark, hot):
    rows = spark.range(3000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit(FR + " numéro "), F.col("id") % 500).alias("text"), F.lit("fr").alias("lang"))
    for lang, text, at in (("de", DE, 10_000), ("en", EN, 20_000)):
        rows = rows.unionByName(spark.range(500).select((F.col("id") + at).alias("doc_id"), F.concat(F.lit(text + " "), "id").alias("text"), F.lit(lang).alias("lang")))
    model = langid.fit(rows, 50)
    assert sorted(model.langs) == ["de", "en", "fr"]
    got = langid.identify(spark.createDataFrame([(1, FR), (2, DE), (3, EN)], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "fr", 2: "de", 3: "en"}
    same = spark.range(900).select(F.lit(hot).cast("long").alias("doc_id"), F.lit(FR).alias("text"), F.lit("fr").alias("lang"))
    assert sorted(langid.fit(same.unionByName(rows.where("lang = 'de'")), 50).langs) == ["de", "fr"]


def tables(spark):
    text = F.concat(F.lit("word "), F.col("id"), F.lit(" again"))
    dense = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    far = spark.createDataFrame([(1 << 60, "far"), (-(1 << 61), "below")], "doc_id long, text string")
    equal = spark.range(9000).select(F.lit(777).cast("long").alias("doc_id"), text.alias("text"))
    null = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    return {"dense": dense, "far": dense.unionByName(far), "equal": dense.unionByName(equal), "null": dense.unionByName(null), "all": dense.unionByName(far).unionByName(equal).unionByName(null)}


@pytest.mark.parametrize("kind", ["dense", "far", "equal", "null", "all"])
def test_ranges_are_even(spark, kind):
    docs = tables(spark)[kind]
    rows = winnowing.spans(docs).groupBy("_span").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert rows[2] == docs.count() and rows[0] < 1000 and rows[1] > 60


def test_followers_are_those_of_the_order(spark):
    rows = [(i * i - 50, f"text {i}") for i in range(300)] + [(1 << 60, "far")] + [(7, f"seven {i}") for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(9, "same")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = winnowing.dealt_for_next(docs, 8)
    assert dealt.where("_extra = 0").count() == len(rows)
    assert dealt.where("_extra = 1").count() == dealt.select("_span").distinct().count()
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), hashes[r[1]]))
    from pyspark.sql import Window

    window = Window.partitionBy("_span").orderBy("_extra", F.col("_key").desc(), F.col("_hash").desc())
    got = dealt.withColumn("after", F.lead("text").over(window)).where("_extra = 0").select("text", "after").collect()
    want = [(a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)
