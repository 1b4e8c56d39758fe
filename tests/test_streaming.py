from weftgraph.streaming.degrees import running_degrees


def test_degrees_follow_the_stream(spark, tmp_path):
    schema = "src long, dst long"
    folder = str(tmp_path / "edges")
    spark.createDataFrame([(0, 1), (0, 2), (1, 1)], schema).write.parquet(folder)
    query = running_degrees(spark.readStream.schema(schema).parquet(folder)).writeStream.format("memory").queryName("deg").outputMode("complete").start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(2, 0), (0, 1)], schema).write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert {r.node_id: r.d for r in spark.table("deg").collect()} == {0: 3, 1: 1, 2: 1}
    finally:
        query.stop()
