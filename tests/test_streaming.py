from scorefold.streaming import seen


def test_keys_are_let_through_once_over_all_batches(spark, tmp_path):
    for n, ids in enumerate([[1, 2, 2, None], [2, 3, 1, None], [4]]):
        spark.createDataFrame([(i, f"b{n}") for i in ids], "id long, batch string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, batch string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = seen.unseen(stream.select("id"), ["id"]).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination(120)
    assert sorted((r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda i: (i is None, i)) == [1, 2, 3, 4, None]
