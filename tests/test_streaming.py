from __future__ import annotations

from keyloom.streaming.selections import select_stream


def test_stream_is_selected_like_a_table(spark, tmp_path):
    rows = [(i, [i, i + 1, i + 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, a array<int>")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = select_stream(stream, "k a[2]", "k 2 4 k 8 8 a[1] 3 9", dimensions={"a": 3})
    q = out.writeStream.format("memory").queryName("selected").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r[0], r[1]) for r in spark.table("selected").collect()) == [(3, [4]), (4, [5]), (8, [9])]
