"""Window counts: the same function on a table and on a stream."""

from datetime import datetime, timedelta

from chartstone.streaming.ingest import windowed_counts

SCHEMA = "ts timestamp, kind string"
START = datetime(2024, 1, 1)


def test_stream_equals_table(spark, tmp_path):
    rows = [(START + timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_counts(df, "ts", "kind").collect()), key=str)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect()), key=str) == want
    assert sum(r[2] for r in want) == 40
