from datetime import datetime, timedelta

from gneiss.streaming.errors import windowed_errors


def test_stream_equals_batch(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(t + timedelta(minutes=i % 30), i % 3, i % 2, (i // 2) % 2 if i % 7 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp, cluster int, y int, p int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_errors(stream).writeStream.outputMode("complete").format("memory").queryName("errors").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from errors").collect()}
    assert got == {tuple(r) for r in windowed_errors(df).collect()} and sum(r[3] for r in got) == 90
