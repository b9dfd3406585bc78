import datetime

from veriscope.streaming import monitor

T0 = datetime.datetime(2024, 1, 1)


def _events(spark, path, n):
    rows = [(i, "m", T0 + datetime.timedelta(minutes=i), 0.05 if i < n // 2 else 0.95) for i in range(n)]
    df = spark.createDataFrame([*rows, rows[0]], "event_id long, model string, ts timestamp, fraud_prob double")
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_windowed_drift(spark, tmp_path):
    q = monitor.windowed_drift(_events(spark, str(tmp_path / "in"), 60)).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("windowed").first()
    assert r.events == 60 and r.level == "critical"


def test_last_events(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = monitor.last_events(_events(spark, str(tmp_path / "in"), 301), 200).writeStream.format("memory").queryName("last").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("last").collect()[-1]
    assert r.events == 200 and abs(r.mean_prob - (49 * 0.05 + 151 * 0.95) / 200) < 0.01 and r.level == "critical"
