import datetime

import pytest
from pyspark.sql import functions as F

from veriscope.operators import prep


def test_first_of_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 4), (5, "", 5)], "sample_id int, text string, _k int")
    assert sorted(r.sample_id for r in prep.first_of_duplicates(df).collect()) == [1, 3, 5]


def test_time_marks(spark):
    rows = [("2024-03-31", None), ("31/12/2023", None), ("Q3 2022", None), ("quý 4 năm 2021", None), ("2019", None), ("1999", None), ("2099", "2020.05.07"), ("", ""), (None, "2024_1_31")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, collected_at string, text string")
    got = {r.i: (r.mark.date, r.mark.source) for r in prep.time_mark(df, "2026-01-01").collect()}
    d = datetime.date
    assert got == {0: (d(2024, 3, 28), "collected_at"), 1: (d(2023, 12, 28), "collected_at"), 2: (d(2022, 9, 28), "collected_at:quarter"), 3: (d(2021, 12, 28), "collected_at:quarter"), 4: (d(2019, 12, 28), "collected_at:year"), 5: (d(1900, 1, 1), "unknown"), 6: (d(2020, 5, 7), "text"), 7: (d(1900, 1, 1), "unknown"), 8: (d(2024, 1, 28), "text")}


def test_position_and_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    got = {r.v: r.position for r in prep.with_position(df, ["v"]).collect()}
    assert got == {i: i for i in range(1000)}
    sizes = {r.split: r["count"] for r in prep.temporal_split(df, ["v"]).groupBy("split").count().collect()}
    assert sizes == {"train": 800, "val": 100, "test": 100}
    assert prep.split_sizes(3) == (1, 1, 1)
    lab = df.withColumn("label", F.col("id") % 3)
    parts = prep.stratified_split(lab, "label", F.md5(F.col("id").cast("string")), {"train": 0.7, "dev": 0.15, "test": 0.15})
    assert parts.count() == 1000
    for r in parts.groupBy("label", "split").count().collect():
        assert abs(r["count"] - {"train": 0.7}.get(r.split, 0.15) * 333.3) <= 1.5


def test_folds(spark):
    folds = prep.expanding_folds(spark.range(100), ["id"], 3)
    assert {(r.fold, r.role): r["count"] for r in folds.groupBy("fold", "role").count().collect()} == {(1, "train"): 50, (1, "val"): 12, (2, "train"): 62, (2, "val"): 12, (3, "train"): 74, (3, "val"): 12}
    with pytest.raises(ValueError):
        prep.expanding_folds(spark.range(5), ["id"], 3)


def test_blocks_equal_whole_windows(spark):
    from pyspark.sql.window import Window

    from veriscope.operators import drift

    df = spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 < 5, "hot").when(F.col("id") % 7 == 5, "m").alias("model"), (F.col("id") * 7919 % 1000 / 1000.0).alias("fraud_prob"))
    got = drift.rolling(df, ["model"], ["event_id"], size=20, block=32)
    w = Window.partitionBy("model").orderBy("event_id").rowsBetween(-19, 0)
    want = df.withColumns({"window_n": F.count("fraud_prob").over(w), "window_mean": F.avg("fraud_prob").over(w), "window_max": F.max("fraud_prob").over(w)})
    key = lambda d: {r.event_id: (r.window_n, round(r.window_mean, 9), r.window_max) for r in d.collect()}
    assert key(got) == key(want)
    texts = df.select("event_id", "model", F.concat_ws(" ", F.lit("chung"), (F.col("event_id") % 5).cast("string"), F.lit("từ"), (F.col("event_id") % 3 + 20).cast("string")).alias("text"))
    assert {r.event_id: r.drift_score for r in drift.term_drift(texts, "model", ["event_id"], block=8).collect()} == {r.event_id: r.drift_score for r in drift.term_drift(texts, "model", ["event_id"]).collect()}
