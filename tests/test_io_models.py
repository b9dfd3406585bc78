import json
import math

import pytest
from pyspark.sql import functions as F

from veriscope.operators import explain, model, retrieval
from veriscope.sources import readers, writers


def test_json_shapes(spark, tmp_path):
    rows = [{"text": "a", "label": 1}, {"text": "b", "label": 0}]
    shapes = {"array": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows)), "columns": json.dumps({"texts": ["a", "b"], "labels": [1, 0]}), "records": json.dumps({"records": rows}, indent=1)}
    for name, content in shapes.items():
        p = tmp_path / f"{name}.json"
        p.write_text(content)
        assert sorted((r.text, r.label) for r in readers.read_json(spark, str(p)).collect()) == [("a", 1), ("b", 0)], name
    for bad in ("", json.dumps({"texts": ["a"], "labels": []})):
        p = tmp_path / f"bad{len(bad)}.json"
        p.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            readers.read_json(spark, str(p)).collect()
    with pytest.raises(Exception):  # noqa: B017
        readers.require_labelled(spark.createDataFrame([(None, 1)], "text string, label int")).collect()


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Báo cáo ".encode() + b"\xff x")
    (tmp_path / "b.txt").write_bytes(b"  \n")
    (tmp_path / "c.docx").write_bytes(b"PK")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "Báo cáo  x" and got["a.txt"].error is None
    assert got["b.txt"].text is None and got["b.txt"].error and got["c.docx"].error == "unsupported file type"


def test_csv_and_splits(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('﻿id,source,label,text\n1,s,1,"a ""b""\nc"\n2,s,x,y\n3,s,0,z\n', encoding="utf-8")
    assert [(r.label, r.text) for r in readers.read_eval_csv(spark, str(p)).collect()] == [(1, 'a "b"\nc'), (0, "z")]
    df = spark.createDataFrame([("t", "train"), ("v", "val")], "text string, split string")
    writers.write_splits(df, str(tmp_path / "s"))
    assert [r.text for r in writers.read_split(spark, str(tmp_path / "s"), "val").collect()] == ["v"]
    writers.write_report(df, str(tmp_path / "r.json"))
    assert (tmp_path / "r.md").read_text().startswith("| text | split |")


def _frame(spark):
    rows = [(i, ("hóa đơn giả khống doanh thu" if i % 2 else "kiểm kê đầy đủ hàng tồn kho") + f" kỳ{i % 5}", i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id int, text string, label int")


def test_text_model(spark, tmp_path):
    df = _frame(spark)
    m = model.TextModel(vocabulary=100, iterations=50).fit(df, df)
    r = {x.doc_id: x.raw_score for x in m.score(df).collect()}
    assert min(v for k, v in r.items() if k % 2) > max(v for k, v in r.items() if not k % 2)
    m.save(str(tmp_path / "m"))
    again = model.TextModel().load(str(tmp_path / "m"))
    assert again.threshold == m.threshold and model.TextModel().load(str(tmp_path / "m"), 0.9).threshold == 0.9
    assert {x.doc_id: x.raw_score for x in again.score(df).collect()} == r
    out = model.predictions(m.score(df), m.threshold).where("doc_id = 1").first()
    assert out.red_flags == ["hoa_don_gia_hoac_thoi_phong_doanh_thu"] and out.score_breakdown.decision_layer == "rule_based_postprocessing"
    top = m.contributions(df.where("doc_id = 1"), "doc_id").collect()
    assert len(top) == 5 and all(x.contribution > 0 for x in top[:3])


def test_hybrid_head(spark):
    df = _frame(spark).withColumn("raw_score", F.when(F.col("label") == 1, 0.8).otherwise(0.3) + F.col("doc_id") / 1000)
    head = model.HybridHead(["raw_score"]).fit(df)
    got = df.select("label", head.column().alias("s")).groupBy("label").agg(F.avg("s").alias("s")).collect()
    assert {r.label: round(r.s) for r in got} == {0: 0, 1: 1}
    assert df.where("label = 1").select(model.HybridHead(["raw_score"]).fit(df.where("label = 1")).column().alias("s")).first().s is None


def test_registry(spark):
    r = model.Registry(("baseline", "a", "b", "c"))
    with pytest.raises(KeyError):
        r.get("other")
    r.register("baseline", lambda d: d.withColumn("raw_score", F.lit(0.5)))
    got = r.compare(spark.range(2), "id").groupBy("status").count().collect()
    assert {x.status: x["count"] for x in got} == {"ok": 2, "missing": 6}


def test_roll_up(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 10, "a"), (1, 1, 0.8, 30, "b"), (1, 2, 0.8, 5, "c")], "k int, i int, s double, n int, t string")
    assert math.isclose(model.rolled_up(df, "k", "s", "n").first().score, 0.6 * 0.8 + 0.4 * (0.2 * 10 + 0.8 * 35) / 45)
    assert model.best_chunk(df, "k", "s", "i", "t").first().t == "b"


def test_leave_one_out_and_surrogate(spark):
    df = spark.createDataFrame([(1, "x giả y z"), (2, ""), (3, None)], "k int, text string")
    score = lambda d: d.withColumn("raw_score", F.col("text").contains("giả").cast("double"))
    assert explain.leave_one_out(df, "k", score).where("k = 1 and rank = 1").first().term == "giả"
    w = {r.term: r.weight for r in explain.local_surrogate(df, "k", score).collect()}
    assert max(w, key=w.get) == "giả" and set(w) == {"x", "giả", "y", "z"}


def test_cosine_ignores_zero_and_self(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, None), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query"], r.vec_id, r["rank"]) for r in retrieval.cosine_top(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 1).collect()]
    assert sorted(got) == [(0, 1, 1), (20, 1, 1)]
