import json

from pyspark.sql import functions as F

from veriscope import cli, serving
from veriscope.operators import datasets, model, tuning


def _records():
    return [{"text": ("Công ty lập hóa đơn giả và doanh thu khống" if i % 2 else "Kiểm kê hàng tồn kho đầy đủ") + f" quý {i % 4 + 1} năm {2019 + i % 5}", "label": i % 2, "source": "s" if i % 3 else None} for i in range(80)]


def test_canonical_records(spark):
    df = spark.createDataFrame([(1, "doanh thu khống", "1", None), (2, None, None, "X1")], "n int, text string, label string, id string")
    r = datasets.canonical_m1(df, "n").orderBy("label").collect()
    assert (r[0].id, r[0].label, r[0].risk_level, r[0].standard_ref) == ("X1", "BINH_THUONG", "THAP", [])
    assert (r[1].id, r[1].label_int, r[1].risk_level, r[1].standard_ref) == ("AV-0001", 1, "TRUNG_BINH", ["VAS 14"])
    m3 = datasets.canonical_m3(spark.createDataFrame([(1, "co the giam", 0, 2020, "C"), (2, "co the tang", 2, 2021, "C")], "n int, text string, risk_label_int int, year int, company_id string"), "n").orderBy("year").collect()
    assert [x.risk_label for x in m3] == ["LOW_RISK", "HIGH_RISK"] and m3[0].drift_score == 0 and 0 < m3[1].drift_score <= 1
    assert {s.span for s in m3[0].signals} == {"co the"}


def test_build(spark, tmp_path):
    df = spark.createDataFrame([(i, r["text"], r["label"]) for i, r in enumerate(_records())], "n int, text string, label int")
    m = datasets.build(spark, df, "n", str(tmp_path))
    assert sum(s["records"] for s in m["splits"]) == 80 and "reranker_pairs" in m["sets"]
    assert spark.read.parquet(str(tmp_path / "reranker_pairs")).groupBy("label").count().orderBy("label").collect()[0]["count"] == 240


def test_cli_and_serving(spark, tmp_path, capsys):
    data = tmp_path / "d.json"
    data.write_text(json.dumps({"records": _records()}, ensure_ascii=False), encoding="utf-8")
    cli.main(["governance", "--dataset", str(data)])
    assert json.loads(capsys.readouterr().out)[0]["total"] == 80
    cli.main(["train", "--dataset", str(data), "--out", str(tmp_path / "m")])
    assert json.loads(capsys.readouterr().out)[0]["f1"] is not None
    cli.main(["demo", "--model", str(tmp_path / "m")])
    assert len(json.loads(capsys.readouterr().out)) == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hóa đơn giả", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text(" ", encoding="utf-8")
    cli.main(["score", "--folder", str(tmp_path / "in"), "--model", str(tmp_path / "m"), "--out", str(tmp_path / "o")])
    s = json.loads(capsys.readouterr().out)[0]
    assert (s["documents"], s["failed"]) == (2, 1)
    reg = model.Registry(("baseline", "encoder"))
    reg.register("baseline", lambda d: d.withColumn("raw_score", F.lit(0.4)))
    out = serving.analyze(spark.createDataFrame([(1, "x"), (2, "")], "id int, text string"), reg).orderBy("id").collect()
    assert out[0].label_int == 0 and out[1].error and serving.health(spark, reg)["models"] == {"baseline": True, "encoder": False}
    events = serving.prediction_events(serving.analyze(spark.createDataFrame([(i, "x") for i in range(12)], "id int, text string"), reg), "id", "baseline")
    assert serving.drift_status(events).first().level == "critical"


def test_tuning(spark):
    df = spark.createDataFrame([(i, r["text"], r["label"]) for i, r in enumerate(_records())], "n int, text string, label int")
    got = tuning.search(df, ["n"], {"c": (1.0,), "vocabulary": (50, 100)}, folds=2, iterations=5)
    assert len(got) == 2 and got[0]["score"] >= got[1]["score"]
