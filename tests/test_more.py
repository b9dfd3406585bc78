import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from veriscope.functions import features, rules
from veriscope.functions import text as tx
from veriscope.operators import drift, explain, metrics, model, retrieval
from veriscope.sources import readers, writers


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ("Doanh thu tăng mạnh nhưng dòng tiền âm.", ["doanh_thu_khong_di_kem_dong_tien"]), ("DOANH THU TĂNG NHƯNG LỢI NHUẬN GIẢM", ["doanh_thu_tang_nhung_loi_nhuan_giam"]),
        ("ghi nhận doanh thu  khống", ["hoa_don_gia_hoac_thoi_phong_doanh_thu"]), ("Off-balance sheet financing", ["che_giau_no_phai_tra"]), ("khoản ngoài bảng cân đối bị che giấu", ["che_giau_no_phai_tra"]),
        ("giao dịch với bên liên quan", ["dau_hieu_quan_tri_rui_ro"]), ("phát sinh vào cuối niên độ kế toán", ["window_dressing_cuoi_ky"]), ("không có gì", []), ("", []), (None, None),
    ],
)
def test_default_rules(spark, text, flags):
    df = spark.createDataFrame([(text,)], "text string").withColumn("f", rules.red_flags(tx.fold(F.col("text"))))
    assert (df.first().f or None) == (flags or None)


def test_segments_of_default_rules(spark):
    df = spark.createDataFrame([("Kho đủ hàng. Có hóa đơn giả. Bên liên quan mua.",)], "text string")
    got = df.select(rules.suspicious_segments(F.col("text")).alias("s")).first().s
    assert [(x.snippet, x.flags) for x in got] == [("Có hóa đơn giả.", "hoa_don_gia_hoac_thoi_phong_doanh_thu"), ("Bên liên quan mua.", "dau_hieu_quan_tri_rui_ro")]


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],), (None,)], "t array<string>").select(tx.counted(F.col("t")).alias("c"))
    assert [None if r.c is None else [(x.term, x.tf) for x in r.c] for r in df.collect()] == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)], None]


def test_tfidf_of_repeated_keys_and_bm25_ways(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (2, ""), (3, "b c")], "k int, t string")
    got = {(r.k, r.term): r.tf for r in model.tfidf(df, "k", tx.word_tokens(F.col("t"))).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (3, "b"): 1, (3, "c"): 1}
    q = spark.createDataFrame([(7, "b c c"), (8, "zz"), (9, "")], "q int, x string")
    run = lambda: sorted(map(tuple, retrieval.bm25(q, df.where("k <> 1"), "q", "k", tx.word_tokens(F.col("x")), tx.word_tokens(F.col("t"))).collect()))
    one = run()
    monkeypatch.setattr(retrieval, "ROW_TERMS", 0)
    assert one == run() and [(r[0], r[1]) for r in one] == [(7, 3)]


def test_docx_and_ingest(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Công ty có </w:t></w:r><w:r><w:t>hóa đơn giả</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", xml)
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.docx").write_bytes(made.getvalue())
    (folder / "b.docx").write_bytes(b"broken")
    (folder / "c.txt").write_text("Báo cáo kiểm toán đầy đủ", encoding="utf-8")
    (folder / "d.txt").write_text("  ")
    (folder / "e.bin").write_bytes(b"x")
    assert readers.docx_text(made.getvalue()) == "Công ty có hóa đơn giả\na | 1"
    out = str(tmp_path / "out")
    got = {(r.source_type, r.suggested_review): r.files for r in readers.ingest(spark, str(tmp_path / "in"), out).collect()}
    assert got == {("docx", True): 1, ("docx", None): 1, ("txt", False): 1, ("txt", None): 1}
    assert spark.read.json(f"{out}/errors").count() == 2
    done = spark.read.parquet(f"{out}/parsed").select("path").union(spark.read.json(f"{out}/errors").select("path"))
    assert readers.ingest(spark, str(tmp_path / "in"), out, done).count() == 0


def test_json_errors_name_the_record(spark, tmp_path):
    df = spark.createDataFrame([("x", 1, 0), ("y", None, 7)], "text string, label int, row int")
    with pytest.raises(Exception, match="record 7 lacks"):
        readers.require_labelled(df, "row").collect()
    (tmp_path / "o.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(Exception, match="without text"):
        readers.read_json(spark, str(tmp_path / "o.json")).collect()


def test_split_cache(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("a", "train"), ("b", "val")], "text string, split string")

    for _ in range(2):
        assert writers.cached_splits(spark, str(tmp_path), "m", "/x/d.json", make).count() == 2
    assert len(calls) == 1 and writers.split_cache("m", "/x/d.json") != writers.split_cache("m", "/y/d.json")


def test_baseline_store_and_simulator(spark, tmp_path):
    path = str(tmp_path / "b")
    assert drift.load_baseline(spark, path)[0] == drift.lx.BASELINE_BINS
    drift.save_baseline(spark, path, [0.1] * 10, {"f2": 0.5})
    shares, known = drift.load_baseline(spark, path)
    assert shares == [0.1] * 10 and known["f2"] == 0.5 and known["recall"] == drift.lx.BASELINE_METRICS["recall"]
    drift.save_baseline(spark, path, [0.5, 0.5], {})
    assert drift.load_baseline(spark, path)[0] == drift.lx.BASELINE_BINS
    x = drift.simulated(spark, 4000, 2000)
    means = [r.m for r in x.groupBy(F.floor(F.col("event_id") / 2000).alias("h")).agg(F.avg("fraud_prob").alias("m")).orderBy("h").collect()]
    assert abs(means[0] - 0.25) < 0.02 and abs(means[1] - 0.5) < 0.02
    assert x.exceptAll(drift.simulated(spark, 4000, 2000).repartition(3)).count() == 0


def test_late_label_wins(spark):
    events = spark.createDataFrame([(1, None), (2, 0), (3, None)], "event_id int, true_label int")
    truth = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 1, 5), (9, 1, 1), (3, None, 9)], "event_id int, true_label int, labelled_at int")
    assert {r.event_id: r.true_label for r in drift.with_ground_truth(events, truth).collect()} == {1: 1, 2: 1, 3: None}


def _texts(spark, n=60):
    rows = [(i, ("hóa đơn giả khống doanh thu" if i % 2 else "kiểm kê đầy đủ hàng tồn kho") + f" kỳ{i % 5}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id int, text string, label int")


def test_full_predictions_and_other_models(spark):
    df = _texts(spark)
    m = model.TextModel(vocabulary=100, iterations=40).fit(df, df)
    with_features = features.with_metadata_features(m.score(df))
    head = model.HybridHead().fit(with_features)
    out = {r.id: r for r in model.full_predictions(m, df.where("id < 4").select("id", "text"), "id", head).collect()}
    assert out[1].explanation_method == "tfidf_logreg_contribution" and out[1].top_terms and out[1].score_breakdown.decision_layer == "rule_based_postprocessing"
    assert out[1].explanation[0].startswith("Các red flags") and out[1].explanation[-1].endswith(", ".join(out[1].top_terms)) and out[0].score_breakdown.decision_layer == "hybrid_metadata_head"
    assert out[1].highlight.startswith('<span style="background: rgba(') and out[1].top_terms[0] in out[1].highlight
    d = model.DescentModel(epochs=200).fit(df)
    s = {r.id: r.raw_score for r in d.score(df.unionByName(spark.createDataFrame([(99, None, None)], df.schema)), "id").collect()}
    assert min(v for k, v in s.items() if k % 2 and k < 99) > max(v for k, v in s.items() if not k % 2) and math.isclose(s[99], 1 / (1 + math.exp(-d.bias)))
    assert metrics.evaluate(model.metadata_only(df, df), (), "label", "raw_score", 0.5).first().auc_roc > 0.9


def test_method_choice_and_terms(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "k int, term string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (2, "z", 1)], "k int, term string, rank int")
    assert {r.k: (r.method, r.top_terms) for r in explain.chosen(keys, "k", {"a": a, "b": b}).collect()} == {1: ("a", ["y", "x"]), 2: ("b", ["z"]), 3: ("none", [])}
    words = spark.createDataFrame([("a",), ("ab",), ("12.5",), ("x@@",), ("1a",), ("y" * 31,)], "t string")
    assert [r.t for r in words.where(explain.explainable(F.col("t"))).collect()] == ["ab", "1a"]


def test_p_values(spark):
    df = spark.createDataFrame([(0.0,), (3.841459,), (10.827566,)], "statistic double")
    assert [round(r.p_value, 4) for r in metrics.with_p_value(df).collect()] == [1.0, 0.05, 0.001]


def test_prompts_and_encoder_rows(spark):
    rec = spark.createDataFrame([(1, "văn bản", "L", "train"), (2, None, None, None), (3, "x" * 50, "M", "val")], "id int, text string, label string, split string")
    ctx = spark.createDataFrame([(1, "p2", 2), (1, "p1", 1)], "id int, passage string, rank int")
    got = {r.id: r.user for r in retrieval.prompt_rows(rec, "s", "T:{text} C:{context}", ctx).collect()}
    assert got[1] == "T:văn bản C:p1\np2" and got[2] == "T: C:"
    rows = retrieval.encoder_rows(rec.withColumn("label_int", F.when(F.col("label").isNotNull(), 1)), longest=20).orderBy("id", "part").collect()
    assert [(r.id, len(r.text)) for r in rows] == [(1, 7), (3, 20), (3, 20), (3, 10)]
    with pytest.raises(ValueError):
        retrieval.few(spark.range(retrieval.MOST_STANDARDS + 1))


def test_feature_schema(spark):
    assert [r.name for r in features.schema(spark).orderBy("position").collect()] == features.METADATA


def test_collapsed_models_are_trained_again(spark, tmp_path, monkeypatch):
    df, path = _texts(spark), str(tmp_path / "m")
    fits = []
    plain = model.TextModel.fit
    monkeypatch.setattr(model.TextModel, "fit", lambda self, *a: fits.append(1) or plain(model.TextModel(vocabulary=50, iterations=20), *a))
    first = model.load_or_train(path, df, df)
    again = model.load_or_train(path, df, df)
    assert len(fits) == 1 and again.auc == first.auc > 0.9 and again.threshold == first.threshold
    first.auc = 0.5
    first.save(path)
    model.load_or_train(path, df, df)
    assert len(fits) == 2
