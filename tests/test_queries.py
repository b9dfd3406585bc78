from veriscope.operators import model
from veriscope.plans import QUERIES, queries


def test_positives_are_each_records_own(spark, tmp_path):
    rows = [("a", "x", "BINH_THUONG", ["nhap khac"]), ("b", "x", "BINH_THUONG", ["TK2293", "Doanh thu"]), ("c", "doanh thu", "1", ["Trung thuc"]), ("d", "doanh thu khống", "1", []), ("e", None, None, None), ("f", "x", "0", ["CM 11"]), ("g", "doanh thu khống", "1", None), ("a", "x", "BINH_THUONG", ["nhap khac"]), (None, "x", "1", ["TK2293"])]
    spark.createDataFrame(rows, "id string, text string, label string, standard_ref array<string>").write.parquet(str(tmp_path / "m1_records.parquet"))
    # without a reference, "VAS 14" is inferred, and its "14" is first found in the year 2014 of TT200, as in the reference
    own = {"a": "VAS14-chunk01", "b": "TT200-TK2293-chunk01", "c": "VAS01-chunk01", "d": "TT200-TK2293-chunk01", "e": "TT48-Art6-chunk01", "f": "TT48-Art6-chunk01", "g": "TT200-TK2293-chunk01"}
    negatives = QUERIES["hard_negatives"](spark, str(tmp_path)).collect()
    every = {"TT48-Art6-chunk01", "TT200-TK2293-chunk01", "VAS14-chunk01", "VAS01-chunk01"}
    for k, c in own.items():
        assert sorted(r.chunk_id for r in negatives if r.id == k) == sorted(every - {c})
    pairs = QUERIES["retrieval_sets"](spark, str(tmp_path)).collect()
    from veriscope.functions.lexicons import STANDARDS

    text = {s[0]: s[4] for s in STANDARDS}
    assert {r.id: r.passage for r in pairs if r.label == 1} == {k: text[c] for k, c in own.items()}
    assert len(pairs) == 4 * len(own) and all(r.passage != text[own[r.id]] for r in pairs if r.label == 0)


def test_text_model_has_the_settings_of_the_reference(spark, tmp_path, monkeypatch):
    rows = [(i, f"văn bản {i}", i % 2) for i in range(20)]
    spark.createDataFrame(rows, "sample_id int, text string, label int").write.parquet(str(tmp_path / "mini_samples.parquet"))
    monkeypatch.setattr(model.TextModel, "fit", lambda self, *_: self)
    for m in (queries.trained(spark, str(tmp_path))[0], model.TextModel()):
        assert m.vocabulary == 20_000 and m.iterations >= 300
