"""Command line: python -m veriscope.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from veriscope import get_spark
from veriscope.operators import datasets, drift, governance, metrics, model, prep, tuning
from veriscope.sources import readers, writers

# Texts of the demonstration.
DEMO = ["Doanh thu tăng mạnh nhưng dòng tiền âm trong kỳ.", "Báo cáo trình bày trung thực, hợp lý.", "Công ty ghi nhận doanh thu khống qua hóa đơn giả.", "Related party transactions were fully disclosed."]


def _split(df):
    marked = prep.time_mark(df, "2026-12-31")
    if prep.choose_strategy(marked) == "temporal":
        return prep.temporal_split(marked.withColumn("_date", F.col("mark.date")), ["_date", "_row"])
    return prep.stratified_split(marked, "label", F.md5(F.concat(F.col("_row").cast("string"), F.lit(":42"))), {"train": 0.8, "val": 0.1, "test": 0.1})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="veriscope")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "train": ("dataset", "out"), "score": ("folder", "model", "out"), "text": ("text", "model"), "demo": ("model",), "governance": ("dataset",), "split": ("dataset", "out"), "build": ("dataset", "out"), "tune": ("dataset",), "evaluate": ("csv", "model"), "drift": ("events",), "mcnemar": ("scored",), "ablation": ("scored",), "ingest": ("folder", "out"),
    }.items():
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        c.add_argument("--threshold", type=float, help="overrides the tuned threshold")
    a = p.parse_args(argv)
    spark = get_spark()
    show = lambda rows: print(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str, indent=2))
    if a.command in ("train", "split", "governance", "build", "tune"):
        df = readers.read_json(spark, a.dataset, row="_row")
        if a.command == "governance":
            show(governance.governance_report(df.drop("_row")).collect())
            return
        if a.command == "build":
            print(json.dumps(datasets.build(spark, df, "_row", a.out), ensure_ascii=False, indent=2))
            return
        if a.command == "tune":
            print(json.dumps(tuning.search(readers.require_labelled(df, "_row"), ["_row"]), indent=2))
            return
        parts = _split(prep.first_of_duplicates(readers.require_labelled(df, "_row").withColumn("sample_id", F.col("_row"))))
        if a.command == "split":
            writers.write_splits(parts.drop("mark", "_row", "_date"), a.out)
            show(prep.split_manifest(parts).collect())
            return
        m = model.TextModel().fit(parts.where("split = 'train'"), parts.where("split = 'val'"))
        m.save(a.out)
        show(metrics.evaluate(m.score(parts.where("split = 'test'")), (), "label", "raw_score", m.threshold).collect())
    elif a.command == "ingest":
        show(readers.ingest(spark, a.folder, a.out).collect())
    elif a.command == "mcnemar":
        scored = spark.read.parquet(a.scored).withColumns({"_y": (F.col("label") > 0).cast("int"), "_p": F.col("predicted_label").cast("int")})
        show(metrics.with_p_value(metrics.mcnemar(scored, "index", "model", "_y", "_p")).collect())
    elif a.command == "ablation":
        by = metrics.evaluate(spark.read.parquet(a.scored), ["model"], "label", "final_score", 0.5 if a.threshold is None else a.threshold)
        show(metrics.ablation_deltas(by, "model").collect())
    elif a.command == "drift":
        show(drift.drift_report(drift.once(spark.read.parquet(a.events)), ["model"]).collect())
    else:
        m = model.TextModel().load(a.model, a.threshold)
        if a.command == "evaluate":
            show(metrics.evaluate(m.score(readers.read_eval_csv(spark, a.csv)), (), "label", "raw_score", m.threshold).collect())
        elif a.command == "score":
            docs = readers.read_documents(spark, a.folder)
            done = model.predictions(m.score(docs.where("text is not null")), m.threshold).drop("score_breakdown", "doan_nghi_ngo", "metadata_features")
            out = done.unionByName(docs.where("text is null"), allowMissingColumns=True)
            out.write.mode("overwrite").json(a.out)
            show(writers.scan_summary(spark.read.schema(out.schema).json(a.out)).collect())
        else:
            texts = [a.text] if a.command == "text" else DEMO
            show(model.predictions(m.score(spark.createDataFrame([(t,) for t in texts], "text string")), m.threshold).collect())


if __name__ == "__main__":
    main()
