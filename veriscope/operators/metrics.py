"""Evaluation of scored rows, in SQL over scores that were grouped first.

All metrics come from one table of (group, score, positives, rows), so the data is aggregated once and the windows run
over distinct scores per group, not over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ONE = F.lit


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(p + r == 0, 0.0).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def scored_groups(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """(group..., s, pos, n): rows per distinct score; rows without label or score are left out."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*group, F.col(score).cast("double").alias("s")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))


#: Bins of the score range in which running sums are taken before they are joined.
BINS = 4096


def _running(by: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Adds ``up_*`` and ``down_*``, sums of the columns over scores up to and down to each row's ``s``, and ``all_*``.

    Sums run within bins of the score and are offset by the sums of whole bins, at most ``BINS`` rows a group, so neither
    one group nor a table without groups is summed in one task. The bin is monotone in the score: half of
    the bins lie between 0 and 1, and a quarter on either side, ever wider, so scores of any range are told apart.
    """
    g = list(group)
    s = F.col("s")
    place = F.when(F.isnan(s), 1.0).when(s < 0, 0.25 / (1 - s)).when(s > 1, 1 - 0.25 / s).otherwise(0.25 + 0.5 * s)
    by = by.withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(place * BINS).cast("int")))
    inner = Window.partitionBy(*g, "_bin").orderBy("s")
    bins = by.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(g)), F.col("_bin").alias("_b")).agg(*(F.sum(c).alias(f"_s_{c}") for c in cols))
    keys = [f"_g{i}" for i in range(len(g))]
    over, whole = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys)
    bins = bins.select(*keys, "_b", *((F.sum(f"_s_{c}").over(over) - F.col(f"_s_{c}")).alias(f"_o_{c}") for c in cols), *(F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in cols))
    on = F.col("_bin") == F.col("_b")
    for k, c in zip(keys, g, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    out = by.withColumns({f"_i_{c}": F.sum(c).over(inner) for c in cols}).join(bins, on)
    up = {c: F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in cols}
    return out.select(*(x for x in by.columns if x != "_bin"), *(up[c].alias(f"up_{c}") for c in cols), *((F.col(f"all_{c}") - up[c] + F.col(c)).alias(f"down_{c}") for c in cols), *(f"all_{c}" for c in cols))


def evaluate(df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score", threshold: str | float = 0.5) -> DataFrame:
    """One row per group: support, confusion counts at the threshold, nine metrics, and the spread of scores.

    A column name as threshold means each row's own. AUC needs both classes, AUPRC a positive, MCC both classes and both
    predictions; otherwise 0. Ties count half in AUC; AUPRC is the step sum over distinct scores.
    """
    g = list(group)
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*g, (F.col(label) > 0).cast("int").alias("y"), F.col(score).cast("double").alias("s"), (F.col(score) >= (F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold)))).cast("int").alias("p"))
    # counts per (group, score) are combined before they are shuffled
    by = rows.groupBy(*g, "s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum("p").alias("pp"))
    by = _running(by, g, ("n", "pos"))
    by = by.withColumns({"below": F.col("up_n") - F.col("n"), "cum_n": F.col("down_n"), "cum_tp": F.col("down_pos")})
    s = by.groupBy(*g).agg(
        F.sum("n").alias("support"), F.sum("pos").alias("positives"), F.sum("tp").alias("tp"), F.sum("pp").alias("_pp"),
        F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("_ranks"),
        F.sum(F.col("pos") * (F.col("cum_tp") / F.col("cum_n"))).alias("_ap"),
        (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("score_mean"), F.sum(F.col("s") * F.col("s") * F.col("n")).alias("_sq"),
        F.min("s").alias("score_min"), F.max("s").alias("score_max"),
    )
    pos, n, tp = F.col("positives"), F.col("support"), F.col("tp")
    s = s.withColumns({"fp": F.col("_pp") - tp, "fn": pos - tp}).withColumn("tn", n - tp - F.col("fp") - F.col("fn"))
    fp, fn, tn = F.col("fp"), F.col("fn"), F.col("tn")
    s = s.withColumns({"precision": _ratio(tp.cast("double"), tp + fp), "recall": _ratio(tp.cast("double"), pos), "accuracy": _ratio((tp + tn).cast("double"), n)})
    p, r = F.col("precision"), F.col("recall")
    neg = n - pos
    mcc = (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(F.nullif((tp + fp).cast("double") * pos * (tn + fp) * (tn + fn), F.lit(0.0)))
    return s.select(
        *g, "support", "positives", "tp", "fp", "fn", "tn", "precision", "recall", f_beta(p, r, 1).alias("f1"), f_beta(p, r, 0.5).alias("f0_5"), f_beta(p, r, 2).alias("f2"), "accuracy",
        F.when((pos > 0) & (neg > 0), (F.col("_ranks") - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, F.lit(0))).otherwise(0.0).alias("auc_roc"),
        F.when(pos > 0, F.col("_ap") / F.nullif(pos, F.lit(0))).otherwise(0.0).alias("auprc"), F.coalesce(mcc, F.lit(0.0)).alias("mcc"),
        _ratio(F.col("_pp").cast("double"), n).alias("predicted_rate"), "score_mean", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / n - F.col("score_mean") * F.col("score_mean"))).alias("score_std"), "score_min", "score_max",
    )


def curve(df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """(group..., threshold, precision, recall, f1, f0_5, f2) at every distinct score."""
    by = _running(scored_groups(df, group, label, score), group, ("n", "pos"))
    by = by.withColumns({"tp": F.col("down_pos"), "pp": F.col("down_n"), "all": F.col("all_pos")})
    by = by.withColumns({"precision": _ratio(F.col("tp").cast("double"), F.col("pp")), "recall": _ratio(F.col("tp").cast("double"), F.col("all"))})
    p, r = F.col("precision"), F.col("recall")
    return by.select(*group, F.col("s").alias("threshold"), "all", "precision", "recall", f_beta(p, r, 1).alias("f1"), f_beta(p, r, 0.5).alias("f0_5"), f_beta(p, r, 2).alias("f2"))


def best_threshold(df: DataFrame, group: Sequence[str] = (), label: str = "label", score: str = "score", metric: str = "f2") -> DataFrame:
    """(group..., threshold, value): the threshold of the greatest metric, the lowest on ties; 0.5 without positives.

    An unknown metric means f2.
    """
    m = metric if metric in ("f1", "f2", "f0_5", "precision", "recall") else "f2"
    best = curve(df, group, label, score).groupBy(*group).agg(F.max(F.struct(F.round(m, 12).alias("v"), (-F.col("threshold")).alias("t"), F.col(m).alias("exact"))).alias("b"), F.max("all").alias("all"))
    return best.select(*group, F.when(F.col("all") > 0, -F.col("b.t")).otherwise(0.5).alias("threshold"), F.when(F.col("all") > 0, F.col("b.exact")).otherwise(0.0).alias("value"))


def bias_report(df: DataFrame, flags: str, label: str = "label", score: str = "score", threshold: float = 0.5, min_support: int = 5) -> DataFrame:
    """Metrics of every slice with enough rows and its gaps to all rows; rows without a flag form ``default_population``."""
    slices = df.withColumn("slice", F.explode(F.when(F.size(flags) > 0, F.col(flags)).otherwise(F.array(F.lit("default_population")))))
    by = evaluate(slices, ["slice"], label, score, threshold).where(F.col("support") >= min_support)
    whole = evaluate(df, (), label, score, threshold).select(F.col("precision").alias("_p"), F.col("recall").alias("_r"))
    # one row of totals meets one row per slice
    return by.join(F.broadcast(whole)).select("slice", "support", "positives", "precision", "recall", "f2", F.abs(F.col("precision") - F.col("_p")).alias("precision_gap"), F.abs(F.col("recall") - F.col("_r")).alias("recall_gap"))


def mcnemar(df: DataFrame, item: str, model: str, label: str, predicted: str) -> DataFrame:
    """(model_a, model_b, n00, n01, n10, n11, statistic) for every pair of models over the items that both predicted.

    Correct answers are packed into one map per item, so each item is shuffled once and pairs are made inside it (the
    number of models bounds them). Without discordant pairs the statistic is 0.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(item, model).agg(F.max((F.col(label) == F.col(predicted)).cast("int")).alias("ok"))
    per = rows.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), "ok"))).alias("a"))
    pairs = per.select(F.explode(F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: y["m"] > x["m"]), lambda y: F.struct(x["m"].alias("model_a"), y["m"].alias("model_b"), x["ok"].alias("a"), y["ok"].alias("b")))))).alias("p")).select("p.*")
    n = lambda a, b, name: F.count_if((F.col("a") == a) & (F.col("b") == b)).alias(name)
    out = pairs.groupBy("model_a", "model_b").agg(n(0, 0, "n00"), n(0, 1, "n01"), n(1, 0, "n10"), n(1, 1, "n11"))
    diff = F.greatest(F.abs(F.col("n01") - F.col("n10")) - 1, F.lit(-1)).cast("double")
    return out.withColumn("statistic", F.when(F.col("n01") + F.col("n10") == 0, 0.0).otherwise(diff * diff / F.nullif(F.col("n01") + F.col("n10"), F.lit(0))))


def with_p_value(pairs: DataFrame, statistic: str = "statistic") -> DataFrame:
    """Adds ``p_value``, the chi-square tail (one degree) of each pair's statistic; 1 without discordant pairs."""

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(mcnemar_p)

    return pairs.withColumn("p_value", tail(F.col(statistic)))


def mcnemar_p(statistic: float | None) -> float:
    """Chi-square (one degree) tail of a statistic; 1 for none."""
    return 1.0 if not statistic else math.erfc(math.sqrt(statistic / 2))


def ablation_deltas(metrics: DataFrame, variant: str, full: str | None = None, names: Sequence[str] = ("f2", "auc_roc", "mcc")) -> DataFrame:
    """(variant, full, delta_*): the full variant's metric minus each other's.

    Without ``full`` the variant of greatest first metric counts as full, the least name on ties. A metric that is null
    on either side has a null delta; without the full variant there is no row.
    """
    rows = metrics if full is None else metrics.where(F.col(variant) == full)
    base = rows.where(F.col(variant).isNotNull()).agg(F.min_by(F.struct(F.col(variant).alias("full"), *names), F.struct(-F.coalesce(F.col(names[0]).cast("double"), F.lit(float("-inf"))), F.col(variant))).alias("_b"))
    return metrics.join(F.broadcast(base)).where(F.col(variant) != F.col("_b.full")).select(variant, F.col("_b.full").alias("full"), *((F.col(f"_b.{n}") - F.col(n)).alias(f"delta_{n}") for n in names))


def best_models(metrics: DataFrame, model: str, names: Sequence[str]) -> DataFrame:
    """(metric, model, value): the best model of every metric, the least name on ties."""
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(model).alias("model"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.min_by("model", F.struct(-F.col("value"), "model")).alias("model"), F.max("value").alias("value"))


def layer_evidence(df: DataFrame, raw: str, hybrid: str, threshold: float) -> DataFrame:
    """Mean and greatest shift between two score layers and how many decisions changed."""
    shift = F.abs(F.col(hybrid) - F.col(raw))
    changed = (F.col(raw) >= threshold) != (F.col(hybrid) >= threshold)
    return df.where(F.col(raw).isNotNull() & F.col(hybrid).isNotNull()).agg(F.count("*").alias("n"), F.avg(shift).alias("mean_shift"), F.max(shift).alias("max_shift"), F.count_if(changed).alias("changed"))


def both_layers(df: DataFrame, label: str, raw: str, hybrid: str, threshold: float) -> DataFrame:
    """One row: how far two score layers lie apart, and the areas and F2 of both over rows with a label and both scores."""
    rows = df.where(F.col(label).isNotNull() & F.col(raw).isNotNull() & F.col(hybrid).isNotNull())
    out = layer_evidence(rows, raw, hybrid, threshold)
    for name, score in (("raw", raw), ("hybrid", hybrid)):
        one = evaluate(rows, (), label, score, threshold).select(*(F.col(m).alias(f"{name}_{m}") for m in ("auc_roc", "auprc", "f2")))
        out = out.join(F.broadcast(one))  # one row each
    return out


def changed_decisions(df: DataFrame, key: str, raw: str, hybrid: str, threshold: float, n: int = 10) -> DataFrame:
    """The first ``n`` rows whose decision differs between two layers."""
    return df.where((F.col(raw) >= threshold) != (F.col(hybrid) >= threshold)).orderBy(key).limit(n).select(key, raw, hybrid)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight, alpha): balanced weight n/(k·n_c) and the share of the other classes."""
    by = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # over one row per class
    return by.select(label, "n", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"), (F.lit(1.0) - F.col("n") / F.sum("n").over(w)).alias("alpha"))


def collapsed(auc: float | None, limit: float = 0.60) -> bool:
    """Whether a saved model must be trained again."""
    return auc is None or auc < limit
