"""Explanations of scores by perturbation, expressed on sets of rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENS = r"([A-Za-zÀ-ỹ0-9_]+)"
Scorer = Callable[[DataFrame], DataFrame]


def first_tokens(t: Column, n: int = 12) -> Column:
    return F.slice(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKENS), F.lit(1)), 1, n)


def explainable(term: Column) -> Column:
    """Whether a term can stand in an explanation: 2 to 30 characters, a letter, no mark of a broken subword, no number."""
    return F.length(term).between(2, 30) & term.rlike(r"\p{L}") & ~term.contains("@@") & ~term.rlike(r"^[\p{Nd}., :]*$")


def linear_attributions(contributions: DataFrame, key: str) -> DataFrame:
    """(key, term, score, rank): integrated gradients of a linear model from an empty text, which are the contributions
    themselves, scaled by the greatest of the row; terms that can't explain are left out."""
    top = F.max(F.abs("contribution")).over(Window.partitionBy(key))
    kept = contributions.where(explainable(F.col("term"))).withColumn("score", F.coalesce(F.col("contribution") / F.nullif(top, F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("score"), 9)), "term")
    return kept.withColumn("rank", F.row_number().over(w)).select(key, "term", "score", "rank")


def chosen(df: DataFrame, key: str, methods: Mapping[str, DataFrame]) -> DataFrame:
    """(key, method, top_terms): for each row the first method, in order, that has terms for it; else ``none``.

    ``methods``: frames of (key, term, rank) by name; terms come in order of rank.
    """
    out = df.select(key)
    for name, terms in methods.items():
        listed = terms.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(f"_{name}"))
        out = out.join(listed, key, "left")
    name, terms = F.lit("none"), F.array().cast("array<string>")
    for m in reversed(list(methods)):
        has = F.size(F.coalesce(f"_{m}", F.array().cast("array<string>"))) > 0
        name, terms = F.when(has, m).otherwise(name), F.when(has, F.col(f"_{m}")).otherwise(terms)
    return out.select(key, name.alias("method"), terms.alias("top_terms"))


def leave_one_out(df: DataFrame, key: str, scorer: Scorer, text: str = "text", n: int = 12, top: int = 5) -> DataFrame:
    """(key, term, contribution, rank): full score minus the score without one of the first ``n`` tokens.

    Variants are ordinary rows of ``text`` for the scorer, which adds ``raw_score``; at most ``n`` + 1 per row.
    """
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_full"), first_tokens(F.col(text), n).alias("_t"))
    whole = rows.select(key, F.lit(-1).alias("_i"), F.lit("").alias("term"), F.col("_full").alias("text"))
    less = rows.select(key, F.posexplode("_t").alias("_i", "term"), "_t").select(key, "_i", "term", F.array_join(F.filter("_t", lambda x, j: j != F.col("_i")), " ").alias("text"))
    scored = scorer(whole.unionByName(less)).select(key, "_i", "term", "raw_score")
    full = F.max(F.when(F.col("_i") == -1, F.col("raw_score"))).over(Window.partitionBy(key))
    out = scored.withColumn("contribution", full - F.col("raw_score")).where("_i >= 0")
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("contribution"), 9)), "_i")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "term", "contribution", "rank")


def local_surrogate(df: DataFrame, key: str, scorer: Scorer, text: str = "text", n: int = 12, masks: int = 48, keep: float = 0.65, width: float = 0.75, seed: int = 42) -> DataFrame:
    """(key, term, weight): a weighted linear fit of the scores of masked variants per row.

    Masks are a small table drawn once; variants are scored as rows; each row's fit sees its own ``masks`` variants.
    """
    rng = np.random.default_rng(seed)
    drawn = (rng.random((masks, n)) < keep).astype(int)
    drawn[0] = 1
    table = df.sparkSession.createDataFrame([(i, m.tolist()) for i, m in enumerate(drawn)], "_m int, _mask array<int>")
    rows = df.select(key, first_tokens(F.col(text), n).alias("_t")).where(F.size("_t") > 0)
    variants = rows.join(F.broadcast(table)).select(key, "_m", "_t", F.slice("_mask", F.lit(1), F.size("_t")).alias("_mask"))
    variants = variants.withColumn("text", F.array_join(F.filter("_t", lambda x, j: F.get("_mask", j) == 1), " "))
    scored = scorer(variants)
    kind = df.schema[key].dataType.simpleString()

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["_mask"].values).astype(float)
        k = x.shape[1]
        w = np.exp(-(((k - x.sum(1)) / (width * k)) ** 2))
        a = np.hstack([np.ones((len(x), 1)), x]) * np.sqrt(w)[:, None]
        beta = np.linalg.pinv(a) @ (b["raw_score"].values * np.sqrt(w))
        return pd.DataFrame({key: b[key].iloc[0], "term": list(b["_t"].iloc[0]), "position": range(k), "weight": beta[1:]})

    return scored.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, term string, position int, weight double")


def highlighted(terms: Column) -> Column:
    """HTML of (term, weight) structs: the stronger the weight, the darker."""
    span = lambda x: F.format_string('<span style="background: rgba(%s, %.2f)">%s</span>', F.when(x["weight"] >= 0, "220,38,38").otherwise("37,99,235"), F.least(F.lit(0.85), F.lit(0.2) + F.lit(0.65) * F.abs(x["weight"])), F.replace(F.replace(x["term"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    return F.array_join(F.transform(terms, span), " ")
