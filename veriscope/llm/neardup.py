"""Near-duplicate texts with small edits, grouped at any scale (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.components import components
from veriscope.llm.nearsets import Corpus, similar_classes
from veriscope.session import staged


def near_duplicate_pairs(df: DataFrame, id_col: str = "sample_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(sample_a, sample_b), the smaller id first: texts whose word-shingle sets have at least that Jaccard similarity.

    Texts count in their consistent lower-case form; equal texts are a pair even where they are shorter than a shingle.
    Null ids, null texts and texts without a word are in no pair, a repeated id pairs with others but not with itself, an empty
    input gives an empty result, and extra columns are ignored.
    """
    corpus = Corpus(df, id_col, text_col, shingle)
    every = corpus.members()
    links, members = similar_classes(corpus, every, similarity), every.select("id", "sig").distinct()
    several = members.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig")
    same = members.join(several, "sig", "left_semi")
    a, b = F.col("a"), F.col("b")
    equal = same.select("sig", F.col("id").alias("a")).join(same.select("sig", F.col("id").alias("b")), "sig").where(a < b).select("a", "b")
    left, right = members.select(F.col("sig").alias("sig_a"), F.col("id").alias("a")), members.select(F.col("sig").alias("sig_b"), F.col("id").alias("b"))
    near = links.join(left, "sig_a").join(right, "sig_b").where(a != b).select("a", "b")
    return equal.union(near).select(F.least(a, b).alias(f"{id_col.removesuffix('_id')}_a"), F.greatest(a, b).alias(f"{id_col.removesuffix('_id')}_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str = "sample_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, class_id, group_id, links): one row per non-null id and text with a word, without expanding copies into pairs.

    ``class_id``: the least id of the rows with an equal set; ``group_id``: the least id that similarity links reach,
    directly or through others; ``links``: how many other classes this one is similar to. Nulls, empty texts, repeated
    rows and empty inputs are treated as in ``near_duplicate_pairs``.
    """
    corpus = Corpus(df, id_col, text_col, shingle)
    members = corpus.members()
    links = staged(similar_classes(corpus, members, similarity).select("sig_a", "sig_b"), "links")
    classes = members.groupBy("sig").agg(F.min("id").alias("class_id"))
    named = links.join(classes.select(F.col("sig").alias("sig_a"), F.col("class_id").alias("u")), "sig_a").join(classes.select(F.col("sig").alias("sig_b"), F.col("class_id").alias("v")), "sig_b").select("u", "v")
    labels = components(named)
    degree = named.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    out = members.select("id", "sig").distinct().join(classes, "sig").join(labels.select(F.col("node").alias("class_id"), F.col("label").alias("group_id")), "class_id", "left").join(degree, "class_id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
