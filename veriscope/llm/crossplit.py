"""Records of evaluation splits that appear again, the same or almost, in the training split (problem 4).

Every text gets a similarity fingerprint: the parity bits of its hashed shingles, so two texts whose shingle sets differ
in d members have fingerprints within Hamming distance d. Texts are blocked by the codes of their rarest shingles and
joined across splits within the Hamming radius that the wanted similarity allows; the exact similarity is then verified.
Segments of the fingerprint itself can't serve as blocks at these similarities (see the README), codes of rare shingles
lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.nearsets import Corpus, similar_classes


def split_name(split: Column) -> Column:
    """train, val or test, however spelt (dev counts as val); null for anything else."""
    s = F.lower(F.regexp_replace(split, r"(?U)^\W+|\W+$", ""))
    return F.when(s.startswith("train"), "train").when(s.startswith("val") | s.startswith("dev"), "val").when(s.startswith("test"), "test")


def cross_split_pairs(df: DataFrame, id_col: str = "sample_id", text_col: str = "text", split_col: str = "split", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(sample_a, sample_b), the smaller id first: similar texts of which one is in train and the other in val or test.

    Similarity and the treatment of null, empty and repeated texts are those of ``near_duplicate_pairs``; rows whose
    split is null or unknown are in no pair; an empty input gives an empty result; extra columns are ignored.
    """
    name = split_name(F.col(split_col))
    sided = df.select(F.col(id_col), F.col(text_col), F.when(name == "train", 1).otherwise(2).alias("_mask")).where(name.isNotNull())
    corpus = Corpus(sided, id_col, text_col, shingle, "_mask")
    every = corpus.members()
    links = similar_classes(corpus, every, similarity, cross=True).select("sig_a", "sig_b")
    members = every.select("id", "sig", "mask").distinct()
    train = members.where("mask = 1").select(F.col("sig").alias("sig_a"), F.col("id").alias("a"))
    held = members.where("mask = 2").select(F.col("sig").alias("sig_b"), F.col("id").alias("b"))
    both_ways = links.union(links.select(F.col("sig_b").alias("sig_a"), F.col("sig_a").alias("sig_b")))
    near = both_ways.join(train, "sig_a").join(held, "sig_b").select("a", "b")
    equal = train.join(held, F.col("sig_a") == F.col("sig_b")).select("a", "b")
    stem = id_col.removesuffix("_id")
    return near.union(equal).where("a <> b").select(F.least("a", "b").alias(f"{stem}_a"), F.greatest("a", "b").alias(f"{stem}_b")).distinct()


def overlap_report(df: DataFrame, pairs: DataFrame, id_col: str = "sample_id", split_col: str = "split", source_col: str = "source") -> DataFrame:
    """Per evaluation split and source: its samples, and how many of them overlap the training split."""
    stem = id_col.removesuffix("_id")
    ids = pairs.select(F.explode(F.array(f"{stem}_a", f"{stem}_b")).alias(id_col)).distinct().withColumn("hit", F.lit(1))
    rows = df.select(F.col(id_col), split_name(F.col(split_col)).alias("split"), F.coalesce(F.nullif(F.trim(F.col(source_col)), F.lit("")), F.lit("unknown")).alias("source")).where("split in ('val', 'test')")
    return rows.join(ids, id_col, "left").groupBy("split", "source").agg(F.count("*").alias("samples"), F.count("hit").alias("overlapping"))
