"""Preparing labelled records: deduplication, time marks, splits, folds and their manifests."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriscope.functions import lexicons as lx
from veriscope.session import staged

TIME_FIELDS = ("collected_at", "published_at", "report_date", "doc_id", "file", "text")


def first_of_duplicates(df: DataFrame, text: str = "text", order: str = "sample_id") -> DataFrame:
    """Rows whose text occurs first in ``order``; null texts count as one text.

    Keys are 96 bits of hash of the text, and the first row of each is found by a partial minimum, so a text that a third
    of the rows share costs one row per task and whole texts aren't sorted.
    """
    key = [F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("_k"), F.hash(F.coalesce(F.col(text), F.lit(""))).alias("_j")]
    first = df.select(F.col(order), *key).groupBy("_k", "_j").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def time_mark(df: DataFrame, today: str, fields: Sequence[str] = TIME_FIELDS) -> DataFrame:
    """Adds ``mark`` (struct of date, year, source, known) from the first field that tells a valid time.

    A field's first pattern that matches decides it: year-month-day, day-month-year, quarter, year. Years outside
    2000..today+1 pass to the next field; days are at most 28; without any the mark is 1900-01-01, unknown.
    """
    last = int(today[:4]) + 1
    made = []
    for f in fields:
        if f not in df.columns:
            continue
        v = F.coalesce(F.col(f).cast("string"), F.lit(""))
        num = lambda p, g, v=v: F.regexp_extract(v, p, g).try_cast("int")
        day = lambda y, m, d: F.make_date(y, F.least(F.greatest(m, F.lit(1)), F.lit(12)), F.least(F.greatest(d, F.lit(1)), F.lit(28)))
        quarter = F.coalesce(*(num(lx.DATE_QUARTER, g) for g in (1, 2, 3)))
        shapes = [
            (lx.DATE_YMD, num(lx.DATE_YMD, 1), num(lx.DATE_YMD, 2), num(lx.DATE_YMD, 3), ""),
            (lx.DATE_DMY, num(lx.DATE_DMY, 3), num(lx.DATE_DMY, 2), num(lx.DATE_DMY, 1), ""),
            (lx.DATE_QUARTER, num(lx.DATE_QUARTER, 4), quarter * 3, F.lit(28), ":quarter"),
            (lx.DATE_YEAR, num(lx.DATE_YEAR, 1), F.lit(12), F.lit(28), ":year"),
        ]
        pick = F.lit(None)
        for p, y, m, d, suffix in reversed(shapes):
            mark = F.when(y.between(2000, last), F.struct(day(y, m, d).alias("date"), y.alias("year"), F.lit(f + suffix).alias("source"), F.lit(True).alias("known")))
            pick = F.when(v.rlike(p), mark).otherwise(pick)
        made.append(pick)
    unknown = F.struct(F.make_date(F.lit(1900), F.lit(1), F.lit(1)).alias("date"), F.lit(0).alias("year"), F.lit("unknown").alias("source"), F.lit(False).alias("known"))
    return df.withColumn("mark", F.coalesce(*made, unknown))


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Adds the 0-based position in ``order`` without sorting everything in one task.

    Rows are range-partitioned and sorted, counted per partition, and numbered within it; only one count per partition
    reaches the driver.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    part = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    # written down, so that the numbers counted are the numbers used even if an executor is lost in between
    part = staged(part.withColumns({"_p": F.shiftright("_id", 33), "_r": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ordered")
    counts = {r._p: r.c for r in part.groupBy("_p").agg(F.count("*").alias("c")).collect()}
    at, total = {}, 0
    for p in sorted(counts):
        at[p], total = total, total + counts[p]
    starts = df.sparkSession.createDataFrame(list(at.items()), "_p long, _at long")
    return part.join(F.broadcast(starts), "_p").select(*df.columns, (F.col("_r") + F.col("_at")).alias(name))


def blocked(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], before: int, rows: int = 100_000) -> DataFrame:
    """Adds ``_position``, ``_block`` and ``_own`` for windows that look back at most ``before`` rows.

    Rows in order of (partition, order) form blocks of ``rows``, and each block also gets the last rows of the one
    before it as copies that aren't its own. A window per (partition, ``_block``) in order of ``_position``, filtered to
    own rows, then equals one per partition, though no task holds all rows of a large partition.
    """
    if before >= rows:
        raise ValueError("blocks must be longer than the look-back")
    placed = with_position(df, [*partition, *order], "_position")
    b = F.floor(F.col("_position") / rows)
    tail = F.col("_position") % rows >= rows - before
    own, copy = F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b + 1).alias("b"), F.lit(False).alias("own"))
    placed = placed.withColumn("_x", F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own))))
    return placed.withColumns({"_block": F.col("_x.b"), "_own": F.col("_x.own")}).drop("_x")


def split_sizes(n: int, train: float = 0.8, val: float = 0.1) -> tuple[int, int, int]:
    """Sizes of train, val and test by truncation, each at least 1 where there are three rows."""
    a, b = int(n * train), int(n * val)
    a, b = max(1, a), max(1, b)
    if a + b >= n and n >= 3:
        a = max(1, n - 2)
        b = 1
    return a, b, max(0, n - a - b)


def temporal_split(df: DataFrame, order: Sequence[str | Column], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Adds ``split``: the earliest rows train, then val, then test; unknown marks sort first."""
    placed = with_position(df, order, "_position")
    a, b, _ = split_sizes(df.count(), train, val)
    return placed.withColumn("split", F.when(F.col("_position") < a, "train").when(F.col("_position") < a + b, "val").otherwise("test")).drop("_position")


#: Rows that one part of a stratum holds on average at most.
PART_ROWS = 200_000


def stratified_split(df: DataFrame, label: str, key: Column, shares: Mapping[str, float]) -> DataFrame:
    """Adds ``split`` with the shares held within every label to a row, in the order of ``key`` (say a seeded hash).

    Strata are numbered in hash ranges: a window over (label, first hexadecimal digits of the key) numbers rows of many parts
    of each label at once, as many as keep a part under ``PART_ROWS`` rows, and the counts of the parts give the offsets.
    """
    digits = max(2, math.ceil(math.log(max(df.count() / PART_ROWS, 1), 16)))
    rows = df.withColumn("_key", key).withColumn("_part", F.left("_key", F.lit(digits)))
    within = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_key")))
    parts = rows.groupBy(label, "_part").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label)
    parts = parts.select(F.col(label).alias("_l"), F.col("_part").alias("_q"), (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_at"), F.sum("_c").over(w).alias("_n"))
    placed = within.join(parts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_part") == F.col("_q"))).withColumn("_place", (F.col("_at") + F.col("_r") - 1) / F.col("_n"))
    names, edge = list(shares), 0.0
    pick, cuts = F.lit(names[-1]), []
    for s in names[:-1]:
        edge += shares[s]
        cuts.append((round(edge, 12), s))
    for e, s in reversed(cuts):
        pick = F.when(F.col("_place") < e, s).otherwise(pick)
    return placed.select(*df.columns, pick.alias("split"))


def choose_strategy(df: DataFrame) -> str:
    """temporal if at least half the marks are known and tell two years, else random; one row reaches the driver."""
    r = df.agg(F.avg(F.col("mark.known").cast("double")).alias("known"), F.count_distinct(F.when(F.col("mark.known"), F.col("mark.year"))).alias("years")).first()
    return "temporal" if (r.known or 0) >= 0.5 and r.years >= 2 else "random"


def split_manifest(df: DataFrame, label: str = "label") -> DataFrame:
    """(split, total, fraud, non_fraud, fraud_ratio, known_ratio, start, end) of rows with ``split`` and ``mark``."""
    return df.groupBy("split").agg(
        F.count("*").alias("total"), F.count_if(F.col(label) > 0).alias("fraud"), F.count_if(F.col(label) <= 0).alias("non_fraud"), F.round(F.avg((F.col(label) > 0).cast("double")), 4).alias("fraud_ratio"),
        F.round(F.avg(F.col("mark.known").cast("double")), 4).alias("known_ratio"), F.min(F.when(F.col("mark.known"), F.col("mark.date"))).alias("start"), F.max(F.when(F.col("mark.known"), F.col("mark.date"))).alias("end"),
    )


def expanding_folds(df: DataFrame, order: Sequence[str | Column], folds: int = 3, min_train: float = 0.5) -> DataFrame:
    """Rows exploded to (fold, role): fold i trains on the first part and validates on the next block.

    n rows, first = int(n·min_train), block = (n - first) // (folds + 1); under four rows a fold raises.
    """
    n = df.count()
    if n < 4 * folds:
        raise ValueError(f"{n} rows are too few for {folds} folds")
    first = int(n * min_train)
    block = (n - first) // (folds + 1)
    placed = with_position(df, order, "_position")
    marks = F.array(*(F.struct(F.lit(i).alias("fold"), F.when(F.col("_position") < first + (i - 1) * block, "train").when(F.col("_position") < first + i * block, "val").alias("role")) for i in range(1, folds + 1)))
    return placed.withColumn("_f", F.explode(marks)).where("_f.role is not null").select(*df.columns, F.col("_f.fold").alias("fold"), F.col("_f.role").alias("role"))


def tail_validation(df: DataFrame, order: Sequence[str | Column], share: float = 0.1) -> DataFrame:
    """Adds ``split``: the last rows validate, at least one."""
    n = df.count()
    cut = n - max(1, int(n * share))
    return with_position(df, order, "_position").withColumn("split", F.when(F.col("_position") < cut, "train").otherwise("val")).drop("_position")


def split_statistics(df: DataFrame, split: str = "split", label: str = "label", company: str = "company_id") -> DataFrame:
    """(split, records, companies, label_distribution): distinct companies and a map of label counts."""
    labels = df.groupBy(split, F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("_l")).agg(F.count("*").alias("_c"))
    maps = labels.groupBy(split).agg(F.sum("_c").alias("records"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("_l", "_c")))).alias("label_distribution"))
    firms = df.groupBy(F.col(split).alias("_split")).agg(F.count_distinct(company).alias("companies"))
    return maps.join(firms, F.col(split).eqNullSafe(F.col("_split"))).select(split, "records", "companies", "label_distribution")
