"""Splits that keep related records together (problem 3).

Records and the entities they name (company, source file) form a bipartite graph whose components are the groups.
Entities of one record are tied to its least entity, which leaves a graph of distinct entity pairs however many records
repeat them; minimum-label propagation runs on that graph. Groups are then assigned to splits as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.llm.components import components
from veriscope.session import staged

#: A group with at least this share of all records is placed one by one: at most 1/share groups.
LARGE_SHARE = 1 / 2000
#: Smaller groups are placed in bins: groups of one size class and leading label are dealt to so many by a hash.
BINS = 512
#: Labels that are told apart, the most frequent ones; the others count as one.
LABELS = 16

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def _plain(value: Column) -> Column:
    return F.regexp_replace(F.translate(value, _WIDE, _NARROW), r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")


def canonical_company(value: Column) -> Column:
    """CTY_ANON_ and seven digits for any spelling of such an id; null for anything else, such as a ticker."""
    digits = F.regexp_extract(F.upper(_plain(value)), r"^CTY[\W_]*ANON[\W_]*0*(\d{1,7})$", 1)
    return F.when(digits != "", F.concat(F.lit("CTY_ANON_"), F.lpad(digits, 7, "0")))


def file_name(value: Column) -> Column:
    """The file name in lower case, without folder and padding; null where the value names no file."""
    name = F.lower(_plain(F.regexp_extract(_plain(value), r"([^/\\]*)$", 1)))
    return F.when(name.rlike(r"^.*[^\s.].*\.[a-z0-9]{1,5}$"), name)


def record_entities(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, entity), distinct: the canonical company, by id or by current or former ticker, and ``file:`` names.

    A ticker that is one company's current and another's former one means the current one; among equals the least id.
    """
    tick = lambda c: F.upper(_plain(F.col(c)))
    tickers = companies.select(tick("ticker").alias("t"), canonical_company(F.col("company_id")).alias("c"), F.lit(0).alias("age")).union(companies.select(tick("former_ticker"), canonical_company(F.col("company_id")), F.lit(1)))
    tickers = tickers.where("t <> '' and c is not null").groupBy("t").agg(F.min(F.struct("age", "c"))["c"].alias("by_ticker"))
    rows = records.select(F.col("id"), canonical_company(F.col("company_id")).alias("by_id"), tick("company_id").alias("t"), file_name(F.col("source")).alias("file")).where("id is not null")
    named = rows.join(tickers, "t", "left").select("id", F.coalesce("by_id", "by_ticker").alias("company"), "file")
    return named.select("id", F.explode(F.array("company", F.concat(F.lit("file:"), "file"))).alias("entity")).where("entity is not null").distinct()


def record_groups(records: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, group, group_company, members): each distinct id that names an entity, its group and the group's ids.

    ``group`` is the least entity of the component, ``group_company`` the least canonical company id that it names (null
    if it names none). Null ids give no row, repeated rows count once, ids without an entity are in no group; an empty
    input gives an empty result; extra columns are ignored.
    """
    named = staged(record_entities(records, companies), "entities")
    least = named.groupBy("id").agg(F.min("entity").alias("u"))
    edges = named.join(least, "id").select("u", F.col("entity").alias("v")).distinct()
    labels = components(edges)  # company ids sort before file names, so a label is a company wherever one is named
    of = staged(least.join(labels, F.col("u") == F.col("node")).select("id", F.col("label").alias("group")), "groups")
    sizes = of.groupBy("group").agg(F.count("*").alias("members"))
    return of.join(sizes, "group").select("id", "group", F.when(~F.col("group").startswith("file:"), F.col("group")).alias("group_company"), "members")


def wanted_shares(distribution: DataFrame) -> dict[str, float]:
    """The shares of the newest dataset version, whose numbers are compared as numbers; 70, 15 and 15 % if there is none."""
    numbers = F.transform(F.regexp_extract_all("dataset_version", F.lit(r"(\d{1,18})"), F.lit(1)), lambda x: x.cast("bigint"))
    named = distribution.where("split is not null and share is not null").groupBy("dataset_version").agg(F.collect_list(F.struct("split", "share")).alias("s"))
    newest = named.orderBy(numbers.desc(), F.desc("dataset_version")).first()
    return {r.split: r.share for r in newest.s} if newest else {"train": 0.7, "dev": 0.15, "test": 0.15}


def _placed(units: dict, totals: dict[str, int], shares: dict[str, float]) -> dict:
    """A split for every unit (its records by label): in order of size, where the labels it has lack most.

    Afterwards units move as long as a move makes the deviation less, at most ten times through.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    open_ = {s: {k: v * shares[s] for k, v in totals.items()} for s in names}
    out = {}
    for u in sorted(units, key=lambda u: (-sum(units[u].values()), str(u))):
        # what the squares of all deviations, each as a part of its label, fall by
        gain = lambda s: sum((2 * open_[s][k] - c) * c / totals[k] ** 2 for k, c in units[u].items()) if shares[s] else float("-inf")  # noqa: B023, E731
        out[u] = max(names, key=gain)
        for k, c in units[u].items():
            open_[out[u]][k] -= c
    for _ in range(10):
        moved = False
        for u in sorted(units, key=lambda u: (-sum(units[u].values()), str(u))):
            for k, c in units[u].items():
                open_[out[u]][k] += c
            gain = lambda s: sum((2 * open_[s][k] - c) * c / totals[k] ** 2 for k, c in units[u].items()) if shares[s] else float("-inf")  # noqa: B023, E731
            best = max(names, key=gain)
            if gain(best) > gain(out[u]) + 1e-12:
                out[u], moved = best, True
            for k, c in units[u].items():
                open_[out[u]][k] -= c
        if not moved:
            break
    return out


def _labelled(records: DataFrame) -> DataFrame:
    """(id, label) of every distinct id; the least label of repeated ones."""
    label = F.coalesce(F.upper(F.trim("label")), F.lit("?"))
    return records.where("id is not null").groupBy("id").agg(F.min(label).alias("label"))


def assign_splits(records: DataFrame, companies: DataFrame, distribution: DataFrame) -> DataFrame:
    """(id, split): every distinct non-null id in train, dev or test, groups whole.

    Shares are those of the newest dataset version in ``distribution``. Groups are placed in order of size, each where the
    labels it has are still lacking most: large ones one by one, smaller ones, each under ``LARGE_SHARE`` of the records,
    in bins of groups of one size class and leading label. What reaches the driver is bounded by ``LARGE_SHARE``, ``BINS``
    and ``LABELS``: records by label of each large group and each bin.
    """
    shares = wanted_shares(distribution)
    grouped = record_groups(records, companies)
    ids = _labelled(records).join(grouped.select("id", "group"), "id", "left").select("id", "label", F.coalesce("group", F.concat(F.lit("id:"), "id")).alias("group"))
    ids = staged(ids, "labelled")
    common = [r.label for r in ids.groupBy("label").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "label").limit(LABELS - 1).collect()]
    kept = F.when(F.col("label").isin(common), F.col("label")).otherwise("other") if common else F.lit("other")
    counts = staged(ids.groupBy("group", kept.alias("label")).agg(F.count("*").alias("c")), "counts")
    totals = {r.label: r.c for r in counts.groupBy("label").agg(F.sum("c").alias("c")).collect()}
    every = sum(totals.values())
    sizes = counts.groupBy("group").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label"))["label"].alias("lead"))
    large = F.col("n") >= max(2, every * LARGE_SHARE)
    unit = sizes.select("group", F.when(large, F.col("group")).alias("alone"), F.floor(F.log2("n")).cast("int").alias("class"), "lead", F.pmod(F.xxhash64("group"), F.lit(BINS)).cast("int").alias("bin"))
    unit = unit.select("group", "alone", *(F.when(F.col("alone").isNull(), F.col(c)).alias(c) for c in ("class", "lead", "bin")))
    keys = ["alone", "class", "lead", "bin"]
    units: dict[tuple, dict[str, int]] = {}
    for r in counts.join(unit, "group").groupBy(*keys, "label").agg(F.sum("c").alias("c")).collect():
        units.setdefault(tuple(r[k] for k in keys), {})[r.label] = r.c
    placed = _placed(units, totals, shares)
    chosen = records.sparkSession.createDataFrame([(*u, s) for u, s in placed.items()], "alone string, class int, lead string, bin int, split string")
    same = [unit[k].eqNullSafe(chosen[k]) for k in keys]
    of = unit.join(F.broadcast(chosen), same[0] & same[1] & same[2] & same[3]).select("group", "split")
    return ids.join(of, "group").select("id", "split")


def split_deviation(records: DataFrame, splits: DataFrame, distribution: DataFrame) -> DataFrame:
    """(split, label, records, wanted, deviation): the records of each label in each split, how many its share asks for, and
    the difference as a part of all records of the label. A label that a split lacks has a row with 0 records."""
    shares = wanted_shares(distribution)
    wanted = records.sparkSession.createDataFrame(sorted(shares.items()), "split string, share double")
    of = _labelled(records).join(splits, "id")
    totals = of.groupBy("label").agg(F.count("*").alias("total"))
    cells = totals.join(F.broadcast(wanted)).join(of.groupBy("label", "split").agg(F.count("*").alias("records")), ["label", "split"], "left")
    n, w = F.coalesce("records", F.lit(0)), F.col("total") * F.col("share")
    return cells.select("split", "label", n.alias("records"), w.alias("wanted"), ((n - w) / F.col("total")).alias("deviation"))


def companies_per_split(records: DataFrame, companies: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, records, companies): distinct ids and distinct canonical companies of each split."""
    named = record_entities(records, companies).where(~F.col("entity").startswith("file:")).select("id", F.col("entity").alias("company"))
    of = splits.join(named, "id", "left")
    return of.groupBy("split").agg(F.countDistinct("id").alias("records"), F.countDistinct("company").alias("companies"))
