"""Reading level of every document by harmonic propagation over a similarity graph (problem 9).

Documents of similar shape share nodes. A document's shape is four numbers: the logarithm of its mean sentence length, that
of the length of the sentence that its mean word stands in, its commas a sentence, and the share of its words in long
sentences. Each node is a cell of three of them; four overlapping tilings of cells, of two such triples, link a document
with all whose shape is within a step of its own. The steps are fixed, so the nodes are as many at any size of the corpus.

Documents with levels given by people are clamped to them. Every round sets a node to the mean of its documents and a
document that isn't clamped to the mean of its nodes, graded and ungraded ones counting alike, until no node moves by more
than ``TOLERANCE``. Documents in the same finest cell are alike to the graph, so the rounds run over the distinct cells
with their numbers of documents, and texts are read once. A linear fit of the clamped documents puts what the rounds have
drawn towards the mean back on their scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm import blocks
from veriscope.llm.contamination import comparable, fold_table
from veriscope.llm.shingles import chunks, spans
from veriscope.session import staged

#: Words from which a sentence is long.
LONG = 22
#: Width of a cell in each number, how many cells it has (greater values fall in the last one), and the tilings.
STEPS, CELLS, TILINGS = (0.21, 0.21, 0.21, 0.105), (64, 64, 32, 12), 4
#: Which numbers make the nodes.
TRIPLES = ((0, 2, 3), (0, 1, 3))
#: A node counts this much of a document at the mean level; no node moves by more than the tolerance in the last round.
PRIOR, TOLERANCE, ROUNDS = 0.01, 0.02, 60

_ENDS = np.array([ord(c) for c in ".!?…;"], np.uint32)
_SPACES = np.array([ord(c) for c in " \t\r \x0b\x0c"], np.uint32)
NODES = TILINGS * sum(int(np.prod([CELLS[j] for j in t])) for t in TRIPLES)


def shapes(texts: list[str]) -> np.ndarray:
    """Row per text: the four numbers of its shape; not a number for a text without a word."""
    out = np.full((len(texts), 4), np.nan)
    for lo, hi in chunks([len(t) for t in texts]):
        cp, first, _, _, ends = spans([comparable(t) for t in texts[lo:hi]], fold_table())
        if not len(first):
            continue
        n = hi - lo
        doc = np.searchsorted(ends, first)
        after = np.append(cp[1:], 0).astype(np.uint32)
        stop = np.isin(cp, _ENDS) & (np.isin(after, _SPACES) | (after == 10) | (after == 0)) | (cp == 10) | (cp == 0)
        _, at, size = np.unique(np.cumsum(stop)[first], return_index=True, return_counts=True)
        of = doc[at]  # a text's end is a stop too, so no sentence spans two texts
        sentences, words = np.bincount(of, minlength=n), np.bincount(doc, minlength=n)
        commas = np.bincount(np.searchsorted(ends, np.flatnonzero(cp == 44)), minlength=n)[:n]
        some = words > 0
        k, w = sentences[some], words[some]
        lived = np.bincount(of, weights=size.astype(float) ** 2, minlength=n)[some] / w
        long = np.bincount(of, weights=size * (size >= LONG), minlength=n)[some] / w
        out[np.flatnonzero(some) + lo] = np.stack([np.log2(w / k + 1), np.log2(lived + 1), np.sqrt(commas[some] / k), long], 1)
    return out


def finest(shape: np.ndarray) -> np.ndarray:
    """The number of the finest cell of each shape, a quarter of a step wide; -1 for a text without a word."""
    known = ~np.isnan(shape[:, 0])
    out = np.full(len(shape), -1, np.int64)
    cell = np.zeros(known.sum(), np.int64)
    for j, (step, many) in enumerate(zip(STEPS, CELLS, strict=True)):
        cell = cell * (many * TILINGS) + np.clip(np.floor(shape[known, j] * TILINGS / step), 0, many * TILINGS - 1).astype(np.int64)
    out[known] = cell
    return out


def nodes_of(cell: np.ndarray) -> np.ndarray:
    """Row per finest cell: its nodes, one for each triple and tiling."""
    parts = []
    for many in reversed(CELLS):
        parts.append(cell % (many * TILINGS))
        cell = cell // (many * TILINGS)
    parts.reverse()
    out, base = [], 0
    for triple in TRIPLES:
        for tiling in range(TILINGS):
            node = np.zeros(len(cell), np.int64)
            for k, j in enumerate(triple):
                node = node * CELLS[j] + np.minimum((parts[j] + tiling * (k + 1)) // TILINGS, CELLS[j] - 1)
            out.append(base + node)
            base += int(np.prod([CELLS[j] for j in triple]))
    return np.stack(out, 1) if len(cell) else np.empty((0, len(TRIPLES) * TILINGS), np.int64)


@dataclass
class Levels:
    """The level of every node, the mean level, and how the rounds ended."""

    node: np.ndarray
    known: np.ndarray
    mean: float
    rounds: int
    residual: float

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """The mean of each row's nodes: of those that a level has reached, or else the mean level."""
        w = self.known[nodes].astype(float)
        many = w.sum(1)
        return np.where(many > 0, (w * self.node[nodes]).sum(1) / np.maximum(many, 1), self.mean)


def _sums(classes: DataFrame, at: Levels | None) -> np.ndarray:
    """For every node the documents that count in it and the sum of their levels."""
    shared = classes.sparkSession.sparkContext.broadcast(at)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, now = np.zeros((2, NODES)), shared.value
        for b in batches:
            nodes = nodes_of(b["cell"].values)
            weight, level = b["graded"].values.astype(float), b["given"].values.astype(float)
            if now is not None:
                free = b["n"].values - weight
                weight, level = weight + free, level + free * now.of(nodes)
            for column in nodes.T:
                total[0] += np.bincount(column, weights=weight, minlength=NODES)
                total[1] += np.bincount(column, weights=level, minlength=NODES)
        yield blocks.cut(total.reshape(-1))

    return blocks.joined(classes.mapInPandas(part, "block int, c binary"), 2 * NODES, "<f8").reshape(2, NODES)


def harmonic(classes: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Levels:
    """Levels of the nodes from (cell, n, graded, given): distinct finest cells, their documents, how many are graded and
    the sum of their levels. A round is one pass over the distinct cells; only the nodes' fixed number of sums travels."""
    sums = classes.agg(F.sum("given").alias("s"), F.sum("graded").alias("n")).first()
    mean, now = sums.s / sums.n, None
    for k in range(1, rounds + 1):
        weight, total = _sums(classes, now)
        node = (total + PRIOR * mean) / (weight + PRIOR)
        residual = float(np.abs(node - now.node)[weight > 0].max()) if now is not None else float("inf")
        now = Levels(node, weight > 0, mean, k, residual)
        if residual <= tolerance:
            break
    return now


def reading_levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", level_col: str = "reading_level", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, level, grade): every row's reading level on the scale of the labels, and the nearest whole level.

    A graded document keeps the mean of the levels given to it. Texts that are null or without a word have a null level; so
    have all if there are no labels. Null labels are left out, repeated rows each get the level of their text, an empty
    table gives an empty result, and extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "cell": finest(shapes([t or "" for t in b["t"]]))})

    given = labels.where(F.col(level_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.avg(level_col).alias("y"))
    # ids travel as strings: pandas would turn whole numbers among nulls into floats
    packed = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInPandas(build, "id string, cell bigint")
    graph = staged(packed.join(given, "id", "left"), "graph")
    by = graph.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.count("y").alias("graded"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("given"))
    classes = staged(by, "cells")
    stats = graph.where("cell >= 0").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if stats.lo is None:
        return graph.select(F.col("id").cast(kind).alias(id_col), F.lit(None).cast("double").alias("level"), F.lit(None).cast("int").alias("grade"))
    shared = docs.sparkSession.sparkContext.broadcast(harmonic(classes, rounds))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["s"] = shared.value.of(nodes_of(b["cell"].values))
            yield b[["cell", "s", "n", "graded", "given"]]

    scored = classes.mapInPandas(last, "cell bigint, s double, n bigint, graded bigint, given double")
    # the line through the graded documents, each with the score of its cell
    m = scored.where("graded > 0").agg(*(F.sum(x).alias(k) for k, x in (("w", F.col("graded").cast("double")), ("x", F.col("graded") * F.col("s")), ("y", F.col("given")), ("xx", F.col("graded") * F.col("s") * F.col("s")), ("xy", F.col("given") * F.col("s"))))).first()
    spread = m.xx - m.x * m.x / m.w
    a = (m.xy - m.x * m.y / m.w) / spread if spread > 1e-9 * m.w else 1.0
    b = (m.y - a * m.x) / m.w
    fitted = F.least(F.lit(stats.hi), F.greatest(F.lit(stats.lo), F.col("s") * F.lit(a) + F.lit(b)))
    level = F.when(F.col("cell") >= 0, F.coalesce("y", "fitted"))
    out = graph.join(scored.select("cell", fitted.alias("fitted")), "cell", "left").select(F.col("id").cast(kind).alias(id_col), level.alias("level"))
    return out.select(id_col, "level", F.round("level").cast("int").alias("grade"))
