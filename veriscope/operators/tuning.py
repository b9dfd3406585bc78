"""Search over settings of the linear text model on expanding folds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame

from veriscope.operators import metrics, prep
from veriscope.operators.model import TextModel

GRID = {"c": (0.3, 1.0, 3.0), "vocabulary": (5_000, 20_000)}


def search(df: DataFrame, order: Sequence[str | Column], grid: dict[str, Sequence] | None = None, folds: int = 3, metric: str = "f2", iterations: int = 50) -> list[dict]:
    """Settings with their mean validation metric, best first (the first of the grid on ties).

    Each fold's threshold is chosen on its training rows, so validation rows only judge. A setting whose first fold is
    worse than the median of those before it is pruned.
    """
    grid = grid or GRID
    marked = prep.expanding_folds(df, order, folds).persist()
    out: list[dict] = []
    firsts: list[float] = []
    for values in product(*grid.values()):
        setting = dict(zip(grid, values, strict=True))
        scores = []
        for fold in range(1, folds + 1):
            train, val = (marked.where((marked["fold"] == fold) & (marked["role"] == r)) for r in ("train", "val"))
            m = TextModel(iterations=iterations, **setting).fit(train, train, metric)
            scores.append(metrics.evaluate(m.score(val), (), "label", "raw_score", m.threshold).first()[metric] or 0.0)
            if fold == 1:
                if len(firsts) >= 5 and scores[0] < sorted(firsts)[len(firsts) // 2]:
                    break
                firsts.append(scores[0])
        out.append({**setting, "score": sum(scores) / len(scores), "folds": len(scores)})
    marked.unpersist()
    return sorted(out, key=lambda r: (-(r["folds"] == folds), -r["score"]))
