import math
import random

from pyspark.sql import functions as F

from veriscope.operators import drift, governance, metrics


def brute(y, s, t):
    p = [x >= t for x in s]
    tp = sum(a and b for a, b in zip(y, p, strict=True))
    fp, fn = sum(p) - tp, sum(y) - tp
    pos, neg = [x for x, k in zip(s, y, strict=True) if k], [x for x, k in zip(s, y, strict=True) if not k]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0
    ap = seen = hit = 0
    for v in sorted(set(s), reverse=True):
        n = [k for x, k in zip(s, y, strict=True) if x == v]
        seen, hit = seen + len(n), hit + sum(n)
        ap += sum(n) * hit / seen
    return tp, fp, fn, auc, ap / len(pos) if pos else 0


def test_against_brute_force(spark):
    rnd = random.Random(3)
    y = [rnd.random() < 0.3 for _ in range(300)]
    s = [round(min(1.0, max(0.0, rnd.gauss(0.6 if k else 0.4, 0.2))), 2) for k in y]
    df = spark.createDataFrame([(int(a), b) for a, b in zip(y, s, strict=True)], "label int, score double")
    r = metrics.evaluate(df).first()
    tp, fp, fn, auc, ap = brute(y, s, 0.5)
    assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and math.isclose(r.auc_roc, auc) and math.isclose(r.auprc, ap)
    best = metrics.best_threshold(df).first()
    f2 = lambda t: (lambda a, b, c: 5 * a / (5 * a + 4 * c + b) if a else 0)(*brute(y, s, t)[:3])
    top = max(round(f2(t), 12) for t in set(s))
    assert math.isclose(best.value, top, abs_tol=1e-9) and best.threshold == min(t for t in set(s) if round(f2(t), 12) == top)


def test_degenerate(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    r = metrics.evaluate(one).first()
    assert r.auc_roc == 0 and r.mcc == 0 and r.auprc == 1
    none = spark.createDataFrame([(0, 0.5), (None, 0.1), (0, None)], "label int, score double")
    assert metrics.evaluate(none).first().support == 1
    assert metrics.best_threshold(none).first().threshold == 0.5
    assert metrics.evaluate(none.limit(0)).where("support is not null").count() == 0


def test_mcnemar(spark):
    rows = [(i, m, 1, p) for i in range(20) for m, p in (("a", 1), ("b", int(i < 12)))]
    r = metrics.mcnemar(spark.createDataFrame(rows, "item int, model string, label int, p int"), "item", "model", "label", "p").first()
    assert (r.n11, r.n10, r.n01, r.n00) == (12, 8, 0, 0) and math.isclose(r.statistic, 49 / 8)
    assert math.isclose(metrics.mcnemar_p(3.841458820694124), 0.05, rel_tol=1e-6) and metrics.mcnemar_p(0) == 1


def test_kappa_and_governance(spark):
    df = spark.createDataFrame([("x", 1, 1, 1, "s"), ("x", 0, 0, 1, ""), ("a@b.vn", 1, 1, 1, None), (None, None, 0, 0, "s")], "text string, label int, labeler_a int, labeler_b int, source string")
    k = governance.cohen_kappa(df, "labeler_a", "labeler_b").first()
    assert k.n == 4 and math.isclose(k.kappa, (0.75 - 0.5) / 0.5)
    r = governance.governance_report(df).first()
    assert r.total == 4 and r.duplicates == 1 and r.pii_email == 1 and not r.ready and r.step_2 == "warning"
    assert governance.governance_report(df.limit(0)).first().total == 0


def test_psi(spark):
    base = [0.1] * 10
    df = spark.createDataFrame([(i % 10 / 10 + 0.05,) for i in range(100)] + [(1.0,), (None,)], "p double")
    h = drift.histogram(df, [], "p")
    assert h.first().n == 101
    flat = spark.range(1).select(drift.psi(F.array(*map(F.lit, base)), base).alias("x")).first().x
    assert flat == 0
    assert spark.range(1).select(F.array(*(drift.bin_of(F.lit(v)) for v in (0.0, 0.999, 1.0, -1.0, 2.0))).alias("x")).first().x == [0, 9, 9, 0, 9]


def test_scores_of_any_range(spark):
    """Logits and counts are ranked as probabilities are, and fall into many bins."""
    import random

    rnd = random.Random(1)
    rows = [(i, int(rnd.random() < 0.4), rnd.gauss(0, 5)) for i in range(400)]
    squashed = [(i, y, 1 / (1 + 2.718281828**-s)) for i, y, s in rows]
    schema = "i int, label int, score double"
    a, b = (metrics.evaluate(spark.createDataFrame(r, schema), (), "label", "score", 0.0).first() for r in (rows, squashed))
    assert abs(a.auc_roc - b.auc_roc) < 1e-9 and abs(a.auprc - b.auprc) < 1e-9
