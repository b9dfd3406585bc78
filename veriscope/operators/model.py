"""Linear models over text, score layers, the registry of scorers, and full predictions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, Normalizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriscope.functions import features as ft
from veriscope.functions import lexicons as lx
from veriscope.functions import rules as rl
from veriscope.functions import text as tx
from veriscope.operators import explain, metrics
from veriscope.session import staged


#: Terms of a corpus up to which their document counts are broadcast (about 64 MB).
BROADCAST_TERMS = 1_000_000


def tfidf(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf, df, weight): raw counts times ln((1+n)/(1+df))+1, scaled to unit length per row.

    Terms are counted inside each row. Their document counts are broadcast while they are at most ``BROADCAST_TERMS``, so
    that only the scaling shuffles, by key. A repeated key counts as one row.
    """
    d = tx.once(df.select(key, tokens.alias("_t")), _c=tx.counted(F.col("_t")))
    tf = d.select(key, F.inline("_c"))
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        tf = tf.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    n = df.count()
    freq = staged(tf.groupBy("term").agg(F.count("*").alias("df")), "terms")
    if freq.count() <= BROADCAST_TERMS:
        freq = F.broadcast(freq)
    raw = tf.join(freq, "term").withColumn("_w", F.col("tf") * (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", F.col("tf").cast("long").alias("tf"), "df", (F.col("_w") / norm).alias("weight"))


def builder_tfidf(train: DataFrame, rows: DataFrame, key: str, text: str = "text", most: int = 5_000) -> DataFrame:
    """(key, term, weight) of ``rows``: lower-case words of two or more characters, of which the ``most`` frequent ones of
    ``train`` count (the least term on ties) with train's document counts, scaled to unit length per row and rounded to 8
    places. A null text counts as empty and gives no row; keys must be unique."""
    tokens = F.filter(tx.word_tokens(F.coalesce(F.col(text), F.lit(""))), lambda x: F.length(x) >= 2)
    counts = lambda df: tx.once(df.select(key, tokens.alias("_t")), _c=tx.counted(F.col("_t"))).select(key, F.inline("_c"))
    n = train.count()
    kept = counts(train).groupBy("term").agg(F.sum("tf").alias("_f"), F.count("*").alias("_df")).orderBy(F.desc("_f"), "term").limit(most)
    idf = F.broadcast(kept.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("_df"))) + 1).alias("_idf")))  # at most ``most`` rows
    raw = counts(rows).join(idf, "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", F.round(F.col("_w") / norm, 8).alias("weight"))


def top_terms(weights: DataFrame, key: str, weight: str = "weight", k: int = 5) -> DataFrame:
    """(key, term, weight, rank): the k terms of greatest absolute weight, in order of the term on ties."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs(weight), 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "term", weight, "rank")


@dataclass
class TextModel:
    """TF-IDF of words and word pairs with a balanced logistic regression."""

    name: str = "baseline"
    vocabulary: int = 20_000
    c: float = 1.0
    iterations: int = 300
    threshold: float = 0.5
    #: Area under the curve of the validation rows; none where there were none.
    auc: float | None = None
    fitted: PipelineModel | None = None

    def _tokens(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_terms", tx.terms(F.coalesce(F.col("text"), F.lit(""))))

    def fit(self, train: DataFrame, validation: DataFrame | None = None, metric: str = "f2") -> TextModel:
        """Fits on rows with text and label 0 or 1; the threshold is the best of the validation rows."""
        rows = self._tokens(train.where("label is not null")).withColumn("label", (F.col("label") > 0).cast("double"))
        weights = {r.label: r.weight for r in metrics.class_weights(rows).collect()}
        rows = rows.withColumn("_weight", F.when(F.col("label") == 1.0, weights.get(1.0, 1.0)).otherwise(weights.get(0.0, 1.0))).select("_terms", "label", "_weight").persist()
        n = rows.count()
        steps = [
            NGram(n=2, inputCol="_terms", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_terms, _pairs) AS _all FROM __THIS__"),
            CountVectorizer(inputCol="_all", outputCol="_tf", vocabSize=self.vocabulary),
        ]
        counted = Pipeline(stages=steps).fit(rows)
        vectors = counted.transform(rows)
        size = len(counted.stages[-1].vocabulary)
        # inverse document frequency with 1 added, as a diagonal scaling learnt from document counts
        from pyspark.ml.feature import ElementwiseProduct
        from pyspark.ml.linalg import Vectors
        from pyspark.ml.stat import Summarizer

        present = vectors.select(Summarizer.numNonZeros(F.col("_tf")).alias("df")).first().df.toArray() if n else [0.0] * size
        idf = np.log((1 + n) / (1 + np.asarray(present))) + 1
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
        unit = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
        lr = LogisticRegression(weightCol="_weight", regParam=1.0 / (self.c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=self.iterations)
        tail = Pipeline(stages=[scale, unit, lr]).fit(vectors)
        self.fitted = PipelineModel([*counted.stages, *tail.stages])
        rows.unpersist()
        if validation is not None:
            self.threshold = metrics.best_threshold(self.score(validation), (), "label", "raw_score", metric).first().threshold
            self.auc = metrics.evaluate(self.score(validation), (), "label", "raw_score", self.threshold).first().auc_roc
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``raw_score``, the probability of class 1."""
        out = self.fitted.transform(self._tokens(df))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("raw_score"))

    def coefficients(self) -> list[tuple[str, float]]:
        """Terms with their weights, greatest absolute weight first."""
        vocabulary, lr = self.fitted.stages[2].vocabulary, self.fitted.stages[-1]
        return sorted(zip(vocabulary, lr.coefficients.toArray().tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))

    def contributions(self, df: DataFrame, key: str, k: int = 5) -> DataFrame:
        """(key, term, contribution, rank): terms by weight times coefficient."""
        spark = df.sparkSession
        terms = spark.createDataFrame(self.coefficients(), "term string, _c double")
        out = self.fitted.transform(self._tokens(df))
        names = self.fitted.stages[2].vocabulary
        position = spark.createDataFrame(list(enumerate(names)), "_i int, term string")
        long = out.select(key, F.posexplode(vector_to_array("features")).alias("_i", "_v")).where("_v <> 0").join(position, "_i").join(terms, "term")
        return top_terms(long.withColumn("contribution", F.col("_v") * F.col("_c")), key, "contribution", k)

    def save(self, path: str) -> None:
        """The pipeline in ``path``/model and a side-car beside it: what scoring needs besides the pipeline."""
        self.fitted.write().overwrite().save(f"{path}/model")
        side = {"name": self.name, "threshold": float(self.threshold), "vocabulary": self.vocabulary, "c": self.c, "iterations": self.iterations, "auc": self.auc}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side_car")

    def load(self, path: str, threshold: float | None = None) -> TextModel:
        """The model as saved; ``threshold`` overrides the one that was tuned."""
        side = json.loads(SparkSession.active().read.text(f"{path}/side_car").first().value)
        for k, v in side.items():
            setattr(self, k, v)
        self.fitted = PipelineModel.load(f"{path}/model")
        if threshold is not None:
            self.threshold = threshold
        return self


def load_or_train(path: str, train: DataFrame, validation: DataFrame) -> TextModel:
    """The model saved at ``path``, unless there is none or it has collapsed (its area is under 0.6 or unknown): then one is
    trained and saved there."""
    try:
        m = TextModel().load(path)
    except AnalysisException:
        m = None
    if m is None or metrics.collapsed(m.auc):
        m = TextModel().fit(train, validation)
        m.save(path)
    return m


@dataclass
class HybridHead:
    """Logistic regression over the text score and the metadata features; scoring is a Column of constants."""

    names: Sequence[str] = field(default_factory=lambda: ["raw_score", *ft.METADATA])
    mean: Sequence[float] = ()
    scale: Sequence[float] = ()
    coefficients: Sequence[float] = ()
    intercept: float = 0.0

    def fit(self, df: DataFrame) -> HybridHead:
        """Fits on rows with ``label`` and the named columns; left as identity where only one class occurs."""
        rows = df.where("label is not null").withColumn("label", (F.col("label") > 0).cast("double"))
        weights = {r.label: r.weight for r in metrics.class_weights(rows).collect()}
        if len(weights) < 2:
            return self
        stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in self.names), *(F.stddev_pop(c).alias(f"s_{c}") for c in self.names), F.count("*").alias("n")).first()
        self.mean, self.scale = [stats[f"m_{c}"] for c in self.names], [stats[f"s_{c}"] or 1.0 for c in self.names]
        z = rows.select("label", F.when(F.col("label") == 1.0, weights[1.0]).otherwise(weights[0.0]).alias("_w"), *(((F.col(c) - m) / s).alias(c) for c, m, s in zip(self.names, self.mean, self.scale, strict=True)))
        data = VectorAssembler(inputCols=list(self.names), outputCol="features").transform(z)
        lr = LogisticRegression(weightCol="_w", regParam=1.0 / max(stats.n, 1), standardization=False, maxIter=200).fit(data)
        self.coefficients, self.intercept = lr.coefficients.toArray().tolist(), lr.intercept
        return self

    def column(self) -> Column:
        """The score; null where the head isn't fitted, so that the text score stands."""
        if not self.coefficients:
            return F.lit(None).cast("double")
        return ft.hybrid_score([F.col(c) for c in self.names], self.mean, self.scale, self.coefficients, self.intercept)


def rolled_up(chunks: DataFrame, key: str, score: str, length: str) -> DataFrame:
    """(key, score): 0.6 of the greatest chunk score and 0.4 of the mean weighted by length."""
    return chunks.groupBy(key).agg((F.lit(0.6) * F.max(score) + F.lit(0.4) * F.sum(F.col(score) * F.col(length)) / F.nullif(F.sum(length).cast("double"), F.lit(0.0))).alias("score"))


def best_chunk(chunks: DataFrame, key: str, score: str, position: str, value: str) -> DataFrame:
    """(key, value): the chunk of greatest score, the first on ties."""
    return chunks.groupBy(key).agg(F.max_by(value, F.struct(score, -F.col(position))).alias(value))


def external_scores(df: DataFrame, scorer: Callable[[list[str]], Sequence[float]], text: str = "text") -> DataFrame:
    """Adds ``raw_score`` from any batch scorer, such as a neural network, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scorer(s.fillna("").tolist()), index=s.index)

    return df.withColumn("raw_score", run(F.col(text)))


class Registry:
    """Scorers by name; the names are the caller's, and an unknown name is an error."""

    def __init__(self, names: Sequence[str] = ("baseline",)):
        self.names = tuple(names)
        self._made: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
        if name not in self.names:
            raise KeyError(name)
        self._made[name] = scorer

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        if name not in self.names:
            raise KeyError(name)
        if name not in self._made:
            raise LookupError(f"{name} has no scorer here")
        return self._made[name]

    def compare(self, df: DataFrame, key: str) -> DataFrame:
        """(key, model, status, raw_score) of every registered model; those without a scorer are ``missing``."""
        out = None
        for name in self.names:
            rows = self._made[name](df).select(key, F.lit(name).alias("model"), F.lit("ok").alias("status"), "raw_score") if name in self._made else df.select(key, F.lit(name).alias("model"), F.lit("missing").alias("status"), F.lit(None).cast("double").alias("raw_score"))
            out = rows if out is None else out.unionByName(rows)
        return out


def predictions(df: DataFrame, threshold: float, model: str = "baseline", labels: Mapping[int, str] | None = None) -> DataFrame:
    """The full result of rows with ``text``, ``raw_score`` and optional ``hybrid_score``; numbers to four places."""
    # Names of the two outcomes.
    labels = labels or {1: "Cảnh báo rủi ro", 0: "Bình thường"}
    base = df if "hybrid_score" in df.columns else df.withColumn("hybrid_score", F.lit(None).cast("double"))
    base = ft.with_metadata_features(base)
    base = base.withColumn("_fold", tx.fold(F.coalesce("text", F.lit("")))).withColumn("red_flags", rl.red_flags(F.col("_fold"))).drop("_fold")
    base = base.withColumn("score_breakdown", rl.score_breakdown(F.col("raw_score"), F.col("hybrid_score"), F.col("red_flags"), F.lit(float(threshold))))
    s, y = F.col("score_breakdown.final_score"), F.col("score_breakdown.predicted_label")
    four = lambda c: F.bround(c, 4)
    name = F.when(y == 1, labels[1]).otherwise(labels[0])
    made = {
        "model": F.lit(model), "label": name, "legacy_label": F.when(y == 1, "Gian lận").otherwise("Bình thường"), "label_int": y, "risk_label": F.when(y == 1, "Rủi ro cao").otherwise("Rủi ro thấp"), "risk_label_int": y,
        "muc_do_rui_ro": rl.risk_band(s), "fraud_probability": four(s), "fraud_risk_probability": four(s), "non_fraud_probability": four(1 - s), "model_fraud_probability": four(F.col("score_breakdown.hybrid_metadata_score")),
        "raw_text_probability": four(F.col("raw_score")), "hybrid_probability": four(F.coalesce("hybrid_score", "raw_score")), "threshold_used": F.lit(round(float(threshold), 4)), "chat_luong_van_ban": four(F.col("ocr_quality")),
        "van_ban_sach": tx.clean(F.coalesce("text", F.lit(""))), "doan_nghi_ngo": rl.suspicious_segments(F.coalesce("text", F.lit("")), flags=F.col("red_flags")),
        "bias_flags": rl.bias_flags(F.col("ocr_quality"), F.col("digit_ratio"), F.col("log_char_len"), F.col("red_flag_count"), F.col("english_keyword_ratio")),
        "metadata_features": F.create_map(*(x for n in ft.METADATA for x in (F.lit(n), four(F.col(n))))),
    }
    # The sentences of an explanation.
    terms = F.col("top_terms") if "top_terms" in df.columns else F.array().cast("array<string>")
    lines = [
        F.when(F.size("red_flags") > 0, F.concat(F.lit("Các red flags theo rule-based: "), F.array_join("red_flags", ", "))),
        F.format_string("Xác suất gian lận của mô hình: %.3f", F.col("raw_score")), F.format_string("Điểm rủi ro sau rule-based: %.3f", s), F.format_string("Chất lượng văn bản/OCR: %.3f", F.col("ocr_quality")),
        F.when(F.size(terms) > 0, F.concat(F.lit("Từ khóa tác động mạnh: "), F.array_join(terms, ", "))),
    ]
    made["explanation"] = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return base.withColumns(made).drop(*ft.METADATA)


def full_predictions(model: TextModel, df: DataFrame, key: str, head: HybridHead | None = None, threshold: float | None = None, terms: int = 5) -> DataFrame:
    """The whole chain for rows with ``text``: text score, hybrid head where one is fitted, rules, and an explanation by the
    terms that weigh most in the linear model. Keys must be unique and not null."""
    scored = model.score(df)
    if head is not None and head.coefficients:
        scored = ft.with_metadata_features(scored).withColumn("hybrid_score", head.column()).drop(*ft.METADATA)
    by = explain.linear_attributions(model.contributions(df, key, 4 * terms), key).where(F.col("rank") <= terms)
    why = explain.chosen(df, key, {"tfidf_logreg_contribution": by})
    shown = by.groupBy(key).agg(explain.highlighted(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "score"))), lambda x: F.struct(x["term"].alias("term"), x["score"].alias("weight")))).alias("highlight"))
    why = why.join(shown, key, "left")
    return predictions(scored.join(why, key), model.threshold if threshold is None else threshold, model.name).withColumnRenamed("method", "explanation_method")


@dataclass
class DescentModel:
    """Logistic regression of term shares by batch gradient descent, as a check on the solver's.

    Fits on at most ``sample`` labelled rows, those of least hash, which bounds what reaches the driver; scoring is a join of
    term weights. A term's value is its share of the text's terms times ln((1+n)/(1+df))+1.
    """

    rate: float = 0.25
    epochs: int = 500
    vocabulary: int = 5_000
    sample: int = 2_000
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def fit(self, df: DataFrame) -> DescentModel:
        rows = df.where("label is not null").select(tx.terms(F.coalesce("text", F.lit(""))).alias("_t"), (F.col("label") > 0).cast("int").alias("y"), F.xxhash64("text").alias("_h")).orderBy("_h").limit(self.sample).toPandas()
        count: dict[str, int] = {}
        for t in rows["_t"]:
            for w in set(t):
                count[w] = count.get(w, 0) + 1
        names = sorted(count, key=lambda w: (-count[w], w))[: self.vocabulary]
        at, n = {w: i for i, w in enumerate(names)}, len(rows)
        x = np.zeros((n, len(names)), np.float32)
        for i, t in enumerate(rows["_t"]):
            for w in t:
                if w in at:
                    x[i, at[w]] += 1 / len(t)
        idf = np.log((1 + n) / (1 + np.array([count[w] for w in names], float))) + 1
        x *= idf.astype(np.float32)
        y = rows["y"].values.astype(float)
        each = np.where(y > 0, n / max(2 * y.sum(), 1), n / max(2 * (n - y.sum()), 1))
        w, b = np.zeros(len(names)), 0.0
        for _ in range(self.epochs):
            g = each * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
            w -= self.rate * (x.T @ g) / max(n, 1)
            b -= self.rate * g.mean() if n else 0.0
        self.weights, self.bias = dict(zip(names, (w * idf).tolist(), strict=True)), float(b)
        return self

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """Adds ``raw_score``; a text without a known term has that of the bias. Keys must be unique."""
        weights = F.broadcast(df.sparkSession.createDataFrame(list(self.weights.items()), "term string, _w double"))  # at most ``vocabulary`` rows
        t = tx.once(df.select(key, tx.terms(F.coalesce("text", F.lit(""))).alias("_t")), _c=tx.counted(F.col("_t")))
        z = t.select(key, F.size("_t").alias("_n"), F.inline("_c")).join(weights, "term").groupBy(key).agg(F.sum(F.col("tf") / F.col("_n") * F.col("_w")).alias("_z"))
        return df.join(z, key, "left").withColumn("raw_score", 1 / (1 + F.exp(-(F.coalesce("_z", F.lit(0.0)) + self.bias)))).drop("_z")


def metadata_only(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with ``raw_score`` by a head that sees the metadata features alone, its scaling learnt on ``train``."""
    seen = staged(ft.with_metadata_features(train).select("label", *ft.METADATA), "features")  # fitting reads them many times
    head = HybridHead(list(ft.METADATA)).fit(seen)
    return ft.with_metadata_features(test).withColumn("raw_score", head.column()).drop(*ft.METADATA)
