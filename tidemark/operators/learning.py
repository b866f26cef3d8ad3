"""Labels, validation figures, clustering and classification of feature vectors, by MLlib and ``models``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, remove
from . import models


def auto_label(score: Column, negative: Column, low: float = 0.49, high: float = 0.55) -> Column:
    """1 from ``high`` up, 0 up to ``low``, null between; always 0 where ``negative`` holds."""
    return F.when(negative, 0).when(score >= high, 1).when(score <= low, 0)


def auc(df: DataFrame, score: str, label: str, group: Sequence[str]) -> DataFrame:
    """``group, n, n_positive, auc`` by rank sums with mean ranks for ties; null where a class is missing.

    Ranks come from counts per distinct score, so a window holds distinct scores and not rows.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = known.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = per.withColumn("rank", below + (F.col("n") + 1) / 2).groupBy(*group).agg(F.sum("n").alias("n"), F.sum("p").alias("n_positive"), F.sum(F.col("rank") * F.col("p")).alias("__r"))
    p, n = F.col("n_positive"), F.col("n")
    return g.select(*group, "n", "n_positive", F.round(F.try_divide(F.col("__r") - p * (p + 1) / 2, p * (n - p)), 6).alias("auc"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``class, support, precision, recall, f1`` (0 where undefined), from one small table of counts."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    per = counts.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("t")))).alias("r"))
    g = per.select("r.*").groupBy("class").agg(F.sum("s").alias("support"), F.sum("q").alias("q"), F.sum("t").alias("t"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    t, s, q = F.col("t"), F.col("support"), F.col("q")
    return g.select("class", "support", ratio(t, q).alias("precision"), ratio(t, s).alias("recall"), ratio(2 * t, s + q).alias("f1"))


def doubles(vector: str) -> Column:
    return array_to_vector(F.transform(vector, lambda v: v.cast("double")))


def reduced(df: DataFrame, vector: str, components: int, to: str = "reduced", unit: bool = True) -> tuple[DataFrame, float]:
    """``df`` and its (unit) vectors' centred principal components, written as a table as several fits read it, and
    the share of the variance that these explain. There are as many components as rows and places allow."""
    n, d = df.agg(F.count("*"), F.max(F.size(vector))).first()
    x = df.withColumn("__x", doubles(vector))
    x = Normalizer(p=2.0, inputCol="__x", outputCol="__unit").transform(x) if unit else x.withColumn("__unit", F.col("__x"))
    x, path = materialize(x.drop("__x"), "unit-vectors")
    x = StandardScaler(withMean=True, withStd=False, inputCol="__unit", outputCol="__centred").fit(x).transform(x)
    model = PCA(k=max(1, min(components, n, d)), inputCol="__centred", outputCol=to).fit(x)
    out, _ = materialize(model.transform(x).drop("__unit", "__centred"), "reduced-vectors")
    remove(df.sparkSession, path)
    return out, float(sum(model.explainedVariance))


def _arrays(df: DataFrame, vector: str, components: int) -> DataFrame:
    """``df`` and ``__x``: its vectors' principal components as arrays."""
    return reduced(df, vector, components, "__r")[0].withColumn("__x", vector_to_array("__r")).drop("__r")


def clusters(df: DataFrame, vector: str, k: int, components: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """``df`` and ``cluster``: the best of ``starts`` runs of k-means on the principal components."""
    x = _arrays(df, vector, components)
    return models.assigned(x, "__x", models.best(models.kmeans(x, "__x", [k], starts, seed), k)).drop("__x")


def elbow(df: DataFrame, vector: str, components: int, most: int = 15, seed: int = 42, starts: int = 10) -> DataFrame:
    """``k, inertia`` for k from 2 to below ``most`` (or the number of rows): the best of ``starts`` each, all fitted side by side."""
    x = _arrays(df, vector, components)
    sizes = list(range(2, min(most, x.count())))
    fitted = models.kmeans(x, "__x", sizes, starts, seed) if sizes else {}
    return df.sparkSession.createDataFrame([(k, models.best(fitted, k).inertia) for k in sizes], "k int, inertia double")


def classifier(df: DataFrame, vector: str, label: str, c: float = 0.1, rounds: int = 1000):
    """A fitted (scaler, logistic regression): balanced weights, ridge strength 1 / (c * weight)."""
    x, path = materialize(df.select(doubles(vector).alias("__x"), F.col(label).cast("double").alias("label")), "training-rows")
    n = {r["label"]: r["count"] for r in x.groupBy("label").count().collect()}  # two classes
    x = x.withColumn("__w", F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__s").fit(x)
    model = LogisticRegression(featuresCol="__s", weightCol="__w", regParam=1 / (c * sum(n.values())), maxIter=rounds, standardization=False).fit(scaler.transform(x))
    remove(df.sparkSession, path)
    return scaler, model


def save_classifier(fitted, path: str) -> None:
    """Keeps a fitted classifier, replacing what is there."""
    for part, name in zip(fitted, ("scaler", "model"), strict=True):
        part.write().overwrite().save(f"{path}/{name}")


def load_classifier(path: str):
    return StandardScalerModel.load(f"{path}/scaler"), LogisticRegressionModel.load(f"{path}/model")


def session_report(df: DataFrame, fitted, vector: str, session: str, t: str, events: DataFrame, reach: int, least: float = 0.5) -> DataFrame:
    """``session, n, occupancy, event_max`` of sessions scored by a classifier: the share of rows of ``least`` or more, and
    the highest score within ``reach`` of the session's event (``events``: ``session, at``; 0 where there is none)."""
    s = scored(df.select(session, t, vector), vector, fitted).join(events.select(session, F.col("at").alias("__at")), session, "left")
    near = F.when(F.col(t).between(F.col("__at") - reach, F.col("__at") + reach), F.col("score"))
    return s.groupBy(session).agg(F.count("*").alias("n"), F.avg((F.col("score") >= least).cast("double")).alias("occupancy"), F.coalesce(F.max(near), F.lit(0.0)).alias("event_max"))


def scored(df: DataFrame, vector: str, fitted) -> DataFrame:
    """``df`` and ``score``, the probability of class 1. It is computed from the model's coefficients: a model that was just
    fitted holds its session by its summary, and a session that has observed metrics can't be sent to tasks."""
    scaler, model = fitted
    x = scaler.transform(df.withColumn("__x", doubles(vector)))
    weighed = F.zip_with(vector_to_array("__s"), F.lit(model.coefficients.toArray().tolist()), lambda v, c: v * c)
    logit = F.aggregate(weighed, F.lit(float(model.intercept)), lambda total, v: total + v)
    return x.withColumn("score", 1 / (1 + F.exp(-logit))).drop("__x", "__s")


def leave_one_group_out(df: DataFrame, vector: str, label: str, group: str) -> DataFrame:
    """``group, n, n_positive, auc`` of models trained on all other groups; groups whose training rows have
    one class are skipped. The models of all groups are fitted side by side (``models.group_folds``)."""
    df, _ = materialize(df.select(group, vector, label), "labelled-vectors")
    folds = models.group_folds(df, vector, label, group)
    return auc(models.fold_scores(df, folds, vector, label, group), "score", "truth", ["group"])
