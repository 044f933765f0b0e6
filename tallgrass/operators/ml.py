"""Models and preparation of features by name, on Spark's own machine learning library.

A model takes plain columns: `fit` assembles them, and the fitted pipeline's `transform` adds `prediction`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as CL
from pyspark.ml import clustering as CU
from pyspark.ml import evaluation as EV
from pyspark.ml import feature as FE
from pyspark.ml import regression as RE
from pyspark.ml import tuning as TU
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

#: Estimators by name.
MODELS = {
    "linear_regression": RE.LinearRegression,
    "tree_regressor": RE.DecisionTreeRegressor,
    "forest_regressor": RE.RandomForestRegressor,
    "boosting_regressor": RE.GBTRegressor,
    "logistic_regression": CL.LogisticRegression,
    "tree_classifier": CL.DecisionTreeClassifier,
    "forest_classifier": CL.RandomForestClassifier,
    "boosting_classifier": CL.GBTClassifier,
    "perceptron_classifier": CL.MultilayerPerceptronClassifier,
    "kmeans": CU.KMeans,
}

#: Preparations by name: their input is a vector of the assembled columns.
SCALERS = {"standard": lambda i, o: FE.StandardScaler(inputCol=i, outputCol=o, withMean=True, withStd=True), "minmax": lambda i, o: FE.MinMaxScaler(inputCol=i, outputCol=o)}


def estimator(name: str, features: list[str], label: str | None = None, scaler: str | None = None, polynomial: int = 1, **parameters: object) -> Pipeline:
    """Assemble, expand to products up to a degree, scale, then the model. Rows with a missing feature are skipped."""
    stages, at = [FE.VectorAssembler(inputCols=features, outputCol="_features0", handleInvalid="skip")], "_features0"
    if polynomial > 1:
        stages.append(FE.PolynomialExpansion(degree=polynomial, inputCol=at, outputCol="_features1"))
        at = "_features1"
    if scaler is not None:
        stages.append(SCALERS[scaler](at, "_features2"))
        at = "_features2"
    supervised = {"labelCol": label} if label is not None else {}
    return Pipeline(stages=[*stages, MODELS[name](featuresCol=at, **supervised, **parameters)])


def fit(df: DataFrame, name: str, features: list[str], label: str | None = None, **parameters: object) -> PipelineModel:
    return estimator(name, features, label, **parameters).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df's columns and prediction."""
    return model.transform(df).select(*df.columns, "prediction")


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """By a hash of a key: reruns and retried tasks agree, and rows of one key stay together."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(test * 1_000_000)
    return df.where(~at), df.where(at)


def grid_search(df: DataFrame, name: str, features: list[str], label: str, grid: Mapping[str, list], metric: str, folds: int = 3, seed: int = 0) -> TU.CrossValidatorModel:
    """Cross-validated choice over all combinations of the grid's parameters of the model."""
    pipeline = estimator(name, features, label)
    builder = TU.ParamGridBuilder()
    for parameter, values in grid.items():
        builder = builder.addGrid(getattr(pipeline.getStages()[-1], parameter), values)
    judge = (EV.RegressionEvaluator if metric in ("rmse", "mse", "mae", "r2", "var") else EV.MulticlassClassificationEvaluator)(labelCol=label, metricName=metric)
    return TU.CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=judge, numFolds=folds, seed=seed).fit(df)


def regression_report(df: DataFrame, label: str, guess: str = "prediction") -> DataFrame:
    return stats.regression_metrics(df, label, guess)


def select_k_best(df: DataFrame, features: list[str], label: str, k: int, categorical_label: bool = True) -> list[str]:
    """The k columns with the best F score."""
    vectors = FE.VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df)
    selector = FE.UnivariateFeatureSelector(featuresCol="_v", labelCol=label, outputCol="_s", selectionMode="numTopFeatures")
    model = selector.setFeatureType("continuous").setLabelType("categorical" if categorical_label else "continuous").setSelectionThreshold(k).fit(vectors)
    return [features[i] for i in sorted(model.selectedFeatures)]


def pca(df: DataFrame, features: list[str], k: int, out: str = "components") -> DataFrame:
    """df's columns and an array of the first k principal components (of centred values)."""
    from pyspark.ml.functions import vector_to_array

    steps = [FE.VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip"), FE.StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), FE.PCA(k=k, inputCol="_c", outputCol="_p")]
    return Pipeline(stages=steps).fit(df).transform(df).select(*df.columns, vector_to_array("_p").alias(out))


# --- preparation as columns: no vectors, one pass of aggregates ---


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / standard deviation of the population; a constant column becomes 0."""
    m = df.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    part = lambda i, c: F.when(F.col(f"_s{i}") > 0, (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")).when(F.col(c).isNotNull(), 0.0)
    return df.crossJoin(F.broadcast(m)).withColumns({c: part(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def minmax_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    m = df.agg(*[f(c).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))])
    part = lambda i, c: F.when(F.col(f"_b{i}") > F.col(f"_a{i}"), low + (high - low) * (F.col(c) - F.col(f"_a{i}")) / (F.col(f"_b{i}") - F.col(f"_a{i}"))).when(F.col(c).isNotNull(), low)
    return df.crossJoin(F.broadcast(m)).withColumns({c: part(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def impute(df: DataFrame, columns: list[str], how: str = "mean") -> DataFrame:
    """NULL becomes the column's mean, median or most frequent value (the least on ties)."""
    pick = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "mode": lambda c: F.mode(c, True)}[how]
    m = df.agg(*[pick(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m{i}")) for i, c in enumerate(columns)}).select(*df.columns)


def polynomial_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds all products of two of the columns, squares included, as a_x_b."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i:]])


def choose_model(df: DataFrame, features: list[str], label: str, candidates: Mapping[str, Mapping[str, list]], metric: str, folds: int = 3, seed: int = 0) -> tuple[str, PipelineModel, dict[str, float]]:
    """Name and fitted pipeline of the candidate (name to grid) with the best cross-validated metric, and all metrics."""
    lower = metric in ("rmse", "mse", "mae")
    scores, models = {}, {}
    for name, grid in candidates.items():
        searched = grid_search(df, name, features, label, grid, metric, folds, seed)
        scores[name], models[name] = (min if lower else max)(searched.avgMetrics), searched.bestModel
    best = (min if lower else max)(scores, key=lambda n: scores[n])
    return best, models[best], scores
