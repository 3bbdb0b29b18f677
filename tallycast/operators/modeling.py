"""Model jobs on Spark ML: preparation, grid search on a time-ordered holdout, calibration, scoring."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycast.functions.numeric import exact_percentiles
from tallycast.operators.metrics import auc, market_weights
from tallycast.operators.snapshots import rolling_columns
from tallycast.operators.trends import TREND_COLUMNS
from tallycast.session import cut, shared_folder

# Model inputs, grids, bounds. The final lifetime volume is unknown at snapshot time and never an input.
NUMERIC_FEATURES = ["price_at_snapshot", "price_deviation_from_half", "days_before_close", "pct_lifetime_elapsed",
                    "duration_days", *rolling_columns()]
POINT_FEATURES = ["price_at_snapshot", "price_deviation_from_half", "days_before_close", "pct_lifetime_elapsed",
                  "duration_days", "price_mean_7d", "price_volatility_7d", "price_change_7d", "price_trend_7d"]
PRICE_ONLY = ["price_at_snapshot"]
LOGISTIC_GRID = [{"C": c, "l1": l1} for l1, c in product([False, True], [0.01, 0.1, 1.0, 10.0, 100.0])]
BOOSTED_GRID = [{"learning_rate": lr, "max_depth": d, "min_child_weight": m}
                for lr, d, m in product([0.01, 0.05, 0.1], [4, 6, 8], [5, 10, 20])]
FOREST_GRID = [{"max_depth": d, "min_samples_leaf": m} for d, m in product([8, 12, 16, 20], [20, 50, 100])]
PROB_FLOOR, PROB_CEIL = 0.001, 0.999
RARE_SHARE = 0.02
SMOKE_FLOOR = 0.80
SEED = 42
#: Bins of a numeric feature in a forest; more where there are more categories.
BINS = 32

#: Rows of a task of a fit or of scoring, and the least that are worth a task.
TASK_ROWS, LEAST_ROWS = 50_000, 2_000

Params = dict[str, float]
Fitter = Callable[[DataFrame, Params], PipelineModel]


def with_trend_features(numeric: list[str]) -> list[str]:
    return numeric + TREND_COLUMNS


def row_weights(df: DataFrame, y: str = "outcome") -> DataFrame:
    """Market weight times class balance; classes are counted without weights."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    n, pos = counts.select("n").scalar(), counts.select("pos").scalar()
    balance = n / (2.0 * F.when(F.col(y) == 1, pos).otherwise(n - pos))
    return market_weights(df).withColumn("weight", F.col("weight") * balance)


def training_table(df: DataFrame) -> DataFrame:
    """Weighted rows, written once: a fit passes over them many times."""
    return cut(row_weights(df))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to tasks by their number: a fit's work a row is large, and tasks by bytes of a compressed table
    would be few. Which rows a task has, and their order, follow from the rows alone, so samples that a fit draws do too."""
    rows = df.count()
    tasks = max(1, -(-rows // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS))
    place = F.xxhash64(*[f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)])
    return df.withColumn("__place", place).repartition(tasks, "__place").sortWithinPartitions("__place").drop("__place")


def collapse_rare(train: DataFrame, other: DataFrame, share: float = RARE_SHARE) -> tuple[DataFrame, DataFrame]:
    """Categories below a share of the train markets, and unseen ones, become `other` in both tables."""
    per_market = train.groupBy("market_id").agg(F.min("category").alias("category"))
    sizes = per_market.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    kept = sizes.filter(F.col("n") / total >= share).select("category", F.lit(True).alias("kept"))

    def collapse(df: DataFrame) -> DataFrame:
        joined = df.join(kept, "category", "left")
        return joined.withColumn("category", F.when(F.col("kept"), F.col("category")).otherwise("other")).drop("kept")

    return collapse(train), collapse(other)


def category_codes(df: DataFrame) -> DataFrame:
    """Ordinal code per category in alphabetical order; one row per category, so a bounded table."""
    found = df.select("category").distinct().agg(F.sort_array(F.collect_set("category")).alias("names"))
    return found.select(F.posexplode("names").alias("code", "category"))


def folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Fold of the row's market: whole markets stay together."""
    digest = F.conv(F.substring(F.md5(F.col("market_id").cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digest % k).cast("int"))


def prepare(df: DataFrame, numeric: list[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric})
    return filled.withColumn("category", F.coalesce("category", F.lit("other")))


def fill_medians(train: DataFrame, other: DataFrame, numeric: list[str]) -> tuple[DataFrame, DataFrame]:
    """Missing numbers become the exact median of the train column, in both tables; 0 where train has none."""
    long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])))
    medians = {r["column"]: r["value"] for r in exact_percentiles(long, ["column"], "value", [0.5]).collect()}

    def fill(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c) or 0.0))) for c in numeric})

    return fill(train), fill(other)


def ordinal_category(train: DataFrame, other: DataFrame, name: str = "category_code") -> tuple[DataFrame, DataFrame]:
    """Alphabetical code of each category of train as a number; categories train lacks, and NULL, are -1."""
    codes = category_codes(train).select("category", F.col("code").cast("double").alias(name))

    def coded(df: DataFrame) -> DataFrame:
        return df.join(codes, "category", "left").withColumn(name, F.coalesce(name, F.lit(-1.0)))

    return coded(train), coded(other)


def standardized(train: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps deviation 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in numeric}


def encoders(numeric: list[str], scale: dict[str, tuple[float, float]] | None = None) -> list:
    """One-hot category (unknown ones all zero) and numeric columns, scaled for linear models."""
    index = StringIndexer(inputCol="category", outputCol="category_code", stringOrderType="alphabetAsc", handleInvalid="keep")
    onehot = OneHotEncoder(inputCol="category_code", outputCol="category_vec", dropLast=True)
    if scale is None:
        return [index, onehot, VectorAssembler(inputCols=[*numeric, "category_vec"], outputCol="features")]
    terms = ", ".join(f"(`{c}` - {scale[c][0]!r}D) / {scale[c][1]!r}D AS `scaled_{c}`" for c in numeric)
    scaler = SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")
    return [index, onehot, scaler, VectorAssembler(inputCols=[*(f"scaled_{c}" for c in numeric), "category_vec"], outputCol="features")]


def stored(model: PipelineModel, df: DataFrame) -> PipelineModel:
    """The model as written to the shared folder and read back. One from a fit holds its training summary, which holds
    the session, and a session with job tags cannot be sent to tasks; a model that was read has no summary."""
    path = f"{shared_folder(df.sparkSession)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel.load(path)


def fit_logistic(numeric: list[str]) -> Fitter:
    """The inverse strength C becomes Spark's penalty per unit of the weight it fits on."""
    def fit(train: DataFrame, p: Params) -> PipelineModel:
        total = train.agg(F.sum("weight")).first()[0]
        model = LogisticRegression(
            labelCol="outcome", weightCol="weight", standardization=False, maxIter=1000, tol=1e-4,
            regParam=1.0 / (p["C"] * total), elasticNetParam=1.0 if p["l1"] else 0.0)
        return stored(Pipeline(stages=[*encoders(numeric, standardized(train, numeric)), model]).fit(dealt(train)), train)
    return fit


def fit_boosted(numeric: list[str], rounds: int = 1000, patience: int = 50, first: int = 64) -> Fitter:
    """Boosting whose number of rounds is the best one on the rows with `is_holdout`.

    Spark cannot go on with a fitted ensemble, so fits double in length until the best round lies more than
    `patience` before the end, or `rounds` is reached; the last fit repeats the chosen number with the same seed,
    which gives the same trees. Without `is_holdout`, or with `n_estimators` given, the number is taken as it is.
    """
    def booster(p: Params, n: int) -> GBTClassifier:
        return GBTClassifier(
            labelCol="outcome", weightCol="weight", maxIter=n, stepSize=p["learning_rate"], maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_child_weight"]), subsamplingRate=0.8, seed=SEED)

    def fit(train: DataFrame, p: Params) -> PipelineModel:
        held = "is_holdout" in train.columns and "n_estimators" not in p
        used = train.filter(~F.col("is_holdout")) if "is_holdout" in train.columns else train
        if not held:
            return Pipeline(stages=[*encoders(numeric), booster(p, int(p.get("n_estimators", rounds)))]).fit(dealt(used))
        ready = Pipeline(stages=encoders(numeric)).fit(used)
        rows, watched = dealt(cut(ready.transform(used))), dealt(cut(ready.transform(train.filter("is_holdout"))))
        n = min(first, rounds)
        while True:
            loss = booster(p, n).fit(rows).evaluateEachIteration(watched)
            best = loss.index(min(loss)) + 1
            if best + patience <= n or n >= rounds:
                break
            n = min(rounds, 2 * n)
        return PipelineModel([*ready.stages, booster(p, best).fit(rows)])
    return fit


def rounds_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def fit_forest(numeric: list[str], trees: int = 300) -> Fitter:
    """Trees split on the category itself: its alphabetical code is one feature, marked as nominal in the vector's
    metadata, so a split parts the categories in two sets. Categories that train lacks share a code of their own."""
    def fit(train: DataFrame, p: Params) -> PipelineModel:
        index = StringIndexer(inputCol="category", outputCol="category_code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
        vector = VectorAssembler(inputCols=[*numeric, "category_code"], outputCol="features")
        model = RandomForestClassifier(
            labelCol="outcome", weightCol="weight", numTrees=trees, featureSubsetStrategy="sqrt", maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]), maxBins=max(BINS, len(index.labels) + 1), maxMemoryInMB=512, seed=SEED)
        return stored(Pipeline(stages=[index, vector, model]).fit(dealt(train)), train)
    return fit


SEARCHES: dict[str, tuple[Callable[[list[str]], Fitter], list[Params]]] = {
    "logistic": (fit_logistic, LOGISTIC_GRID),
    "boosted": (fit_boosted, BOOSTED_GRID),
    "forest": (lambda numeric: fit_forest(numeric, 100), FOREST_GRID),
}


def search(kind: str, numeric: list[str], train: DataFrame, holdout: DataFrame) -> tuple[Params, pd.DataFrame]:
    """The whole grid of a model kind on the holdout; forests are searched with 100 trees."""
    fitter, grid = SEARCHES[kind]
    return grid_search(fitter(numeric), train, holdout, grid)


def check_params(given: Params, expected: set[str]) -> Params:
    """Given settings replace the search only if they name exactly what the search would choose."""
    if set(given) != expected:
        raise ValueError(f"settings need exactly {sorted(expected)}, got {sorted(given)}")
    return given


def scored(model: PipelineModel, df: DataFrame, name: str = "p_raw") -> DataFrame:
    """`df` with the model's probability, written once: no later join or window plans around the model's functions."""
    out = model.transform(dealt(df)).withColumn(name, vector_to_array("probability")[1])
    return cut(out.select(*df.columns, name))


def holdout_auc(model: PipelineModel, holdout: DataFrame) -> float:
    return auc(scored(model, holdout), [], "p_raw").first()["auc"] or 0.0


def grid_search(fit: Fitter, train: DataFrame, holdout: DataFrame, grid: list[Params]) -> tuple[Params, pd.DataFrame]:
    """Settings with the highest holdout AUC, the first on equal AUC. Every fit is a distributed job."""
    rows = []
    for params in grid:
        rows.append({**params, "auc": holdout_auc(fit(train, params), holdout)})
    table = pd.DataFrame(rows)
    return grid[int(table["auc"].idxmax())], table


def fit_calibrator(holdout: DataFrame, p: str = "p_raw", y: str = "outcome", step: float = 1e-6) -> IsotonicRegressionModel:
    """Isotonic fit over scores rounded to `step`, equal ones summed as weights: at most 1 / step + 1 points."""
    points = holdout.groupBy((F.round(F.col(p) / step) * step).alias(p)).agg(F.avg(F.col(y).cast("double")).alias(y), F.count(F.lit(1)).cast("double").alias("n"))
    return IsotonicRegression(featuresCol=p, labelCol=y, weightCol="n").fit(points)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, p: str = "p_raw", name: str = "p") -> DataFrame:
    bounded = F.least(F.greatest(F.col("prediction"), F.lit(PROB_FLOOR)), F.lit(PROB_CEIL))
    return cut(model.transform(df).withColumn(name, bounded).drop("prediction"))


def feature_names(model: PipelineModel, numeric: list[str]) -> list[str]:
    if not any(isinstance(stage, OneHotEncoderModel) for stage in model.stages):
        return [*numeric, "category"]
    labels = model.stages[0].labelsArray[0]
    return numeric + [f"category_{c}" for c in labels]


def importance_table(model: PipelineModel, df: DataFrame, numeric: list[str]) -> DataFrame:
    """(feature, importance): coefficients of a linear model, impurity shares of trees."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = list(zip(feature_names(model, numeric), [float(v) for v in values.toArray()]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


BATCH = 100


def keyword_category(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first category with a keyword in the text, whatever its case, else `other`; no answer for empty text."""
    low, out = F.lower(text), F.lit("other")
    for category, words in reversed(keywords.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, category).otherwise(out)
    return F.when(F.length(text) > 0, out)


def classify_questions(df: DataFrame, classify: Callable[[list[str]], list[str | None]], key: str = "market_id", text: str = "question") -> DataFrame:
    """(key, category) through a plugged-in batch classifier; unanswered rows stay NULL and are picked up by the
    next run. `keyword_category` needs no plug-in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), BATCH):
                part = pdf.iloc[start:start + BATCH]
                yield pd.DataFrame({key: part[key], "category": classify(part[text].tolist())})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {key_type}, category string")


def smoke_fit(train: DataFrame, test: DataFrame, numeric: list[str], n_train: int = 2000, floor: float = SMOKE_FLOOR) -> float:
    """AUC on all test rows of a logistic model fitted on a small fixed sample of `n_train` rows: a check that
    training works, not a result. Raises where the AUC does not exceed `floor`."""
    pick = [F.md5(F.concat_ws(":", F.lit(str(SEED)), "market_id", "snapshot_timestamp")), F.col("market_id")]
    small = cut(prepare(train.orderBy(*pick).limit(n_train), numeric).withColumn("weight", F.lit(1.0)))
    value = holdout_auc(fit_logistic(numeric)(small, {"C": 1.0, "l1": False}), cut(prepare(test, numeric)))
    if value <= floor:
        raise ValueError(f"AUC {value:.3f} does not exceed {floor}")
    return value


def cross_validated_auc(df: DataFrame, fit: Fitter, params: Params, k: int = 5) -> float:
    """Mean AUC over folds of whole markets."""
    rows = folds(df, k)
    scores: list[float] = []
    for i in range(k):
        model = fit(training_table(rows.filter(F.col("fold") != i)), params)
        scores.append(holdout_auc(model, rows.filter(F.col("fold") == i)))
    return sum(scores) / k


def save_model(model: PipelineModel, calibrator: IsotonicRegressionModel, path: str) -> None:
    """Model and calibrator in one folder of any store that Spark writes to."""
    model.write().overwrite().save(f"{path}/model")
    calibrator.write().overwrite().save(f"{path}/calibrator")


def score_saved(path: str, df: DataFrame, name: str = "p") -> DataFrame:
    """`df` scored by a saved model and its calibrator."""
    model, calibrator = PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/calibrator")
    return calibrated(calibrator, scored(model, df), name=name).drop("p_raw")


def label(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")
