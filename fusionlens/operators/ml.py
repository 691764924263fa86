"""Model training: split, preparation, the candidate ladder, metrics, artifacts.

Fitting is a set of distributed jobs over a table that is split and
written once for each scenario (``prepare``) and encoded as it is read; prediction plus metrics is one
scan ending in the small confusion aggregate of ``evaluation``. The driver
only sees parameters and the per-class label list.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusionlens.contract import CATEGORICAL, MODEL_LADDER, TARGET, TEXT, scenario_columns, usable_columns
from fusionlens.operators import evaluation
from fusionlens.operators.ensembles import TreeEnsemble
from fusionlens.operators.order_stats import exact_quantiles
from fusionlens.operators.projections import model_frame
from fusionlens.operators.trees import BoostSettings, ForestSettings
from fusionlens.session import shared_path
from fusionlens.sources import files

MODEL_TYPES = list(MODEL_LADDER)

# Reference hyper-parameters (fixed values)
LOGISTIC = {"maxIter": 2000, "C": 1.0}
FOREST = {"trees": 300, "min_leaf": 2, "max_depth": None}
BOOSTING = {"rounds": 300, "rate": 0.05, "l2": 0.1}
# Rows of a file of split rows. A task that fits takes some 30 files at most (each counts 4 MB beside its
# bytes), so what it holds decoded does not grow with the table, however well a file is compressed
FILE_ROWS = 50_000
QUICK_FOREST = {"trees": 50, "max_depth": 6, "min_leaf": 1}


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "Sample_ID",
                     label: str = TARGET) -> DataFrame:
    """Add ``is_test``: the share ``test_size`` (rounded) of each class, by a hash of the id as text.

    The hash orders the rows of a class at random. Its first three hex digits
    cut a class into 4096 ranges whose counts say where the held-out share
    ends; only the rows of that one range are ranked, so no task sorts a class.
    If a class has a single row, the table is split as a whole.
    """
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("__h", key).withColumn("__r", F.substring("__h", 1, 3))
    counts = rows.groupBy(F.col(label).alias("__class"), "__r").agg(F.count(F.lit(1)).alias("__n"))
    least = counts.groupBy("__class").agg(F.sum("__n").alias("n")).agg(F.min("n").alias("least")).scalar()
    stratum = F.when(least >= 2, F.col("__class"))
    by_range = Window.partitionBy("__stratum").orderBy("__r")
    ranges = counts.withColumn("__stratum", stratum).groupBy("__stratum", "__r").agg(F.sum("__n").alias("__n"))
    ranges = ranges.withColumn("__upto", F.sum("__n").over(by_range)).withColumn(
        "__want", F.floor(F.sum("__n").over(Window.partitionBy("__stratum")) * F.lit(test_size) + 0.5))
    ranges = ranges.select("__stratum", "__r", (F.col("__want") - (F.col("__upto") - F.col("__n"))).alias("__room"), "__n")
    # at most 4096 ranges for each class: the label domain bounds this side. Named, as its size is not known
    # before it runs: the rows would be shuffled beside it
    marked = rows.withColumn("__stratum", F.when(least >= 2, F.col(label))).join(
        F.broadcast(ranges.withColumnsRenamed({"__stratum": "__s2", "__r": "__r2"})),
        F.col("__stratum").eqNullSafe(F.col("__s2")) & (F.col("__r") == F.col("__r2")))
    edge = (F.col("__room") > 0) & (F.col("__room") < F.col("__n"))
    whole = marked.where(~edge).withColumn("is_test", F.col("__room") >= F.col("__n"))
    place = F.row_number().over(Window.partitionBy("__stratum").orderBy("__h"))
    cut = marked.where(edge).withColumn("is_test", place <= F.col("__room"))
    return whole.unionByName(cut).select(*df.columns, "is_test")


def with_class_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    return evaluation.class_weights(df, label, "class_weight")


def category_modes(train: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per categorical column (ties: sorted first); one small row."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["feature"]: r["mode"] for r in best.collect()}  # one row per categorical column


def imputation(train: DataFrame, features: list[str]) -> SQLTransformer:
    """A pipeline stage that fills numbers with the training median and categories with the mode.

    The values are computed in Spark (``order_stats``) and become literals of the
    stage, so a saved pipeline fills as training did. NaN counts as missing; a
    column without any value is filled with 0 or "Missing".
    """
    cats = [c for c in CATEGORICAL if c in features]
    nums = [c for c in features if c not in cats]
    median = {r["feature"]: r["median"] for r in exact_quantiles(train, nums, {"median": 0.5})}
    mode = category_modes(train, cats) if cats else {}
    filled = [f"coalesce(CASE WHEN isnan(CAST(`{c}` AS DOUBLE)) THEN NULL ELSE CAST(`{c}` AS DOUBLE) END, "
              f"CAST('{median.get(c, 0.0)!r}' AS DOUBLE)) AS `{c}__imp`" for c in nums]
    escape = lambda text: text.replace("\\", "\\\\").replace("'", "\\'")
    filled += [f"coalesce(`{c}`, '{escape(mode.get(c, 'Missing'))}') AS `{c}__imp`" for c in cats]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def preparation(train: DataFrame, features: list[str]) -> list:
    """Stages that every model shares: label index, imputation, one-hot categoricals, the vector of numbers."""
    cats = [c for c in CATEGORICAL if c in features]
    nums = [c for c in features if c not in cats]
    stages = [
        StringIndexer(inputCol=TARGET, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"),
        imputation(train, features),
    ]
    if cats:
        stages += [
            StringIndexer(inputCols=[f"{c}__imp" for c in cats], outputCols=[f"{c}__idx" for c in cats], stringOrderType="alphabetAsc",
                          handleInvalid="keep"),
            # dropLast removes exactly the "unknown" slot: unseen categories encode as all zeros
            OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__oh" for c in cats], dropLast=True),
        ]
    return stages + [VectorAssembler(inputCols=[f"{c}__imp" for c in nums], outputCol="num_vec", handleInvalid="keep")]


def classifier(features: list[str], model_type: str, n_weight: float, seed: int = 42, params: dict | None = None) -> list:
    """The stages of one model after ``preparation``; ``params`` override the reference's settings."""
    onehot = [f"{c}__oh" for c in CATEGORICAL if c in features]
    scaled = model_type == "logistic_regression"
    stages = [StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True)] if scaled else []
    stages.append(VectorAssembler(inputCols=["num_scaled" if scaled else "num_vec", *onehot], outputCol="features"))
    if scaled:
        p = {**LOGISTIC, **(params or {})}
        stages.append(LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="class_weight", family="multinomial", maxIter=p["maxIter"],
            regParam=1.0 / (p["C"] * max(n_weight, 1.0)), elasticNetParam=0.0, standardization=False))
    elif model_type == "random_forest":
        stages.append(TreeEnsemble(ForestSettings(**{**FOREST, "seed": seed, **(params or {})})))
    elif model_type == "hist_gradient_boosting":
        stages.append(TreeEnsemble(BoostSettings(**{**BOOSTING, **(params or {})})))
    else:
        raise ValueError(f"Unknown model type '{model_type}'")
    return stages


def build_pipeline(train: DataFrame, features: list[str], model_type: str, n_weight: float, seed: int = 42,
                   params: dict | None = None) -> Pipeline:
    """Impute + (scaled for logistic) numerics, indexed + one-hot categoricals, classifier."""
    return Pipeline(stages=preparation(train, features) + classifier(features, model_type, n_weight, seed, params))


def majority_stage(train: DataFrame, labels: list[str]) -> SQLTransformer:
    """The dummy model as a stage that can be saved: the majority class with probability 1."""
    most = labels.index(evaluation.majority_class(train).first()["majority_class"])
    chances = ", ".join("1.0D" if i == most else "0.0D" for i in range(len(labels)))
    return SQLTransformer(statement=f"SELECT *, {most}.0D AS prediction, array({chances}) AS prob_array FROM __THIS__")


def predicted_label(model_labels: list[str], pred_col: str = "prediction"):
    m = F.create_map(*[x for i, lab in enumerate(model_labels) for x in (F.lit(float(i)), F.lit(lab))])
    return m[F.col(pred_col)]


def _written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Prepared:
    """A scenario's rows, split once, with the imputation and encoding that every model fitted on them shares."""
    scenario: str
    features: list[str]
    stages: list           # fitted preparation
    rows: DataFrame        # Sample_ID, the label, is_test and the encoded columns, encoded from the written split as they are read
    facts: dict            # for the metadata of a model

    @property
    def labels(self) -> list[str]:
        return self.stages[0].labels


def prepare(df: DataFrame, scenario: str, test_size: float = 0.2, seed: int = 42) -> Prepared:
    """Frame -> split -> imputation and encoding fitted on the training rows.

    The split is a written table of plain columns. Encoding looks at one row, so it is done
    while the rows are read: vectors take several times the bytes of the columns they are made of.
    """
    frame = df.select("Sample_ID", *model_frame(df, scenario).columns).filter(F.col(TARGET).isNotNull())
    split = _written(stratified_split(frame, test_size, seed), "split", FILE_ROWS)
    features = scenario_columns(scenario)
    fitted = Pipeline(stages=preparation(split.filter(~F.col("is_test")), features)).fit(split)
    keep = ["num_vec", *[f"{c}__oh" for c in CATEGORICAL if c in features]]
    rows = fitted.transform(split).select("Sample_ID", TARGET, "is_test", "label", *keep)
    n = split.agg(F.count(F.lit(1)).alias("all"), F.count_if("is_test").alias("test")).first()
    facts = {"n_rows_total": n["all"], "n_rows_train": n["all"] - n["test"], "n_rows_test": n["test"],
             "test_size": test_size, "random_state": seed}
    return Prepared(scenario, features, fitted.stages, rows, facts)


def train_model(df: DataFrame | None, scenario: str, model_type: str, test_size: float = 0.2, seed: int = 42,
                params: dict | None = None, prepared: Prepared | None = None) -> dict:
    """Fit -> predict -> metrics for one (scenario, model), on ``prepared`` rows or on ``df``.

    Returns {"model" (a pipeline that takes raw columns), "labels", "metadata",
    "predictions" (held-out rows), "metrics" (one row)}.
    """
    p = prepared or prepare(df, scenario, test_size, seed)
    train, test = p.rows.filter(~F.col("is_test")), p.rows.filter(F.col("is_test"))
    if model_type == "dummy":
        stages = [majority_stage(train, p.labels)]
    else:
        if model_type == "logistic_regression":
            train = with_class_weights(train)
        tail = classifier(p.features, model_type, float(p.facts["n_rows_train"]), seed, params)
        stages = Pipeline(stages=tail).fit(train).stages  # balanced weights sum to the number of rows
    pred = PipelineModel(stages=stages).transform(test).withColumn("predicted_class", predicted_label(p.labels))
    pred = pred.select("Sample_ID", F.col(TARGET).alias("label"), F.col("predicted_class").alias("prediction"),
                       *[c for c in ("probability", "prob_array") if c in pred.columns])
    keyed = pred.withColumn("scenario", F.lit(scenario)).withColumn("model_type", F.lit(model_type))
    metadata = {"scenario": scenario, "model_type": model_type, "target": TARGET, "features": p.features,
                "labels": p.labels, **p.facts}
    return {"model": PipelineModel(stages=[*p.stages, *stages]), "labels": p.labels, "metadata": metadata, "predictions": pred,
            "metrics": evaluation.classification_metrics(keyed, ["scenario", "model_type"])}


def training_grid(df: DataFrame, scenarios: list[str], model_types: list[str], out_dir: str,
                  params: dict[str, dict] | None = None, test_size: float = 0.2, seed: int = 42, at_once: int = 4) -> DataFrame:
    """Metric rows for every (scenario, model); ``at_once`` fits run side by side.

    Each scenario is prepared once. A fit leaves its pipeline with metadata
    (``artifacts``), its nested metrics (``metrics``), its confusion matrix
    (``confusion``) and its held-out predictions (``predictions``) under
    ``out_dir``, each in a folder ``scenario=.../model_type=...``; the metric rows are one scan of
    the predictions. Nothing is cached.
    """
    spark = df.sparkSession
    context = spark.sparkContext

    def run(job, name):
        def go():
            context.setJobGroup(f"training-{name}", f"training {name}")
            context.setLocalProperty("spark.scheduler.pool", name)  # used where the scheduler is FAIR
            return job()
        return inheritable_thread_target(spark)(go)

    def fit(scenario: str, model_type: str) -> None:
        res = train_model(None, scenario, model_type, seed=seed, params=(params or {}).get(model_type), prepared=ready[scenario].result())
        where = f"scenario={scenario}/model_type={model_type}"
        pred_path = f"{out_dir}/predictions/{where}"
        res["predictions"].select("Sample_ID", "label", "prediction").write.mode("overwrite").parquet(pred_path)
        save_model(res["model"], res["metadata"], f"{out_dir}/artifacts/{where}")
        pred = spark.read.parquet(pred_path)
        files.sink_metrics_json(evaluation.metrics_report(pred, res["metadata"]), f"{out_dir}/metrics/{where}")
        files.sink_confusion_csv(evaluation.confusion_matrix(pred, []), [], f"{out_dir}/confusion/{where}")

    with ThreadPoolExecutor(len(scenarios)) as first, ThreadPoolExecutor(at_once) as pool:
        ready = {s: first.submit(run(lambda s=s: prepare(df, s, test_size, seed), s)) for s in scenarios}
        # the longest fits first
        order = sorted(model_types, key=lambda m: -MODEL_TYPES.index(m) if m in MODEL_TYPES else 0)
        for done in [pool.submit(run(lambda s=s, m=m: fit(s, m), f"{s}-{m}")) for m in order for s in scenarios]:
            done.result()
    return evaluation.classification_metrics(spark.read.parquet(f"{out_dir}/predictions"), ["scenario", "model_type"])


def quick_predictability(df: DataFrame, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Small balanced forest on a 75/25 split: accuracy and balanced accuracy vs chance."""
    spark = df.sparkSession
    schema = ("check string, status string, reason string, features_used int, classes long, "
              "minimum_class_count long, random_chance_baseline double, accuracy double, "
              "balanced_accuracy double, interpretation string")
    work = df.filter(F.col(TARGET).isNotNull())
    feats = usable_columns(work.columns)
    feats = [c for c in feats if c in set(scenario_columns("postbuild"))]
    counts = work.groupBy(TARGET).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("m")).first()
    k, m = (counts["k"] or 0), (counts["m"] or 0)
    if k < 2 or m < 2:
        reason = ("Target has fewer than 2 classes" if k < 2 else
                  "At least one class has fewer than 2 samples, so stratified train/test split is not possible")
        return spark.createDataFrame([("quick_random_forest_predictability", "SKIPPED", reason, len(feats), k, m,
                                       (1.0 / k) if k else None, None, None,
                                       "Dataset too small for reliable model sanity check")], schema)
    res = train_model(work, "postbuild", "random_forest", test_size, seed,
                      params=QUICK_FOREST)
    met = res["metrics"]
    chance = 1.0 / k
    return met.select(
        F.lit("quick_random_forest_predictability").alias("check"), F.lit("DONE").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.lit(len(feats)).alias("features_used"),
        F.lit(k).cast("long").alias("classes"), F.lit(m).cast("long").alias("minimum_class_count"),
        F.lit(chance).alias("random_chance_baseline"), "accuracy", "balanced_accuracy",
        F.when(F.col("balanced_accuracy") < chance + 0.10, TEXT["rf_weak"]).otherwise(TEXT["rf_signal"])
        .alias("interpretation"))


def save_model(model: PipelineModel, metadata: dict, path: str) -> None:
    """Pipeline directory + a one-row metadata table beside it."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(f"{path}/pipeline")
    if not isinstance(model, Transformer):
        raise TypeError("Saved artifact does not hold a pipeline")
    return model, json.loads(spark.read.text(f"{path}/metadata").first()["value"])


def evaluate_saved(model: PipelineModel, metadata: dict, df: DataFrame, keep: str = "Sample_ID") -> DataFrame:
    """Score a full table with a saved model, in the scenario of its metadata; rows used in training are scored too."""
    scenario = metadata["scenario"]
    frame = df.select(keep, *scenario_columns(scenario), TARGET).filter(F.col(TARGET).isNotNull())
    pred = model.transform(frame).select(F.col(TARGET).alias("label"), predicted_label(model.stages[0].labels).alias("prediction"))
    keyed = pred.withColumns({"scenario": F.lit(scenario), "model_type": F.lit(metadata["model_type"]),
                              "evaluation": F.lit("resubstitution")})
    return evaluation.classification_metrics(keyed, ["scenario", "model_type", "evaluation"])
