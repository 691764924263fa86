"""Evaluation: confusion table, multi-class and risk metrics, class weights, dummy model.

Predictions arrive as a long table (keys..., label, prediction). Everything is
derived from one ``groupBy(keys, label, prediction).count()`` - a tiny table
after map-side combine - so scoring a billion rows costs one scan and the
driver never sees a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.contract import METRIC_MEANING, QUALITY_ORDER, RISK_CLASSES, TARGET
from fusionlens.functions.exprs import risk_flag
from fusionlens.functions.frames import attach_one_row


def confusion_counts(pred: DataFrame, keys: list[str], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(*keys, F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_matrix(pred: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction",
                     labels: list[str] = QUALITY_ORDER) -> DataFrame:
    """4 x 4 counts in quality order per key (0 where a pair never occurs)."""
    counts = confusion_counts(pred, keys, label, prediction)
    grid = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                              F.lit(i).alias("actual_order"), F.lit(j).alias("predicted_order"))
                     for i, a in enumerate(labels) for j, p in enumerate(labels)])
    key_rows = counts.select(*keys).distinct() if keys else pred.sparkSession.range(1).select()
    cells = key_rows.select(*keys, F.explode(grid).alias("g")).select(*keys, "g.*")
    return cells.join(counts, keys + ["actual", "predicted"], "left").select(
        *keys, "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        "actual_order", "predicted_order")


def _per_class(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., cls, tp, true_n, pred_n) over every label seen as truth or prediction."""
    t = counts.groupBy(*keys, F.col("actual").alias("cls")).agg(F.sum("count").alias("true_n"))
    p = counts.groupBy(*keys, F.col("predicted").alias("cls")).agg(F.sum("count").alias("pred_n"))
    tp = counts.filter(F.col("actual") == F.col("predicted")).groupBy(*keys, F.col("actual").alias("cls")).agg(
        F.sum("count").alias("tp"))
    allc = t.select(*keys, "cls").unionByName(p.select(*keys, "cls")).distinct()
    return (allc.join(t, keys + ["cls"], "left").join(p, keys + ["cls"], "left").join(tp, keys + ["cls"], "left")
            .select(*keys, "cls", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("tp", "true_n", "pred_n")]))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_metrics(pred: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction",
                      labels: list[str] = QUALITY_ORDER) -> DataFrame:
    """precision / recall / F1 / support for each domain label; division by zero = 0."""
    pc = _per_class(confusion_counts(pred, keys, label, prediction), keys)
    key_rows = pc.select(*keys).distinct() if keys else pred.sparkSession.range(1).select()
    dom = key_rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("cls"), F.lit(i).alias("class_order"))
                                                    for i, v in enumerate(labels)])).alias("d")).select(*keys, "d.*")
    j = dom.join(pc, keys + ["cls"], "left").na.fill(0.0, ["tp", "true_n", "pred_n"])
    return j.select(
        *keys, F.col("cls").alias("label"), "class_order",
        _ratio(F.col("tp"), F.col("pred_n")).alias("precision"),
        _ratio(F.col("tp"), F.col("true_n")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("true_n") + F.col("pred_n")).alias("f1"),
        F.col("true_n").cast("long").alias("support"),
    )


def classification_metrics(pred: DataFrame, keys: list[str], label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """accuracy, balanced accuracy, macro F1, weighted F1 and the four risk metrics per key.

    The cells of the confusion table (one for each pair of labels) become one
    array per key, and every metric is an expression over it: one scan, one
    shuffle of rows and one of cells. Rows without a label or prediction are
    left out.
    """
    counts = confusion_counts(pred, keys, label, prediction).where("actual IS NOT NULL AND predicted IS NOT NULL")
    cell = F.struct("actual", "predicted", F.col("count").cast("double").alias("n"))
    cells = counts.groupBy(*keys).agg(F.collect_list(cell).alias("cells"))
    names = F.array_distinct(F.concat(F.transform("cells", lambda c: c["actual"]),
                                      F.transform("cells", lambda c: c["predicted"])))

    def total(condition):
        return F.aggregate(F.filter("cells", condition), F.lit(0.0), lambda a, c: a + c["n"])

    def over(of):
        return F.aggregate(F.transform("per", of), F.lit(0.0), lambda a, x: a + x)

    per = cells.select(*keys, "cells", F.transform(names, lambda name: F.struct(
        total(lambda c: (c["actual"] == name) & (c["predicted"] == name)).alias("tp"),
        total(lambda c: c["actual"] == name).alias("true_n"),
        total(lambda c: c["predicted"] == name).alias("pred_n"))).alias("per"))

    def f1(x):
        return _ratio(2 * x["tp"], x["true_n"] + x["pred_n"])

    every = over(lambda x: x["true_n"])
    risky = lambda c, side: c[side].isin(*RISK_CLASSES)
    tp = total(lambda c: risky(c, "actual") & risky(c, "predicted"))
    fp = total(lambda c: ~risky(c, "actual") & risky(c, "predicted"))
    fn = total(lambda c: risky(c, "actual") & ~risky(c, "predicted"))
    seen = F.size(F.filter("per", lambda x: x["true_n"] > 0))
    return per.select(
        *keys,
        (over(lambda x: x["tp"]) / every).alias("accuracy"),
        (over(lambda x: F.when(x["true_n"] > 0, x["tp"] / x["true_n"]).otherwise(0.0)) / seen).alias("balanced_accuracy"),
        (over(f1) / F.size("per")).alias("macro_f1"),
        _ratio(over(lambda x: f1(x) * x["true_n"]), every).alias("weighted_f1"),
        *_risk_columns(tp, fp, fn),
    )


def _risk_columns(tp, fp, fn) -> list:
    return [
        _ratio(tp, tp + fp).alias("risk_precision"),
        _ratio(tp, tp + fn).alias("risk_recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("risk_f1"),
        _ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("risk_f2"),
    ]


def risk_metrics_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    a = risk_flag("actual")
    p = risk_flag("predicted")
    c = F.col("count").cast("double")
    agg = counts.groupBy(*keys).agg(
        F.sum(F.when((a == 1) & (p == 1), c).otherwise(0.0)).alias("tp"),
        F.sum(F.when((a == 0) & (p == 1), c).otherwise(0.0)).alias("fp"),
        F.sum(F.when((a == 1) & (p == 0), c).otherwise(0.0)).alias("fn"))
    return agg.select(*keys, *_risk_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def risk_metrics(pred: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Binary precision / recall / F1 / F2 on {Poor, Moderate}."""
    return risk_metrics_from_counts(confusion_counts(pred, keys, label, prediction), keys)


def class_weights(df: DataFrame, label: str = TARGET, out: str = "class_weight") -> DataFrame:
    """'Balanced' weight n / (k * n_class) on every row (class counts joined back)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = attach_one_row(counts, tot).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    # one short row a class: without the hint the rows would be shuffled by class, one task for all rows of a class
    return df.join(F.broadcast(w), label, "left")


def majority_class(train: DataFrame, label: str = TARGET) -> DataFrame:
    """One-row frame with the most frequent label (ties: first in sorted order)."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    return counts.agg(F.min_by(label, F.struct(-F.col("__c"), F.col(label))).alias("majority_class")).filter(
        F.col("majority_class").isNotNull())


def metrics_report(pred: DataFrame, metadata: dict | None = None, label: str = "label", prediction: str = "prediction",
                   keys: list[str] = ()) -> DataFrame:
    """One nested row per key: the metrics, a report per class, the confusion matrix, its meaning, the metadata."""
    keys = list(keys)
    flat = classification_metrics(pred, keys, label, prediction)
    fields = ("precision", "recall", "f1", "support")
    classes = per_class_metrics(pred, keys, label, prediction).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.struct(*fields)))).alias("m")).select(
        *keys, F.struct(*[F.col("m")[q].alias(q) for q in QUALITY_ORDER]).alias("classification_report"))
    cells = confusion_matrix(pred, keys, label, prediction).groupBy(*keys, "actual_order").agg(
        F.array_sort(F.collect_list(F.struct("predicted_order", "count"))).alias("r"))
    matrix = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("actual_order", "r"))).alias("m")).select(
        *keys, F.struct(F.array(*[F.lit(q) for q in QUALITY_ORDER]).alias("labels"), F.transform(
            "m", lambda x: F.transform(x["r"], lambda y: y["count"])).alias("matrix")).alias("confusion_matrix"))
    if keys:
        out = flat.join(classes, keys).join(matrix, keys)
    else:
        out = attach_one_row(attach_one_row(flat, classes), matrix)
    out = out.withColumn("metric_interpretation", F.struct(*[F.lit(v).alias(k) for k, v in METRIC_MEANING.items()]))
    for name, value in (metadata or {}).items():
        out = out.withColumn(f"__{name}", F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value))
    if metadata:
        out = out.withColumn("metadata", F.struct(*[F.col(f"__{n}").alias(n) for n in metadata])).drop(*[f"__{n}" for n in metadata])
    return out


def dummy_predict(train: DataFrame, score: DataFrame, label: str = TARGET, out: str = "prediction") -> DataFrame:
    """Majority-class model: every scored row gets the train majority (one-row broadcast)."""
    return attach_one_row(score, majority_class(train, label)).withColumnRenamed("majority_class", out)
