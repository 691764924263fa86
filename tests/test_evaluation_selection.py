from fusionlens.operators import evaluation, selection
from fusionlens.operators.projections import scenario_view
from fusionlens.contract import scenario_columns
import pytest


def _comparison(spark, dummy, other, other_type):
    rows = [("inbuild", "dummy", 0.3, 0.25, 0.2, 0.2, 0.4, dummy[1], 0.4, dummy[0]),
            ("inbuild", other_type, 0.4, 0.3, 0.3, 0.3, 0.5, other[1], 0.5, other[0])]
    m = spark.createDataFrame(rows, "scenario string, model_type string, accuracy double, balanced_accuracy double, "
                                    "macro_f1 double, weighted_f1 double, risk_precision double, risk_recall double, "
                                    "risk_f1 double, risk_f2 double")
    return selection.comparison_rows(m)


def test_recommendation_weak_and_strong_lift(spark):
    weak = selection.recommendation(_comparison(spark, (0.40, 0.40), (0.42, 0.43), "random_forest")).first()
    assert weak["deployment_status"] == "NOT_RECOMMENDED_FOR_DEPLOYMENT"
    strong = selection.recommendation(_comparison(spark, (0.40, 0.40), (0.55, 0.58), "hist_gradient_boosting")).first()
    assert strong["deployment_status"] == "CANDIDATE_FOR_ENGINEERING_VALIDATION"
    no_dummy = selection.recommendation(
        _comparison(spark, (0.40, 0.40), (0.55, 0.58), "random_forest").filter("model_type != 'dummy'")).first()
    assert no_dummy["deployment_status"] == "REVIEW_REQUIRED"


def test_metrics_against_hand_counts(spark):
    rows = [("Poor", "Poor"), ("Poor", "Good"), ("Moderate", "Moderate"), ("Good", "Good"), ("Excellent", "Good")]
    pred = spark.createDataFrame(rows, "label string, prediction string")
    m = evaluation.classification_metrics(pred, []).first()
    assert abs(m["accuracy"] - 0.6) < 1e-12
    assert abs(m["balanced_accuracy"] - (0.5 + 1 + 1 + 0) / 4) < 1e-12
    # risk: tp=2 (Poor->Poor, Moderate->Moderate), fn=1 (Poor->Good), fp=0
    assert abs(m["risk_recall"] - 2 / 3) < 1e-12 and m["risk_precision"] == 1.0
    assert abs(m["risk_f2"] - 10 / 14) < 1e-12
    cm = evaluation.confusion_matrix(pred, []).collect()
    assert len(cm) == 16 and sum(r["count"] for r in cm) == 5


def test_scenario_views_exclude_post_build(builds_small):
    pre = scenario_view(builds_small, "prebuild")
    assert len(pre.columns) == 11 and "Defect_Count" not in pre.columns
    assert len(scenario_view(builds_small, "inbuild").columns) == 17
    assert len(scenario_view(builds_small, "postbuild").columns) == 25
    with pytest.raises(ValueError):
        scenario_columns("tomorrow")
