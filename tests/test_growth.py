"""Steps whose cost must not grow faster than their rows: views computed once, fits in few tasks, models asked once."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from callgauge.operators import modeling as md
from callgauge.plans.catalog import models, tables


def test_auc_scores_are_written_before_they_are_ranked(spark):
    scored = spark.createDataFrame([(1, 2.0, 1, "x"), (2, 1.0, 0, "y"), (3, 1.5, None, "z")], "doc_id long, avg_word_length double, label_binary int, lang string")
    out = models.roc_auc(SimpleNamespace(scored=scored))
    assert out.first().roc_auc == 1.0 and out.inputFiles()


def test_targets_without_leaks_are_computed_once(spark):
    rows = [(1, 10.0, 1.0, 0.1), (2, 20.0, 2.0, -0.1)]
    stored = spark.createDataFrame(rows, "doc_id long, financial_Total_Revenue double, financial_Total_Debt double, abnormal_return double")
    got = tables.leak_free_numeric(SimpleNamespace(stored_targets=stored)).collect()
    assert sorted(map(tuple, got)) == [(1, 10.0, 1.0), (2, 20.0, 2.0)]


def _rows(spark, n=120):
    return md.assemble(spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y")), ["a", "b"])


def test_fit_rows_are_in_as_few_tasks_as_their_number_asks_for(spark, monkeypatch):
    d = _rows(spark).repartition(12)
    with md.fit_rows(d, "y", "features", md._positive) as held:
        assert held.rdd.getNumPartitions() == 1 and held.columns == ["y", "features", "__w"] and held.count() == 120
    monkeypatch.setattr(md, "TASK_ROWS", 50)
    with md.fit_rows(d, "y", "features") as held:
        assert held.rdd.getNumPartitions() == 3 and held.agg(F.sum("__w")).first()[0] == 120.0


def test_models_are_asked_once_for_their_scores(spark):
    d = _rows(spark).drop("features").withColumnRenamed("id", "idx")
    few = lambda d, y, x: md.fit_boosted_classifier(d, y, x, rounds=2, depth=2)
    oof = md.cross_validate(d, 120, ["a", "b"], few, 2, "y")
    assert oof.inputFiles() and oof.count() == 80
    out = md.feature_set_ablation(d, d, {"one": ["a"], "none": [], "both": ["a", "b"]}, {"few": few, "line": lambda d, y, x: md.fit_logistic(d, y, x)}, "y", ["idx"])
    assert out.inputFiles() and out.groupBy("feature_set", "model").count().count() == 4 and out.filter("score IS NOT NULL").count() == 480
