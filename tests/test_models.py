"""The registered classifiers cover every labelled class at the operators' own sizes."""

from hitflow.operators import learning
from hitflow.plans import queries
from pyspark.sql import functions as F


def test_registered_perceptron_learns_every_labelled_class(spark, sf, monkeypatch):
    labels = queries.labels  # this table has no background: a third of its labelled clusters stand for it
    monkeypatch.setattr(queries, "labels", lambda *a: labels(*a).withColumn("hard_label", F.when(F.expr("hard_label >= 0 and cluster_id % 3 = 0"), 2).otherwise(F.col("hard_label"))))
    scored = queries._perceptron(spark, sf)
    assert {r[0] for r in scored.select("hard_label").distinct().collect()} == {0, 1, 2}
    assert len(scored.first()["rawPrediction"]) == len(queries.MEANS) + 1


def test_registered_trees_have_the_operator_size(spark, sf):
    """At most 20 trees of depth 5: the val block ends the boosting of a model that has stopped improving."""
    rows, model = queries._boosted(spark, sf)
    models = model.stages[-1].models
    assert all(1 <= m.getNumTrees <= 20 and m.getMaxDepth() == 5 for m in models)
    whole = learning.fit_boosted(rows.withColumn("split", F.lit("train")))
    assert all(m.getNumTrees == 20 and m.getMaxDepth() == 5 for m in whole.stages[-1].models)
