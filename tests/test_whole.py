"""Registered queries run their operator's whole job."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import community
from tessera.plans import clusters, graphs


def test_louvain_is_one_algorithm_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(community, "_sequential", None)
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "src long, dst long")
    found = community.louvain(edges, spark.range(5).toDF("id"))
    assert found.count() == 5
    with pytest.raises(ValueError):
        community.louvain(edges, spark.range(5).toDF("id"), mode="auto")


def test_reference_parameters(spark, sf, monkeypatch):
    calls = {}

    def kept(name, out):
        return lambda *a, **k: calls.__setitem__(name, (a[1:], k)) or out

    frame = spark.range(1)
    monkeypatch.setattr(clusters.cluster, "choose_k", kept("choose_k", frame))
    monkeypatch.setattr(clusters.cluster, "kmeans", kept("kmeans", (frame.withColumn("cluster", F.lit(0)), [], 0.0)))
    monkeypatch.setattr(graphs.community, "louvain", kept("louvain", frame.withColumn("community", F.lit(0))))
    monkeypatch.setattr(clusters.linalg, "reconstruction", kept("reconstruction", frame))
    monkeypatch.setattr(clusters.recommend, "tfidf", kept("tfidf", spark.createDataFrame([("a", "t", 1.0)], "item string, term string, w double")))
    clusters.choose_k(spark, sf), clusters.kmeans_best(spark, sf), graphs.louvain_parallel(spark, sf), clusters.svd_curve(spark, sf)
    assert calls["choose_k"] == ((), {}) and calls["kmeans"] == ((5,), {}) and calls["louvain"][1] == {"mode": "parallel"}
    assert calls["tfidf"][0][1] == 2000 and calls["reconstruction"][0][2] == [5, 10, 25, 50, 100, 200, 400]
