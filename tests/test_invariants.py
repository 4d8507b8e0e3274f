"""Queries without a SQL twin: properties their results must have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cytoplane.operators import cluster as K
from cytoplane.operators import cohort as C
from cytoplane.operators import graph as G
from cytoplane.plans import fixtures as fx

Q = queries()


def test_communities_beat_single_nodes_and_cover_all(spark, folder):
    edges = G.knn_graph(fx.points(spark, folder))
    found = G.communities(edges, [0.3, 1.0], rounds=3, levels=2).cache()
    nodes = edges.select("src").distinct().count()
    assert found.groupBy("res").count().where(F.col("count") != nodes).count() == 0
    alone = found.withColumn("label", F.col("node"))
    better = {r["res"]: r["modularity"] for r in G.modularity(edges, found).collect()}
    start = {r["res"]: r["modularity"] for r in G.modularity(edges, alone).collect()}
    assert all(better[r] > start[r] for r in (0.3, 1.0))


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for a in range(4) for b in range(4) if a != b]
    edges = [(a, b, 1.0) for a, b in pairs] + [(a + 4, b + 4, 1.0) for a, b in pairs]
    edges += [(0, 4, 1.0), (4, 0, 1.0)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, w double")
    rows = G.communities(df, [1.0]).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def _blobs(spark, n=60):
    rng = np.random.default_rng(3)
    centres = np.eye(3) * 10
    rows = [(i, [float(x) for x in centres[i % 3] + rng.normal(0, 0.1, 3)], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int")


@pytest.mark.parametrize("method", ["kmeans", "mixture", "spectral"])
def test_separate_blobs_are_found(spark, method):
    row = K.cluster_and_score(_blobs(spark), 3, method, neighbours=5).first()
    assert (row["accuracy"], row["ari"], row["nmi"]) == (1.0, 1.0, 1.0)


def test_refine_settles_on_blobs(spark):
    pts = _blobs(spark)
    start = K.label_centres(pts) + 1.0
    labels, log = K.refine(pts, start)
    assert log[-1]["change_rate"] < K.TOLERANCE and len(log) < 20
    both = labels.join(pts, "id")
    assert both.where(F.col("cluster") != F.col("label")).count() == 0
    assert labels.where((F.col("membership") <= 0) | (F.col("membership") > 1)).count() == 0


def test_refine_keeps_overlapping_groups_apart(spark):
    """Where groups overlap so that memberships are nearly even, centres must not fall into one place."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in 0.25 * np.eye(64)[i % 10] + rng.normal(0, 0.12, 64)], i % 10) for i in range(500)]
    pts = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    labels, log = K.refine(pts, K.label_centres(pts))
    sizes = [r["count"] for r in labels.groupBy("cluster").count().collect()]
    assert len(sizes) == 10 and min(sizes) > 20
    assert labels.join(pts, "id").where("cluster = label").count() > 300
    assert log[-1]["change_rate"] < K.TOLERANCE


def test_p_values_match_the_error_function(spark, folder):
    rows = Q["ranksum_p_values"](spark, folder).collect()
    assert rows
    for r in rows:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)))
        assert r["mark"] in {"****", "***", "**", "*", "ns"}


def test_stars_limits(spark):
    df = spark.createDataFrame([(1e-5,), (5e-4,), (0.005,), (0.05,), (0.2,), (None,)], "p double")
    got = [r[0] for r in df.select(C.stars(F.col("p"))).collect()]
    assert got == ["****", "***", "**", "*", "ns", None]


def test_predictions_are_probabilities(spark, folder):
    rows = Q["predict_labels"](spark, folder).collect()
    assert rows and all(0 < r["confidence"] <= 1 and 0 <= r["pred"] < 10 for r in rows)
    assert all(r["pred_label"].startswith("type ") for r in rows)
    assert len({(r["pred"], r["pred_label"]) for r in rows}) == len({r["pred"] for r in rows})


def test_linear_embedding_has_unit_rows(spark, folder):
    norms = Q["fit_linear_embedding"](spark, folder).groupBy("cell_id").agg(
        F.sum(F.col("value") * F.col("value")).alias("s")
    )
    assert norms.where(F.abs(F.col("s") - 1) > 1e-4).count() == 0


def test_segments_rebuild_the_words(spark, folder):
    parts = Q["segment_text"](spark, folder)
    joined = parts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p")
    )
    docs = fx.table(spark, folder, "documents").select("doc_id", "text")
    squeeze = lambda c: F.regexp_replace(c, "\\s", "")
    bad = joined.join(docs, "doc_id").where(
        squeeze(F.array_join(F.col("p.piece"), "")) != squeeze(F.col("text"))
    )
    assert bad.count() == 0
    assert joined.count() == docs.count()


def test_overlaps_are_real(spark, folder):
    docs = fx.table(spark, folder, "documents").select("doc_id", F.col("text").alias("a"))
    items = fx.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("b"))
    runs = Q["longest_common_substring_join"](spark, folder)
    both = runs.join(docs, runs.left_id == docs.doc_id).join(items, runs.right_id == items.item_id)
    left = F.substring("a", F.col("left_start") + 1, F.col("length"))
    right = F.substring("b", F.col("right_start") + 1, F.col("length"))
    assert runs.count() > 0
    assert both.where((left != right) | (F.length(left) != F.col("length"))).count() == 0
    seq = Q["longest_common_subsequence_join"](spark, folder).withColumnRenamed("length", "seq")
    pair = ["left_id", "right_id"]
    assert runs.join(seq, pair).where(F.col("seq") < F.col("length")).count() == 0


@pytest.mark.parametrize("name", ["kmeans_clusters", "gmm_clusters", "spectral_clusters", "deep_cluster_refine"])
def test_each_point_gets_one_cluster(spark, folder, name):
    rows = Q[name](spark, folder).cache()
    n = fx.points(spark, folder).count()
    assert rows.count() == n == rows.select("id").distinct().count()
    assert rows.where("cluster < 0 OR cluster > 9").count() == 0


def test_resolution_table(spark, folder):
    rows = Q["resolution_sweep_table"](spark, folder).collect()
    assert len(rows) == 6
    assert all(r["communities"] >= 1 and -1 <= r["ari"] <= 1 and 0 <= r["nmi"] <= 1 for r in rows)


def test_best_match_on_the_prediction_table(spark, folder):
    row = Q["cluster_accuracy"](spark, folder).first()
    assert row["accuracy"] == row["matched"] / row["n"]
    assert Q["cluster_error"](spark, folder).first()["error"] == pytest.approx(1 - row["accuracy"])
