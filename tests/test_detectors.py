"""Detectors against numpy references written here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import classify, ensemble, isolation, kmeans, reconstruction
from flowvigil.plans import models
from flowvigil.plans.views import Tables
from flowvigil.session import spread


@pytest.fixture(scope="module")
def cloud(spark):
    """950 usual rows in three groups and 50 far ones, as (id, a, b, c)."""
    rng = np.random.default_rng(11)
    usual = np.vstack([rng.normal(centre, 1.0, (317, 3)) for centre in (0, 5, -5)])[:950]
    x = np.vstack([usual, rng.normal(25, 2.0, (50, 3))])
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(len(x)))
    return pdf, spark.createDataFrame(pdf).repartition(5)


def slow_path(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["low"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["high"][at]
    return tree["path"][at]


def test_tree_walk_equals_row_by_row():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    trees = [{k: np.array(v) for k, v in isolation.grow_tree(x, np.random.default_rng(i)).items()} for i in range(5)]
    want = [np.mean([slow_path(t, row) for t in trees]) for row in x]
    np.testing.assert_allclose(isolation.path_lengths(trees, x), want)


def test_walk_takes_as_many_steps_as_the_deepest_leaf(monkeypatch):
    """The same paths in steps of a few rows, with NaN (goes high), a tree of one leaf, and no rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 3))
    x[7] = np.nan
    trees = [{k: np.array(v) for k, v in isolation.grow_tree(rng.normal(size=(64, 3)), np.random.default_rng(i)).items()} for i in range(4)]
    trees.append({k: np.array(v) for k, v in isolation.grow_tree(np.zeros((9, 3)), rng).items()})
    monkeypatch.setattr(isolation, "STEP_ROWS", 7)
    np.testing.assert_allclose(isolation.path_lengths(trees, x), [np.mean([slow_path(t, row) for t in trees]) for row in x])
    assert len(isolation.path_lengths(trees, x[:0])) == 0


def test_every_training_row_lands_in_one_leaf():
    x = np.random.default_rng(1).normal(size=(64, 2))
    tree = isolation.grow_tree(x, np.random.default_rng(2))
    assert max(tree["path"]) <= 6 + isolation.usual_path(64)
    assert isolation.grow_tree(np.zeros((9, 2)), np.random.default_rng(0))["feature"] == [-1]


def test_usual_path():
    assert [isolation.usual_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    harmonic = sum(1 / i for i in range(1, 256))
    assert isolation.usual_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=0.01)


def test_isolation_forest_finds_the_far_rows(spark, cloud):
    pdf, df = cloud
    model = isolation.fit_isolation_forest(df, ["a", "b", "c"], "id", trees=60, sample=128, contamination=0.05)
    out = model.score(df).toPandas().set_index("id").sort_index()
    assert out.anomaly_score.between(0, 1).all() and out.anomaly_score.max() == pytest.approx(1.0, abs=1e-6)
    assert out.is_anomaly.mean() == pytest.approx(0.05, abs=0.002)
    assert out.index[out.is_anomaly].isin(range(950, 1000)).mean() > 0.9
    again = isolation.fit_isolation_forest(df.orderBy(F.rand(1)).repartition(3), ["a", "b", "c"], "id", trees=60, sample=128, contamination=0.05)
    np.testing.assert_allclose(again.score(df).toPandas().set_index("id").sort_index().raw_score, out.raw_score)


def test_tree_samples_are_full_and_distinct(spark):
    df = spark.range(5000).select("id", F.rand(3).alias("x"))
    for total, n in ((5000, 5000), (40, 40)):
        part = df.where(F.col("id") < n)
        sizes = isolation.tree_samples(part, ["x"], "id", 20, 64, 1, total).groupBy("tree").agg(
            F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()
        assert len(sizes) == 20 and {(r["n"], r["d"]) for r in sizes} == {(min(64, n), min(64, n))}


def test_score_norm_of_one_row(spark):
    assert isolation.normalise_within(spark.createDataFrame([(0.3,)], "s double"), "s").first()["anomaly_score"] == 1.0


@pytest.mark.parametrize("metric", ["euclidean", "mahalanobis"])
def test_kmeans_distances(spark, cloud, metric):
    pdf, df = cloud
    model = kmeans.fit_kmeans(df, ["a", "b", "c"], "id", k=4, restarts=2, contamination=0.05, metric=metric, silhouette=True)
    out = model.score(df, "id").toPandas().set_index("id").sort_index()
    x = pdf[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    plain = np.linalg.norm(z[:, None, :] - model.centres[None], axis=2)
    labels = plain.argmin(1)
    if metric == "euclidean":
        want = plain.min(1)
    else:
        each = []
        for i, centre in enumerate(model.centres):
            members = z[labels == i]
            cov = np.cov(members.T) + 1e-6 * np.eye(3) if len(members) > 1 else np.eye(3)
            gap = z - centre
            each.append(np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)))
        want = np.min(each, axis=0)
    np.testing.assert_allclose(out.distance, want, rtol=1e-6, atol=1e-9)
    assert out.cluster.tolist() == labels.tolist()
    assert model.threshold == pytest.approx(np.quantile(want, 0.95), rel=1e-6)
    assert out.is_anomaly.tolist() == (want > model.threshold).tolist() and model.silhouette > 0.5


def test_autoencoder_error_is_the_pca_residual(spark, cloud):
    pdf, df = cloud
    wide = df.withColumn("d", F.col("a") + F.col("b"))
    model = reconstruction.fit_autoencoder(wide, list("abcd"), "id", encoding_dim=2)
    out = model.score(wide, "id").toPandas().set_index("id").sort_index()
    x = pdf.assign(d=pdf.a + pdf.b)[list("abcd")].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    back = z @ v[:2].T @ v[:2]
    want = ((z - back) ** 2).mean(1)
    np.testing.assert_allclose(out.error, want, atol=1e-9)
    assert out.is_anomaly.mean() == pytest.approx(0.05, abs=0.002) and len(out.encoding.iloc[0]) == 2


def test_sequence_errors_start_after_the_first_window(spark):
    n = 120
    pdf = pd.DataFrame({"user": [0] * n + [1] * 5, "at": list(range(n)) + list(range(5)), "v": list(np.sin(np.arange(n) / 3)) + [0.0] * 5})
    pdf.loc[100, "v"] = 9.0
    df = spark.createDataFrame(pdf)
    model = reconstruction.fit_sequence_model(df, ["v"], "user", ["at"], length=10)
    out = model.score(df).toPandas().sort_values(["user", "at"])
    first = out[out.user == 0]
    assert len(out) == n + 5 and first.error.isna().sum() == 10 and out[out.user == 1].anomaly_score.isna().all()
    assert bool(first.set_index("at").loc[100, "is_anomaly"])


def test_sequence_model_against_plain_ridge(spark):
    rng = np.random.default_rng(5)
    n, length = 300, 4
    values = rng.normal(size=(n, 2)).cumsum(0)
    df = spark.createDataFrame(pd.DataFrame({"user": 0, "at": range(n), "a": values[:, 0], "b": values[:, 1]})).repartition(5)
    model = reconstruction.fit_sequence_model(df, ["a", "b"], "user", ["at"], length=length)
    x = np.column_stack([(values[:, i] - model.scaler[c][0]) / model.scaler[c][1] for i, c in enumerate("ab")])
    before = np.array([x[i - length:i].ravel() for i in range(length, n)])
    centred, target = before - before.mean(0), x[length:] - x[length:].mean(0)
    want = np.linalg.solve(centred.T @ centred + 1e-3 * np.diag((centred ** 2).sum(0)), centred.T @ target)
    assert np.allclose(np.array(model.weights).T, want)
    errors = model.errors(df).orderBy("at").toPandas().error.to_numpy()
    assert np.allclose(errors, ((centred @ want - target) ** 2).mean(1))
    few = reconstruction.fit_sequence_model(df.limit(3), ["a"], "user", ["at"], length=length)
    assert few.weights == [[0.0] * length]


def test_ensemble_skips_missing_scores(spark):
    df = spark.createDataFrame([(0.9, None, True, False, True), (None, None, None, None, None), (0.4, 0.8, True, False, False)],
                               "a double, b double, x boolean, y boolean, z boolean")
    out = ensemble.combine(df, ["a", "b"], ["x", "y", "z"]).collect()
    assert [r["ensemble_score"] for r in out] == [0.9, None, pytest.approx(0.6)]
    assert [r["hard_anomaly"] for r in out] == [True, False, False]


def test_zero_day_indicators(spark):
    df = spark.createDataFrame([(50.0, 0.9), (-50.0, 0.5), (0.0, 0.99)], "x double, anomaly_score double")
    out = ensemble.zero_day(df, {"x": (0.0, 10.0)}).collect()
    assert [(r["divergence"], r["is_zero_day"], r["indicators"]) for r in out] == [
        (pytest.approx(1.0), True, ["extreme_statistical_outlier"]), (pytest.approx(1.0), False, ["unusual_low_values"]), (0.0, False, [])]


def test_one_vs_rest_probabilities_sum_to_one(spark, cloud):
    _, df = cloud
    rows = classify.vectorise(df, ["a", "b", "c"]).withColumn(
        "label_code", F.when(F.col("id") >= 950, 2.0).when(F.col("a") > 2, 1.0).otherwise(0.0))
    model = classify.boosted_trees("plain", 3, maxIter=3, maxDepth=2).fit(rows)
    out = classify.with_probabilities(model, rows)
    name, confidence = classify.top_class("probabilities", ["low", "mid", "far"])
    out = out.select("label_code", F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p).alias("total"),
                     name.alias("name"), confidence.alias("confidence")).toPandas()
    np.testing.assert_allclose(out.total, 1.0)
    assert (out.name == out.label_code.map({0.0: "low", 1.0: "mid", 2.0: "far"})).mean() > 0.95
    assert out.confidence.between(1 / 3, 1).all()


def test_model_search_marks_one_best(spark, cloud):
    _, df = cloud
    rows = df.withColumn("label_code", (F.col("id") >= 950).cast("double"))
    out = classify.model_search(rows, ["a", "b", "c"], "id", forest={"numTrees": 5, "maxDepth": 3}, boosting={"maxIter": 3},
                                contaminations={"few": (20, 0.05), "broken": (0, 0.5)}).toPandas().set_index("model")
    assert out.is_best.sum() == 1 and out.loc["random_forest", "f1_score"] > 0.9
    assert out.loc["broken", "f1_score"] == 0.0 and out.loc["broken", "error"]


def test_forest_of_no_rows_scores_null(spark):
    none = spark.createDataFrame([], "id long, a double")
    model = isolation.fit_isolation_forest(none, ["a"], "id", trees=5)
    row = model.score(spark.createDataFrame([(1, 0.5)], "id long, a double")).first()
    assert model.trees == [] and row.raw_score is None and row.is_anomaly is None


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_kmeans_restarts_share_their_passes(spark, cloud):
    """The same centres and cost as the best of Spark's own fits, with one pass a step for all restarts."""
    from pyspark.ml.clustering import KMeans
    _, df = cloud
    vectors = classify.vectorise(kmeans.apply_scaler(df, kmeans.fit_scaler(df, list("abc"))), list("abc")).persist()
    fits = [KMeans(k=6, maxIter=300, seed=42 + i).fit(vectors) for i in range(8)]
    want = min(fits, key=lambda m: m.summary.trainingCost)
    out = []
    jobs = jobs_of(spark, "restarts", lambda: out.append(kmeans.fit_kmeans(df, ["a", "b", "c"], "id", k=6, restarts=8)))
    got = out[0]
    np.testing.assert_allclose(got.centres, np.array(want.clusterCenters()), rtol=1e-9, atol=1e-9)
    assert got.cost == pytest.approx(want.summary.trainingCost, rel=1e-9)
    firsts = 8 * jobs_of(spark, "first", lambda: KMeans(k=6, maxIter=0, seed=42).fit(vectors))
    assert jobs < firsts + sum(m.summary.numIter for m in fits)


def test_kmeans_sums_of_ties_and_missing_centres():
    rows = np.array([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0], [9.0, 9.0]])
    sets = np.array([[[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]], [[9.0, 9.0], [np.inf, np.inf], [np.inf, np.inf]]])
    out = kmeans.nearest_sums(rows, sets)
    assert out[0].tolist() == [[2.0, 1.0, 1.0, 0.0], [2.0, 130.0, 11.0, 9.0], [0.0] * 4]
    assert out[1].tolist() == [[4.0, 162.0 + 130.0 + 145.0, 12.0, 9.0], [0.0] * 4, [0.0] * 4]


def test_kmeans_with_fewer_different_rows_than_centres(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "id long, a double")
    model = kmeans.fit_kmeans(df, ["a"], "id", k=4, restarts=2)
    assert sorted(c[0] for c in model.centres.tolist()) == [-1.0, 1.0] and model.cost == 0.0 and model.threshold == 0.0


def test_small_files_are_spread_over_the_cores(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few, 100).rdd.getNumPartitions() == 1
    assert spread(few, 99).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_vectors_of_one_file_are_spread_before_a_fit(spark, tmp_path):
    rows = 1001 * spark.sparkContext.defaultParallelism
    spark.range(rows).selectExpr("id as vec_id", "array(cast(id % 7 as float), cast(id as float)) as embedding", "cast(id % 3 as int) as label").coalesce(
        1).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors, classes = models._vectors(Tables(spark, str(tmp_path)))
    assert vectors.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert classes == ["0", "1", "2"] and vectors.select("vec_id").distinct().count() == rows
