"""The autoencoder with a hidden layer: gradient, a curved data set, nulls, and the model store."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import curved, reconstruction


def parameters(seed=0, d=5, size=2, hidden=3):
    rng = np.random.default_rng(seed)
    shapes = {"encode": (size, d), "straight": (d, size), "bend_in": (hidden, size), "bend_shift": (hidden,), "bend_out": (d, hidden), "shift": (d,)}
    return {name: rng.normal(size=shape) for name, shape in shapes.items()}


@pytest.mark.parametrize("part", curved.PARTS)
def test_gradient_equals_finite_differences(part):
    x = np.random.default_rng(3).normal(size=(7, 5))
    p = parameters()
    _, gradient = curved.loss_and_gradient(x, p)
    for at in np.ndindex(p[part].shape):
        sides = []
        for change in (1e-6, -1e-6):
            q = {name: value.copy() for name, value in p.items()}
            q[part][at] += change
            sides.append(curved.loss_and_gradient(x, q)[0])
        assert gradient[part][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-6)


def test_gradient_over_all_tasks(spark):
    x = np.random.default_rng(4).normal(size=(500, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(7)
    rows, loss, gradient = curved.gradient_over(df, parameters())
    want_loss, want = curved.loss_and_gradient(x, parameters())
    assert rows == 500 and loss == pytest.approx(want_loss / 500)
    for name in curved.PARTS:
        np.testing.assert_allclose(gradient[name], want[name] / 500, rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def bow(spark):
    rng = np.random.default_rng(5)
    t = rng.uniform(-2, 2, 1500)
    pdf = pd.DataFrame({"id": np.arange(1500), "a": t, "b": t ** 2 + rng.normal(0, .05, 1500), "c": np.sin(2 * t) + rng.normal(0, .05, 1500)})
    return spark.createDataFrame(pdf).repartition(4)


def test_curved_data_are_rebuilt_better_than_by_components(bow):
    columns = ["a", "b", "c"]
    bent = curved.fit_curved_autoencoder(bow, columns, "id", encoding_dim=1, hidden=12, rate=0.05)
    straight = reconstruction.fit_autoencoder(bow, columns, "id", encoding_dim=1)
    of_bent = bent.errors(bow, "id").agg(F.avg("error")).first()[0]
    of_straight = straight.errors(bow, "id").agg(F.avg("error")).first()[0]
    assert of_bent < 0.8 * of_straight  # its main component folds this curve, which bounds what a decoder can win
    flagged = bent.score(bow, "id").agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert 0.04 < flagged < 0.06


def test_a_curve_that_its_main_component_does_not_fold(spark):
    rng = np.random.default_rng(6)
    t = rng.uniform(-2, 2, 1000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1000), "a": t, "b": t ** 2 + rng.normal(0, .05, 1000), "c": t + rng.normal(0, .05, 1000)}))
    bent = curved.fit_curved_autoencoder(df, ["a", "b", "c"], "id", encoding_dim=1, hidden=8, rate=0.05)
    straight = reconstruction.fit_autoencoder(df, ["a", "b", "c"], "id", encoding_dim=1)
    of_bent, of_straight = (m.errors(df, "id").agg(F.avg("error")).first()[0] for m in (bent, straight))
    assert of_bent < 0.3 * of_straight
    away = spark.createDataFrame([(1, 0.0, 4.0, 0.0), (2, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0)], "id long, a double, b double, c double")
    got = {r["id"]: r for r in bent.score(away, "id").collect()}
    assert got[1]["is_anomaly"] and got[1]["anomaly_score"] == 1.0
    assert got[2]["error"] is None and got[3]["error"] is None and got[2]["is_anomaly"] is None and got[3]["encoding"] is None


def test_without_steps_it_is_the_linear_one(bow):
    columns = ["a", "b", "c"]
    bent = curved.fit_curved_autoencoder(bow, columns, "id", encoding_dim=2, steps=0).errors(bow, "id").toPandas().set_index("id")
    straight = reconstruction.fit_autoencoder(bow, columns, "id", encoding_dim=2).errors(bow, "id").toPandas().set_index("id")
    np.testing.assert_allclose(bent.error.sort_index(), straight.error.sort_index(), atol=1e-9)


def test_rows_without_a_number_do_not_change_the_fit(bow):
    columns = ["a", "b", "c"]
    holes = bow.sparkSession.createDataFrame([(-1, None, 1.0, 1.0), (-2, float("nan"), 1.0, 1.0), (-3, 1.0, float("inf"), 1.0)], bow.schema)
    fits = [curved.fit_curved_autoencoder(df, columns, "id", encoding_dim=1, hidden=4, steps=1) for df in (bow, bow.unionByName(holes))]
    np.testing.assert_allclose(fits[0].encode, fits[1].encode, atol=1e-9)
    assert fits[0].threshold == pytest.approx(fits[1].threshold)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, a double, b double")
    model = curved.fit_curved_autoencoder(empty, ["a", "b"], "id")
    assert model.threshold is None and model.score(empty, "id").collect() == []


def test_kept_in_the_model_store(spark, bow, tmp_path):
    from flowvigil.sources.model_store import ModelStore
    model = curved.fit_curved_autoencoder(bow, ["a", "b", "c"], "id", encoding_dim=1, hidden=4, steps=2)
    store = ModelStore(spark, str(tmp_path / "store"))
    store.save("s", {"bent": model})
    back = store.load("s")["bent"]
    assert back.score(bow, "id").orderBy("id").collect() == model.score(bow, "id").orderBy("id").collect()
