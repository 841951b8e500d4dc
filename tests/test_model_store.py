"""Models kept as rows score equally in another session; versions and the active suite."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowvigil.operators import classify, context, ensemble, isolation, kmeans, reconstruction
from flowvigil.plans.detect import Models, load_suite, save_suite
from flowvigil.sources.folders import Folders
from flowvigil.sources.model_store import ModelStore

COLUMNS = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=COLUMNS)
    return spark.createDataFrame(pdf.assign(id=range(300), user=0, kind=[f"k{i % 3}" for i in range(300)]))


def store_at(spark, tmp_path):
    return ModelStore(spark, f"file://{tmp_path}/models")


def equal(a, b, key="id"):
    a, b = (df.orderBy(key).toPandas() for df in (a, b))
    assert len(a) and list(a.columns) == list(b.columns)
    for c in a.columns:
        assert a[c].map(str).tolist() == b[c].map(str).tolist()


def test_every_detector_scores_equally_in_a_new_session(spark, rows, tmp_path):
    forest = isolation.fit_isolation_forest(rows, COLUMNS, "id", trees=7, sample=64)
    models = {
        "forest": forest, "centres": kmeans.fit_kmeans(rows, COLUMNS, "id", k=3, restarts=1, max_iter=5),
        "mahalanobis": kmeans.fit_kmeans(rows, COLUMNS, "id", k=2, restarts=1, max_iter=5, metric="mahalanobis", silhouette=True),
        "autoencoder": reconstruction.fit_autoencoder(rows, COLUMNS, "id", encoding_dim=2),
        "sequence": reconstruction.fit_sequence_model(rows, ["a", "b"], "user", ["id"], length=4),
        "scaler": context.fit_scaler(rows, COLUMNS), "baseline": ensemble.fit_baseline(rows, ["a"]), "codes": context.fit_codes(rows, "kind"),
        "names": ["x", "ü", ""], "limit": 3, "share": 0.25, "weights": np.arange(6.0).reshape(2, 3), "text": "a 'b'"}
    assert store_at(spark, tmp_path).save("flows", models, trained_on=300) == 1
    found = store_at(spark.newSession(), tmp_path).load("flows")
    assert set(found) == set(models)
    equal(forest.score(rows), found["forest"].score(rows))
    for name in ("centres", "mahalanobis", "autoencoder"):
        equal(models[name].score(rows, "id"), found[name].score(rows, "id"))
    equal(models["sequence"].score(rows), found["sequence"].score(rows))
    for name in ("scaler", "baseline", "names", "limit", "share", "text"):
        assert found[name] == models[name]
    assert np.array_equal(found["weights"], models["weights"])
    equal(context.apply_codes(rows, "kind", models["codes"], "code"), context.apply_codes(rows, "kind", found["codes"], "code"))
    assert store_at(spark, tmp_path).nodes().count() == sum(len(t["feature"]) for t in forest.trees)


def test_suites_of_a_detection(spark, rows, tmp_path):
    store = store_at(spark, tmp_path)
    assert load_suite(store) == Models()
    labelled = classify.vectorise(rows, COLUMNS).withColumn("label_code", (F.col("a") > 0).cast("double"))
    classifier = classify.random_forest("wide", numTrees=3, maxDepth=2).fit(labelled)
    empty = isolation.fit_isolation_forest(rows.limit(0), COLUMNS, "id", trees=2)
    save_suite(store, "cicids", Models(empty, classifier, ("normal", "dos")))
    save_suite(store, "kdd", Models())
    with pytest.raises(LookupError):
        store.activate("none")
    store.activate("kdd")
    assert load_suite(store_at(spark.newSession(), tmp_path)) == Models(None, None, [])
    store.activate("cicids")
    found = load_suite(store_at(spark.newSession(), tmp_path))
    assert found.anomaly.trees == [] and found.classes == ["normal", "dos"]
    equal(classifier.transform(labelled).select("id", "prediction"), found.classifier.transform(labelled).select("id", "prediction"))


def test_versions_and_switches(spark, tmp_path):
    store = store_at(spark, tmp_path)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: store.save("s", {"n": i}), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4]
    # a writer that died before its manifest leaves nothing to see
    Folders(spark).create_new(f"{store.root}/claims/s-5", "s")
    store._put("cells", "s", 5, spark.createDataFrame([("n", "", "int", [], 0, None, "9")], "part string, field string, kind string, shape array<int>, pos int, number double, text string"))
    assert store.latest("s") == 4 and store.save("s", {"n": 6}) == 6
    assert {r["version"] for r in store.cells().select("version").distinct().collect()} == {1, 2, 3, 4, 6}
    assert store.active() is None and store.load_active() == {}
    for version in (3, 1, 2):
        store.activate("s", version)
    # a switch whose record was never written is passed over
    Folders(spark).create_new(f"{store.root}/active/{9:012d}", "")
    assert store.active() == ("s", 2)
    store.activate("s")
    assert store.active() == ("s", 6) and store.load_active() == {"n": 6}
    store.activate("s", 1)
    assert store.prune("s", keep=2) == [2, 3] and store.prune("s", keep=2) == []
    assert sorted(r["version"] for r in store.versions().collect()) == [1, 4, 6] and store.load_active() == {"n": numbers.index(1)}
    with pytest.raises(LookupError):
        store.load("s", 2)
    with pytest.raises(ValueError):
        store.save("a/b", {})
    with pytest.raises(TypeError):
        store.save("s", {"x": object()})
