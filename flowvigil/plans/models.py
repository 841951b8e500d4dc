"""Queries of classification, the whole detection, and the model store.

All models are fitted with the published settings, which are the defaults of the operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowvigil.operators import classify, context, ensemble, isolation
from flowvigil.operators.isolation import IsolationForest, usual_path
from flowvigil.plans.detect import Models, detect, load_suite, save_suite
from flowvigil.plans.registry import PARTS, query
from flowvigil.session import materialise, scratch_path, spread
from flowvigil.sources import sinks
from flowvigil.sources.model_store import ModelStore

DIMENSIONS = [f"e{i}" for i in range(64)]
ROWS_EACH = 1000  # rows that one task of a fit may have before the rows are spread: a row passes hundreds of trees


def _vectors(t):
    """(vec_id, features, label_code) and the class names."""
    rows = classify.vectorise_array(t.table("embeddings"), "embedding")
    classes = classify.fit_label_codes(rows, "label")
    coded = classify.add_label_code(rows, "label", classes).select("vec_id", "features", "label_code")
    return spread(coded, ROWS_EACH), classes


def _predicted(model, rows, classes):
    scored = classify.with_probabilities(model, rows)
    name, confidence = classify.top_class("probabilities", classes)
    return scored.select("vec_id", F.element_at(F.array(*[F.lit(c) for c in classes]), (F.col("label_code") + 1).cast("int")).alias("actual"),
                         name.alias("predicted"), confidence.alias("confidence"))


@query("m1_random_forest")
def _forest(t):
    rows, classes = _vectors(t)
    return _predicted(classify.random_forest("wide").fit(rows), rows, classes)


@query("m1_random_forest_balanced")
def _forest_balanced(t):
    rows, classes = _vectors(t)
    weighted = classify.class_weights(rows)
    return _predicted(classify.random_forest("balanced").fit(weighted), rows, classes)


@query("m2_boosted_trees")
def _boosted(t):
    rows, classes = _vectors(t)
    rows = materialise(rows)
    model = classify.boosted_trees("deep", len(classes)).fit(rows)
    return _predicted(model, rows, classes)


@query("m2_boosted_trees_binary")
def _boosted_binary(t):
    rows, _ = _vectors(t)
    halves = rows.withColumn("label_code", (F.col("label_code") >= 5).cast("double"))
    halves = materialise(halves)
    model = classify.boosted_trees("leafy").fit(halves)
    return _predicted(model, halves, ["low", "high"])


@query("m5_feature_importance")
def _importance(t):
    rows, _ = _vectors(t)
    return classify.feature_importance(classify.random_forest("wide").fit(rows), DIMENSIONS)


@query("m6_cross_validation")
def _cross(t):
    rows, _ = _vectors(t)
    return classify.cross_validate(materialise(rows), "vec_id", {"random_forest": classify.random_forest("wide")})


@query("m7_model_search")
def _search(t):
    labelled = context.model_features(t.flows).join(
        t.flows.select("flow_id", F.col("label").cast("double").alias("label_code")), "flow_id")
    return classify.model_search(materialise(labelled), context.MODEL_COLUMNS, "flow_id")


@query("r10_detect")
def _detect(t):
    labelled = materialise(context.model_features(t.flows).join(
        t.detections.select(F.col("seq").alias("flow_id"), "threat_class"), "flow_id"))
    classes = classify.fit_label_codes(labelled, "threat_class")
    training = classify.add_label_code(classify.vectorise(labelled, context.MODEL_COLUMNS), "threat_class", classes)
    models = Models(
        isolation.fit_isolation_forest(labelled, context.MODEL_COLUMNS, "flow_id"),
        classify.random_forest("wide").fit(training.select("features", "label_code")), classes)
    return detect(t.flows, models)


query("r10_detect_safe_mode", """
select flow_id as seq, 'THR-' || strftime(ts, '%Y%m%d') || '-' || lpad(cast(row_number() over (
    partition by strftime(ts, '%Y%m%d') order by ts, flow_id) - 1 as varchar), 6, '0') as threat_id, ts, src_ip, dst_ip, dst_port,
  false as is_anomaly, 0e0 as anomaly_score, 'unknown' as threat_class, 0e0 as classification_confidence,
  28e0 as risk_score, 'low' as severity, 'monitor' as recommended_action, 'executed' as status from flows""", "risk_score")(
    lambda t: detect(t.flows.drop("src_port", "protocol"), Models()))


@query("s10_model_store")
def _store(t):
    """Two versions of a suite are saved, listed, and the newest one is loaded and used."""
    root = scratch_path(t.spark, "models")
    flows = t.flows.select("flow_id", F.col("packets").cast("double").alias("packets"), "flow_duration")
    steps = [VectorAssembler(inputCols=["packets", "flow_duration"], outputCol="features")]
    for version, k in ((1, 2), (2, 3)):
        model = Pipeline(stages=[*steps, KMeans(k=k, seed=42, maxIter=5)]).fit(flows)
        sinks.save_model(model, root, "flows", version, columns=["packets", "flow_duration"], k=k)
    loaded = sinks.load_model(t.spark, root, "flows")
    return loaded.transform(flows).groupBy("prediction").agg(F.count("*").alias("rows")).withColumn(
        "versions", F.lit(sinks.model_table(t.spark, root).count()))


# --- the model store with our own models --------------------------------------

# A given forest of two trees: (feature, cut, low, high, rows of a leaf) of each node; depth and rows give a leaf's path.
_GIVEN = [[(0, 1, 2, None), (1, 3, 4, None), (-1, 0, 0, 8), (-1, 0, 0, 64), (-1, 0, 0, 4)],
          [(1, 1, 2, None), (-1, 0, 0, 128), (0, 3, 4, None), (-1, 0, 0, 2), (-1, 0, 0, 16)]]
_DEPTHS = [[0, 1, 1, 2, 2], [0, 1, 1, 2, 2]]


def _leaf_path(tree, node):
    rows = _GIVEN[tree][node][3]
    return _DEPTHS[tree][node] + usual_path(rows) if rows else 0.0


def given_forest(columns, cuts) -> IsolationForest:
    """The given trees over two columns, cut at ``cuts``."""
    trees = []
    for i, nodes in enumerate(_GIVEN):
        feature = np.array([n[0] for n in nodes], np.int32)
        trees.append({"feature": feature, "cut": np.array([cuts[f] if f >= 0 else 0.0 for f in feature]), "low": np.array([n[1] for n in nodes], np.int32),
                      "high": np.array([n[2] for n in nodes], np.int32), "path": np.array([_leaf_path(i, k) for k in range(len(nodes))])})
    return IsolationForest(list(columns), trees, 256, 0.48, 0.4, 0.6)


def given_score_sql(first: str, second: str, cuts: tuple[str, str]) -> str:
    """The raw score of the given forest as SQL."""
    p = [[repr(_leaf_path(i, k)) for k in range(5)] for i in range(2)]
    a, b = f"{first} <= {cuts[0]}", f"{second} <= {cuts[1]}"
    low = f"case when {a} then case when {b} then {p[0][3]}e0 else {p[0][4]}e0 end else {p[0][2]}e0 end"
    high = f"case when {b} then {p[1][1]}e0 else case when {a} then {p[1][3]}e0 else {p[1][4]}e0 end end"
    return f"power(2e0, -(({low} + {high})/2)/{usual_path(256)!r}e0)"


def _mean_forest(t) -> IsolationForest:
    means = t.flows.agg(F.avg("packets"), F.avg("bytes")).first()
    return given_forest(["packets", "bytes"], tuple(means))


def _reopened(t, root: str) -> ModelStore:
    """The store as another session sees it."""
    return ModelStore(t.spark.newSession(), root)


PARTS["flow_means"] = "select avg(packets) as mp, avg(bytes) as mb from flows"
_NODES_SQL = " union all ".join(
    f"select {i} as tree, {k} as node, {f} as feature, {('mp' if f == 0 else 'mb') if f >= 0 else '0e0'} as cut, {low} as low, {high} as high, {_leaf_path(i, k)!r}e0 as path from flow_means"
    for i, nodes in enumerate(_GIVEN) for k, (f, low, high, _) in enumerate(nodes))


@query("s10_model_store_nodes", f"""
select tree::int as tree, count(*) as nodes, count(*) filter (where feature >= 0) as cuts, sum(cut) as cut_sum, sum(path) as path_sum,
  sum(low + 2*high) as links from ({_NODES_SQL}) as n group by 1""", "cut_sum path_sum")
def _store_nodes(t):
    """The trees of a saved forest, read as rows by another session."""
    root = scratch_path(t.spark, "nodes")
    ModelStore(t.spark, root).save("flows", {"forest": _mean_forest(t)})
    return _reopened(t, root).nodes().groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("feature") >= 0).alias("cuts"), F.sum("cut").alias("cut_sum"), F.sum("path").alias("path_sum"),
        F.sum(F.col("low") + 2 * F.col("high")).alias("links"))


@query("s10_model_store_score", f"""
select flow_id, raw_score, greatest(0e0, least(1e0, (raw_score - 4e-1)/(2e-1 + 1e-8))) as anomaly_score, raw_score > 48e-2 as is_anomaly
from (select flow_id, {given_score_sql('packets', 'bytes', ('mp', 'mb'))} as raw_score from flows join flow_means on true) as s""", "raw_score anomaly_score")
def _store_score(t):
    """Flows scored with a forest that another session saved and activated."""
    root = scratch_path(t.spark, "scored")
    store = ModelStore(t.spark.newSession(), root)
    save_suite(store, "flows", Models(_mean_forest(t)))
    store.activate("flows")
    forest = load_suite(ModelStore(t.spark, root)).anomaly
    return forest.score(t.flows).select("flow_id", "raw_score", "anomaly_score", "is_anomaly")


@query("s10_model_store_active", """
select v.suite, v.version::int as version, v.suite = 'quiet' and v.version = 2 as active, c.name as column_name, c.mean, c.std
from (values ('all', 1), ('quiet', 1), ('quiet', 2)) as v(suite, version) join (
  select 'all' as suite, 1 as version, 'packets' as name, avg(packets) as mean, stddev_pop(packets) as std from flows
  union all select 'all', 1, 'bytes', avg(bytes), stddev_pop(bytes) from flows
  union all select 'quiet', 1, 'packets', avg(packets), stddev_pop(packets) from flows where label = 0
  union all select 'quiet', 1, 'bytes', avg(bytes), stddev_pop(bytes) from flows where label = 0
  union all select 'quiet', 2, 'packets', avg(packets), stddev_pop(packets) from flows where label = 0 and protocol = 6
  union all select 'quiet', 2, 'bytes', avg(bytes), stddev_pop(bytes) from flows where label = 0 and protocol = 6
) as c on v.suite = c.suite and v.version = c.version""", "mean std")
def _store_active(t):
    """Three versions of two suites; the switch goes to one suite and then to another version of the other."""
    store = ModelStore(t.spark, scratch_path(t.spark, "suites"))
    for suite, rows in (("all", t.flows), ("quiet", t.flows.where("label = 0")), ("quiet", t.flows.where("label = 0 and protocol = 6"))):
        store.save(suite, {"baseline": ensemble.fit_baseline(rows, ["packets", "bytes"])})
    store.activate("all")
    store.activate("quiet")
    cells = store.cells().where("kind = 'scaler'").groupBy("suite", "version", F.col("text").alias("column_name")).agg(
        F.min_by("number", "pos").alias("mean"), F.max_by("number", "pos").alias("std"))
    suite, version = store.active()
    active = (F.col("suite") == suite) & (F.col("version") == version)
    return cells.select("suite", "version", active.alias("active"), "column_name", "mean", "std")


query("r10_detect_given_forest", f"""
with c as (select connection_id, sum(packets) as p, sum(bytes) as b from flows group by 1),
s as (select f.*, {given_score_sql('p', 'b', ('600e0', '60000e0'))} as raw from flows f join c on f.connection_id = c.connection_id),
k as (select *, greatest(0e0, least(1e0, (raw - 4e-1)/(2e-1 + 1e-8))) as anomaly_score from s)
select flow_id as seq, raw > 48e-2 as is_anomaly, anomaly_score, 28 + 20*anomaly_score as risk_score,
  case when 28 + 20*anomaly_score < 40 then 'low' else 'medium' end as severity,
  (select min_by(a.action, a.ord) from action_ranges a where 28 + 20*anomaly_score between a.lo and a.hi) as recommended_action from k""",
      "anomaly_score risk_score")(
    lambda t: detect(t.flows, Models(given_forest(["packet_count", "byte_count"], (600.0, 60000.0)))).select(
        "seq", "is_anomaly", "anomaly_score", "risk_score", "severity", "recommended_action"))
