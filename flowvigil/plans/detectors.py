"""Queries of the anomaly detectors."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from flowvigil.operators import baselines, clean, context, curved, ensemble, evaluate, isolation, kmeans, reconstruction
from flowvigil.plans.registry import PARTS, query
from flowvigil.session import materialise, scratch_path

COLUMNS = context.MODEL_COLUMNS


def _features(t):
    """The 21-column model input of every flow, written once because fits read it often."""
    return materialise(context.model_features(t.flows))


@query("d1_isolation_forest")
def _isolation(t):
    features = _features(t)
    model = isolation.fit_isolation_forest(features, COLUMNS, "flow_id")
    return model.score(features).select("flow_id", "raw_score", "anomaly_score", "is_anomaly")


query("d2_isolation_score_norm", """
select seq, 1 - (s - lo)/(hi - lo + 1e-8) as anomaly_score from (select seq, -confidence*anomaly_score as s from detections) as d
join (select min(-confidence*anomaly_score) as lo, max(-confidence*anomaly_score) as hi from detections) as b on true""",
      "anomaly_score")(
    lambda t: isolation.normalise_within(
        t.detections.select("seq", (-F.col("confidence") * F.col("anomaly_score")).alias("s")), "s").drop("s"))


@query("d3_reconstruction_error")
def _reconstruction(t):
    vectors = t.table("embeddings")
    size = 64
    columns = [f"v{i}" for i in range(size)]
    wide = vectors.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    return reconstruction.fit_autoencoder(wide, columns, "vec_id", encoding_dim=32).score(wide, "vec_id")


@query("d3_curved_reconstruction")
def _curved(t):
    vectors = t.table("embeddings")
    columns = [f"v{i}" for i in range(64)]
    wide = vectors.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    return curved.fit_curved_autoencoder(wide, columns, "vec_id").score(wide, "vec_id")


@query("d3_error_threshold", """
with e as (select event_id, value as error from events), q as (select quantile_cont(error, 0.95) as thr from e)
select event_id, error, greatest(0e0, least(1e0, error/(thr + 1e-8))) as anomaly_score, error > thr as is_anomaly
from e join q on true""", "anomaly_score")
def _threshold(t):
    errors = t.events.select("event_id", F.col("value").alias("error"))
    return reconstruction.score_errors(errors, reconstruction.error_threshold(errors))


@query("d4_sequence_error")
def _sequence(t):
    rows = t.flows.select("user_id", "ts", "flow_id", "bytes", "packets", "flow_duration")
    model = reconstruction.fit_sequence_model(rows, ["bytes", "packets", "flow_duration"], "user_id", ["ts", "flow_id"])
    return model.score(rows)


@query("d5_kmeans")
def _kmeans(t):
    features = _features(t)
    model = kmeans.fit_kmeans(features, COLUMNS, "flow_id")
    return model.score(features, "flow_id").drop("distances")


_CENTRES = [(10.0, 1.0), (50.0, 4.0), (90.0, 12.0)]
_NEAREST = "least(" + ", ".join(f"sqrt((packets-{a})*(packets-{a}) + (flow_duration-{b})*(flow_duration-{b}))" for a, b in _CENTRES) + ")"


@query("d5_kmeans_scoring", f"""
with d as (select flow_id, {_NEAREST} as distance from flows), q as (select quantile_cont(distance, 0.9) as thr from d)
select flow_id, distance, greatest(0e0, least(1e0, distance/(thr + 1e-8))) as anomaly_score, distance > thr as is_anomaly
from d join q on true""", "distance anomaly_score")
def _given_centres(t):
    distances = kmeans.centre_distances(["packets", "flow_duration"], _CENTRES)
    rows = t.flows.select("flow_id", F.array_min(distances).alias("distance"))
    return kmeans.score_distances(rows, kmeans.exact_quantiles(rows, {"distance": 0.9})["distance"])


@query("d6_mahalanobis")
def _mahalanobis(t):
    features = _features(t)
    model = kmeans.fit_kmeans(features, context.NETWORK_COLUMNS, "flow_id", metric="mahalanobis")
    return model.score(features, "flow_id").drop("distances")


@query("d7_cluster_info")
def _cluster_info(t):
    features = _features(t)
    model = kmeans.fit_kmeans(features, COLUMNS, "flow_id")
    return model.with_distances(features, "flow_id").withColumns(
        {"threshold": F.lit(model.threshold), "n_clusters": F.lit(len(model.centres))})


@query("d8_silhouette")
def _silhouette(t):
    features = _features(t)
    model = kmeans.fit_kmeans(features, COLUMNS, "flow_id", silhouette=True)
    return t.spark.createDataFrame([(len(model.centres), float(model.cost), float(model.silhouette))],
                                   "n_clusters int, cost double, silhouette double")


@query("d9_normal_only_fit")
def _normal_only(t):
    labelled = materialise(context.model_features(t.flows).join(t.flows.select("flow_id", "label"), "flow_id"))
    split = clean.stratified_split(labelled, "label", "flow_id")
    model = kmeans.fit_kmeans(split.where("not held_out and label = 0"), COLUMNS, "flow_id")
    held_out = split.where("held_out")
    scored = model.score(held_out, "flow_id").join(held_out.select("flow_id", F.col("label").alias("y_true")), "flow_id")
    return evaluate.binary_metrics(scored.withColumn("y_pred", F.col("is_anomaly").cast("int")))


@query("d10_ensemble_score", """
select seq, (a + c + coalesce(b, 0e0))/(2 + (b is not null)::int) as ensemble_score,
  (a + c + coalesce(b, 0e0))/(2 + (b is not null)::int) > 7e-1 as soft_anomaly,
  (a > 5e-1)::int + coalesce((b > 5e-1)::int, 0) + (c > 5e-1)::int > 15e-1 as hard_anomaly
from (select seq, anomaly_score as a, case when seq%3 <> 0 then confidence end as b, seq%10/10e0 as c from detections) as d""",
       "ensemble_score")
def _ensemble(t):
    rows = t.detections.select(
        "seq", F.col("anomaly_score").alias("a"), F.when(F.col("seq") % 3 != 0, F.col("confidence")).alias("b"),
        ((F.col("seq") % 10) / 10.0).alias("c"))
    flagged = rows.withColumns({f"{n}_flag": F.col(n) > 0.5 for n in "abc"})
    return ensemble.combine(flagged, ["a", "b", "c"], ["a_flag", "b_flag", "c_flag"]).select(
        "seq", "ensemble_score", "soft_anomaly", "hard_anomaly")


PARTS["flow_z"] = """
select flow_id, (packets - mp)/(sp + 1e-8) as zp, (bytes - mb)/(sb + 1e-8) as zb, (flow_duration - md)/(sd + 1e-8) as zd
from flows join (select avg(packets) as mp, stddev_pop(packets) as sp, avg(bytes) as mb, stddev_pop(bytes) as sb,
  avg(flow_duration) as md, stddev_pop(flow_duration) as sd from flows) as s on true"""
_BASE = ["packets", "bytes", "flow_duration"]

query("d11_baseline_zscore", """
select flow_id, least(greatest(abs(zp), abs(zb), abs(zd))/5e0, 1e0) as divergence from flow_z""", "divergence")(
    lambda t: t.flows.select("flow_id", ensemble.divergence(ensemble.fit_baseline(t.flows, _BASE)).alias("divergence")))


@query("d12_zero_day", """
select flow_id, divergence, anomaly_score, divergence > 9e-1 and anomaly_score > 8e-1 as is_zero_day,
  (divergence + anomaly_score)/2 as zero_day_confidence,
  concat_ws(',', case when zp > 3 or zb > 3 or zd > 3 then 'extreme_statistical_outlier' end,
    case when zp < -3 or zb < -3 or zd < -3 then 'unusual_low_values' end) as indicators
from (select z.*, least(greatest(abs(zp), abs(zb), abs(zd))/5e0, 1e0) as divergence, least(bytes/10000e0, 1e0) as anomaly_score
  from flow_z z join flows f on z.flow_id = f.flow_id) as d""", "divergence anomaly_score zero_day_confidence")
def _zero_day(t):
    rows = t.flows.select("flow_id", *_BASE, F.least(F.col("bytes") / 10000, F.lit(1.0)).alias("anomaly_score"))
    found = ensemble.zero_day(rows, ensemble.fit_baseline(t.flows, _BASE))
    return found.select("flow_id", "divergence", "anomaly_score", "is_zero_day", "zero_day_confidence",
                        F.array_join("indicators", ",").alias("indicators"))


# --- baselines per entity -----------------------------------------------------

PARTS["last_day"] = "select max(cast(ts as date)) as d from flows"
PARTS["user_base"] = """
select user_id, count(*) as samples, avg(packets) as mp, stddev_pop(packets) as sp, avg(bytes) as mb, stddev_pop(bytes) as sb,
  avg(flow_duration) as md, stddev_pop(flow_duration) as sd
from flows join last_day on cast(ts as date) >= d - interval '13 days' and cast(ts as date) < d group by 1 having count(*) >= 4"""


def _user_baselines(t, runs: int = 2):
    """Moments of all days but the last one, added in ``runs`` steps: what each step read, and the store."""
    store = baselines.BaselineStore(t.spark, scratch_path(t.spark, "moments"), "user_id", _BASE)
    last = t.flows.agg(F.to_date(F.max("ts"))).first()[0]
    steps = [store.refresh(t.flows, last - timedelta(days=runs - 1 - i)) for i in range(runs)]
    return steps, store, last


query("x2_baseline_merged", """
select user_id, samples, mp as packets_mean, sp as packets_std, mb as bytes_mean, sb as bytes_std, md as duration_mean, sd as duration_std
from user_base""", "packets_mean packets_std bytes_mean:4 bytes_std:4 duration_mean duration_std")(
    lambda t: (lambda store, last: store.baseline(last, days=13, min_samples=4).select(
        "user_id", "samples", *(F.col(f"baseline.{c}.{part}").alias(f"{name}_{part}")
                                for c, name in zip(_BASE, ("packets", "bytes", "duration")) for part in ("mean", "std"))))(*_user_baselines(t)[1:]))


@query("x2_baseline_refresh", """
select run, count(distinct cast(ts as date)) as days_read, count(*) as rows_read from flows join last_day on true
join (values (1, -100000, 3), (2, 3, 2), (3, 2, 1), (4, 1, 0)) as r(run, after, upto)
  on (after < 0 or cast(ts as date) >= d - to_days(after)) and cast(ts as date) < d - to_days(upto) group by 1""")
def _refresh(t):
    """Four days in a row: after the first run each one reads the new day only."""
    steps, _, _ = _user_baselines(t, 4)
    reads = [t.flows.where((F.to_date("ts") < F.lit(end)) & (F.lit(True) if since is None else F.to_date("ts") >= F.lit(since))).agg(
        F.lit(i + 1).alias("run"), F.countDistinct(F.to_date("ts")).alias("days_read"), F.count("*").alias("rows_read")) for i, (since, end) in enumerate(steps)]
    out = reads[0]
    for more in reads[1:]:
        out = out.unionByName(more)
    return out


@query("d12_zero_day_entity", """
select flow_id, divergence, divergence > 9e-1 and anomaly_score > 8e-1 as is_zero_day, (divergence + anomaly_score)/2 as zero_day_confidence,
  concat_ws(',', case when zp > 3 or zb > 3 or zd > 3 then 'extreme_statistical_outlier' end,
    case when zp < -3 or zb < -3 or zd < -3 then 'unusual_low_values' end) as indicators
from (select *, least(greatest(abs(zp), abs(zb), abs(zd))/5e0, 1e0) as divergence from (
  select f.flow_id, least(bytes/10000e0, 1e0) as anomaly_score, coalesce((packets - u.mp)/(u.sp + 1e-8), z.zp) as zp,
    coalesce((bytes - u.mb)/(u.sb + 1e-8), z.zb) as zb, coalesce((flow_duration - u.md)/(u.sd + 1e-8), z.zd) as zd
  from flows f join flow_z z on f.flow_id = z.flow_id left join user_base u on f.user_id = u.user_id) as s) as d""",
       "divergence:4 zero_day_confidence:4")
def _zero_day_entity(t):
    """Each flow against its user's own baseline, or against all flows where the user has too few."""
    _, store, last = _user_baselines(t)
    rows = t.flows.select("flow_id", "user_id", *_BASE, F.least(F.col("bytes") / 10000, F.lit(1.0)).alias("anomaly_score"))
    joined, z = baselines.with_entity_z(rows, store.baseline(last, days=13, min_samples=4), "user_id", _BASE, "flow_id", ensemble.fit_baseline(t.flows, _BASE))
    return ensemble.zero_day(joined, z).select("flow_id", "divergence", "is_zero_day", "zero_day_confidence", F.array_join("indicators", ",").alias("indicators"))
