"""Context codes, assembly of feature groups, and scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowvigil import dims
from flowvigil.operators import network, temporal, user
from flowvigil.operators.skew import AUTO, attach_by_key, find_hot, key_sizes, number_rows


# --- category codes ---------------------------------------------------------

def fit_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): each distinct non-null value with its place in sorted order."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return number_rows(distinct, [column], "code").select(column, F.col("code").cast("int").alias("code"))


def apply_codes(df: DataFrame, column: str, codes: DataFrame, name: str,
                unseen: str = "error") -> DataFrame:
    """Attach the code of ``column``; ``unseen`` is error, first (code 0) or keep (null).

    The code table is joined without a hint: it is broadcast when its measured size
    allows, else shuffled with skewed categories split at run time.
    """
    joined = df.join(codes.withColumnRenamed("code", name), column, "left").select(*df.columns, name)
    missing = F.col(name).isNull() & F.col(column).isNotNull()
    if unseen == "error":
        fail = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col(column).cast("string")))
        return joined.withColumn(name, F.when(missing, fail.cast("int")).otherwise(F.col(name)))
    if unseen == "first":
        return joined.withColumn(name, F.when(missing, F.lit(0)).otherwise(F.col(name)))
    if unseen == "keep":
        return joined
    raise ValueError(f"unseen must be error, first or keep, not {unseen!r}")


def geo_department_codes(events: DataFrame) -> DataFrame:
    out = events
    for column, name in (("geolocation", "geo_encoded"), ("department", "department_encoded")):
        if column in events.columns:
            out = apply_codes(out, column, fit_codes(events, column), name)
    return out


def asset_criticality(events: DataFrame) -> DataFrame:
    # five fixed rows
    table = F.broadcast(dims.asset_criticality(events.sparkSession))
    return events.join(table, "asset_id", "left").select(
        *events.columns, F.coalesce("asset_criticality", F.lit(0.0)).alias("asset_criticality"))


def contextual_features(events: DataFrame) -> DataFrame:
    """Per event: place and department codes, asset criticality, device habits of the user."""
    out = geo_department_codes(events)
    if "asset_id" in events.columns:
        out = asset_criticality(out)
    if "device_id" in events.columns:
        out = attach_by_key(out, user.device_consistency(events), "user_id", "event_id")
    return out


# --- custom features --------------------------------------------------------

_CUSTOM: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {}


def register_feature(name: str, fn: Callable[[DataFrame], DataFrame], key: str) -> None:
    """Add a feature group: ``fn(events)`` gives one row per ``key`` with new columns."""
    _CUSTOM[name] = (fn, key)


def unregister_feature(name: str) -> None:
    _CUSTOM.pop(name, None)


def custom_features(events: DataFrame, names: Iterable[str] | None = None, row_id: str = "event_id",
                    source: DataFrame | None = None) -> DataFrame:
    """Join the registered groups (all, or ``names``) to the events, each on its own key.

    The groups are made from ``source``, or from the events themselves.
    """
    out = events
    for name in (_CUSTOM if names is None else names):
        fn, key = _CUSTOM[name]
        extra = fn(events if source is None else source)
        if key == row_id:
            out = out.join(extra, key, "left")
        else:
            out = attach_by_key(out, extra, key, row_id)
    return out


# --- assembly ---------------------------------------------------------------

NETWORK_COLUMNS = ["packet_count", "byte_count", "duration", "packets_per_second", "bytes_per_second",
                   "avg_packet_size", "protocol_entropy", "port_entropy", "unique_dst_ips",
                   "unique_dst_ports", "packet_size_variance", "packet_size_std"]
CONTEXT_COLUMNS = ["geo_encoded", "department_encoded", "asset_criticality", "unique_devices", "device_consistency"]
MODEL_COLUMNS = NETWORK_COLUMNS + temporal.TIME_COLUMNS  # the default 21-column model input


def assemble_features(flows: DataFrame, user_events: DataFrame | None = None, *,
                      groups: Iterable[str] = ("network", "user", "temporal", "contextual"),
                      row_id: str = "flow_id", custom: Iterable[str] | None = None) -> DataFrame:
    """One row per event with the enabled groups joined on their real keys; null → 0.

    ``user_events`` holds the user-behaviour columns (``event_id``, ``user_id``, ...)
    of the same events; needed for the user and contextual groups only. ``custom`` names the
    registered groups to add (all when None); they are made from ``flows``.
    """
    groups = set(groups)
    out = flows.select(row_id, "ts", *[c for c in ("user_id", "connection_id") if c in flows.columns])
    added: list[str] = []
    # one look for busy users serves the ordered scans and the join below
    per_user_work = "user_id" in out.columns and ("temporal" in groups or "user" in groups)
    busy, largest = AUTO, None
    if per_user_work:
        sizes = key_sizes(out, ["user_id"])
        busy, largest = find_hot(out, ["user_id"], "ts", sizes=sizes), sizes[0]
    if "temporal" in groups:
        out = temporal.temporal_features(out, row_id=row_id, hot=busy, largest=largest)
    elif "clock" in groups:
        out = temporal.clock_features(out)
    added += [c for c in out.columns if c not in (row_id, "ts", "user_id", "connection_id")]
    if "network" in groups:
        per_connection = network.network_features(flows)
        names = [c for c in per_connection.columns if c not in ("connection_id", "flow_count")]
        out = attach_by_key(out, per_connection.drop("flow_count"), "connection_id", row_id)
        added += names
    if "user" in groups and user_events is not None:
        per_user = user.user_features(user_events, hot=busy)
        names = [c for c in per_user.columns if c not in ("user_id", "event_count")]
        out = attach_by_key(out, per_user.drop("event_count"), "user_id", row_id, hot=busy)
        added += names
    if "contextual" in groups and user_events is not None:
        coded = contextual_features(user_events)
        names = [c for c in CONTEXT_COLUMNS if c in coded.columns]
        out = out.join(coded.select(F.col("event_id").alias(row_id), *names), row_id, "left")
        added += names
    before = set(out.columns)
    out = custom_features(out, custom, row_id, flows)
    added += [c for c in out.columns if c not in before]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in added})


def model_features(flows: DataFrame) -> DataFrame:
    """The 21-column model input, one row per event."""
    return assemble_features(flows, groups=("network", "clock"), custom=()).select(
        "flow_id", *[F.col(c).cast("double").alias(c) for c in MODEL_COLUMNS])


# --- scaling ----------------------------------------------------------------

def numeric_columns(df: DataFrame, besides: Iterable[str] = ()) -> list[str]:
    skip = set(besides)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population deviation)}, found in one aggregate."""
    stats = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
                   *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    return {c: (stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 0.0) for i, c in enumerate(columns)}


def scaled(column: str, mean: float, deviation: float) -> Column:
    if deviation == 0.0:
        return F.col(column) * F.lit(0.0)
    return (F.col(column) - F.lit(mean)) / F.lit(deviation)


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """z-scores with the fitted parameters; a constant column becomes 0."""
    return df.withColumns({c: scaled(c, m, s) for c, (m, s) in scaler.items()})
