"""Registry of named queries: a Spark function and, where SQL can say it, the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.plans.views import VIEWS, Tables, duck_sql

_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None, dict[str, int]]] = {}


def _digits(spec: str) -> dict[str, int]:
    """"a b:2" → {"a": 6, "b": 2}."""
    out = {}
    for item in spec.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits or 6)
    return out


def query(key: str, sql: str | None = None, rounded: str = ""):
    """Register a query; the ``rounded`` columns are rounded alike on both sides."""
    def add(fn):
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")
        _QUERIES[key] = (fn, sql, _digits(rounded))
        return fn
    return add


def tidy(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns and give timestamps without a zone."""
    changes = {name: F.round(name, n) for name, n in digits.items()}
    changes.update({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema
                    if f.dataType.typeName() == "timestamp"})
    return df.withColumns(changes) if changes else df


def _text(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"cast({value} as double)" if isinstance(value, float) else str(value)


def _rows(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_text(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) as (values {body})"


def _dim_ctes() -> dict[str, str]:
    return {
        "ports": _rows("ports", "port, service, service_desc, port_risk", dims.PORTS),
        "class_severity": _rows("class_severity", "threat_class, base_severity",
                                [(n, float(s)) for n, s in dims.CLASS_SEVERITY]),
        "action_ranges": _rows("action_ranges", "ord, lo, hi, action", dims.ACTION_RANGES),
        "asset_scores": _rows("asset_scores", "asset_id, score", dims.ASSET_CRITICALITY),
        "zones": _rows("zones", "zone, multiplier", dims.ZONES),
        "kill_chain": _rows("kill_chain", "ord, threat_class, stage", dims.KILL_CHAIN),
        "ip_ranges": _rows("ip_ranges", "prio, lo, hi, kind", dims.ipv4_ranges()),
        "day_names": _rows("day_names", "dow, day", list(enumerate(dims.DAY_NAMES))),
    }


# Named parts shared by several checks; each may use the views, tables and earlier parts.
PARTS: dict[str, str] = {}


def _uses(text: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", text) is not None


def oracle_text(sql: str, digits: dict[str, int]) -> str:
    """The check SQL with the views, fixed tables and shared parts it names put in front."""
    parts: list[str] = []
    text = sql
    for name in reversed(list(PARTS)):
        if _uses(text, name):
            parts.insert(0, f"{name} as ({PARTS[name].strip()})")
            text += " " + PARTS[name]
    front = [cte for name, cte in _dim_ctes().items() if _uses(text, name)]
    front += [f"{name} as ({duck_sql(name)})" for name in VIEWS if _uses(text, name)]
    head = front + parts
    body = sql.strip()
    if digits:
        fixes = ", ".join(f"round({c}, {n}) + 0e0 as {c}" for c, n in digits.items())
        body = f"select * replace ({fixes}) from (\n{body}\n) as result"
    if not head:
        return body
    if body.startswith("with"):
        body = f"select * from (\n{body}\n) as result"
    return "with recursive " + ",\n".join(head) + "\n" + body


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(fn, digits):
        return lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir)), digits)
    return {key: runner(fn, digits) for key, (fn, _, digits) in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {key: oracle_text(sql, digits) for key, (_, sql, digits) in _QUERIES.items() if sql}
