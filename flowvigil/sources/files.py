"""Readers: parquet, CSV, ARFF, JSON event batches, recent time range."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowvigil import schemas


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One file, or every parquet file of a folder."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("recursiveFileLookup", "true").parquet(path) if not path.endswith(".parquet") else reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; pass a schema, or types are inferred by one more pass."""
    reader = spark.read.option("header", "true").option("nanValue", "NaN")
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    return reader.schema(schema).csv(path)


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.+)", re.IGNORECASE)


def arff_schema(lines: Sequence[str]) -> T.StructType:
    """Schema from ``@attribute`` lines; numeric kinds become DOUBLE, others STRING."""
    fields = []
    for line in lines:
        found = _ATTRIBUTE.match(line.strip())
        if found:
            number = found.group(2).strip().lower() in ("numeric", "real", "integer")
            fields.append(T.StructField(found.group(1).strip("'\""), T.DoubleType() if number else T.StringType()))
    return T.StructType(fields)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF text: the header declares the attributes, comments start with ``%``, the rest is comma data.

    Header lines are the declarations in the first block of a file, so data may begin with ``@``.
    The files of a folder must declare the same attributes.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_first"))
    text = F.trim("value")
    declares = F.col("_first") & text.rlike(r"(?i)^@(relation\s|attribute\s|data\s*$)")
    # one line per attribute
    header = lines.where(declares & text.rlike(r"(?i)^@attribute\s")).withColumn(
        "_at", F.monotonically_increasing_id()).orderBy("_at").select("_file", "value").collect()
    declared: dict[str, list[str]] = {}
    for row in header:
        declared.setdefault(row["_file"], []).append(row["value"])
    schemas_found = [arff_schema(rows) for rows in declared.values()] or [arff_schema([])]
    schema = schemas_found[0]
    if any(other != schema for other in schemas_found):
        raise ValueError("the files declare different attributes")
    data = lines.where((F.length(text) > 0) & ~declares & ~text.startswith("%"))
    parsed = F.from_csv(F.col("value"), schema.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": "'"}) \
        if all(re.fullmatch(r"\w+", f.name) for f in schema) else F.from_csv(
            F.col("value"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), {"quote": "'"})
    return data.select(parsed.alias("r")).select("r.*")


def parse_json_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text → event columns plus ``_bad``: null, or the text of a row that fails.

    A row fails when it is not JSON, a field has the wrong type, or a required field
    is absent.
    """
    schema = T.StructType([*schemas.EVENT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("_e", F.from_json(column, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    complete = F.lit(True)
    for name in schemas.REQUIRED:
        complete = complete & F.col(f"_e.{name}").isNotNull()
    bad = F.when(F.col("_e._corrupt").isNotNull() | F.col("_e").isNull() | ~complete, F.col(column))
    kept = [c for c in lines.columns if c != column]
    return parsed.select(*kept, *[f"_e.{f.name}" for f in schemas.EVENT.fields], bad.alias("_bad"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_bad").isNull()).drop("_bad")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_bad").isNotNull())


def newest_time(df: DataFrame, at: str) -> datetime | None:
    """The latest event time: stands for "now" so that results can be repeated."""
    return df.agg(F.max(at)).first()[0]


def at_literal(moment: datetime | None, kind: T.DataType) -> Column:
    """The moment as a literal of the column type ``kind``, whatever zone the driver's system has.

    A time without a zone means itself for columns without a zone, and the system's time for others. No moment, as of
    an empty table, is null.
    """
    if moment is None:
        return F.lit(None).cast(kind)
    text = moment.isoformat(" ") if isinstance(kind, T.TimestampNTZType) else moment.astimezone(timezone.utc).isoformat(" ")
    return F.lit(text).cast(kind)


def recent_range(df: DataFrame, at: str = "ts", minutes: float = 5, limit: int | None = None,
                 as_of: datetime | None = None) -> DataFrame:
    """Events of the last ``minutes``, newest first; at most ``limit`` if one is given, ties in time by the other columns.

    The bounds are literals, so the range reaches the scan as a pushed filter.
    """
    as_of = newest_time(df, at) if as_of is None else as_of
    end = at_literal(as_of, df.schema[at].dataType)
    start = end - F.expr(f"interval {int(minutes * 60)} seconds")
    found = df.where((F.col(at) >= start) & (F.col(at) <= end))
    others = [f.name for f in df.schema if f.name != at and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordered = found.orderBy(F.col(at).desc(), *others)
    return ordered if limit is None else ordered.limit(limit)


def recent_cache(df: DataFrame, at: str = "ts", ttl_seconds: int = 3600, as_of: datetime | None = None) -> DataFrame:
    """Events younger than the time-to-live, with the minute bucket they are kept under."""
    as_of = newest_time(df, at) if as_of is None else as_of
    start = at_literal(as_of, df.schema[at].dataType) - F.expr(f"interval {ttl_seconds} seconds")
    return df.where(F.col(at) > start).withColumn(
        "cache_key", F.concat(F.lit("recent_events:"), F.date_format(at, "yyyyMMddHHmm")))
