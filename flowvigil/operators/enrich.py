"""Port and address enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil import dims
from flowvigil.functions.ip import ip_location, ip_type
from flowvigil.operators.networks import longest_prefix


def port_service(df: DataFrame, port: str = "dst_port") -> DataFrame:
    """Add service, service_desc and port_risk; a port outside the table is UNKNOWN."""
    # 35 fixed rows
    table = F.broadcast(dims.ports(df.sparkSession).withColumnRenamed("port", port))
    joined = df.join(table, port, "left")
    service, desc, risk = dims.UNKNOWN_PORT
    return joined.select(*df.columns, F.coalesce("service", F.lit(service)).alias("service"),
                         F.coalesce("service_desc", F.lit(desc)).alias("service_desc"),
                         F.coalesce("port_risk", F.lit(risk)).alias("port_risk"))


def ip_types(df: DataFrame, column: str, name: str = "ip_type") -> DataFrame:
    return df.withColumn(name, ip_type(column))


def ip_locations(df: DataFrame, column: str, name: str = "location") -> DataFrame:
    return df.withColumn(name, ip_location(ip_type(column)))


def network_labels(df: DataFrame, column: str, networks: DataFrame, row_id: str) -> DataFrame:
    """The columns of a table of networks, of any size, for each row's address; the longest prefix decides."""
    return longest_prefix(df, column, networks, row_id)
