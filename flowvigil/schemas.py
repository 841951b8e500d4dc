"""Explicit schemas: no inference pass over the data."""

from pyspark.sql import types as T

FLOW_FIELDS = [
    ("timestamp", T.TimestampType()), ("src_ip", T.StringType()), ("dst_ip", T.StringType()),
    ("src_port", T.IntegerType()), ("dst_port", T.IntegerType()), ("protocol", T.IntegerType()),
    ("packets", T.LongType()), ("bytes", T.LongType()), ("flow_duration", T.DoubleType()),
]
REQUIRED = [name for name, _ in FLOW_FIELDS]
OPTIONAL_FIELDS = [("flags", T.StringType()), ("service", T.StringType())]
FLOW = T.StructType([T.StructField(n, t) for n, t in FLOW_FIELDS])
EVENT = T.StructType([T.StructField(n, t) for n, t in FLOW_FIELDS + OPTIONAL_FIELDS])
