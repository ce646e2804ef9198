"""Column layouts of the tables that cross module borders."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# One row per executed command; a record without commands is one row whose
# step columns are null. Long form, so a record may hold any number of commands.
LEDGER = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("record_success", T.BooleanType()),
    T.StructField("dry_run", T.BooleanType()),
    T.StructField("executed_at", T.TimestampType()),
    T.StructField("step", T.LongType()),
    T.StructField("rule_type", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("output", T.StringType()),
    T.StructField("rollback_command", T.StringType()),
])
