"""Flat schemas from a short text, without a session."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<bigint>": T.ArrayType(T.LongType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def flat(text: str) -> T.StructType:
    """``"a string, b int"`` as a schema of nullable columns."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])
