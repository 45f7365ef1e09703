"""The index tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _schema(columns: str) -> T.StructType:
    """From "name type, ..."; unlike Spark's own reader it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


FILES = _schema("repo string, path string, hash string, line_count long, size long, mtime timestamp, indexed_at timestamp")
SYMBOLS = _schema("symbol_id long, repo string, file string, name string, kind string, start_byte long, end_byte long, signature string, docstring string, embedding array<float>, seq int")
CALLS = _schema("symbol_id long, repo string, file string, caller_name string, callee_name string, seq int")
EDGES = _schema("caller_id long, repo string, caller_file string, caller_name string, callee_name string, callee_file string")
ROUTES = _schema("repo string, file string, method string, path string, handler string, start_byte long, end_byte long")
REPOS = _schema("name string, root_path string, db_path string, last_indexed timestamp")
TABLES = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "routes": ROUTES}
