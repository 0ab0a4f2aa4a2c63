"""Broadcast only what a count has shown to be small; anything larger takes an ordinary (adaptive) shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows and they take at most max_bytes written out; else df as it is."""
    size = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return F.broadcast(df) if size.n <= max_rows and (size.b or 0) <= max_bytes else df
