"""Whether a table is small enough to go to every executor: its rows and bytes are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is sent whole.
MOST_BYTES = 16 << 20


def fits(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``df``, of plain columns, has no more rows and bytes than these; a value of fixed width counts as 16 bytes."""
    if any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
        return False
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    told = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(wide, F.lit(16 * len(df.columns)))), F.lit(0)).alias("bytes")).first()
    return told.rows <= most_rows and told.bytes <= most_bytes


def small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` to be broadcast, if it fits."""
    return F.broadcast(df) if fits(df, most_rows, most_bytes) else df
