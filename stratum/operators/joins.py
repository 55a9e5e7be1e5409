"""Join helpers: size-checked broadcast, unmatched-side fill, orphan checks."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DecimalType, NumericType, StringType,
                               TimestampNTZType, TimestampType)


MAX_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan
    early), so it is cheap even when the answer is "too big"; beyond the bound
    the caller gets the plain DataFrame and Catalyst/AQE plan a shuffle join.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= max_rows and (total or 0) <= max_bytes else df


def _default_for(dtype):
    if isinstance(dtype, StringType):
        return F.lit("")
    if isinstance(dtype, DecimalType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, BooleanType):
        return F.lit(False)
    if isinstance(dtype, DateType):
        return F.lit(_dt.date(1970, 1, 1))
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    return F.lit(None).cast(dtype)


def fill_unmatched(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs in right-side columns by the type's default value."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: F.coalesce(F.col(c), _default_for(types[c])) for c in cols})


def check_references(child: DataFrame, parent: DataFrame, key: str,
                     parent_key: str | None = None) -> DataFrame:
    """Child rows whose (non-NULL) key has no parent row: a ``left_anti`` join."""
    parents = parent.select(F.col(parent_key or key).alias(key))
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")
