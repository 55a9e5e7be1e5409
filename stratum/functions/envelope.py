"""Decoders for values inside a change-event envelope (connector defaults).

A change connector without schema-aware converters ships
* DECIMAL as base64 of the big-endian two's-complement unscaled integer,
* DATE as days since 1970-01-01,
* TIMESTAMP (no zone) as microseconds since 1970-01-01 (wall clock).
All decoders are built-in expressions (no Python UDF); unscaled values of up
to 16 bytes are supported (DECIMAL(38, s)).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_decimal(c, scale: int, precision: int = 18) -> Column:
    """NULL where the value has more than 16 bytes or does not fit the type."""
    h = F.hex(F.unbase64(_c(c)))
    negative = F.substring(h, 1, 1) >= "8"      # upper-case digits in code point order
    # up to 8 bytes are a long; only longer values need two halves
    short = F.conv(F.when(negative, F.lpad(h, 16, "F")).otherwise(h), 16, -10).cast("decimal(19,0)")
    wide = F.when(negative, F.lpad(h, 32, "F")).otherwise(F.lpad(h, 32, "0"))
    high = F.conv(F.substring(wide, 1, 16), 16, -10).cast("decimal(19,0)")   # signed half
    low = F.conv(F.substring(wide, 17, 16), 16, 10).cast("decimal(20,0)")    # unsigned half
    unscaled = F.try_add(F.try_multiply(high, F.lit(Decimal(2**64))), low.cast("decimal(38,0)"))
    unit = F.lit(Decimal(1).scaleb(-scale))
    kind = f"decimal({precision},{scale})"
    return (F.when(F.length(h).between(1, 16), F.try_multiply(short, unit).try_cast(kind))
             .when(F.length(h).between(17, 32), F.try_multiply(unscaled, unit).try_cast(kind)))


def encode_decimal(c, scale: int) -> Column:
    """Inverse of ``decode_decimal`` with minimal-length bytes (sign kept)."""
    unscaled = (_c(c).cast("decimal(38,10)") * F.lit(10 ** scale)).cast("long")
    h = F.hex(unscaled)                         # no leading zeros; 16 digits below zero
    # whole bytes, and 00 before a byte >= 0x80; of negative values FF before >= 0x80 goes
    plus = (F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h))
             .when(F.substring(h, 1, 1) >= "8", F.concat(F.lit("00"), h)).otherwise(h))
    minus = F.regexp_replace(h, r"^(?:FF)+(?=[89A-F])", "")
    return F.base64(F.unhex(F.when(unscaled < 0, minus).otherwise(plus)))


def decode_date(c) -> Column:
    return F.date_from_unix_date(_c(c).cast("int"))


def encode_date(c) -> Column:
    return F.unix_date(F.to_date(_c(c)))


def decode_micros(c) -> Column:
    """Micros since epoch -> zone-less timestamp (wall clock, session in UTC)."""
    return F.timestamp_micros(_c(c).cast("long")).cast("timestamp_ntz")


def encode_micros(c) -> Column:
    return F.unix_micros(_c(c).cast("timestamp"))
