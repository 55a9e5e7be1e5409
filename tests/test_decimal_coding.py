"""Connector decimals: short values decode through one long, whatever their sign and scale."""
from decimal import Decimal

from pyspark.sql import functions as F

from stratum.functions.envelope import decode_decimal, encode_decimal


def test_every_length_and_sign_comes_back(spark):
    ints = [0, 1, -1] + [s * (2**k + e) for k in range(62) for e in (-1, 0, 1) for s in (1, -1)]
    rows = [(Decimal(v).scaleb(-2), (v.to_bytes((v + (v < 0)).bit_length() // 8 + 1, "big", signed=True))) for v in ints]
    df = spark.createDataFrame([*rows, (None, None)], "v decimal(38,2), raw binary")
    out = df.select("v", "raw", encode_decimal("v", 2).alias("t")).select(
        "v", (F.base64("raw").eqNullSafe(F.col("t"))).alias("same"), decode_decimal("t", 2, 38).alias("back")).collect()
    assert all(r["same"] and r["back"] == r["v"] for r in out)


def test_digits_of_a_large_scale_are_kept(spark):
    text = encode_decimal(F.lit(Decimal("1.0123456789")), 10)
    assert spark.range(1).select(decode_decimal(text, 10, 38).alias("x")).first().x == Decimal("1.0123456789")
