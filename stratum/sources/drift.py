"""Change records whose fields drift: VARIANT bronze.

A record without a declared schema is parsed once, into a VARIANT, and kept
whole in bronze.  Silver reads the fields it knows with ``try_variant_get``;
fields it does not know stay beside them as JSON, and a report says which
fields came, went or changed their type, with the type that would hold them.

Defined cases: a value that is no JSON, has an unknown ``op``, no row image or
an image without its key is ``bad`` (kept in bronze, left out of silver and of
the report); a NULL value is a tombstone and is neither.  A field whose value
is JSON null counts as missing.  A field of another type than declared is read
where the cast allows it ("5" as a number), else NULL, and named either way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, MapType, NumericType, StringType,
                               StructType)

from .cdc import ALL_OPS


def _at(doc: Column, name: str, kind: str = "variant") -> Column:
    if "'" in name or "\\" in name:
        raise ValueError(f"field name {name!r} cannot be written as a path")
    return F.try_variant_get(doc, f"$['{name}']", kind)


def _kind(t: Column) -> Column:
    """What JSON calls a type of ``schema_of_variant``; NULL for null and for no value.
    The type is read several times: give it as a column, not as an expression."""
    return (F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array")
            .when(t != "VOID", "number"))


def variant_bronze(changes: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """``value`` becomes ``env`` (VARIANT); adds ``op``, ``image`` (VARIANT: the
    row a record carries) and ``bad``.  Write the result: readers then get the
    binary form, and no text is parsed again."""
    p = changes.select("*", F.explode(F.array(F.try_parse_json("value"))).alias("env"))
    p = p.withColumn("op", _at(F.col("env"), "op", "string"))
    p = p.withColumn("image", F.when(F.col("op") == "d", _at(F.col("env"), "before")).otherwise(_at(F.col("env"), "after")))
    good = F.col("op").isin(list(ALL_OPS))
    if not key:
        good = good & F.schema_of_variant("image").startswith("OBJECT")
    for k in key:       # only an object has a field, so its type need not be asked
        good = good & (F.schema_of_variant(_at(F.col("image"), k)) != "VOID")
    return p.withColumn("bad", F.col("value").isNotNull() & ~F.coalesce(good, F.lit(False))).drop("value")


def _rows(bronze: DataFrame) -> DataFrame:
    return bronze.where(F.col("op").isNotNull() & ~F.col("bad"))


def _declared(kind: DataType) -> str:
    for types, name in ((StringType, "string"), (BooleanType, "boolean"), ((StructType, MapType), "object"),
                        (ArrayType, "array"), (NumericType, "number")):
        if isinstance(kind, types):
            return name
    raise ValueError(f"{kind.simpleString()} has no JSON type: declare the encoded one")


def _apart(bronze: DataFrame, row: StructType) -> DataFrame:
    """The row images, each taken apart once: ``__all`` (map of all fields), and of known
    field number i its value ``__v<i>`` and type ``__t<i>``.  These are columns of steps of
    their own, so the many conditions on a field read it and do not extract it again."""
    every = _rows(bronze).withColumn("__all", F.col("image").cast("map<string,variant>"))
    values = every.select("*", *[F.col("__all").getItem(f.name).alias(f"__v{i}") for i, f in enumerate(row.fields)])
    return values.select("*", *[F.schema_of_variant(f"__v{i}").alias(f"__t{i}") for i in range(len(row.fields))])


def _retyped(row: StructType) -> list[tuple[str, Column]]:
    return [(f.name, _kind(F.col(f"__t{i}")) != _declared(f.dataType)) for i, f in enumerate(row.fields)]


def _unknown(row: StructType) -> Column:
    """Names of the fields that the schema does not have; NULL for none."""
    met = sum((F.col(f"__v{i}").isNotNull().cast("int") for i in range(len(row.fields))), F.lit(0))
    names = F.array_except(F.map_keys("__all"), F.array(*[F.lit(f.name) for f in row.fields]))
    return F.when(F.size("__all") > met, names)


def conform(bronze: DataFrame, row: StructType) -> DataFrame:
    """Typed rows of the records of a bronze table: the fields of ``row``, then
    ``op``, ``_offset``, ``rest`` (unknown fields as JSON text, NULL for none) and
    ``retyped`` (known fields of another JSON type, joined by commas)."""
    named = F.concat_ws(",", *[F.when(cond, name) for name, cond in _retyped(row)])
    known = [f.name for f in row.fields]
    rest = F.when(_unknown(row).isNotNull(), F.map_filter("__all", lambda k, v: ~k.isin(known)))
    return _apart(bronze, row).select(
        *[_at(F.col("image"), f.name, f.dataType.simpleString()).alias(f.name) for f in row.fields],
        "op", F.col("offset").alias("_offset"), F.to_json(rest).alias("rest"), named.alias("retyped"))


def drift_report(bronze: DataFrame, row: StructType) -> DataFrame:
    """field, status (``added``, ``missing``, ``retyped``), found (the SQL type
    that holds all values met, VOID for none), records.

    Only the deviations of a record become rows, so a topic that keeps to its
    schema shuffles nothing; the counts and types combine before the exchange.
    """
    known = [f.name for f in row.fields]
    off = F.array(*[F.when(F.coalesce(retyped, F.lit(True)), name) for name, retyped in _retyped(row)])
    names = F.concat(off, F.coalesce(_unknown(row), F.array().cast("array<string>")))
    found = _apart(bronze, row).select("__all", F.explode(names).alias("field")).where(F.col("field").isNotNull())
    found = found.withColumn("value", F.col("__all")[F.col("field")]).withColumn("type", F.schema_of_variant("value"))
    added, missing = ~F.col("field").isin(known), _kind(F.col("type")).isNull()
    status = F.when(added, "added").when(missing, "missing").otherwise("retyped")
    return (found.select("field", status.alias("status"), F.when(added | ~missing, F.col("value")).alias("value"))
            .groupBy("field", "status")
            .agg(F.schema_of_variant_agg("value").alias("found"), F.count(F.lit(1)).alias("records")))
