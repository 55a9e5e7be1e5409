"""Semantic layer: cubes of named measures and dimensions compiled to
``groupBy().agg()`` plans.

A query names measures, dimensions, an optional time dimension at a
granularity, filters (dimension filters become WHERE, measure filters become
HAVING), order and limit.  Row-level security is a ``left_semi`` join against
the principal's policy rows.  Rollups (pre-aggregated tables) are matched at
compile time in :mod:`stratum.plans.rollup`.

Every measure is additive or derived from additive parts (count, sums), so
partial aggregation combines map-side and a hot dimension value never
funnels its rows to one task.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import truncate_to
from ..session import scratch_path


@dataclass(frozen=True)
class Measure:
    type: str                       # count | sum | avg | number | count_if
    sql: str | None = None          # input expression (column name or SQL)
    format: str | None = None       # e.g. "currency" (display only)
    numerator: str | None = None    # for type "number": ratio of two sums
    denominator: str | None = None
    drill_members: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dimension:
    sql: str
    type: str = "string"            # string | number | time
    primary_key: bool = False


@dataclass
class Cube:
    name: str
    source: str | Callable[[SparkSession], DataFrame]
    measures: dict[str, Measure]
    dimensions: dict[str, Dimension]
    data_source: str = "default"
    # time dimension -> yyyymm partition column of the stored table: a date
    # range on the dimension also becomes a predicate on the partition column
    # (the optimizer cannot derive one from the other), so folders prune.
    partition_hints: dict[str, str] = field(default_factory=dict)

    def primary_key(self) -> str | None:
        for n, d in self.dimensions.items():
            if d.primary_key:
                return n
        return None


# ---------------------------------------------------------------- cube defs
# Cube, measure and dimension names and the columns they read,
# as the warehouse's users query them (marginRatio is our documented ratio).
ORDERS = Cube(
    name="Orders",
    source="fct_sales",
    measures={
        "count": Measure("count"),
        "totalAmount": Measure("sum", "amount_usd", format="currency"),
        "avgOrderValue": Measure("avg", "amount_usd", format="currency"),
        "grossMargin": Measure("sum", "gross_margin_usd", format="currency"),
        # (sale - cost) / sale as a ratio of sums, never an average of ratios
        "marginRatio": Measure("number", numerator="gross_margin_usd",
                               denominator="amount_usd"),
    },
    dimensions={
        "id": Dimension("order_id", "number", primary_key=True),
        "status": Dimension("order_status"),
        "category": Dimension("category"),
        "country": Dimension("country"),
        "productId": Dimension("product_id", "number"),
        "orderDate": Dimension("order_date", "time"),
    },
    partition_hints={"orderDate": "order_ym"},
)

PRODUCTS = Cube(
    name="Products",
    source="stg_products",
    measures={"count": Measure("count"),
              "avgPrice": Measure("avg", "price_usd", format="currency")},
    dimensions={"id": Dimension("product_id", "number", primary_key=True),
                "name": Dimension("product_name"),
                "category": Dimension("category")},
)

USERS = Cube(
    name="Users",
    source="stg_users",
    measures={"count": Measure("count")},
    dimensions={"id": Dimension("user_id", "number", primary_key=True),
                "name": Dimension("user_name"),
                "country": Dimension("country"),
                "createdAt": Dimension("signup_date", "time")},
)

SALES_HISTORY = Cube(
    name="VentasHistoricas",
    source="ventas_historicas",
    measures={"count": Measure("count"),
              "totalVentas": Measure("sum", "ventas_reales"),
              "promedioVentas": Measure("avg", "ventas_reales")},
    dimensions={"historicoMes": Dimension("historico_mes", "number", primary_key=True)},
)

SALES_FORECAST = Cube(
    name="MlPrediccionVentas",
    source="ml_prediccion_ventas",
    data_source="pg_legacy",
    measures={"count": Measure("count", drill_members=("modeloVersion", "fechaPrediccion")),
              "totalPrediccion": Measure("sum", "prediccion_ventas"),
              "promedioPrediccion": Measure("avg", "prediccion_ventas")},
    dimensions={"fechaPrediccion": Dimension("fecha_prediccion", "time"),
                "mesSimulado": Dimension("mes_simulado", "number"),
                "modeloVersion": Dimension("modelo_version"),
                "id": Dimension("mes_simulado", "number", primary_key=True)},
)

CUBES = {c.name: c for c in (ORDERS, PRODUCTS, USERS, SALES_HISTORY, SALES_FORECAST)}


def load_cube(spark: SparkSession, cube: Cube) -> DataFrame:
    """The cube's source rows, from its named data source."""
    if callable(cube.source):
        return cube.source(spark)
    from ..sources.tables import table
    return table(spark, cube.source, cube.data_source)


# ------------------------------------------------------------- compilation
def time_column(dim: str, granularity: str) -> str:
    return f"{dim}_{granularity}"


def _dim_expr(cube: Cube, name: str) -> Column:
    return F.expr(cube.dimensions[name].sql)


_OPS = {
    "equals": lambda c, v: c.isin(list(v)),
    "notEquals": lambda c, v: ~c.isin(list(v)) | c.isNull(),
    "in": lambda c, v: c.isin(list(v)),
    "notIn": lambda c, v: ~c.isin(list(v)) | c.isNull(),
    "gt": lambda c, v: c > v[0],
    "gte": lambda c, v: c >= v[0],
    "lt": lambda c, v: c < v[0],
    "lte": lambda c, v: c <= v[0],
    "set": lambda c, v: c.isNotNull(),
    "notSet": lambda c, v: c.isNull(),
    "contains": lambda c, v: F.lower(c).contains(str(v[0]).lower()),
    # whole days: the last one counts to its end on a TIMESTAMP dimension too
    "inDateRange": lambda c, v: (c >= F.lit(v[0]).cast("date"))
    & (c < F.date_add(F.lit(v[1]).cast("date"), 1)),
    "beforeDate": lambda c, v: c < F.lit(v[0]).cast("date"),
    "afterDate": lambda c, v: c >= F.date_add(F.lit(v[0]).cast("date"), 1),
}


def _ym(v) -> int:
    d = datetime.date.fromisoformat(str(v)[:10])
    return d.year * 100 + d.month


def partition_condition(column: str, op: str, values):
    """Month-partition predicate implied by a date filter, or None."""
    vals = values if isinstance(values, (list, tuple)) else [values]
    c = F.col(column)
    if op == "inDateRange":
        return c.between(_ym(vals[0]), _ym(vals[1]))
    if op == "beforeDate":
        return c <= _ym(vals[0])
    if op == "afterDate":
        return c >= _ym(vals[0])
    return None


def filter_condition(col: Column, op: str, values) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown filter operator {op!r}")
    vals = values if isinstance(values, (list, tuple)) else [values]
    return _OPS[op](col, vals)


def _agg_parts(cube: Cube, name: str) -> list[tuple[str, Column]]:
    """Additive components that a measure is finalised from."""
    m = cube.measures[name]
    if m.type == "count":
        return [(f"{name}__n", F.count(F.lit(1)))]
    if m.type == "count_if":
        return [(f"{name}__n", F.count_if(F.expr(m.sql)))]
    if m.type == "sum":
        return [(f"{name}__s", F.sum(F.expr(m.sql)))]
    if m.type == "avg":
        return [(f"{name}__s", F.sum(F.expr(m.sql))), (f"{name}__c", F.count(F.expr(m.sql)))]
    if m.type == "number":
        return [(f"{name}__num", F.sum(F.expr(m.numerator))),
                (f"{name}__den", F.sum(F.expr(m.denominator)))]
    raise ValueError(f"unsupported measure type {m.type!r}")


def _finalise(cube: Cube, name: str) -> Column:
    m = cube.measures[name]
    if m.type in ("count", "count_if"):
        return F.col(f"{name}__n").cast("long").alias(name)
    if m.type == "sum":
        return F.col(f"{name}__s").alias(name)
    if m.type == "avg":
        return (F.col(f"{name}__s").cast("double") / F.col(f"{name}__c")).alias(name)
    if m.type == "number":
        return F.try_divide(F.col(f"{name}__num").cast("double"),
                            F.col(f"{name}__den").cast("double")).alias(name)
    raise ValueError(m.type)


def apply_rls(df: DataFrame, policy: DataFrame, principal: str, column: str,
              policy_column: str | None = None, principal_column: str = "principal") -> DataFrame:
    """Keep only rows whose ``column`` value the principal may see.

    The policy is (principal, value) rows; the filter is a ``left_semi``
    join against the principal's slice, so it never duplicates fact rows.
    """
    value = policy_column or column
    missing = {value, principal_column} - set(policy.columns)
    if missing:
        raise KeyError(f"policy has no column {sorted(missing)}")
    allowed = (policy.where(F.col(principal_column) == principal)
                     .select(F.col(value).alias(column)))
    return df.join(allowed, column, "left_semi")


def secured(df: DataFrame, cube: Cube, rls: tuple | None) -> DataFrame:
    """``df`` as ``rls`` allows it: the one place that applies a policy.

    ``rls`` is ``(policy, principal, dimension)``, where the policy names its
    value column by the dimension or by the dimension's column, or
    ``(policy, principal, dimension, policy column)``.
    """
    if rls is None:
        return df
    policy, principal, dim, *named = rls
    column = cube.dimensions[dim].sql
    if named:
        value = named[0]
    else:
        found = [c for c in dict.fromkeys((column, dim)) if c in policy.columns]
        if len(found) != 1:
            raise KeyError(f"name the policy column of {dim!r}: the policy has {policy.columns}")
        value = found[0]
    return apply_rls(df, policy, principal, column, policy_column=value)


def _sum_type_fix(cube: Cube, df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Widen decimal sums to a fixed (38, s) so direct and rollup answers agree."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in df.columns:
        t = types[c]
        if c in measures and cube.measures[c].type == "sum" and t.typeName() == "decimal":
            out.append(F.col(c).cast(f"decimal(38,{t.scale})").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def query(df: DataFrame, cube: Cube, measures: Sequence[str] = (),
          dimensions: Sequence[str] = (), time_dimension: tuple[str, str] | None = None,
          filters: Sequence[tuple[str, str, object]] = (),
          order: Sequence[tuple[str, str]] = (), limit: int | None = None,
          rls: tuple | None = None,
          rollups: Sequence = ()) -> DataFrame:
    """Compile one semantic query over ``df`` (the cube's source rows).

    ``rls`` is a policy as of :func:`secured`.
    ``rollups`` are :class:`stratum.plans.rollup.RollupTable` candidates; the
    first one that can answer is used instead of ``df``.
    """
    measures, dimensions = list(measures), list(dimensions)
    for m in measures:
        if m not in cube.measures:
            raise KeyError(f"{cube.name} has no measure {m!r}")
    for d in dimensions:
        if d not in cube.dimensions:
            raise KeyError(f"{cube.name} has no dimension {d!r}")

    dim_filters = [f for f in filters if f[0] in cube.dimensions]
    msr_filters = [f for f in filters if f[0] in cube.measures]
    unknown = [f for f in filters if f[0] not in cube.dimensions and f[0] not in cube.measures]
    if unknown:
        raise KeyError(f"unknown filter members {unknown}")

    from .rollup import match_rollup  # local import: rollup imports this module
    hit = None if rls else match_rollup(rollups, cube, measures + [f[0] for f in msr_filters],
                                        dimensions, time_dimension, dim_filters)
    if hit is not None:
        out = hit.answer(cube, measures, dimensions, time_dimension, dim_filters,
                         [f[0] for f in msr_filters])
    else:
        base = secured(df, cube, rls)
        for member, op, values in dim_filters:
            base = base.where(filter_condition(_dim_expr(cube, member), op, values))
            part_col = cube.partition_hints.get(member)
            if part_col and part_col in base.columns:
                cond = partition_condition(part_col, op, values)
                if cond is not None:
                    base = base.where(cond)
        groups = [_dim_expr(cube, d).alias(d) for d in dimensions]
        if time_dimension:
            td, g = time_dimension
            groups.append(truncate_to(_dim_expr(cube, td), g).alias(time_column(td, g)))
        needed = list(dict.fromkeys(measures + [f[0] for f in msr_filters]))
        parts = [p.alias(n) for m in needed for n, p in _agg_parts(cube, m)]
        agg = base.groupBy(*groups).agg(*parts) if groups else base.agg(*parts)
        keys = dimensions + ([time_column(*time_dimension)] if time_dimension else [])
        out = agg.select(*keys, *[_finalise(cube, m) for m in needed])
    for member, op, values in msr_filters:
        out = out.where(filter_condition(F.col(member), op, values))
    keep = list(dimensions) + ([time_column(*time_dimension)] if time_dimension else []) + measures
    out = _sum_type_fix(cube, out.select(*keep), measures)
    if order:
        out = out.orderBy(*[F.col(c).desc_nulls_last() if d.lower() == "desc"
                            else F.col(c).asc_nulls_first() for c, d in order])
    if limit is not None:
        out = out.limit(limit)
    return out


def drill(df: DataFrame, cube: Cube, measure: str, filters=(), limit: int | None = None,
          rls: tuple | None = None) -> DataFrame:
    """Rows behind a measure value: the measure's drill members, filtered, as ``rls`` allows."""
    m = cube.measures[measure]
    members = list(m.drill_members) or [cube.primary_key()]
    base = secured(df, cube, rls)
    for member, op, values in filters:
        base = base.where(filter_condition(_dim_expr(cube, member), op, values))
    pk = cube.primary_key()
    out = base.select(*[_dim_expr(cube, d).alias(d) for d in members],
                      *([] if pk in members else [_dim_expr(cube, pk).alias(pk)]))
    out = out.orderBy(pk) if limit is not None else out
    return out.limit(limit) if limit is not None else out


def format_measures(df: DataFrame, cube: Cube) -> DataFrame:
    """Display projection: currency measures as '$1,234.50' strings."""
    cols = []
    for c in df.columns:
        m = cube.measures.get(c)
        if m is not None and m.format == "currency":
            cols.append(F.concat(F.lit("$"), F.format_number(F.col(c).cast("double"), 2)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def register_cube(df: DataFrame, cube: Cube, rls: tuple | None = None,
                  name: str | None = None) -> DataFrame:
    """Expose a cube as a SQL view: dimensions and measure inputs by name, with
    the rows that ``rls`` allows (``name`` keeps principals' views apart)."""
    cols = [_dim_expr(cube, d).alias(d) for d in cube.dimensions]
    seen = set(cube.dimensions)
    for n, m in cube.measures.items():
        if m.sql and n not in seen:
            cols.append(F.expr(m.sql).alias(n))
            seen.add(n)
    view = secured(df, cube, rls).select(*cols)
    view.createOrReplaceTempView(name or cube.name)
    return view


def sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """Parameterised SQL: values are bound as literals, never spliced."""
    return spark.sql(text, args=args or {})


def capped(df: DataFrame, max_rows: int = 5000) -> tuple[DataFrame, bool]:
    """Result row cap (the BI default is 5,000 rows), and whether it cut rows.

    The query runs once: at most ``max_rows + 1`` rows are kept in the shared
    folder, and the row beyond the cap only sets the flag.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "capped")
    # a limit leaves one partition, so the ids number its rows in order
    df.limit(max_rows + 1).withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.where(F.col("__row") < max_rows).drop("__row"), rows.count() > max_rows
