"""Linear trend fit and next-period prediction (ordinary least squares).

The fit is a single aggregation of exact sums (n, Σx, Σy, Σxy, Σx²) per
group - partial aggregation, so any number of groups and rows scales - and
the closed-form slope/intercept is evaluated from those sums.  A DECIMAL ``y``
stays DECIMAL through the sums so the result does not depend on summation
order; a DOUBLE one keeps all its digits.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..functions.scalar import fmt_date, round_half_even

# Fixed value: the model version stamped on published predictions.
MODEL_VERSION = "v1.1-dynamic"


class EmptyTrainingSet(ValueError):
    pass


def _exact(dtype) -> bool:
    """Types whose OLS sums are exact in DECIMAL(38): integers and up to 18 digits."""
    return isinstance(dtype, IntegralType) or (isinstance(dtype, DecimalType) and dtype.precision <= 18)


def fit_line(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per group: n, slope, intercept, max_x over the rows that have both values.

    Integer and short DECIMAL ``y`` use exact sums; DOUBLE and longer DECIMAL
    ``y`` the numerically stable regression aggregates.  Fewer than two
    distinct x values give a NULL slope."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xl = F.col(x).cast("long")
    if not _exact(df.schema[y].dataType):
        yd, xd = F.col(y).cast("double"), xl.cast("double")
        one = F.min(xl) == F.max(xl)
        aggs = [F.count(F.lit(1)).alias("n"),
                F.when(~one, F.regr_slope(yd, xd)).alias("slope"),
                F.when(~one, F.regr_intercept(yd, xd)).alias("intercept"), F.max(xl).alias("max_x")]
        s = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
        return s.select(*groups, "n", "slope", "intercept", "max_x")
    yd = F.col(y).cast("decimal(24,6)") if isinstance(df.schema[y].dataType, IntegralType) else F.col(y)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(xl).alias("sx"), F.sum(yd).alias("sy"),
            F.sum(xl * yd).alias("sxy"), F.sum(xl * xl).alias("sxx"), F.max(xl).alias("max_x")]
    s = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
    num = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    den = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    slope = F.when(den != 0, num / den)
    s = s.withColumn("slope", slope)
    intercept = (F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double")) \
        / F.col("n").cast("double")
    return s.withColumn("intercept", intercept).select(*groups, "n", "slope", "intercept", "max_x")


def forecast_next(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Fit per group and predict ``y`` at ``max(x) + 1`` (rounded to 2 digits).

    A training set without two different x values raises
    :class:`EmptyTrainingSet`; with groups, an empty one does, and a group
    that cannot be fitted has a NULL prediction, which is never published.
    """
    fit = fit_line(df, x, y, groups)
    if groups:
        if df.limit(1).isEmpty():
            raise EmptyTrainingSet("no rows to train on")
    else:
        row = fit.first()  # one row: the fit itself
        if row["slope"] is None:
            raise EmptyTrainingSet(f"{row['n']} rows to train on, no two periods among them")
        fit = df.sparkSession.createDataFrame([row], fit.schema)
    nxt = (F.col("max_x") + 1).cast("long")
    pred = round_half_even(F.col("slope") * nxt.cast("double") + F.col("intercept"))
    return fit.select(*groups, "slope", "intercept", nxt.alias("next_x"), pred.alias("prediction"))


def prediction_table(forecast: DataFrame, run_date: _dt.date | None = None,
                     version: str = MODEL_VERSION) -> DataFrame:
    """The published prediction rows: date, period, value, model version."""
    d = F.lit(run_date.isoformat()) if run_date else fmt_date(F.current_date())
    return forecast.where(F.col("prediction").isNotNull()).select(d.alias("fecha_prediccion"), F.col("next_x").alias("mes_simulado"),
                           F.col("prediction").alias("prediccion_ventas"),
                           F.lit(version).alias("modelo_version"))


@dataclass
class ForecastRun:
    predictions: DataFrame
    rollup: object


def run_forecast(spark: SparkSession, seed: DataFrame, history_table: str, history_path: str, out: str,
                 x: str = "historico_mes", y: str = "ventas_reales", run_date: _dt.date | None = None,
                 rollup_path: str | None = None) -> ForecastRun:
    """The flow: seed the history if it is empty, verify it, fit and predict,
    replace the prediction table, refresh its rollup.  Each step runs only after
    the one before it succeeded."""
    from ..plans.materialize import seed_if_empty, verify_source, write
    from ..plans.rollup import FORECAST_ROLLUP, build_rollup
    from ..plans.semantic import SALES_FORECAST
    seed_if_empty(seed, history_table, history_path)
    history = spark.table(history_table)
    if not verify_source(history):
        raise EmptyTrainingSet(f"{history_table} is empty")
    write(prediction_table(forecast_next(history, x, y), run_date), out, "overwrite")
    predictions = spark.read.parquet(out)
    return ForecastRun(predictions, build_rollup(predictions, SALES_FORECAST, FORECAST_ROLLUP, rollup_path))
