"""Pipelines: bronze -> silver -> quality gate -> gold (written once).

``run_medallion`` follows the documented order Raw -> Transform -> Audit ->
Publish: silver models are checked by the gate, and only then is the gold
fact table written (partitioned by month, clustered by the dashboard's filter
columns).  ``run_incremental`` drains the available change records into the
bronze log with an ``availableNow`` stream and applies them: only the keys
that changed are resolved again, and only the months they leave or enter are
written.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import yyyymm
from ..operators import quality as Q
from ..session import child_names, scratch_path
from . import marts, staging
from .materialize import materialize_table, materialize_view
from .versioned import VersionedTable

# normalised statuses outside the known list are marked 'unknown' and kept out
# of gold by the model itself: worth a report, not a stop
GATE_LEVELS = {("stg_orders", "accepted_values", "order_status"): "warn"}
FIRST_DAY = _dt.date(1970, 1, 1)
MONTH = "order_ym"


@dataclass
class MedallionResult:
    gold: DataFrame
    report: DataFrame
    gold_path: str
    months: list[int] | None = None    # the months written; None: all
    # the change of gold, for what follows it by deltas: rows that went, rows
    # that came; None for a full run
    retracted: DataFrame | None = None
    added: DataFrame | None = None


def silver_models(orders_bronze: DataFrame, products_bronze: DataFrame,
                  users_bronze: DataFrame, order_tiebreak=(), order_keys=("id",),
                  persist_orders_at: str | None = None, tz: str | None = None,
                  order_checks: Q.ObservedChecks | None = None):
    """Silver models; calendar columns in the business zone ``tz``.  With
    ``persist_orders_at`` the orders model (the one
    with the bronze-wide shuffle) is written once to the shared folder, so
    the quality checks and the gold build read it instead of re-resolving
    every key's latest version; it also cuts lineage for executor loss.  That
    write counts ``order_checks`` as it goes."""
    o = staging.stg_orders(orders_bronze, keys=order_keys, tiebreak=order_tiebreak, tz=tz)
    if persist_orders_at:
        if order_checks:
            o = order_checks.attach(o)
        o = materialize_table(o, persist_orders_at)
    p = staging.stg_products(products_bronze)
    u = staging.stg_users(users_bronze, tz=tz)
    materialize_view(o, "stg_orders")
    materialize_view(p, "stg_products")
    materialize_view(u, "stg_users")
    return o, p, u


def order_row_checks(last_day: _dt.date | None = None) -> list:
    return [Q.null_spec("order_id"), Q.null_spec("amount_usd"),
            Q.accepted_spec("order_status", staging.ORDER_STATUSES),
            Q.range_spec("order_date", FIRST_DAY, last_day)]


def silver_checks(o: DataFrame, p: DataFrame, u: DataFrame, last_day: _dt.date | None = None,
                  observed: Q.ObservedChecks | None = None) -> DataFrame:
    """The declared tests (keys not null and unique, required columns not null),
    accepted statuses, the logical date range and referential consistency.  Row
    checks of orders that their write has ``observed`` are not computed again."""
    return Q.report(
        observed.report(o.sparkSession) if observed
        else Q.table_checks(o, "stg_orders", *order_row_checks(last_day)),
        Q.unique(o, ["order_id"], "stg_orders"),
        Q.references(o, p, "product_id", table="stg_orders"),
        Q.references(o, u, "user_id", table="stg_orders"),
        Q.table_checks(p, "stg_products", Q.null_spec("product_id"), Q.null_spec("price_usd")),
        Q.unique(p, ["product_id"], "stg_products"),
        Q.table_checks(u, "stg_users", Q.null_spec("user_id"), Q.null_spec("email")),
        Q.unique(u, ["user_id"], "stg_users"),
    )


def checked(spark: SparkSession, o: DataFrame, p: DataFrame, u: DataFrame, gate: bool,
            levels: dict | None, last_day: _dt.date | None, observed: Q.ObservedChecks | None = None) -> DataFrame:
    """The report, computed once and kept; raises where the gate stops it."""
    report = materialize_table(silver_checks(o, p, u, last_day, observed), scratch_path(spark, "quality-report"))
    return Q.gate(report, severities=GATE_LEVELS | (levels or {})) if gate else report


def run_medallion(spark: SparkSession, orders_bronze: DataFrame, products_bronze: DataFrame,
                  users_bronze: DataFrame, gold_path: str | None = None,
                  order_tiebreak=(), gate: bool = True, tz: str | None = None,
                  gate_levels: dict | None = None, last_day: _dt.date | None = None) -> MedallionResult:
    seen = Q.ObservedChecks("stg_orders", *order_row_checks(last_day))
    o, p, u = silver_models(orders_bronze, products_bronze, users_bronze, order_tiebreak,
                            persist_orders_at=scratch_path(spark, "silver-stg_orders"), tz=tz, order_checks=seen)
    report = checked(spark, o, p, u, gate, gate_levels, last_day, seen)
    fct = marts.build_fct_sales(o, p, u).withColumn(MONTH, yyyymm("order_date"))
    path = gold_path or scratch_path(spark, "gold-fct_sales")
    gold = VersionedTable(spark, path, MONTH).replace(fct, list(marts.FCT_SALES_ORDER))
    materialize_view(gold, "fct_sales")
    return MedallionResult(gold, report, path)


def _applied(spark: SparkSession, gold_path: str) -> int:
    """The last bronze batch that gold holds, -1 for none."""
    names = child_names(spark, f"{gold_path.rstrip('/')}/applied")
    return max([int(n[2:]) for n in names if n.startswith("b=")], default=-1)


# what gold takes from the dimensions, by the id that orders name
DIMENSION_COLUMNS = {
    "product_id": ("product_name", "category", "price_usd"),
    "user_id": ("user_name", "email", "country", "signup_date"),
}


def row_digests(dim: DataFrame, key: str) -> DataFrame:
    """key, digest of what gold takes from a dimension's rows."""
    values = F.to_json(F.struct(*DIMENSION_COLUMNS[key]), {"ignoreNullFields": "false"})
    return dim.select(key, F.unhex(F.md5(values)).alias("digest"))


def changed_ids(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Ids whose row is new, gone or different between two snapshots of digests."""
    return (before.withColumnRenamed("digest", "was").join(now, key, "full_outer")
            .where(~F.col("was").eqNullSafe(F.col("digest"))).select(key))


class Snapshots:
    """The dimensions' row digests as gold has them, a folder per run."""

    def __init__(self, spark: SparkSession, gold_path: str):
        self.spark, self.home = spark, f"{gold_path.rstrip('/')}/dimensions"

    def _runs(self) -> list[int]:
        return sorted(int(c[2:]) for c in child_names(self.spark, self.home)
                      if c.startswith("r=") and "_SUCCESS" in child_names(self.spark, f"{self.home}/{c}/done"))

    def changed(self, now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Per dimension the ids that differ from the last run's snapshot."""
        runs = self._runs()
        if not runs:
            return {}
        last = f"{self.home}/r={runs[-1]}"
        return {key: changed_ids(self.spark.read.parquet(f"{last}/{key}"), digests, key) for key, digests in now.items()}

    def keep(self, now: dict[str, DataFrame]) -> None:
        """Written after gold: a run that stops before does its changes again."""
        runs = self._runs()
        out = f"{self.home}/r={runs[-1] + 1 if runs else 0}"
        for key, digests in now.items():
            digests.write.mode("overwrite").parquet(f"{out}/{key}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{out}/done")


def dimension_digests(spark: SparkSession, products_bronze: DataFrame, users_bronze: DataFrame,
                      tz: str | None) -> dict[str, DataFrame]:
    """Digests of the present dimensions, written once per run."""
    dims = {"product_id": staging.stg_products(products_bronze), "user_id": staging.stg_users(users_bronze, tz=tz)}
    return {key: materialize_table(row_digests(dim, key), scratch_path(spark, f"digests-{key}")) for key, dim in dims.items()}


def run_incremental(spark: SparkSession, changes_stream: DataFrame, bronze_path: str,
                    unwrap_fn, products_bronze: DataFrame, users_bronze: DataFrame,
                    checkpoint: str | None = None, gold_path: str | None = None,
                    order_tiebreak=("_offset",), gate: bool = True, tz: str | None = None,
                    gate_levels: dict | None = None, changed_products: DataFrame | None = None,
                    changed_users: DataFrame | None = None) -> MedallionResult:
    """Drain the available changes into bronze (a folder per micro-batch,
    overwritten on replay) and apply them to gold.

    The first run builds gold from the whole log.  Later ones take the keys of
    the batches that gold has not seen, resolve those from the log, and rewrite
    the months in which they were or now are.  Changed products and users are
    found by comparing their rows' digests with those of the last run, and the
    orders in gold that name them are resolved again; ``changed_products`` and
    ``changed_users`` (a column ``id``) add others.  Pass the same
    ``checkpoint``, ``bronze_path`` and ``gold_path`` to every run.
    """
    from ..streaming.latest_stream import await_done, write_versions
    path = gold_path or scratch_path(spark, "gold-fct_sales")
    await_done(write_versions(unwrap_fn(changes_stream), bronze_path, checkpoint, output_mode="append"))
    bronze = spark.read.parquet(bronze_path)
    last = bronze.agg(F.max("_batch_id")).first()[0]
    table, seen = VersionedTable(spark, path, MONTH), _applied(spark, path)
    snapshots, now = Snapshots(spark, path), dimension_digests(spark, products_bronze, users_bronze, tz)
    if table.version() is None or seen < 0:
        result = run_medallion(spark, bronze.drop("_batch_id"), products_bronze, users_bronze, path,
                               order_tiebreak, gate, tz, gate_levels)
    else:
        result = _apply(spark, table, bronze, seen, products_bronze, users_bronze, order_tiebreak,
                        gate, tz, gate_levels, changed_products, changed_users, snapshots.changed(now))
    snapshots.keep(now)
    if last is not None:
        spark.range(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/applied/b={last}")
    return result


def _apply(spark, table: VersionedTable, bronze: DataFrame, seen: int, products_bronze, users_bronze,
           order_tiebreak, gate, tz, gate_levels, changed_products, changed_users,
           found: dict[str, DataFrame]) -> MedallionResult:
    keys = bronze.where(F.col("_batch_id") > seen).select("id")
    for column, changed in (("product_id", changed_products), ("user_id", changed_users)):
        ids = [changed.select(F.col("id").alias(column))] if changed is not None else []
        ids += [found[column]] if column in found else []
        if ids:
            # gold names the product and user of its orders; orders that are not in gold do not need them
            of = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            keys = keys.unionByName(table.read().join(of.distinct(), column, "left_semi")
                                    .select(F.col("order_id").alias("id")))
    keys = materialize_table(keys.distinct(), scratch_path(spark, "changed-keys"))
    log = bronze.drop("_batch_id").join(keys, "id", "left_semi")
    seen = Q.ObservedChecks("stg_orders", *order_row_checks())
    o, p, u = silver_models(log, products_bronze, users_bronze, order_tiebreak,
                            persist_orders_at=scratch_path(spark, "silver-changed"), tz=tz, order_checks=seen)
    report = checked(spark, o, p, u, gate, gate_levels, None, seen)
    old = table.read()
    order_keys = keys.withColumnRenamed("id", "order_id")
    new = materialize_table(marts.build_fct_sales(o, p, u).withColumn(MONTH, yyyymm("order_date")),
                            scratch_path(spark, "gold-changed"))
    # one row per month: those that a changed order leaves or enters
    gone = materialize_table(old.join(order_keys, "order_id", "left_semi"), scratch_path(spark, "gold-gone"))
    months = [r[0] for r in gone.select(MONTH).unionByName(new.select(MONTH)).distinct().collect()]
    if not months:
        return MedallionResult(old, report, table.path, [], gone, new)
    stay = old.where(F.col(MONTH).isin(months)).join(order_keys, "order_id", "left_anti")
    gold = table.replace_partitions(stay.unionByName(new), months, list(marts.FCT_SALES_ORDER))
    materialize_view(gold, "fct_sales")
    return MedallionResult(gold, report, table.path, sorted(months), gone, new)
