"""Adapters: the shared test tables -> the engine's input shapes.

The warehouse this engine mirrors works on CDC'd sales tables (orders,
products, users), metric samples, an audit log and question/SQL examples.
The cluster gives us TPC-H-like tables instead; these functions derive the
engine's inputs from them with plain DataFrame operations, so every query's
work grows with the given tables.  ``stratum.oracle`` states the same rules
in SQL for the independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Total order among versions of one order line that share a version stamp
# (stands in for arrival order, which the test tables do not carry).
ORDER_TIEBREAK = ("product_id", "supp_key", "amount", "quantity", "discount", "tax",
                  "_is_deleted")

# Raw status spellings per source order status (exercise the
# lower/trim normalisation and the 'unknown' branch).
STATUS_SPELLING = {"F": " Completed", "O": "PENDING ", "P": "weird"}

# Event type -> tool name requested in the audit fixture.
TOOL_OF_EVENT = {"view": "list_dashboards", "click": "get_dashboard_info",
                 "purchase": "list_datasets", "signup": "create_chart",
                 "error": "delete_dataset"}

EPOCH_NTZ = "1995-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _status(c) -> F.Column:
    expr = None
    for k, v in STATUS_SPELLING.items():
        expr = (F.when(c == k, v) if expr is None else expr.when(c == k, v))
    return expr.otherwise(F.lit(None))


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line version log: one row per change, several per key."""
    li = read(spark, sf_dir, "lineitem")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                             "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supp_key"),
        _status(F.col("o_orderstatus")).alias("status"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("updated_at"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                  (F.col("l_suppkey") % 90).cast("int")))
        .alias("_synced_at"),
        (F.col("l_returnflag") == "R").cast("int").alias("_is_deleted"),
    )


def bronze_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    ts = F.lit(EPOCH_NTZ).cast("timestamp_ntz")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit(" "), F.col("p_type")).alias("category"),
        F.col("p_retailprice").alias("price"),
        ts.alias("updated_at"),
        ts.alias("_synced_at"),
        F.lit(0).alias("_is_deleted"),
    )


def bronze_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation")
    first = (read(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("created_at")))
    j = (c.join(n, c.c_nationkey == n.n_nationkey)
          .join(first, c.c_custkey == first.o_custkey, "left"))
    ts = F.coalesce(F.col("created_at"), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
    return j.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Example.com ")).alias("email"),
        F.col("n_name").alias("country"),
        F.col("created_at"),
        ts.alias("updated_at"),
        ts.alias("_synced_at"),
        F.lit(0).alias("_is_deleted"),
    )


def bronze_products_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products minus every tenth id: creates orders whose product is unknown."""
    return bronze_products(spark, sf_dir).where(F.col("id") % 10 != 0)


def bronze_support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket version log: a user's error events are updates of that user's
    ticket (id = user); the latest error decides status and priority."""
    e = read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(
        F.col("user_id").alias("id"),
        F.col("user_id"),
        F.col("props").alias("subject"),
        F.when(F.col("value") >= 100, "high").otherwise("normal").alias("priority"),
        F.when(F.col("value") >= 50, "open").otherwise("closed").alias("status"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("_offset"),
        F.col("ts").alias("_synced_at"),
        F.lit(0).alias("_is_deleted"),
    )


def monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x = month number since 1995-01, y = order revenue that month)."""
    o = read(spark, sf_dir, "orders")
    x = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    return (o.groupBy(x.alias("historico_mes"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("ventas_reales")))


def monthly_history_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    x = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .groupBy(F.col("c_mktsegment").alias("segment"), x.alias("historico_mes"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("ventas_reales")))


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: one series per (event type, user); the counter is the
    running sum of event values, restarting every day (an exporter restart),
    kept as DECIMAL so increases are exact.  The running sum is bucketed by
    hour (skew-safe for a busy series)."""
    from .operators.series import (assign_buckets, drop_bucket, epoch_micros,
                                   running_sum_across_buckets)
    e = read(spark, sf_dir, "events")
    e = e.withColumns({"__day": F.to_date("ts"), "__t": epoch_micros(e, "ts"),
                       "__v": F.col("value").cast("decimal(18,2)")})
    e = assign_buckets(e, ["event_type", "user_id", "__day"], "__t", 3600 * 1_000_000)
    e = drop_bucket(running_sum_across_buckets(e, ["event_type", "user_id", "__day"],
                                               ["__t", "event_id"], "__v", "counter"))
    return e.select(
        F.col("ts"),
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.col("user_id").alias("series_id"),
        F.col("event_id"),
        F.col("counter").alias("value"),
    )


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples straight from events: (ts, metric, labels, value)."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("ts"),
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.col("user_id").alias("series_id"),
        F.col("event_id"),
        F.col("value"),
    )


def audit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool requests: who asked for which tool, with which arguments."""
    e = read(spark, sf_dir, "events")
    tool = None
    for k, v in TOOL_OF_EVENT.items():
        tool = F.when(F.col("event_type") == k, v) if tool is None else tool.when(
            F.col("event_type") == k, v)
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"),
        F.when(F.col("user_id") % 3 == 0, "admin").otherwise("analyst").alias("role"),
        tool.otherwise(F.col("event_type")).alias("tool_name"),
        F.col("props").alias("arguments"),
    )


def golden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn n paired with the assistant turn n+1 of the same conversation."""
    c = read(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected_sql"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", "query", "expected_sql")


def example_vectors(spark: SparkSession, sf_dir: str):
    """Split embeddings into (queries, stored examples): every fiftieth id asks."""
    e = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    asks = F.col("vec_id") % 50 == 0
    return e.where(asks), e.where(~asks)


def rls_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level policy: principal (a region name) -> countries it may see."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("principal"), F.col("n_name").alias("country"))


# ------------------------------------------------------------- change feed
def order_row_schema():
    from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                                   StructType)
    return StructType([
        StructField("id", LongType()), StructField("user_id", LongType()),
        StructField("product_id", LongType()), StructField("supp_key", LongType()),
        StructField("status", StringType()),
        StructField("amount", StringType()),        # base64 unscaled decimal(10,2)
        StructField("quantity", DoubleType()), StructField("discount", DoubleType()),
        StructField("tax", DoubleType()),
        StructField("order_date", IntegerType()),   # days since epoch
        StructField("updated_at", LongType()),      # micros since epoch
    ])


ORDERS_TOPIC = "shop.public.orders"
PRODUCTS_TOPIC = "shop.public.products"


#: a block of 1,000 ids with more rows than this is numbered in time slices
HOT_BLOCK_ROWS = 1 << 20


def numbered_orders(spark: SparkSession, sf_dir: str, hot_rows: int = HOT_BLOCK_ROWS) -> DataFrame:
    """The order-line log with ``seq``: the arrival number of a version within its key.

    Numbers come from one window per key, dealt once.  Keys of a block of ids with
    more than ``hot_rows`` lines may have too many versions for one task: they are
    numbered by a running count in 30-day version windows (hot ones cut finer).
    There is at most one such block per ``hot_rows`` lines, so their list is broadcast;
    where there is none, which a count of lines per block tells first, no key is sliced.
    """
    from pyspark.sql import Window
    from .operators.series import (assign_buckets, drop_bucket, epoch_micros,
                                   running_sum_across_buckets)
    b = bronze_orders(spark, sf_dir)
    b = b.withColumns({"__t": epoch_micros(b, "updated_at"), "__one": F.lit(1)})
    order = ["__t", *ORDER_TIEBREAK]
    dealt = F.row_number().over(Window.partitionBy("id").orderBy(*order)).cast("long")
    li = read(spark, sf_dir, "lineitem")
    line_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    # a null id is a key like any other
    blocks = (li.groupBy(F.floor(line_id / 1000).alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
                .where(F.col("__n") > hot_rows).select("__block"))
    if blocks.isEmpty():
        return b.withColumn("seq", dealt).drop("__t", "__one")
    hot = F.broadcast(blocks)
    in_block = F.floor(F.col("id") / 1000).eqNullSafe(F.col("__block"))
    cold = b.join(hot, in_block, "left_anti").withColumn("seq", dealt)
    sliced = assign_buckets(b.join(hot, in_block, "left_semi"), ["id"], "__t", 30 * 86400 * 1_000_000)
    sliced = drop_bucket(running_sum_across_buckets(sliced, ["id"], order, "__one", "seq"))
    return cold.unionByName(sliced).drop("__t", "__one")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker-shaped change records for the order-line log.

    op = 'c' for a key's first version, 'u' for later ones, 'd' when the
    version is a delete (then ``before`` carries the row); every delete is
    followed by a tombstone (NULL value).  Product snapshot records ('r') on
    a second topic exercise routing, and one malformed record exercises the
    quarantine.  ``offset`` is the arrival order within a key.
    """
    from .functions.envelope import encode_date, encode_decimal, encode_micros
    b = numbered_orders(spark, sf_dir)
    row = F.struct(
        "id", "user_id", "product_id", "supp_key", "status",
        encode_decimal(F.col("amount"), 2).alias("amount"), "quantity", "discount", "tax",
        encode_date(F.col("order_date")).alias("order_date"),
        encode_micros(F.col("updated_at")).alias("updated_at"))
    op = (F.when(F.col("_is_deleted") == 1, "d").when(F.col("seq") == 1, "c").otherwise("u"))
    env = F.struct(F.when(op == "d", row).alias("before"), F.when(op != "d", row).alias("after"),
                   op.alias("op"),
                   F.floor(encode_micros(F.col("updated_at")) / 1000).cast("long").alias("ts_ms"),
                   F.struct(F.lit("orders").alias("table")).alias("source"))
    recs = b.select(F.lit(ORDERS_TOPIC).alias("topic"),
                    (F.col("id") % 8).cast("int").alias("partition"),
                    F.col("seq").cast("long").alias("offset"),
                    F.col("id").cast("string").alias("key"),
                    F.to_json(env).alias("__text"),
                    F.col("_synced_at").cast("timestamp").alias("timestamp"),
                    op.alias("_op"))
    # the generator also keeps filters on the value above it: the text is made once
    images = F.when(F.col("_op") == "d", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    recs = (recs.select("*", F.explode(images).alias("__image"))
                .withColumn("value", F.when(F.col("__image"), F.col("__text")))
                .select("topic", "partition", "offset", "key", "value", "timestamp"))
    p = bronze_products(spark, sf_dir)
    prow = F.to_json(F.struct(F.struct("id", "name", "category", "price").alias("after"),
                              F.lit("r").alias("op"), F.lit(0).cast("long").alias("ts_ms")))
    prods = p.select(F.lit(PRODUCTS_TOPIC).alias("topic"),
                     (F.col("id") % 8).cast("int").alias("partition"),
                     F.lit(1).cast("long").alias("offset"),
                     F.col("id").cast("string").alias("key"), prow.alias("value"),
                     F.col("_synced_at").cast("timestamp").alias("timestamp"))
    bad = spark.createDataFrame(
        [(ORDERS_TOPIC, 0, 0, "-1", "{oops", None)],
        "topic string, partition int, offset long, key string, value string, "
        "timestamp timestamp")
    return recs.unionByName(prods).unionByName(bad)


def typed_orders(unwrapped: DataFrame) -> DataFrame:
    """Decode connector-encoded values of unwrapped order rows."""
    from .functions.envelope import decode_date, decode_decimal, decode_micros
    return unwrapped.withColumns({
        "amount": decode_decimal("amount", 2, 10).cast("double"),
        "order_date": decode_date("order_date"),
        "updated_at": decode_micros("updated_at"),
    })


def row_schema(ddl: str):
    from pyspark.sql.types import StructType
    return StructType.fromDDL(ddl)


# Row schemas of the other replicated tables, as the source defines them: none
# of these has an updated_at column, so the source's change time is the version.
ROW_SCHEMAS = {
    "users": "id long, name string, email string, country string, created_at long",
    "products": "id long, name string, category string, price string",
    "support_tickets": "id long, user_id long, subject string, priority string, status string",
    "ml_prediccion_ventas": "fecha_prediccion string, mes_simulado long, prediccion_ventas double, "
                            "modelo_version string",
}


def _table_log(rows: DataFrame, table: str, row, made_ms, op, key_only_delete: bool = True) -> DataFrame:
    """Broker-shaped records: ``row`` is the image of c/u/r, a delete has the key alone."""
    deleted = op == "d"
    env = F.struct(F.when(deleted, F.struct(F.col("id"))).alias("before"),
                   F.when(~deleted, row).alias("after"), op.alias("op"), made_ms.alias("ts_ms"))
    return rows.select(F.lit(f"shop.public.{table}").alias("topic"), F.lit(0).alias("partition"),
                       F.col("version").cast("long").alias("offset"), F.col("id").cast("string").alias("key"),
                       F.to_json(env).alias("value"),
                       F.timestamp_millis(made_ms + 2000).alias("timestamp"))


def _versions(df: DataFrame) -> DataFrame:
    """A snapshot record for every id, an update for every third, a delete for every seventh."""
    return (df.withColumn("version", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
              .where((F.col("version") == 0) | ((F.col("version") == 1) & (F.col("id") % 3 == 0))
                     | ((F.col("version") == 2) & (F.col("id") % 7 == 0))))


def _made(version) -> F.Column:
    return (F.lit(946684800000) + version * 86400000 + F.col("id")).cast("long")


def _op(version) -> F.Column:
    return F.element_at(F.array(F.lit("r"), F.lit("u"), F.lit("d")), (version + 1).cast("int"))


def products_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.envelope import encode_decimal
    rows = _versions(bronze_products(spark, sf_dir))
    row = F.struct("id", "name", "category",
                   encode_decimal(F.col("price") + F.col("version"), 2).alias("price"))
    return _table_log(rows, "products", row, _made(F.col("version")), _op(F.col("version")))


def users_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.envelope import encode_micros
    rows = _versions(bronze_users(spark, sf_dir))
    row = F.struct("id", "name", "email",
                   F.when(F.col("version") == 1, F.lit("MOVED")).otherwise(F.col("country")).alias("country"),
                   encode_micros(F.col("created_at")).alias("created_at"))
    return _table_log(rows, "users", row, _made(F.col("version")), _op(F.col("version")))


def change_log_key_only_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order change log as a connector sends it by default: a delete names
    the key alone, and its time is that of the envelope."""
    log = change_log(spark, sf_dir)
    is_delete = F.get_json_object("value", "$.op") == "d"
    bare = F.concat(F.lit('{"before":{"id":'), F.col("key"), F.lit('},"op":"d","ts_ms":'),
                    F.get_json_object("value", "$.ts_ms"), F.lit("}"))
    return log.withColumn("value", F.when(is_delete, bare).otherwise(F.col("value")))


def change_log_with_broken_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order change log plus, for some keys, records with a broken key, an
    update without its row, a delete without any image and an unknown op."""
    log = change_log(spark, sf_dir)
    first = ((F.col("topic") == ORDERS_TOPIC) & (F.col("offset") == 1) & F.col("value").isNotNull()
             & (F.col("key").cast("long") % 97 == 0))
    broken = F.array(F.lit('{"after":{"id":"abc"},"op":"u","ts_ms":1}'), F.lit('{"after":null,"op":"u","ts_ms":1}'),
                     F.lit('{"op":"d","ts_ms":1}'), F.lit('{"after":{"id":1},"op":"x","ts_ms":1}'))
    bad = F.element_at(broken, (F.pmod(F.col("key").cast("long"), F.lit(4)) + 1).cast("int"))
    # beside its record, so that the log is made once
    return log.withColumn("value", F.explode(F.when(first, F.array("value", bad)).otherwise(F.array("value"))))


def change_log_drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order change log from a source whose fields drift: some rows have a
    new field, lack their quantity, or carry quantity or user as text."""
    log = change_log(spark, sf_dir).where(F.col("topic") == ORDERS_TOPIC)
    k = F.col("key").cast("long")
    # a step each, and the last beside its record: a text is made and rewritten once
    for every, pattern, by in ((7, '"(after|before)":[{]', '"$1":{"channel":"web",'), (11, '"quantity":[^,]*,', ""),
                               (13, '"quantity":([0-9.E]+)', '"quantity":"$1 pcs"'), (17, '"user_id":([0-9]+)', '"user_id":"$1"')):
        log = log.withColumn("value", F.when(k % every == 0, F.regexp_replace("value", pattern, by)).otherwise(F.col("value")))
    return log.withColumn("value", F.explode(F.array("value")))
