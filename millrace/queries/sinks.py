"""Joins, counts, distribution and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.folders import current
from millrace.operators.dates import DATE_PARTS, add_date_parts
from millrace.operators.distribution import spread
from millrace.operators.joins import equi_join, salted_join
from millrace.operators.quality import (
    READING,
    WRITING,
    TooManyErrors,
    check_errors,
    count_records,
    first_error_stops,
    metrics_row,
)
from millrace.plans.refresh import Warehouse
from millrace.plans.warehouse import load_warehouse
from millrace.queries.registry import derived, new_database, query, table, time_text
from millrace.session import fresh_dir
from millrace.sinks.files import write_parquet, write_partitioned
from millrace.sinks.landing import land
from millrace.sources.catalog import register_table
from millrace.sources.files import read_csv, read_json, read_parquet

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def warehouse(spark: SparkSession, table: str) -> Warehouse:
    """The database named by ``spark.millrace.warehouse.url``, else one embedded in this process.

    Executors in other processes do not see the embedded one: on a cluster, name a real one.
    """
    name = uuid.uuid4().hex
    url = spark.conf.get("spark.millrace.warehouse.url", None)
    if url:
        return Warehouse(url, f"{table}_{name}", {})
    return Warehouse(f"jdbc:derby:memory:wh_{name};create=true", table, DERBY)


@query("join_inner", """
    SELECT o_orderkey, o_orderdate, shipped, lines FROM orders
    JOIN (SELECT l_shipdate AS shipped, count(*) AS lines FROM lineitem GROUP BY l_shipdate)
      ON o_orderdate = shipped
""")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number of lines shipped on the day of the order; lines are counted per day first."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return equi_join(orders, shipped.agg(F.count(F.lit(1)).alias("lines")), ["o_orderdate"], ["shipped"])


@query("join_hot_key", """
    SELECT o_orderkey, o_orderpriority, day, n_parts FROM (
        SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '1995-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS of_day FROM orders)
    JOIN (SELECT CASE WHEN l_shipdate < '1995-01-01' THEN '1995-01-01' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
                 l_suppkey, count(*) AS n_parts FROM lineitem WHERE l_suppkey <= 3 GROUP BY ALL) ON of_day = day
""")
def join_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day holds half of the orders: its rows are dealt over salts, and the other side's replicated for each."""
    day, hot = time_text("o_orderdate", "yyyy-MM-dd"), F.lit("1995-01-01")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, hot).otherwise(day).alias("of_day")
    )
    shipped = time_text("l_shipdate", "yyyy-MM-dd")
    parts = table(spark, sf_dir, "lineitem").where("l_suppkey <= 3")
    parts = parts.groupBy(F.when(shipped < hot, hot).otherwise(shipped).alias("day"), "l_suppkey").agg(F.count("*").alias("n_parts"))
    return salted_join(orders, parts, ["of_day"], ["day"], 64).drop("of_day", "l_suppkey")


@query("metrics", """
    SELECT action, records,
           concat('{"job_metrics":"copy","directory":"events","records":', records, ',"action":"', action, '"}') AS json
    FROM (SELECT 'reading_s3' AS action, count(*) AS records FROM events
          UNION ALL SELECT 'writing_s3', count(*) FROM events)
""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = table(spark, sf_dir, "events"), fresh_dir(spark, "events-copy")
    write_parquet(events, path)
    read, written = count_records(events), count_records(read_parquet(spark, path))
    rows = metrics_row(spark, "copy", "events", read, READING).union(
        metrics_row(spark, "copy", "events", written, WRITING)
    )
    return rows.select("action", "records", "json")


@query("error_threshold", """
    WITH props AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events)
    SELECT 0 AS threshold, 'passed' AS verdict, n, bad FROM props
    UNION ALL SELECT 1, 'failed', n, bad FROM props
    UNION ALL SELECT 2, 'failed', n, bad FROM props
    UNION ALL SELECT 2000000000, 'passed', n, bad FROM props
""")
def error_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text of the events, cut short where the event is an error, against four thresholds."""

    def write(path: str) -> None:
        cut = F.when(F.col("event_type") == "error", F.rtrim("props", F.lit("}"))).otherwise(F.col("props"))
        table(spark, sf_dir, "events").select(cut).write.option("compression", "gzip").text(path)

    path = derived(spark, sf_dir, "props-cut", write)
    schema, verdicts = "k long", []
    props = read_json(spark, path, schema, bad_record="line")
    for threshold in (0, 1, 2, 2_000_000_000):
        try:
            if threshold == 1:
                with first_error_stops():
                    write_parquet(read_json(spark, path, schema, fail_fast=True), fresh_dir(spark, "props"))
            else:
                check_errors(props, threshold, "line")
            verdicts.append((threshold, "passed"))
        except TooManyErrors:
            verdicts.append((threshold, "failed"))
    counts = (props.count(), check_errors(props, 0, "line"))
    return spark.createDataFrame(
        [(*verdict, *counts) for verdict in verdicts], "threshold int, verdict string, n long, bad long"
    )


@query("spread", """
    SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag
""")
def spread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), 200)
    counts = (F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
    return lines.groupBy("l_returnflag").agg(*counts)


EVENT_DAYS_SQL = """
    SELECT event_id, user_id, event_type, value, props,
           year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events
"""


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_date_parts(table(spark, sf_dir, "events"), "ts").drop("ts")


@query("partitioned_write", EVENT_DAYS_SQL)
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "event-days")
    write_partitioned(event_days(spark, sf_dir), path, DATE_PARTS)
    return read_parquet(spark, path)


@query("partitioned_write_null_key", """
    SELECT event_id, user_id, event_type, value, props, CASE WHEN event_type <> 'error' THEN year(ts)::INT END AS year,
           CASE WHEN event_type <> 'error' THEN month(ts)::INT END AS month,
           CASE WHEN event_type <> 'error' THEN day(ts)::INT END AS day FROM events
""")
def partitioned_write_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a date share the default partition, here a fifth of all."""
    path = fresh_dir(spark, "event-days-null")
    dated = F.when(F.col("event_type") != "error", F.col("ts"))
    events = table(spark, sf_dir, "events").withColumn("ts", dated)
    write_partitioned(add_date_parts(events, "ts").drop("ts"), path, DATE_PARTS)
    return read_parquet(spark, path)


@query("partition_overwrite", """
    SELECT event_id, user_id, event_type, CASE WHEN day(ts) = 15 THEN -value ELSE value END AS value, props,
           year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events
""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day is written again, twice; the other days stay as they were."""
    path, events = fresh_dir(spark, "event-days-again"), event_days(spark, sf_dir)
    write_partitioned(events, path, DATE_PARTS, mode="overwrite")
    redone = events.filter(F.col("day") == 15).withColumn("value", -F.col("value"))
    for _ in range(2):
        write_partitioned(redone, path, DATE_PARTS, mode="overwrite")
    return read_parquet(spark, path)


PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("snappy_write", PART_SQL)
def snappy_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "part")
    write_parquet(table(spark, sf_dir, "part"), path)
    return read_parquet(spark, path)


@query("replace_write", PART_SQL)
def replace_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice, there once."""
    path = fresh_dir(spark, "part-twice")
    for _ in range(2):
        write_parquet(table(spark, sf_dir, "part"), path, mode="overwrite")
    return read_parquet(spark, path)


@query("warehouse_load", "SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def warehouse_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table loaded twice: the second load replaces the first."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    path, db, target = fresh_dir(spark, "processed"), new_database(spark), warehouse(spark, "customer_nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    write_parquet(joined.select("c_custkey", "c_acctbal", "n_name"), path)
    register_table(spark, db, "processed_data", path, "parquet")
    for _ in range(2):
        load_warehouse(spark, db, "processed_data", *target)
    return spark.read.jdbc(target.url, target.table, properties=target.properties)


@query("landing_refresh", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def landing_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New raw files take the place of older, different ones."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    old = derived(spark, sf_dir, "part-csv", lambda p: part.write.option("header", True).csv(p))
    new = derived(spark, sf_dir, "supplier-csv", lambda p: supplier.write.option("header", True).csv(p))
    raw = fresh_dir(spark, "raw")
    land(spark, old, raw, "csv")
    land(spark, new, raw, "csv")
    return read_csv(spark, raw, supplier.schema)


@query("landing_partitioned", """
    SELECT fmt, s_suppkey::VARCHAR AS s_suppkey, s_name, s_acctbal::VARCHAR AS s_acctbal, concat('0', s_nationkey) AS value
    FROM supplier, (VALUES ('csv'), ('json')) f(fmt)
""")
def landing_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts below ``value=…``, what Spark calls a line as well, with leading zeros, landed as CSV and as JSON."""
    nation = F.concat(F.lit("0"), F.col("s_nationkey").cast("string")).alias("value")
    text = [F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_acctbal")]
    supplier = table(spark, sf_dir, "supplier").select(*text, nation)
    out = None
    for fmt in ("csv", "json"):
        write = lambda p, fmt=fmt: supplier.write.partitionBy("value").option("header", True).format(fmt).save(p)
        raw = fresh_dir(spark, "raw")
        land(spark, derived(spark, sf_dir, f"supplier-{fmt}-keyed", write), raw, fmt)
        rows = spark.read.option("header", True).schema(supplier.schema).format(fmt).load(current(spark, raw))
        rows = rows.withColumn("fmt", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    return out
