"""Scans, catalog tables and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.dates import DATE_PARTS, add_date_parts
from millrace.queries.registry import derived, new_database, query, table, time_text
from millrace.session import fresh_dir
from millrace.sinks.files import append_partitions, write_parquet, write_partitioned
from millrace.sources.catalog import (
    add_partitions,
    describe,
    discover_table,
    is_deprecated,
    read_table,
    refresh_partitions,
    register_table,
    sync_schema,
)
from millrace.sources.crawl import crawl
from millrace.sources.files import read_csv, read_json, read_parquet
from millrace.streaming.incremental import ingest_incremental

ORDERS = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
)
ORDERS_SQL = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,"
    " strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders"
)


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", time_text("o_orderdate"))


def orders_json(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        orders_text(spark, sf_dir).write.option("compression", "gzip").json(path)

    return derived(spark, sf_dir, "orders-json", write)


@query("json_scan", ORDERS_SQL)
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_json(spark, orders_json(spark, sf_dir), ORDERS)


@query("json_scan_rechunked", ORDERS_SQL)
def json_scan_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan, with the gzip files cut into small ones first."""
    return read_json(spark, orders_json(spark, sf_dir), ORDERS, rechunk_over=0)


@query("json_scan_partitioned", f"""
    SELECT rechunked, o.* EXCLUDE (o_orderstatus), o_orderstatus AS value FROM ({ORDERS_SQL}) o, (VALUES (0), (1)) n(rechunked)
""")
def json_scan_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders below ``value=…``, which is also what Spark calls a line: the directory's column survives cutting the files."""

    def write(path: str) -> None:
        keyed = orders_text(spark, sf_dir).withColumnRenamed("o_orderstatus", "value")
        keyed.write.partitionBy("value").option("compression", "gzip").json(path)

    path = derived(spark, sf_dir, "orders-json-keyed", write)
    schema = ORDERS.replace("o_orderstatus string, ", "")
    scans = [read_json(spark, path, schema, rechunk_over=limit) for limit in (None, 0)]
    first, second = (df.withColumn("rechunked", F.lit(i)) for i, df in enumerate(scans))
    return first.unionByName(second)


@query("json_scan_inferred", f"""
    SELECT o.* REPLACE (o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_totalprice::VARCHAR AS o_totalprice)
    FROM ({ORDERS_SQL}) o
""")
def json_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No schema given: the columns are found in the files, every leaf as text."""
    return read_json(spark, orders_json(spark, sf_dir))


@query("json_scan_exclude", ORDERS_SQL)
def json_scan_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, uncompressed copy of the orders lies in the same folder and is skipped by name."""

    def write(path: str) -> None:
        orders = orders_text(spark, sf_dir)
        orders.write.option("compression", "gzip").json(path)
        orders.write.mode("append").json(path)

    path = derived(spark, sf_dir, "orders-json-twice", write)
    return read_json(spark, path, ORDERS, exclude=["_part*", "*.json"])


@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    path = derived(spark, sf_dir, "customer-csv", lambda p: customer.write.option("header", True).csv(p))
    return read_csv(spark, path, customer.schema)


@query("csv_scan_inferred", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    path = derived(spark, sf_dir, "customer-csv", lambda p: customer.write.option("header", True).csv(p))
    return read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("parquet_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/part.parquet")


@query("catalog_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = new_database(spark)
    register_table(spark, db, "supplier", f"{sf_dir}/supplier.parquet", "parquet")
    return read_table(spark, db, "supplier")


@query("catalog_scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def catalog_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files as a table, the way a crawler exposes them."""
    customer, db = table(spark, sf_dir, "customer"), new_database(spark)
    path = derived(spark, sf_dir, "customer-csv", lambda p: customer.write.option("header", True).csv(p))
    register_table(spark, db, "customer", path, "csv")
    return read_table(spark, db, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("partition_discovery", """
    SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, count(*) AS n
    FROM events GROUP BY ALL
""")
def partition_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the directories appear after the table was registered."""
    db, path = new_database(spark), fresh_dir(spark, "events-by-day")
    events = add_date_parts(table(spark, sf_dir, "events"), "ts")
    write_partitioned(events.filter("day <= 15"), path, DATE_PARTS)
    register_table(spark, db, "events", path, "parquet")
    write_partitioned(events.filter("day > 15"), path, DATE_PARTS)
    return refresh_partitions(spark, db, "events").groupBy(*DATE_PARTS).agg(F.count(F.lit(1)).alias("n"))


@query("partitions_from_commits", """
    SELECT day(ts)::INT AS day, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def partitions_from_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog learns of partitions from what each append reports, without listing the folder."""
    db, path = new_database(spark), fresh_dir(spark, "events-appended")
    events = add_date_parts(table(spark, sf_dir, "events"), "ts").drop("ts")
    keys = ["day", "event_type"]
    append_partitions(events.filter("day <= 10"), path, keys)
    register_table(spark, db, "events", path, "parquet")
    for part in ("day > 10 and day <= 15", "day > 15", "day > 15"):
        # The last one is a run that is repeated.
        add_partitions(spark, db, "events", append_partitions(events.filter(part), path, keys, part.replace(" ", "")))
    return read_table(spark, db, "events").groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_crawl", """
    SELECT 'customer' AS name, 'csv' AS fmt, 5 AS n_columns, count(*) AS n FROM customer
    UNION ALL SELECT 'orders', 'json', 6, count(*) FROM orders
    UNION ALL SELECT 'parts', 'parquet', 6, count(*) FROM part
    UNION ALL SELECT 'regions', 'parquet', 2, 2 * count(*) FROM region
    UNION ALL SELECT 'nation', 'parquet', 3, count(*) FROM nation
    UNION ALL SELECT 'supplier', 'parquet', 4, count(*) FROM supplier
""")
def catalog_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of several formats below one prefix, with and without partitions, published, nested, and two that are one table."""
    db, prefix = new_database(spark), fresh_dir(spark, "extracts")
    of = lambda name: table(spark, sf_dir, name)
    of("customer").write.option("header", True).csv(f"{prefix}/raw/customer")
    orders_text(spark, sf_dir).write.partitionBy("o_orderstatus").option("compression", "gzip").json(f"{prefix}/raw/orders")
    write_parquet(of("part"), f"{prefix}/processed/parts")
    for year in (2023, 2024):
        of("region").write.parquet(f"{prefix}/processed/regions/{year}")
    of("nation").write.parquet(f"{prefix}/mixed/nation")
    of("supplier").write.parquet(f"{prefix}/mixed/supplier")
    crawl(spark, db, prefix)
    write_parquet(of("part"), f"{prefix}/processed/parts")
    found = []
    for t in crawl(spark, db, prefix):
        rows = read_table(spark, db, t.table)
        found.append((t.table, t.fmt, len(rows.columns), rows.count()))
    return spark.createDataFrame(found, "name string, fmt string, n_columns int, n long")


@query("schema_evolution", """
    SELECT 1 AS step, 'c_mktsegment' AS column_name, 'added' AS change,
           NULL::VARCHAR AS old_type, 'string' AS new_type, count(*) AS n FROM customer
    UNION ALL
    SELECT 2, 'c_name', 'removed', 'string', NULL, count(*) FROM customer
    UNION ALL
    SELECT 3, 'c_nationkey', 'retyped', 'int', 'bigint', count(*) FROM customer
""")
def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of the customers, each with other columns, replace one another below one table."""
    customer, db = table(spark, sf_dir, "customer"), new_database(spark)
    path = fresh_dir(spark, "customer-extract")
    extracts = [
        customer.select("c_custkey", "c_nationkey", "c_name"),
        customer.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment"),
        customer.select("c_custkey", "c_nationkey", "c_mktsegment"),
        customer.select("c_custkey", F.col("c_nationkey").cast("long"), "c_mktsegment"),
    ]
    write_parquet(extracts[0], path)
    register_table(spark, db, "customer", path, "parquet")
    found = []
    for step, extract in enumerate(extracts[1:], start=1):
        write_parquet(extract, path)
        changes = sync_schema(spark, db, "customer")
        rows = read_table(spark, db, "customer").count()
        found += [(step, *change, rows) for change in changes]
    return spark.createDataFrame(
        found, "step int, column_name string, change string, old_type string, new_type string, n long"
    )


@query("schema_evolution_rows", """
    SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal
    FROM customer
""")
def schema_evolution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that came before a column was added give NULL for it."""
    customer, db = table(spark, sf_dir, "customer"), new_database(spark)
    path = fresh_dir(spark, "customer-growing")
    building = F.col("c_mktsegment") == "BUILDING"
    write_parquet(customer.filter(building).select("c_custkey", "c_mktsegment"), path)
    discover_table(spark, db, "customer", path, "parquet")
    later = customer.filter(~building).select("c_custkey", "c_mktsegment", "c_acctbal")
    write_parquet(later, path, mode="append")
    discover_table(spark, db, "customer", path, "parquet")
    return read_table(spark, db, "customer")


@query("table_deprecation", """
    SELECT 'present' AS state, false AS deprecated, true AS listed, count(*) AS n FROM supplier
    UNION ALL
    SELECT 'vanished', true, true, NULL
""")
def table_deprecation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of the files drops them; the table recorded over them is flagged and kept."""
    db = new_database(spark)
    table(spark, sf_dir, "supplier").write.saveAsTable(f"{db}.owned")
    path = describe(spark, db, "owned")["location"]
    found = []
    for state in ("present", "vanished"):
        if state == "vanished":
            spark.sql(f"DROP TABLE {db}.owned")
        discover_table(spark, db, "supplier", path, "parquet")
        flagged, listed = is_deprecated(spark, db, "supplier"), spark.catalog.tableExists(f"{db}.supplier")
        found.append((state, flagged, listed, None if flagged else read_table(spark, db, "supplier").count()))
    return spark.createDataFrame(found, "state string, deprecated boolean, listed boolean, n long")


@query("incremental_ingest", ORDERS_SQL)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries and three runs: every order arrives once."""
    src, dst, log = (fresh_dir(spark, f"incremental-{part}") for part in ("src", "dst", "log"))
    orders = orders_text(spark, sf_dir)
    final = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    for delivery in (orders.filter(final), orders.filter(~final), None):
        if delivery is not None:
            delivery.write.mode("append").option("compression", "gzip").json(src)
        ingest_incremental(spark, src, dst, ORDERS, log)
    return read_parquet(spark, dst)
