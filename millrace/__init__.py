"""Table-level Spark operators that turn raw nested files into typed, partitioned tables."""

from millrace.operators.distribution import cluster, spread
from millrace.operators.filters import filter_in
from millrace.operators.flatten import absorb, flatten, relationalize, strip_name
from millrace.operators.cleaning import strip_quotes
from millrace.operators.dates import add_date_parts
from millrace.operators.joins import equi_join, salted_join
from millrace.operators.mapping import Mapping, apply_mapping, read_mapping, source_schema, target_schema
from millrace.operators.quality import (
    TooManyErrors,
    check_errors,
    count_records,
    first_error_stops,
    is_empty,
    metrics_row,
    write_metrics,
)
from millrace.session import shared_dir, fresh_dir
from millrace.folders import add, current, publish
from millrace.sinks.files import append_partitions, write_parquet, write_partitioned
from millrace.sinks.landing import land
from millrace.sinks.warehouse import load_jdbc
from millrace.sources.catalog import (
    add_partitions,
    discover_table,
    mark_deprecated,
    read_table,
    refresh_partitions,
    register_table,
    sync_schema,
)
from millrace.sources.crawl import crawl, discover_new
from millrace.sources.files import oversized_gzip, read_csv, read_json, read_parquet
from millrace.streaming.incremental import ingest_incremental

__all__ = [
    "Mapping",
    "TooManyErrors",
    "absorb",
    "add",
    "add_date_parts",
    "add_partitions",
    "append_partitions",
    "apply_mapping",
    "check_errors",
    "cluster",
    "count_records",
    "crawl",
    "current",
    "discover_new",
    "discover_table",
    "equi_join",
    "filter_in",
    "first_error_stops",
    "flatten",
    "fresh_dir",
    "ingest_incremental",
    "is_empty",
    "land",
    "load_jdbc",
    "mark_deprecated",
    "metrics_row",
    "oversized_gzip",
    "publish",
    "read_csv",
    "read_json",
    "read_mapping",
    "read_parquet",
    "read_table",
    "refresh_partitions",
    "register_table",
    "relationalize",
    "salted_join",
    "shared_dir",
    "source_schema",
    "spread",
    "strip_name",
    "strip_quotes",
    "sync_schema",
    "target_schema",
    "write_metrics",
    "write_parquet",
    "write_partitioned",
]
