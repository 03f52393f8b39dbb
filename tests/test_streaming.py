import pytest
from pyspark.sql import functions as F

from millrace import ingest_incremental


def test_each_file_counts_once(spark, lines, tmp_path):
    src = lines("src", "1.json.gz", '{"a": "1"}', '{"a": "2"}')
    dst, log = str(tmp_path / "dst"), str(tmp_path / "log")

    def run():
        ingest_incremental(spark, src, dst, "a string", log)
        return sorted(r.a for r in spark.read.parquet(dst).collect())

    assert run() == run() == ["1", "2"]
    lines("src", "2.json.gz", '{"a": "3"}')
    assert run() == run() == ["1", "2", "3"]


def test_backlog_in_bounded_batches_with_transform(spark, lines, tmp_path):
    for i in range(5):
        src = lines("src", f"{i}.json", f'{{"a": "{i}"}}')
    dst, log = str(tmp_path / "dst"), str(tmp_path / "log")
    ingest_incremental(
        spark,
        src,
        dst,
        "a string",
        log,
        transform=lambda df: df.withColumn("odd", F.col("a").cast("int") % 2),
        partition_by=["odd"],
        files_per_batch=2,
    )
    assert len(list((tmp_path / "log" / "commits").glob("[0-9]*"))) == 3
    assert spark.read.parquet(dst).groupBy("odd").count().orderBy("odd").collect() == [(0, 3), (1, 2)]


def test_a_batch_of_many_tasks_leaves_few_files(spark, tmp_path):
    src, dst = str(tmp_path / "src"), tmp_path / "dst"
    spark.range(0, 6_000, 1, 12).select(F.col("id").cast("string").alias("a")).write.json(src)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        ingest_incremental(
            spark,
            src,
            str(dst),
            "a string",
            str(tmp_path / "log"),
            transform=lambda df: df.withColumn("third", F.col("a").cast("int") % 3),
            partition_by=["third"],
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [len(list((dst / f"third={i}").glob("*.parquet"))) for i in range(3)] == [1, 1, 1]
    assert spark.read.parquet(str(dst)).count() == 6_000


def test_a_malformed_record_stops_the_run(spark, lines, tmp_path):
    src = lines("src", "1.json", '{"a": "1"}')
    dst, log = str(tmp_path / "dst"), str(tmp_path / "log")
    ingest_incremental(spark, src, dst, "a string", log)
    lines("src", "2.json", '{"a": "2"}', '{"a": ')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        ingest_incremental(spark, src, dst, "a string", log)
    assert [r.a for r in spark.read.parquet(dst).collect()] == ["1"]
    ingest_incremental(spark, src, dst, "a string", log, mode="DROPMALFORMED")
    assert sorted(r.a for r in spark.read.parquet(dst).collect()) == ["1", "2"]
