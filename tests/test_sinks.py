import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import cluster, land, load_jdbc, read_parquet, write_parquet, write_partitioned
from millrace.folders import current
from millrace.queries.sinks import DERBY, warehouse as embedded
from millrace.sinks import warehouse
from millrace.sinks.files import StreamedFolder


def days(spark):
    return spark.range(100).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("int")).alias("day"))


def test_partitions_and_null_key(spark, tmp_path):
    path = tmp_path / "t"
    write_partitioned(days(spark), str(path), ["day"])
    assert sorted(p.name for p in path.glob("day=*")) == [
        "day=1",
        "day=2",
        "day=3",
        "day=__HIVE_DEFAULT_PARTITION__",
    ]
    assert all(len(list(p.glob("*.snappy.parquet"))) == 1 for p in path.glob("day=*"))
    assert spark.read.parquet(str(path)).filter("day is null").count() == 25
    write_partitioned(days(spark), str(path), ["day"])
    assert spark.read.parquet(str(path)).count() == 200


def test_overwrite_replaces_only_what_it_brings(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        write_partitioned(days(spark), path, ["day"], mode="overwrite")
    assert spark.read.parquet(path).count() == 100
    write_partitioned(days(spark).filter("day = 2 and id < 10"), path, ["day"], mode="overwrite")
    assert spark.read.parquet(path).count() == 100 - 25 + 2  # ids 2 and 6
    write_partitioned(days(spark).filter("day = 2"), path, ["day"], mode="replace")
    assert read_parquet(spark, path).count() == 25
    write_partitioned(days(spark).filter("day = 3"), path, ["day"])
    write_partitioned(days(spark).filter("day = 2 and id < 10"), path, ["day"], mode="overwrite")
    assert read_parquet(spark, path).count() == 25 + 2
    with pytest.raises(ValueError):
        write_partitioned(days(spark), path, ["day"], mode="ignore")


def test_hot_day_is_split_over_tasks(spark, tmp_path):
    """One day with most of the rows: a hash repartition would write it with a single task."""
    hot = spark.range(0, 400_000, 1, 8).select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 100 == 0, 2).otherwise(1).alias("day"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4m")
    try:
        write_partitioned(hot, str(tmp_path / "t"), ["day"])
        hash_only = hot.repartition("day").write.partitionBy("day").parquet
        hash_only(str(tmp_path / "plain"))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "plain" / "day=1").glob("*.parquet"))) == 1
    assert len(list((tmp_path / "t" / "day=1").glob("*.parquet"))) >= 4
    assert len(list((tmp_path / "t" / "day=2").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000


def test_hot_day_is_split_without_adaptive_execution(spark, tmp_path):
    copies = spark.range(0, 8_000, 1, 8).select(F.lit("same").alias("text"), F.lit(1).alias("day"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_partitioned(copies, str(tmp_path / "t"), ["day"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "t" / "day=1").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8_000


def test_clustered_rows_are_not_shuffled_again(spark):
    plan = cluster(days(spark), ["day"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REBALANCE" in plan


def test_replace(spark, tmp_path):
    path = tmp_path / "t"
    for n in (50, 7):
        write_parquet(spark.range(n), str(path))
    assert read_parquet(spark, str(path)).count() == 7
    assert all(".snappy." in p.name for p in Path(current(spark, str(path))).glob("*.parquet"))


@pytest.mark.parametrize("truncate", [True, False])
def test_warehouse_full_refresh(spark, truncate):
    url = embedded(spark, "t").url
    assert load_jdbc(spark.range(30), url, "t", truncate, properties=DERBY) == 30
    assert load_jdbc(spark.range(12), url, "t", truncate, properties=DERBY, connections=2) == 12
    assert spark.read.jdbc(url, "t", properties=DERBY).count() == 12
    assert load_jdbc(spark.range(0), url, "t", truncate, properties=DERBY) == 0


def test_warehouse_truncate_keeps_the_definition(spark):
    url = embedded(spark, "t").url
    load_jdbc(spark.range(3).selectExpr("cast(id as int) id"), url, "t", properties=DERBY)
    load_jdbc(spark.range(5), url, "t", properties=DERBY)
    assert [t for _, t in spark.read.jdbc(url, "t", properties=DERBY).dtypes] == ["int"]


def rows_of(spark, url, table="t"):
    return sorted(r[0] for r in spark.read.jdbc(url, table, properties=DERBY).collect())


def tables_of(spark, url):
    with warehouse._connection(spark, url, DERBY) as connection:
        found, out = connection.getMetaData().getTables(None, None, None, None), []
        while found.next():
            if found.getString("TABLE_TYPE") == "TABLE":
                out.append(found.getString("TABLE_NAME"))
        return out


@pytest.mark.parametrize("truncate", [True, False])
def test_a_task_that_is_run_again_replaces_its_own_rows(spark, monkeypatch, truncate):
    """Lost after its commit: the partition's rows are in the staging table under two attempts."""
    url, once = embedded(spark, "t").url, warehouse.stage

    def twice(df, *args):
        once(df, *args)
        once(df, *args)

    monkeypatch.setattr(warehouse, "stage", twice)
    for n in (9, 5):
        df = spark.range(0, n, 1, 4).selectExpr("id", "cast(null as string) as note", "timestamp'2024-01-01 01:02:03' as at")
        assert load_jdbc(df, url, "t", truncate, properties=DERBY) == n
        assert rows_of(spark, url) == list(range(n))
    assert tables_of(spark, url) == ["T"]


def test_loads_at_the_same_time_do_not_mix(spark, monkeypatch):
    """A whole load runs while another one has its rows staged."""
    url, once = embedded(spark, "t").url, warehouse.stage
    load_jdbc(spark.range(2), url, "t", properties=DERBY)

    def between(df, *args):
        once(df, *args)
        monkeypatch.setattr(warehouse, "stage", once)
        assert load_jdbc(spark.range(100, 104), url, "t", properties=DERBY) == 4
        assert rows_of(spark, url) == [100, 101, 102, 103]

    monkeypatch.setattr(warehouse, "stage", between)
    assert load_jdbc(spark.range(7), url, "t", properties=DERBY) == 7
    assert rows_of(spark, url) == list(range(7)) and tables_of(spark, url) == ["T"]


@pytest.mark.parametrize("truncate", [True, False])
@pytest.mark.parametrize("step", ["rows", "exists", "DELETE", "INSERT", "DROP", "RENAME"])
def test_a_load_that_fails_leaves_the_old_rows(spark, monkeypatch, truncate, step):
    url = embedded(spark, "t").url
    load_jdbc(spark.range(4), url, "t", properties=DERBY)
    df, run, asked = spark.range(3), warehouse._run, warehouse._exists
    broken = []

    def fail(*args):
        broken.append(step)
        raise ConnectionError("lost")

    if step == "rows":
        df = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    elif step == "exists":
        monkeypatch.setattr(warehouse, "_exists", lambda c, t: fail() if t == "t" else asked(c, t))
    else:
        lost = lambda text: text.startswith(step) and "_s" not in text.split()[-1]
        monkeypatch.setattr(warehouse, "_run", lambda c, text: fail() if lost(text) and not broken else run(c, text))
    try:
        load_jdbc(df, url, "t", truncate, properties=DERBY)
    except Exception as error:
        assert "lost" in str(error)
        assert rows_of(spark, url) == [0, 1, 2, 3]
    else:  # a statement that this way of loading does not use
        assert not broken and rows_of(spark, url) == [0, 1, 2]
    assert tables_of(spark, url) == ["T"]


def test_names_of_tables_and_columns(spark):
    url = embedded(spark, "t").url
    df = spark.range(3).toDF("select").selectExpr("`select`", "1 as `two words`")
    for _ in range(2):
        assert load_jdbc(df, url, "app.Wh_1", properties=DERBY) == 3
    assert load_jdbc(spark.range(2), url, "whx1", properties=DERBY) == 2
    assert rows_of(spark, url, "app.WH_1") == [0, 1, 2]
    with pytest.raises(ValueError):
        load_jdbc(df.withColumn(warehouse.PART, F.lit(1)), url, "t", properties=DERBY)


def test_no_append_beside_a_stream(spark, tmp_path):
    (tmp_path / "t" / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(StreamedFolder):
        write_partitioned(days(spark), str(tmp_path / "t"), ["day"])
    with pytest.raises(StreamedFolder):
        write_parquet(days(spark), str(tmp_path / "t"), mode="append")


def test_landing_refuses_ragged_rows(spark, lines, tmp_path):
    dst = str(tmp_path / "raw")
    land(spark, lines("good", "a.csv", "a,b", "1,2"), dst, "csv")
    with pytest.raises(Exception, match="MALFORMED"):
        land(spark, lines("bad", "a.csv", "a,b", "1,2,3"), dst, "csv")
    assert spark.read.option("header", True).csv(current(spark, dst)).count() == 1


def test_landing_of_a_truncated_file_leaves_the_old_ones(spark, lines, tmp_path):
    dst = str(tmp_path / "raw")
    land(spark, lines("good", "a.json.gz", '{"a": 1}'), dst, "json")
    src = Path(lines("bad", "a.json.gz", *['{"a": %d}' % i for i in range(1000)])) / "a.json.gz"
    src.write_bytes(src.read_bytes()[:-200])
    with pytest.raises(Exception):
        land(spark, str(src.parent), dst, "json")
    assert spark.read.text(current(spark, dst)).count() == 1


@pytest.mark.parametrize("fmt, name, text", [("csv", "a.csv", ("a,b", "01,2")), ("json", "a.json", ('{"a": "01"}',))])
def test_landing_keeps_directories_and_subfolders(spark, lines, tmp_path, fmt, name, text):
    (tmp_path / "keyed").mkdir()
    lines("keyed/code=007", name, *text)
    dst = str(tmp_path / "raw")
    land(spark, str(tmp_path / "keyed"), dst, fmt)
    assert [p.name for p in Path(current(spark, dst)).glob("code=*")] == ["code=007"]
    src = lines("plain", name, *text)
    lines("plain/more", name, *text)
    land(spark, src, dst, fmt)
    assert spark.read.option("header", True).format(fmt).load(current(spark, dst)).count() == 2


def test_landing_replaces_and_keeps_values(spark, lines, tmp_path):
    src = lines("src", "a.csv", "k,v", '007," x ""y"", "', "2,", '3,""', '"",4')
    dst = str(tmp_path / "raw")
    land(spark, lines("old", "a.csv", "z", "1", "2"), dst, "csv")
    for _ in range(2):
        land(spark, src, dst, "csv")
    text = sorted(r[0] for r in spark.read.text(current(spark, dst)).collect())
    assert text == ['"",4', '007," x ""y"", "', "2,", '3,""', "k,v"]


def test_landing_json_is_untouched(spark, lines, tmp_path):
    text = ('{"a":  1.50, "b": "é"}', "{broken")
    land(spark, lines("src", "a.json.gz", *text), str(tmp_path / "raw"), "json")
    files = list(Path(current(spark, str(tmp_path / "raw"))).glob("*.gz"))
    assert "".join(gzip.decompress(f.read_bytes()).decode() for f in files).splitlines() == list(text)


@pytest.mark.parametrize("dst", ["{0}/src", "file:{0}/src/", "{0}/src/sub", "{0}"])
def test_landing_never_clears_its_source(spark, lines, tmp_path, dst):
    src = lines("src", "a.csv", "k", "1")
    with pytest.raises(ValueError, match="overlap"):
        land(spark, src, dst.format(tmp_path), "csv")
    assert spark.read.text(src).count() == 2
