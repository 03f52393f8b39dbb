"""Runs that are cut short at every step: readers always find whole versions, and the next run carries on."""

import os
import time
from pathlib import Path

import pytest

from millrace import folders, ingest_incremental, land, read_csv, read_json, read_parquet, read_table, write_parquet, write_partitioned
from millrace.folders import add, current, publish, recover
from millrace.plans import jobmart
from millrace.plans.jobmart import build_job_mart
from millrace.sources.catalog import discover_table, register_table, sync_schema


class Killed(BaseException):
    pass


@pytest.fixture
def killer(monkeypatch):
    """Let the n-th use of the file system by ``folders`` end the run as a kill would, without any clean-up."""
    state = {"left": None}
    for name in ("names", "_delete", "touch", "exists", "hadoop_path"):
        own = getattr(folders, name)

        def step(*args, own=own):
            if state["left"] is not None:
                state["left"] -= 1
                if state["left"] < 0:
                    raise Killed
            return own(*args)

        monkeypatch.setattr(folders, name, step)

    def at(n):
        state["left"] = n

    return at


def rows(spark, path):
    return sorted(r[0] for r in read_parquet(spark, path).collect())


def steps(killer, run):
    """Run it killed at its first step, its second, and so on, until it comes through."""
    for n in range(200):
        killer(n)
        try:
            run()
        except Killed:
            killer(None)
            yield n
            continue
        killer(None)
        return
    raise AssertionError("it never came through")


@pytest.mark.parametrize("plain", [True, False])
def test_a_replacing_run_killed_at_any_step_leaves_a_whole_version(spark, killer, tmp_path, plain):
    path = str(tmp_path / "t")
    old, new = [1, 2], [7, 8, 9]
    first = spark.createDataFrame([(i,) for i in old], "i int")
    (first.write.parquet(path) if plain else write_parquet(first, path))
    after = spark.createDataFrame([(i,) for i in new], "i int").coalesce(1)
    seen = []
    for _ in steps(killer, lambda: write_parquet(after, path)):
        seen.append(rows(spark, path))
        assert seen[-1] in (old, new)
    assert rows(spark, path) == new and old in seen and new in seen
    for i in range(3):
        write_parquet(spark.range(i), path)
    assert len(folders.names(spark, f"{path}/_runs")) == folders.KEPT
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 0


def test_readers_of_the_version_before_finish(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(5), path)
    before = read_parquet(spark, path)
    write_parquet(spark.range(2), path)
    assert before.count() == 5 and read_parquet(spark, path).count() == 2


def test_nothing_that_was_written_is_renamed(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 4):
        seen = []
        publish(spark, path, lambda folder: (spark.range(n).write.parquet(folder), seen.append(folder)))
        assert current(spark, path) == seen[0] and read_parquet(spark, path).count() == n


def test_of_two_runs_at_once_the_last_one_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(1), path)

    def slow(folder):
        spark.range(2).write.parquet(folder)
        write_parquet(spark.range(3), path)  # starts later, ends earlier
        assert read_parquet(spark, path).count() == 3

    publish(spark, path, slow)
    assert read_parquet(spark, path).count() == 2


def test_a_run_that_two_others_overtake_says_so(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(1), path)

    def slower(folder):
        spark.range(2).write.parquet(folder)
        for n in (3, 4, 5):
            write_parquet(spark.range(n), path)

    with pytest.raises(OSError, match="removed"):
        publish(spark, path, slower)
    assert read_parquet(spark, path).count() == 5


def test_an_addition_killed_at_any_step_counts_once_or_not_at_all(spark, killer, tmp_path):
    keyed = lambda n: spark.range(n, n + 10).selectExpr("id", "id % 3 as k").coalesce(1)
    path = str(tmp_path / "t")
    keyed(0).write.partitionBy("k").parquet(path)
    before = {p.name for p in Path(path).glob("k=*/*")}
    write = lambda folder: keyed(10).write.partitionBy("k").parquet(folder)
    seen = []
    for n in steps(killer, lambda: add(spark, path, write, "a")):
        seen.append(len(rows(spark, path)))
        recover(spark, path)
        assert rows(spark, path) in (list(range(10)), list(range(20))), n
        if (tmp_path / "t" / "_added" / "a").exists():
            (tmp_path / "t" / "_added" / "a").unlink()  # and once more, from the start
            for file in (tmp_path / "t").glob("k=*/*"):
                if file.name not in before:
                    file.unlink()
    assert rows(spark, path) == list(range(20)) and 10 in seen and len(seen) > 10


def test_a_name_is_added_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for name in ("a", "b", "a", "a"):
        add(spark, path, spark.range(2).write.parquet, name)
    assert rows(spark, path) == [0, 0, 1, 1]
    folders.forget(spark, path, "a", keep=0)
    assert add(spark, path, spark.range(1).write.parquet, "a") and len(rows(spark, path)) == 5


def test_what_a_killed_run_left_unmarked_is_removed_in_time(spark, tmp_path):
    path = tmp_path / "t"
    for name, age in (("old", 2 * folders.ABANDONED), ("new", 60)):
        left = path / "_pending" / name
        left.mkdir(parents=True)
        os.utime(left, (time.time() - age,) * 2)
    recover(spark, str(path))
    assert [p.name for p in (path / "_pending").iterdir()] == ["new"]


@pytest.mark.parametrize("published", [True, False])
def test_a_failing_addition_adds_nothing(spark, tmp_path, published):
    path = str(tmp_path / "t")
    write_parquet(spark.range(3), path, "overwrite" if published else "append")

    def broken(folder):
        spark.range(4).write.parquet(folder)
        raise ValueError("late")

    with pytest.raises(ValueError):
        add(spark, path, broken)
    assert rows(spark, path) == [0, 1, 2] and not folders.names(spark, f"{current(spark, path)}/_pending")
    add(spark, path, spark.range(3, 5).write.parquet)
    assert rows(spark, path) == [0, 1, 2, 3, 4]


# Ingestion


@pytest.mark.parametrize("step", ["write", "forget"])
def test_a_batch_that_is_run_again_counts_once(spark, lines, tmp_path, monkeypatch, step):
    """Cut short while it is written, and after its rows were added but before the checkpoint knows."""
    src = lines("src", "1.json", '{"a": "1"}')
    dst, log = str(tmp_path / "dst"), str(tmp_path / "log")
    run = lambda: ingest_incremental(spark, src, dst, "a string", log)
    assert run().written == 1
    lines("src", "2.json", '{"a": "2"}', '{"a": "3"}')
    with monkeypatch.context() as patch:
        from millrace.streaming import incremental

        def fail(*args, **kwargs):
            raise RuntimeError("cut short")

        if step == "write":
            patch.setattr(incremental, "add", lambda s, d, write, name: add(s, d, lambda f: (write(f), fail()), name))
        else:
            patch.setattr(incremental, "forget", fail)
        with pytest.raises(Exception, match="cut short"):
            run()
    run()
    assert sorted(r.a for r in read_parquet(spark, dst).collect()) == ["1", "2", "3"]
    assert run() == incremental.IngestRun(0, 0, 0, 0)


def test_batches_and_ingestion_share_a_folder(spark, lines, tmp_path):
    src = lines("src", "1.json", '{"a": "1"}', "{broken")
    dst, log = str(tmp_path / "dst"), str(tmp_path / "log")
    batch = spark.createDataFrame([("b",)], "a string")
    metrics = str(tmp_path / "m")
    run = lambda: ingest_incremental(spark, src, dst, "a string", log, mode="DROPMALFORMED", metrics_path=metrics)
    write_parquet(batch, dst, mode="append")
    found = run()
    assert (found.batches, found.read, found.bad, found.written) == (1, 2, 1, 1)
    write_parquet(batch, dst, mode="append")
    lines("src", "2.json", '{"a": "2"}')
    assert run().written == 1 and run().batches == 0
    assert sorted(r.a for r in spark.read.parquet(dst).collect()) == ["1", "2", "b", "b"]
    assert sorted((r.action, r.records) for r in spark.read.parquet(metrics).collect()) == [
        ("reading_s3", 1), ("reading_s3", 2), ("writing_s3", 1), ("writing_s3", 1),
    ]
    # A checkpoint that starts over takes the files again: it is another one, though it lies at the same path.
    import shutil

    shutil.rmtree(log)
    assert run().read == 3


# Job mart


@pytest.mark.parametrize("mode", ["append", "overwrite", "replace"])
@pytest.mark.parametrize("max_errors, kept", [(0, 2), (1, None), (2, None), (3, 2)])
def test_one_read_of_the_input_for_any_threshold_and_mode(spark, lines, tmp_path, monkeypatch, mode, max_errors, kept):
    good = '{"jsonBody": {"JOB_ID": "%d", "START_TIME": "2024-01-0%d"}}'
    src, dst = lines("raw", "a.json", good % (1, 1), "{broken", good % (2, 2), "[1]"), str(tmp_path / "out")
    old = lines("old", "a.json", good % (9, 1), good % (8, 3))
    build_job_mart(spark, old, dst, "START_TIME", mode=mode)
    scans, scan = [], jobmart.read_json
    monkeypatch.setattr(jobmart, "read_json", lambda *a, **k: scans.append(1) or scan(*a, **k))
    ids = lambda: sorted(int(r.JOB_ID) for r in read_parquet(spark, dst).collect())
    if kept is None:
        with pytest.raises(jobmart.TooManyErrors):
            build_job_mart(spark, src, dst, "START_TIME", mode=mode, max_errors=max_errors)
        assert ids() == [8, 9]
    else:
        run = build_job_mart(spark, src, dst, "START_TIME", mode=mode, max_errors=max_errors)
        assert (run.read, run.bad, run.written) == (4, 2, 2)
        assert ids() == {"append": [1, 2, 8, 9], "overwrite": [1, 2, 8], "replace": [1, 2]}[mode]
    assert len(scans) == 2  # a look for a first record, and the one pass


# Catalog


def test_a_table_follows_what_is_published(spark, db, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(spark.range(3), path)
    discover_table(spark, db, "t", path, "parquet")
    for n in (4, 5):
        write_parquet(spark.range(n), path)
        assert discover_table(spark, db, "t", path, "parquet") == []
        assert read_table(spark, db, "t").count() == n
    keyed = str(tmp_path / "k")
    day = lambda *days: spark.createDataFrame([(d, d) for d in days], "i int, day int")
    day(1, 2).write.partitionBy("day").parquet(keyed)  # not published yet
    discover_table(spark, db, "k", keyed, "parquet")
    for days in ((2, 3), (4,)):
        write_partitioned(day(*days), keyed, ["day"], mode="replace")
        discover_table(spark, db, "k", keyed, "parquet")
        assert sorted(r.day for r in read_table(spark, db, "k").collect()) == list(days)
        assert spark.sql(f"show partitions {db}.k").count() == len(days)


@pytest.mark.parametrize("statement", ["DROP TABLE `", "ALTER TABLE .* RENAME", "SET TBLPROPERTIES", "CREATE"])
def test_a_record_that_is_exchanged_is_never_lost(spark, db, tmp_path, monkeypatch, statement):
    import re

    path = str(tmp_path / "t")
    spark.range(3).selectExpr("id", "id as gone").write.parquet(path)
    register_table(spark, db, "t", path, "parquet")
    spark.sql(f"ALTER TABLE {db}.t SET TBLPROPERTIES ('steward' = 'me')")
    spark.range(4).write.mode("overwrite").parquet(path)
    sql, create = type(spark).sql, type(spark.catalog).createTable
    with monkeypatch.context() as patch:
        fail = lambda text: text.startswith("DROP TABLE IF") is False and re.search(statement, text)

        def cut(self, text, *args, **kwargs):
            if fail(text):
                raise Killed
            return sql(self, text, *args, **kwargs)

        patch.setattr(type(spark), "sql", cut)
        if statement == "CREATE":
            patch.setattr(type(spark.catalog), "createTable", lambda *a, **k: (_ for _ in ()).throw(Killed))
        with pytest.raises(Killed):
            sync_schema(spark, db, "t")
    assert create is type(spark.catalog).createTable
    assert read_table(spark, db, "t").count() == 4
    sync_schema(spark, db, "t")
    assert read_table(spark, db, "t").columns == ["id"]
    assert [r.tableName for r in spark.sql(f"SHOW TABLES IN {db}").collect()] == ["t"]
    assert spark.sql(f"SHOW TBLPROPERTIES {db}.t").filter("key = 'steward'").count() == 1


# Directories


KEYS = ["value", "line", "text", "_corrupt", "Value", "a.b", "a b", "path", "content", "length", "id", "__row"]


@pytest.mark.parametrize("key", KEYS)
def test_any_directory_key_survives_scan_and_landing(spark, lines, tmp_path, key):
    raw = tmp_path / "raw"
    raw.mkdir()
    for v in ("007", "x"):
        lines(f"raw/{key}={v}", "a.json.gz", '{"i": "1"}', '{"i": "2"}')
    want = sorted((i, v) for i in "12" for v in ("007", "x"))
    pairs = lambda df: sorted((r["i"], str(r[key])) for r in df.collect())
    for limit in (None, 0):
        assert pairs(read_json(spark, str(raw), "i string", rechunk_over=limit)) == want
    assert pairs(read_json(spark, str(raw), exclude=["_part*"])) == want
    land(spark, str(raw), str(tmp_path / "landed"), "json")
    assert pairs(read_json(spark, str(tmp_path / "landed"), "i string")) == want


def test_empty_values_stay_empty_and_missing_ones_missing(spark, lines, tmp_path):
    src = lines("src", "a.csv", "a,b,c", '"",,x', ',"",""')
    land(spark, src, str(tmp_path / "raw"), "csv")
    landed = "".join(p.read_text() for p in Path(current(spark, str(tmp_path / "raw"))).glob("*.csv"))
    assert sorted(landed.split()) == sorted(["a,b,c", '"",,x', ',"",""'])
    assert read_csv(spark, str(tmp_path / "raw"), inferSchema=False).count() == 2


def test_excluded_files_leave_an_empty_schema(spark, lines):
    src = lines("src", "_skip.json", '{"a": 1}')
    lines("src", "skip1.json", '{"a": 1}')
    assert read_json(spark, src, exclude=["skip*"]).columns == []
