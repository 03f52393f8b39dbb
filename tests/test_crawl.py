"""Folders below a prefix as tables, and discovery that looks at new files only."""

import pytest

from millrace import add_partitions, append_partitions, crawl, discover_new, read_table, register_table, write_parquet
from millrace.sources import crawl as crawling
from millrace.sources.catalog import is_deprecated
from millrace.sources.crawl import folders_below, merged_type
from pyspark.sql.types import DataType


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


@pytest.fixture
def prefix(spark, tmp_path, lines):
    base = tmp_path / "data"
    frame(spark, "a int, b string", (1, "x")).write.parquet(str(base / "one"))
    frame(spark, "a int, k string", (1, "x"), (2, "y")).write.partitionBy("k").json(str(base / "keyed"), compression="gzip")
    for day in ("d1", "d2"):
        frame(spark, "a int, b string, c double", (1, "x", 0.5)).write.csv(str(base / "daily" / day), header=True)
    frame(spark, "a int", (1,)).write.parquet(str(base / "group" / "left"))
    frame(spark, "z string, y string", ("1", "2")).write.parquet(str(base / "group" / "right"))
    frame(spark, "a int", (1,)).write.parquet(str(base / "deep" / "er" / "one"))
    write_parquet(frame(spark, "a int", (1,), (2,)), str(base / "published"))
    (base / "_hidden").mkdir()
    (base / "empty").mkdir()
    (base / "notes").mkdir()
    (base / "notes" / "readme.txt").write_text("no table")
    return str(base)


def test_folders_become_the_right_tables(spark, db, prefix):
    found = {t.table: t for t in crawl(spark, db, prefix)}
    assert sorted(found) == ["daily", "er_one", "keyed", "left", "one", "published", "right"]
    count = {t: read_table(spark, db, t).count() for t in found}
    assert count["daily"] == 2 and count["keyed"] == 2 and count["published"] == 2 and count["one"] == 1
    assert read_table(spark, db, "keyed").columns == ["a", "k"] and found["keyed"].fmt == "json"
    assert spark.sql(f"SHOW PARTITIONS {db}.keyed").count() == 2
    assert all(t.changes == [] for t in crawl(spark, db, prefix))


def test_a_crawl_follows_the_folders(spark, db, prefix):
    import shutil

    crawl(spark, db, prefix)
    write_parquet(frame(spark, "a int, n string", (1, "n")), f"{prefix}/published")
    frame(spark, "a int, b string, more int", (2, "y", 3)).write.mode("append").parquet(f"{prefix}/one")
    shutil.rmtree(f"{prefix}/group/left")
    found = {t.table: [(c.column, c.change) for c in t.changes] for t in crawl(spark, db, prefix)}
    assert found["published"] == [("n", "added")] and found["one"] == [("more", "added")] and "left" not in found
    assert is_deprecated(spark, db, "left") and not is_deprecated(spark, db, "right")
    assert sorted((r.a, r.more) for r in read_table(spark, db, "one").collect()) == [(1, None), (2, 3)]
    assert [tuple(r) for r in read_table(spark, db, "published").collect()] == [(1, "n")]


def test_an_unchanged_folder_costs_a_listing(spark, db, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame(spark, "a int", (1,)).write.parquet(path)
    assert [c.column for c in discover_new(spark, db, "t", path, "parquet")] == ["a"]
    with monkeypatch.context() as patch:
        patch.setattr(crawling, "discover_table", lambda *a, **k: pytest.fail("all files were looked at"))
        assert discover_new(spark, db, "t", path, "parquet") == []
        for ddl, row, want in (
            ("a int, b array<struct<x:int>>", (2, [(1,)]), [("b", "added")]),
            ("a int", (3,), []),
        ):
            frame(spark, ddl, row).write.mode("append").parquet(path)
            assert [(c.column, c.change) for c in discover_new(spark, db, "t", path, "parquet")] == want
    assert read_table(spark, db, "t").count() == 3
    # A file that changed, and one that is gone, are reasons to look at all.
    frame(spark, "c int", (1,)).write.mode("overwrite").parquet(path)
    assert sorted((c.column, c.change) for c in discover_new(spark, db, "t", path, "parquet")) == [
        ("a", "removed"), ("b", "removed"), ("c", "added"),
    ]
    assert read_table(spark, db, "t").columns == ["c"]


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_new_files_give_the_schema_that_all_give(spark, db, tmp_path, fmt):
    from millrace.sources.catalog import discover_schema

    path = str(tmp_path / "t")
    deliveries = [
        ("a int, s struct<x:int>", (1, (1,))), ("a int, s struct<x:int,y:string>, n double", (2, (1, "y"), 0.5)), ("a int", (3,)),
    ]
    for i, (ddl, row) in enumerate(deliveries):
        df = frame(spark, ddl, row)
        df = df.drop("s") if fmt == "csv" else df
        df.write.mode("append").options(header=True).format(fmt).save(path)
        if fmt == "csv" and i:
            break  # files with other headers are no table
        discover_new(spark, db, "t", path, fmt)
        assert set(read_table(spark, db, "t").dtypes) == {(f.name, f.dataType.simpleString()) for f in discover_schema(spark, path, fmt)}


def test_merged_types():
    of = DataType.fromDDL
    for a, b, want in (
        ("int", "bigint", "bigint"), ("int", "double", "double"), ("int", "string", "string"), ("date", "int", "string"),
        ("array<int>", "array<double>", "array<double>"), ("struct<a:int>", "struct<A:string,b:int>", "struct<a:string,b:int>"),
    ):
        assert merged_type(of(a), of(b)).simpleString() == want


def test_partitions_from_what_a_write_reports(spark, db, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    odd = "a b/c=d%'x"
    rows = lambda *days: frame(spark, "i int, day int, name string", *[(d, d, odd if d % 2 else None) for d in days])
    first = append_partitions(rows(1, 2), path, ["day", "name"], "first")
    assert len(first) == 2 and append_partitions(rows(1, 2), path, ["day", "name"], "first") == []
    register_table(spark, db, "t", path, "parquet")
    sql, seen = type(spark).sql, []
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (seen.append(text), sql(self, text, *a, **k))[1])
    later = append_partitions(rows(2, 3, 5), path, ["day", "name"])
    df = add_partitions(spark, db, "t", later)
    assert not any("MSCK" in text for text in seen)
    assert sorted((r.i, r.day, r.name) for r in df.collect()) == [(1, 1, odd), (2, 2, None), (2, 2, None), (3, 3, odd), (5, 5, odd)]
    add_partitions(spark, db, "t", [])


def test_folders_below(spark, prefix):
    found = {f.path.rpartition("/data/")[2]: (f.fmt, f.keys) for f in folders_below(spark, prefix)}
    assert found["keyed"] == ("json", ("k",)) and found["published"] == ("parquet", ()) and "empty" not in found and "notes" not in found
