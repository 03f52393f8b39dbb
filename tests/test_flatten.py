import pytest
from pyspark.sql import functions as F

from millrace import absorb, flatten, relationalize, strip_name
from millrace.sources.files import read_json

NESTED = """
    id long, who struct<name: string, at: struct<city: string>>,
    tags array<string>, items array<struct<sku: string, parts: array<struct<n: int>>>>
"""


@pytest.fixture
def nested(spark, lines):
    path = lines(
        "nested",
        "a.json.gz",
        '{"id": 1, "who": {"name": "ann", "at": {"city": "x"}}, "tags": ["p", "q"],'
        ' "items": [{"sku": "s1", "parts": [{"n": 1}, {"n": 2}]}, {"sku": "s2", "parts": []}]}',
        '{"id": 2, "who": null, "tags": [], "items": [{"sku": "s3"}, null]}',
        '{"id": 3, "who": {"name": "cy", "at": null}}',
    )
    return read_json(spark, path, NESTED)


def test_flatten_structs(nested):
    flat = flatten(nested)
    assert flat.columns == ["id", "who.name", "who.at.city", "tags", "items"]
    assert [r[1:3] for r in flat.orderBy("id").collect()] == [("ann", "x"), (None, None), ("cy", None)]


def test_flatten_other_separator_and_collision(spark):
    df = spark.sql("select named_struct('b', 1) as a, 2 as `a.b`")
    assert flatten(df, "__").columns == ["a__b", "a.b"]
    with pytest.raises(ValueError, match="same name"):
        flatten(df)


def test_flatten_name_with_dot_inside_struct(spark):
    df = spark.sql("select named_struct('x.y', 7, 'z', 8) as `p.q`")
    flat = flatten(df)
    assert flat.columns == ["p.q.x.y", "p.q.z"]
    assert tuple(flat.first()) == (7, 8)


@pytest.mark.parametrize("key_cols", [["id"], ["id", "who.name"], None])
def test_relationalize_conserves_elements(nested, tmp_path, key_cols):
    if key_cols and len(key_cols) > 1:
        nested = nested.withColumn("who", F.coalesce("who", F.expr("named_struct('name','-','at',null)")))
    tables = relationalize(nested, "r", key_cols, str(tmp_path / "staging"))
    assert set(tables) == {"r", "r_tags", "r_items", "r_items.val.parts"}
    assert tables["r"].count() == 3
    assert tables["r_tags"].count() == 2
    assert tables["r_items"].count() == 4
    assert tables["r_items.val.parts"].count() == 2
    assert tables["r_items"].columns == ["id", "index", "items.val.sku", "items.val.parts"]


def test_relationalize_keys_join_back(nested, tmp_path):
    tables = relationalize(nested, "r", staging=str(tmp_path / "staging"))
    root, items, parts = tables["r"], tables["r_items"], tables["r_items.val.parts"]
    joined = root.select("id", F.col("items").alias("key")).join(
        items.select(F.col("id").alias("key"), "index", "`items.val.sku`"), "key"
    )
    got = sorted((r["id"], r["index"], r["items.val.sku"]) for r in joined.collect())
    assert got[:3] == [(1, 0, "s1"), (1, 1, "s2"), (2, 0, "s3")] and got[3][2] is None
    deep = items.join(parts, items["`items.val.parts`"] == parts["id"])
    deep = deep.select("`items.val.sku`", "`items.val.parts.val.n`")
    assert sorted(map(tuple, deep.collect())) == [("s1", 1), ("s1", 2)]


def test_relationalize_null_and_empty_arrays(nested):
    root = relationalize(nested, "r", ["id"])["r"].orderBy("id").collect()
    assert [(r["tags"], r["items"]) for r in root] == [(1, 1), (2, 2), (None, None)]


def test_strip_name_every_occurrence(spark):
    df = spark.sql("select 1 as `jsonBody.a`, 2 as `x.jsonBody.jsonBody.b`, 3 as c")
    assert strip_name(df, "jsonBody.").columns == ["a", "x.b", "c"]


def test_strip_name_collision(spark):
    df = spark.sql("select * from values (1, 2), (null, 4) as t(`jsonBody.a`, a)")
    with pytest.raises(ValueError, match="same name"):
        strip_name(df, "jsonBody.")


def test_absorb_takes_the_first_value_at_hand(spark):
    df = spark.sql("""
        select * from values
            (named_struct('a', 'in', 'b', null, 'c', 'c'), 'out', 'b', 1),
            (null, 'x', null, 2),
            (named_struct('a', 'y', 'b', 'z', 'c', null), null, null, 3),
            (null, null, null, 4)
        as t(body, a, b, other)
    """)
    out = absorb(df, "body").orderBy("other").collect()
    assert [r.body and tuple(r.body) for r in out] == [("in", "b", "c"), ("x", None, None), ("y", "z", None), None]
    assert absorb(df.select("body", "other"), "body").columns == ["body", "other"]
