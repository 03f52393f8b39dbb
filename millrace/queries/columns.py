"""Flattening, renaming, cleaning, casting and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.cleaning import strip_quotes
from millrace.operators.dates import add_date_parts
from millrace.operators.filters import filter_in
from millrace.operators.flatten import flatten, relationalize, strip_name
from millrace.operators.mapping import apply_mapping
from millrace.queries.registry import derived, plain_names, query, table, time_text, wall_clock
from millrace.sources.files import read_json

NESTED_DOCUMENTS = """
    doc_id long,
    doc struct<lang: string, source: string>,
    lines array<struct<text: string, words: array<string>>>
"""


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gzip JSON: a struct, and an array of lines that hold arrays of words."""

    def write(path: str) -> None:
        lines = F.transform(
            F.split("text", "\n"), lambda line: F.struct(line.alias("text"), F.split(line, " ").alias("words"))
        )
        documents = table(spark, sf_dir, "documents")
        nested = documents.select("doc_id", F.struct("lang", "source").alias("doc"), lines.alias("lines"))
        nested.write.option("compression", "gzip").json(path)

    path = derived(spark, sf_dir, "documents-json", write)
    return read_json(spark, path, NESTED_DOCUMENTS)


@query("flatten_struct", """
    SELECT c_custkey, c_name AS customer__name, c_acctbal AS customer__acctbal,
           n_name AS customer__nation__name, r_name AS customer__nation__region__name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    area = F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region"))
    nested = F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), area.alias("nation"))
    return plain_names(flatten(joined.select("c_custkey", nested.alias("customer"))))


@query("relationalize_root", "SELECT doc_id, lang AS doc__lang, source AS doc__source, doc_id AS lines FROM documents")
def relationalize_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = relationalize(nested_documents(spark, sf_dir), "documents", ["doc_id"])
    return plain_names(tables["documents"])


@query("relationalize_child", """
    SELECT doc_id AS id, (line_no - 1)::INT AS index, line AS lines__val__text,
           doc_id AS words_id, (line_no - 1)::INT AS words_index
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
""")
def relationalize_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = relationalize(nested_documents(spark, sf_dir), "documents", ["doc_id"])["documents_lines"]
    words = F.col("`lines.val.words`")
    lines = lines.select(
        "id", "index", "`lines.val.text`", words["id"].alias("words_id"), words["index"].alias("words_index")
    )
    return plain_names(lines)


@query("relationalize_grandchild", """
    SELECT doc_id AS line_doc, (line_no - 1)::INT AS line_index, (word_no - 1)::INT AS index, word
    FROM (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word,
                 generate_subscripts(string_split(line, ' '), 1) AS word_no
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                       generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))
""")
def relationalize_grandchild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays inside arrays: each word points to its line, each line to its document."""
    tables = relationalize(nested_documents(spark, sf_dir), "documents", ["doc_id"])
    return tables["documents_lines.val.words"].select(
        F.col("id.id").alias("line_doc"),
        F.col("id.index").alias("line_index"),
        "index",
        F.col("`lines.val.words.val`").alias("word"),
    )


@query("relationalize_rejoined", """
    SELECT doc_id, lang, (line_no - 1)::INT AS index, line AS text
    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
""")
def relationalize_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a key are numbered; root and child meet again on that number."""
    tables = relationalize(nested_documents(spark, sf_dir), "documents")
    root, lines = tables["documents"], tables["documents_lines"]
    rejoined = root.withColumnRenamed("lines", "lines_id").join(lines, F.col("lines_id") == lines["id"])
    return rejoined.select(
        "doc_id", F.col("`doc.lang`").alias("lang"), "index", F.col("`lines.val.text`").alias("text")
    )


@query("rename_strip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def rename_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    body = F.struct("o_orderkey", "o_orderstatus", "o_totalprice").alias("jsonBody")
    return strip_name(flatten(orders.select(body)), "jsonBody.")


@query("strip_quotes", """
    SELECT doc_id::VARCHAR AS doc_id, replace(text, '"', '') AS text, lang AS doc__lang, source AS doc__source
    FROM documents
""")
def strip_quotes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    quoted_lang = F.concat(F.lit('"'), "lang", F.lit('"')).alias("doc.lang")
    rows = documents.select("doc_id", "text", quoted_lang, F.col("source").alias("doc.source"))
    return plain_names(strip_quotes(rows))


MAPPING = [
    ("l_orderkey", "string", "order_id", "decimal(15,0)"),
    ("l_linenumber", "string", "line_number", "decimal(10,0)"),
    ("l_quantity", "string", "quantity", "decimal(19,4)"),
    ("l_discount", "double", "discount", "double"),
    ("l_returnflag", "string", "flag", "string"),
    ("l_shipdate", "string", "shipped", "timestamp"),
    ("l_comment", "string", "comment", "string"),
]


@query("apply_mapping", """
    SELECT CAST(l_orderkey AS DECIMAL(15,0)) AS order_id, CAST(l_linenumber AS DECIMAL(10,0)) AS line_number,
           CAST(l_quantity AS DECIMAL(19,4)) AS quantity, l_discount AS discount, l_returnflag AS flag,
           l_shipdate AS shipped, NULL::VARCHAR AS comment
    FROM lineitem
""")
def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns to types; one mapped column is missing, others are not mapped."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", time_text("l_shipdate"))
    texts = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    lineitem = lineitem.withColumns({c: F.col(c).cast("string") for c in texts})
    return wall_clock(apply_mapping(lineitem, MAPPING), "shipped")


@query("apply_mapping_strict", """
    SELECT o_orderkey AS id, o_totalprice::DECIMAL(19,4) AS price, o_orderstatus AS status, o_orderdate AS day
    FROM orders
""")
def mapping_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated source types are checked against the table before anything runs."""
    stated = [
        ("o_orderkey", "bigint", "id", "bigint"),
        ("o_totalprice", "double", "price", "decimal(19,4)"),
        ("o_orderstatus", "string", "status", "string"),
        ("o_orderdate", "timestamp_ntz", "day", "timestamp_ntz"),
    ]
    return apply_mapping(table(spark, sf_dir, "orders"), stated, strict=True)


@query("cast_timestamp", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL
                            WHEN o_orderstatus = 'P' THEN date_trunc('day', o_orderdate)
                            ELSE o_orderdate + INTERVAL 250 MILLISECOND END AS ordered
    FROM orders
""")
def cast_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text: unusable, without a time of day, or with fractions of a second."""
    day = time_text("o_orderdate", "yyyy-MM-dd")
    full = F.concat(time_text("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(".25"))
    status = F.col("o_orderstatus")
    text = F.when(status == "F", F.concat(F.lit("on "), day)).when(status == "P", day).otherwise(full)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    typed = apply_mapping(
        orders, [("o_orderkey", "long", "o_orderkey", "long"), ("text", "string", "ordered", "timestamp")]
    )
    return wall_clock(typed, "ordered")


DECIMALS = {"d10": "decimal(10,0)", "d13": "decimal(13,0)", "d15": "decimal(15,0)", "d19": "decimal(19,4)"}


@query("cast_decimal", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           TRY_CAST(text AS DECIMAL(10,0)) AS d10, TRY_CAST(text AS DECIMAL(13,0)) AS d13,
           TRY_CAST(text AS DECIMAL(15,0)) AS d15, TRY_CAST(text AS DECIMAL(19,4)) AS d19
    FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN concat(l_quantity::INT, 'x')
                                      WHEN 'A' THEN concat(' ', l_orderkey, l_quantity::INT, '00000.5 ')
                                      ELSE concat('-', l_quantity::INT, '.50005') END AS text FROM lineitem)
""")
def cast_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text: unusable, padded and at times too large, or negative and to be rounded."""
    quantity, flag = F.col("l_quantity").cast("int"), F.col("l_returnflag")
    text = (
        F.when(flag == "R", F.concat(quantity, F.lit("x")))
        .when(flag == "A", F.concat(F.lit(" "), "l_orderkey", quantity, F.lit("00000.5 ")))
        .otherwise(F.concat(F.lit("-"), quantity, F.lit(".50005")))
    )
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lineitem = table(spark, sf_dir, "lineitem").select(*keys, text.alias("text"))
    kept = [(k, t, k, t) for k, t in lineitem.drop("text").dtypes]
    return apply_mapping(lineitem, kept + [("text", "string", name, type_) for name, type_ in DECIMALS.items()])


@query("date_parts", """
    SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events
""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_date_parts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@query("filter_in", """
    SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def filter_by_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return filter_in(customer, "c_mktsegment", ["BUILDING", "MACHINERY"])
