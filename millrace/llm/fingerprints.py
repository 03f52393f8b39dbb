"""Document fingerprints as Merkle trees; DataFrame functions only.

A text is cut at line feeds into paragraphs, a paragraph into pieces of a sentence, at most ``PIECE`` characters long.
The leaves are hashes of the pieces, a paragraph's node hashes its leaves, a section's node hashes ``FANOUT`` paragraphs, and
the root hashes the sections. A fingerprint is ``root:sections:paragraphs`` as text: 32 hex digits, 16 for each
section, and the leaves, 8 digits each, with a comma after each paragraph but the last. Equal texts, and only they (but
for hash collisions), have equal roots. Where roots differ, sections that differ lead to the paragraphs that do.

The likeness of two fingerprints is twice the number of distinct leaves they share over the number they have, 1 for equal
roots. A null text is an empty one: one paragraph without leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

PIECE = 24  # characters
FANOUT = 8  # paragraphs in a section
BUCKET_ROWS = 500  # documents that are ordered together, at least
MOST_BUCKETS = 200_000

_PIECES = rf"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text."""

    def paragraph(line: Column) -> Column:
        pieces = F.regexp_extract_all(line, F.lit(_PIECES), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.substring(F.md5(p.cast("binary")), 1, 8)), "")

    def tree(paragraphs: Column) -> Column:
        nodes = F.transform(paragraphs, lambda p: F.md5(p.cast("binary")))
        count = F.ceil(F.size(paragraphs) / F.lit(FANOUT)).cast("int")

        def section(nodes: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), count - 1),
                lambda i: F.md5(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "").cast("binary")),
            )

        def written(sections: Column) -> Column:
            root = F.md5(F.array_join(sections, "").cast("binary"))
            short = F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 16)), "")
            return F.concat_ws(":", root, short, F.array_join(paragraphs, ","))

        bind = lambda value, use: F.transform(F.array(value), use)[0]
        return bind(nodes, lambda n: bind(section(n), written))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(F.array(F.transform(lines, paragraph)), tree)[0]


def leaves(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.element_at(F.split(print_, ":"), 3), F.lit("[0-9a-f]{8}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, of two fingerprints."""

    def compare(both: Column) -> Column:
        total = F.size(both["a"]) + F.size(both["b"])
        return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(both["a"], both["b"])) / total)

    leafy = F.array(F.struct(leaves(a).alias("a"), leaves(b).alias("b")))
    return F.when(a == b, 1.0).otherwise(F.transform(leafy, compare)[0])


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Paragraphs, from 0, in which two fingerprints differ; sections that agree are not looked into."""

    def differ(x: Column) -> Column:
        longest = F.greatest(F.size(x["pa"]), F.size(x["pb"]))
        section = lambda s, i: F.substring(s, F.floor(i / F.lit(FANOUT)).cast("int") * 16 + 1, 16)
        return F.filter(
            F.sequence(F.lit(0), longest - 1),
            lambda i: (section(x["sa"], i) != section(x["sb"], i)) & ~F.get(x["pa"], i).eqNullSafe(F.get(x["pb"], i)),
        )

    part = lambda p, i: F.element_at(F.split(p, ":"), i)
    parts = F.struct(
        part(a, 2).alias("sa"),
        part(b, 2).alias("sb"),
        F.split(part(a, 3), ",", -1).alias("pa"),
        F.split(part(b, 3), ",", -1).alias("pb"),
    )
    return F.transform(F.array(parts), differ)[0]


def _after(a: Column, b: Column) -> Column:
    """Whether place ``a`` in the order comes after ``b``: ``unnamed`` last, then ``down``, then ``h`` ascending."""
    down = ~a["unnamed"] & ~b["unnamed"]
    return (
        (a["unnamed"] & ~b["unnamed"])
        | (down & (a["down"] > b["down"]))
        | ((a["unnamed"] == b["unnamed"]) & (a["down"] == b["down"]) & (a["h"] > b["h"]))
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, text, next_text``: each document with the one after it by descending id; the first follows the last.

    Rows of one id follow one another by a hash of their texts; rows without an id come last. Ids are whole numbers. Spark
    samples ids and hashes to cut their order into ranges of like size, however ids are spread and repeated; the ranges'
    first places, ``MOST_BUCKETS`` at most, go to all tasks. The first row of each range is also sent to the range before it,
    so the texts are shuffled once. Rows that agree in id and text always share a range.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"with_next: {id_col} is {docs.schema[id_col].dataType.simpleString()}, ids are whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The complement falls as the id rises, for all long numbers.
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    place = F.struct(F.isnull("doc_id").alias("unnamed"), down.alias("down"), F.xxhash64("text").alias("h"))
    rows = rows.select("doc_id", "text", place.alias("place"))
    places = rows.select("place.*")
    buckets = max(1, min(MOST_BUCKETS, places.count() // bucket_rows))
    ranged = places.repartitionByRange(buckets, "unnamed", "down", "h").withColumn("part", F.spark_partition_id())
    first = ranged.groupBy("part").agg(F.min(F.struct("unnamed", "down", "h")).alias("first"))
    firsts = first.agg(F.array_sort(F.collect_list("first")).alias("firsts")).withColumn("all", F.lit(0))
    marked = rows.withColumn("all", F.lit(0)).join(F.broadcast(firsts), "all")
    # The last range whose first place is not after the row's, by halving.
    n = F.size("firsts")
    halve = lambda at, width: F.when(
        (at + width < n) & ~_after(F.get(F.col("firsts"), at + width), F.col("place")), at + width
    ).otherwise(at)
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_BUCKETS.bit_length()))])
    bucket = F.aggregate(widths, F.lit(0), halve)
    marked = marked.select("doc_id", "text", "place", bucket.alias("bucket"), n.alias("n"), "firsts")
    is_first = F.get(F.col("firsts"), F.col("bucket")) == F.col("place")
    marked = marked.select("doc_id", "text", "place", "bucket", "n", is_first.alias("is_first"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") - 1, F.col("n")).alias("bucket"), F.lit(True).alias("guest"))
    placed = marked.select(
        "doc_id", "text", "place", F.explode(F.when(F.col("is_first"), F.array(own, guest)).otherwise(F.array(own))).alias("to")
    ).select("doc_id", "text", "place.*", "to.bucket", "to.guest")
    after = F.lead("text").over(W.partitionBy("bucket").orderBy("guest", "unnamed", "down", "h"))
    return placed.withColumn("next_text", after).where("not guest").select("doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last third of characters replaced by as many from the start of the next document;
    ``edited_paragraphs`` are where the descent into differing sections ends.
    """
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr(
        "substring(next_text, 1, cast(floor(length(text) / 3) as int))"
    ))
    rows = with_next(docs, id_col, text_col).select("doc_id", n.cast("long").alias("n_chars"), third.alias("k"), "text", edited.alias("edited"), "next_text")
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        changed_paragraphs(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edited_paragraphs"),
    )
