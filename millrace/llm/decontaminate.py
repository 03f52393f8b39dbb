"""Benchmark passages in documents, by SimHash of item-sized windows; DataFrame functions only.

Words are runs of letters and digits, in lower case; a shingle is ``SHINGLE`` of them. An item of n words is compared with
windows of n words. A window that is alike enough shares a certain number of shingles with the item, in any
order. Shingles of items are therefore found first, and windows laid at every start from which a window holds that many
of them. Equal windows are folded into one. Among windows that are equally alike, one that holds a shared shingle where
the item has it (moved inwards at the ends of the document) comes first, and then the foremost.

Each window and each item gets a SimHash, the bitwise majority over its shingles, which count as often as they
occur. The 64 bits are cut into ``RADIUS + 1`` blocks: fingerprints that differ in at most ``RADIUS`` bits agree in a
whole block, so the join on (size, block number, block) finds all of them. The pairs within the radius are then
verified: weighted Jaccard similarity of the shingles, at least ``LIKENESS``. At a similarity of 0.8 fingerprints differ
in 9.7 bits on average with a deviation of 2.9, so the radius misses about one such pair in two thousand,
and hardly any above 0.85.

Items with fewer words than a shingle, null and empty items are not searched for. Null and empty documents hold nothing.
Documents are named by id and a hash of the text, so ids may be null or repeated; repeated rows give one row for each
item they hold. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LIKENESS = 0.8
RADIUS = 19
BROADCAST_ROWS = 1_000_000  # of a few dozen bytes each; above that the join shuffles


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(text: Column, size: int) -> Column:
    """The hashes of all runs of ``size`` words, by place."""

    def hashed(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(words) - size + 1)
        return F.when(
            F.size(words) >= size, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, size)))
        ).otherwise(F.array().cast("array<bigint>"))

    # The lambda binds the words once; otherwise every place would split the text anew.
    return F.transform(F.array(_words(text)), hashed)[0]


_LANE = 21  # bits of a counter, three to a number: enough for bags of two million shingles


def simhash(shingles: Column) -> Column:
    """64 bits, each the majority of that bit over the shingles.

    Three bits of all shingles are counted by one sum: bits ``k``, ``k + 21`` and ``k + 42`` are the lowest of three
    lanes once a hash is shifted by ``k``. The bit that is left over has a sum of its own.
    """
    mask = 1 | 1 << _LANE | 1 << 2 * _LANE

    def lanes(k: Column) -> Column:
        return F.aggregate(
            shingles,
            F.lit(0).cast("long"),
            lambda acc, h: acc + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(mask)),
        )

    def majority(sums: Column) -> Column:
        def bit(b: Column) -> Column:
            lane = F.call_function("shiftrightunsigned", F.get(sums, b % _LANE), F.floor(b / F.lit(_LANE)).cast("int") * _LANE)
            return F.when(lane.bitwiseAND(F.lit((1 << _LANE) - 1)) * 2 > F.size(shingles), F.lit(1)).otherwise(F.lit(0)).cast("long")

        return F.transform(F.sequence(F.lit(0), F.lit(3 * _LANE - 1)), bit)

    top = F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, 63))
    top = F.array(F.when(top * 2 > F.size(shingles), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    bits = F.transform(F.array(F.transform(F.sequence(F.lit(0), F.lit(_LANE - 1)), lanes)), majority)[0]
    # The bits from the lowest to the highest, folded from the highest.
    return F.aggregate(F.reverse(F.concat(bits, top)), F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """Number and value of each of ``radius + 1`` blocks."""
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("number"),
                F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(bounds, bounds[1:]))
        ]
    )


def likeness(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of shingles.

    Shingles that either bag has count once by an intersection of sets; only what occurs again, if anything does, is
    counted one by one.
    """

    def again(bag: Column) -> Column:
        """Every occurrence but the first of each shingle."""
        ordered = F.array_sort(bag)
        repeats = F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))[0]
        return F.when(F.size(F.array_distinct(bag)) < F.size(bag), repeats).otherwise(F.array().cast("array<bigint>"))

    def times(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    def counted(more: Column) -> Column:
        both = F.array_intersect(more["a"], more["b"])
        return F.aggregate(both, F.lit(0), lambda acc, x: acc + F.least(times(more["a"], x), times(more["b"], x)))

    more = F.array(F.struct(again(a).alias("a"), again(b).alias("b")))
    shared = F.size(F.array_intersect(a, b)) + F.transform(more, counted)[0]
    return F.transform(F.array(shared), lambda n: n / (F.size(a) + F.size(b) - n))[0]


def _needed(n: Column, held: Column, least: float) -> Column:
    """How many of the ``n`` shingles of an item a window of ``held`` shingles shares at least, to be alike enough."""
    return F.greatest(F.lit(1), F.ceil((n + held) * F.lit(least / (1 + least)) - F.lit(1e-9)).cast("int"))


def _starts(n: Column, places: Column, total: Column, least: float) -> Column:
    """Every start from which ``n`` of ``total`` shingles hold enough of ``places``, which ascend; each start once."""
    needed, last = _needed(n, F.least(n, total), least), F.greatest(total - n, F.lit(0))

    def run(i: Column) -> Column:
        # Windows with the i-th place and those behind it, without the windows that the place before has as well.
        low = F.greatest(F.get(places, i + needed - 1) - n + 1, F.lit(0))
        low = F.greatest(low, F.least(F.coalesce(F.get(places, i - 1), F.lit(-1)), last) + 1)
        high = F.least(F.get(places, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    firsts = F.sequence(F.lit(0), F.size(places) - needed)
    return F.when(F.size(places) >= needed, F.flatten(F.transform(firsts, run))).otherwise(F.array().cast("array<int>"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    size: int = SHINGLE,
    least: float = LIKENESS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, h, item_id, start, n_words, likeness``: the best window of each item in each document.

    ``h`` is the hash of the text, ``start`` the first word of the window, from 0.
    """
    if not 0 <= radius < 64:
        raise ValueError("a radius is from 0 to 63 bits")
    known = items.select("item_id", _shingles(F.col("text"), size).alias("own")).where(F.size("own") > 0)
    known = known.select("item_id", "own", F.size("own").alias("n"), simhash(F.col("own")).alias("print"))
    seeds = known.select("n", F.explode("own").alias("shingle")).distinct()
    n_seeds = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # with repeats: what the items' bags hold

    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    spread = named.select("doc_id", "h", F.posexplode(_shingles(F.col("text"), size)).alias("place", "shingle"))
    hits = spread.join(_bounded(seeds, n_seeds), "shingle")
    places = hits.groupBy(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), "n").agg(
        F.sort_array(F.collect_set("place")).alias("places")
    )
    # The shortest window that can be alike enough has n * least shingles, all of them shared.
    places = places.where(F.size("places") >= F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)))
    places = places.groupBy("of_doc", "of_h").agg(F.collect_list(F.struct("n", "places")).alias("sizes"))

    # The shingles of a window are a part of those of its document.
    same = F.col("of_doc").eqNullSafe(F.col("doc_id")) & (F.col("of_h") == F.col("h"))
    held = named.join(places, same).select("doc_id", "h", "sizes", _shingles(F.col("text"), size).alias("own"))
    held = held.distinct().select("doc_id", "h", "own", F.explode("sizes").alias("w")).select("doc_id", "h", "own", "w.*")
    held = held.select("doc_id", "h", "own", "n", F.explode(_starts(F.col("n"), F.col("places"), F.size("own"), least)).alias("start"))
    held = held.select(
        "doc_id",
        "h",
        "start",
        "n",
        F.expr("slice(own, start + 1, n)").alias("bag"),
    )

    # One fingerprint for all equal windows.
    bags = held.groupBy("n", "bag").agg(F.count("*").alias("times")).select("n", "bag", simhash(F.col("bag")).alias("print"))
    block = lambda df, *more: df.select(*more, "n", "print", F.explode(_blocks(F.col("print"), radius)).alias("block"))
    of_items = block(known.select("item_id", "n", "print"), "item_id").withColumnRenamed("print", "item_print")
    near = (
        block(bags, "bag")
        .join(_bounded(of_items, n_seeds * (radius + 1)), ["n", "block"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("bag", "n", "item_id")
        .distinct()
    )
    alike = near.join(_bounded(known.select("item_id", "own"), n_seeds), "item_id")
    alike = alike.withColumn("likeness", likeness(F.col("own"), F.col("bag"))).where(F.col("likeness") >= least)
    found = held.join(alike.select("bag", "n", "item_id", "likeness"), ["n", "bag"])
    best = F.max(F.struct("likeness", (-F.col("start")).alias("back"), "n")).alias("best")
    return (
        found.groupBy("doc_id", "h", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "h",
            "item_id",
            (-F.col("best.back")).alias("start"),
            (F.col("best.n") + size - 1).alias("n_words"),
            F.col("best.likeness").alias("likeness"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns unchanged, without the documents that hold a passage of an item."""
    found = find_passages(docs, items, id_col=id_col, text_col=text_col).select(
        F.col("doc_id").alias("__doc"), F.col("h").alias("__hash")
    )
    found = found.distinct()
    same = docs[id_col].eqNullSafe(found["__doc"]) & (F.xxhash64(docs[text_col]) == found["__hash"])
    return docs.join(found, same, "left_anti")
