"""Near-duplicates by BagMinHash, banding, and an exact check of the multiset overlap.

A text is the multiset of its runs of ``SHINGLE`` words; a shorter text is one run of all its words. The
likeness of two texts is the weighted Jaccard similarity ``sum(min) / sum(max)`` over their runs.

Signature. The weight of a run is cut at powers of two into layers ``(0,1], (1,2], (2,4], ...``. In each layer a
Poisson process, seeded by run and layer, throws points in time, each with a place in the layer and a
component of the signature; a run keeps the points whose place its weight covers. A component takes the
first point it gets. Two texts agree in a component with a chance equal to their weighted
Jaccard similarity. Points are made in rounds, and only for runs whose process can still beat the
latest component, so a text costs little more than one point for each of its runs.

Candidates share all components of a band. First texts of the same words are folded into one representative; then the
members of a bucket are compared with its first member; in buckets whose members are not of one class by then,
those outside the largest class with drawn members of it; and what is still apart with every member of another
class, block by block within a task, which emits only pairs that pass. So no candidate pair is left
open, yet a bucket of copies never emits all its pairs. Every candidate is checked on
the words themselves, by numbers that only equal runs share; equal texts are folded by a cryptographic digest. Classes are the connected components of the pairs that pass; the class id is the smallest
doc_id in it.

With ``BANDS`` bands of ``ROWS`` components a pair at the limit of 0.8 is missed with a chance of about 6e-7.

Null and empty texts, and texts of white space, are alike (no runs). Equal texts are one class. A row is named by a
64-bit hash of its id and text, so ids may be null or repeated; rows that agree in both are one document
and get equal results. A class without any id has a null class id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import gram_hash, hash_words, map_texts, mix, run_hash, split_words, unused
from millrace.session import fresh_dir, scratch

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 36, 5
ROUNDS = 2  # of comparisons with drawn members, before all that is left is compared
BLOCK_TEXTS = 256  # texts on either side that are compared at once
BLOCK_MARKS = 4_096
MARK_WORDS = 1 << 18  # rows of the broadcast marks, at most: 4 MB
BLOCK = 1 << 15  # points made at once where few processes go on


def _laid(heads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the first word of each run, and whether it has ``size`` words or is a short text."""
    n = np.diff(heads)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + heads[:-1][text]
    return text, first, n[text] >= size


def runs(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of words, and the text it belongs to, text by text."""
    return _runs(*split_words(column), size)


def _runs(found: list[bytes], heads: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    hashed = hash_words(found)
    text, first, whole = _laid(heads, size)
    out = np.empty(len(text), np.uint64)
    out[whole] = gram_hash(hashed, size)[first[whole]]
    short = ~whole
    out[short] = run_hash(hashed, first[short], np.diff(heads)[text[short]])
    return out, text


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, the same for equal pairs only."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def numbered_runs(columns: list[pa.Array], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Like ``runs`` for each column, but with numbers that are equal just where the words are; nothing is hashed."""
    split = [split_words(c) for c in columns]
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for found, _ in split for w in found], np.int64)
    rank, length = ids, 1
    while 2 * length <= size and len(rank) > length:
        rank, length = _pairs(rank[:-length], rank[length:]), 2 * length
    if length < size and len(ids) >= size:
        rank = _pairs(rank[: len(ids) - size + 1], rank[size - length : len(ids) - length + 1])
    shorts: dict[tuple, int] = {}
    out, base = [], 0
    for found, heads in split:
        text, first, whole = _laid(heads, size)
        number = np.empty(len(text), np.int64)
        number[whole] = rank[base + first[whole]]
        for i in np.flatnonzero(~whole).tolist():
            words = tuple(found[heads[text[i]] : heads[text[i] + 1]])
            number[i] = len(ids) + shorts.setdefault(words, len(shorts))
        out.append((number, text))
        base += len(found)
    return out


def weighted(hashed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text in order of text and hash: hash, text, number of times."""
    order = np.lexsort((hashed, text))
    h, t = hashed[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(h: np.ndarray, t: np.ndarray, count: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """The signature of each text, a row of ``size`` numbers that name the first points."""
    # Layers (0,1], (1,2], (2,4], ... of each weight; the last one may be covered in part.
    layers = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(h)), layers)
    layer = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    width = np.where(layer == 0, 1.0, low)
    covered = np.minimum(1.0, (count[owner] - low) / width)
    seed = mix(h[owner] ^ mix(layer.astype(np.uint64) + np.uint64(1)))
    text = t[owner]

    best = np.full(texts * size, np.inf)
    name = np.zeros(texts * size, np.uint64)
    latest = np.full(texts, np.inf)
    time, pace = np.zeros(len(seed)), -1.0 / width
    active, made = np.arange(len(seed)), 0
    while len(active):
        block = max(1, min(64, BLOCK // len(active)))
        counter = np.arange(made + 1, made + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        made += block
        point = mix(seed[active][:, None] + counter)
        when = time[active][:, None] + np.cumsum(np.log(_uniform(point)) * pace[active][:, None], axis=1)
        time[active] = end = when[:, -1]
        # Once a text has a point in every component, later points than the latest of these are idle.
        timely = np.nonzero(when < latest[text[active]][:, None])
        of, when, draw = active[timely[0]], when[timely], mix(point[timely] ^ np.uint64(0x5851F42D4C957F2D))
        slot = text[of] * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        use = (when < best[slot]) & (_uniform(draw) < covered[of])
        slot, when, draw = slot[use], when[use], draw[use]
        np.minimum.at(best, slot, when)
        lead = when == best[slot]
        name[slot[lead]] = draw[lead]
        latest = best.reshape(texts, size).max(1)
        active = active[end < latest[text[active]]]
    return name.reshape(texts, size)


def sketch(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``rid, n_runs, same, bands``: a cryptographic digest of the words and the band hashes of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        words, heads = split_words(batch.column(1))
        hashed, text = _runs(words, heads, size)
        h, t, count = weighted(hashed, text)
        found = signatures(h, t, count, n, bands * rows).reshape(n, bands, rows)
        key = np.zeros((n, bands), np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + found[:, :, j])
        key ^= mix(np.arange(1, bands + 1, dtype=np.uint64))
        ends = zip(heads.tolist(), heads[1:].tolist())
        same = [hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() for a, b in ends]
        flat = pa.array(key.view(np.int64).ravel())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.bincount(text, minlength=n), pa.int64()),
                pa.array(same, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), flat),
            ],
            ["rid", "n_runs", "same", "bands"],
        )

    return map_texts(docs, ["rid", "text"], run, "rid long, n_runs long, same binary, bands array<long>")


def compare(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``pairs`` (``a, b`` and their classes ``ra, rb``) with the ``likeness`` of the two texts, from their words."""
    left = texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        (ha, ta), (hb, tb) = numbered_runs([batch.column(4), batch.column(5)], size)
        h, t, count = weighted(np.concatenate([ha, hb]), np.concatenate([2 * ta, 2 * tb + 1]))
        pair, side = t >> 1, t & 1
        order = np.lexsort((side, h, pair))
        h, pair, count = h[order], pair[order], count[order]
        both = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
        shared = np.bincount(pair[1:][both], np.minimum(count[1:], count[:-1])[both], n)
        total = np.bincount(pair, count, n)
        likeness = shared / np.maximum(total - shared, 1)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(likeness)], ["a", "b", "ra", "rb", "likeness"])

    columns = ["a", "b", "ra", "rb", "text_a", "text_b"]
    return map_texts(joined, columns, run, "a long, b long, ra long, rb long, likeness double")


def _block(likeness: float, size: int):
    """The pairs of one block that pass: those that ask against all of it that are of another class."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        asks, rid, root = block["asks"].to_numpy(), block["rid"].to_numpy(), block["root"].to_numpy()
        h, t, count = weighted(*numbered_runs([pa.array(block["text"], pa.string())], size)[0])
        # A run that occurs c times is c marks, so the smaller number of times is a product of marks.
        level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        mark = _pairs(np.repeat(h, count), level)
        text = np.repeat(t, count)
        total = np.bincount(text, minlength=len(block))
        _, mark, times = np.unique(mark, return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        shared = times[mark] > 1
        text, mark = text[shared], number[mark[shared]]
        order = np.argsort(mark, kind="stable")
        text, mark = text[order], mark[order]
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        place = np.zeros(len(block), np.int64)
        place[x], place[y] = np.arange(len(x)), np.arange(len(y))
        both = np.zeros((len(x), len(y)), np.float32)
        for a in range(0, int(mark.max(initial=-1)) + 1, BLOCK_MARKS):
            own = slice(*np.searchsorted(mark, [a, a + BLOCK_MARKS]))
            of, column = text[own], mark[own] - a
            left, right = np.zeros((len(x), BLOCK_MARKS), np.float32), np.zeros((len(y), BLOCK_MARKS), np.float32)
            left[place[of[asks[of]]], column[asks[of]]] = 1
            right[place[of[~asks[of]]], column[~asks[of]]] = 1
            both += left @ right.T
        union = total[x][:, None] + total[y][None, :] - both
        i, j = np.nonzero((both >= likeness * union - 1e-6) & (root[x][:, None] != root[y][None, :]))
        a, b, ra, rb = rid[x[i]], rid[y[j]], root[x[i]], root[y[j]]
        ends = {"a": np.minimum(a, b), "b": np.maximum(a, b), "ra": np.minimum(ra, rb), "rb": np.maximum(ra, rb)}
        return pd.DataFrame(ends)

    return run


def marked(rows: DataFrame, wanted: DataFrame, column: str = "rid") -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``; never without one that is.

    Each wanted number sets one bit of a table of ``MARK_WORDS`` rows, whatever the input; it is broadcast, so rows that
    nobody asks for are not shuffled. With more numbers than the table has bits (16 million) it lets most rows pass.
    """
    word, bit = f"{column} & {MARK_WORDS - 1}L", f"shiftleft(1L, cast(shiftrightunsigned({column}, 58) as int))"
    marks = wanted.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or({bit})").alias("marks"))
    found = rows.withColumn("word", F.expr(word)).join(F.broadcast(marks), "word")
    return found.where(f"marks & {bit} != 0").drop("word", "marks")


def merge(nodes: DataFrame, links: DataFrame, base: str) -> DataFrame:
    """``rid, root`` of ``nodes`` after the classes that ``links`` (``ra, rb``) name are put together.

    The root of a class is the smallest rid in it. Each round hooks roots onto their smallest neighbour, shortens the
    paths, and goes on with the links that are left between the new roots.
    """
    spark = nodes.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    step = 0
    while not links.isEmpty():
        hooks = links.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("onto"))
        hooks = kept(hooks, f"hooks{step}")
        # Follow the hooks to their ends; a chain halves with every jump.
        jump = 0
        while True:
            nxt = hooks.select(F.col("root").alias("onto"), F.col("onto").alias("further"))
            if hooks.join(nxt, "onto", "left_semi").isEmpty():
                break
            longer = hooks.join(nxt, "onto", "left").select("root", F.coalesce("further", "onto").alias("onto"))
            hooks = kept(longer, f"jump{step}_{jump}")
            jump += 1
        nodes = kept(nodes.join(hooks, "root", "left").select("rid", F.coalesce("onto", "root").alias("root")), f"nodes{step}")
        for end in ("ra", "rb"):
            links = links.join(hooks.withColumnRenamed("root", end), end, "left")
            links = links.withColumn(end, F.coalesce("onto", end)).drop("onto")
        left = links.where("ra != rb").select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"))
        links = kept(left.distinct(), f"links{step}")
        step += 1
    return nodes


def classes(rows: DataFrame, likeness: float, size: int, base: str) -> DataFrame:
    """``rid, root, links`` of every row of ``rows`` (``rid, text``)."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    sketches = kept(sketch(rows, size), "sketches")
    # Equal texts first: one representative stands for all of them.
    same = sketches.groupBy("same").agg(F.min("rid").alias("rep"))
    folded = kept(sketches.select("rid", "same").join(same, "same").select("rid", "rep").distinct(), "folded")
    reps = folded.select(F.col("rep").alias("rid")).distinct()
    distinct = kept(sketches.where("n_runs > 0").join(reps, "rid", "left_semi").dropDuplicates(["rid"]), "distinct")
    # Nearly all buckets have one member: which have more is counted by bucket alone, the members of the rest stay where
    # they are but for those whose mark collides, and these fall out of the next count.
    slots = distinct.select("rid", "n_runs", F.explode("bands").alias("bucket"))
    twice = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    slots = kept(marked(slots, twice, "bucket"), "candidates")
    digests = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"set{k}") for k in (1, 2)]
    shared = slots.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rid").alias("lead"), *digests).where("n > 1")
    # Of buckets that hold the same members one is enough; equal sets have equal leads.
    shared = shared.groupBy("n", "lead", "set1", "set2").agg(F.min("bucket").alias("bucket")).select("bucket", "lead")
    sizes = distinct.select(F.col("rid").alias("lead"), F.col("n_runs").alias("lead_runs"))
    shared = kept(shared.join(sizes, "lead"), "shared")
    lead = F.struct(F.col("lead").alias("rid"), F.col("lead_runs").alias("n_runs")).alias("lead")
    slots = kept(slots.join(shared, "bucket").select("bucket", "rid", "n_runs", lead), "slots")
    wanted = slots.select("rid").distinct()
    # An inner join: Spark would do a semi join first, and shuffle every text for it.
    texts = marked(rows, wanted).join(wanted, "rid").dropDuplicates(["rid"])
    texts = kept(texts, "texts")

    def comparable(m, n):
        """Texts of very unlike length cannot be alike enough."""
        return F.least(m, n) >= F.greatest(m, n) * (likeness - 1e-9)

    def leaders(nodes: DataFrame, salt: int) -> DataFrame:
        """The members of buckets that hold more than one class, each with a member of the largest class drawn by ``salt``."""
        member = slots.select("bucket", "rid", "n_runs").join(nodes, "rid")
        drawn = F.min_by(F.struct("rid", "n_runs"), F.xxhash64("rid", "bucket", F.lit(salt))).alias("lead")
        per = member.groupBy("bucket", "root").agg(F.count("*").alias("n"), drawn)
        largest = F.struct(F.col("root").alias("main"), "lead", F.col("n").alias("main_n"))
        per = per.groupBy("bucket").agg(
            F.max_by(largest, F.struct("n", "root")).alias("m"), F.count("*").alias("kinds"), F.sum("n").alias("total")
        )
        # Two members have been compared, or are too unlike in length.
        per = per.where("kinds > 1 and total > 2").select(
            "bucket", "m.main", F.col("m.lead").alias("drawn"), "total", (F.col("total") - F.col("m.main_n")).alias("others")
        )
        return member.join(per, "bucket")

    ends = ["a", "b", "ra", "rb"]

    def checked(pairs: DataFrame, salt: int) -> DataFrame:
        """The pairs that pass."""
        pairs = kept(pairs, f"pairs{salt}")
        return kept(compare(pairs, texts, size).where(F.col("likeness") >= likeness - 1e-9).select(ends), f"passed{salt}")

    # All members of a bucket against its first one.
    lead = F.col("lead")
    first = slots.where((F.col("rid") != lead["rid"]) & comparable(F.col("n_runs"), lead["n_runs"]))
    first = first.select(lead["rid"].alias("a"), F.col("rid").alias("b")).distinct()
    passed = checked(first.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")), 0)
    nodes = slots.select("rid").distinct().select("rid", F.col("rid").alias("root"))
    nodes = merge(nodes, passed.select("ra", "rb"), f"{base}/round0")

    # Members outside the largest class of their bucket against other members of it. Texts of two classes have not
    # passed before, and a bucket that holds one class only is done with. The largest class is left out by the join
    # itself: its members would be most of the rows, and none of them is compared here.
    for salt in range(1, ROUNDS + 1):
        drawn = F.col("drawn")
        member = leaders(nodes, salt)
        rest = member.where((F.col("root") != F.col("main")) & comparable(F.col("n_runs"), drawn["n_runs"]))
        rest = rest.select(
            F.least("rid", drawn["rid"]).alias("a"),
            F.greatest("rid", drawn["rid"]).alias("b"),
            F.least("root", "main").alias("ra"),
            F.greatest("root", "main").alias("rb"),
        )
        more = checked(rest.distinct(), salt)
        passed = passed.unionByName(more)
        nodes = merge(nodes, more.select("ra", "rb"), f"{base}/round{salt}")

    # Whatever still meets in a bucket without being of one class: the members outside the largest
    # class against all of another class, block by block, so that only pairs that pass leave a task.
    member = leaders(nodes, ROUNDS + 1).select("bucket", "rid", "root", "main", "total", "others")
    member = kept(member, "members")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_TEXTS).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rid", "bucket"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    x = member.where("root != main").withColumn("i", own("others")).withColumn("j", every("total"))
    y = member.withColumn("j", own("total")).withColumn("i", every("others"))
    dealt = x.withColumn("asks", F.lit(True)).unionByName(y.withColumn("asks", F.lit(False)))
    dealt = dealt.select("bucket", "i", "j", "rid", "root", "asks").join(texts, "rid")
    block = dealt.groupBy("bucket", "i", "j").applyInPandas(_block(likeness, size), "a long, b long, ra long, rb long")
    more = kept(block.distinct(), "passed")
    passed = passed.unionByName(more)
    nodes = merge(nodes, more.select("ra", "rb"), f"{base}/last")

    links = passed.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = folded.join(nodes.select(F.col("rid").alias("rep"), "root"), "rep", "left").join(links, "rep", "left")
    return out.select("rid", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def _placed(rows: DataFrame, likeness: float, size: int) -> DataFrame:
    """``classes``, written once; the tables between are removed."""
    spark = rows.sparkSession
    out = fresh_dir(spark, "near-dedup-classes")
    with scratch(spark):
        classes(rows.select("rid", "text"), likeness, size, fresh_dir(spark, "near-dedup")).write.parquet(out)
    return rows.select("rid", "doc_id").join(spark.read.parquet(out), "rid")


def near_duplicates(
    docs: DataFrame, likeness: float = LIKENESS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, class_id, class_size, n_links`` for every row.

    ``n_links`` counts the checked links to other texts; equal texts are folded and count once.
    """
    placed = _placed(_named(docs, id_col, text_col), likeness, size)
    per = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(per, "root").select("doc_id", "class_id", "class_size", F.col("links").alias("n_links"))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def drop_near_duplicates(
    docs: DataFrame, likeness: float = LIKENESS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id; of rows that repeat it, one."""
    placed = _placed(_named(docs, id_col, text_col), likeness, size)
    least = placed.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "rid")).alias("one"))
    rid = unused(docs.columns, "__rid")
    least = least.select(F.col("one")["rid"].alias(rid))
    name = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.withColumn(rid, name).join(least, rid, "left_semi")
    return kept.dropDuplicates([rid]).select(*[F.col(f"`{c}`") for c in docs.columns])
