"""Ranked lexical search: the best documents of each item, by branch and bound over a tree of documents.

Of each document only the terms that items have are kept, with how often they occur. In a task, runs of documents are put
into an FP-tree: the terms of a document stand in the order of their frequency in the corpus, so documents share the
paths of their frequent terms, and a path without branches is one step. A node knows, for each term, the largest
number of times ``tf`` that it occurs in a document below, and the least length factor ``m`` below. A term's part of the score
grows with ``tf`` and falls with ``m``, so the score made from both is a bound for all documents below. For each item
the tree is searched depth-first, the child of the largest bound first, and a node is left out where its bound is below the
item's k-th best score so far. The best of all tasks are ranked.

Terms, weights and scores: see ``WORDS``, ``weight`` and ``scores``; all but the weight is integer arithmetic, so results are
exact. Items are taken in blocks of bounded size, one after the other, so whatever is sent to all tasks is bounded.

A null text or one without terms is no document. An item without terms has no results. Equal scores are ranked by
ascending id, null ids last. Each row is a document, repeated rows and ids included; item rows that agree in id and text
are one item. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.arrow import map_texts, ship, utf8
from millrace.session import fresh_dir, scratch

BLOCK_BYTES = 1 << 20  # text of the items that are searched at once; a longer item is a block of its own
RUN_DOCS, RUN_TERMS = 4_096, 1 << 20  # documents of a tree, and their terms
BUCKET = 16  # documents that are scored one by one
NUMBERED = [StructField("place", LongType()), StructField("item", LongType())]  # in the block, and over all blocks
SHORT = 90  # percent of the length that counts in m

# Maximal matches of [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased: what is no word becomes a blank.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs ``tf`` times adds to the score of a document, for each unit of the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def terms(data: bytes) -> list[bytes]:
    return data.translate(WORDS).split()


def restricted(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, times`` of each document: its length, and its terms that are in ``vocabulary``, sent to all."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary.value
        raw, offsets = utf8(batch.column(1))
        data = raw.tobytes()
        n, ends, ids, times = [], [0], [], []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            words = terms(data[a:b])
            n.append(len(words))
            count = Counter(words)
            for term in count.keys() & known.keys():
                ids.append(known[term])
                times.append(count[term])
            ends.append(len(ids))
        ends = pa.array(ends, pa.int32())
        columns = [batch.column(0), pa.array(n, pa.int64())]
        columns += [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, times)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_texts(docs, [id_col, text_col], run, f"doc_id {kind}, n long, terms array<int>, times array<int>")
    return found.where("n > 0")


class Tree:
    """The FP-tree over a run of documents; ``term`` holds the ranks of terms, the most frequent one being 0."""

    def __init__(self, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        owner = np.repeat(np.arange(len(m)), np.diff(ends))
        order = np.lexsort((term, owner))
        term, tf = term[order], tf[order]
        path = term.astype(">u4").tobytes()
        paths = [path[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        self.place = np.array(sorted(range(len(m)), key=paths.__getitem__), np.int64)
        sizes = np.diff(ends)[self.place]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(term)) - np.repeat(self.ends[:-1], sizes) + np.repeat(ends[:-1][self.place], sizes)
        self.term, self.tf, self.m = term[at], tf[at], m[self.place]
        self.nodes: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        self._grow()
        # Bottom-up: the largest tf of each term below each node, and the least m.
        self.most = np.zeros((len(self.nodes), n_terms), np.int32)
        self.least = np.zeros(len(self.nodes), np.int64)
        for node in reversed(range(len(self.nodes))):
            a, b = self.nodes[node]
            self.least[node] = self.m[a:b].min()
            if len(self.children[node]):
                self.most[node] = self.most[self.children[node]].max(0)
            else:
                own = slice(self.ends[a], self.ends[b])
                np.maximum.at(self.most[node], self.term[own], self.tf[own])

    def _grow(self) -> None:
        """Nodes are runs of documents in the order of their paths; children branch where the shared path ends."""
        sizes = np.diff(self.ends)
        shared = np.zeros(len(sizes), np.int64)  # with the document before
        for i in range(1, len(sizes)):
            n = min(sizes[i], sizes[i - 1])
            a, b = self.ends[i - 1], self.ends[i]
            differ = self.term[a : a + n] != self.term[b : b + n]
            shared[i] = differ.argmax() if differ.any() else n
        todo = [(0, len(sizes), -1)]
        links: list[list[int]] = []
        while todo:
            a, b, parent = todo.pop()
            node = len(self.nodes)
            self.nodes.append((a, b))
            links.append([])
            if parent >= 0:
                links[parent].append(node)
            inner = shared[a + 1 : b]
            if b - a <= BUCKET or (inner == sizes[a + 1 : b]).all() and (inner == sizes[a:b - 1]).all():
                continue  # few documents, or documents of one path
            cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
            start = a
            for i in range(1, len(cuts)):
                # Small branches that stand side by side are one bucket.
                if i + 1 < len(cuts) and cuts[i + 1] - start <= BUCKET:
                    continue
                todo.append((start, cuts[i], node))
                start = cuts[i]
        self.children = [np.array(own, np.int64) for own in links]

    def bounds(self, nodes: np.ndarray, item: np.ndarray, weights: np.ndarray) -> np.ndarray:
        most = self.most[nodes[:, None], item[None, :]].astype(np.int64)
        return (parts(most, self.least[nodes][:, None]) * weights).sum(1)

    def scores(self, node: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a bucket, by their number in the run, and their scores; ``dense`` has the weight of each term."""
        a, b = self.nodes[node]
        own = slice(self.ends[a], self.ends[b])
        owner = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
        used = dense[self.term[own]]
        hit = np.flatnonzero(used)
        score = np.zeros(b - a, np.int64)
        np.add.at(score, owner[hit], used[hit] * parts(self.tf[own][hit], self.m[a + owner[hit]]))
        return self.place[a:b], score


def best_documents(tree: Tree, ids: list, item: np.ndarray, weights: np.ndarray, best: list, k: int) -> list:
    """``best``, the item's ranking ``(-score, id is null, id)`` so far, after the documents of the tree. Counts visits."""
    dense = np.zeros(tree.most.shape[1], np.int64)
    dense[item] = weights
    root = np.zeros(1, np.int64)
    todo = [(int(tree.bounds(root, item, weights)[0]), 0)]
    while todo:
        bound, node = todo.pop()
        # An equal score can still win by a smaller id.
        if not bound or len(best) == k and bound < -best[-1][0]:
            continue
        below = tree.children[node]
        if len(below):
            limits = tree.bounds(below, item, weights)
            order = np.argsort(limits, kind="stable")
            todo += zip(limits[order].tolist(), below[order].tolist())
            continue
        least = max(1, -best[-1][0] if len(best) == k else 1)
        place, score = tree.scores(node, dense)
        hit = score >= least
        if hit.any():
            more = [(-s, ids[p] is None, ids[p]) for p, s in zip(place[hit].tolist(), score[hit].tolist())]
            best = sorted(best + more, key=lambda x: (x[0], x[1], x[2] if not x[1] else 0))[:k]
    return best


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    run_docs: int = RUN_DOCS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    ship(spark)
    base = fresh_dir(spark, "lexical")
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    rows = rows.distinct().withColumn("size", F.octet_length("text"))
    rows.write.parquet(f"{base}/items")
    rows = spark.read.parquet(f"{base}/items")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for b in range(n_blocks):
        block = rows.where(block_of == b).orderBy("item_id", "text").select("item_id", "text").collect()
        if not block and b:
            continue
        names = [(i, (b << 32) + i, r.item_id) for i, r in enumerate(block)]
        names = spark.createDataFrame(names, StructType([*NUMBERED, rows.schema["item_id"]]))
        with scratch(spark):  # the documents' terms are removed when the block is done
            found = _block(docs, block, k, id_col, text_col, fresh_dir(spark, "lexical-block"), run_docs)
            found.join(F.broadcast(names), "place").drop("place").write.mode("append").parquet(f"{base}/found")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = spark.read.parquet(f"{base}/found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str, base: str, run_docs: int) -> DataFrame:
    """The best documents of each task for the items of one block."""
    spark = docs.sparkSession
    item_terms = [sorted(set(terms(r.text.encode()))) for r in block]
    known = {t: i for i, t in enumerate(sorted(set().union(*item_terms)))}
    vocabulary = spark.sparkContext.broadcast(known)
    restricted(docs, vocabulary, id_col, text_col).write.parquet(f"{base}/terms")
    rows = spark.read.parquet(f"{base}/terms")
    n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(known), np.int64)
    for r in held:
        df[r.term] = r.df
    ranked = np.argsort(-df, kind="stable")
    rank_of = np.empty(len(known), np.int64)
    rank_of[ranked] = np.arange(len(known))
    weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
    asked = []
    for own in item_terms:
        ids = np.array([known[t] for t in own], np.int64)
        ids = ids[weights[ids] > 0] if len(ids) else ids
        asked.append((rank_of[ids], weights[ids]))
    sent = spark.sparkContext.broadcast((rank_of, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, asked = sent.value
        best: list[list] = [[] for _ in asked]
        kind = pa.null()
        ids, lengths, sizes, term, tf = [], [], [], [], []

        def search() -> None:
            n = np.concatenate(lengths)
            m = 100 - SHORT + SHORT * n * n_docs // length
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            tree = Tree(ends, rank_of[np.concatenate(term)], np.concatenate(tf).astype(np.int64), m, len(rank_of))
            for i, (item, own) in enumerate(asked):
                if len(item):
                    best[i] = best_documents(tree, ids, item, own, best[i], k)
            for held in (ids, lengths, sizes, term, tf):
                held.clear()

        for batch in batches:
            at, kind = 0, batch.column(0).type
            counts = batch.column(2).value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(counts)])
            while at < batch.num_rows:
                room = run_docs - len(ids), RUN_TERMS - sum(map(len, term))
                stop = min(at + room[0], int(np.searchsorted(starts, starts[at] + max(0, room[1]), "right")) - 1)
                stop = max(stop, at + (not ids))
                if stop > at:
                    part = batch.slice(at, stop - at)
                    ids += part.column(0).to_pylist()
                    lengths.append(part.column(1).to_numpy())
                    sizes.append(counts[at:stop])
                    term.append(part.column(2).flatten().to_numpy())
                    tf.append(part.column(3).flatten().to_numpy())
                    at = stop
                if at < batch.num_rows:
                    search()
        if ids:
            search()
        out = [(i, d, -s) for i, own in enumerate(best) for s, _, d in own]
        if out:
            columns = zip(zip(*out), (pa.int64(), kind, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["place", "doc_id", "score"])

    # Documents of like length stand together, so the least m of a node says much.
    near = rows.where(F.size("terms") > 0).sortWithinPartitions("n", "doc_id")
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    return near.mapInArrow(run, f"place long, doc_id {doc_kind}, score long")
