"""Toxicity by maximum-scoring segments.

Each word has a log-odds weight, toxic against clean, under an informative Dirichlet prior, lowered by its
standard error. A word scores its weight, any other word a small loss, so that clean text drifts
down. A linear scan finds every maximal-scoring segment of a text. How surprising a score
is in a text of n words follows an extreme-value law, ``P(best >= s) = 1 - exp(-K n exp(-rate s))``;
``rate`` comes from the word scores of clean text, ``K`` from clean texts that had no part in the weights. A
logistic curve over that evidence and over the number and sum of significant segments gives the score.

The model is fitted on at most about ``max_rows`` labelled documents (a hash of the id picks them; of rows that share an id
one is taken), and has as many words as stand in two of their toxic texts. Only words that speak clearly for toxicity keep their
weight (``LEAST``); clean text is told by the loss alone, which all other words have in common. Null and empty texts have no segment and get the lowest evidence. Rows without a
label are not learnt from; of an id labelled more than once the highest label counts. Without both classes among
the labels every score is 0. Extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import map_texts, release, ship, slices

MAX_ROWS = 20_000
PRIOR = 0.2  # weight of the prior, as a share of the labelled words
LOSS = 0.3  # what a word without weight costs
LEAST = 0.7  # smallest weight that is kept
LEAST_TEXTS = 2  # toxic texts that a word stands in at least; tokens of one text say little
SIGNIFICANT = 0.01  # expected number of such segments in a clean text of the same length
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode())


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = ()


def log_odds(toxic: Column, clean: Column, n1: float, n0: float, share: float = PRIOR) -> Column:
    """Log-odds of a word, moved towards 0 by one standard error; the prior follows the counts of both classes."""
    prior = share * (n1 + n0)
    alpha = share * (toxic + clean)
    a, b = toxic + alpha, clean + alpha
    delta = F.log(a / (n1 + prior - a)) - F.log(b / (n0 + prior - b))
    return F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - F.sqrt(1 / a + 1 / b))


def segments(hits: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments: score, first and last word.

    ``hits`` are the weighted words in order, each with its place; every other word costs ``loss``.
    One pass (Ruzzo and Tompa): a stack keeps candidates with the running sum before (low) and after
    (high) them, and a link to the nearest candidate below that starts lower, so no search is repeated.
    """
    stack: list[tuple] = []
    total, place = 0.0, -1
    for at, weight in hits:
        total -= loss * (at - place - 1)
        place = at
        low, high, first = total, total + weight, at
        total = high
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= high:
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((low, high, first, at, j))
    return [(high - low, first, last) for low, high, first, last, _ in stack]


def _evidence(model: Model, text: str) -> tuple[int, float, list[tuple[float, int, int]]]:
    found = word_list(text)
    weights = model.weights
    hits = [(i, weights[w]) for i, w in enumerate(found) if w in weights]
    parts = segments(hits)
    return len(found), max((p[0] for p in parts), default=0.0), parts


def _features(model: Model, n: int, best: float, parts: list[tuple[float, int, int]]) -> tuple[list[float], list]:
    significant = [p for p in parts if model.k * n * math.exp(-model.rate * p[0]) <= SIGNIFICANT]
    # -log of the chance that a clean text of this length holds a segment as good.
    expected = model.k * max(n, 1) * math.exp(-model.rate * best)
    surprise = -math.log(max(-math.expm1(-expected), 1e-30))
    share = sum(p[2] - p[1] + 1 for p in significant) / max(n, 1)
    return [min(surprise, 30.0), math.log1p(len(significant)), math.log1p(sum(p[0] for p in significant)), share], significant


def _score(model: Model, features: list[float]) -> float:
    if not model.curve:
        return 0.0
    x = model.curve[0] + sum(w * f for w, f in zip(model.curve[1:], features))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled texts: text, label, and a number for the fold."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    n = known.count()
    pick = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000))
    known = known.where(pick < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(4)))
    # The sample is bounded by max_rows: a few hundred KB.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return sample.groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text")).select("label", "fold", "text")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic) for which ``learn`` holds."""
    sample = _labelled(docs, labels, learn, max_rows)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, texts = (Counter(), Counter()), Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = word_list(text)
            counts[label > 0].update(found)
            if label > 0:
                texts.update(set(found))
        every = list(counts[0] | counts[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(every, pa.binary()), *(pa.array([c[w] for w in every], pa.int64()) for c in (counts[1], counts[0], texts))],
            ["word", "toxic", "clean", "texts"],
        )

    counted = map_texts(sample.where("fold != 0"), ["label", "text"], count, "word binary, toxic long, clean long, texts long")
    by_word = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "texts")]).persist()
    n1, n0 = by_word.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        by_word.unpersist()
        return Model()
    weight = log_odds(F.col("toxic"), F.col("clean"), float(n1), float(n0))
    rows = (
        by_word.where(F.col("texts") >= LEAST_TEXTS)
        .select("word", "clean", weight.alias("weight"))
        .where(F.col("weight") >= LEAST)
        .orderBy(F.desc("weight"), "word")
        .collect()
    )
    by_word.unpersist()
    weights = {bytes(r["word"]): r["weight"] for r in rows}
    model = Model(weights, _rate([r["clean"] / n0 for r in rows], list(weights.values())))

    held = sample.where("fold = 0").withColumn("label", F.col("label").cast("int"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_evidence(model, text)[:2] for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())],
            ["label", "n", "best"],
        )

    # Both collected tables are bounded by max_rows.
    rows = map_texts(held, ["label", "text"], measure, "label int, n long, best double").collect()
    clean_rows = [r for r in rows if r["label"] == 0 and r["n"]]
    k = len(clean_rows) / max(sum(r["n"] * math.exp(-model.rate * r["best"]) for r in clean_rows), 1e-9)
    known = Model(weights, model.rate, max(k, 1e-9))

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_features(known, *_evidence(known, text))[0] for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["label", "x"])

    # A second pass, now that K is known: the features of a text come from all its segments, as when it is scored.
    rows = map_texts(held, ["label", "text"], describe, "label int, x array<double>").collect()
    curve = _curve(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return Model(weights, known.rate, known.k, curve)


def _rate(shares: list[float], weights: list[float]) -> float:
    """The positive root of ``E[exp(rate * score)] = 1``; ``shares`` of the words of clean text have ``weights``."""
    p, w = np.array(shares), np.array(weights)
    low, high = 1e-6, 20.0
    f = lambda t: (p * np.exp(np.minimum(t * w, 700))).sum() + (1 - p.sum()) * math.exp(-t * LOSS) - 1
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return (math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), *[0.3] * 4) if len(y) else ()
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return tuple(w.tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``, and the significant passages as first and last word and score."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_features(model, *_evidence(model, t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([_score(model, f) for f, _ in out], pa.float64()),
                pa.array(
                    [[{"first": a, "last": b, "score": s} for s, a, b in parts] for _, parts in out],
                    pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])),
                ),
            ],
            ["doc_id", "score", "passages"],
        )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, passages array<struct<first:int,last:int,score:double>>"
    return map_texts(docs, [id_col, text_col], run, schema)


def drop_toxic(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose score is below ``limit``."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            sizer = pa.RecordBatch.from_arrays([batch.column(place)], ["t"])
            start = 0
            for part in slices(sizer):
                own = batch.slice(start, part.num_rows)
                start += part.num_rows
                keep = [
                    _score(model, _features(model, *_evidence(model, t or ""))[0]) < limit
                    for t in part.column(0).to_pylist()
                ]
                yield own.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
