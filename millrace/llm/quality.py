"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by the hashed byte
trigrams in it and by shares of letters, digits, marks and repetitions; one layer encodes that into ``h``. The bag
is the weighted mean of its passages with gated attention ``softmax(w . (tanh(V h) * sigmoid(U h)))``, and a logistic
unit scores it. Everything is learnt from document labels alone, on at most about ``max_rows`` labelled documents
(a hash of the id picks them; of rows that share an id one is taken), from all passages of their texts. Learning is spread: groups of about
``GROUP_ROWS`` bags go through ``LOCAL_STEPS`` steps of gradient descent each in a task of its own, the parameters are averaged,
and this is repeated ``ROUNDS`` times; the driver sees parameters only.

Null and empty texts are one passage without words. Rows without a label are not learnt from; of an id
labelled more than once the highest label counts. Without both classes the score is the share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import map_texts, prefix_hash, range_hash, utf8, words
from millrace.session import fresh_dir

PASSAGE = 64  # words
BUCKETS = 96
HIDDEN, GATE = 24, 12
MAX_ROWS = 4_000
GROUP_ROWS = 500
ROUNDS, LOCAL_STEPS = 8, 25
_KINDS = np.zeros(256, np.int8)  # kind of each byte
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[[9, 11, 12, 13, 32]] = 4
_KINDS[10] = 5
_KINDS[128:] = 6
_KINDS[[ord(c) for c in ".,;:'\"()-?"]] = 7
DIM = BUCKETS + 8 + 7


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the text it belongs to. Every text has one passage at least."""
    starts, ends, heads = words(raw, offsets)
    n_words = np.diff(heads)
    count = np.maximum(1, -(-n_words // PASSAGE))
    owner = np.repeat(np.arange(len(n_words)), count)
    base = np.cumsum(count) - count
    # The passage of each word, and of each byte: a passage reaches up to the next one's first word.
    word_owner = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(len(starts)) - heads[word_owner] if len(starts) else np.zeros(0, np.int64)
    word_passage = base[word_owner] + within // PASSAGE if len(starts) else np.zeros(0, np.int64)
    begin = offsets[:-1][owner].copy()
    later = np.flatnonzero((within % PASSAGE == 0) & (within > 0))
    begin[word_passage[later]] = starts[later]
    sizes = np.diff(np.append(begin, len(raw)))
    n = len(owner)
    byte_passage = np.repeat(np.arange(n), sizes)

    x = np.zeros((n, DIM), np.float32)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
        code = (code ^ (code >> np.uint32(11))) % np.uint32(BUCKETS)
        same = byte_passage[:-2] == byte_passage[2:]
        grams = np.bincount(byte_passage[:-2][same] * BUCKETS + code[same], minlength=n * BUCKETS)
        grams = grams.reshape(n, BUCKETS)
        x[:, :BUCKETS] = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1)) * 4
    kinds = np.bincount(byte_passage * 8 + _KINDS[raw], minlength=n * 8).reshape(n, 8)
    x[:, BUCKETS : BUCKETS + 8] = kinds / np.maximum(sizes, 1)[:, None] * 4
    per = np.bincount(word_passage, minlength=n)
    x[:, BUCKETS + 8] = np.log1p(per)
    x[:, BUCKETS + 9] = np.bincount(word_passage, ends - starts, n) / np.maximum(per, 1) / 8
    if len(starts):
        hashed = range_hash(prefix_hash(raw), starts, ends)
        pair = word_passage[1:] == word_passage[:-1]
        twice = pair & (hashed[1:] == hashed[:-1])
        x[:, BUCKETS + 10] = np.bincount(word_passage[1:], twice, n) / np.maximum(per, 1) * 4
        order = np.lexsort((hashed, word_passage))
        again = (word_passage[order][1:] == word_passage[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
        x[:, BUCKETS + 11] = np.bincount(word_passage[order][1:], again, n) / np.maximum(per, 1) * 4
        # Words that end in a mark, and words without a letter.
        x[:, BUCKETS + 12] = np.bincount(word_passage, _KINDS[raw[ends - 1]] == 0, n) / np.maximum(per, 1) * 4
        x[:, BUCKETS + 13] = np.bincount(word_passage, (ends - starts == 1) & (_KINDS[raw[starts]] == 0), n) / np.maximum(per, 1) * 4
    x[:, BUCKETS + 14] = np.log1p(n_words[owner]) / 4
    return x, owner


@dataclass(frozen=True)
class Model:
    """Parameters; ``prior`` is the score where nothing could be learnt."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float = 0.5


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    return {
        "W": draw(DIM, HIDDEN),
        "b": np.zeros(HIDDEN),
        "V": draw(HIDDEN, GATE),
        "U": draw(HIDDEN, GATE),
        "w": draw(GATE, 1)[:, 0],
        "c": np.zeros(HIDDEN),
        "d": np.zeros(1),
    }


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple:
    """``first`` is the first passage of each bag; bags are contiguous."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first)
    logit = z @ p["c"] + p["d"][0]
    return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradient(p: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the bags; ``owner`` ascends from 0 and every bag has a passage."""
    first = np.searchsorted(owner, np.arange(len(y)))
    h, t, s, a, z, out = _forward(p, x, first, owner)
    up = (out - y) / len(y)
    g = {"c": z.T @ up, "d": np.array([up.sum()])}
    dz = up[:, None] * p["c"]
    da = (dz[owner] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[owner])
    dt, ds = de[:, None] * p["w"] * s, de[:, None] * p["w"] * t
    g["w"] = (t * s).T @ de
    dt, ds = dt * (1 - t * t), ds * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def descend(p: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int) -> dict[str, np.ndarray]:
    """Parameters after ``steps`` steps of Adam on all bags."""
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for step in range(1, steps + 1):
        g = gradient(p, x, owner, y)
        for k in p:
            g[k] = g[k] + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
        p = {k: p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) for k in p}
    return p


def predict(model: Model, x: np.ndarray, owner: np.ndarray, bags: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the bags and attention of the passages."""
    first = np.searchsorted(owner, np.arange(bags))
    if not model.params or not bags:
        return np.full(bags, model.prior), 1 / np.maximum(np.bincount(owner, minlength=bags), 1)[owner]
    out = _forward(model.params, (x - model.mean) / model.scale, first, owner)
    return out[5], out[3]


def described(docs: DataFrame, labels: DataFrame, learn_from: Column, max_rows: int) -> DataFrame:
    """``part, name, label, x``: the features of all passages of each sampled document, and the group it is learnt in."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
        .groupBy("doc_id")
        .agg(F.max("quality").alias("label"))
    )
    n = known.count()
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    known = known.where(pick < int(1_000_000 * min(1.0, max_rows / max(n, 1))))
    # The sample is bounded by max_rows: a few dozen KB.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    parts = max(1, -(-min(n, max_rows) // GROUP_ROWS))
    name = F.xxhash64("doc_id", F.lit(11))
    sample = sample.select(F.pmod(name, F.lit(parts)).cast("int").alias("part"), name.alias("name"), F.col("label").cast("int"), "text")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, owner = passages(*utf8(batch.column(3)))
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        bags = pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], bags], ["part", "name", "label", "x"])

    return map_texts(sample, ["part", "name", "label", "text"], describe, "part int, name long, label int, x binary")


def _bags(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, the bag of each, and labels, in an order that does not depend on how the rows arrived."""
    part = part.sort_values(["name", "label"])
    bags = [np.frombuffer(x, np.float32).reshape(-1, DIM) for x in part["x"]]
    return np.vstack(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), (part["label"] > 0).to_numpy(float)


def _flat(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).tobytes()


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(flat, ends[:-1]))}


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Learn from the rows of ``labels`` (doc_id, quality) for which ``learn_from`` holds."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "quality")
    described(docs, labels, learn_from, max_rows).write.parquet(path)
    sample = spark.read.parquet(path)

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        x, _, y = _bags(part)
        x = x.astype(np.float64)
        row = part["part"].iloc[0], len(x), len(y), y.sum(), x.sum(0).tobytes(), np.square(x).sum(0).tobytes()
        return pd.DataFrame([row], columns=["part", "passages", "bags", "positive", "sums", "squares"])

    schema = "part int, passages long, bags long, positive double, sums binary, squares binary"
    groups = sorted(sample.groupBy("part").applyInPandas(measure, schema).collect())  # a row for each group
    n, bags, positive = (sum(r[i] for r in groups) for i in (1, 2, 3))
    prior = positive / bags if bags else 0.5
    if not bags or positive in (0, bags):
        return Model({}, np.zeros(DIM), np.ones(DIM), prior)
    mean, square = (sum(np.frombuffer(r[i]) for r in groups) / n for i in (4, 5))
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 0.05
    p = _start(np.random.default_rng(seed))
    p["d"][0] = np.log(prior / (1 - prior))

    def improved(p: dict[str, np.ndarray]):
        def improve(part: pd.DataFrame) -> pd.DataFrame:
            x, owner, y = _bags(part)
            found = descend(p, (x - mean) / scale, owner, y, LOCAL_STEPS)
            return pd.DataFrame([(part["part"].iloc[0], len(y), _flat(found))], columns=["part", "bags", "params"])

        return improve

    for _ in range(ROUNDS):
        groups = sample.groupBy("part").applyInPandas(improved(p), "part int, bags long, params binary")
        p = _unflat(sum(np.frombuffer(r.params) * (r.bags / bags) for r in sorted(groups.collect())), p)
    return Model(p, mean, scale, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_passages``, and the passage with most attention and its weight."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, owner = passages(*utf8(batch.column(1)))
        scores, attention = predict(model, x, owner, batch.num_rows)
        bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        best = [int(a + attention[a:b].argmax()) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(scores, pa.float64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(np.array(best, np.int64) - bounds[:-1], pa.int64()),
                pa.array(attention[best], pa.float64()),
            ],
            ["doc_id", "score", "n_passages", "top_passage", "top_weight"],
        )

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, n_passages long, top_passage long, top_weight double"
    return map_texts(docs, [id_col, text_col], run, schema)
