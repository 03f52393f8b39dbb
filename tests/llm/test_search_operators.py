"""Nearest neighbours, token alignment and lexical search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import reduce

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, lexical, queries, vantage_points
from millrace.llm.vantage_points import Tree

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Nearest neighbours


def nearest(rows, queries, k):
    """Brute force over ``(id, vector)`` rows, summed in the order of the components."""
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    keep = lambda xs: sorted({(i, tuple(v)) for i, v in xs if i is not None and usable(v)})
    plain = lambda v, w: reduce(lambda total, x: total + x, ((a - b) * (a - b) for a, b in zip(v, w)), 0.0)
    out = []
    for q, v in keep(queries):
        near = sorted((math.sqrt(plain(v, w)), i) for i, w in keep(rows) if i != q and len(w) == len(v))
        out += [(q, r, i, d) for r, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, 8)).tolist()) for i in range(700)]
    rows += [(1_000 + i, rows[7][1]) for i in range(200)]  # copies of one vector
    rows += [(2_000, None), (2_001, []), (2_002, [0.0] * 8), (2_003, [1.0, None] * 4), (2_004, [math.nan] * 8)]
    rows += [(2_005, [math.inf] * 8), (None, rows[1][1]), (2_006, [1.0, 2.0]), (2_007, [2.0, 2.0])]
    rows += [rows[3], (3, rows[4][1]), (2_100, rows[7][1]), rows[0]]
    return rows


@pytest.mark.parametrize("shard_bytes, leaf, block_bytes", [(1 << 20, 16, 1 << 20), (64 * 40, 4, 2_000), (64, 1, 1 << 20)])
def test_factor_one_is_exact(spark, vectors, shard_bytes, leaf, block_bytes):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    table = table.selectExpr("*", "vec_id AS rank", "'x' AS score", "1 AS dim", "1 AS query_id")
    index = vantage_points.build_index(table, leaf=leaf, shard_bytes=shard_bytes)
    asked = table.where("vec_id % 100 = 0 or vec_id in (3, 2006)")
    got = vantage_points.search(index, asked, 10, 1.0, block_bytes=block_bytes)
    wanted = [r for r in vectors if r[0] is not None and (r[0] % 100 == 0 or r[0] in (3, 2006))]
    have = sorted(map(tuple, got.collect()))
    # An id with two vectors is two queries.
    assert have == nearest(vectors, wanted, 10)


def test_neighbours_of_empty_tables_and_few_rows(spark, vectors):
    table = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    index = vantage_points.build_index(table)
    assert vantage_points.search(index, table, 10).count() == 6
    assert vantage_points.search(index, table.limit(0), 10).count() == 0
    assert vantage_points.search(vantage_points.build_index(table.limit(0)), table, 10).count() == 0
    with pytest.raises(ValueError):
        vantage_points.search(index, table, 10, 0.5)


def test_relaxed_search_compares_less_and_keeps_its_recall():
    """Groups of neighbours, as embeddings of texts have; a factor of 3 leaves out most rows and loses hardly any."""
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(400, 64)), 20, 0) + rng.normal(0, 0.1, (8_000, 64))
    ids = np.arange(len(points))
    asked = ids[::100]
    found, compared = {}, {}
    for relax in (1.0, queries.RELAX):
        tree = Tree.build(ids, points)
        found[relax] = tree.search(asked, points[asked], 10, relax)[0]
        compared[relax] = tree.compared
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[1.0], found[queries.RELAX])])
    assert recall >= 0.9 and compared[queries.RELAX] < compared[1.0] < len(asked) * len(ids)
    brute = [np.argsort(np.square(points - points[q]).sum(1) + (ids == q) * 1e9)[:10] for q in asked]
    assert [sorted(a) for a in found[1.0]] == [sorted(b) for b in brute]


def test_recall_of_the_query(spark):
    """At the factor of the registered query, on vectors without any structure."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {tuple(r) for r in queries.QUERIES["op11_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got & set(want)) >= 0.9 * len(want)


# Alignment


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        values = alignment.byte_values()
        self.a_bytes = lambda i: bytes(values[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """The groups as pairs of id lists, by walking both lists at once."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        data = (" " + text).encode()
        if b"".join(map(self.a_bytes, a)) != data or b"".join(map(self.b_bytes, b)) != data:
            return []
        out, left, right, x, y = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if x <= y and a:
                left.append(a.pop())
                x += len(self.a_bytes(left[-1]))
            else:
                right.append(b.pop())
                y += len(self.b_bytes(right[-1]))
            if x == y and left and right:
                out.append((left, right))
                left, right = [], []
        return out


@pytest.fixture(scope="module")
def whole():
    return Whole()


def aligned(whole, texts):
    """The rows of the contract, without ids."""
    groups = [whole.groups(t) for t in texts]
    links = [[(a, b) for left, right in g for a in left for b in right] for g in groups]
    held = Counter(pair for own in links for pair in set(own))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for g, own in zip(groups, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        sizes = [sum(len(p[i]) for p in g) for i in (0, 1)]
        best = sum(held[p] == most[p[0]] for p in own)
        out.append((*sizes, len(g), len(own), best, sum(held[p] for p in own), digest))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n  b\t c ", "ends in blanks   ", "x▁y", "ﬁ ½ Ⅳ", "é" * 50,
    "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語テキスト 　 全角", "\x00\x1c \x1f", "😀👍🏽 emoji", "'ll 's n't I'm", "1234567 12 3",
    "word " * 3_000, "    x", "same", "same",
]


@pytest.mark.parametrize("sent_pairs", [alignment.SENT_PAIRS, 0, 20])
def test_alignment(spark, whole, sent_pairs):
    """Also where pair counts are not sent, or some are."""
    draw = random.Random(1)
    bits = ["the", " ", "  ", "\n", "antidis", "é", "7", "!?", "'s", "Straße", "\t", "東", "▁", "ing", " of"]
    texts = [*ODD, *("".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(80))]
    rows = [(None if i == 4 else i // 2, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string").repartition(4)
    out, counts = alignment.align_tokens(docs, A, B, sent_pairs=sent_pairs)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(r[0], *x) for r, x in zip(rows, aligned(whole, texts))]
    assert sorted(map(tuple, out.select(columns).collect()), key=key) == sorted(want, key=key)
    assert {r.n_docs for r in counts.where("best").collect()} and counts.count() == counts.select("a_id", "b_id").distinct().count()


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    out, counts = alignment.align_tokens(docs, A, B)
    assert out.count() == 0 and counts.count() == 0


def test_common_ends_slice_both_lists():
    assert alignment.common_slices([2, 3, 7], [1, 3, 5, 7]) == [(0, 2, 0, 2), (2, 3, 2, 4)]
    assert alignment.common_slices([4], [4]) == [(0, 1, 0, 1)]
    assert alignment.common_slices([], []) == []


# Lexical search


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def best(docs, items, k=10):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, length = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for *_, c in bags for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, w, c in bags:
            m = 100 - 90 + 90 * len(w) * n_docs // length
            score = 0
            for t in set(split(text)) & c.keys():
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("block_bytes, run_docs", [(1 << 20, 4_096), (600, 50)])
def test_lexical_search(spark, block_bytes, run_docs):
    draw = random.Random(run_docs)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "東京", "naïve", "A1b2"]
    often = [1 / (1 + i) for i in range(len(words))]
    text = lambda n: draw.choice([" ", ", ", "\n", "--"]).join(draw.choices(words, often, k=n))
    docs = [(i, text(draw.randrange(1, 80))) for i in range(400)]
    docs += [(1_000 + i, docs[5][1]) for i in range(60)]  # copies
    docs += [(2_000, None), (2_001, ""), (2_002, "-- ?!"), (None, docs[5][1]), (3, docs[5][1]), docs[9], docs[9]]
    docs += [(2_003, "w1 " * 20_000 + "Ärger")]
    items = [(i, text(draw.randrange(1, 25))) for i in range(25)]
    items += [(None, "W1 ärger Ärger"), (30, None), (31, "!!"), (32, "unknown w3"), (33, docs[5][1]), (33, docs[6][1]), items[0]]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    got = lexical.rank(table, asked, 10, block_bytes=block_bytes, run_docs=run_docs)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(best(docs, items), key=key)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id int, text string")
    assert [tuple(r)[:3] for r in lexical.rank(docs, items).collect()] == [(1, 1, "a")]
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_bounds_leave_out_most_of_the_tree():
    """An item of rare terms visits few buckets, and node bounds hold for every document below."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(3, 20, 2_000)
    term = np.concatenate([rng.choice(300, n, replace=False, p=np.arange(300, 0, -1) / 45_150) for n in sizes])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tf, m = rng.integers(1, 4, len(term)), rng.integers(50, 200, len(sizes))
    tree = lexical.Tree(ends, term, tf, m, 300)
    item, weights = np.array([2, 150, 290, 295]), np.array([300, 3_000, 6_000, 6_500])
    dense = np.zeros(300, np.int64)
    dense[item] = weights
    limits = tree.bounds(np.arange(len(tree.nodes)), item, weights)
    leaves = [i for i in range(len(tree.nodes)) if not len(tree.children[i])]
    scored = {i: tree.scores(i, dense) for i in leaves}
    assert all(limits[i] >= s.max() for i, (_, s) in scored.items())
    assert all(limits[i] >= limits[c].max() for i, c in enumerate(tree.children) if len(c))
    assert sorted(np.concatenate([p for p, _ in scored.values()]).tolist()) == list(range(2_000))
    visits = []
    tree.scores = lambda node, dense, own=tree.scores: (visits.append(node), own(node, dense))[1]
    found = lexical.best_documents(tree, list(range(2_000)), item, weights, [], 10)
    every = sorted((-s, False, int(p)) for places, scores in scored.values() for p, s in zip(places, scores.tolist()) if s)
    assert found == every[:10] and len(visits) < len(leaves) / 3
