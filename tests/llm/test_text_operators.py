"""Each operator against a brute-force version or an exact round trip, with nulls, ties and odd texts."""

import functools
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import (
    bpe_chunks,
    decontaminate,
    fingerprints,
    licenses,
    near_dedup,
    pii,
    quality,
    substring_dedup,
    token_counts,
    toxicity,
)
from millrace.llm.arrow import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None,
    "",
    "   \n\t ",
    "x" * 70_000,
    "ab  cd\n\n" * 9_000,
    "é" * 40_000 + " <|endoftext|> a",
    "<|endoftext|>" * 4_000,
    "　" * 3_000 + "'ll 's \x1c\x1f x",
    "日本語テキスト" * 6_000,
    " " * 40_000 + "a",
    "same text twice",
    "same text twice",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, null and repeated ids, a repeated row, and columns whose names the results use."""
    rows = [(None if i == 3 else i - i % 2, t, i, f"s{i}") for i, t in enumerate([*ODD, ODD[-1]])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(odd, empty, library):
    got = sorted(tuple(r)[1:] for r in token_counts.count_tokens(odd, PATH).collect())
    want = [(len((r.text or "").encode()), len(ids_of(library, r.text))) for r in odd.collect()]
    assert got == sorted((b, n, n > 1024) for b, n in want)
    assert token_counts.count_tokens(empty, PATH).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(40, 4), (64, 1), (300, 16)])
def test_overlapping_chunks_are_spliced(library, chunk, overlap):
    encode = lambda texts: library.encode_batch(texts, add_special_tokens=False)
    draw = random.Random(chunk)
    for _ in range(40):
        text = "".join(draw.choice(["ab", " ", "\n", "  ", "é", "1", "!?", "'s", "<|endoftext|>"]) for _ in range(300))
        assert token_counts.resynchronised_count(encode, text, chunk, overlap) == len(encode([text])[0])


def test_bpe_round_trip(odd, empty, library):
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode_decode(odd, PATH).collect())
    want = []
    for r in odd.collect():
        ids = ids_of(library, r.text)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_chunks.encode_decode(empty, PATH).count() == 0


def test_chunks_are_reused_and_joins_repaired(library, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MASK", 31)
    draw = random.Random(4)
    passage = " ".join(draw.choice(["alpha", "beta,", "ga\nmma", "d'elta", "1234"]) for _ in range(2_000))
    codec = bpe_chunks.Codec(library)
    for text in (passage, "Some other start. " + passage, passage[5:] + "  \n"):
        [(ids, decoded)] = codec.run([text])
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text) and decoded == text
    assert codec.reused > codec.encoded


def removed(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, longest", [(2_000, 64), (2, 5), (0, 64)])
def test_substring_dedup(spark, monkeypatch, hot, longest):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "LONGEST", longest)
    draw = random.Random(hot)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(80)]
    for _ in range(40):
        a = draw.choice(texts).split()
        i = draw.randint(0, max(0, len(a) - 1))
        texts.append("new start " + " ".join(a[i : i + draw.randint(3, 40)]) + " end")
    texts += ["x " * 90, "x " * 30, "p q r " * 20, "", None, texts[2]]
    rows = [(i if i % 5 else None, t, "clash") for i, t in enumerate([*texts, texts[-1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    got = substring_dedup.remove_repeats(df, window=9, anchor=4)
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == removed([r[1] for r in rows], 9)


def test_substring_dedup_of_odd_texts(odd, empty):
    got = substring_dedup.remove_repeats(odd).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed([r.text for r in odd.collect()], 35)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_matching_statistics():
    draw = random.Random(1)
    for _ in range(10):
        texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(6, 60))).encode() for _ in range(20)]
        seen = Counter(tuple(t.split()[i : i + 5]) for t in texts for i in range(len(t.split()) - 4))
        for text, flags in zip(texts, substring_dedup.repeated_windows(texts, np.ones(20, int), 5)):
            words = text.split()
            assert flags.tolist() == [seen[tuple(words[i : i + 5])] > 1 for i in range(len(words) - 4)]


def bag(text):
    w = (text or "").encode().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def alike(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def classes(ids, texts):
    bags, parent = [bag(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(texts)):
        members[find(i)].append(ids[i])
    named = [(min((x for x in members[find(i)] if x is not None), default=None), len(members[find(i)])) for i in range(len(texts))]
    return sorted(((-1 if i is None else i, *n) for i, n in zip(ids, named)), key=str)


def test_near_duplicates(spark, empty):
    draw = random.Random(3)
    words, texts = [f"w{i}" for i in range(40)], []
    for _ in range(25):
        start = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.choice([1, 1, 2, 6])):
            copy = list(start)
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "a " * 10, "a " * 9, texts[0]]
    ids = [None if i == 5 else i for i in range(len(texts))]
    ids[-1] = 0
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, root int").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(((-1 if r[0] is None else r[0], r[1], r[2]) for r in got), key=str) == classes(ids, texts)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len({r[1:] for r in classes(ids, texts)})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_members_of_the_largest_class_are_emitted_once(spark, tmp_path):
    draw = random.Random(5)
    start = [f"w{i}" for i in range(80)]

    def changed(n):
        copy = list(start)
        for i in draw.sample(range(80), n):
            copy[i] = f"x{draw.randrange(10**6)}"
        return " ".join(copy)

    # Alike to the first text by 0.87 or more, and, further off, by about 0.5 to 0.75.
    texts = [" ".join(start), *(changed(1) for _ in range(40)), *(changed(n) for n in (4, 5, 6) for _ in range(4))]
    base, ids = str(tmp_path / "steps"), list(range(len(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = near_dedup.classes(rows, near_dedup.LIKENESS, near_dedup.SHINGLE, base).collect()
    size = Counter(r.root for r in got)
    assert sorted(((r.rid, r.root, size[r.root]) for r in got), key=str) == classes(ids, texts)
    assert max(size.values()) > 40 and len(size) > 4
    written = [spark.read.parquet(str(p)).select("bucket", "rid", "root", "main") for p in (tmp_path / "steps").glob("members*")]
    seen = Counter((r.bucket, r.rid) for df in written for r in df.where("root = main").collect())
    assert seen and set(seen.values()) == {1}


def test_signatures_estimate_weighted_jaccard():
    draw, errors = random.Random(3), []
    words = [f"w{i}" for i in range(40)]
    for share in (20, 60, 120, 180):
        a = [draw.choice(words) for _ in range(200)]
        b = a[:share] + [draw.choice(words) for _ in range(200 - share)] + a[: draw.randint(0, 150)]
        texts = [" ".join(a), " ".join(b)]
        h, t, count = near_dedup.weighted(*near_dedup.runs(pa.array(texts)))
        found = near_dedup.signatures(h, t, count, 2, 2_000)
        errors.append((found[0] == found[1]).mean() - alike(*map(bag, texts)))
    assert max(map(abs, errors)) < 0.05


WORDS = re.compile(r"[^\W_]+")


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_decontamination(spark, odd, empty):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [[draw.choice(words) for _ in range(draw.randint(12, 30))] for _ in range(12)]
    docs = []
    for _ in range(60):
        doc = [draw.choice(words) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.6:
            item = list(draw.choice(items))
            if draw.random() < 0.5:
                item[draw.randrange(len(item))] = "changed"
            at = draw.randint(0, len(doc))
            doc[at:at] = item
        docs.append(doc)
    bench = [(i, " ".join(w).upper() + "!") for i, w in enumerate(items)] + [(98, None), (99, "too short")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    df = spark.createDataFrame([(i, ", ".join(w), 0) for i, w in enumerate(docs)], "doc_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r.likeness for r in decontaminate.find_passages(df, bench).collect()}
    want = {}
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            best = max(alike(shingles(doc[a : a + len(item)]), shingles(item)) for a in range(max(1, len(doc) - len(item) + 1)))
            if best >= 0.8:
                want[i, j] = best
    assert got == pytest.approx(want) and any(v < 1 for v in want.values())
    kept = decontaminate.drop_contaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - {i for i, _ in want} and kept.columns == df.columns
    assert decontaminate.find_passages(odd, bench).count() == 0
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.find_passages(empty, bench).count() == 0


def test_decontamination_finds_windows_that_no_shingle_aligns(spark):
    """The halves of an item swapped, or three parts of it in another order, within other words."""
    item = [f"w{i}" for i in range(90)]
    around = [f"x{i}" for i in range(100)]
    docs = [
        around + item[45:] + item[:45] + around,
        item[45:] + item[:45],
        item[45:] + item[:45] + around,
        around + item[60:] + item[30:60] + item[:30],
        around + item[:40] + around + item[40:],
    ]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.likeness) for r in decontaminate.find_passages(df, bench).collect()}
    want = {}
    for i, doc in enumerate(docs):
        best = max((alike(shingles(doc[a : a + 90]), shingles(item)), -a) for a in range(len(doc) - 89))
        if best[0] >= 0.8:
            want[i] = (-best[1], best[0])
    assert set(want) == {0, 1, 2, 3} and got == {i: (a, pytest.approx(v)) for i, (a, v) in want.items()}


def test_blocks_guarantee_the_radius(spark):
    pairs = spark.range(500).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("noise"), "id")
    flips = F.shiftrightunsigned("noise", 33).bitwiseAND(F.xxhash64("id", F.lit(2)))
    pairs = pairs.select("a", F.col("a").bitwiseXOR(flips).alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= decontaminate.RADIUS)
    blocks = lambda c: decontaminate._blocks(F.col(c), decontaminate.RADIUS)
    assert pairs.count() > 100
    assert pairs.where(~F.arrays_overlap(blocks("a"), blocks("b"))).count() == 0


def test_fingerprints(spark, odd, empty):
    draw = random.Random(2)
    texts = ["\n".join(" ".join(draw.choice("abcdefg") * 4 for _ in range(9)) + "." for _ in range(draw.randint(0, 30))) for _ in range(1_200)]
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]  # by descending id; after the last the first
        k = len(text) // 3
        row = got[3 * i]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    prints = defaultdict(set)
    for i, text in enumerate(texts):
        prints[text].add(got[3 * i].fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({p for v in prints.values() for p in v}) == len(prints)
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.edited_fingerprints(empty).count() == 0
    alone = spark.createDataFrame([(7, "one. two.")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(alone).first().near_next == 1.0


def plain_tree(text):
    """The Merkle tree from its definition."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    paragraphs = []
    for line in (text or "").split("\n"):
        pieces = re.findall(rf"[^.!?]{{1,{fingerprints.PIECE}}}[.!?]*|[.!?]+", line)
        paragraphs.append("".join(md5(p)[:8] for p in pieces))
    nodes = [md5(p) for p in paragraphs]
    step = fingerprints.FANOUT
    sections = [md5("".join(nodes[i : i + step])) for i in range(0, len(nodes), step)]
    return f"{md5(''.join(sections))}:{''.join(s[:16] for s in sections)}:{','.join(paragraphs)}"


def plain_likeness(a, b):
    leaves = lambda x: set(re.findall("[0-9a-f]{8}", x.split(":")[2]))
    x, y = leaves(a), leaves(b)
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


@pytest.mark.parametrize("bucket_rows", [1, 7, 500])
def test_fingerprints_against_brute_force(spark, bucket_rows, monkeypatch):
    """Ids that crowd, one far away, one that a third of the rows share, and rows without any."""
    monkeypatch.setattr(fingerprints, "with_next", functools.partial(fingerprints.with_next, bucket_rows=bucket_rows))
    draw = random.Random(bucket_rows)
    text = lambda: "".join(draw.choice(["word ", "Other. ", "\n", "é! ", "a", "  "]) for _ in range(draw.randrange(120)))
    rows = [(i, text()) for i in range(40)] + [(7, text()) for _ in range(30)] + [(None, text()) for _ in range(10)]
    rows += [(10**15, "far\naway"), (-(2**63), "least"), (2**63 - 1, "most"), (41, None), (42, ""), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = map(plain_tree, (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    got = [tuple(r)[:7] for r in fingerprints.edited_fingerprints(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_need_whole_numbers(spark):
    with pytest.raises(TypeError):
        fingerprints.with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_changed_paragraphs(spark):
    text = "\n".join(f"Paragraph {i}." for i in range(40))
    pair = spark.createDataFrame([(text, text.replace("Paragraph 17.", "Other."))], "a string, b string")
    pair = pair.select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    assert pair.select(fingerprints.changed_paragraphs(F.col("a"), F.col("b"))).first()[0] == [17]


def test_native_operators_run_no_python(spark, odd):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (decontaminate.find_passages(odd, bench), fingerprints.edited_fingerprints(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def labelled(spark, column):
    draw = random.Random(5)
    words, bad = [f"w{i}" for i in range(200)], ["vile", "nasty", "rotten"]
    docs, labels = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(draw.randint(5, 200))]
        odd_one = i % 4 == 0
        if odd_one and column == "toxic":
            at = draw.randint(0, len(text))
            text[at:at] = [draw.choice(bad) for _ in range(5)]
        if not odd_one and column == "quality":
            text = [w + "%%%" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(odd_one)))
    labels += [(None, 1), (700, None), (0, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, f"doc_id long, {column} int"),
    )


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, odd, empty, module, column):
    docs, labels = labelled(spark, column)
    model = module.fit(docs, labels, F.col("doc_id") % 5 != 0)
    rows = module.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= 0.5) == bool(r[column]) for r in rows]) > 0.9
    scores = [r.score for r in module.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert module.score(empty, model).count() == 0
    nothing = module.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in module.score(docs, nothing).select("score").distinct().collect()} <= {0.0, 0.5}


def bags_of(texts, seed=0):
    x, owner = quality.passages(*utf8(pa.array(texts)))
    rng = np.random.default_rng(seed)
    return x.astype(np.float64) + rng.normal(0, 0.1, x.shape), owner, quality._start(rng)


def test_attention_weights_sum_to_one():
    x, owner, p = bags_of(["a b c " * 100, "", "d " * 65])
    assert np.bincount(owner).tolist() == [5, 1, 2]
    p = quality.descend(p, x, owner, np.array([1.0, 0.0, 1.0]), 5)
    _, attention = quality.predict(quality.Model(p, np.zeros(quality.DIM), np.ones(quality.DIM)), x, owner, 3)
    assert np.bincount(owner, attention) == pytest.approx([1, 1, 1])


def plain_score(p, rows):
    """The forward pass of one bag, one passage and one unit after the other."""
    h = [[math.tanh(sum(v * w for v, w in zip(row, p["W"][:, j])) + p["b"][j]) for j in range(quality.HIDDEN)] for row in rows]
    e = []
    for u in h:
        gate = 0.0
        for j in range(quality.GATE):
            t = math.tanh(sum(v * w for v, w in zip(u, p["V"][:, j])))
            gate += p["w"][j] * t / (1 + math.exp(-sum(v * w for v, w in zip(u, p["U"][:, j]))))
        e.append(math.exp(gate))
    z = [sum(a * u[j] for a, u in zip(e, h)) / sum(e) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0]))), [a / sum(e) for a in e]


def test_forward_pass_and_gradient_against_brute_force():
    x, owner, p = bags_of(["a b c " * 100, "", "%% d! " * 70, "x" * 500])
    p["c"] = np.random.default_rng(1).normal(0, 1, quality.HIDDEN)
    y = np.array([1.0, 0.0, 1.0, 0.0])
    scores, attention = quality.predict(quality.Model(p, np.zeros(quality.DIM), np.ones(quality.DIM)), x, owner, 4)
    for i in range(4):
        want, weights = plain_score(p, x[owner == i].tolist())
        assert scores[i] == pytest.approx(want) and attention[owner == i] == pytest.approx(weights)
    loss = lambda: -np.mean(
        [math.log(s if t else 1 - s) for s, t in ((plain_score(p, x[owner == i].tolist())[0], y[i]) for i in range(4))]
    )
    g = quality.gradient(p, x, owner, y)
    draw = random.Random(3)
    for k in p:
        for _ in range(4):
            at = tuple(draw.randrange(n) for n in p[k].shape)
            kept = p[k][at]
            p[k][at] = kept + 1e-5
            up = loss()
            p[k][at] = kept - 1e-5
            down = loss()
            p[k][at] = kept
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-7), (k, at)


def test_a_passage_far_behind_decides_the_label(spark):
    """Texts of 5,000 words; what tells the classes apart stands in one passage from the 33rd on, elsewhere in each text."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        text = [draw.choice(words) for _ in range(5_000)]
        at = 64 * draw.randrange(33, 78)
        if i % 2:
            text[at : at + 64] = ["%%%&&"] * 64
        docs.append((i, " ".join(text)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labels, F.col("doc_id") < 120)
    rows = quality.score(docs, model).join(labels, "doc_id").where("doc_id >= 120").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in rows]) >= 0.95
    assert all(r.top_passage >= 33 for r in rows if r.quality)


def test_learning_does_not_depend_on_how_rows_arrive(spark):
    """And a row that stands often under one id is one row."""
    docs, labels = labelled(spark, "quality")
    more = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1")).repartition(7)
    one, other = (quality.fit(d, labels, F.lit(True)) for d in (docs, more))
    assert all((one.params[k] == other.params[k]).all() for k in one.params)


def twins():
    """Two words of 1024 letters, in the Thue-Morse order and its complement: sums over their bytes collide."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    return ["".join("ab"[x ^ flip] for x in order) for flip in (0, 1)]


def test_words_that_collide_in_sums_are_two_words(spark):
    head, tail = " ".join(f"h{i}" for i in range(20)), " ".join(f"t{i}" for i in range(20))
    texts = [f"{head} {w} {tail}" for w in twins()]
    # One of many words: alike, but not equal.
    long = [f"{head} {tail} {w} {' '.join(f'x{i}' for i in range(80))}" for w in twins()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame(list(enumerate(twins())), "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_duplicates(df).collect()} == {0, 1}
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert {r.class_id for r in rows} == {0} and {r.n_links for r in rows} == {1}
    (a, _), (b, _) = near_dedup.numbered_runs([pa.array([long[0]]), pa.array([long[1]])])
    assert len(set(a.tolist()) & set(b.tolist())) == len(a) - 5


def test_numbered_runs():
    texts = [["a b c d e f a b c d e", "", None, "a b"], ["a b c d e", "b a", "a  b", "a b c d e f"]]
    for size in (1, 2, 3, 5, 7):
        got = near_dedup.numbered_runs([pa.array(t, pa.string()) for t in texts], size)
        names = {}
        for column, (number, text) in zip(texts, got):
            words = [(t or "").split() for t in column]
            want = [(i, tuple(w[j : j + size])) for i, w in enumerate(words) for j in range(max(1, len(w) - size + 1)) if w]
            assert text.tolist() == [i for i, _ in want]
            for n, (_, run) in zip(number.tolist(), want):
                assert names.setdefault(n, run) == run
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("name", ["__rid", "__row", "__spans", "__new", "rid", "root", "class_id"])
def test_columns_of_any_name_are_kept(spark, name):
    texts = ["one two three four five six", "one two three four five six", "mail anna@mail.example.com now please"]
    docs = spark.createDataFrame([(i, t, f"v{i}") for i, t in enumerate(texts)], f"doc_id long, text string, `{name}` string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r[name] for r in kept.collect()} == {"v0", "v2"}
    new, _ = pii.replace_personal_data(docs, b"k")
    assert new.columns == docs.columns and {r[name] for r in new.collect()} == {"v0", "v1", "v2"}


def test_no_surrogate_holds_letters_of_its_value():
    """Letters of any script: none stays in its place, and no run of four comes again."""
    draw = random.Random(2)
    scripts = ["שלוםעולם", "さくらテスト", "مرحبابك", "ελλάδα", "привет", "安全王小明", "한국어말", "नमस्ते", "ქართული", "abcxyz", "ñandú", "ไทยคำ", "ⅷ²"]
    for text in scripts:
        for kind in ("email", "secret", "name-n"):
            for attempt in (0, 1, 5):
                local = "".join(draw.choice(text) for _ in range(6))
                value = f"{local}@{text.lower()}.com" if kind == "email" else local.lower()
                new = pii.surrogate(b"key", kind, value, attempt)
                own, other = value.partition(".com")[0], new.partition(".com")[0]
                assert not any(own[i : i + 4] in other for i in range(len(own) - 3)), (value, new)
                if kind != "name-n":
                    assert not any(a == b and a.isalpha() for a, b in zip(own, other)), (value, new)
    assert pii._like("Ab-1", pii._Draw(b"k", "x"))[2] == "-"


@pytest.mark.parametrize("value", ["192.0.2.7", "198.18.0.5", "198.51.100.9", "203.0.113.200", "127.0.0.1", "10.1.2.3", "172.20.1.1"])
def test_addresses_stay_in_their_block(value):
    block = next(b for b, _ in pii._BLOCKS if pii.ip_address(value) in b)
    for attempt in range(20):
        assert pii.ip_address(pii.surrogate(b"k", "ip", value, attempt)) in block
    assert all(pii.ip_address(s) in block for s in pii.listed(b"k", "ip", value, 0, 200))


@pytest.mark.parametrize(
    "text",
    ["The token: embedding of words", "password: correct, they said", "Dr Who and Mr No", "version 1.2.3.4 is out", "v 1.2.3.4"],
)
def test_plain_prose_is_left_alone(text):
    assert pii.detect(text) == []


def test_names_get_names_of_their_script():
    script = lambda x: {pii.unicodedata.name(c).split()[0] for c in x if c.isalpha()}
    for name in ("anna smith", "иван петров", "γιώργος παπαδόπουλος", "王 小明"):
        assert script(pii.surrogate(b"k", "name-n", name, 0)) == script(name)


def test_toxicity_is_fitted_on_all_segments(spark, monkeypatch):
    """The features the curve is fitted on are those that scoring computes, in texts with many segments."""
    clean, rows = [f"w{j}" for j in range(200)], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join(clean + 20 * (toxic * ["vile"] * 6 + clean)), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen, curve = [], toxicity._curve
    monkeypatch.setattr(toxicity, "_curve", lambda x, y: seen.append((x, y)) or curve(x, y))
    model = toxicity.fit(docs, labels, F.lit(True))
    (x, y), (n, best, parts) = seen[0], toxicity._evidence(model, rows[0][1])
    want, significant = toxicity._features(model, n, best, parts)
    assert len(significant) == 20
    assert (y > 0).any() and x[y > 0] == pytest.approx(np.array([want] * int(y.sum())))


def test_segments_are_the_maximal_ones():
    draw = random.Random(6)
    for _ in range(200):
        n = draw.randint(1, 14)
        scores = [draw.choice([-2.0, -1.0, 1.5, 3.0]) for _ in range(n)]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        line = [s if s > 0 else -0.5 for s in scores]
        want, stack = [], [(0, n)]
        while stack:  # the definition: the best segment, then the same left and right of it
            a, b = stack.pop()
            options = [(sum(line[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not options or max(options)[0] <= 0:
                continue
            total, length, start = max(options)
            want.append((total, -start, -start - length - 1))
            stack += [(a, -start), (-start - length, b)]
        assert sorted(toxicity.segments(hits, 0.5)) == sorted(want)


def test_drop_toxic_keeps_columns(spark, odd):
    kept = toxicity.drop_toxic(odd, toxicity.Model(), 0.5)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_licenses(spark, odd, empty):
    texts = [
        "Released under the MIT License.",
        "Relesed undr the MIT License",
        "GNU General Public License and the gnu general  public-license",
        "Licensed under CC BY-NC 4.0. cc by cc by",
        "This work is licensed under the GNU General Public License, version 3.",
        "submit licenses to mit",
    ]
    got = [licenses.scan(t) for t in texts]
    assert [g["n_base"] for g in got] == [1, 1, 2, 3, 1, 0]
    assert [g["labels"] for g in got] == ["mit,mit-notice", "mit,mit-notice", "gpl", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", ""]
    assert (got[2]["first_word"], got[2]["last_word"], got[5]["first_word"]) == (0, 6, None)
    assert got[1]["spans"][0]["edits"] == 2 and got[1]["spans"][0]["first_word"] == 0
    assert licenses.scan_licenses(odd).count() == odd.count()
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under CC BY-ND 4.0", "cc-by"),
        ("licensed under CC BY 3.0", "cc-by"),
        ("Licensed under the Apache License, Version 1.1", "apache"),
        ("Licensed under the GNU General Public License version 1", "gpl"),
        ("released under the BSD 4-clause license", ""),
        ("subject to the terms of the Mozilla Public License, v. 1.1", ""),
        ("licensd under the Apache Licence, Version 2.0", "apache-2.0"),
        ("licensed under the GNU Affero General Public License version 3", "agpl-3.0"),
        ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: ISC", "isc"),
    ],
)
def test_another_version_or_clause_is_another_licence(text, labels):
    assert licenses.scan(text)["labels"] == labels


def test_notices_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "use of this widget is subject to the acme terms 7"), (2, "MIT License")], "doc_id long, text string")
    rows = {r.doc_id: r.labels for r in licenses.scan_licenses(df, notices={"acme-7": ["subject to the acme terms 7"]}).collect()}
    assert rows == {1: "acme-7", 2: "mit"}


def test_a_megabyte_of_phrases_takes_seconds():
    import time

    began = time.process_time()
    found = licenses.scan("cc by " * 170_000)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (170_000, 0, 339_998)
    assert time.process_time() - began < 5


def test_base_columns_against_brute_force():
    draw = random.Random(8)
    words = "gnu general public license apache cc by mit License BY\u00e9 x ccby".split()
    for _ in range(200):
        text = "".join(draw.choice(words) + draw.choice([" ", "-", ", ", "\n"]) for _ in range(draw.randrange(60)))
        w = [x.lower() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        got = licenses.scan(text)
        assert (got["n_words"], got["n_base"], got["base_labels"]) == (len(w), len(places), ",".join(sorted(labels)))
        assert (got["first_word"], got["last_word"]) == (min(places, default=None), max(places, default=None))


def test_seeds_find_every_notice():
    import regex

    draw, scanner = random.Random(9), licenses.Scanner()
    for label, notice, k, *_ in scanner.patterns:
        for _ in range(20):
            text = list(notice)
            for _ in range(draw.randint(0, k)):
                text[draw.randrange(len(text))] = draw.choice("xyz ")
            text = "before " + "".join(text) + " after"
            brute = regex.search(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}", text)
            # A place whose telling words were edited is none.
            assert (brute is not None and scanner._told(text, notice, *brute.span())) == bool(scanner.notices(text)), text


def test_notices_that_stand_back_to_back():
    """An edited notice is found beside a better one, also where the two only differ by a digit or share letters."""
    gpl = "licensed under the gnu general public license version"
    edited = "lisenced undr the gnu general public license version 3"
    cases = {
        f"{edited} {gpl} 2": [("gpl-3.0", 0), ("gpl-2.0", len(edited) + 1)],
        f"{gpl} 2 {edited}": [("gpl-2.0", 0), ("gpl-3.0", len(gpl) + 3)],
        f"{edited} {gpl} 3 {edited}": [("gpl-3.0", 0), ("gpl-3.0", len(edited) + 1), ("gpl-3.0", len(edited) + len(gpl) + 4)],
        " ".join([edited, f"{gpl} 2"] * 50): [("gpl-3.0", None), ("gpl-2.0", None)] * 50,
    }
    for text, want in cases.items():
        got = [(n[0], n[1]) for n in licenses.Scanner().notices(text)]
        assert [(label, at if w is not None else None) for (label, at), (_, w) in zip(got, want)] == want
        assert len(got) == len(want)
    got = licenses.Scanner().notices(f"{gpl} {gpl} 2")
    assert [(n[0], n[1], n[3]) for n in got] == [("gpl-2.0", len(gpl) + 1, 0)]


def test_surrogates(spark, odd, empty):
    texts = [
        "mail anna.b@mail1.example.com or ANNA.B@mail1.example.com, call +1 (017) 555-7713",
        "phone +1 017 555 7713; host 97.51.17.173; card 4111 1111 1111 1111.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mrs. Erika Muster met Mr. Muster',
        "nothing here, but 12.5 and 3 4 5",
        None,
        "",
    ]
    rows = [(i % 5, t, 7) for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int").repartition(2)
    new, names = pii.replace_personal_data(df, b"key")
    assert new.columns == df.columns and new.count() == df.count()
    out = {r.text for r in new.collect()}
    assert {texts[3], None, ""} <= out
    found = {r.value: r.surrogate for r in names.collect()}
    assert len(set(found.values())) == len(found) and not set(found) & set(found.values())
    first = next(t for t in out if t and t.startswith("mail"))
    low, high = first.split()[1], first.split()[3].rstrip(",")
    assert low == high.lower() and low != "anna.b@mail1.example.com" and low.endswith(".com")
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", first)[0]
    second = next(t for t in out if t and t.startswith("phone"))
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", second.split(";")[0]) != "10175557713"
    assert pii._luhn(re.sub(r"\D", "", second.split("card ")[1]))
    third = next(t for t in out if t and t.startswith("token"))
    assert re.search(r'"[0-9a-f]{40}"', third) and "Muster" not in third
    assert pii.surrogates(odd, b"key").count() == odd.count()
    assert pii.surrogates(empty, b"key").count() == 0


def test_surrogates_stay_distinct_when_they_collide(spark, monkeypatch, tmp_path):
    """With a generator that collides at first, every value still gets one of its own, and no real value."""
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt: "a" if attempt == 0 else f"{value}{attempt}")
    values = spark.createDataFrame([("secret", v) for v in "abcdefgh"], "kind string, value string")
    got = {r.value: r.surrogate for r in pii.assign(values, b"k", str(tmp_path)).collect()}
    assert set(got) == set("abcdefgh") and len(set(got.values())) == 8 and not set(got) & set(got.values())


def test_one_name_has_one_surrogate_with_any_title(spark, monkeypatch, tmp_path):
    texts = [
        "Dr Anna Smith met Mr Boris Brown. Later Anna Smith and ANNA SMITH left; Anna Smithson and brown paper stayed.",
        "Mrs Anna Smith and Prof Anna-Smith",
        "Anna Smith without a form of address in this text",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new, names = pii.replace_personal_data(df, b"key")
    found = {r.value: (r.kind, r.surrogate) for r in names.collect()}
    assert names.count() == 2 and found["anna smith"][0] == "name-f" and found["boris brown"][0] == "name-m"
    out = {r.doc_id: r.text for r in new.collect()}
    own = " ".join(w.capitalize() for w in found["anna smith"][1].split(" "))
    assert out[0].count(own) == 2 and own.upper() in out[0] and "Anna Smith " not in out[0] and "ANNA" not in out[0]
    assert "Anna Smithson and brown paper" in out[0] and out[1] == f"Mrs {own} and Prof {own.replace(' ', '-')}"
    assert out[2] == texts[2]
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt: "a b" if attempt < 2 else f"{value}{attempt}")
    kinds = [("name-m", "c d"), ("name-f", "e f"), ("name-n", "a b"), ("name-f", "g h")]
    values = spark.createDataFrame(kinds, "kind string, value string")
    got = {r.value: r.surrogate for r in pii.assign(values, b"k", str(tmp_path)).collect()}
    assert len(set(got.values())) == 4 and not set(got) & set(got.values())


def test_surrogates_of_dense_kinds(spark, tmp_path):
    """More private addresses than half their block, and every local part of one letter."""
    rows = [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(33_000)]
    rows += [("email", f"{c}@mail.example.com") for c in "abcdefghijklmnopqrstuvwxyz"]
    values = spark.createDataFrame(rows, "kind string, value string")
    got = {r.value: r.surrogate for r in pii.assign(values, b"k", str(tmp_path)).collect()}
    assert set(got) == {v for _, v in rows} and len(set(got.values())) == len(rows) and not set(got) & set(got.values())
    addresses = [s for v, s in got.items() if v.startswith("192.")]
    assert sum(s.startswith("192.168.") for s in addresses) == 65_536 - 33_000
    assert all(s.startswith(("192.168.", "10.")) for s in addresses)


def test_marks_never_drop_a_wanted_row(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("rid"), "id")
    wanted = rows.where("id % 100 = 0").select("rid")
    left = near_dedup.marked(rows, wanted)
    assert left.columns == rows.columns
    assert left.join(wanted, "rid", "left_semi").count() == 200
    assert left.count() < 400
    assert near_dedup.marked(rows, wanted.limit(0)).count() == 0


def test_codec_gives_the_same_after_it_rested():
    codec = bpe_chunks.Codec(Tokenizer.from_file(PATH))
    texts = ["one two three " * 2000, "", "four  five"]
    first = codec.run(texts)
    codec.rest()
    assert not codec.chunks and codec.run(texts) == first


def test_codec_holds_little_beside_its_texts(monkeypatch):
    """A part's text is not held twice, and what finds the chunks works in blocks, also in a very long text."""
    codec = bpe_chunks.Codec(Tokenizer.from_file(PATH))
    texts = ["plain words é 汉 stand here once more, and again", "", "a � b\u0000c d <|endoftext|> e"]
    expected = [codec.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in codec.run(texts)] == expected
    assert [text for _, text in codec.run(texts)] == [codec.library.decode(e, skip_special_tokens=False) for e in expected]
    assert all(isinstance(codec.parts[p], bytes) for p in ("words", "stand", "here"))

    long = "".join(random.Random(5).choices("abcdefgh é汉", k=1_500_000))
    tracemalloc.start()
    cut = codec.cut(["short", long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(cut[1]) == long and len(cut[1]) > 100
    assert peak < 16 * len(long.encode())
    for block in (5_000, 1 << 24):
        monkeypatch.setattr(bpe_chunks, "BLOCK", block)
        assert codec.cut(["short", long]) == cut


def test_parts_that_decode_to_other_text_keep_it():
    codec = bpe_chunks.Codec(Tokenizer.from_file(PATH))
    codec.parts.make = lambda new: [(b"\1\0\0\0", "!") if p == "odd" else codec._make([p])[0] for p in new]
    assert codec.run(["so plain odd words end here"])[0][1] == "so plain! words end here"
