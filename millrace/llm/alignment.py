"""Alignment of the tokens that two tokenizers make of the same text.

Either tokenizer cuts the text, with a space before it, into tokens; the ends of the tokens, as byte offsets, are put into one
dictionary a tokenizer (end to index of the token). The ends in both dictionaries, sorted, slice both lists of ids
into groups; within a group every token of one side is linked with every token of the other. For each pair of ids the
documents that hold it linked are counted over the corpus, and each document learns how many of its links are the
best of their first id.

Both tokenizers begin a new token where a space follows a character that is no white space: the byte-level one by its
pattern (see ``tokens``), the other since none of its pieces holds a space mark behind another character, so that no merge can
reach over. So a text is aligned part by part between such places, and a worker remembers the alignment of parts. A
model with pieces that do reach over is refused.

The pair counts go to all tasks only for the ``SENT_PAIRS`` pairs that most documents hold; links of other pairs, if
there are any, get their counts by a join, where no pair is frequent.

Texts that are null, empty, or that a tokenizer does not give back byte by byte have no tokens: all numbers are 0 and the
digest is empty. Ids may be null or repeated; each row counts as a document and stays one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import map_texts, ship
from millrace.llm.tokens import _AFTER_GAP, _ENDS_SOLID, _SPACE
from millrace.session import fresh_dir

SENT_PAIRS = 1_000_000  # pair counts that are sent to all tasks: 24 MB at most
STORE_PARTS = 300_000  # parts whose alignment a worker remembers
STORE_BYTES = 48 << 20  # and their text and links, about
RUN = 2_000  # parts that are encoded as one text
_SHIFT = 20  # a pair is one number: the first id, and the second one in this many bits

LINKED = (
    "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<long>, times array<int>"
)

_loaded: dict[tuple[str, str], Aligner] = {}


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for their own code; the other bytes, in order, for the characters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_slices(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """The slices of either list between the ends that both lists have."""
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_index.keys() & b_index.keys())
    a_stops, b_stops = [a_index[end] for end in common], [b_index[end] for end in common]
    return list(zip([0, *a_stops], a_stops, [0, *b_stops], b_stops))


class Aligner:
    """Both tokenizers, and the alignments of the parts seen lately.

    The parts known have numbers; for each there are its numbers of tokens, groups and links (``counts``; the first is
    -1 for a part that cannot be given back), its groups as text, how often it was used, and its links in one long array.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        marks = [p.rfind("▁") for p in pieces]
        if any(at > 0 and p[:at].strip("▁") for p, at in zip(pieces, marks)):
            raise ValueError("pieces with a space inside would reach over parts")
        values = byte_values()
        size = self.a.get_vocab_size(with_added_tokens=True)
        if max(size, len(pieces)) >= 1 << _SHIFT:
            raise ValueError("too many ids for one number a pair")
        words = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(values.get(c, 0) for c in w) for w in words]
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes))
        self.names = list(map(str, range(max(size, len(pieces)))))
        # The model puts a space before a text, but not before an empty one.
        self.blank = self.b.encode("x ")[len(self.b.encode("x")) :]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.held = 0

    def _keep_frequent(self) -> None:
        """Make room: of the parts that were used more than once, the most used ones stay, half of the store at most."""
        order = np.argsort(-self.used, kind="stable")[: STORE_PARTS // 2]
        keep = np.sort(order[self.used[order] > 1])
        names = list(self.known)
        texts, counts, first, links, used = self.texts, self.counts, self.first, self.links, self.used
        self._forget()
        n = counts[keep, 3]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[keep], n)
        self.known = {names[i]: j for j, i in enumerate(keep.tolist())}
        self.texts = [texts[i] for i in keep.tolist()]
        self.counts, self.links, self.used = counts[keep], links[place], used[keep] // 2
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.held = sum(map(len, self.known)) + sum(map(len, self.texts)) + 8 * len(self.links)
        if self.held > STORE_BYTES // 2:
            self._forget()

    def _encode(self, parts: list[str], data: list[bytes]) -> tuple[list[int], list[int]] | None:
        """Ids of either side for the parts one after the other; None where the tokens do not give the bytes back."""
        a_ids = self.a.encode_batch_fast(["".join(f" {p}" for p in parts)], add_special_tokens=False)[0].ids
        b = self.b.encode(" ".join(parts)) if parts != [""] else self.blank
        whole = b"".join(data)
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return a_ids, b

    def align(self, parts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each part its numbers of tokens, groups and links and its groups as text, and the links of all.

        Parts are encoded in long runs, one after the other with their spaces, as they may stand in a text; a part that ends in
        white space is encoded by itself, and so are those of a run that does not come back byte by byte. All that do
        are aligned as one text, so one pair of dictionaries serves them.
        """
        data = [f" {part}".encode() for part in parts]
        numbers, texts = np.zeros((len(parts), 4), np.int64), [""] * len(parts)
        numbers[:, 0] = -1
        solid = [i for i, part in enumerate(parts) if _ENDS_SOLID.search(part)]
        alone = sorted(set(range(len(parts))).difference(solid))
        todo = [solid[i : i + RUN] for i in range(0, len(solid), RUN)] + [[i] for i in alone]
        good, a_list, b_list = [], [], []
        while todo:
            run = todo.pop()
            found = self._encode([parts[i] for i in run], [data[i] for i in run])
            if found:
                good += run
                a_list += found[0]
                b_list += found[1]
            elif len(run) > 1:
                todo += [run[: len(run) // 2], run[len(run) // 2 :]]
        if not good:
            return numbers, texts, np.zeros(0, np.int64)
        a_ids, b_ids = np.array(a_list, np.int64), np.array(b_list, np.int64)
        ends = np.cumsum([len(data[i]) for i in good])
        a_ends = np.cumsum(self.a_sizes[a_ids])
        slices = np.array(common_slices(a_ends.tolist(), np.cumsum(self.b_sizes[b_ids]).tolist()), np.int64)
        at, a_stop, bt, b_stop = slices.T
        wide_a, wide_b = a_stop - at, b_stop - bt
        # The ends of parts are common ends, so every group lies within one part.
        stops = np.searchsorted(a_ends[a_stop - 1], ends, "right")
        a_text, b_text = (list(map(self.names.__getitem__, ids)) for ids in (a_list, b_list))
        # The text of a group, for most of one token on either side.
        groups = [f"{a_text[w]}|{b_text[y]}" for w, y in zip(at.tolist(), bt.tolist())]
        for i in np.flatnonzero((wide_a > 1) | (wide_b > 1)).tolist():
            w, x, y, z = slices[i].tolist()
            groups[i] = f"{','.join(a_text[w:x])}|{','.join(b_text[y:z])}"
        n = wide_a * wide_b
        group = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        left, right = np.divmod(within, wide_b[group])
        links = a_ids[at[group] + left] << _SHIFT | b_ids[bt[group] + right]
        # The links in the order of the parts, which is not that of the runs.
        bounds = [0, *stops.tolist()]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        numbers[good] = np.stack([sums(wide_a), sums(wide_b), np.diff(bounds), sums(n)], 1)
        for i, x, y in zip(good, bounds, bounds[1:]):
            texts[i] = ";".join(groups[x:y])
        owner = np.repeat(np.array(good), numbers[good, 3])
        return numbers, texts, links[np.argsort(owner, kind="stable")]

    def learn(self, parts: set[str]) -> None:
        if len(self.texts) > STORE_PARTS or self.held > STORE_BYTES:
            self._keep_frequent()
        new = list(parts.difference(self.known))
        if not new:
            return
        counts, texts, links = self.align(new)
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.texts += texts
        self.held += sum(map(len, new)) + sum(map(len, texts)) + 8 * len(links)
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts[:, 3])])
        self.links = np.concatenate([self.links, links])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def run(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text its numbers and digest, and its links: text, pair and how often."""
        cut = [parts_of(t) for t in texts]
        self.learn(set().union(*cut))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        text = np.repeat(np.arange(len(cut)), [len(parts) for parts in cut])
        self.used += np.bincount(at, minlength=len(self.used))
        bad = np.zeros(len(cut), bool)
        bad[text[self.counts[at, 0] < 0]] = True
        keep = ~bad[text]
        at, text = at[keep], text[keep]
        numbers = np.zeros((len(cut), 4), np.int64)
        np.add.at(numbers, text, self.counts[at])
        digests = [""] * len(cut)
        ends = np.searchsorted(text, np.arange(len(cut) + 1))
        names = list(map(self.texts.__getitem__, at.tolist()))
        for i in np.flatnonzero(numbers[:, 0]).tolist():
            digests[i] = hashlib.sha256(";".join(names[ends[i] : ends[i + 1]]).encode()).hexdigest()
        # Equal parts of a text first, then equal pairs.
        key, times = np.unique(text * len(self.texts) + at, return_counts=True)
        text, at = np.divmod(key, max(1, len(self.texts)))
        n = self.counts[at, 3]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
        text, pair, times = np.repeat(text, n), self.links[place], np.repeat(times, n)
        order = np.lexsort((pair, text))
        text, pair, times = text[order], pair[order], times[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
        lead = np.flatnonzero(new)
        total = np.add.reduceat(times, lead) if len(lead) else times
        return numbers, digests, text[lead], pair[lead], total


def parts_of(text: str) -> list[str]:
    """The text cut before each space that follows a character that is no white space, without these spaces."""
    if not text:
        return []
    spaced = " " + text
    return _SPACE.split(spaced[1:]) if _AFTER_GAP.search(spaced) else text.split(" ")


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its numbers, its digest, and the distinct pairs linked in it with how often each is."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        numbers, digests, text, pair, times = aligner(a_path, b_path).run(batch.column(1).to_pylist())
        offsets = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        columns = [batch.column(0), *(pa.array(c) for c in numbers.T), pa.array(digests, pa.string())]
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())))
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], run, LINKED.replace("doc_id string", f"doc_id {kind}"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, n_docs, best``: the documents that hold a pair linked, and whether that is its first id's most."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.withColumn("a_id", F.shiftright("pair", _SHIFT)).withColumn("b_id", F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sent_pairs: int = SENT_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their numbers, and the table of ``pair_counts``.

    The documents' pairs are written to the shared folder once, so the texts are tokenized once.
    """
    spark = docs.sparkSession
    ship(spark)
    base = fresh_dir(spark, "alignment")
    linked(docs, a_path, b_path, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()).write.parquet(f"{base}/linked")
    rows = spark.read.parquet(f"{base}/linked")
    pair_counts(rows).write.parquet(f"{base}/counts")
    counts = spark.read.parquet(f"{base}/counts")
    # Levels of frequency, from the top, as long as their pairs are few enough to be sent.
    level = F.floor(F.log2("n_docs")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    totals = list(accumulate(r.n for r in sizes))
    fits = [r.level for r, total in zip(sizes, totals) if total <= sent_pairs]
    rest = len(fits) < len(sizes)
    frequent = counts.where(level >= (fits[-1] if fits else 64)).select("pair", "n_docs", "best").toArrow()
    pair, n_docs = (frequent.column(i).to_numpy() for i in (0, 1))
    best = np.array(frequent.column(2).to_pylist(), bool)
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order], n_docs[order], best[order]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"rid long, doc_id {kind}, {', '.join(f'{c} long' for c in numbers)}, n_best long, count_sum long"
    schema += ", groups_sha256 string, rare array<long>, rare_times array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held_by, is_best = sent.value
        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            text = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            pair, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            place = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            found = known[place] == pair if len(known) else np.zeros(len(pair), bool)
            of, place, often = text[found], place[found], times[found]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], of[is_best[place]], often[is_best[place]])
            np.add.at(sums[1], of, often * held_by[place])
            offsets = pa.array(np.searchsorted(text[~found], np.arange(batch.num_rows + 1)), pa.int32())
            rare = pa.ListArray.from_arrays(offsets, pa.array(pair[~found], pa.int64()))
            rare_times = pa.ListArray.from_arrays(offsets, pa.array(times[~found], pa.int32()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("rid", "doc_id", *numbers)]
            columns += [pa.array(s) for s in sums]
            columns += [batch.column(batch.schema.get_field_index("groups_sha256")), rare, rare_times]
            names = ["rid", "doc_id", *numbers, "n_best", "count_sum", "groups_sha256", "rare", "rare_times"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(count, schema)
    if rest:
        out.write.parquet(f"{base}/counted")
        out = spark.read.parquet(f"{base}/counted")
        rare = out.select("rid", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(
            "rid", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("often")
        )
        more = rare.join(counts.select("pair", "n_docs", "best"), "pair").groupBy("rid")
        more = more.agg(
            F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
            F.sum(F.col("often") * F.col("n_docs")).alias("more_sum"),
        )
        out = out.join(more, "rid", "left")
        for total, part in (("n_best", "more_best"), ("count_sum", "more_sum")):
            out = out.withColumn(total, F.col(total) + F.coalesce(part, F.lit(0)))
    return out.select("doc_id", *numbers, "n_best", "count_sum", "groups_sha256"), counts.drop("pair")
