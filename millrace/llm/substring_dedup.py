"""Exact removal of long repeated passages, with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words. Every window has an anchor, the ``ANCHOR``-word run in it with
the smallest hash; equal windows have equal anchors. A maximal run of windows with one anchor place makes a
segment, so a text turns into few segments, and two equal windows always lie in segments of one
anchor. That gives the shards: a shard holds all segments of its anchors.

Segments whose anchor stands in one place only hold no repeated window and are set aside. Equal segments of an anchor are
folded into one with a count; if the anchor has no other segment, they are repeated whole. The segments that are
left are dealt to shards. A shard numbers its words, builds the
suffix array, keeps the Burrows-Wheeler transform in a wavelet tree of bit vectors with rank samples, and
streams its segments through backward search, from the right end: the matching statistic of a place is the length
of the longest run of words that starts there and also stands elsewhere. Windows whose statistic reaches
``WINDOW``, or whose segment was folded from several, are reported as intervals of their texts.

An anchor with more than ``HOT`` different segments is not put into one shard. Its windows become
segments of one window each, with the hash of the window as their anchor, so they spread
over all shards, and equal ones fold into one row before they get there.

Segments and windows are folded by a cryptographic digest of their words, and shards compare the words themselves; the
hashes of words only choose anchors. So different texts are never taken for equal.

Null and empty texts have no words. Texts shorter than a window keep all words. Repeated rows are repeated
texts, and each gets a row of its own; ``doc_id`` may be null or repeated. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import gram_hash, hash_words, map_texts, release, ship, slices, split_words, utf8, words
from millrace.session import fresh_dir, scratch

WINDOW = 35
ANCHOR = 6
LONGEST = 64  # windows in a segment
HOT = 2_000  # different segments of one anchor
SHARD_WORDS = 1 << 19  # words in a shard, on average
KEY = ["doc_id", "h"]  # names a row: its id and a hash of its text


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(word_hash: np.ndarray, heads: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts whose words begin at ``heads``.

    Text, first word in the text, number of words, anchor hash, and whether the anchor recurs, of each.
    """
    none = np.zeros(0, np.int64)
    if len(word_hash) < window:
        return none, none, none, none.view(np.uint64), none.view(bool)
    grams = gram_hash(word_hash, anchor)
    span = window - anchor + 1
    low = _minimum(grams, span)  # by the first word of a window
    lengths = np.diff(heads)
    counts = np.maximum(0, lengths - window + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    low = low[first + heads[:-1][text]]
    # Windows next to one another with the same anchor hash make a segment. Where an anchor recurs
    # within a window the segment is only longer, and still holds every window of that anchor there.
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(text)))
    parts = -(-sizes // LONGEST)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(begin, parts) + within * LONGEST
    n_windows = np.minimum(np.repeat(sizes, parts) - within * LONGEST, LONGEST)
    # Two windows of one segment can be equal only where its anchor stands twice in it.
    inside = n_windows + span - 1
    head = np.cumsum(inside) - inside
    place = np.arange(inside.sum()) + np.repeat(first[at] + heads[:-1][text[at]] - head, inside)
    hits = np.add.reduceat(grams[place] == np.repeat(low[at], inside), head, dtype=np.int64) if len(at) else none
    return text[at], first[at], n_windows + window - 1, low[at], hits > 1


def digest(found: list[bytes]) -> bytes:
    """Names a run of words: runs with equal digests are taken for equal, so it is a cryptographic one."""
    return hashlib.blake2b(b" ".join(found), digest_size=16).digest()


def find_segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``doc_id, h, first, n, anchor, digest, recurs`` of the segments of all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, heads = split_words(batch.column(2))
        text, first, n, low, recurs = anchors(hash_words(found), heads, window, anchor)
        at = heads[:-1][text] + first
        digests = [digest(found[a:b]) for a, b in zip(at.tolist(), (at + n).tolist())]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(text)),
                batch.column(1).take(pa.array(text)),
                pa.array(first.astype(np.int32)),
                pa.array(n.astype(np.int32)),
                pa.array(low.view(np.int64)),
                pa.array(digests, pa.binary()),
                pa.array(recurs),
            ],
            [*KEY, "first", "n", "anchor", "digest", "recurs"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h long, first int, n int, anchor long, digest binary, recurs boolean"
    return map_texts(docs, [*KEY, "text"], run, schema)


class WaveletTree:
    """Rank of any symbol in a sequence of small numbers, by bit vectors with sampled counts."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.words: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, np.uint8)), bitorder="little").view(np.uint64)
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.words.append(packed)
            self.ranks.append(ones)
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

        # Where the places of each symbol begin after the last level.
        self.origin = np.zeros(symbols, np.int64)
        self.origin = self._descend(np.arange(symbols), self.origin)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ranks[k][word] + np.bitwise_count(below)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` stands before place ``at[i]``."""
        return self._descend(symbol, at) - self.origin[symbol]


class FMIndex:
    """Backward search over texts that are joined with separators."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """``symbols`` are numbers from 1; 0 separates. Suffixes are told apart up to ``depth`` words."""
        n = len(symbols)
        rank = symbols.astype(np.int64)
        length = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - length)] = rank[length:] + 1
            key = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            step = np.zeros(n, np.int64)
            np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
            rank = np.empty(n, np.int64)
            rank[order] = step
            length *= 2
            if length >= depth or step[-1] == n - 1:
                break
        self.n = n
        self.size = int(symbols.max()) + 1
        self.less = np.searchsorted(np.sort(symbols), np.arange(self.size + 1))
        self.tree = WaveletTree(symbols[order - 1], self.size)
        # Length of the common start of neighbours in the order, up to depth: lets a match drop its last words.
        self.common = self._common(symbols, order, depth)
        self.edges: dict[int, np.ndarray] = {}

    @staticmethod
    def _common(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
        n = len(symbols)
        padded = np.append(symbols, np.zeros(depth + 1, symbols.dtype))
        common = np.zeros(n + 1, np.int32)
        left, right = order[:-1], order[1:]
        alive = np.arange(n - 1)
        for k in range(depth):
            a, b = padded[left[alive] + k], padded[right[alive] + k]
            alive = alive[(a == b) & (a != 0)]
            if not len(alive):
                break
            common[alive + 1] = k + 1
        return common

    def _widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share ``depth`` words with those from ``low`` up to ``high``."""
        low, high = low.copy(), high.copy()
        for d in np.unique(depth).tolist():
            if d not in self.edges:
                self.edges[d] = np.flatnonzero(self.common < d)
            edges, of = self.edges[d], depth == d
            low[of] = edges[np.searchsorted(edges, low[of], "right") - 1]
            high[of] = edges[np.searchsorted(edges, high[of], "left")]
        return low, high

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        n = len(symbol)
        both = np.tile(self.less[symbol], 2) + self.tree.rank(np.tile(symbol, 2), np.concatenate([low, high]))
        return both[:n], both[n:]

    def repeated(self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each query, from its start up to its end, stands twice at least."""
        out = np.ones(len(starts), bool)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        at = ends - 1
        live = np.flatnonzero(at >= starts)
        while len(live):
            low[live], high[live] = self._extend(queries[at[live]], low[live], high[live])
            out[live] = high[live] - low[live] >= 2
            at[live] -= 1
            live = live[out[live] & (at[live] >= starts[live])]
        return out

    def matching_statistics(self, queries: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
        """For each word of the queries the longest run from there, up to ``most``, that stands twice at least.

        ``ends`` are the ends of the queries in ``queries``, which come from the indexed texts themselves. All
        queries advance together, one word to the left at a time.
        """
        out = np.zeros(len(queries), np.int32)
        starts = np.append(0, ends[:-1])
        at = ends - 1
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        depth = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(at >= starts)
        while len(live):
            pending = live
            while len(pending):
                new_low, new_high = self._extend(queries[at[pending]], low[pending], high[pending])
                good = new_high - new_low >= 2
                hit = pending[good]
                low[hit], high[hit] = new_low[good], new_high[good]
                depth[hit] += 1
                rest = pending[~good]
                # No longer run of words stands twice: drop words at the right end, as few as change the interval.
                none = depth[rest] == 0
                zero = rest[none]
                low[zero], high[zero] = 0, self.n
                rest = rest[~none]
                if len(rest):
                    shorter = np.maximum(self.common[low[rest]], self.common[high[rest]]).astype(np.int64)
                    shorter = np.minimum(shorter, depth[rest] - 1)
                    depth[rest] = shorter
                    empty = shorter == 0
                    low[rest[empty]], high[rest[empty]] = 0, self.n
                    some = rest[~empty]
                    if len(some):
                        low[some], high[some] = self._widen(low[some], high[some], depth[some])
                pending = rest
            full = live[depth[live] > most]
            if len(full):
                # Longer runs need not be told apart: keep the first words only.
                depth[full] = most
                low[full], high[full] = self._widen(low[full], high[full], depth[full])
            out[at[live]] = depth[live]
            at[live] -= 1
            live = live[at[live] >= starts[live]]
        return out


def repeated_windows(texts: list[bytes], copies: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment which of its windows stand twice at least among all segments and their copies."""
    names: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    symbols = [np.array([names.setdefault(w, len(names) + 1) for w in own], np.int64) for own in split]
    joined = np.concatenate([x for own in symbols for x in (own, np.zeros(1, np.int64))])
    index = FMIndex(joined, window + 1)
    flags = [np.ones(len(own) - window + 1, bool) for own in symbols]
    ask = np.flatnonzero(copies == 1)  # windows of a folded segment stand in all its copies
    if len(ask):
        sizes = np.array([len(symbols[i]) for i in ask])
        ends = np.cumsum(sizes)
        starts, queries = ends - sizes, np.concatenate([symbols[i] for i in ask])
        # Where the words that all windows of a segment share do not stand twice, no window does.
        count = sizes - window + 1
        hope = index.repeated(queries, starts + np.minimum(count - 1, window), starts + window)
        for i in ask[~hope].tolist():
            flags[i][:] = False
        ask, sizes = ask[hope], sizes[hope]
    if len(ask):
        ends = np.cumsum(sizes)
        found = index.matching_statistics(np.concatenate([symbols[i] for i in ask]), ends, window)
        for i, end in zip(ask.tolist(), ends.tolist()):
            flags[i] = found[end - len(symbols[i]) : end - window + 1] >= window
    return flags


def _search(window: int):
    """One shard: its folded segments in, the repeated intervals of each out."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows([bytes(t) for t in shard["words"]], shard["copies"].to_numpy(), window)
        rows = []
        for anchor, name, flags in zip(shard["anchor"].tolist(), shard["digest"].tolist(), found):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                rows.append((anchor, name, a, b - 1 + window))
        return pd.DataFrame(rows, columns=["anchor", "digest", "start", "stop"])

    return run


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def _cut(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of wanted segments; a segment of a hot anchor gives one row for each window, at its offset."""
    ship(rows.sparkSession)
    whole, name = pa.int64(), pa.binary()
    kinds = {"anchor": whole, "digest": name, "copies": whole, "offset": whole, "window": name, "words": name}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, offsets = utf8(part.column(1))
                starts, ends, heads = words(raw, offsets)
                data, out = raw.tobytes(), []
                for head, own in zip(heads.tolist(), part.column(0).to_pylist()):
                    for s in own:
                        base, key = head + s["first"], (s["anchor"], s["digest"], s["copies"])
                        text = data[starts[base] : ends[base + s["n"] - 1]]
                        if not s["hot"]:
                            out.append((*key, 0, None, text))
                            continue
                        found = text.split()
                        for i in range(len(found) - window + 1):
                            single = found[i : i + window]
                            out.append((*key, i, digest(single), b" ".join(single)))
                columns = list(zip(*out)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))
        release()

    struct = F.struct("first", "n", "anchor", "digest", "copies", "hot")
    own = wanted.groupBy(*KEY).agg(F.collect_list(struct).alias("own"))
    joined = rows.join(own, _same(rows, own)).select(own["own"], rows["text"])
    return joined.mapInArrow(run, "anchor long, digest binary, copies long, offset long, window binary, words binary")


def repeated_intervals(rows: DataFrame, window: int, anchor: int, base: str) -> DataFrame:
    """``doc_id, h, spans`` of the rows that hold repeated windows; tables between the steps go below ``base``."""
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    segments = kept(find_segments(rows, window, anchor), "segments")
    places = F.sum(F.when(F.col("recurs"), 2).otherwise(1))
    twice = segments.groupBy("anchor").agg(places.alias("places")).where("places > 1").select("anchor")
    segments = kept(segments.join(twice, "anchor").drop("recurs"), "repeated")
    folded = segments.groupBy("anchor", "digest").agg(
        F.count("*").alias("copies"), F.min_by(F.struct(*KEY, "first", "n"), F.col("h")).alias("one")
    )
    kinds = folded.groupBy("anchor").agg(F.count("*").alias("kinds"))
    folded = kept(
        folded.join(kinds, "anchor").select(
            "one.*", "anchor", "digest", "copies", "kinds", (F.col("kinds") > HOT).alias("hot")
        ),
        "folded",
    )
    # Copies of a segment that nothing else shares an anchor with need no search.
    alone = (F.col("kinds") == 1) & (F.col("copies") > 1)
    copied = folded.where(alone).select("anchor", "digest", F.lit(0).alias("start"), F.col("n").alias("stop"))
    folded = folded.where(~alone)
    words_of = F.when(F.col("hot"), (F.col("n") - window + 1) * window).otherwise(F.col("n")).cast("long")
    total, any_hot = folded.agg(F.sum(words_of), F.max("hot")).first()
    pieces = kept(_cut(rows, folded, window), "pieces")
    plain = pieces.where("window is null").select("anchor", "digest", "copies", "words")
    if any_hot:
        single = pieces.where("window is not null")
        again = single.groupBy("window").agg(F.sum("copies").alias("copies"), F.min("words").alias("words"))
        plain = plain.unionByName(
            again.where("copies > 1").select(
                F.xxhash64("window").alias("anchor"), F.col("window").alias("digest"), "copies", "words"
            )
        )
    shards = max(1, -(-(total or 0) // SHARD_WORDS))
    found = kept(
        plain.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(
            _search(window), "anchor long, digest binary, start int, stop int"
        ),
        "found",
    )
    if any_hot:
        # A window found for its own sake is brought back to the segments that hold it.
        again = found.where(F.col("anchor") == F.xxhash64("digest")).select(F.col("digest").alias("window")).distinct()
        back = single.join(again, "window")
        back = back.select(
            "anchor", "digest", F.col("offset").cast("int").alias("start"), (F.col("offset") + window).cast("int").alias("stop")
        )
        found = found.unionByName(back)
    found = found.unionByName(copied)
    placed = segments.join(found, ["anchor", "digest"]).select(
        *KEY, (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")
    )
    return placed.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept, spans`` for every row; spans are removed words."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and at most as many as a window")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    spark = docs.sparkSession
    spans = fresh_dir(spark, "repeats")
    with scratch(spark):  # the tables between are removed
        repeated_intervals(rows, window, anchor, fresh_dir(spark, "substring-dedup")).write.parquet(spans)
    found = spark.read.parquet(spans)
    joined = rows.join(found, _same(rows, found), "left").select(rows["doc_id"], found["spans"], rows["text"])

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept, spans = [], [], [], []
        for own, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found, merged = text.encode().split(), []
            for a, b in sorted((s["start"], s["stop"]) for s in own or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            n.append(len(found))
            gone.append(sum(b - a for a, b in merged))
            for a, b in reversed(merged):
                del found[a:b]
            kept.append(b" ".join(found).decode())
            spans.append([{"start": a, "stop": b} for a, b in merged])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:int,stop:int>>"
    return map_texts(joined, ["doc_id", "spans", "text"], remove, schema)
