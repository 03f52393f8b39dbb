"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last bytes of a text decides where chunks end, so equal passages are
cut alike in whatever document they stand. A worker encodes each distinct chunk once (a
bounded memo) and keeps, of its tokens, those between its first and last stable boundary (see
``tokens``): they are the same whatever the neighbours are. What lies between the stable parts of two chunks
is encoded anew, together with a part of known tokens on either side; if the
known tokens do not come out again, the join is widened until they do. Reuse is per
worker: sharing chunks over the whole cluster would mean shuffling every text and its tokens.

Null and empty texts encode to no tokens. Extra columns are ignored, repeated rows stay.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrow import map_texts, mix, prefix_hash, range_hash, utf8
from millrace.llm.tokens import Memo, encode_parts, split, tokenizer

WINDOW = 48  # bytes the rolling hash looks at
MASK = (1 << 12) - 1  # a chunk ends where these bits of the hash are 0: every 4096 bytes on average
STAY = 100_000  # parts that a worker remembers from one task to the next
BLOCK = 1 << 17  # bytes hashed at once; the arrays for it take about 70 times as much
CHUNK_BYTES = 4 << 20  # text of the chunks a worker remembers


def _ids(known: bytes | tuple[bytes, str]) -> bytes:
    return known if isinstance(known, bytes) else known[0]


def _decoded(part: str, known: bytes | tuple[bytes, str]) -> str:
    return " " + part if isinstance(known, bytes) else known[1]


def _ends(raw: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where, from ``start`` up to ``stop``, the hash of the bytes before ends a chunk."""
    own = raw[start - WINDOW : stop]
    ends = np.arange(WINDOW, len(own))
    return ends[(mix(range_hash(prefix_hash(own), ends - WINDOW, ends)) & np.uint64(MASK)) == 0] + (start - WINDOW)


class Codec:
    """Encodes and decodes texts with one tokenizer, reusing chunks."""

    def __init__(self, library):
        self.library = library
        self.parts = Memo(self._make)
        self.chunks: dict[str, tuple] = {}
        self.joins: dict[tuple, tuple[bytes, str]] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def _make(self, new: list[str]):
        ids = encode_parts(self.library, new)
        texts = self.library.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
        # The decoded text takes memory of its own only where it is not the part again.
        return [i.tobytes() if t == " " + p else (i.tobytes(), t) for p, i, t in zip(new, ids, texts)]

    def rest(self) -> None:
        """Give memory back between tasks, for other operators in the same worker; some parts stay known."""
        self.chunks.clear()
        self.joins.clear()
        self.parts.old.clear()
        if len(self.parts) > STAY:
            # What was learnt first is what most texts hold.
            stay = dict(islice(self.parts.items(), STAY))
            self.parts.clear()
            self.parts.update(stay)
        self.held = 0

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text; joined they are the text."""
        column = pa.array(texts, pa.large_string())
        raw, offsets = utf8(column)
        hits = np.concatenate([np.zeros(0, np.int64), *(_ends(raw, a, a + BLOCK) for a in range(WINDOW, len(raw), BLOCK))])
        hits = hits[(raw[hits] & 0xC0) != 0x80]  # not within a character
        out = []
        for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
            inner = hits[np.searchsorted(hits, a + WINDOW) : np.searchsorted(hits, b)] - a
            if not len(inner):
                out.append([text] if text else [])
                continue
            data = text.encode()
            bounds = [0, *inner.tolist(), len(data)]
            out.append([data[x:y].decode() for x, y in zip(bounds, bounds[1:])])
        return out

    def learn(self, chunks: list[list[str]]) -> None:
        """Encode the chunks that are not known yet."""
        if self.held > CHUNK_BYTES:
            self.chunks.clear()
            self.joins.clear()
            self.held = 0
        seen = [c for one in chunks for c in one]
        new = {c for c in seen if c not in self.chunks}
        self.encoded += len(new)
        self.reused += len(seen) - len(new)
        cut = {chunk: split(chunk) for chunk in new}
        self.parts.learn([parts[1:-1] for parts in cut.values()])
        known = self.parts
        for chunk, parts in cut.items():
            body = parts[1:-1]
            found = [known[p] for p in body]
            if {bytes}.issuperset(map(type, found)):
                inner = (b"".join(found), "".join([" " + p for p in body]))
            else:
                inner = (b"".join(map(_ids, found)), "".join(map(_decoded, body, found)))
            tail = " " + parts[-1] if len(parts) > 1 else ""
            self.chunks[chunk] = (parts[0], body[:1], body[-1:], tail, inner)
            self.held += len(chunk)

    def _join(self, left: str | None, gap: str, right: str | None) -> tuple[bytes, str]:
        """The tokens of ``gap`` between two chunks; widened until known parts beside it come out unchanged."""
        width, whole = 1, False
        while True:
            if width == 1:
                before = self.chunks[left][2] if left else []
                after = self.chunks[right][1] if right else []
            else:
                before = split(left)[1:-1] if left else []
                after = split(right)[1:-1] if right else []
                whole = width >= max(len(before), len(after))
                before, after = before[-width:], after[:width]
                self.parts.learn([before, after])
            sure = [b"".join(self._known(p) for p in side) for side in (before, after)]
            ids = self._encode("".join(f" {p}" for p in before) + gap + "".join(f" {p}" for p in after))
            stop = len(ids) - len(sure[1])
            if stop >= len(sure[0]) and ids.startswith(sure[0]) and ids.endswith(sure[1]):
                ids = ids[len(sure[0]) : stop]
                return ids, self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
            if whole:
                raise AssertionError("stable boundaries do not hold for this tokenizer")
            width *= 2

    def _known(self, part: str) -> bytes:
        if part not in self.parts:
            self.parts.learn([[part]])
        return _ids(self.parts[part])

    def run(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Token ids (little-endian, 32 bits) and decoded text of each text."""
        cut = self.cut(texts)
        self.learn(cut)
        return [self._assemble(chunks) for chunks in cut]

    def _assemble(self, chunks: list[str]) -> tuple[bytes, str]:
        ids, texts = [], []
        left, gap = None, ""
        for chunk in [*chunks, None]:
            head, first, _, tail, inner = self.chunks[chunk] if chunk else ("", [], [], "", (b"", ""))
            gap += head
            if chunk and not first:
                gap += tail  # no stable part in this chunk: the join reaches over it
                continue
            if gap:
                key = (gap, *(self.chunks[left][2] if left else []), None, *first)
                if key not in self.joins:
                    self.joins[key] = self._join(left, gap, chunk)
                    self.held += 4 * len(gap)
                ids.append(self.joins[key][0])
                texts.append(self.joins[key][1])
            ids.append(inner[0])
            texts.append(inner[1])
            left, gap = chunk, tail
        return b"".join(ids), "".join(texts)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(tokenizer(path))
    return _codecs[path]


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and the ``outputs`` asked for: ``ids``, ``decoded``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec(path).run(batch.column(1).to_pylist())
        ids = [f[0] for f in found]
        columns = [
            batch.column(0),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if "ids" in outputs:
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]])
            flat = np.frombuffer(b"".join(ids), "<i4")
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
            names.append("ids")
        if "decoded" in outputs:
            columns.append(pa.array([f[1] for f in found], pa.string()))
            names.append("decoded")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ("ids" in outputs) + ", decoded string" * ("decoded" in outputs)
    return map_texts(docs, [id_col, text_col], run, schema, lambda: codec(path).rest())
