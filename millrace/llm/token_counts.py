"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

A text over ``CHUNK`` characters is cut into chunks that overlap. Both chunks encode the
overlap, with offsets. The splice goes where both have a token boundary at one and the same
character that is also stable (see ``tokens``): what stands left of it is then counted from the left
chunk, the rest from the right one. Where the overlap holds no such place, it is widened,
up to the whole text. Shorter texts are one chunk; their parts between stable boundaries are
encoded once per worker, since words recur.

Null and empty texts have 0 bytes and 0 tokens. Columns other than id and text are ignored;
repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrow import map_texts
from millrace.llm.tokens import BOUNDARY, Memo, encode_parts, offsets, split, tokenizer

CHUNK = 32_768  # characters
OVERLAP = 256  # characters at first
_memos: dict[str, Memo] = {}


def _token_ends(spans: np.ndarray, place: int) -> int | None:
    """How many tokens end up to ``place``, if none of them crosses it."""
    before = int(np.searchsorted(spans[:, 1], place, "right"))
    if before < len(spans) and spans[before, 0] < place:
        return None
    return before


def resynchronised_count(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of ``text``; ``encode`` takes a list of texts."""
    if len(text) <= chunk:
        return len(encode([text])[0])
    spans = [(a, min(len(text), a + chunk)) for a in range(0, len(text) - overlap, chunk - overlap)]
    total, left, kept_from = 0, None, 0
    # The chunks of one text are encoded a few at a time, so that memory does not grow with it.
    for first in range(0, len(spans), 16):
        part = spans[first : first + 16]
        for (a, b), encoding in zip(part, encode([text[a:b] for a, b in part])):
            right = (a, b, offsets(encoding))
            if left is None:
                left = right
                continue
            while True:
                splice = _splice(text, left, right, kept_from)
                if splice:
                    place, before = splice
                    total += before - _token_ends(left[2], kept_from - left[0])
                    left, kept_from = right, place
                    break
                # No common stable boundary: the left chunk reaches twice as far, over more of the right one.
                end = min(len(text), 2 * left[1] - left[0])
                if end > left[1]:
                    left = (left[0], end, offsets(encode([text[left[0] : end]])[0]))
                elif left[1] >= right[1]:
                    break
                if left[1] >= right[1] and not _splice(text, left, right, kept_from):
                    break  # it covers the right chunk whole, which is not needed then
    return total + len(left[2]) - _token_ends(left[2], kept_from - left[0])


def _splice(text: str, left: tuple, right: tuple, kept_from: int) -> tuple[int, int] | None:
    """The first stable place where both chunks end a token, and the tokens of the left one up to it."""
    low, high = max(right[0], kept_from), min(left[1], right[1])
    for match in BOUNDARY.finditer(text, low + 1, high) if high > low else ():
        place = match.start()
        before = _token_ends(left[2], place - left[0])
        if before is not None and _token_ends(right[2], place - right[0]) is not None:
            return place, before
    return None


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``path`` names a tokenizers file."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        library = tokenizer(path)
        if path not in _memos:
            _memos[path] = Memo(lambda new: map(len, encode_parts(library, new)))
        memo, texts = _memos[path], batch.column(1).to_pylist()
        parts = [split(t) if len(t) <= CHUNK else [""] for t in texts]
        heads = library.encode_batch_fast([p[0] for p in parts], add_special_tokens=False)
        parts = [p[1:] for p in parts]
        memo.learn(parts)
        known = memo.__getitem__
        n = [
            len(head) + sum(map(known, p))
            if len(t) <= CHUNK
            else resynchronised_count(lambda c: library.encode_batch(c, add_special_tokens=False), t)
            for t, head, p in zip(texts, heads, parts)
        ]
        n_bytes = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_bytes, pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([k > limit for k in n], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col, text_col], count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
