"""What the token operators share: a tokenizer per worker, and boundaries that no token crosses.

A byte-level BPE tokenizer first splits a text with a pattern that looks ahead by one
character and never back. None of its alternatives goes on from a character that is no
white space to one that is, so a place between the two always ends a token, and the
tokens on either side depend on their own side alone. The same holds for added tokens
without white space in them.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

# Python counts \x1c-\x1f as white space, the tokenizer does not.
_SOLID = r"[\S\x1c-\x1f]"
BOUNDARY = re.compile(f"(?<={_SOLID})(?= )")
_SPACE = re.compile(f"(?<={_SOLID}) ")
_AFTER_GAP = re.compile(r"\s ")
_ENDS_SOLID = re.compile(f"{_SOLID}\\Z")
MEMO_ENTRIES = 300_000  # parts in each of the two generations that a worker remembers
_BULK = 2_000  # parts that are encoded as one text

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer at ``path``, loaded once in each worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        if any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in loaded.get_added_tokens_decoder().values()):
            raise ValueError("added tokens with white space would cross the boundaries")
        _loaded[path] = loaded
    return _loaded[path]


def split(text: str) -> list[str]:
    """The text cut at its stable boundaries before a space; every part but the first lacks that space."""
    return _SPACE.split(text) if _AFTER_GAP.search(text) else text.split(" ")


def encode_parts(library, parts: list[str]) -> list[np.ndarray]:
    """The ids of each part with a space before it; parts stand one after the other in a few long texts."""
    out: list[np.ndarray | None] = [None] * len(parts)
    bulk = [i for i, p in enumerate(parts) if _ENDS_SOLID.search(p)]
    for first in range(0, len(bulk), _BULK):
        run = bulk[first : first + _BULK]
        # One after the other: an encoding takes many times the memory of its text.
        encoding = library.encode("".join(" " + parts[i] for i in run), add_special_tokens=False)
        starts = np.cumsum([0, *(len(parts[i]) + 1 for i in run)])
        # A token may leave its white space out of its offsets, but never reaches into the next part.
        at = np.searchsorted(offsets(encoding)[:, 0], starts)
        ids = np.array(encoding.ids, "<u4")
        for i, a, b in zip(run, at.tolist(), at[1:].tolist()):
            out[i] = ids[a:b]
    rest = [i for i in range(len(parts)) if out[i] is None]
    for i, e in zip(rest, library.encode_batch_fast([" " + parts[i] for i in rest], add_special_tokens=False)):
        out[i] = np.array(e.ids, "<u4")
    return out


def offsets(encoding) -> np.ndarray:
    """First character and end of each token."""
    flat = chain.from_iterable(encoding.offsets)
    return np.fromiter(flat, np.int64, 2 * len(encoding)).reshape(-1, 2)


class Memo(dict):
    """What ``make`` gives for each part, worked out once, in bulk.

    Two generations bound the memory: when the young one is full it becomes the old one, and what
    is used again moves back.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def learn(self, parts: list[list[str]]) -> None:
        """Make all these parts known; they stay so until the next call."""
        if len(self) > MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        new = set().union(*parts).difference(self)
        for part in new.intersection(self.old):
            self[part] = self.old[part]
        new = list(new.difference(self.old))
        if new:
            self.update(zip(new, self.make(new)))
