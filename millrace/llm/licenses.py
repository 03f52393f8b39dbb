"""License notices, also misspelt ones.

A text becomes its lower-case words joined by single spaces. Four fixed phrases are counted where their
words stand one after the other. Notices are found with up to ``k`` edits: a notice is split into
``k + 1`` parts, one of which must stand unchanged in any place within ``k`` edits; an automaton finds all
such parts in one pass, and around each, by itself, the regex library's bounded-error matching verifies the notice
and gives its span and number of edits. Of notices that overlap the likest is kept, and what is left free of the
other's surroundings is searched again. Edits are for misspelt words: tokens that tell one licence from another, which is to say
words with digits and the clauses of ``EXACT``, must stand as they are, so another version has not the nearest one's label.

Null and empty texts have no words and no labels. Repeated rows stay, extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.arrow import map_texts

# The phrases that are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# How the licences are referred to, as words.
NOTICES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd-2-clause": ["released under the bsd 2 clause license", "licensed under the bsd 2 clause license"],
    "bsd-3-clause": ["released under the bsd 3 clause license", "licensed under the bsd 3 clause license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "isc": ["licensed under the isc license"],
    "lgpl-2.1": ["licensed under the gnu lesser general public license version 2 1"],
    "lgpl-3.0": ["licensed under the gnu lesser general public license version 3"],
    "mit-notice": ["released under the mit license", "licensed under the mit license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
}
EXACT = {"by", "nc", "nd", "sa", "isc", "mit", "bsd", "lesser", "affero"}
SPDX = "spdx license identifier"  # followed by the label itself, as words
LETTERS_PER_EDIT = 12
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def telling(words: list[str]) -> list[str]:
    """The words that tell one licence from another."""
    return [w for w in words if w in EXACT or any(c.isdigit() for c in w)]


def seeds(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` parts of the notice, each with its place."""
    bounds = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(bounds, bounds[1:])]


class Scanner:
    """All notices, compiled."""

    def __init__(self, notices: dict[str, list[str]] = NOTICES):
        self.patterns = []
        parts: dict[str, list[tuple[int, int]]] = {}
        for label, texts in notices.items():
            spdx = " ".join(re.split("[^0-9a-z]+", label.removesuffix("-notice")))
            for text in [*texts, f"{SPDX} {spdx}"]:
                k = len(text) // LETTERS_PER_EDIT
                found = regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}")
                self.patterns.append((label, text, k, found, set(telling(text.split(" ")))))
                for place, part in seeds(text, k):
                    parts.setdefault(part, []).append((len(self.patterns) - 1, place))
        self.automaton = ahocorasick.Automaton()
        for part, where in parts.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()

    @staticmethod
    def _told(text: str, notice: str, start: int, end: int) -> bool:
        """Whether the words that the place touches have the notice's telling words, and no further one follows."""
        first, last = text.rfind(" ", 0, start + 1) + 1, text.find(" ", end)
        last = len(text) if last < 0 else last
        return telling(text[first:last].split(" ")) == telling(notice.split(" "))

    def notices(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """Label, start, end, edits and likeness of each notice in a text of normalised words."""
        queue: list[tuple] = []
        tried: set[tuple[int, int, int]] = set()

        def search(number: int, a: int, b: int) -> None:
            label, notice, k, pattern, told = self.patterns[number]
            if b - a < len(notice) - k or (number, a, b) in tried:
                return
            tried.add((number, a, b))
            if not told.issubset(text[a:b].split(" ")) and not told.issubset(text[max(0, a - k) : b + k].split(" ")):
                return  # a word that must stand as it is does not
            at = text.find(notice, a, b)
            if at >= 0 and self._told(text, notice, at, at + len(notice)):
                heapq.heappush(queue, (-1.0, label, at, at + len(notice), 0, number, a, b))
            elif (match := pattern.search(text, a, b)) and self._told(text, notice, *match.span()):
                edits = sum(match.fuzzy_counts)
                heapq.heappush(queue, (edits / len(notice) - 1, label, *match.span(), edits, number, a, b))

        for end, (length, where) in self.automaton.iter(text):
            for number, place in where:
                _, notice, k, _, _ = self.patterns[number]
                start = end + 1 - length - place
                # Too short for two notices, so the best match hides none beside it.
                search(number, max(0, start - k), min(len(text), start + len(notice) + k))
        # Notices that differ by a digit match in one place; the one with fewest edits is meant.
        kept: list[tuple[int, int, str, int, float]] = []
        while queue:
            less, label, start, end, edits, number, a, b = heapq.heappop(queue)
            at = bisect.bisect(kept, (start, end))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end, label, edits, -less))
                continue
            at = max(0, bisect.bisect(kept, (a,)) - 1)
            while at < len(kept) and kept[at][0] < b:
                search(number, a, kept[at][0])
                a = max(a, kept[at][1])
                at += 1
            search(number, a, b)
        return [(label, start, end, edits, likeness) for start, end, label, edits, likeness in kept]


_scanners: dict[str, Scanner] = {}


def scan(text: str, notices: dict[str, list[str]] = NOTICES) -> dict:
    """What is found in one text; the places are words from 0."""
    key = repr(notices)
    if key not in _scanners:
        _scanners[key] = Scanner(notices)
    return _scan(text, _scanners[key])


def _scan(text: str, scanner: Scanner) -> dict:
    found = WORD.findall(text.encode().lower())
    joined = b" ".join(found).decode()
    # Where each word begins in the joined text; no place is counted from the start of the text.
    starts = list(accumulate((len(w.decode()) + 1 for w in found), initial=0))
    word_at = lambda place: bisect.bisect_right(starts, place) - 1
    base, places = set(), []
    padded = f" {joined} "
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            base.add(label)
            places.append(word_at(at))
            at = padded.find(f" {phrase} ", at + 1)
    notices = scanner.notices(joined)
    return {
        "n_words": len(found),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {n[0] for n in notices})),
        "score": max([1.0] * bool(places) + [n[4] for n in notices], default=0.0),
        "spans": [
            {"label": label, "first_word": word_at(a), "last_word": word_at(b - 1), "edits": edits}
            for label, a, b, edits, _ in notices
        ],
    }


_TYPES = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(
        pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("edits", pa.int32())])
    ),
}


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per document: counts and places of the phrases, labels, score, spans of the notices.

    ``notices`` has the texts to look for, as lower-case words, by label; by default ``NOTICES``.
    """
    notices = NOTICES if notices is None else notices

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [scan(t, notices) for t in batch.column(1).to_pylist()]
        columns = [pa.array([o[name] for o in out], kind) for name, kind in _TYPES.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_TYPES])

    schema = (
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:int,last_word:int,edits:int>>"
    )
    return map_texts(docs, [id_col, text_col], run, schema)
