"""License scans: winnowed template fingerprints find candidates, banded alignment measures them.

Texts and templates are sequences of words, lower-cased and stripped of
punctuation at their ends. Every run of ``GRAM`` words of a template is hashed,
and of each ``WINDOW`` neighbouring hashes the smallest (the last of equal ones)
is a fingerprint; a text that shares GRAM + WINDOW - 1 words in a row with a
template has one of its fingerprints among its own hashes. A template of up to
``SHORT`` words has all its pairs of words as fingerprints, so that it is found
by two words in a row. An inverted index from fingerprint to (template, place)
names candidates by diagonal. Diagonals within a band of each other are one
candidate; a banded local alignment around them gives the words that match,
their share of the template (coverage) and the span in the text. Matches of
COVERAGE or more are reported; of overlapping ones of one template the best, and
none inside another template's that has more words and covers no less.

The templates are a parameter; ``license_texts`` has statements, notices and
short licenses' whole texts.

Defined cases: a null, empty or matchless text has no row; repeated rows are
reported each; of matches with equal coverage the first stays; an empty table
gives an empty result; of docs only doc_id and text are looked at. Texts are
read whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.llm.common import WORD, slices, table
from dagmar.llm.license_texts import TEMPLATES

GRAM, WINDOW, SHORT, BAND, COVERAGE, MEMO = 3, 2, 9, 6, 0.8, 200_000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#|-_/"
_SPANS = re.compile(WORD)

def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment of template to text with text place - template place from low to high.

    A match scores 2, a mismatch or gap -1; start and end are places in text, end exclusive.
    """
    best, before = (0, 0, 0, 0), {}
    for i, word in enumerate(template):
        row = {}
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            score, matched, start = before.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, start = 0, 0, j
            hit = word == text[j] and word > 0
            here = (score + 2, matched + 1, start) if hit else (score - 1, matched, start)
            for other in (before.get(j), row.get(j - 1)):
                if other and other[0] - 1 > here[0]:
                    here = (other[0] - 1, other[1], other[2])
            if here[0] > 0:
                row[j] = here
                if here[0] > best[0]:
                    best = (here[0], here[1], here[2], j + 1)
        before = row
    return best[1], best[2], best[3]


class Index(dict):
    """Raw word -> number in the templates' vocabulary, 0 for all others; with the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE):
        self.gram, self.window, self.band, self.coverage, self.names = gram, window, band, coverage, sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.templates = []
        for name in self.names:
            words = [self.clean(w) for w in templates[name].split()]
            self.templates.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words if w])
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {2: defaultdict(list), gram: defaultdict(list)}
        for t, words in enumerate(self.templates):
            short = len(words) <= SHORT
            n = 2 if short else gram
            hashes = self.hashes(np.array(words, np.int64), n)
            for p in range(len(hashes)) if short else self.winnow(hashes).tolist():
                self.places[n][int(hashes[p])].append((t, p))
        self.known = {n: np.array(sorted(at), np.uint64) for n, at in self.places.items()}

    @staticmethod
    def clean(word: str) -> str:
        return word.lower().strip(PUNCTUATION)

    def __missing__(self, raw: str) -> int:
        number = self.vocabulary.get(self.clean(raw), 0)
        if len(self) < MEMO:
            self[raw] = number
        return number

    @staticmethod
    def hashes(words: np.ndarray, gram: int) -> np.ndarray:
        """Hashes of all runs of gram words."""
        n = len(words) - gram + 1
        h = np.zeros(max(n, 0), np.uint64)
        for i in range(gram if n > 0 else 0):
            h = (h + words[i : i + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def winnow(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the smallest of each `window` neighbouring hashes."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        width = min(self.window, len(hashes))
        views = np.lib.stride_tricks.sliding_window_view(hashes, width)
        return np.unique(np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1))

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, end word) of each match."""
        numbers = np.fromiter(map(self.__getitem__, _SPANS.findall(text)), np.int64)
        if np.count_nonzero(numbers) < 2:
            return []
        diagonals = defaultdict(set)
        for n, known in self.known.items():
            hashes = self.hashes(numbers, n)
            for i in np.nonzero(np.isin(hashes, known))[0].tolist():
                for t, p in self.places[n][int(hashes[i])]:
                    diagonals[t].add(i - p)
        found = []
        for t, all_ in diagonals.items():
            spans = [s for low, high in self.bands(sorted(all_)) for s in self.matches(t, numbers, low, high)]
            taken: list[tuple] = []
            for s in sorted(spans, key=lambda s: (-s[0], s[2])):
                if all(s[3] <= o[2] or s[2] >= o[3] for o in taken):
                    taken.append(s)
            found += [(self.names[t], *s) for s in taken]
        beside = lambda f, o: o is not f and o[3] <= f[3] and f[4] <= o[4] and o[2] > f[2] and o[1] >= f[1]
        return sorted((f for f in found if not any(beside(f, o) for o in found)), key=lambda f: (f[3], f[0]))

    def bands(self, diagonals: list[int]):
        """Ranges of diagonals that lie within a band of each other, each with a band on either side."""
        low = last = diagonals[0]
        for d in [*diagonals[1:], None]:
            if d is None or d - last > self.band:
                yield low - self.band, last + self.band
                low = d
            last = d

    def matches(self, t: int, numbers: np.ndarray, low: int, high: int):
        """(coverage, matched words, first word, end word) of the template's matches within a range of diagonals."""
        words = self.templates[t]
        todo = [(max(0, low), min(len(numbers), high + len(words)))]
        while todo:  # a window may hold further matches before and behind the best one
            lo, hi = todo.pop()
            there = set(numbers[lo:hi].tolist())
            if sum(w in there for w in words) < self.coverage * len(words):
                continue
            matched, start, end = align(words, numbers[lo:hi].tolist(), low - lo, high - lo)
            if matched >= self.coverage * len(words):
                yield matched / len(words), matched, lo + start, lo + end
                todo += [(lo, lo + start), (lo + end, hi)]


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_word, end_word, start_char and end_char of every match."""
    chosen = templates or TEMPLATES

    def run(batches):
        index = Index(chosen)
        for batch in batches:
            for some in slices([batch], 1, 4 << 20):
                out = [[] for _ in range(8)]
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    matches = index.scan(text) if text else []
                    if not matches:
                        continue
                    spans = [m.span() for m in _SPANS.finditer(text)]
                    for name, coverage, matched, start, end in matches:
                        for column, value in zip(out, (doc_id, name, coverage, matched, start, end, spans[start][0], spans[end - 1][1]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "license", "coverage", "matched_words", "start_word", "end_word", "start_char", "end_char"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, coverage double, matched_words int, start_word int, end_word int, start_char int, end_char int")


def op8(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, table(spark, sf_dir, "documents"))
