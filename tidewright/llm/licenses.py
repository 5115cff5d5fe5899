"""License scans: set-similarity join of text blocks with license templates, and exact base phrases.

Words are maximal runs of ASCII letters, digits and non-ASCII characters after A-Z is lower-cased. A block is a
window of words, across line ends, of WINDOW times the template's length: notices are found however they are
wrapped, and words scattered over a text are not. A block is labelled with a template when it holds at least
``threshold`` of the template's distinct words. The join is exact: a text that does not match as a whole has no
block that does, so whole texts are joined first and their windows verify. Words are ordered by the number of
documents that have them, rarest first, counted over the whole table; a template's first words under that order are
indexed (prefix filter), a block too short to hold enough words is passed over (length filter), and a shared word too
near the end of either list for the needed overlap is as well (positional filter). What is left is verified, and then
read: of the template's words at least the share ``threshold`` must stand in the block in the template's order.

Templates are a fixed list, so their index is part of the function that scans; text is read twice and never
shuffled.

Defined results: a null or empty text has no words, labels or places and scores 0; repeated rows are scanned
alike; long texts are scanned whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes to words: A-Z to a-z, other ASCII that is no letter or digit to a space; all others stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words in a block for each word of the template.
WINDOW = 2

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc0": "released into the public domain under cc0",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
}


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Index:
    """``templates`` by label; ``frequency``: word to the number of documents that have it."""

    templates: dict[str, str]
    threshold: float
    frequency: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sets = {label: frozenset(words(t.encode())) for label, t in self.templates.items()}
        vocabulary = sorted(set().union(*sets.values()), key=lambda w: (self.frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.sets = {label: s for label, s in sets.items() if s}
        self.need = {label: max(1, math.ceil(self.threshold * len(s) - 1e-9)) for label, s in self.sets.items()}
        self.first: dict[bytes, list[tuple[str, int]]] = {}
        for label, s in self.sets.items():
            for i, w in enumerate(sorted(s, key=self.rank.get)[: len(s) - self.need[label] + 1]):
                self.first.setdefault(w, []).append((label, i))

    def match(self, block: set[bytes]) -> dict[str, float]:
        """Labels of all templates that the block holds, with their containment."""
        known = sorted((w for w in block if w in self.rank), key=self.rank.get)
        n, found, tried = len(known), {}, set()
        for j, w in enumerate(known):
            for label, i in self.first.get(w, ()):
                need = self.need[label]
                if label in tried or n < need or j > n - need or 1 + min(len(self.sets[label]) - i - 1, n - j - 1) < need:
                    continue
                tried.add(label)
                if (shared := len(self.sets[label].intersection(known))) >= need:
                    found[label] = shared / len(self.sets[label])
        return found

    def blocks(self, label: str, all_words: list[bytes]) -> float:
        """The best containment of the template in a window of the text that has its words in order, else 0."""
        wanted, order = self.sets[label], words(self.templates[label].encode())
        span, needed = WINDOW * len(order), math.ceil(self.threshold * len(order) - 1e-9)
        held, inside, best = Counter(), deque(), 0
        for i, w in enumerate(all_words):
            if w not in wanted:
                continue
            inside.append((i, w))
            held[w] += 1
            while inside[0][0] <= i - span:
                gone = inside.popleft()[1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
            if len(held) > best and len(held) >= self.need[label] and in_order(order, [x for _, x in inside]) >= needed:
                best = len(held)
        return best / len(wanted)


def in_order(template: list[bytes], block: list[bytes]) -> int:
    """The most words of the template that the block has in the template's order."""
    row = [0] * (len(template) + 1)
    for w in block:
        before = 0
        for j, t in enumerate(template, 1):
            before, row[j] = row[j], before + 1 if t == w else max(row[j], row[j - 1])
    return row[-1]


def base_places(all_words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Label to the word numbers at which its phrases start."""
    joined, out = b" " + b" ".join(all_words) + b" ", {}
    for phrase, label in phrases.items():
        seek, at, seen, count = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := joined.find(seek, at + 1)) >= 0:
            count += joined.count(b" ", seen, at)
            seen = at
            out.setdefault(label, []).append(count)
    return out


def word_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Documents that have each word of the vocabulary, over the whole table; the result is as small as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """Per row: counts and places of base phrases, base labels, all labels, and the best containment as score."""
    templates, phrases = templates or TEMPLATES, phrases or BASE
    vocabulary = set(Index(templates, threshold).rank)
    index = Index(templates, threshold, word_frequency(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                all_words = words(text)
                have, found = vocabulary.intersection(all_words), {}
                if not have.isdisjoint(index.first):
                    found = {label: part for label in index.match(have) if (part := index.blocks(label, all_words))}
                places = base_places(all_words, phrases)
                starts = [p for v in places.values() for p in v]
                score = 1.0 if starts else max(found.values(), default=0.0)
                rows.append((len(all_words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *found})), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
