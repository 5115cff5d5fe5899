"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Text is lower-cased and folded first: homoglyphs become the Latin letters they look like, invisible characters
go, and digits and signs that stand for letters inside a word become those letters. A lexicon term is a whole
word or the start of a word. Hits inside an exception phrase do not count. The weights of all hits, divided by
1 + ln(1 + words), are the document's strength; a logistic curve turns that into a score from 0 to 1.

The lexicon is learned from labelled rows: of at most ``max_rows`` rows (half of them toxic, those of the smallest
hashed doc_id), terms that toxic rows have and others lack are taken greedily by the toxic rows they add, the most
specific first among equals; a term's weight is its smoothed log-odds. Two words, one of them hit, that several clean
rows have and no toxic one become exception phrases. Without labels a small general list is used. Only the text is
an input of a score.

Defined results: a null or empty text has no hits and the lowest score; long texts are matched whole; repeated
rows score alike; labels that are null are ignored; an empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.common import Scratch, col, free_name

HOMOGLYPHS = str.maketrans(
    "абвгдезикмнорстухѕіјԁһԛԝαβεικνορτυχϲ" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ" + "０１２３４５６７８９",
    "abbrde3ukmhopctyxsijdhqwabeikvoptuxc" + "abcdefghijklmnopqrstuvwxyz" + "0123456789",
    "​‌‍⁠﻿­",
)
FOREIGN = re.compile("[Ͱ-ԯ＀-｟​-‍⁠﻿­]")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
STANDS = re.compile(r"(?<![\W_])[0134578@$!]+(?=[^\W\d_])|(?<![\w])[0134578]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\w])")
LETTERS = re.compile(r"[^\W\d_]+")
GENERAL = {"idiot$": 4.0, "moron$": 4.0, "scum$": 4.0, "worthless$": 3.0, "pathetic$": 3.0, "disgusting$": 3.0, "stupid$": 3.0, "loser$": 3.0, "trash$": 2.0, "clown$": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "scum of the pond")
STEM = range(4, 13)
#: How far below certainty (in nats, over all terms) a term may be, and by how many terms a toxic row is covered.
CHANCE, COVER = 3.0, 8
#: Clean rows that must share a phrase before it is an exception.
CALM = 3


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(HOMOGLYPHS)
    if any(c in text for c in DIGITS):
        text = STANDS.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return text


@dataclass
class Lexicon:
    """``terms``: a term to its weight; one that ends in $ is a whole word, others start a word."""

    terms: dict[str, float] = field(default_factory=lambda: dict(GENERAL))
    exceptions: tuple[str, ...] = EXCEPTIONS
    middle: float = 0.35
    slope: float = 12.0

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list[tuple[str, int, float, bool]]] = {}
        for term, weight in self.terms.items():
            word = term.rstrip("$")
            # The digit 1 folds to i but may stand for l.
            for form in {word, word.replace("l", "i")}:
                found.setdefault(form, []).append(("term", len(form), weight, term.endswith("$")))
        for phrase in self.exceptions:
            found.setdefault(phrase, []).append(("exception", len(phrase), 0.0, True))
        out = ahocorasick.Automaton()
        for form, entries in found.items():
            out.add_word(form, entries)
        if found:
            out.make_automaton()
        return out

    def hits(self, folded_text: str, automaton: ahocorasick.Automaton) -> dict[int, tuple[int, float]]:
        """Where terms start, outside exception phrases, to the end and the weight of the heaviest term there."""
        hits, safe, n = [], [], len(folded_text)
        for end, entries in automaton.iter(folded_text):
            for kind, length, weight, whole in entries:
                start = end - length + 1
                if (start and folded_text[start - 1].isalpha()) or (whole and end + 1 < n and folded_text[end + 1].isalpha()):
                    continue
                if kind == "exception":
                    safe.append((start, end))
                else:
                    hits.append((start, end, weight))
        best: dict[int, tuple[int, float]] = {}
        # Phrases in order of their starts: one covers a hit if it reaches far enough and starts early enough.
        safe.sort()
        reach, k, last = -1, 0, sorted(hits)
        for start, end, weight in last:
            while k < len(safe) and safe[k][0] <= start:
                reach, k = max(reach, safe[k][1]), k + 1
            if end > reach and (start not in best or weight > best[start][1]):
                best[start] = (end, weight)
        return best

    def strength(self, text: str | None, automaton: ahocorasick.Automaton) -> float:
        if not text or not len(automaton):
            return 0.0
        found = self.hits(folded(text), automaton)
        return sum(w for _, w in found.values()) / (1 + math.log1p(len(text.split()))) if found else 0.0

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * (strength - self.middle)))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _terms(text: str) -> set[str]:
    words = set(LETTERS.findall(folded(text)))
    return {w[:k] for w in words for k in STEM if len(w) >= k} | {w + "$" for w in words if len(w) >= 3}


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled training rows: (text, toxic)."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    rows = marked.where("toxic = 1").orderBy(*order).limit(max_rows // 2).unionByName(marked.where("toxic = 0").orderBy(*order).limit(max_rows // 2))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select("text", "toxic")


def _phrases(text: str, lexicon: Lexicon, automaton: ahocorasick.Automaton) -> set[str]:
    """Pairs of words with one space between them of which one is hit."""
    text = folded(text)
    found = lexicon.hits(text, automaton) if len(automaton) else {}
    if not found:
        return set()
    words = [(m.start(), m.end()) for m in LETTERS.finditer(text)]
    at = {a: i for i, (a, _) in enumerate(words)}
    pairs = {j for start in found if (i := at.get(start)) is not None for j in (i - 1, i) if 0 <= j < len(words) - 1}
    return {text[words[j][0] : words[j + 1][1]] for j in pairs if text[words[j][1] : words[j + 1][0]] == " "}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Lexicon:
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled_sample(docs, labels, max_rows), "sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            terms = [*toxic, *(t for t in clean if t not in toxic)]
            for i in range(0, len(terms), 10_000):
                part = terms[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], ["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(_terms(text or ""))
                if len(toxic) + len(clean) > 200_000:
                    yield from flushed()
        yield from flushed()

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    every = scratch.save(sample.mapInArrow(counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    # A term that toxic rows have by chance alone is so unlikely among all terms seen.
    least = max(3.0, (math.log(max(every.count(), 1)) - CHANCE) / math.log((n1 + n0) / n1))
    found = every.where((F.col("toxic") >= least) & (F.col("clean") / n0 <= 0.1 * F.col("toxic") / n1))
    # As many as the sample's toxic rows share, whatever the table: the bound is that of the rows.
    rows = found.collect()
    odds = {r.term: math.log((r.toxic + 0.5) / (n1 + 1)) - math.log((r.clean + 0.5) / (n0 + 1)) for r in rows}
    names = sorted(odds)
    at = {t: i for i, t in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [sorted(at[t] for t in _terms(x or "") if t in at) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.list_(pa.int32()))], ["has"])

    of: dict[int, set[int]] = {}
    for i, r in enumerate(sample.where("toxic = 1").mapInArrow(present, "has array<int>").collect()):
        for t in r.has:
            of.setdefault(t, set()).add(i)
    clean, chosen, times = {r.term: r.clean for r in rows}, {}, Counter()
    while of:
        t = max(of, key=lambda t: (len(of[t]) - 3 * clean[names[t]] * n1 / n0, -clean[names[t]], names[t].endswith("$"), len(names[t]), names[t]))
        got = of.pop(t)
        if len(got) < least:
            break
        chosen[names[t]] = odds[names[t]]
        times.update(got)
        done = {i for i in got if times[i] >= COVER}
        # What a chosen stem begins, or begins it, is found already; rows found often enough need no more terms.
        stem = names[t].rstrip("$")
        of = {k: rest for k, v in of.items() if not names[k].startswith(stem) and not stem.startswith(names[k]) and (rest := v - done)}
    lexicon = Lexicon(terms=chosen, exceptions=())

    def calm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            pairs = [(p, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in _phrases(x or "", lexicon, automaton)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], ["phrase", "toxic"])

    phrases = sample.mapInArrow(calm, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    lexicon = Lexicon(terms=chosen, exceptions=tuple(sorted(r.phrase for r in phrases.where((F.col("toxic") == 0) & (F.col("n") >= CALM)).collect())))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.strength(x, automaton) for x in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["strength", "toxic"])

    seen = sorted((r.strength, r.toxic) for r in sample.mapInArrow(strengths, "strength double, toxic int").collect())
    scratch.drop()
    # The cut with the fewest errors on the sample, halfway between its neighbours.
    errors = best = sum(1 for _, y in seen if not y)
    lexicon.middle = seen[0][0] / 2
    for i, (v, y) in enumerate(seen):
        errors += 1 if y else -1
        after = seen[i + 1][0] if i + 1 < len(seen) else v + 1
        if errors < best and after > v:
            best, lexicon.middle = errors, (v + after) / 2
    lexicon.slope = 4 / max(lexicon.middle, 1e-3)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, carry: list[str] | None = None, score: str = "__score") -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default), and ``score``, which no carried column may be named."""
    carry = docs.columns if carry is None else carry
    # A text that is carried is not sent twice. Columns go by number, whatever they are named.
    own = "text" in carry and dict(docs.dtypes)["text"] == "string"
    kept = [col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(*kept) if own else docs.select(*kept, F.col("text").cast("string").alias("read"))
    at, out = carry.index("text") if own else len(carry), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                scores = [lexicon.score(lexicon.strength(x, automaton)) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:out], pa.array(scores, pa.float64())], [*batch.schema.names[:out], "score"])

    schema = StructType([*rows.schema.fields[:out], StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*carry, score)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with its columns."""
    score = free_name(docs.columns, "__score")
    return score_toxicity(docs, lexicon, score=score).where(F.col(score) < least).select(*map(col, docs.columns))
