"""Best-fit packing of tokenised documents into sequences under several capacities.

A document's tokens end with one separator; a document longer than a sequence is cut into whole sequences and a
rest. Pieces are dealt by hash into shards of about ``shard_pieces`` pieces, and each shard is packed on its own,
largest piece first: of the open bins with enough room in every capacity (tokens, documents, attention cost as
the sum of squared lengths) the one is taken whose residual after placing has the least weighted norm, or the
greatest weighted dot product with the piece. Bins of one state are interchangeable, so each state is tried once.
A shard leaves about one bin part-filled, whatever the size of the table.

Tokens never reach over ASCII white space in this vocabulary, so each distinct word of a slice of texts is encoded
once and its ids are gathered by numpy. Nothing is kept from slice to slice but a bounded store of odd words.

Defined results: a null or empty text is one separator; repeated rows are packed as rows of their own; long
texts are cut as above, never dropped; ties go to the bin opened first; a piece that exceeds a capacity by itself
is an error; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.common import Scratch

#: Bytes of text that are encoded together, and the most odd words kept.
SLICE, MAX_ODD = 8 << 20, 100_000
#: ASCII signs: none is a letter, a digit or white space.
SIGNS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
#: Letters whose lower-case form is one letter and that never combine with each other.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁҊ-ӿ"
PLAIN = rf"^(?P<before>[{SIGNS}]*)(?P<run>[{LETTERS}]+)(?P<after>[{SIGNS}']*)$"
WORD_END = "</w>"
#: How the tokenizer this module knows parts a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _printable() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself, or one from 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _merged(units: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    while pairs := [(order[p], k) for k, p in enumerate(zip(units, units[1:], strict=False)) if p in order]:
        k = min(pairs)[1]
        units = [*units[:k], units[k] + units[k + 1], *units[k + 2 :]]
    return units


@cache
def by_words(path: str) -> bool:
    """Whether texts may be encoded word by word, and runs of letters by the rank of the merged token.

    The first needs the split and the normal form this module knows. The second holds if every token, merged from
    its own characters, gives itself: two neighbours that make up a token are then always its last merge.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    normal, split, model = whole["normalizer"] or {}, whole["pre_tokenizer"] or {}, whole["model"]
    if [n.get("type") for n in normal.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or [n.get("type") for n in split.get("pretokenizers", [])] != ["Split", "ByteLevel"]:
        return False
    if split["pretokenizers"][0]["pattern"].get("Regex") != SPLIT or model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return False
    order = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    for token, i in model["vocab"].items():
        units = list(token.removesuffix(WORD_END))
        if token.endswith(WORD_END) and units:
            units[-1] += WORD_END
        if _merged(units, order) != [token] or (len(units) > 1) != (i >= 2 * 256):
            return False
    return True


class WordEncoder:
    """Ids of texts. Word by word, only ASCII white space parts words.

    A word of letters with signs before or after it is one run of letters and one or two runs of signs to the
    tokenizer. Distinct runs of letters are merged by a second, faster engine with the same vocabulary. It knows no
    ends of words, so a run's bytes are spelled as code points, with other ones for its last byte. All other
    words, and whole texts if ``by_words`` does not hold, go to the tokenizer itself.
    """

    def __init__(self, path: str, words: bool, max_odd: int = MAX_ODD):
        self.tokenizer, self.words, self.max_odd = Tokenizer.from_file(path), words, max_odd
        self.odd: dict[str, list[int]] = {}
        if not words:
            return
        vocabulary, byte, ranks = self.tokenizer.get_vocab(with_added_tokens=False), _printable(), {}
        spelled = {ord(c): b if b < 128 else b + 0x100 for c, b in byte.items()}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            if token.endswith(WORD_END):
                self.ends[i] = True
                word = token.removesuffix(WORD_END)
                ranks[(word[:-1].translate(spelled) + chr(byte[word[-1]] + 0x200)).encode()] = i
            else:
                ranks[token.translate(spelled).encode()] = i
        # Single bytes need a number too; none is left over, as every code point is a token of low rank.
        ranks |= {b: len(ranks) + k for k, b in enumerate(bytes([b]) for b in range(256)) if b not in ranks}
        self.engine = tiktoken.Encoding("runs", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs of lower-case letters, end to end, and where each one's end."""
        if not len(runs):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(runs)], runs.cast(pa.string())), " ")[0].as_buffer()
        points = np.append(np.frombuffer(joined, np.uint8), 32).astype("<u4")
        # ASCII stays, others go to 0x100 and on; a run's last byte goes to 0x200 and on.
        last = np.flatnonzero(points == 32) - 1
        ends = points[last] + 0x200
        points[points >= 128] += 0x100
        points[last] = ends
        ids = self.engine.encode_to_numpy(points.tobytes().decode("utf-32-le")).astype("<u4")
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def _others(self, words: list[str]) -> list[list[int]]:
        if len(self.odd) > self.max_odd:
            self.odd.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.odd]
        for i in range(0, len(new), 5_000):
            part = new[i : i + 5_000]
            self.odd.update(zip(part, (e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [self.odd[w] for w in words]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids and, for each word, three places in it: signs, letters, signs (odd words have one)."""
        found = pc.extract_regex(words, PLAIN)
        plain = pc.and_(pc.is_valid(found), pc.invert(pc.match_substring(words, "<|")))
        odd, found = words.filter(pc.invert(plain)).to_pylist(), found.filter(plain)
        before, run, after = (found.field(i).dictionary_encode() for i in range(3))
        run_codes, lowered = run.indices.to_numpy(), pc.utf8_lower(run.dictionary).dictionary_encode()
        ids, ends = self._runs(lowered.dictionary)
        pool, starts, sizes = [ids], np.append(0, ends[:-1]).astype(np.int64), np.diff(ends, prepend=0)
        others = [*before.dictionary.to_pylist(), *after.dictionary.to_pylist(), *odd]
        coded = self._others(others)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        starts = np.append(starts, len(ids) + np.cumsum(lengths) - lengths)
        sizes = np.append(sizes, lengths)
        pool.append(np.fromiter((i for c in coded for i in c), np.uint32, int(lengths.sum())))
        n, b, a = len(lowered.dictionary), len(before.dictionary), len(after.dictionary)
        part = np.zeros((len(words), 3), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        part[is_plain, 0] = n + before.indices.to_numpy()
        part[is_plain, 1] = lowered.indices.to_numpy()[run_codes] if len(run_codes) else 0
        part[is_plain, 2] = n + b + after.indices.to_numpy()
        start, size = np.zeros_like(part), np.zeros_like(part)
        start[is_plain], size[is_plain] = starts[part[is_plain]], sizes[part[is_plain]]
        k = n + b + a + np.arange(len(odd))
        start[~is_plain, 0], size[~is_plain, 0] = starts[k], sizes[k]
        return np.concatenate(pool).astype("<u4"), start, size

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by the id ``end`` if given, and where each text's begin; one more
        number is the total."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        extra = [end] * (end is not None)
        if not self.words:
            coded = [[*e.ids, *extra] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            return np.fromiter((i for c in coded for i in c), "<u4", int(sizes.sum())), np.append(0, np.cumsum(sizes))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pool, start, size = self._distinct(coded.dictionary)
        bounds = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
        index = coded.indices.to_numpy()
        if extra:
            # One word more, of the id ``end`` alone, after each text's words.
            start, size = np.vstack([start, [[len(pool), 0, 0]]]), np.vstack([size, [[1, 0, 0]]])
            index = np.insert(index, bounds[1:], len(size) - 1)
            pool, bounds = np.append(pool, np.uint32(end)), bounds + np.arange(len(bounds))
        total = size.sum(axis=1)
        # Each distinct word's ids are laid end to end first, then words are gathered.
        word_ids = pool[_ranges(start.ravel(), size.ravel())]
        at = np.cumsum(total) - total
        lengths = total[index]
        return word_ids[_ranges(at[index], lengths)], np.append(0, np.cumsum(lengths))[bounds]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


@cache
def encoder(path: str, words: bool) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, words)


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text, each of a row at least."""
    upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        yield i, j - i
        i = j


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, separator: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, the ids themselves as bytes."""
    path = tokenizer or default_tokenizer()
    names, words = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids], by_words(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, words).encode
        for batch in batches:
            for i, n in byte_slices(batch.column(1), SLICE):
                coded, bounds = encode(batch.column(1).slice(i, n), separator)
                pieces = -(-np.diff(bounds) // capacity)
                number = _ranges(np.zeros(n, np.int64), pieces)
                first = np.repeat(bounds[:-1], pieces) + number * capacity
                last = np.minimum(first + capacity, np.repeat(bounds[1:], pieces))
                raw = memoryview(np.ascontiguousarray(coded, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                doc = batch.column(0).slice(i, n).take(pa.array(np.repeat(np.arange(n), pieces)))
                columns = [doc, pa.array(number, pa.int32()), pa.array(number * capacity), pa.array(last - first), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(
    lengths: Iterable[int],
    capacity: int,
    max_docs: int,
    max_attention: int,
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4),
    by: str = "norm",
) -> tuple[list[int], list[int]]:
    """For lengths in descending order, each one's bin and its place there."""
    lengths, (w_t, w_d, w_a) = list(lengths), weights
    if lengths and (lengths[0] > capacity or lengths[0] ** 2 > max_attention or max_docs < 1):
        raise ValueError(f"a piece of {lengths[0]} tokens fits no bin of {capacity} tokens, {max_docs} documents and an attention cost of {max_attention}")
    open_bins: dict[int, dict[tuple[int, int], list[int]]] = {}
    mask, count, bins, places = 0, 0, [], []
    used: list[int] = []
    for n in lengths:
        cost, best, chosen = n * n, None, None
        left, r = mask >> n, n
        while left:
            step = (left & -left).bit_length() - 1
            r, left = r + step, left >> step
            if by == "norm" and best is not None and w_t * ((r - n) / capacity) ** 2 >= best:
                break
            for docs, attention in open_bins[r]:
                if docs < 1 or attention < cost:
                    continue
                if by == "norm":
                    score = w_t * ((r - n) / capacity) ** 2 + w_d * ((docs - 1) / max_docs) ** 2 + w_a * ((attention - cost) / max_attention) ** 2
                else:
                    score = -(w_t * n / capacity * r / capacity + w_d / max_docs * docs / max_docs + w_a * cost / max_attention * attention / max_attention)
                if best is None or score < best:
                    best, chosen = score, (r, docs, attention)
            r, left = r + 1, left >> 1
        if chosen is None:
            b, r, docs, attention = count, capacity, max_docs, max_attention
            count += 1
            used.append(0)
        else:
            r, docs, attention = chosen
            b = open_bins[r][docs, attention].pop()
            if not open_bins[r][docs, attention]:
                del open_bins[r][docs, attention]
                if not open_bins[r]:
                    del open_bins[r]
                    mask &= ~(1 << r)
        bins.append(b)
        places.append(used[b])
        used[b] += n
        if r > n and docs > 1:
            open_bins.setdefault(r - n, {}).setdefault((docs - 1, attention - cost), []).append(b)
            mask |= 1 << (r - n)
    return bins, places


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    by: str = "norm",
    shard_pieces: int = 6_000,
    ids: bool = False,
) -> DataFrame:
    """The pieces with sequence_id and offset. Without limits of their own, documents and attention cost are
    limited only by the tokens: at most ``capacity`` documents and ``capacity`` squared of cost. A piece whose
    own cost is over ``max_attention`` cannot be placed: that is an error (a smaller ``capacity`` cuts shorter)."""
    max_docs, max_attention = capacity if max_docs is None else max_docs, capacity * capacity if max_attention is None else max_attention
    pieces = Scratch(docs.sparkSession, "packing").save(token_pieces(docs, tokenizer, capacity, ids=ids), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    names, schema = pieces.columns, f"{', '.join(f'{c} {t}' for c, t in pieces.dtypes)}, sequence_id long, offset long"
    # A row number within the task keeps the pieces of repeated rows apart.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, places = best_fit(rows["length"].tolist(), capacity, max_docs, max_attention, by=by)
        rows["sequence_id"] = np.array(bins, np.int64) * shards + rows["shard"].iloc[0] if len(rows) else 0
        rows["offset"] = np.array(places, np.int64)
        return rows[[*names, "sequence_id", "offset"]]

    return dealt.groupBy("shard").applyInPandas(run, schema)
