"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (no piece reaches over a chunk's bounds) are laid end to end and their suffixes
sorted by prefix doubling, up to the length of the longest piece. Every piece is looked up by binary search, all
pieces at once; its range of the suffix array lists all places where it occurs. These occurrences are edges from
their start to their end; sorted by the position of their end they are relaxed from left to right. For merge-based models an edge
(p, q) extends the encoding of the text up to p exactly if its piece and the last piece there are a compatible
pair, that is, encode to themselves when put together; each prefix has one encoding, so one edge into each place
holds and the last place gives the encoding of the whole. This is the encoding that merging would give.

Characters without a piece become one piece a byte and part the text. Chunks and their ids are kept in a store of
two generations, the older of which goes when the younger is full, and unseen chunks are indexed at most ``max_index`` characters at a time (longer chunks
alone), so memory is bounded but for one word's length.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded alike;
long texts are encoded whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MAX_CHUNKS, MAX_INDEX, MAX_PAIRS = 400_000, 400_000, 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of the next ``depth`` symbols; symbols are 1 upwards, of less than 2 ** 15 kinds
    for the short start, in which four symbols make the first key."""
    n = len(symbols)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if k < n:
            out[: n - k] = x[k:]
        return out

    key, k = symbols.astype(np.int64), 1
    if n and key.max() < 1 << 15:
        key = key << 45 | shifted(key, 1) << 30 | shifted(key, 2) << 15 | shifted(key, 3)
        k = 4
    while k < depth and n:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        key = rank * (int(rank.max()) + 1) + shifted(rank, k)
        k *= 2
    return np.argsort(key, kind="stable")


def occurrence_ranges(symbols: np.ndarray, order: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of one length (a row of symbols each) the range of ``order`` whose suffixes start with each."""
    length, n = pieces.shape[1], len(order)
    padded = np.concatenate([symbols, np.zeros(length, symbols.dtype)])
    steps = np.arange(length)

    def search(after: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            text, want = padded[order[mid][:, None] + steps], pieces[open_]
            first = (text != want).argmax(axis=1)
            rows = np.arange(len(open_))
            a, b = text[rows, first], want[rows, first]
            right = a <= b if after else a < b
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    return search(False), search(True)


class PieceModel:
    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, max_index: int = MAX_INDEX):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.max_chunks, self.max_index = max_chunks, max_index
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i, text in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte_ids[int(text[1:-1], 16)] = i
            self.raw.append(bytes([int(text[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else text.replace(SPACE, " ").encode())
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in normal}
        self.scores = {i: sp.get_score(i) for i in normal}
        # Pieces in the order of merging, single characters first: a piece's number here is its rank.
        ordered = sorted(normal, key=lambda i: (len(self.texts[i]) > 1, -self.scores[i] if len(self.texts[i]) > 1 else 0, i))
        rank = {i: r for r, i in enumerate(ordered)}
        self.id_of = ordered
        self.parts = [(r, r) for r in range(len(ordered))]
        self.joined: dict[tuple[int, int], int] = {}
        whole = []
        for r, i in enumerate(ordered):
            text = self.texts[i]
            for k in range(1, len(text)):
                if (a := self.ids.get(text[:k])) is not None and (b := self.ids.get(text[k:])) is not None:
                    self.joined[rank[a], rank[b]] = r
            merged, last = self.merge(text)
            if len(merged) == 1:  # others never come out of merging
                whole.append(i)
                if last:
                    self.parts[r] = (rank[self.ids[last[0]]], rank[self.ids[last[1]]])
        self.depth = max(len(self.texts[i]) for i in whole)
        self.by_length = {k: [(self.texts[i], rank[i]) for i in whole if len(self.texts[i]) == k] for k in sorted({len(self.texts[i]) for i in whole})}
        cut = "" if any("\n" in t for t in self.ids) else "\n"
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("pieces with a space after other characters need other chunks")
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + ("|\n+" if cut else ""))
        self.single = {ord(t) for t in self.ids if len(t) == 1}
        # Chunks seen lately, and those seen before that: what is still used moves over.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, best score first and leftmost among equals; and the last merge made."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' texts in a row gives the two pieces: their merges are undone, latest
        first, and at each stage a merge over the seam must not have come before the one undone."""
        limit, joined, parts = len(self.id_of) + 1, self.joined, self.parts
        while True:
            r = joined.get((a, b))
            if r is not None and r < limit:
                return False
            left, right = parts[a][1], parts[b][0]
            if left == a and right == b:
                return True
            # Of equal pieces the left one was merged first. Single characters are never undone.
            if left != a and (right == b or a > b):
                limit, a = a, left
            else:
                limit, b = b + 1, right

    def _unknown(self, chunk: str, at: int) -> list[int]:
        return [self.byte_ids[b] for b in chunk[at].encode()]

    def _index(self, chunks: list[str]) -> None:
        """Encodes the chunks and keeps their ids."""
        text = "".join(chunks)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, symbols = np.unique(points, return_inverse=True)
        symbols = symbols.astype(np.int32) + 1
        order = suffix_order(symbols, self.depth)
        ends = np.cumsum([len(c) for c in chunks])
        end_at = np.repeat(ends, [len(c) for c in chunks])
        starts, ranks, sizes = [], [], []
        known = set(alphabet.tolist())
        for length, rows in self.by_length.items():
            here = [(t, r) for t, r in rows if known.issuperset(map(ord, t))]
            if not here:
                continue
            coded = np.frombuffer("".join(t for t, _ in here).encode("utf-32-le"), np.uint32)
            low, high = occurrence_ranges(symbols, order, (np.searchsorted(alphabet, coded) + 1).astype(np.int32).reshape(-1, length))
            count = high - low
            where = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            starts.append(order[where])
            ranks.append(np.repeat([r for _, r in here], count))
            sizes.append(np.full(int(count.sum()), length))
        start, rank, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ranks, sizes))
        end = start + size
        inside = end <= end_at[start] if len(start) else np.zeros(0, bool)
        start, rank, end = start[inside], rank[inside], end[inside]
        # By the place an edge leads to, the longest first: the first that holds is the one.
        by_place = np.argsort(end * 64 - (end - start), kind="stable")
        start, rank, end = start[by_place], rank[by_place], end[by_place]
        bounds = np.searchsorted(end, np.concatenate(([0], ends)), side="right").tolist()
        strange = set(points.tolist()) - self.single
        start, rank, end = start.tolist(), rank.tolist(), end.tolist()
        pairs, compatible, id_of, begin = self.pairs, self.compatible, self.id_of, 0
        for c, chunk in enumerate(chunks):
            n, i, j = len(chunk), bounds[c], bounds[c + 1]
            last, back, done = [-1] * (n + 1), [0] * (n + 1), 0
            unknown = [k for k, x in enumerate(chunk) if ord(x) in strange] if strange else ()
            for k in unknown:
                last[k + 1], back[k + 1] = -2, k
            for p, b, q in zip(start[i:j], rank[i:j], end[i:j], strict=True):
                if q == done:
                    continue
                p -= begin
                if p:
                    a = last[p]
                    if a >= 0:
                        row = pairs.get(a)
                        if row is None:
                            row = pairs[a] = {}
                        ok = row.get(b)
                        if ok is None:
                            ok = row[b] = compatible(a, b)
                            self.n_pairs += 1
                        if not ok:
                            continue
                    elif a == -1:
                        continue
                done = q
                last[q - begin], back[q - begin] = b, p
            ids, q = [], n
            while q:
                if last[q] == -2:
                    ids.extend(reversed(self._unknown(chunk, q - 1)))
                else:
                    ids.append(id_of[last[q]])
                q = back[q]
            ids.reverse()
            self.known[chunk] = array("I", ids).tobytes()
            begin += n

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.max_chunks:
            self.known, self.older = {}, self.known
        if self.n_pairs > MAX_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        known, older = self.known, self.older
        split = [self.chunks.findall((SPACE + text).replace(" ", SPACE)) if text else [] for text in texts]
        new = set().union(*split).difference(known)
        part, size = [], 0
        for chunk in sorted(new):
            if (coded := older.get(chunk)) is not None:
                known[chunk] = coded
                continue
            if chunk.startswith(SPACE * 2):
                # Pieces of spaces alone have one score, which ranks cannot tell apart: merged plainly.
                known[chunk] = self._plain(chunk)
                continue
            if part and size + len(chunk) > self.max_index:
                self._index(part)
                part, size = [], 0
            part.append(chunk)
            size += len(chunk)
        if part:
            self._index(part)
        return [b"".join([known[c] for c in chunks]) for chunks in split]

    def _plain(self, chunk: str) -> bytes:
        """A run of spaces and a word, with a heap of merges, best score first and leftmost among equals."""
        n = len(chunk)
        text, after, before = list(chunk), [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (i := self.ids.get(text[k] + text[after[k]])) is not None:
                heapq.heappush(heap, (-self.scores[i], k, after[k], text[k] + text[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, other, both = heapq.heappop(heap)
            if not text[k] or after[k] != other or text[k] + text[other] != both:
                continue
            text[k], text[other] = both, ""
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        out: list[int] = []
        for t in text:
            if t:
                out.extend([self.ids[t]] if t in self.ids else self._unknown(t, 0))
        return array("I", out).tobytes()

    def decode(self, coded: bytes) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in np.frombuffer(coded, "<u4").tolist()]).decode(errors="replace")
        return out[1:] if out.startswith(" ") else out


@cache
def model(path: str) -> PieceModel:
    """One for each Python worker."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, and the ids as bytes if asked, else whether they decode to the text."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                coded = m.encode(texts)
                last = pa.array(coded, pa.binary()) if ids else pa.array([m.decode(c) == x for c, x in zip(coded, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), last], ["doc_id", "n_ids", "ids_crc32", "ids" if ids else "round_trip"])

    schema = "doc_id long, n_ids long, ids_crc32 long, " + ("ids binary" if ids else "round_trip boolean")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_pieces(coded: DataFrame, path: str | None = None) -> DataFrame:
    """From doc_id and ids (bytes as encode_pieces gives them, null for none) the texts."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
