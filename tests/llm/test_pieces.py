"""SentencePiece encoding against the library, the index against plain search, and odd rows."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece

from tidewright.llm import pieces as P
from tidewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
TEXTS = [
    "", " ", " a", "Hello  world\n\tfoo ", "a   b    c     d\n\n   x", "<s> x ▁y</s><0x0A>", "日本語テスト 😀👍🏽 ñandú", "aaaaaaaaaaaaaaa " * 3, "tab\tx\x00y",
    " " * 40 + "x" + " " * 17, "café́ naïve 1234567 ::::: ---- ====== ......", "x" * 5000, "zzzzz ooooooo lllllllll http://www.a.b/?c=d&e=f", "​ ﻿ a\u0085b",
]


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


@pytest.mark.parametrize("limits", [(10**6, 400_000), (50, 3_000)])
def test_the_library_agrees(limits):
    m = P.PieceModel(P.default_model(), *limits)
    docs = [(r["text"] or "")[: limits[1]] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()][: limits[1] // 300]
    rng = np.random.default_rng(8)
    letters = np.array(list("aabbeeeorst  .,\n▁é日"))
    random = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(300)]
    for part in (TEXTS, docs, random, TEXTS):
        for text, coded in zip(part, m.encode(part)):
            want = SP.encode(text)
            assert ids(coded) == want, text
            assert m.decode(coded) == SP.decode(want), text


def test_suffix_array():
    rng = np.random.default_rng(0)
    for kinds in (3, 40_000):
        x = rng.integers(1, kinds, 700).astype(np.int32)
        keys = [tuple(x[i : i + 16]) for i in range(len(x))]
        order = P.suffix_order(x, 16)
        assert [keys[i] for i in order] == sorted(keys)
        pieces = np.array([x[i : i + 3] for i in range(0, 600, 7)] + [[1, 1, kinds]], np.int32)
        low, high = P.occurrence_ranges(x, order, pieces)
        for p, a, b in zip(pieces, low, high):
            assert sorted(order[a:b]) == [i for i in range(len(x)) if keys[i][:3] == tuple(p)]


def test_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, SF).collect()}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        want = np.array(SP.encode(r["text"] or ""), "<u4")
        got = rows[r["doc_id"]]
        assert (got.n_ids, got.ids_crc32, got.round_trip) == (len(want), zlib.crc32(want.tobytes()), SP.decode(want.tolist()) == (r["text"] or ""))


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "a", 2), (3, "", 3), (4, "word " * 200_000, 4), (4, "x", 5), (4, "x", 5)]
    coded = P.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids int"), ids=True)
    assert sorted((r.doc_id or 0, r.text) for r in P.decode_pieces(coded).collect()) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert P.encode_pieces(spark.createDataFrame([], "doc_id long, text string")).collect() == []
