"""Licences, packing and toxicity against brute force, and odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewright.llm import licenses as L
from tidewright.llm import packing as P
from tidewright.llm import toxicity as T
from tidewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, labels string, sequence_id int, score double"
ODD = [(1, None, "x", 1, 0.5), (2, "", None, 2, None), (None, "released under the MIT license", "y", 3, 1.0), (4, "All rights reserved. cc-by " * 30_000, "z", 4, 0.0), (4, "a b", "z", 4, 0.0), (4, "a b", "z", 4, 0.0)]


def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_license(text, templates=L.TEMPLATES, threshold=0.9):
    w = plain_words(text)
    places = defaultdict(list)
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places[label].append(i)
    found = {}
    for line in (text or "").split("\n"):
        block = set(plain_words(line))
        for label, t in templates.items():
            s = set(t.split())
            if len(s & block) >= threshold * len(s) - 1e-9:
                found[label] = max(found.get(label, 0), len(s & block) / len(s))
    starts = [i for v in places.values() for i in v]
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *found})), 1.0 if starts else max(found.values(), default=0.0))


def test_license_whole_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_license_scan"](spark, SF).collect()}
    assert got == {r["doc_id"]: plain_license(r["text"]) for r in documents()}
    assert any(x[1] for x in got.values())


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_license_index_loses_nothing(threshold):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": " ".join(rng.choice(vocabulary, rng.integers(1, 9), replace=False)) for i in range(12)}
    index = L.Index(templates, threshold, {w.encode(): int(rng.integers(0, 5)) for w in vocabulary})
    for _ in range(400):
        block = {w.encode() for w in rng.choice(vocabulary, rng.integers(0, 14), replace=False)}
        sets = {k: {w.encode() for w in v.split()} for k, v in templates.items()}
        want = {k: len(s & block) / len(s) for k, s in sets.items() if len(s & block) >= threshold * len(s) - 1e-9}
        assert index.match(block) == want


def test_license_odd_rows(spark):
    got = sorted((r.doc_id or 0, r.n_words, r.labels) for r in L.license_scan(spark.createDataFrame(ODD, DOCS)).collect())
    assert got == sorted((d or 0, plain_license(t)[0], plain_license(t)[5]) for d, t, *_ in ODD)
    assert L.license_scan(spark.createDataFrame([], DOCS)).collect() == []


def check_packing(rows, want, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.piece))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in want.items():
        pieces = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert sorted(by_doc[doc]) == [(k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), k) for k, p in enumerate(pieces)]
    total = sum(n for seq in by_seq.values() for _, n in seq)
    return len(by_seq), -(-total // capacity)


def test_packing_whole_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in documents()}
    used, least = check_packing(QUERIES["op6_packing"](spark, SF).collect(), want, 2048)
    assert used <= 1.03 * least + 1


def test_packing_odd_rows(spark):
    rows = P.pack(spark.createDataFrame(ODD, DOCS), shard_pieces=50).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert P.pack(spark.createDataFrame([], DOCS)).collect() == []


def check_encoder(coder, tokenizer, texts):
    ids, bounds = coder.encode(pa.array(texts, pa.string()), 7)
    assert len(bounds) == len(texts) + 1 and len(ids) == bounds[-1]
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 7], text


@pytest.mark.parametrize("by_words", [True, False])
def test_encoder_is_the_tokenizer_on_whole_texts(by_words):
    from tokenizers import Tokenizer

    t, coder = Tokenizer.from_file(P.default_tokenizer()), P.WordEncoder(P.default_tokenizer(), by_words, max_odd=5)
    check_encoder(coder, t, [])
    check_encoder(coder, t, [None, "", " \n", "It's  a test x", "\u00e9 \u0301a don't", "a\x1cb c\x85d", "<|endoftext|> <|startoftext|>x", "12 3.4 \u00bfqu\u00e9?\t\u00f1\n"])
    check_encoder(coder, t, ["日本語 テスト 😀👍🏽", "\u200b x\ufeff", "'sing 'S s's it's' ''s (don't) <|x|> a_b _a_ x<|endoftext|>y", "Éa, ÉA! Ǆ ŉ İi ſ ß, Ⅷ a² ªb ʰc", "e\u0301. \u0301a, K", "a. A, a! b. (b) [b] \"b\" `b` ^b~"])
    check_encoder(coder, t, ["PERİ.", "İ! aİ, İa", "ΟΔΟΣ Σας.", "a" * 3000 + "é" * 3000])
    # Every letter that may go to the second engine, at each place of a word.
    letters = [chr(c) for c in [*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x400, 0x500)]]
    check_encoder(coder, t, [f"{a}{c}{b}" for c in letters for a, b in (("", ""), ("a", ""), ("", "a"), ("x", "y"), (".", "!"))])
    rng = np.random.default_rng(5)
    alphabet = list("abcXYZ'é.ÉßİıŉǄǅΣσςДд!?<|>#  \n\t日本12½ªſKﬁ-_`^&\x1c\x85") + ["\u0301", "\u200b"]
    check_encoder(coder, t, ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(20_000)])


def test_only_a_known_tokenizer_is_read_by_words():
    import public_tokenizers

    assert P.by_words(P.default_tokenizer())
    assert not P.by_words(public_tokenizers.path("byte_bpe_50k.json"))


def test_slices_hold_every_row():
    texts = pa.array(["a" * n if n else None for n in (5, 0, 100, 3, 3, 3, 0)])
    assert list(P.byte_slices(texts, 10)) == [(0, 2), (2, 1), (3, 4)]
    assert list(P.byte_slices(texts.slice(0, 0), 10)) == []


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by):
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 800).tolist(), reverse=True)
    bins, places = P.best_fit(lengths, 100, 4, 5000, by=by)
    of = defaultdict(list)
    for n, b, p in zip(lengths, bins, places):
        of[b].append((p, n))
    for x in of.values():
        assert sum(n for _, n in x) <= 100 and len(x) <= 4 and (len(x) == 1 or sum(n * n for _, n in x) <= 5000)


def test_what_fits_no_bin_is_an_error():
    for limits in ((100, 4, 2499), (49, 4, 10_000), (100, 0, 10_000)):
        with pytest.raises(ValueError, match="fits no bin"):
            P.best_fit([50, 3], *limits)


def test_ties_go_to_the_bin_opened_first():
    bins, places = P.best_fit([60, 60, 60, 40, 40, 40], 100, 9, 10_000)
    assert bins[:3] == [0, 1, 2] and sorted(bins[3:]) == [0, 1, 2] and places == [0, 0, 0, 60, 60, 60]


def test_limits_that_bind(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 40)) for i in range(400)], "doc_id long, text string")
    for limits, per_bin, cost in (({"max_docs": 3}, 3, 10**9), ({"max_attention": 2000}, 10**9, 2000), ({"max_docs": 5, "max_attention": 3000, "by": "dot"}, 5, 3000)):
        of = defaultdict(list)
        for r in P.pack(docs, capacity=100, **limits).collect():
            of[r.sequence_id].append(r.length)
        assert sum(map(len, of.values())) == 400
        assert all(sum(v) <= 100 and len(v) <= per_bin and sum(n * n for n in v) <= cost for v in of.values())


def test_ids_come_back_whole(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = P.pack(docs, capacity=64, ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_best_fit_takes_the_least_norm():
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 60, 200).tolist(), reverse=True)
    w, (cap, docs, att) = (1.0, 0.5, 0.5), (100, 5, 6000)
    bins, _ = P.best_fit(lengths, cap, docs, att, weights=w)
    left, norms = [], []
    for n, b in zip(lengths, bins):
        fits = {i: sum(x * ((r - u) / c) ** 2 for x, r, u, c in zip(w, res, (n, 1, n * n), (cap, docs, att))) for i, res in enumerate(left) if res[0] >= n and res[1] >= 1 and res[2] >= n * n}
        if fits:
            assert fits[b] == pytest.approx(min(fits.values()))
            norms.append(b)
        else:
            assert b == len(left)
            left.append([cap, docs, att])
        left[b] = [left[b][0] - n, left[b][1] - 1, left[b][2] - n * n]
    assert norms


def test_toxicity_folds_and_excepts():
    lex = T.Lexicon()
    auto = lex.automaton()
    for text in ["you idiot", "1d10t!", "IDIOT!!", "іdіоt", "ｉｄｉｏｔ***", "c1own", "tr4sh", "wor7hle5s", "id​iot", "$tupid m0ron"]:
        assert lex.strength(text, auto) > 0, text
    for text in [None, "", "the trash can", "clownish idiotic trashy", "a scumx b", "12 345 $$$ !!!", "vidiot"]:
        assert lex.strength(text, auto) == 0, text
    assert lex.strength("idiot " + "calm " * 500, auto) < lex.strength("idiot calm", auto)


def plain_strength(lex, text):
    """Every place against every term and phrase, one by one."""
    f = T.folded(text)

    def stands(form, whole, i):
        j = i + len(form)
        return f.startswith(form, i) and not (i and f[i - 1].isalpha()) and not (whole and j < len(f) and f[j].isalpha())

    safe = [(i, i + len(p)) for p in lex.exceptions for i in range(len(f)) if stands(p, True, i)]
    total = 0.0
    for i in range(len(f)):
        weights = [w for term, w in lex.terms.items() for form in {term.rstrip("$"), term.rstrip("$").replace("l", "i")} if stands(form, term.endswith("$"), i) and not any(a <= i and i + len(form) <= b for a, b in safe)]
        total += max(weights, default=0.0)
    return total / (1 + np.log1p(len(text.split())))


def test_toxicity_matches_as_brute_force_does():
    rng = np.random.default_rng(8)
    letters = list("ab1lo0 .é")
    for _ in range(150):
        terms = {"".join(rng.choice(list("ablo"), rng.integers(1, 5))) + ("$" if rng.random() < 0.5 else ""): float(rng.integers(1, 9)) for _ in range(rng.integers(0, 8))}
        phrases = tuple("".join(rng.choice(list("abo"), 2)) + " " + "".join(rng.choice(list("abo"), 2)) for _ in range(rng.integers(0, 6)))
        lex = T.Lexicon(terms, phrases)
        automaton = lex.automaton()
        for _ in range(20):
            text = "".join(rng.choice(letters, rng.integers(0, 60)))
            assert lex.strength(text, automaton) == pytest.approx(plain_strength(lex, text)), (terms, phrases, text)


def test_toxicity_learns_exceptions_and_scores_ties_alike(spark):
    rows = [(i, f"you utter {'calm' if i % 3 else 'grobnik'} person number{'x' * (i % 7)}", int(i % 3 == 0)) for i in range(600)]
    rows += [(1000 + i, f"the grobnik river flows by village{'y' * (i % 5)}", 0) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lex = T.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert any(p in lex.exceptions for p in ("the grobnik", "grobnik river"))
    score = lambda x: lex.score(lex.strength(x, lex.automaton()))
    assert score("you utter grobnik") > 0.5 > score("down at the grobnik river")
    again = spark.createDataFrame([(1, "you utter grobnik")] * 3 + [(2, "you utter grobnik")], "doc_id long, text string")
    assert len({r[2] for r in T.score_toxicity(again, lex).collect()}) == 1


def test_toxicity_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "you idiot idiot", 1, 2, 3), (2, "calm", 1, 2, 3)], "doc_id long, text string, __SCORE int, read int, `a.b` int")
    out = T.drop_toxic(df, T.Lexicon())
    assert out.columns == df.columns and [r[0] for r in out.collect()] == [2]


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    rows = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    found = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(not y for _, y in held)
    assert found > 0.85 and wrong < 0.01, (found, wrong)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex = T.learn(docs, empty)
    assert lex.terms == T.GENERAL
    out = T.score_toxicity(docs, lex)
    assert out.columns == [*docs.columns, "__score"] and out.count() == len(ODD)
    T.learn(docs, spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int"))
    assert T.score_toxicity(spark.createDataFrame([], DOCS), lex).collect() == []
