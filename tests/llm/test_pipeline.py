"""The corpus pipeline stage by stage against brute force on each stage's own input."""

import re

from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_quality import counts, failed
from tests.llm.test_rows import check_packing
from tidewright.common import Scratch, table
from tidewright.llm.packing import default_tokenizer
from tidewright.llm.toxicity import learn

SF = "/root/testdata/sf0.001"


def firsts(rows, least=0.8):
    """The smallest doc_id of each class of texts linked at a Jaccard similarity over five-word shingles."""

    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, of = [(d, shingles(t)) for d, t in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if (len(x & y) / len(x | y) if x or y else 1.0) >= least:
                of[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _) in enumerate(sets):
        best[root(i)] = min(best.get(root(i), d), d, key=lambda d: (d is None, d or 0))
    return sorted(best.values(), key=lambda d: d or 0)


def test_stages(spark):
    docs, scratch = table(spark, SF, "documents"), Scratch(spark, "t")
    columns, rows = docs.columns, {}
    for name, stage in C.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, SF), name.replace(" ", "-"))
        rows[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs.collect())
        assert docs.columns == columns or name == C.STAGES[-1][0]
    ids = lambda rs: sorted(r.doc_id for r in rs)

    lexicon = learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    before, after = rows["toxicity"]
    assert ids(after) == sorted(d for d, t in before if lexicon.score(lexicon.strength(t, lexicon.automaton())) < 0.5)
    before, after = rows["quality rules"]
    passed = {d for d, t in before if not failed(counts(t))}
    assert set(ids(after)) <= passed and len(after) >= 0.8 * len(passed)
    before, after = rows["line dedup"]
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after) == sorted((d, t, len(t)) for d, _, _, t in plain_lines(before))
    before, after = rows["SimHash near-dedup"]
    assert ids(after) == firsts(before)
    before, after = rows["best-fit packing"]
    t = Tokenizer.from_file(default_tokenizer())
    used, least = check_packing(after, {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in before}, 2048)
    assert used <= 1.05 * least + 2
    whole = C.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in after)


def test_stages_take_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string, score double, __n int, __gone int, __parts int, __r1 int, __SCORE int, __kept int, own int, `a.b` int"
    rows = [(1, None, None, None, None, "a", 0.1, 1), (2, "", "en", "s", 0, None, None, None), (None, "word " * 80, "en", None, 5, "b", 1.0, 2), (3, "same words here " * 40, "en", "s", 1, "c", 0.0, 3), (3, "same words here " * 40, "en", "s", 1, "c", 0.0, 3)]
    rows = [(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            out = stage(spark, docs, SF)
            assert name == C.STAGES[-1][0] or out.columns == docs.columns
            n = len(out.collect())
            assert n == 0 or data
    near = C.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted(((r.doc_id or 0) for r in near.collect())) == sorted((d or 0) for d in firsts([r[:2] for r in rows]))
