"""Licence notices across line ends, and words that only a long line has together."""

from itertools import combinations

import numpy as np
import pytest

from tidewright.llm import licenses as L


def test_wrapped_notices_match_and_scattered_words_do_not(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, f"{filler}\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided"),
        (2, " * subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and"),
        (4, f"released {filler} under the {filler} mit {filler} license"),
        (5, "This project is released under the MIT license."),
    ]
    got = {r.doc_id: r.labels for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "mpl-2.0", 3: "mit-text", 4: "", 5: "mit"}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_windows_are_those_of_brute_force(threshold):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(200):
        template = list(rng.choice(vocabulary, rng.integers(1, 7)))
        text = [w.encode() for w in rng.choice([*vocabulary, "x", "y"], rng.integers(0, 40))]
        index, s, span = L.Index({"t": " ".join(template)}, threshold), {w.encode() for w in template}, L.WINDOW * len(template)
        order = [w.encode() for w in template]

        def fits(block):
            return len(s.intersection(block)) >= threshold * len(s) - 1e-9 and longest(order, block) >= threshold * len(order) - 1e-9

        best = max((len(s.intersection(b)) / len(s) for i in range(len(text)) if fits(b := text[i : i + span])), default=0.0)
        assert index.blocks("t", text) == best


def longest(a, b):
    """The most words of a that are a subsequence of b, by trying all of them."""
    for n in range(len(a), 0, -1):
        for part in combinations(a, n):
            rest = iter(b)
            if all(w in rest for w in part):
                return n
    return 0


def test_words_out_of_order_do_not_match(spark):
    rows = [(1, "under mit license the released"), (2, "it is released, freely, under the MIT license"), (3, "license license license released mit the under")]
    got = {r.doc_id: r.labels for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "mit", 3: ""}
