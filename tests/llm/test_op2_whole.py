"""The language model keeps every gram, however small its segments must be."""

import math
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import corpus, frame, words
from wirelens.llm import op2_lm


def level(c):
    q = int(math.log2(c)) if c else 0
    return (2.0 ** q + 2.0 ** (q + 1) - 1) / 2 if c else 0.0


@pytest.mark.parametrize("most_bytes, part", [(1 << 26, 6_000_000), (20_000, 6_000_000), (20_000, 20_000)])
def test_lm_keeps_every_gram(spark, monkeypatch, most_bytes, part):
    monkeypatch.setattr(op2_lm, "SLICE", part)
    rows = corpus(5, 50) + [(7, "hot id " * k, "en", "a") for k in range(1, 40)] + [(2 ** 53 + 1, "a long id", "en", "a"), (None, None, None, None)]
    toks = [[*words(t), None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, *_ in rows]
    train, pairs = Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            train.update(t)
            pairs.update(zip(["<", *t], t))
    n, kinds, texts = sum(train.values()), len(train), sum(not h for h in held)
    want = []
    for (i, *_), t, h in zip(rows, toks, held):
        s = 0.0
        for v, w in zip(["<", *t], t):
            joint, context = level(pairs[v, w]), texts if v == "<" else level(train[v])
            p = min((level(train[w]) + 0.1) / (n + 0.1 * (kinds + 1)), 1.0)
            s += math.log10((joint + op2_lm.MU * p) / (max(context, joint) + op2_lm.MU))
        want.append((str(i), h, len(t), sum(train[w] > 0 for w in t), n, s))
    got = [(str(r["doc_id"]), *r[1:5], r["score"]) for r in op2_lm.scores(frame(spark, rows), most_bytes=most_bytes).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=0.03, abs=0.5)  # false positives of the filter
