import hashlib

import numpy as np
import pytest

from wirelens.llm import op8_repeats as op
from wirelens.llm.gsaca import suffix_arrays

SCHEMA = "doc_id long, text string, batch string, place int"


def brute(rows):
    """Every byte string of WIDTH bytes, in order of (id, text), by a dict."""
    seen, out = set(), []
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - op.WIDTH + 1):
            s = t[k:k + op.WIDTH]
            if s in seen:
                gone[k:k + op.WIDTH] = True
            seen.add(s)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted(map(tuple, op.query(d).collect()), key=str)


def corpus(seed=0, n=120):
    r = np.random.default_rng(seed)
    words = ["".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(400)] + ["éß", "漢字"]
    prose = lambda k: " ".join(words[i] for i in r.integers(0, len(words), k))
    passage = prose(60)
    rows = []
    for i in range(n):
        kind = i % 8
        t = prose(int(r.integers(1, 90)))
        if kind == 1:
            t = t + " " + passage + " " + prose(5)
        elif kind == 2 and rows:
            t = rows[int(r.integers(len(rows)))][1]
        elif kind == 3 and rows:
            t = rows[int(r.integers(len(rows)))][1] or ""
            at = int(r.integers(0, len(t) + 1))
            t = t[:at] + "EDIT" + t[at:]
        elif kind == 4:
            t = "ab" * int(r.integers(0, 900))
        elif kind == 5:
            t = "-" * int(r.integers(0, 300)) + t
        elif kind == 6:
            t = passage[:int(r.integers(90, 110))]
        rows.append((i * 37 % 5000, t))
    return rows + [(3, None), (3, ""), (3, "twice"), (3, "twice"), (None, "no id " * 40), (None, "no id " * 40)]


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_crowded_anchors_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(op, "CROWD", 2)
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 1000)
    rows = [(i, (t or "") * 9) for i, t in corpus(2, 40)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_suffix_arrays():
    r = np.random.default_rng(3)
    texts = [[*map(int, r.integers(1, 1 + r.integers(1, 5), r.integers(0, 80))), 0] for _ in range(200)]
    text = np.array([x for t in texts for x in [0, *t]])
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size + 1) - size
    sa = suffix_arrays(text, first, size)
    for t, f, n in zip(texts, first, size):
        assert [int(x - f) for x in sa[f:f + n]] == sorted(range(n), key=lambda i: t[i:])


@pytest.mark.parametrize("k", op.LEVELS)
def test_equal_strings_have_equal_anchors(k):
    r = np.random.default_rng(4)
    passage = r.integers(97, 101, 300).astype(np.uint8)
    a, b = (np.concatenate([r.integers(97, 101, m).astype(np.uint8), passage]) for m in (50, 333))
    found = []
    for text in (a, b):
        start, n, anchor, _ = op.segments(text, np.array([len(text)]), k)
        assert n.sum() == len(text) - op.WIDTH + 1
        found.append(dict(zip(np.concatenate([np.arange(s, s + m) for s, m in zip(start, n)]) - (len(text) - 300), np.repeat(anchor, n))))
    assert all(found[0][i] == found[1][i] for i in range(300 - op.WIDTH + 1))
