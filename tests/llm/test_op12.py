import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import frame
from wirelens.llm import op12_spelling


def edits(a, b):
    """Whether a and b differ by exactly one insertion, deletion or replacement."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def corpus(seed):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdeÀéÿ×") for _ in range(r.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abababab"]
    words = []
    for w in common:
        k = r.choice([6, 30, 170, 900])
        words += [w] * k
        for _ in range(6):
            v, at = w, r.randrange(len(w))
            for _ in range(r.choice([1, 1, 1, 2])):
                c = r.choice("abcdeÀéÿz")
                v = r.choice([v[:at] + v[at + 1:], v[:at] + c + v[at + 1:], v[:at] + c + v[at:]])
            words += [v] * r.choice([2, 5, 6, 40])
    words += ["stepone"] * 3000 + ["steponee"] * 500 + ["steponeee"] * 60 + ["steponeeee"] * 7 + ["Steponé"] * 9
    words += ["q" * 3000] * 6 + ["q" * 2999] * 40 + ["short"] * 90 + ["tiesaa"] * 50 + ["tiesab"] * 50 + ["tiesac"] * 6
    r.shuffle(words)
    cuts = sorted(r.sample(range(len(words)), 300))
    texts = [r.choice([" ", "-", "1", "漢", "\n"]).join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
    rows = [(k * 3 - 50, t.upper() if k % 7 == 0 and t.isascii() else t, "en", "a") for k, t in enumerate(texts)]
    return rows + [(None, "stepone " * 20, None, None), (None, None, "en", "a"), (4, "", "en", "a"), (5, "漢字 12 .", "en", "a"), rows[3], rows[3]]


@pytest.mark.parametrize("symbols, crowd", [(8, 1000), (2, 4)])
def test_spelling_groups(spark, symbols, crowd):
    rows = corpus(5)
    want = brute(rows)
    assert any(w[2] != w[1] and w[1] for w in want) and max(w[4] for w in want) > 4
    got = op12_spelling.spelling_groups(frame(spark, rows), symbols, crowd).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(op12_spelling, "PIECE", 7)
    text = "".join(random.Random(2).choice("abcÿ  ,") for _ in range(500)) + "x" * 50
    assert [w for p in op12_spelling._pieces(text) for w in op12_spelling.RUN.findall(p)] == op12_spelling.RUN.findall(text)


def test_neighbourhoods_meet_every_edit():
    r = random.Random(3)
    letters = [chr(c) for c in op12_spelling.LETTERS]
    for symbols in (8, 3, None):
        of, every = op12_spelling._values(symbols)
        values = lambda w: of[np.array([[ord(c) for c in w]])]
        for _ in range(200):
            w = "".join(r.choices(letters, k=r.randint(6, 12)))
            k, c = r.randrange(len(w)), r.choice(letters)
            for v in (w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w[:k] + c + w[k:], w):
                assert op12_spelling.reduced_keys(values(v))[0] in op12_spelling.neighbour_keys(values(w), every)[0]


def test_empty_and_types(spark):
    out = op12_spelling.query(frame(spark, []))
    assert out.collect() == []
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_neighbourhoods_are_not_broadcast(spark):
    """Their size, 17 keys a letter, is not that of the words which Spark goes by."""
    vocab = spark.createDataFrame([("abcdef", 9), ("abcdeg", 50), ("abcxef", 7)], "word string, n long")
    for crowd in (1000, 0):
        pairs = op12_spelling.near_pairs(vocab, crowd=crowd)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString(), pairs._jdf.queryExecution().executedPlan().toString()
        assert plan[0].count("strategy=merge") == plan[1].count("SortMergeJoin [key") == (1 if crowd else 2)
        assert sorted(map(tuple, pairs.collect())) == [("abcdef", "abcdeg", 50), ("abcdef", "abcxef", 7), ("abcdeg", "abcdef", 9), ("abcxef", "abcdef", 9)]
