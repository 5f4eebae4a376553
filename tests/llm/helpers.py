"""Small tables with nulls, empty and long texts, ties, repeated rows and
columns whose names clash with the operators' own."""

import re

import numpy as np

CLASH = ("k1", "k2", "batch", "bucket", "n", "rep", "size", "key", "spans", "h", "place", "label2", "sk", "idx", "scores", "host", "best")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACE.split(low) if w]


def prose(r, k, vocabulary):
    return " ".join(vocabulary[i] for i in r.integers(0, len(vocabulary), k))


def corpus(seed=0, n=60, odd=True):
    """(doc_id, text, lang, source) with near and exact copies."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(map(chr, r.integers(97, 123, r.integers(2, 8)))) for _ in range(300)] + ["Über", "naïve", "漢字", "A,b", "x y", "👍"]
    rows = []
    for i in range(n):
        t = prose(r, int(r.integers(1, 120)), vocabulary)
        if i % 5 == 1 and rows:
            t = rows[int(r.integers(len(rows)))][1]
        elif i % 5 == 2 and rows:
            w = rows[int(r.integers(len(rows)))][1].split(" ")
            w[int(r.integers(len(w)))] = "edited"
            t = " ".join(w)
        rows.append((i * 7, t, "en" if i % 2 else "fr", "abc"[int(r.integers(3))]))
    if odd:
        rows += [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "fr", None), (4, "one two", "en", "b"), (4, "one two", "en", "b"),
                 (5, "ONE  two\tthree four", "en", "c"), (6, "one two three\nfour", "fr", "c"), (8, prose(r, 30_000, vocabulary), "en", "a"), (-3, "q" * 20_000, "fr", "b")]
    return rows


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], f"{schema}, {extra}")


def find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i
