import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import words
from wirelens.llm import op11_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, up string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (r, t)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    paths = rebuilt(rows)
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    kids = {n: 0 for n in nodes}
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n, ids in nodes.items():
        own = (len(ids) - 1) * len(words(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += own
    return sorted(((min(ids), len(n), min(nodes[n[:-1]]) if n else None, len(ids), kids[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(n)))).encode()).hexdigest())
                   for n, ids in nodes.items()), key=str)


def conversations(seed, n=90, odd=True):
    r = random.Random(seed)
    said = [f"{w} {' '.join('xyz'[:k])}" for k in range(4) for w in ("Hello", "so\tbe", "é", "")]
    rows = []
    for c in range(n):
        if c % 3 == 1:  # a third of all are one conversation
            turns = [("user", "Hello x"), ("assistant", "so be it"), ("user", "one"), ("user", "two"), ("assistant", "three")]
        else:
            turns = [(r.choice(["user", "assistant"]), r.choice(said)) for _ in range(r.randint(1, 6))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    if odd:
        rows += [(500, None, "user", "first"), (500, 3, None, None), (500, 3, "user", "tie"), (500, 3, "user", "tie"), (None, 0, "user", "no id"),
                 (-3, 0, "user", "below"), (-20, 0, "user", "below"), (-20, 1, "user", "zero"), (707, 0, "user", "q " * 20_000), (10 ** 12, 5, "user", "alone")]
        rows += [(k, t, "user", f"long {t}") for k in (600, 601, 602, 619) for t in range(300 + k % 7)]
        rows += [(f, 0, "user", "only") for f in range(800, 830)]  # some have no turn after their first ones
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [20_000, 5])
def test_trie(spark, most):
    rows = conversations(1)
    got = op11_trie.trie(frame(spark, rows), most=most)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_and_types(spark):
    out = op11_trie.query(frame(spark, []))
    assert out.collect() == []
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert out.columns == op11_trie.OUT


def _path(turns, ends):
    key, last = b"", b""
    for t in turns:
        last = hashlib.sha256(last + t.encode()).digest()[:op11_trie.WIDTH]
        key += last
    n = len(turns)
    return (key, n, [len(t) for t in turns], [n], [1], [ends], [0], [0], [0], [str(ends)])


def test_runs_merge_to_the_forest_of_all():
    """Cut into runs of any size, over several rounds, the nodes are those of one run."""
    r = random.Random(4)
    for trial in range(60):
        some = {tuple(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 40))}
        paths = sorted(_path(p, k) for k, p in enumerate(sorted(some)))
        whole, none = op11_trie.forest(paths, True)
        assert none == []
        got, left, size = [], paths, r.randint(3, 9)
        while len(left) > size:
            rest = []
            for k in range(0, len(left), size):
                nodes, kept = op11_trie.forest(left[k:k + size], False)
                got += nodes
                rest += kept
            left = rest
        got += op11_trie.forest(left, True)[0]
        assert sorted(tuple(n[2:4]) + tuple(n[5:]) for n in got) == sorted(tuple(n[2:4]) + tuple(n[5:]) for n in whole)
