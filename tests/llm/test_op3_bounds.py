"""Near-dedup of large groups against brute force: edits at every distance,
some of them shared by several copies, at several bounds of rarity."""

import numpy as np
import pytest

from tests.llm.helpers import find
from wirelens.llm import op3_minhash


@pytest.mark.parametrize("rare", [op3_minhash.RARE, 3])
def test_large_groups_lose_no_link(spark, monkeypatch, rare):
    monkeypatch.setattr(op3_minhash, "RARE", rare)
    r, rows, sets = np.random.default_rng(3), [], []
    for g in range(3):
        base = [f"w{x}" for x in r.integers(0, 5000, 90)]
        for _ in range(50):
            w = list(base)
            for at in r.choice(90, int(r.integers(0, 7)), replace=False):
                w[at] = f"p{g}_{r.integers(6)}" if r.random() < 0.4 else f"e{r.integers(1 << 30)}"
            rows.append((len(rows), " ".join(w)))
            sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)})
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    found = op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == [
        (i, len(s), find(parent, i)) for i, s in enumerate(sets)]


def test_repeated_rows_lose_no_link(spark):
    """Rows that repeat an id and its text must not loosen or tighten a bound."""
    r, rows, sets = np.random.default_rng(5), [], []
    for g in range(8):
        base = [f"w{x}" for x in r.integers(0, 5000, 90)]
        for _ in range(14):
            w = list(base)
            for at in r.choice(90, int(r.integers(1, 4)), replace=False):
                w[at] = f"e{r.integers(1 << 30)}"
            rows += [(len(sets), " ".join(w))] * int(r.integers(1, 7))
            sets.append({tuple(w[k:k + 4]) for k in range(len(w) - 3)})
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    found = op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == sorted(
        (i, len(sets[i]), find(parent, i)) for i, _ in rows)
