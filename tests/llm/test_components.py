"""Connected components: few jobs where the edges are stars already."""

import numpy as np

from tests.llm.helpers import find
from wirelens.llm import common


def _noted(monkeypatch):
    seen, real = [], common.cut

    def noted(df, name, batch=None):
        seen.append(name)
        return real(df, name, batch)

    monkeypatch.setattr(common, "cut", noted)
    return seen


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def test_stars_take_no_round(spark, monkeypatch):
    seen = _noted(monkeypatch)
    got = common.components(_edges(spark, [(5, 1), (1, 5), (1, 7), (9, 2), (3, 3)])).collect()
    assert sorted((r.id, r.component) for r in got) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert seen == ["edges"]
    assert common.components(_edges(spark, [])).count() == 0


def test_what_joins_known_components_is_cut_once(spark, monkeypatch):
    known = _edges(spark, [(1, 1), (5, 1), (2, 2), (9, 2)]).toDF("id", "component")
    seen = _noted(monkeypatch)
    got = common.joined_components(known, _edges(spark, [(5, 9), (9, 5), (20, 30), (1, 5)])).collect()
    assert sorted((r.id, r.component) for r in got) == [(1, 1), (2, 1), (5, 1), (9, 1), (20, 20), (30, 20)]
    assert seen == ["across"]


def test_components_of_paths_stars_and_chance(spark):
    r = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(100, 130)] + [(200, 200 + int(i)) for i in range(1, 20)]
    pairs += [(int(a), int(b)) for a, b in r.integers(1000, 1060, (45, 2))]
    parent = {}
    for a, b in pairs:
        parent.setdefault(a, a), parent.setdefault(b, b)
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    wanted = sorted((x, find(parent, x)) for p in pairs if p[0] != p[1] for x in p)
    half = common.components(_edges(spark, pairs[::2]))
    for got in (common.components(_edges(spark, pairs)), common.joined_components(half, _edges(spark, pairs[1::2]))):
        assert sorted((x.id, x.component) for x in got.collect()) == sorted(set(wanted))
