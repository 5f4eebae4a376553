import hashlib
from collections import defaultdict

import pytest

from tests.llm.helpers import corpus, frame
from wirelens.llm import op13_exact


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out, seen = [], set()
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep and (i, t or "") not in seen, hashlib.sha256((t or "").encode()).hexdigest()))
        seen.add((i, t or ""))
    return sorted(out, key=str)


def odd_rows():
    rows = corpus(3)
    long = rows[-2][1]
    rows += [(900, long, "en", "a"), (901, long + "x", "en", "a"), (902, "x" + long, "en", "a"), (903, long[:-1], "en", "a")]
    rows += [(None, None, None, None), (None, long, "fr", "b"), (None, long, "fr", "b"), (900, long, "en", "c"), (900, "other", "en", "c")]
    # blocks and pairs that are equal, in other places and other numbers
    rows += [(1000 + k, "ab" * 8 * k + tail, "en", "a") for k in range(5) for tail in ("", "ab", "c")]
    rows += [(2000 + k, "ab" * 32, "en", "a") for k in range(40)] + [(3000, "q" * 4096, "en", "a"), (3001, "q" * 4096, "en", "b"), (3002, "é" * 2048, "en", "b")]
    return rows


@pytest.mark.parametrize("block, hot", [(1024, 1000), (16, 3), (7, 1)])
def test_exact_duplicates(spark, block, hot):
    rows = odd_rows()
    got = sorted(map(tuple, op13_exact.exact_duplicates(frame(spark, rows), block, hot).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[3] for r in got) == len({t or "" for _, t, *_ in rows})


def test_empty_and_columns(spark):
    out = op13_exact.query(frame(spark, []))
    assert out.collect() == []
    assert dict(out.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}


def test_names_tell_every_pair_of_texts_apart(spark):
    """Names of a level are equal exactly where the texts are, whatever the hash: a few ranges and few bytes."""
    rows = [(i, "".join(c * (1 + i // 3 ** k % 3) for k, c in enumerate("abc")), "en", "a") for i in range(27)] * 2
    got = op13_exact.identities(frame(spark, rows), block=2, hot_after=4).collect()
    assert len(got) == 27 and all(r["copies"] == 2 for r in got) and len({(r["level"], r["name"]) for r in got}) == 27
