"""Mixing with equal rows of two sources, rows repeated often and hot ids."""

import re
from collections import Counter, defaultdict

from wirelens.llm import op5_mix

SCHEMA = "doc_id long, text string, source string, sk string, start long"


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_equal_rows_of_two_sources(spark):
    same = "one two three four " * 25
    rows = [(1, same, "s1", "x", 7), (1, same, "s2", "y", 8), (2, "five six " * 3, "s2", None, 9), (None, same, None, "z", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = op5_mix.mixed_documents(d, block=4, shard_slots=8).collect()
    taken = defaultdict(int)
    for r in op5_mix.mixed_sizes(d, block=4, shard_slots=8).collect():
        taken[r["doc_id"]] += r["taken"]
    per = defaultdict(int)
    for r in got:
        per[r["doc_id"]] += count(r["text"])
        assert (r["doc_id"], r["source"], r["sk"], r["start"]) in {(x[0], x[2], x[3], x[4]) for x in rows}
    assert per == {k: v for k, v in taken.items() if v}
    by_source = Counter()
    for r in got:
        by_source[r["source"]] += count(r["text"])
    want = {r["source"]: r["target"] for r in op5_mix.mix(d, 4, 8).sources.collect()}
    assert all(abs(by_source[s] - want[s]) <= 1 for s in want) and by_source["s1"] and by_source["s2"]


def test_repeated_rows_are_the_same_in_every_run(spark):
    rows = [(5, "a b c d", "s", str(i), i) for i in range(40)] + [(6, "e f", "s", "q", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(op5_mix.mixed_documents(x, block=4).collect(), key=str) for x in (d, d.repartition(7), d.orderBy(d.start.desc()))]
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_places_of_hot_rows(spark):
    """A row that repeats more often than a task makes, a hot null id, rows without words."""
    rows = ([(None, "a b c", "s")] * 90 + [(None, f"w{i} " * (i % 5 + 1), "s") for i in range(60)] + [(3, "", "s")] * 30
            + [(None, None, "t")] * 30 + [(i, "p q", "t") for i in range(40)])
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = op5_mix.mix(d, block=4)
    sized = [(s, i, n) for i, t, s in rows if (n := count(t))]
    for some in (m.placed, op5_mix.placed(d.selectExpr(
            "doc_id", "concat('s', source) AS sk", "xxhash64(text) AS th", "CAST(regexp_count(text, '[^ ]+') AS LONG) AS size"), repeats=7)):
        got = some.collect()
        assert Counter((r["sk"][1:], r["doc_id"], r["size"]) for r in got) == Counter(sized)
        for s in ("s", "t"):  # the places of a source cover its words once, without gaps
            at = 0
            for start, size in sorted((r["start"], r["size"]) for r in got if r["sk"] == "s" + s):
                assert start == at
                at += size
    assert m.empty.count() == 60
    out = op5_mix.mixed_sizes(d, block=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, count(t)) for i, t, _ in rows)


def test_slots_of_a_source_are_made_in_many_tasks(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 40) AS text", "'s' AS source")
    m = op5_mix.mix(d, block=4, shard_slots=256)
    with_rows = m.slots.selectExpr("spark_partition_id() AS p").distinct().count()
    assert m.slots.count() == m.sources.first()["slots"] and with_rows > 1
