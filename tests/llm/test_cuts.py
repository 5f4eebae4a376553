"""Shuffle files of cut tables, and components that further edges join."""

import os
import time
from random import Random

from pyspark.sql import functions as F

from tests.llm.helpers import find
from wirelens.llm import op3_minhash
from wirelens.llm.common import SHUFFLE_CLEANUP, components, cut, joined_components


def _shuffles(spark) -> set:
    jvm = spark.sparkContext._jvm
    folders = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _at, _in, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_job_that_cut(spark):
    before = _shuffles(spark)
    cut(spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).agg(F.collect_list("id").alias("ids")), "shuffled")
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")


def test_joined_components_are_those_of_all_edges(spark):
    r = Random(5)
    first = [(r.randrange(300), r.randrange(300)) for _ in range(120)]
    for more in ([(r.randrange(400), r.randrange(400)) for _ in range(90)], [(a, a) for a in range(5)], [], first[:7]):
        parent = list(range(400))
        for a, b in first + more:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
        known = cut(components(spark.createDataFrame(first, "a long, b long")), "known")
        got = {tuple(x) for x in joined_components(known, spark.createDataFrame(more, "a long, b long")).collect()}
        seen = {x for e in first + more for x in e if find(parent, x) != x or any(find(parent, y) == x for y in range(400) if y != x)}
        assert got == {(x, find(parent, x)) for x in seen}


def test_all_links_are_gone_through_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(op3_minhash, "components", lambda links: calls.append(1) or components(links))
    base = [f"w{x}" for x in range(60)]
    rows = [(i, " ".join(base[:i % 7] + [f"e{i}"] + base[i % 7 + 1:])) for i in range(40)]
    found = op3_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 40 and calls == [1]
