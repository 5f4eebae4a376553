"""What op3 moves: texts of documents that may have a link, sets that are still needed."""

from pyspark.sql import functions as F

from tests.llm.helpers import frame
from wirelens.llm import op3_minhash
from wirelens.llm.common import cut


def test_marked_rows_hold_all_that_are_wanted_and_few_others(spark):
    docs = spark.range(20000).select((F.col("id") * 7 - 9).alias("doc_id"), F.lit("x").alias("text")).union(
        spark.sql("SELECT CAST(NULL AS BIGINT), 'null'"))
    for step in (1, 50, 30000):
        wanted = docs.filter((F.col("doc_id") + 9) % (7 * step) == 0).select("doc_id")
        got = op3_minhash.marked(docs, wanted)
        assert got.columns == ["doc_id", "text"]
        assert got.join(wanted, "doc_id").count() == wanted.count()
        assert got.count() == got.select("doc_id").distinct().count() <= wanted.count() + 0.15 * 20000
    assert op3_minhash.marked(docs, docs.limit(0).select("doc_id")).count() == 0


def test_repeated_ids_stay_repeated_when_marked(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (1, "c")], "doc_id int, text string")
    got = op3_minhash.marked(docs, docs.filter("doc_id = 1").select("doc_id").distinct())
    assert sorted(r.text for r in got.filter("doc_id = 1").collect()) == ["a", "a", "c"]


def test_sets_are_moved_again_only_where_buckets_are_mixed(spark, monkeypatch):
    rows, seen = {}, []

    def noted(df, name, *a):
        out = cut(df, name, *a)
        if name in ("sets", "left-sets"):
            rows[name] = out.count()
        seen.append(name)
        return out

    monkeypatch.setattr(op3_minhash, "cut", noted)
    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join([*words, f"end{i % 2}"]), None, None) for i in range(6)] + [(100 + i, f"alone {i} " * 9, None, None) for i in range(6)]
    got = {r.doc_id: r.component_id for r in op3_minhash.query(frame(spark, data)).collect()}
    assert [got[i] for i in range(6)] == [0] * 6
    assert rows["sets"] == 2 and rows["left-sets"] == 0 and seen.count("signatures") == 2
