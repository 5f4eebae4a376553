"""Exact de-duplication by deterministic block naming, DataFrame functions only.

A text's bytes are cut into blocks of ``BLOCK`` bytes. Blocks are sorted, and
equal ones get one integer name; then every two adjacent names of a text are
taken as a pair, the pairs are sorted and named in the same way, and so on
until each text has a single name. A last name without a partner is paired
with null. A name stands for exactly one run of bytes of its level, so texts
have the same last name at the same level only if they are equal: no digest
decides.

Naming (``named``) sorts within ranges of a hash of the thing to be named, so
that a task's sort holds a bounded number of things. A thing that occurs more
than ``HOT`` times is first reduced to one row by partial aggregates and named
alone; its occurrences get the name by a join, whose large side Spark can
split. Every level holds half the rows of the one before, so the texts move
once and all levels together move less than twice the first names.

Rows of one ``doc_id`` are told apart by the SHA-256 of their texts, which the
result holds in any case; texts of different ids are never compared by it.

Defined results: a null text is the empty text, one block without bytes; null
ids are smaller than all others; of repeated rows of the id that stays, one
is kept; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wirelens.llm.common import cut

#: Bytes of a block.
BLOCK = 1024
#: A thing with more occurrences than this is named from its distinct value.
HOT = 1000
#: Occurrences that a range of the sort holds, about.
RANGE = 4096
#: Names of hot things lie above those of all others.
ABOVE = 1 << 62


def _sorted_names(things: DataFrame, thing: list[str], ranges: int) -> DataFrame:
    """``name``: the number of a thing's range and its rank within it."""
    order = Window.partitionBy("range").orderBy(*thing)
    return (things.withColumn("range", F.pmod("h", F.lit(ranges)))
            .withColumn("name", F.shiftleft("range", 32) + F.dense_rank().over(order)).drop("range"))


def _ranges(rows: int) -> int:
    return max(64, -(-rows // RANGE))


def hot_things(things: DataFrame, thing: list[str], hot_after: int) -> tuple[DataFrame, int, int]:
    """Hashes of the things with more than ``hot_after`` occurrences, their
    number, and the number of all occurrences."""
    seen = Observation()
    counts = things.select(F.xxhash64(*thing).alias("h")).groupBy("h").count()
    hot = cut(counts.observe(seen, F.sum("count").alias("rows")).filter(F.col("count") > hot_after).select("h"), "hot")
    return hot, hot.count(), seen.get["rows"] or 0


def named(things: DataFrame, thing: list[str], hot: DataFrame | None, rows: int) -> DataFrame:
    """``things`` with a column ``name`` in place of the columns ``thing``:
    the same for equal things, different for others. ``hot`` has the hashes
    of things that are named apart, if there are any."""
    rest = [c for c in things.columns if c not in thing]
    t = things.withColumn("h", F.xxhash64(*thing))
    if hot is None:
        return _sorted_names(t, thing, _ranges(rows)).select(*rest, "name")
    cold = _sorted_names(t.join(hot, "h", "left_anti"), thing, _ranges(rows)).select(*rest, "name")
    own = t.join(hot, "h", "left_semi")
    names = cut(_sorted_names(own.select("h", *thing).distinct(), thing, _ranges(rows))
                .withColumn("name", F.col("name") + F.lit(ABOVE)), "hot-names")
    same = reduce(lambda x, y: x & y, [own[c].eqNullSafe(names[c]) for c in thing], own["h"] == names["h"])
    return cold.union(own.join(names, same).select(*[own[c] for c in rest], names["name"]))


def identities(docs: DataFrame, block: int = BLOCK, hot_after: int = HOT) -> DataFrame:
    """doc_id, sha (binary SHA-256 of the text), copies (rows of this id and
    text), level and name: texts are equal if and only if both are."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    d = d.select("doc_id", "bytes", F.unhex(F.sha2("bytes", 256)).alias("sha"),
                 F.greatest(F.ceil(F.octet_length("bytes") / block), F.lit(1)).cast("long").alias("blocks"))
    b = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("pos"))
    b = b.select("doc_id", "sha", "blocks", "pos",
                 F.substring("bytes", (F.col("pos") * block + 1).cast("int"), F.lit(block)).alias("block"))
    hot, n_hot, rows = hot_things(b, ["block"], hot_after)
    level = named(b, ["block"], hot if n_hot else None, rows)
    level = cut(level.groupBy("doc_id", "sha", "blocks", "pos", "name").agg(F.count(F.lit(1)).alias("copies")), "names")
    done, k = [], 0
    while True:
        ended = level.filter("blocks = 1").select("doc_id", "sha", "copies", F.lit(k).alias("level"), "name")
        done.append(ended)
        rest = level.filter("blocks > 1")
        rows = rest.count()
        if not rows:
            break
        even = F.col("pos") % 2 == 0
        pairs = (rest.groupBy("doc_id", "sha", "copies", F.ceil(F.col("blocks") / 2).alias("blocks"),
                              F.floor(F.col("pos") / 2).alias("pos"))
                 .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")))
        if n_hot:  # only a pair of a hot name can be hot
            hot, n_hot, _ = hot_things(pairs, ["a", "b"], hot_after)
        level = cut(named(pairs, ["a", "b"], hot if n_hot else None, rows), "names")
        k += 1
    return reduce(DataFrame.union, done)


def exact_duplicates(docs: DataFrame, block: int = BLOCK, hot_after: int = HOT) -> DataFrame:
    """One row per row of ``docs``: the id that stays of its group of equal
    texts (the largest), the group's size, and whether this row stays."""
    each = identities(docs, block, hot_after)
    groups = cut(each.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    rows = each.join(groups, ["level", "name"]).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size",
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def query(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)


def oracle() -> str:
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY d.t, d.doc_id) = 1 AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
