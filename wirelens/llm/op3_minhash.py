"""MinHash near-dedup: one-permutation hashing with optimal densification.

A document is the set of its word shingles' hashes. Equal sets are one class,
kept by its smallest id. A set's hashes fall into ``BINS`` bins by their top
bits and the smallest of each bin is the signature; an empty bin takes the
value of the first full bin on its own pseudorandom walk, the same walk for
all documents. ``ROWS`` bins make a band; classes that agree in a band share
a bucket.

Every bucket gives a star: edges from its smallest class to the others, so a
bucket of m classes gives m - 1 edges. Edges are confirmed by intersecting
the full sets. Where a bucket still holds several components afterwards:

- A class that shares fewer than 80 percent of its shingles with the other
  sets of such buckets can have no link there and leaves.
- Of the others, pairs with a shingle in common that at most ``RARE`` of them
  hold are made from that shingle, and tested where the rare ones in common
  and the smaller number of other shingles allow a link.
- The rest have only frequent shingles in common; the next 16, 256, 4096,
  ... classes of a bucket become centres for the pairs across components whose
  numbers of frequent shingles allow a link, each centre leaving the bucket,
  until what is left of every bucket is one component. A pair of several
  buckets is made in the first of them.

The bounds are exact, so no link inside a bucket is lost.

With 32 bands of 4 rows, a pair of similarity 0.8 shares no bucket with
probability (1 - 0.8^4)^32, about 5e-8.

Defined results: a null text, or one without words, has an empty set, links
with nothing and is its own component; rows with a null id take part in no
link (component null, not kept); rows that repeat an id are joined by it;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import components, cut, drop, joined_components, tidy
from wirelens.llm.tokens import P1, P2, mix, shingles, word_hashes

BINS, ROWS = 128, 4
SHIFT = np.uint64(64 - BINS.bit_length() + 1)
EDGES = np.arange(BINS, dtype=np.uint64) << SHIFT
#: Percent of the union that the intersection needs.
PERCENT = 80
#: A shingle in no more sets than this is rare: its pairs are made directly.
RARE = 8
#: Centres that a bucket has in the first round, and times as many in each next.
FIRST_CENTRES, MORE_CENTRES = 16, 16
#: Bits of an id in the marks of ``marked``, and most bits in all, by their logarithm.
MARK_BITS, MOST_MARKS = 16, 26


def _walks(steps: int) -> np.ndarray:
    at = np.arange(steps, dtype=np.uint64)[:, None] * P1 + np.arange(BINS, dtype=np.uint64)[None, :] * P2 + np.uint64(11)
    return (mix(at) >> SHIFT).astype(np.int64)


#: The bin that an empty bin (column) looks at in each step.
WALKS = [_walks(16), _walks(512), _walks(8192)]


def signature(h: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of sorted distinct hashes."""
    at = np.minimum(np.searchsorted(h, EDGES), len(h) - 1)
    sig = h[at]
    full = (sig >> SHIFT) == np.arange(BINS, dtype=np.uint64)
    empty = np.flatnonzero(~full)
    for walk in WALKS:
        if not len(empty):
            break
        hit = full[walk[:, empty]]
        ok = hit.any(0)
        sig[empty[ok]] = sig[walk[hit.argmax(0)[ok], empty[ok]]]
        empty = empty[~ok]
    sig[empty] = sig[full][0] if len(empty) else 0  # a walk of 8192 steps met no full bin: about never
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(-1, ROWS)
    out = np.arange(1, len(s) + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * P1 + s[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that identify the set) and
    its bands, for every row of ``docs`` (doc_id, text)."""
    def make(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                h = shingles(word_hashes(t), words)
                if len(h):
                    two = np.array([mix(h + P1).sum(), mix(h + P2).sum()], np.uint64).view(np.int64)
                    rows.append((len(h), two[0], two[1], bands(signature(h))))
                else:
                    rows.append((0, 0, 0, np.zeros(0, np.int64)))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "bands"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, n long, s1 long, s2 long, bands array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, again, items: the sorted set of every row of ``docs`` (rep, again,
    text)."""
    def make(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                yield pd.DataFrame({"rep": part["rep"].array, "again": part["again"].array, "items": [
                    shingles(word_hashes(t), words).view(np.int64) for t in part["text"]]})

    return docs.select("rep", "again", "text").mapInPandas(make, "rep long, again boolean, items array<long>")


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is one of ``wanted`` (a table that is
    read twice), and few others: by one hash in a broadcast bitmap of bounded
    size, so that the texts of the others aren't moved to an exact join. The
    more ids there are beyond that size, the fewer rows it spares."""
    bits = 1 << min(MOST_MARKS, max(10, (MARK_BITS * wanted.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    marks = (wanted.select(at.alias("__at")).groupBy(F.expr("shiftright(__at, 6)").alias("__word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(__at & 63 AS int)))").alias("__bits")))
    own = docs.withColumn("__at", at).withColumn("__word", F.expr("shiftright(__at, 6)"))
    return (own.join(F.broadcast(marks), "__word").filter("shiftright(__bits, cast(__at & 63 AS int)) & 1 = 1")
            .select(*docs.columns))


def confirmed(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a = items.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    b = items.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"),
                                                  F.size(F.array_intersect("x", "y")).alias("i"))
    return both.filter(100 * F.col("i") >= percent * (F.col("n") + F.col("m") - F.col("i"))).select("a", "b")


def shared_counts(items: DataFrame) -> DataFrame:
    """rep, s: how many of the set of each ``rep`` also lie in another set.
    Its intersection with any of them is no larger. (A rep of several sets has
    the largest such number.)"""
    own = items.select("rep", "items", F.xxhash64("items").alias("set"))
    alone = (own.select("rep", "set", F.explode("items").alias("h")).groupBy("h")
             .agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("rep", "set")).alias("of")).filter("k = 1"))
    alone = alone.groupBy("of.rep", "of.set").agg(F.count(F.lit(1)).alias("u"))
    left = own.select("rep", "set", F.size("items").alias("n")).join(alone, ["rep", "set"], "left")
    return left.groupBy("rep").agg(F.max(F.col("n") - F.coalesce("u", F.lit(0))).alias("s"))


def rare_pairs(rows: DataFrame, items: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For the sets of ``rows`` (rep, n, component): (rep, s), the shingles of
    each that lie in more than ``RARE`` of the sets, and all pairs (a, b)
    across components that have a rarer shingle in common and may be similar:
    their intersection is no larger than the rare ones in common and the
    smaller number of others. A shingle gives fewer than RARE / 2 pairs a set."""
    reps = rows.groupBy("rep").agg(F.min("n").alias("n"), F.first("component").alias("component"))
    own = items.join(reps, "rep").select("rep", "component", "n", "items", F.xxhash64("items").alias("set"))
    every = own.select("rep", "component", "set", F.explode("items").alias("h"))
    common = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > RARE).select("h"), "common")
    rare = cut(every.join(common, "h", "left_anti").select("rep", "component", "set", "h"), "rare")
    u = rare.groupBy("rep", "set").agg(F.count(F.lit(1)).alias("u"))
    most = F.max(F.size("items") - F.coalesce("u", F.lit(0)))
    counts = cut(own.join(u, ["rep", "set"], "left").groupBy("rep", "component").agg(F.min("n").alias("n"), most.alias("s")), "counts")
    x, y = (rare.select("h", F.col("rep").alias(k), F.col("component").alias(f"{k}_of")) for k in "ab")
    both = (x.join(y, "h").filter("a < b AND a_of <> b_of").groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"))
            .join(counts.select(F.col("rep").alias("a"), "n", "s"), "a")
            .join(counts.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("s").alias("t")), "b"))
    may = (F.col("r") + F.least("s", "t")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return counts.select("rep", "s"), both.filter(may).select("a", "b")


def _mixed(told: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components."""
    of = told.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return told.join(of.filter("lo < hi").select("bucket"), "bucket")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = PERCENT) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id and kept."""
    d = docs.select("doc_id", "text")
    sig = cut(signatures(d, words), "signatures")
    some = sig.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets have equal bands; classes may share an id when ids repeat
    classes = cut(some.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("low")).filter("k > 1 AND low IS NOT NULL")
    met = cut(members.join(shared, "bucket").select("bucket", "rep", "n", "low"), "buckets")
    # from here on without the bands, most of the table
    slim = cut(sig.drop("bands"), "signatures")
    drop(sig)
    sig, some = slim, slim.filter("n > 0 AND doc_id IS NOT NULL")
    times = some.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    wanted = cut(met.select(F.col("rep").alias("doc_id")).distinct().join(times, "doc_id"), "wanted")
    every = cut(sets(marked(d, wanted).join(wanted.hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("rep"), "again", "text"), words), "sets")
    # the bounds count sets: rows that repeat an id and its set are one
    twice = cut(every.filter("again").select("rep", "items").distinct(), "repeated-sets")
    items = every.filter("NOT again").select("rep", "items").union(twice)

    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    centre = met.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("c")).select("bucket", F.col("c.rep").alias("a"), F.col("c.n").alias("m"))
    pairs = (met.select("bucket", F.col("rep").alias("b"), "n").join(centre, "bucket").filter((F.col("a") < F.col("b")) & fits)
             .select("a", "b").distinct())
    tested = cut(pairs, "stars")
    links = cut(confirmed(tested, items, percent), "links")

    def told(left):
        now = left.join(comp, F.col("rep") == F.col("id"), "left")
        return now.select(*left.columns, F.coalesce("component", "rep").alias("component"))

    def linked(comp, fresh):
        """The components with what is confirmed of ``fresh`` pairs, which lie across them."""
        if fresh.isEmpty():
            return comp
        links = cut(confirmed(fresh, items, percent), "links")
        now = cut(joined_components(comp, links), "components")
        drop(links, comp)
        tidy(d.sparkSession)
        return now

    comp = cut(components(links), "components")
    drop(links)
    mixed = left = cut(_mixed(told(met.select("bucket", "rep", "n"))), "mixed")
    # what follows reads the sets again and again: first those of the mixed buckets alone, then of what is left of these
    some_items = cut(items.join(left.select("rep").distinct(), "rep").select("rep", "items"), "mixed-sets")
    drop(every, twice)
    tidy(d.sparkSession)
    left = left.join(shared_counts(some_items), "rep").filter(F.col("s") * 100 >= F.col("n") * percent).drop("s")
    left = cut(_mixed(left), "mixed")
    items = cut(some_items.join(left.select("rep").distinct(), "rep").select("rep", "items"), "left-sets")
    drop(mixed, some_items)
    counts, fresh = rare_pairs(left, items, percent)
    fresh = cut(fresh.join(tested, ["a", "b"], "left_anti"), "fresh")
    tested = tested.union(fresh)
    comp = linked(comp, fresh)
    # pairs of no rare shingle in common are left: only the others count
    left = left.join(counts, "rep").filter(F.col("s") * 100 >= F.col("n") * percent).select("bucket", "rep", "n", "s")
    # a pair is made in the first bucket that both are in, and only there
    left = cut(left.join(left.groupBy("rep").agg(F.collect_set("bucket").alias("all")), "rep"), "left")
    # a round has a dozen jobs, whatever it holds: few rounds of more centres
    centres = FIRST_CENTRES
    while True:
        # told, mixed and ranked by one exchange: most of what is left of a round is the start of its tasks
        bucket = Window.partitionBy("bucket")
        ranked = told(left).withColumns({
            "rank": F.row_number().over(bucket.orderBy("rep", "n")), "lo": F.min("component").over(bucket), "hi": F.max("component").over(bucket)})
        ranked = cut(ranked.filter("lo < hi").drop("lo", "hi"), "ranked")
        if ranked.isEmpty():
            break
        a = ranked.filter(F.col("rank") <= centres).select(
            "bucket", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("component").alias("other"), F.col("rank").alias("at"),
            F.col("all").alias("others"))
        near = F.least("s", "t") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
        here = F.array_min(F.array_intersect("all", "others")) == F.col("bucket")
        across = (ranked.join(a, "bucket").filter((F.col("rank") > F.col("at")) & (F.col("component") != F.col("other")) & fits & near & here)
                  .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())
        fresh = cut(across.join(tested, ["a", "b"], "left_anti"), "fresh")
        tested = tested.union(fresh)
        comp = linked(comp, fresh)
        # all pairs of the centres are tested, or made in another bucket; the others go on without them
        left = ranked.filter(F.col("rank") > centres).select("bucket", "rep", "n", "s", "all")
        centres *= MORE_CENTRES

    owner = cut(sig.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "rep"), "owners")
    # rows of one id in several classes join them
    again = (owner.filter("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id")
             .agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id"))
    if not again.isEmpty():
        comp = joined_components(comp, owner.filter("rep IS NOT NULL").join(again, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    out = (owner.join(comp, F.col("rep") == F.col("id"), "left")
           .select("doc_id", F.col("n").alias("n_shingles"),
                   F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document of each
    group of near duplicates, the one of the smallest id (of rows that repeat
    that id the first by text). Rows with a null id stay."""
    kept = near_duplicates(docs, words, percent).filter("kept").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text")
    d = docs.join(kept, "doc_id", "left_semi").withColumn("__rank", F.row_number().over(first)).filter("__rank = 1").drop("__rank")
    return d.select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
