"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents in a pseudorandom order, are one long
sequence, cut into blocks of ``block`` words. The mix is a list of slots in
output shards of ``shard_slots`` slots. Each slot's source is drawn by the
target weights, so a shard's counts are multinomial; the few slots drawn
beyond a source's target go to sources that were drawn short. The k-th slot
of a source takes the block at place k of a pseudorandom permutation of the
source's block indexes, pass after pass. Slots and blocks are joined by
(source, block index), a key without hot values.

Targets share all words by weight (1, 2, 3, repeating, by code point of the
source, null last) and stop at three times the source's size.

Defined results: a null text has no words; documents without words take part
in no block and are taken 0 times; a null source is a source of its own;
repeated rows are separate documents that follow each other; an empty table
gives an empty mix; further columns are ignored.

Per-source figures are one row a source; they are ranked in one window over
those rows (never over documents). Nothing else meets in one task: equal rows
are counted first, the word offsets of a source are summed over hash buckets
(of id and text, about ``BUCKET_ROWS`` documents each), then inside each
bucket. A source's slots are numbered by shard and made in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.bytes import let
from wirelens.llm.common import GAP, cut, word_count

BLOCK = 64
SHARD_SLOTS = 16384
#: Least buckets of the documents' order, and documents of one on average.
BUCKETS = 1024
BUCKET_ROWS = 65536
#: Equal rows, and slots, that one task makes at a time.
REPEATS = 65536
TASK_SLOTS = 1 << 20
#: Rounds of the index permutation.
ROUNDS = 12
SEED = 20240521
CAP = 3


def permuted(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """``x`` in a pseudorandom permutation of 0..n-1 chosen by ``key``.

    Swap-or-not rounds: x meets its mirror image K - x (mod n), and a keyed
    bit of the larger of the two says whether they swap. Every round undoes
    itself, so the inverse runs the rounds backwards.
    """
    def turn(a, i):
        return let(F.pmod(F.pmod(F.xxhash64(key, i), n) - a, n), lambda mirror: F.when(
            F.xxhash64(key, i, F.greatest(a, mirror), F.lit(1)).bitwiseAND(1) == 1, mirror).otherwise(a))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, x.cast("long"), turn)


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


@dataclass
class Mix:
    """``sources``: one row a source (sk, source, source_size, target, words,
    blocks, slots, key). ``placed``: one row a document with words (sk, doc_id,
    text hash th, size, start: its first word's place in the source).
    ``empty``: one row a document without (sk, doc_id, size). ``slots``:
    one row a slot (shard, sk, rank, epoch, idx, take: words taken from the
    block's front)."""

    sources: DataFrame
    placed: DataFrame
    empty: DataFrame
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """One row a document and block it reaches: words [first, last) of
        the document lie at [at, at + last - first) of block idx."""
        b = self.block
        return (self.placed.withColumn("idx", F.explode(F.sequence(
                    F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
                .withColumn("first", F.greatest(F.lit(0), F.col("idx") * b - F.col("start")))
                .withColumn("last", F.least(F.col("size"), (F.col("idx") + 1) * b - F.col("start")))
                .withColumn("at", F.col("start") + F.col("first") - F.col("idx") * b))

    def taken(self) -> DataFrame:
        """One row a slot and piece of a document that it holds: adds shard,
        rank, epoch and n, the words taken from the piece (0 without a slot)."""
        got = F.least(F.col("last") - F.col("first"), F.greatest(F.lit(0), F.col("take") - F.col("at")))
        return (self.pieces().join(self.slots, ["sk", "idx"], "left")
                .withColumn("n", F.coalesce(got, F.lit(0)).cast("long")))


def targets(sized: DataFrame, block: int) -> DataFrame:
    """One row a source of ``sized`` (sk, source, size): its size, target,
    whole words, number of blocks and slots."""
    s = (sized.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    # the level L with sum(min(cap * size, weight * L)) = all words: fill caps in the order they are met
    room = Window.orderBy(F.col("source_size") / F.col("weight"), "sk")
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("total", F.sum("source_size").over(whole))
         .withColumn("left_words", F.col("total") - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.max(F.col("left_words") / F.col("left_weight")).over(whole))
         .withColumn("target", F.least((CAP * F.col("source_size")).cast("double"), F.col("weight") * F.col("level"))))
    size, n = F.col("source_size"), F.col("blocks")
    rest = F.col("words") % size
    return (s.withColumn("words", F.round("target").cast("long"))
            .withColumn("blocks", F.ceil(size / block).cast("long"))
            .withColumn("slots", F.when(size > 0, F.floor(F.col("words") / size) * n + F.when(
                rest > 0, F.least(n, F.ceil(rest / block) + 1)).otherwise(0)).otherwise(0).cast("long"))
            .select("sk", "source", "source_size", "target", "words", "blocks", "slots"))


def placed(sized: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Documents with words, each with start, the number of words of the
    source before it, in the order (hash bucket, doc_id, size, text hash).
    Equal rows, however many, are one row until their places are known."""
    with_words = sized.filter("size > 0")
    n_buckets = max(BUCKETS, with_words.count() // BUCKET_ROWS)
    d = (with_words.groupBy("sk", "doc_id", "th", "size").agg(F.count(F.lit(1)).alias("m"))
         .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit(SEED)), F.lit(n_buckets))))
    before = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    all_words = F.col("size") * F.col("m")
    b = (d.groupBy("sk", "bucket").agg(F.sum(all_words).alias("n"))
         .select("sk", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("sk", "bucket").orderBy("doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(d.join(b, ["sk", "bucket"])
                .withColumn("start", F.col("base") + F.coalesce(F.sum(all_words).over(inside), F.lit(0)))
                .select("sk", "doc_id", "th", "size", "start", "m"), "mix-places")

    def each(rows, low, high):
        return (rows.withColumn("k", F.explode(F.sequence(low, high)))
                .select("sk", "doc_id", "th", "size", (F.col("start") + F.col("k") * F.col("size")).alias("start")))

    # rows that repeat more often than one task should make are made in stretches
    long = lambda x: F.lit(x).cast("long")
    often = first.filter(F.col("m") > repeats)
    n = often.agg(F.coalesce(F.sum(F.ceil(F.col("m") / repeats)), F.lit(0))).first()[0]
    often = (often.withColumn("stretch", F.explode(F.sequence(long(0), F.floor((F.col("m") - 1) / repeats))))
             .repartition(max(1, min(n, 100_000)), "sk", "doc_id", "th", "stretch"))
    low = F.col("stretch") * repeats
    return (each(first.filter(F.col("m") <= repeats), long(0), F.col("m") - 1)
            .union(each(often, low, F.least(F.col("m"), low + repeats) - 1)))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source)."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key().alias("sk"),
                            F.xxhash64("text").alias("th"), word_count(F.col("text")).alias("size")), "mix-sizes")
    src = targets(sized, block)
    upto = Window.orderBy("sk").rowsBetween(Window.unboundedPreceding, 0)
    src = cut(src.withColumn("key", F.xxhash64("sk", F.lit(seed)))
              .withColumn("high", F.sum("slots").over(upto)), "mix-sources")
    total = src.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    # draws: a slot's number hits one source's interval of [0, total); intervals are met by equal cells
    cell = max(1, -(-total // 4096))
    spans = (src.filter("slots > 0").select("sk", "high", (F.col("high") - F.col("slots")).alias("low"))
             .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))))
    draws = (spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"),
                                       F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("v"))
             .withColumn("cell", F.floor(F.col("v") / cell)))
    counts = cut(draws.join(spans, "cell").filter("v >= low and v < high")
                 .groupBy("sk", "shard").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    before = Window.partitionBy("sk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_SLOTS + 1)
    ranks = (counts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
             .repartition(tasks, "sk", "shard")  # a source's slots aren't made where its shards were summed
             .withColumn("rank", F.explode(F.sequence(F.col("off"), F.col("off") + F.col("n") - 1)))
             .select("sk", "shard", "rank"))

    # slots beyond a source's target go, in order, to the places that others were drawn short of
    drawn = (src.join(counts.groupBy("sk").agg(F.sum("n").alias("drawn")), "sk", "left")
             .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
             .withColumn("over", F.greatest(F.lit(0), F.col("drawn") - F.col("slots")))
             .withColumn("short", F.greatest(F.lit(0), F.col("slots") - F.col("drawn")))
             .withColumn("over_base", F.sum("over").over(upto) - F.col("over"))
             .withColumn("short_base", F.sum("short").over(upto) - F.col("short")))
    known = ranks.join(drawn.select("sk", "slots", "over_base"), "sk")
    spare = known.filter("rank >= slots").select("shard", (F.col("over_base") + F.col("rank") - F.col("slots")).alias("g"))
    gaps = (drawn.filter("short > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)))
            .select("sk", (F.col("short_base") + F.col("j")).alias("g"), (F.col("drawn") + F.col("j")).alias("rank")))
    slots = (known.filter("rank < slots").select("sk", "shard", "rank")
             .union(spare.join(gaps, "g").select("sk", "shard", "rank")))

    n, size, place = F.col("blocks"), F.col("source_size"), F.col("rank") % F.col("blocks")
    tail = n * block - size  # words that the source's last block lacks
    done = (F.floor(F.col("rank") / n) * size + place * block
            - F.when(F.col("last_place") < place, tail).otherwise(0))
    info = src.select("sk", "words", "blocks", "source_size", "key",
                      permuted(F.col("blocks") - 1, F.col("blocks"), F.col("key"), inverse=True).alias("last_place"))
    slots = (slots.join(info.filter("blocks > 0"), "sk")
             .withColumn("epoch", F.floor(F.col("rank") / n))
             .withColumn("idx", permuted(place, n, F.col("key")))
             .withColumn("length", F.least(F.lit(block), size - F.col("idx") * block))
             .withColumn("take", F.greatest(F.lit(0), F.least(F.col("length"), F.col("words") - done)))
             .select("sk", "shard", "rank", "epoch", "idx", "take"))
    return Mix(src, placed(sized), sized.filter("size = 0").select("sk", "doc_id", "size"), slots, block)


def mixed_sizes(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, and taken, the
    words the mix takes from it, repeats counted."""
    m = mix(docs, block, shard_slots, seed)
    per = m.taken().groupBy("sk", "doc_id", "th", "size", "start").agg(F.sum("n").alias("taken"))
    one = per.select("sk", "doc_id", "size", "taken").union(m.empty.withColumn("taken", F.lit(0).cast("long")))
    return (one.join(m.sources.select("sk", "source_size", "target"), "sk")
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: one row for each document and pass over its
    source that takes words of it, with all columns of ``docs``; text holds
    the words taken, in order, with the white space before each (a document
    taken whole keeps its text as it is), n_chars its length."""
    cols = docs.columns
    m = mix(docs, block, shard_slots, seed)
    parts = (m.taken().filter("n > 0").groupBy("sk", "doc_id", "th", "size", "start", "epoch")
             .agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"))
             .select(F.col("sk").alias("__at"), F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("start").alias("__start"),
                     F.col("epoch").alias("__epoch"), (F.col("taken") == F.col("size")).alias("__whole"), F.col("parts").alias("__parts")))
    # rows of equal source, id and text stand at several places; one of them, the same in every run, stands for all
    rest = [c for c in cols if c not in ("doc_id", "text")]
    one = (docs.withColumn("__sk", source_key()).groupBy("__sk", "doc_id", "text")
           .agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__row")))
    joined = one.join(parts, (F.col("__sk") == F.col("__at")) & F.col("doc_id").eqNullSafe(F.col("__id"))
                      & (F.xxhash64("text") == F.col("__th")))
    cut_out = let(F.regexp_extract_all("text", F.lit(f"{GAP[:-1]}*[^\\x20\\x09-\\x0D]+"), F.lit(0)), lambda w: F.array_join(
        F.flatten(F.transform("__parts", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")))), ""))
    text = F.when(F.col("__whole"), F.col("text")).otherwise(cut_out)
    out = joined.withColumn("__text", text)
    return out.select(*[F.col("__text").alias("text") if c == "text" else
                        F.length("__text").cast("long").alias("n_chars") if c == "n_chars" else
                        F.col(c) if c == "doc_id" else F.col("__row").getField(c).alias(c) for c in cols])


def query(docs: DataFrame) -> DataFrame:
    return mixed_sizes(docs)
