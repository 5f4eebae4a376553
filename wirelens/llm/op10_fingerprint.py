"""Document fingerprints by a threshold-scaled sketch, DataFrame functions only.

A text's shingles (``SHINGLE`` words; the whole sequence when there are
fewer) are hashed to 64 bits, and every hash below the fixed fraction
1/``SCALE`` of the hash range is kept. Sketches of any texts are comparable:
the kept hashes of a union are the union of the kept hashes, so sketches
merge, and the share of one sketch found in another estimates containment
however unequal the texts are. A text with shingles but none below the
threshold keeps its smallest hash, so a fingerprint is empty only for a text
without words.

Defined results: a null text is the empty text; likeness is the estimated
containment of the smaller sketch in the other (1 between two empty
sketches, 0 between an empty one and another); repeated ids follow each
other by text; rows with a null id come after all others; the next document
of the last one is the first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.functions.bytes import let
from wirelens.llm.common import words

SHINGLE = 5
SCALE = 8
#: Hashes are signed; the kept ones are the lowest 1/SCALE of the range.
THRESHOLD = -(2 ** 63) + 2 ** 64 // SCALE
#: Ids per bucket of the order by id, and bucket numbers per group of buckets.
WIDTH = 64
GROUP = 1 << 16


def sketch(text: Column, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> Column:
    """Sorted array of the kept shingle hashes of ``text``."""
    def hashes(w):
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(each)

    def keep(h):
        low = F.filter(h, lambda x: x < F.lit(threshold))
        return let(low, lambda k: F.when((F.size(k) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(
            F.array_sort(F.array_distinct(k))))

    return let(words(text), lambda w: let(hashes(w), keep))


def merged(a: Column, b: Column, threshold: int = THRESHOLD) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    return let(both, lambda u: F.when(F.size(F.filter(u, lambda x: x < F.lit(threshold))) > 0,
                                      F.filter(u, lambda x: x < F.lit(threshold))).otherwise(F.slice(u, 1, 1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles found in the other."""
    small = F.least(F.size(a), F.size(b))
    return (F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(small == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / small))


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def next_bucket(buckets: DataFrame) -> DataFrame:
    """(bucket, following): each distinct bucket number and the next larger
    one, the smallest after the largest. Numbers are grouped by GROUP, and
    the groups by GROUP again, so that each window holds at most GROUP rows
    and the last one the few groups of groups that 64-bit numbers allow."""
    b = buckets.select("bucket").distinct()
    b = b.withColumn("g1", F.floor(F.col("bucket") / GROUP)).withColumn("g2", F.floor(F.col("bucket") / GROUP / GROUP))

    def lead(df, by, value, out):
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(value)))

    inner = lead(b, ["g2", "g1"], "bucket", "following")
    g1 = b.groupBy("g2", "g1").agg(F.min("bucket").alias("low"))
    g2 = b.groupBy("g2").agg(F.min("bucket").alias("low"))
    after1 = lead(g1, ["g2"], "low", "next1").select("g2", "g1", "next1")
    top = Window.partitionBy()
    after2 = (lead(g2, [], "low", "next2").withColumn("next2", F.coalesce("next2", F.min("low").over(top)))
              .select("g2", "next2"))
    return (inner.join(after1, ["g2", "g1"]).join(after2, ["g2"])
            .select("bucket", F.coalesce("following", "next1", "next2").alias("following")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp (the sketch), next_text and next_fp of the next
    document. Texts are shuffled once, by ranges of WIDTH ids; only the first
    document of each range moves again, to the range before it."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("fp", sketch(F.col("text")))
    # null ids lie beyond the largest bucket
    bucket = F.coalesce(F.floor(F.col("doc_id") / WIDTH), F.lit(2 ** 58 + 1))
    d = d.withColumn("bucket", bucket)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    w = (d.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
         .withColumn("place", F.row_number().over(order)))
    follow = next_bucket(docs.select(bucket.alias("bucket")))
    firsts = (w.filter("place = 1").select(F.col("bucket").alias("following"), F.col("text").alias("first_text"),
                                           F.col("fp").alias("first_fp"))
              .join(follow, "following").drop("following"))
    w = w.join(firsts, (w.bucket == firsts.bucket) & w.next_text.isNull(), "left")
    return w.select("doc_id", "text", "fp", F.coalesce("next_text", "first_text").alias("next_text"),
                    F.coalesce("next_fp", "first_fp").alias("next_fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the fingerprint of the text and of the edited text
    (its last half replaced by the start of the next document), and the
    likeness of the first to the second and to the next document's."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
                                        F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"),
                 sketch(F.col("edited")).alias("edited_fp"))
    return d.select("doc_id", "n_chars", "edited_sha256", printed(F.col("fp")).alias("fingerprint"),
                    printed(F.col("edited_fp")).alias("edited_fingerprint"),
                    containment(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                    containment(F.col("fp"), F.col("next_fp")).alias("near_next"))


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
