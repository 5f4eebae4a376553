"""Helpers shared by the operators: table reading, lineage cuts, components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.session import scratch_path

#: White space of the word rule, for trimming.
SPACE = " \t\n\x0b\f\r"
#: One word, and a run of white space, as regular expressions (Java, RE2).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Setting by which a job's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows of a batch that goes to Python or comes from a file.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared checkpoint folder and read it
    back: the lineage ends there, on storage that survives lost executors,
    and later plans see its real size. The folder goes when the driver ends,
    the shuffle files of the writing job, which nothing else reads, with that job.
    ``batch`` bounds the rows of the job's Arrow and Parquet batches: Spark's
    defaults, thousands of rows in every task, are too many of whole texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with _set(spark, {SHUFFLE_CLEANUP: "true"}), batches(spark, batch):
        df.write.parquet(path)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.cut_path = path
    return kept


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches(spark: SparkSession, rows: int | None):
    """Bounds the rows of the Arrow and Parquet batches of the jobs inside."""
    return _set(spark, {k: str(rows) for k in BATCH_ROWS} if rows else {})


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned, once nothing that is still to run
    reads them; what was written from them stands on storage of its own."""
    for df in tables:
        at, fs = _hadoop(df.sparkSession, df.cut_path)
        fs.delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over: its cleaner
    does so when the driver's JVM finds their plans unused, which in a loop of
    many short jobs may be long after."""
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array; without any (or null) it is empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def _edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .filter("u <> v").distinct())


def _stars(e: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u > v, of a cut table, made into stars: every
    node but the smallest of its component has one edge, to that one."""
    def done():
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(
            e.select("v", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
        return not nodes.agg(F.count_if(F.expr("up + top > 1"))).first()[0]

    while not done():
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: every node's smaller neighbours, and itself, go to the smallest
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                  .union(small.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(e)
        e = now
    return e


def _members(stars: DataFrame) -> DataFrame:
    """(id, component) of every node of ``stars``."""
    return (stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of long ids: rows (id,
    component) for every id of an edge, component being the smallest id
    reachable.

    Each round links the larger neighbours of every node to the smallest one
    of its neighbourhood, then the smaller ones likewise (large and small
    stars); every round is cut to a table. Rounds grow with the logarithm of
    the longest path, whatever the size of a component, and end when the edges
    are stars; minima are aggregated before they are shuffled. Only a count is
    read by the driver.
    """
    return _members(_stars(cut(_edges(edges, a, b), "edges")))


def joined_components(known: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``components`` of the edges that gave ``known`` (id, component) and of
    further ``edges``: these are drawn between the components known, so only
    what they join is gone through again, and nothing where they join nothing."""
    one, two = (known.select(F.col("id").alias(x), F.col("component").alias(f"{x}_of")) for x in (a, b))
    across = (edges.select(a, b).join(one, a, "left").join(two, b, "left")
              .select(F.coalesce(f"{a}_of", a).alias("a"), F.coalesce(f"{b}_of", b).alias("b")))
    across = cut(_edges(across, "a", "b"), "across")
    if across.isEmpty():
        return known
    up = _stars(across)
    moved = (known.join(up.select(F.col("u").alias("component"), F.col("v").alias("to")), "component", "left")
             .select("id", F.coalesce("to", "component").alias("component")))
    # ids of no edge before are components of their own
    return moved.union(_members(up).join(known.select("id"), "id", "left_anti").select("id", "component"))


#: For oracle SQL (DuckDB): a common table expression with CRC-32's table of
#: 256 entries, made by its rule, and the CRC-32 of a string by it.
CRC32_CTE = """crc(t) AS (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc32_sql(s: str) -> str:
    """The unsigned CRC-32 of ``s`` in UTF-8; the table ``crc`` stands in FROM."""
    octets = f"list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
