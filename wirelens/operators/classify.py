"""Application classification.

The default keyword set is a fixed ``CASE`` chain evaluated per row inside
codegen. A user keyword table (J4) of any size is matched on the *distinct*
hosts only, by the rarest-gram index (no nested-loop join), and the best
class of each host is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.apps import keyword_rows, named_app, port_app
from ..functions.bytes import cached_column
from ..schemas import APP_KEYWORDS
from ..session import scratch_table
from .substrings import substring_matches

# A keyword without a priority comes last.
LAST_PRIORITY = 2 ** 31 - 1


def default_keywords(spark: SparkSession) -> DataFrame:
    """The built-in keyword table ``(priority, keyword, app)``."""
    return spark.createDataFrame(keyword_rows(), APP_KEYWORDS)


def classify_hosts(df: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Adds ``named`` (keyword class or NULL) and ``port_app`` (port class).

    With ``keywords`` (``priority, keyword, app``), the lowest priority
    matching keyword wins, then the smallest keyword, then the smallest app.
    """
    df = df.withColumn("port_app", cached_column("port_app", lambda: port_app(F.col("svc_port"))))
    if keywords is None:
        return df.withColumn("named", cached_column("named", lambda: named_app(F.col("host"))))
    hosts = df.select(F.lower("host").alias("__h")).distinct()
    kw = keywords.filter("app IS NOT NULL").select(F.coalesce(F.col("priority").cast("int"), F.lit(LAST_PRIORITY)).alias("priority"),
                         F.lower("keyword").alias("keyword"),
                         F.col("app").cast("string").alias("app"))
    matches = substring_matches(hosts, "__h", kw, "keyword")
    best = matches.groupBy("__h").agg(F.min_by(F.col("app"), F.struct("priority", "keyword", "app")).alias("named"))
    best = scratch_table(best.withColumn("__spread", F.lit(0).cast("bigint")), "keyword-classes")
    # packets without a host are spread by a number no class has
    at = F.when(F.length(df["host"]) > 0, F.lit(0)).otherwise(F.xxhash64(df["capture_id"], df["seq"]))
    return (df.join(best, (F.lower(df["host"]) == best["__h"]) & (at == best["__spread"]), "left")
            .drop("__h", "__spread"))
