"""Block rules: loading/validation (S6, X8) and matching.

A rule table has rows ``(rule_type, value, capture_id)``: ``ip`` (dotted
IPv4), ``app`` (class name, any case, e.g. ``youtube``) or ``domain``
(substring of the host, case-insensitive; ``''`` matches every non-empty
host). ``capture_id`` NULL means the rule applies to every capture.

Matching is by equi-joins, whatever the size of the table; Spark chooses how
each join runs from the sizes it knows (a handful of rules is broadcast into
the packets' own stage). Rules are resolved on distinct values first:
* IP rules on the address (and the capture, for rules of single captures);
* app rules of all captures are a set of at most twelve classes, those of
  single captures are joined on (capture, app);
* domain rules on the distinct hosts, by the rarest-gram index of
  ``substrings.py``; the hosts they hit are joined back. Packets without a
  host are spread over that join, not sent to one task.
The rule table is never collected: the driver reads which kinds of rules
occur, at most six rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.apps import APP_NAMES, label_of
from ..functions.ip import ip_parse, ip_parse_error
from ..schemas import RULES
from ..session import scratch_path, scratch_table
from .substrings import substring_matches


def rules_frame(spark: SparkSession, ips=(), apps=(), domains=(),
                capture_id: str | None = None) -> DataFrame:
    """A raw rule table from driver-side lists (CLI-style arguments)."""
    rows = ([("ip", v, capture_id) for v in ips]
            + [("app", v, capture_id) for v in apps]
            + [("domain", v, capture_id) for v in domains])
    return spark.createDataFrame(rows, RULES)


def validate_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a rule table into ``(valid, rejects)``.

    Valid rows get ``ip`` (BIGINT, for ip rules), ``app`` (display label, for
    app rules) and ``domain`` (lower case). App names are upper-cased and
    must be one of the twelve class names; IPs must have four numeric parts
    (each masked to 8 bits, extra parts ignored). Rejects carry ``error``.
    """
    r = rules
    if "capture_id" not in r.columns:
        r = r.withColumn("capture_id", F.lit(None).cast("string"))
    r = r.select(F.lower(F.trim("rule_type")).alias("rule_type"), "value", "capture_id")
    up = F.upper(F.col("value"))
    app_ok = up.isin(*APP_NAMES)
    label = None
    for name in APP_NAMES:
        lab = F.lit(label_of(name))
        label = F.when(up == name, lab) if label is None else label.when(up == name, lab)
    error = (
        F.when(F.col("rule_type") == "ip", ip_parse_error(F.col("value")))
        .when(F.col("rule_type") == "app",
              F.when(~F.coalesce(app_ok, F.lit(False)),
                     F.concat(F.lit("unknown app: "), F.coalesce(F.col("value"), F.lit("null")))))
        .when(F.col("rule_type") == "domain",
              F.when(F.col("value").isNull(), F.lit("null domain")))
        .otherwise(F.concat(F.lit("unknown rule type: "),
                            F.coalesce(F.col("rule_type"), F.lit("null")))))
    checked = r.withColumn("error", error)
    valid = (checked.filter(F.col("error").isNull()).select(
        "rule_type", "value", "capture_id",
        F.when(F.col("rule_type") == "ip", ip_parse(F.col("value"))).alias("ip"),
        F.when(F.col("rule_type") == "app", label).alias("app"),
        F.when(F.col("rule_type") == "domain", F.lower("value")).alias("domain")))
    rejects = checked.filter(F.col("error").isNotNull())
    return valid, rejects


def load_rules(spark: SparkSession, ips=(), apps=(), domains=(),
               capture_id: str | None = None, strict: bool = False):
    """Rules from lists -> ``(rules, rejects)``; ``strict`` raises on a bad IP.

    Unknown app names are reported in ``rejects`` and skipped, as the
    reference's console does; a malformed IP is an error there, so
    ``strict=True`` raises for it.
    """
    valid, rejects = validate_rules(rules_frame(spark, ips, apps, domains, capture_id))
    if strict:
        bad = rejects.filter(F.col("rule_type") == "ip").limit(1).collect()
        if bad:
            raise ValueError(f"bad IP rule {bad[0]['value']!r}: {bad[0]['error']}")
    return valid, rejects


def _kinds(rules: DataFrame) -> dict[tuple[str, bool], list[str]]:
    """The kinds of rules that occur, by (type, of a single capture), with the
    classes of app rules."""
    rows = rules.groupBy("rule_type", F.col("capture_id").isNotNull().alias("per")).agg(F.collect_set("app").alias("apps")).collect()
    return {(r["rule_type"], r["per"]): sorted(r["apps"]) for r in rows}


def _join_flag(df: DataFrame, keys: DataFrame, on: list[tuple[str | Column, str]], name: str) -> DataFrame:
    """Left join of a distinct key table, adding boolean ``name``."""
    keys = keys.distinct().withColumn(name, F.lit(True))
    cond = None
    for left, right in on:
        c = (df[left] if isinstance(left, str) else left) == keys[right]
        cond = c if cond is None else (cond & c)
    out = df.join(keys, cond, "left")
    for _, right in on:
        out = out.drop(keys[right])
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def _any(names: list[str]) -> Column:
    flag = F.lit(False)
    for n in names:
        flag = flag | F.col(n)
    return flag


def _ip_flags(df: DataFrame, rules: DataFrame, cols: list[str], kinds: dict) -> DataFrame:
    ips = rules.filter(F.col("rule_type") == "ip").select(F.col("capture_id").alias("__cap"), F.col("ip").alias("__ip"))
    names = []
    for i, c in enumerate(cols):
        if ("ip", False) in kinds:
            df = _join_flag(df, ips.filter(F.col("__cap").isNull()).select("__ip"), [(c, "__ip")], f"__ipg{i}")
            names.append(f"__ipg{i}")
        if ("ip", True) in kinds:
            df = _join_flag(df, ips.filter(F.col("__cap").isNotNull()), [("capture_id", "__cap"), (c, "__ip")], f"__ipc{i}")
            names.append(f"__ipc{i}")
    return df.withColumn("ip_hit", _any(names)).drop(*names)


def _app_flag(df: DataFrame, rules: DataFrame, app_col: str, name: str, kinds: dict) -> DataFrame:
    """App rules of all captures are at most one for each class and become a
    set; those of single captures, however many, are joined by (capture, app)."""
    flag = F.coalesce(F.col(app_col).isin(*kinds.get(("app", False), [])), F.lit(False))
    if ("app", True) not in kinds:
        return df.withColumn(name, flag)
    per = (rules.filter((F.col("rule_type") == "app") & F.col("capture_id").isNotNull())
           .select(F.col("capture_id").alias("__cap"), F.col("app").alias("__app")))
    df = _join_flag(df, per, [("capture_id", "__cap"), (app_col, "__app")], "__app_cap")
    return df.withColumn(name, F.col("__app_cap") | flag).drop("__app_cap")


def domain_hits(hosts: DataFrame, rules: DataFrame, per_capture: bool = True) -> DataFrame:
    """``(__hcap, __h)``: the lower-cased hosts that a domain rule hits (X11),
    in each capture; ``__hcap`` is null if no rule is of a single capture.

    ``hosts`` has ``capture_id`` and ``host``, in any number of rows."""
    return _hits_among(_distinct_hosts(hosts, per_capture), rules)


def _distinct_hosts(hosts: DataFrame, per_capture: bool) -> DataFrame:
    cap = F.col("capture_id") if per_capture else F.lit(None).cast("string")
    # no filter here: pushed below the distinct it would compute every host twice
    return hosts.select(cap.alias("__hcap"), F.lower("host").alias("__h")).distinct()


def _hits_among(texts: DataFrame, rules: DataFrame) -> DataFrame:
    dr = rules.filter(F.col("rule_type") == "domain").select(
        F.col("capture_id").alias("__rcap"), F.col("domain").alias("__dom"))
    m = substring_matches(texts, "__h", dr, "__dom")
    return (m.filter(F.col("__rcap").isNull() | (F.col("__rcap") == F.col("__hcap")))
            .select("__hcap", "__h").distinct())


class KnownHosts:
    """What the micro-batches of a stream have found out about its rules, so
    that the next ones need not: the kinds of rules, and of every host whether
    a domain rule hits it. A host is tried on the rules once. What is known
    lies in the shared folder and grows with the distinct hosts; each row holds
    by itself, so a micro-batch that is run again does no harm."""

    SCHEMA = "__hcap string, __h string, __spread bigint"

    def __init__(self, rules: DataFrame):
        self.rules, self.path, self._found = rules, None, None

    def kinds(self) -> dict[tuple[str, bool], list[str]]:
        if self._found is None:
            self._found = _kinds(self.rules)
        return self._found

    def hits(self, hosts: DataFrame, per_capture: bool) -> DataFrame:
        """``domain_hits`` of all hosts so far, those of ``hosts`` among them."""
        spark = hosts.sparkSession
        fresh = _distinct_hosts(hosts, per_capture)
        if self.path is not None:
            known = self._read(spark).select(F.col("__hcap").alias("__kcap"), F.col("__h").alias("__k"))
            same = F.col("__hcap").eqNullSafe(F.col("__kcap")) & F.col("__h").eqNullSafe(F.col("__k"))
            fresh = fresh.join(known, same, "left_anti")
        fresh = scratch_table(fresh, "fresh-hosts")
        if self.path is None or not fresh.isEmpty():
            path = self.path or scratch_path(spark, "known-hosts")
            hit = _hits_among(fresh, self.rules).select(
                F.col("__hcap").alias("__kcap"), F.col("__h").alias("__k"), F.lit(0).cast("bigint").alias("__spread"))
            same = F.col("__hcap").eqNullSafe(F.col("__kcap")) & (F.col("__h") == F.col("__k"))
            fresh.join(hit, same, "left").select("__hcap", "__h", "__spread").write.mode("append").parquet(path)
            if self.path is None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
            self.path = path
        return self._read(spark).filter(F.col("__spread").isNotNull())

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).parquet(self.path)


def _domain_flag(df: DataFrame, rules: DataFrame, host_col: str, hosts: DataFrame | None, kinds: dict,
                 known: KnownHosts | None = None) -> DataFrame:
    per = ("domain", True) in kinds
    if not per and ("domain", False) not in kinds:
        return df.withColumn("dom_hit", F.lit(False))
    if hosts is None:
        hosts = df.select("capture_id", F.col(host_col).alias("host"))
    # the number is written with the hits: a literal would be folded into a condition beside the join key
    if known is not None:
        hit = known.hits(hosts, per)
    else:
        hit = scratch_table(domain_hits(hosts, rules, per).withColumn("__spread", F.lit(0).cast("bigint")), "domain-hits")
    # what has no host hits nothing: it is spread by a number no hit has
    at = F.when(F.length(df[host_col]) > 0, F.lit(0)).otherwise(
        F.xxhash64(df["capture_id"], *[df[c] for c in ("seq", "first_seq") if c in df.columns]))
    on = [(F.lower(df[host_col]), "__h"), (at, "__spread")] + ([(df["capture_id"], "__hcap")] if per else [])
    return _join_flag(df, hit if per else hit.drop("__hcap"), on, "dom_hit")


def rule_flags(df: DataFrame, rules: DataFrame, ip_match: str = "low_endpoint",
               app_col: str = "app_state", host_col: str = "host_state",
               hosts: DataFrame | None = None, known: KnownHosts | None = None) -> DataFrame:
    """Adds ``ip_hit``, ``app_hit`` and ``dom_hit``.

    ``hosts`` (``capture_id``, ``host``) may name a table that holds every
    host of ``df`` and is cheaper to read for the distinct ones. ``known`` has
    what earlier calls with the same rules found out.
    """
    if ip_match == "low_endpoint":
        ip_cols = ["src_ip"]
    elif ip_match == "either":
        ip_cols = ["src_ip", "dst_ip"]
    else:
        raise ValueError(f"ip_match must be 'low_endpoint' or 'either', not {ip_match!r}")
    kinds = known.kinds() if known is not None else _kinds(rules)
    df = _ip_flags(df, rules, ip_cols, kinds)
    df = _app_flag(df, rules, app_col, "app_hit", kinds)
    return _domain_flag(df, rules, host_col, hosts, kinds, known)


def apply_rules(df: DataFrame, rules: DataFrame | None, ip_match: str = "low_endpoint",
                app_col: str = "app_state", host_col: str = "host_state",
                hosts: DataFrame | None = None, known: KnownHosts | None = None) -> DataFrame:
    """Adds ``blocked`` and ``block_reason`` (``ip``/``app``/``domain``).

    ``rules`` must come from ``validate_rules``/``load_rules``.
    ``ip_match="low_endpoint"`` tests the normalised ``src_ip`` only (the
    reference's behaviour); ``"either"`` tests both endpoints.
    """
    if rules is None:
        return df.withColumn("blocked", F.lit(False)).withColumn(
            "block_reason", F.lit(None).cast("string"))
    df = rule_flags(df, rules, ip_match, app_col, host_col, hosts, known)
    ip_hit, app_hit, dom_hit = F.col("ip_hit"), F.col("app_hit"), F.col("dom_hit")
    return (df.withColumn("blocked", ip_hit | app_hit | dom_hit)
            .withColumn("block_reason", F.when(ip_hit, F.lit("ip")).when(app_hit, F.lit("app"))
                        .when(dom_hit, F.lit("domain")))
            .drop("ip_hit", "app_hit", "dom_hit"))


def blocked_apps_flag(df: DataFrame, rules: DataFrame | None, app_col: str = "app") -> DataFrame:
    """``blocked`` = the class is named by an app rule (J6); IP and domain
    rules never set it."""
    if rules is None:
        return df.withColumn("blocked", F.lit(False))
    return _app_flag(df, rules, app_col, "blocked", _kinds(rules))
