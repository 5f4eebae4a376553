"""Secret scans through a trigram inverted index, DataFrame functions only.

From every rule's regular expression a Boolean trigram query is derived: an
OR of clauses, each an AND of trigrams that any match must contain. The
index holds (trigram, document) postings for the trigrams that the rules
ask for; a clause's postings are intersected per document (a bit per trigram,
OR-ed by a partial aggregate before the shuffle, so a trigram held by most
documents makes no hot key), and only the documents of a surviving clause
are verified with the expression itself. Rules without mandatory trigrams
scan every text.

Postings are over lower-cased text, so they serve either case and never
lose a match. Offsets count code points; a text's matches are found by
splitting it at them, the lengths of gaps and matches giving the places.

Defined results: a null text is empty and has no spans; null and repeated
ids are told apart by the text's hash, equal rows each give their row; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.bytes import let


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``value`` is a capture group that needs ``least``
    characters, or None."""

    name: str
    pattern: str
    value: int | None = None
    least: int = 0


#: Kinds in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Alternatives that a derivation keeps apart, and members of a small class.
ALTERNATIVES, MEMBERS = 64, 6
BREAK = "\0"


def fragments(node) -> list[str]:
    """Strings that cover a parsed expression, lower-cased: every match
    contains the parts of one of them between breaks, in order."""
    out = [""]
    for op, arg in node:
        if op is sre.LITERAL:
            here = [chr(arg).lower()]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= MEMBERS:
            here = sorted({chr(c).lower() for _, c in arg})
        elif op is sre.BRANCH:
            here = sorted({s for branch in arg[1] for s in fragments(branch)})
        elif op is sre.SUBPATTERN:
            here = fragments(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = fragments(inner)
            if low == 0:
                here = ["", *one] if high == 1 else [BREAK]
            else:
                here = one if low == high == 1 else [s + BREAK for s in one]
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            here = [""]
        else:
            here = [BREAK]
        out = sorted({a + b for a in out for b in here}) if len(out) * len(here) <= ALTERNATIVES else [a + BREAK for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The Boolean query of an expression: clauses of trigrams, one of which
    every match holds in full. None: some match may hold no trigram."""
    clauses = set()
    for s in fragments(parser.parse(pattern)):
        grams = frozenset(p[i:i + 3] for p in s.split(BREAK) for i in range(len(p) - 2))
        if not grams:
            return None
        clauses.add(grams)
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key: the id (null: the smallest long) and
    the text's hash."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.select("doc_id", F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("k1"), F.xxhash64("text").alias("k2"), "text")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of ``docs`` (k1, k2, text) for the given trigrams:
    rows (gram, k1, k2)."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))
    return docs.select(F.explode(held).alias("gram"), "k1", "k2")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Documents (k1, k2, rules) that satisfy a clause of a rule's query."""
    rows = [(g, name, n, 1 << k, (1 << len(c)) - 1) for name, clauses in queries.items()
            for n, c in enumerate(clauses) for k, g in enumerate(sorted(c))]
    clauses = index.sparkSession.createDataFrame(rows, "gram string, rule string, clause int, bit long, full long")
    met = (index.join(F.broadcast(clauses), "gram")  # a row for each rule's trigram, whatever the data
           .groupBy("k1", "k2", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits")).filter("bits = full"))
    return met.groupBy("k1", "k2").agg(F.collect_set("rule").alias("rules"))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, kind rank, end) of a rule's matches, leftmost first."""
    kind = "array<struct<start:int,kind:int,end:int>>"
    pattern = F.lit(rule.pattern)

    def places(found, gaps):
        first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc, i):
            return let(acc["at"] + F.length(F.get(gaps, i)), lambda start: let(start + F.length(F.get(found, i)), lambda end: F.struct(
                end.alias("at"), F.when(good(F.get(found, i)), F.concat(acc["out"], F.array(F.struct(
                    start.alias("start"), F.lit(rank).alias("kind"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))))

        def good(m):
            return F.lit(True) if rule.value is None else F.length(F.regexp_extract(m, rule.pattern, rule.value)) >= rule.least

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda acc: acc["out"])

    spans = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: let(
        F.split(text, rule.pattern, -1), lambda gaps: places(found, gaps)))
    return F.when(F.rlike(text, pattern), spans).otherwise(F.array().cast(kind))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document: doc_id, spans (array of start, kind: the rule's
    place in ``rules``, end; sorted)."""
    return _found(docs, rules).select("doc_id", "spans")


def _found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, the row's key (k1, k2) and spans of every row."""
    d = _keyed(docs)
    asked = {r.name: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in asked.items() if q}
    scanned = [matches(F.col("text"), r, i) for i, r in enumerate(rules) if not asked[r.name]]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = d.select("doc_id", "k1", "k2", F.concat(none, *scanned).alias("scanned"))
    if indexed:
        grams = sorted({g for q in indexed.values() for c in q for g in c})
        found = candidates(postings(d.select("k1", "k2", "text"), grams), indexed).hint("shuffle_hash")
        verified = d.select("k1", "k2", "text").join(found, ["k1", "k2"]).select("k1", "k2", F.concat(none, *[
            F.when(F.array_contains("rules", r.name), matches(F.col("text"), r, i)).otherwise(none)
            for i, r in enumerate(rules) if r.name in indexed]).alias("verified"))
        verified = verified.filter(F.size("verified") > 0).dropDuplicates(["k1", "k2"])
        out = out.join(verified, ["k1", "k2"], "left").withColumn(
            "scanned", F.concat("scanned", F.coalesce("verified", none)))
    return out.select("doc_id", "k1", "k2", F.array_sort("scanned").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span of ``spans`` (as above) replaced by
    [REDACTED]; overlapping spans are replaced together."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        keep = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(
            text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[REDACTED]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), keep.alias("out"))

    whole = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redacted_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets of the texts redacted and n_chars renewed;
    texts without secrets, null ones among them, stay as they are."""
    hit = (_found(docs, rules).filter(F.size("spans") > 0).dropDuplicates(["k1", "k2"])
           .select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans")).hint("shuffle_hash"))
    # the key of _keyed
    key = (F.coalesce("doc_id", F.lit(-(2 ** 63))) == F.col("__k1")) & (F.xxhash64("text") == F.col("__k2"))
    d = docs.join(hit, key, "left").withColumn("__text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__spans"))))
    return d.select(*[F.col("__text").alias(c) if c == "text" else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(F.length("__text")).alias(c)
                      if c == "n_chars" else F.col(c) for c in docs.columns])


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    names = [r.name for r in RULES]
    d = secret_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{n}") for k, n in enumerate(BASE)]
    return d.select("doc_id", *counts, F.sha2(listed(base, names), 256).alias("base_sha256"), listed(F.col("spans"), names).alias("spans"))


def oracle() -> str:
    """The same rows in DuckDB SQL, from the expressions alone."""
    def one(k, r):
        p = r.pattern.replace("'", "''")
        if r.value is None:
            return f"""SELECT rid, {k} AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m,
                list_transform(regexp_extract_all(t, '{p}'), lambda x: true) AS ok FROM d"""
        return f"""SELECT rid, {k} AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m,
                list_transform(regexp_extract_all(t, '{p}', {r.value}), lambda x: length(x) >= {r.least}) AS ok FROM d"""

    names = ", ".join(f"'{r.name}'" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        f AS ({' UNION ALL '.join(one(k, r) for k, r in enumerate(RULES))}),
        e AS (SELECT rid, kind, g, m, ok, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
        s AS (SELECT rid, kind, ok[i] AS good, length(m[i]) AS n,
                coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM e),
        p AS (SELECT rid, kind, start, ([{names}])[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS span FROM s WHERE good),
        a AS (SELECT rid, string_agg(span, ',' ORDER BY start, kind) AS spans,
                string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
                count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1,
                count(*) FILTER (WHERE kind = 2) AS n2 FROM p GROUP BY rid)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""
