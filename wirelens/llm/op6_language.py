"""Language ID by Bayesian fusion of evidence.

For every language, four pieces of evidence are multiplied: the likelihood
of the text's byte trigrams (hashed, additive smoothing), the likelihood of
the declared markup language and of the address suffix given the language,
and a host prior. Host priors are smoothed down a hierarchy by grouped
aggregation: all rows, then the registered domain, then the host, each level
adding its counts to the one above as a Dirichlet prior. Neighbouring
trigrams are far from independent, so a text counts as at most ``EVIDENCE``
of them.

The text model is fitted on a sample of labelled rows chosen by the hash of
their id: about ``SAMPLE`` rows, the one bounded quantity here. Everything
else - evidence tables, priors, scores - covers all rows.

A row is kept when its best language has a posterior of ``LEAST`` or more
and its text holds a letter.

Defined results: null or letterless texts carry no text evidence, get the
language null, and are not kept; null or unseen declared languages,
suffixes and hosts carry no evidence (a null host has the prior of all
rows); without labelled rows no language is known and nothing is kept;
repeated rows each give their row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.bytes import let
from wirelens.llm.common import batches, cut

#: Labelled rows of the fitting sample, on average; hashed trigram buckets.
SAMPLE, GRAMS = 20_000, 1 << 16
#: Most texts of a batch that goes to Python.
ROWS = 1024
#: Most trigrams' worth of evidence of a text; least posterior of a kept row.
EVIDENCE, LEAST = 60.0, 0.5
#: Dirichlet weights of the level above, for domains and hosts, and the
#: additive smoothing of the declared languages and suffixes.
DOMAIN_WEIGHT, HOST_WEIGHT, SMOOTH = 20.0, 10.0, 0.5


def _codes(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text, ASCII lower-cased, that hold a letter
    in the middle (a byte of a-z, or of a character beyond ASCII)."""
    b = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mid = b[1:-1]
    letter = ((mid >= 97) & (mid <= 122)) | (mid >= 128)
    a, m, z = (x[letter].astype(np.uint32) for x in (b[:-2], mid, b[2:]))
    h = (a * np.uint32(0x9E3779B1)) ^ (m * np.uint32(0x85EBCA77)) ^ (z * np.uint32(0xC2B2AE3D))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)).astype(np.int64) % GRAMS


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages and their log trigram probabilities (GRAMS rows), from
    ``labelled`` (id, text, lang)."""
    d = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    n = d.count()
    share = 1_000_000 if n <= sample else max(1, round(1_000_000 * sample / n))
    d = d.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < share).select("lang", "text")

    def count(parts):
        for pdf in parts:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = np.zeros(GRAMS, np.int64)
                for t in texts:
                    total += np.bincount(_codes(t), minlength=GRAMS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "gram": at, "n": total[at]})

    # at most GRAMS rows a language of the bounded sample
    with batches(d.sparkSession, ROWS):
        rows = d.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((GRAMS, len(langs)), 0.05, np.float64)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[own["gram"].to_numpy(), k] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32) if langs else table.astype(np.float32)


def text_scores(df: DataFrame, text: str, out: str, langs: list[str], table: np.ndarray) -> DataFrame:
    """``df`` with ``out``: tempered log likelihoods of the text, one a
    language (null without letters)."""
    model = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        logp = model.value
        found = []
        for t in texts:
            codes = _codes(t) if t else ()
            if not len(codes):
                found.append(None)
                continue
            total = np.zeros(logp.shape[1])
            for i in range(0, len(codes), 1 << 20):
                total += logp[codes[i:i + (1 << 20)]].sum(0, dtype=np.float64)
            total -= total.max()
            found.append(total * min(1.0, EVIDENCE / len(codes)))
        return pd.Series(found, dtype=object)

    return df.withColumn(out, score(F.col(text)))


def host_of(url: Column) -> Column:
    """Lower-cased host of an address; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def declared_of(html: Column) -> Column:
    """Primary subtag of the language that the html tag declares."""
    tag = F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1)
    return F.nullif(F.lower(F.regexp_extract(tag, r"""(?is)\blang\s*=\s*["']?\s*([A-Za-z]{2,3})""", 1)), F.lit(""))


def _counts(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group: how often each language is a text's best."""
    counts = [F.sum(F.when(F.col("best") == k, 1).otherwise(0)).cast("double") for k in range(n)]
    return df.groupBy(*by).agg(F.array(*counts).alias("counts"))


def fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """Posterior of every row of ``rows`` (any columns; used: scores,
    declared, suffix, domain, host). Adds language, probability, and
    text_language, the text's own best."""
    n = len(langs)
    names = F.array(*map(F.lit, langs))
    zero = F.array(*[F.lit(0.0)] * n)
    best = F.array_position("scores", F.array_max("scores")) - 1
    d = rows.withColumn("best", best)
    told = d.filter("best IS NOT NULL")
    total = told.agg(*[F.sum(F.when(F.col("best") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(n)]).first()
    seen = [float(x or 0) for x in total]
    whole = sum(seen)
    prior = [(c + 1.0) / (whole + n) for c in seen]
    top = F.array(*map(F.lit, prior))

    def norm(counts, above, weight):
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return let(size, lambda s: F.zip_with(counts, above, lambda c, p: (c + p * weight) / (s + weight)))

    domain = _counts(told.filter("domain IS NOT NULL"), ["domain"], n)
    domain = domain.select("domain", norm(F.col("counts"), top, DOMAIN_WEIGHT).alias("domain_prior"))
    host = _counts(told.filter("host IS NOT NULL"), ["host", "domain"], n).join(domain, "domain")
    host = host.select("host", norm(F.col("counts"), F.col("domain_prior"), HOST_WEIGHT).alias("host_prior"))

    def evidence(column):
        """log P(value | language) for the values that occur."""
        c = _counts(told.filter(F.col(column).isNotNull()), [column], n)
        kinds, *sums = c.agg(F.count(F.lit(1)), *[F.sum(F.get("counts", k)) for k in range(n)]).first()
        sizes = F.array(*[F.lit((x or 0.0) + SMOOTH * max(kinds, 1)) for x in sums])
        return c.select(column, F.zip_with("counts", sizes, lambda x, s: F.ln((x + SMOOTH) / s)).alias(f"{column}_ll"))

    d = (d.join(host, "host", "left").join(evidence("declared"), "declared", "left").join(evidence("suffix"), "suffix", "left"))
    logp = F.transform(F.coalesce("host_prior", top), lambda v: F.ln(v))
    for part in ("scores", "declared_ll", "suffix_ll"):
        logp = F.zip_with(logp, F.coalesce(part, zero), lambda a, b: a + b)

    def posterior(x):
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(e, lambda p: F.struct((F.array_position(p, F.lit(1.0)) - 1).cast("int").alias("k"),
                                         (1 / F.aggregate(p, F.lit(0.0), lambda a, v: a + v)).alias("p")))

    d = d.withColumn("post", F.when(F.col("scores").isNotNull(), let(logp, posterior)))
    return (d.withColumn("language", F.get(names, F.col("post.k"))).withColumn("probability", F.col("post.p"))
            .withColumn("text_language", F.get(names, F.col("best").cast("int"))))


def identify(df: DataFrame, key: str, text: Column, declared: Column, host: Column, labelled: DataFrame) -> DataFrame:
    """One row a row of ``df``: the key, declared, text_language, language,
    probability and kept. ``labelled`` (id, text, lang) fits the text model."""
    host = host.cast("string")
    rows = df.select(F.col(key).alias("key"), text.alias("text"), declared.alias("declared"), host.alias("host"),
                     domain_of(host).alias("domain"), suffix_of(host).alias("suffix"))
    langs, table = fit(labelled)
    if not langs:
        return rows.select(F.col("key").alias(key), "declared", F.lit(None).cast("string").alias("text_language"),
                           F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("kept"))
    scored = cut(text_scores(rows, "text", "scores", langs, table).drop("text"), "language-scores", ROWS)
    return fused(scored, langs).select(F.col("key").alias(key), "declared", "text_language", "language", "probability",
                                       F.coalesce(F.col("probability") >= LEAST, F.lit(False)).alias("kept"))


def labelled_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", "lang")


def identify_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents: the source is the host, lang the declared language."""
    return identify(docs, key, F.col("text"), F.col("lang"), F.col("source"), labelled_documents(docs))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that identify_documents keeps, all columns. Rows
    of one id, text, declared language and source are decided alike."""
    def keys(d):
        return d.withColumn("__id", F.col("doc_id")).withColumn("__row", F.xxhash64("text", "lang", "source"))

    named = keys(docs.select("doc_id", "text", "lang", "source")).withColumn("__key", F.struct("__id", "__row"))
    kept = identify_documents(named, "__key").filter("kept").select(F.col("__key.__id").alias("__a"), F.col("__key.__row").alias("__b"))
    return keys(docs).join(kept, F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__row") == F.col("__b")), "left_semi").drop("__id", "__row")


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Web pages: language of the html tag, address suffix and host; the text
    is the markup without scripts, styles and tags."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return identify(pages, "page_id", bare, declared_of(F.col("html")), host_of(F.col("url")), labelled_documents(docs))


def query(docs: DataFrame) -> DataFrame:
    return identify_documents(docs)
