"""Grouping of spelling variants by reduced-alphabet generation.

1. ``vocabulary`` counts the words of all texts: partial counts in the tasks,
   summed by word. Counts are flushed once ``FLUSH`` distinct words are held,
   long texts are read in pieces, so memory is bounded.
2. Letters are hashed to ``SYMBOLS`` symbols. For every word the full
   one-edit neighbourhood of its reduced form (itself, every deletion,
   replacement and insertion of a symbol) is generated as 64-bit polynomial
   hashes, each of them in constant time from the prefix sums of the word,
   and joined with the hashes of the reduced vocabulary. Words that differ by
   one edit have reduced forms that differ by one or none, so no pair is lost;
   what only looks near is refused on the original strings (``levenshtein``).
3. Where more than ``CROWD`` words share a reduced form, they are searched
   with all 90 letters as symbols instead, so no pair of a crowd is compared
   that doesn't differ by an edit. Nothing is cut off.
4. A word's form is its near word of the largest count, if that is ``TIMES``
   its own; roots are found by following forms, doubling the step each round.
   A form is ``TIMES`` as frequent, so chains have few links.

Defined results: a null text has no words; a null id is written as nothing
in ``<doc_id>:<run>``; repeated rows count again; words come out once each; an
empty table, or one without frequent words, gives no rows. A word's
neighbourhood, 17 keys a letter, must fit a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import CRC32_CTE, crc32_sql, cut, drop
from wirelens.llm.tokens import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
#: One in so many occurrences, by a hash of document and run, has a letter deleted.
SLIP = 199
#: Letters and occurrences of a word, and how many times as frequent its form is.
LEAST_LETTERS, LEAST_N, TIMES = 6, 5, 5
SYMBOLS = 8
#: Words of one reduced form beyond which they are searched by all letters.
CROWD = 1000
#: Distinct words held by a task, characters of a text read at once, keys made at once.
FLUSH, PIECE, KEYS = 200_000, 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
OVER = pow(BASE, -1, 2 ** 64)


def _pieces(text: str):
    """The text, cut where no run is cut."""
    a = 0
    while a < len(text):
        m = GAP.search(text, a + PIECE)
        b = m.start() if m else len(text)
        yield text[a:b]
        a = b


def _counts(batches):
    held: Counter = Counter()

    def flush():
        words = list(held)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
        held.clear()
        return out

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            if not text:
                continue
            runs: Counter = Counter()
            for piece in _pieces(text.encode().lower().decode()):  # bytes.lower knows A-Z alone
                runs.update(RUN.findall(piece))
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in runs.items():
                h = zlib.crc32(run.encode(), crc)
                if h % SLIP:
                    held[run] += n
                else:
                    k = h % len(run)
                    held[run[:k] + run[k + 1:]] += n
            if len(held) > FLUSH:
                yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LEAST_LETTERS letters and LEAST_N occurrences."""
    each = docs.select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(_counts, "word string, n long")
    return (each.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= LEAST_N))


def _values(symbols: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The value of the symbol of every code point below 256, and the values
    of all symbols; None: every letter is a symbol of its own."""
    codes = np.arange(256, dtype=np.uint64)
    symbol = codes if symbols is None else mix(codes + np.uint64(1)) % np.uint64(symbols)
    every = np.array(LETTERS, np.uint64) if symbols is None else np.arange(symbols, dtype=np.uint64)
    return mix(symbol + np.uint64(1000)), mix(every + np.uint64(1000))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _by_length(batch, symbols):
    """(words, values of their symbols as a matrix) of words of one length."""
    found: dict[int, list[str]] = {}
    for w in batch.column(0).to_pylist():
        found.setdefault(len(w), []).append(w)
    of = _values(symbols)[0]
    for n, words in found.items():
        step = max(1, KEYS // (n * 40))
        for k in range(0, len(words), step):
            some = words[k:k + step]
            codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), n)
            yield some, of[codes]


def _named(h: np.ndarray, n: int) -> np.ndarray:
    return mix(h + np.uint64(n * OVER % 2 ** 64))


def reduced_keys(values: np.ndarray) -> np.ndarray:
    """The hashes of the reduced words."""
    n = values.shape[1]
    return _named((values * _powers(n)).sum(axis=1, dtype=np.uint64), n)


def neighbour_keys(values: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The hashes of each reduced word's one-edit neighbourhood, itself included."""
    w, n = values.shape
    p = _powers(n + 1)
    part = values * p[:n]
    upto = np.zeros((w, n + 1), np.uint64)
    np.cumsum(part, axis=1, out=upto[:, 1:])
    total = upto[:, -1:]
    deleted = upto[:, :-1] + (total - upto[:, 1:]) * np.uint64(OVER)
    replaced = (total - part)[:, :, None] + p[:n, None] * every
    inserted = (upto + (total - upto) * np.uint64(BASE))[:, :, None] + p[:, None] * every
    return np.concatenate([_named(total, n), _named(deleted, n - 1), _named(replaced, n).reshape(w, -1),
                           _named(inserted, n + 1).reshape(w, -1)], axis=1)


def _reduced(symbols):
    def run(batches):
        for b in batches:
            counts = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for words, values in _by_length(b, symbols):
                yield pa.RecordBatch.from_arrays([pa.array(reduced_keys(values).view(np.int64)), pa.array(words, pa.string()),
                                                  pa.array([counts[w] for w in words], pa.int64())], ["key", "near", "near_n"])
    return run


def _neighbours(symbols):
    def run(batches):
        every = _values(symbols)[1]
        for b in batches:
            for words, values in _by_length(b, symbols):
                keys = np.sort(neighbour_keys(values, every), axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                each = pa.array(words, pa.string()).take(pa.array(np.nonzero(new)[0]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), each], ["key", "word"])
    return run


def _met(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of rows (key, word) and (key, near) that differ by one edit.
    Spark takes a neighbourhood to be as small as the words it is made of and
    would broadcast it: both sides are shuffled."""
    return (words.join(targets.hint("merge"), "key").filter(F.col("word") != F.col("near"))
            .filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n"))


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, near, near_n: all ordered pairs that differ by exactly one edit."""
    key, pair = "key long, near string, near_n long", "key long, word string"
    words = vocab.select("word", "n")
    reduced = words.mapInArrow(_reduced(symbols), key)
    around = words.select("word").mapInArrow(_neighbours(symbols), pair)
    crowded = cut(reduced.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        return _met(around, reduced)
    targets = reduced.join(crowded, "key", "left_semi").select(F.col("near").alias("word"), F.col("near_n").alias("n"))
    seekers = around.join(crowded, "key", "left_semi").select("word").distinct()
    return _met(around, reduced.join(crowded, "key", "left_anti")).union(
        _met(seekers.mapInArrow(_neighbours(None), pair), targets.mapInArrow(_reduced(None), key)))


def spelling_groups(docs: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocab = cut(vocabulary(docs), "vocabulary")
    best = (near_pairs(vocab, symbols, crowd).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")))
    is_form = -F.col("best.minus") >= TIMES * F.col("n")
    forms = cut(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    steps = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not steps.filter("moved").isEmpty():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, steps = steps, cut(steps.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(last)
    return (forms.join(steps, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(docs: DataFrame) -> DataFrame:
    return spelling_groups(docs)


def oracle() -> str:
    return f"""
WITH RECURSIVE {CRC32_CTE},
low AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS run FROM low) GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("id || ':' || run")} AS h FROM runs, crc),
spelt AS (SELECT n, CASE WHEN h % {SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM spelt GROUP BY word HAVING length(word) >= {LEAST_LETTERS} AND sum(n) >= {LEAST_N}),
cuts AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM v, unnest(range(length(word))) r(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min_by(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * v.n THEN near END AS form,
  CASE WHEN near_n >= {TIMES} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS further FROM forms
  UNION ALL SELECT c.word, c.further, f.form FROM chain c JOIN forms f ON f.word = c.further)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.further IS NULL
"""
