"""Language-model scoring with a log-frequency Bloom filter.

The model is a smoothed bigram model over words and one end token a text. It
is learnt from the rows whose crc32(id as text) mod 10 is not 0. Its counts
live in a Bloom filter: a gram of count c is inserted with the numbers
1..q, q = 1 + floor(log2 c), so that asking for (gram, 1), (gram, 2), ...
until a miss gives the quantised count. Every gram of every count is
inserted, whatever the size of the corpus.

Rows are dealt, in the files' order, to parts of about ``SLICE`` characters,
and grams to shards by hash. A part sends each shard one row a kind of gram:
its distinct grams there and their training counts. A shard's task counts
its grams, builds its segment of the filter, probes it for all that was
asked, and sends the answers back to the parts. The filter is never in one
place: the number of shards grows with the corpus, and a segment has about
``SHARD_TOKENS`` tokens and at most ``MOST_BYTES`` on average.

A word's probability is (c(v w) + MU p(w)) / (c(v) + MU), with
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), all counts probed from the filter.
``base_score`` has the exact counts of words, which their shards know.

Defined results: a null text is empty (one token, the end); a null id counts
as the empty string (held out); repeated rows each count and give their row;
with no training rows N = V = 0 and every probability is 1; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import cut, tidy
from wirelens.llm.tokens import P1, P2, P3, mix, word_hashes

#: Least count of a bigram that the filter holds; most bytes of a segment.
LEAST_BIGRAM = 1
MOST_BYTES = 64 << 20
#: Filter bits per inserted number, probes per number, smoothing weight.
BITS, PROBES, MU = 10, 7, 4.0
#: Tokens that a shard aims at; characters of a part; documents that go to
#: Python at once.
SHARD_TOKENS, SLICE, ROWS = 1_000_000, 6_000_000, 1024
#: Bytes of a gram in its shard's rows: words (kind 0) whole, bigrams (1) hashed.
KEYS = ("<u8", "<u4")
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text followed by END, and the texts' sizes."""
    parts, sizes = [], []
    end = np.array([END], np.uint64)
    for t in texts:
        h = word_hashes(t)
        parts += (h, end)
        sizes.append(len(h) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def _before(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, START before a text's first."""
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[np.concatenate([[0], sizes.cumsum()[:-1]]).astype(np.int64)] = START
    return prev


def _bigram(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(prev * P3 + word + P1)


def _grams(tokens: np.ndarray, sizes: np.ndarray):
    """Per kind its hashed grams: shards are their highest bits."""
    return mix(tokens), mix(_bigram(_before(tokens, sizes), tokens))


def _packed_texts(texts) -> dict:
    """A null text is the empty one."""
    each = [(t or "").encode() for t in texts]
    return {"sizes": [np.array([len(t) for t in each], "<i8").tobytes()], "texts": [zstandard.ZstdCompressor(level=1).compress(b"".join(each))]}


def _unpacked(part) -> tuple[list, np.ndarray, list[str]]:
    """doc_ids, held_out and texts of a part's rows."""
    ids, held_out, texts = [], [], []
    for i, h, sizes, packed in zip(part["doc_ids"], part["held_out"], part["sizes"], part["texts"]):
        ids += list(i)
        held_out += list(h)
        raw, ends = zstandard.ZstdDecompressor().decompress(packed), np.frombuffer(sizes, "<i8").cumsum().tolist()
        texts += [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]
    return ids, np.array(held_out, bool), texts


def _squeezed(keys: np.ndarray, times: np.ndarray) -> bytes:
    """A row's keys, in order, and their training counts. The steps between
    keys are far smaller than the keys, so their upper bytes, put together,
    pack well; the lower ones are noise."""
    steps = np.diff(keys, prepend=keys.dtype.type(0)).astype(keys.dtype)
    columns, half = steps.view(np.uint8).reshape(len(keys), -1).T, keys.itemsize // 2
    upper, counts = (zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in (columns[half:], times.view(np.uint8).reshape(len(keys), -1).T))
    return np.array([len(keys), len(upper)], "<u4").tobytes() + columns[:half].tobytes() + upper + counts


def _spread(data: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of ``_squeezed``."""
    n, size = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + n * (np.dtype(dtype).itemsize // 2)
    upper, counts = (zstandard.ZstdDecompressor().decompress(x) for x in (data[at:at + size], data[at + size:]))
    steps, times = (np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, n).T) for x in (data[8:at] + upper, counts))
    return steps.view(dtype)[:, 0].cumsum(dtype=dtype), times.view("<u4")[:, 0]


def parts(docs: DataFrame, shards: int) -> DataFrame:
    """The rows (kind -1: part, doc_ids as text, held_out, and the texts packed
    by _packed_texts, since they are kept and moved once more) and, for each
    part, kind and shard, the distinct grams in order with their training
    counts (grams, by _squeezed) and the sum of these (tokens)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    bits = np.uint64(shards.bit_length() - 1)

    def packed(part, texts, held_out):
        tokens, sizes = _tokens(texts)
        train = np.repeat(~held_out, sizes)
        rows = []
        for kind, grams in enumerate(_grams(tokens, sizes)):
            u, at = np.unique(grams, return_inverse=True)
            n = np.bincount(at, train, len(u)).astype("<u4")
            shard = (u >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
            keys = u if kind == 0 else (u >> (np.uint64(32) - bits)) & np.uint64(0xFFFFFFFF)
            keys = keys.astype(KEYS[kind])
            ends = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(ends)):
                k, c = keys[ends[s]:ends[s + 1]], n[ends[s]:ends[s + 1]]
                rows.append((kind, int(s), part, _squeezed(k, c), int(c.sum(dtype=np.int64)), None, None, None, None))
        return pd.DataFrame(rows, columns=["kind", "shard", "part", "grams", "tokens", "doc_ids", "held_out", "sizes", "texts"])

    def deal(batches):
        part, size, texts, held_out = TaskContext.get().partitionId() << 32, 0, [], []
        for pdf in batches:
            # a part ends with the row that fills it
            sizes = size + (pdf["text"].str.len().fillna(0).astype(np.int64) + 16).cumsum().to_numpy()
            at = 0
            while at < len(pdf):
                end = min(len(pdf), int(np.searchsorted(sizes, SLICE)) + 1)
                rows = pdf.iloc[at:end]
                out = rows["held_out"].tolist()
                yield pd.DataFrame({"kind": [-1], "shard": [0], "part": [part], "grams": [b""], "tokens": [0],
                                    "doc_ids": [rows["doc_id"].tolist()], "held_out": [out], **_packed_texts(rows["text"])})
                texts += list(rows["text"])
                held_out.append(rows["held_out"].to_numpy(bool))
                size = int(sizes[end - 1])
                if size >= SLICE:
                    yield packed(part, texts, np.concatenate(held_out))
                    part, sizes, size, texts, held_out = part + 1, sizes - size, 0, [], []
                at = end
        if texts:
            yield packed(part, texts, np.concatenate(held_out))

    schema = "kind int, shard long, part long, grams binary, tokens long, doc_ids array<string>, held_out array<boolean>, sizes binary, texts binary"
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), held.alias("held_out"), "text").mapInPandas(deal, schema)


def _places(keys: np.ndarray, number, size: np.uint64):
    """The filter places of (key, number) in a segment of ``size`` bits."""
    a = mix(keys.astype(np.uint64) * P1 + np.uint64(number * int(P2) % (1 << 64)))
    b = mix(a + P3) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) % size).astype(np.int64)


def segment(keys: np.ndarray, levels: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """Size and bits, eight a byte, of a segment of the filter with each key's numbers 1..level."""
    size = np.uint64(max(64, int(levels.sum(dtype=np.int64)) * BITS))
    on = np.zeros(-(-int(size) // 8) * 8, bool)
    for number in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= number], number, size):
            on[place] = True
    return size, np.packbits(on, bitorder="little")


def probed(keys: np.ndarray, size: np.uint64, data: np.ndarray) -> np.ndarray:
    """The levels that a segment gives for the keys."""
    out = np.zeros(len(keys), np.uint8)
    alive, number = np.arange(len(keys)), 1
    while len(alive):
        hit = np.arange(len(alive))
        for place in _places(keys[alive], number, size):
            p = place[hit]
            hit = hit[((data[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)]
        alive = alive[hit]
        out[alive] = number
        number += 1
    return out


def answers(grams: DataFrame) -> DataFrame:
    """For each row of ``grams`` (see parts) the grams' levels and, of words,
    the exact counts; kinds sums up to the number of words ever seen."""
    def answer(key, pdf):
        kind = int(key[0])
        keys, times = zip(*(_spread(x, KEYS[kind]) for x in pdf["grams"]))
        sizes = np.array([len(k) for k in keys], np.int64)
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(at, np.concatenate(times), len(u)).astype(np.int64)
        level = np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.uint8)
        kept = c >= (LEAST_BIGRAM if kind else 1)
        found = probed(u, *segment(u[kept], level[kept]))[at]
        exact = c[at].astype("<i8") if kind == 0 else None
        ends = np.concatenate([[0], sizes.cumsum()])
        cuts = list(zip(ends[:-1], ends[1:]))
        out = pd.DataFrame({"part": pdf["part"], "kind": kind, "shard": key[1], "levels": [found[a:b].tobytes() for a, b in cuts],
                            "counts": [exact[a:b].tobytes() if kind == 0 else b"" for a, b in cuts], "kinds": 0})
        out.loc[out.index[0], "kinds"] = int((c > 0).sum()) if kind == 0 else 0
        return out

    schema = "part long, kind int, shard long, levels binary, counts binary, kinds long"
    return grams.groupBy("kind", "shard").applyInPandas(answer, schema)


def _middle(levels: np.ndarray) -> np.ndarray:
    """Counts, each the middle of its level."""
    q = levels.astype(np.int64)
    return np.where(q > 0, (2.0 ** (q - 1) + 2.0 ** q - 1) / 2, 0.0)


def scores(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score."""
    chars, rows = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count(F.lit(1))).first()
    # a token has five characters or so, and two at least; a gram of count c adds at most c numbers
    need = max(chars // 5 // SHARD_TOKENS, (chars // 2 + rows) * BITS // 8 // most_bytes)
    dealt = cut(parts(docs, 1 << need.bit_length()), "parts", ROWS)
    grams, texts = dealt.filter("kind >= 0").select("kind", "shard", "part", "grams"), dealt.filter("kind < 0")
    told = cut(answers(grams), "answers", ROWS)
    tidy(docs.sparkSession)
    total = dealt.filter("kind = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    kinds = told.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    ends = texts.agg(F.coalesce(F.sum(F.size(F.filter("held_out", lambda h: ~h))), F.lit(0))).first()[0]
    floor = 0.1 * (kinds + 1)

    def score(key, part, told):
        told = told.sort_values(["kind", "shard"])

        def of(kind, column, dtype):
            return np.frombuffer(b"".join(told.loc[told["kind"] == kind, column]), dtype)

        ids, held_out, each = _unpacked(part)
        tokens, sizes = _tokens(each)
        starts = np.concatenate([[0], sizes.cumsum()[:-1]]).astype(np.int64)
        at, pair_of = (np.unique(g, return_inverse=True)[1] for g in _grams(tokens, sizes))
        c, seen = of(0, "counts", "<i8"), _middle(of(0, "levels", np.uint8))
        base = np.log10((c + 0.1) / (total + floor))
        p = (seen + 0.1) / (total + floor)
        context = np.empty(len(tokens))
        context[1:] = seen[at[:-1]]
        context[starts] = ends
        joint = _middle(of(1, "levels", np.uint8))[pair_of]
        word = np.log10((joint + MU * np.minimum(p[at], 1.0)) / (np.maximum(context, joint) + MU))
        return pd.DataFrame({
            "doc_id": ids, "held_out": held_out, "n_tokens": sizes,
            "n_known": np.add.reduceat((c > 0)[at].astype(np.int64), starts), "train_tokens": total,
            "base_score": np.add.reduceat(base[at], starts), "score": np.add.reduceat(word, starts)})

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = (texts.select("part", "doc_ids", "held_out", "sizes", "texts").groupBy("part")
           .cogroup(told.select("part", "kind", "shard", "levels", "counts").groupBy("part")).applyInPandas(score, schema))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(docs: DataFrame) -> DataFrame:
    return scores(docs)
