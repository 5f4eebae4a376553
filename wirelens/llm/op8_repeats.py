"""Removal of repeated passages with suffix arrays built by linear grouping.

A byte goes when a string of ``WIDTH`` bytes that covers it also starts
earlier (smaller id, or earlier in the same document). No suffix array of the
whole corpus is needed: equal strings of WIDTH bytes hold the same smallest
hash of their ``LEVELS[0]``-byte grams, their anchor. A document is cut into
segments, the longest runs of strings with one and the same anchor, so that
equal strings always lie in segments of equal anchors.

1. Batches of documents send the anchors and short hashes of their segments,
   packed by shard of the anchor; a shard answers every batch which of its
   anchors occur again, and which of these with another content.
2. Batches give their segments with such anchors, equal ones once a batch. Of
   equal segments the earliest is the owner and all others are repeats.
3. The distinct segments of an anchor meet in a bucket, where one suffix array
   for each anchor is built (gsaca.py): strings of WIDTH bytes that are equal
   are neighbours in it; the earliest of them stays, the others are repeats.
   An anchor with more than ``CROWD`` distinct segments doesn't meet in one
   task: its segments are cut again by anchors of more bytes (the next of
   LEVELS, at last the whole string, when equal anchors are equal strings).
4. Every batch gets the places of its repeats and takes their bytes out.

Texts are compressed once, whole batches as few rows, and shuffled so. Segments and
contents are told apart by 64-bit hashes; step 3 compares bytes.

Defined results: a null text is empty; rows with a null id come last; rows of
one id follow each other by text; equal rows count one after the other, and
each gives its row; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import cut
from wirelens.llm.gsaca import suffix_arrays
from wirelens.llm.tokens import P1, P2, P3, mix

WIDTH = 100
LEVELS = (32, 80, 100)
CROWD = 128
#: Ids of a batch; segments of a shard and bytes of a bucket aimed at; bytes
#: hashed at once; documents that go to Python at once.
BATCH, SHARD, BUCKET, CHUNK, ROWS = 1024, 500_000, 1 << 21, 1 << 17, 1024
#: Batches of rows with a null id come after all others.
LAST = 1 << 60
#: A place is the document's number in its batch and the byte in it.
PLACE = 40
LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * P1)
#: Powers of an odd number and of its inverse, for sums over parts of a text.
POWERS, INVERSE = (np.cumprod(np.append(np.uint64(1), np.full(CHUNK + 2 * WIDTH, x))) for x in (P3, np.uint64(pow(int(P3), -1, 1 << 64))))


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-byte grams of ``b``."""
    h, have = LETTERS[b], 1
    while have < k:
        step = min(have, k - have)
        h = h[:len(h) - step] * P2 + h[step:]
        h = (h ^ (h >> np.uint64(31))) * P1
        have += step
    return mix(h)


def segments(b: np.ndarray, ends: np.ndarray, k: int):
    """Segments of the documents that ``b`` holds end to end: (start, n,
    anchor, content) - the first byte, the number of strings, the anchor and
    a hash of the bytes n + WIDTH - 1."""
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    at = 0
    while at < len(ends):  # documents together up to CHUNK bytes, or a longer one in overlapping parts
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        if upto > at + 1 or ends[at] - starts[at] <= CHUNK:
            out.append(_segments(b[starts[at]:ends[upto - 1]], ends[at:upto] - starts[at], k, starts[at]))
        else:
            for lo in range(starts[at], max(starts[at] + 1, ends[at] - WIDTH + 1), CHUNK):
                hi = min(lo + CHUNK + WIDTH - 1, ends[at])
                out.append(_segments(b[lo:hi], np.array([hi - lo]), k, lo))
        at = upto
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(none, *filter(None, out))))


def _segments(b, ends, k, base):
    if len(b) < WIDTH:
        return ()
    h = _grams(b, k)
    low, have, w = h, 1, WIDTH - k + 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    valid = np.ones(len(b), bool)
    for e in ends.tolist():  # strings that would cross a document's end
        valid[max(0, e - WIDTH + 1):e] = False
    valid = valid[:len(low)]
    new = valid.copy()
    # a window's anchor is the first of equals, and it is left behind when it was the window's first gram
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (h[:len(low) - 1] == low[:-1])
    start = np.flatnonzero(new)
    over = np.flatnonzero(np.append(valid[:-1] & (~valid[1:] | new[1:]), valid[-1:])) + 1
    n = over - start
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * POWERS[:len(h)], out=sums[1:])
    content = mix((sums[start + n + WIDTH - k] - sums[start]) * INVERSE[start] + n.astype(np.uint64))
    return start + base, n, low[start], content


def _pack(batches):
    """Rows (batch, doc_id, text) to (batch, ids, sizes, blob)."""
    for pdf in batches:
        for batch, rows in pdf.groupby("batch", sort=False):
            size = rows["text"].str.len().cumsum().to_numpy()
            for _, part in rows.groupby(size // 8_000_000, sort=False):
                texts = [t.encode() for t in part["text"]]
                yield pd.DataFrame({"batch": [batch], "ids": [part["doc_id"].to_numpy(np.int64).tobytes()],
                                    "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()],
                                    "blob": [zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]})


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a batch in order."""
    found = []
    for ids, sizes, blob in zip(pdf["ids"], pdf["sizes"], pdf["blob"]):
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
        for i, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int64).tolist()):
            found.append((i, raw[at:at + n]))
            at += n
    found.sort()
    return np.array([i for i, _ in found], np.int64), [t for _, t in found]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]).astype(np.int64)


def batched(docs: DataFrame) -> DataFrame:
    """(batch, doc_id, text), no nulls."""
    text = F.coalesce("text", F.lit(""))
    batch = F.coalesce(F.floor(F.col("doc_id") / BATCH), LAST + F.pmod(F.xxhash64(text), F.lit(1 << 16)))
    return docs.select(batch.cast("long").alias("batch"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), text.alias("text"))


def again(d: DataFrame, shards: int) -> DataFrame:
    """(batch, shard, keys, several): the 32-bit keys of a batch's anchors
    that occur more than once, and whether with different contents."""
    bits = np.uint64(shards.bit_length() - 1)

    def send(batches):
        for pdf in batches:
            for batch, rows in pdf.groupby("batch", sort=False):
                _, _, anchor, content = segments(*_joined([t.encode() for t in rows["text"]]), LEVELS[0])
                key = anchor >> (np.uint64(32) - bits)
                half = (content >> np.uint64(33)).astype(np.uint32)
                order = np.lexsort((half, key))
                key, half = key[order], half[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (half[1:] != half[:-1])
                heads = np.flatnonzero(new)
                more = np.diff(np.append(heads, len(key))) > 1
                key, half = key[heads], half[heads] * np.uint32(2) + more
                shard = (key >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(shard, np.arange(shards + 1))
                low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                parts = [(batch, s, low[ends[s]:ends[s + 1]].tobytes(), half[ends[s]:ends[s + 1]].tobytes())
                         for s in np.flatnonzero(np.diff(ends)).tolist()]
                yield pd.DataFrame(parts, columns=["batch", "shard", "keys", "halves"])

    def answer(key, pdf):
        keys = [np.frombuffer(x, "<u4") for x in pdf["keys"]]
        sizes = [len(x) for x in keys]
        keys, halves = np.concatenate(keys), np.frombuffer(b"".join(pdf["halves"]), np.uint32)
        order = np.argsort((keys.astype(np.uint64) << np.uint64(32)) | halves)
        k, h = keys[order], halves[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(k)))
        first, last = h[heads] >> 1, h[heads + count - 1] >> 1
        repeat = (count > 1) | (np.bitwise_or.reduceat(h, heads) & 1 == 1)
        state = np.zeros(len(k), np.uint8)
        state[order] = np.repeat(repeat.astype(np.uint8) + (first != last), count)
        ends = np.cumsum(sizes)
        rows = []
        for batch, lo, hi in zip(pdf["batch"], [0, *ends[:-1].tolist()], ends.tolist()):
            on = state[lo:hi] > 0
            if on.any():
                rows.append((batch, key[0], keys[lo:hi][on].tobytes(), (state[lo:hi][on] > 1).astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "shard", "keys", "several"])

    sent = d.select("batch", "text").mapInPandas(send, "batch long, shard long, keys binary, halves binary")
    return sent.groupBy("shard").applyInPandas(answer, "batch long, shard long, keys binary, several binary")


SEGMENTS = "batch long, anchor long, content long, n long, place long, others binary, bytes binary"


def _distinct(batch, data: bytes, start, n, anchor, content, place, several) -> pd.DataFrame:
    """Rows of SEGMENTS: a batch's segments, equal ones once."""
    order = np.lexsort((place, content, anchor))
    new = np.ones(len(order), bool)
    a, c = anchor[order], content[order]
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    heads = np.flatnonzero(new)
    each = place[order].astype("<i8").tobytes()
    stops = np.append(heads[1:], len(order))
    one = order[heads]
    return pd.DataFrame({"batch": batch, "anchor": anchor[one].view(np.int64), "content": content[one].view(np.int64), "n": n[one], "place": place[one],
                         "others": [each[8 * i + 8:8 * j] if j > i + 1 else None for i, j in zip(heads.tolist(), stops.tolist())],
                         "bytes": [data[s:s + m + WIDTH - 1] if v else None for s, m, v in zip(start[one].tolist(), n[one].tolist(), several[one].tolist())]})


def repeated_segments(packed: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """(batch, anchor, content, n, place, others, bytes): each batch's
    distinct segments with an anchor that occurs again; place and others (null
    or packed longs) are where they start, bytes is null if the anchor has no
    other content."""
    bits = np.uint64(shards.bit_length() - 1)

    def find(key, texts, told):
        if not len(texts) or not len(told):
            return pd.DataFrame([])
        _, raw = _unpack(texts)
        b, ends = _joined(raw)
        start, n, anchor, content = segments(b, ends, LEVELS[0])
        keys = np.concatenate([(np.uint64(s) << np.uint64(32)) | np.frombuffer(k, "<u4").astype(np.uint64) for s, k in zip(told["shard"], told["keys"])])
        several = np.frombuffer(b"".join(told["several"]), np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, several = keys[order], several[order]
        mine = anchor >> (np.uint64(32) - bits)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        on = np.flatnonzero(keys[at] == mine)
        start, n, anchor, content, several = start[on], n[on], anchor[on], content[on], several[at[on]]
        doc = np.searchsorted(ends, start, "right")
        place = (doc << PLACE) | (start - np.concatenate([[0], ends])[doc])
        return _distinct(key[0], b.tobytes(), start, n, anchor, content, place, several)

    return packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInPandas(
        find, SEGMENTS)


def equal_strings(anchor: np.ndarray, batch: np.ndarray, place: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among distinct segments, anchor by anchor: (segment, first
    string, number of strings)."""
    order = np.argsort(anchor, kind="stable")
    sizes = np.array([len(raw[i]) for i in order], np.int64)
    head = np.ones(len(order), bool)
    head[1:] = anchor[order][1:] != anchor[order][:-1]
    # a free place, then segments each ended by 1, at last 0; letters from 2
    free = head.astype(np.int64)
    begin = np.cumsum(sizes + 1 + free) - sizes - 1
    text = np.zeros(int((sizes + 1 + free).sum()), np.int16)
    seg = np.full(len(text), -1, np.int32)
    inside = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    flat = np.frombuffer(b"".join([raw[i] for i in order]), np.uint8)
    text[inside] = flat.astype(np.int16) + 2
    seg[inside] = np.repeat(np.arange(len(order)), sizes)
    text[begin + sizes] = 1
    first = begin[head]
    last = np.append(first[1:] - 2, len(text) - 1)
    text[last] = 0
    sa = suffix_arrays(text, first, last - first + 1)
    left = np.zeros(len(text), np.int64)  # bytes up to the segment's end
    left[inside] = np.repeat(begin + sizes, sizes) - inside
    at = sa[sa >= 0]
    at = at[left[at] >= WIDTH]
    head_of = np.cumsum(head) - 1
    same = np.zeros(len(at), bool)
    letters = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint8), WIDTH) if len(text) >= WIDTH else None
    for lo in range(1, len(at), 1 << 15):
        hi = min(len(at), lo + (1 << 15))
        x, y = at[lo - 1:hi - 1], at[lo:hi]
        maybe = np.flatnonzero((text[x] == text[y]) & (text[x + WIDTH - 1] == text[y + WIDTH - 1]) & (head_of[seg[x]] == head_of[seg[y]]))
        same[lo + maybe] = (letters[x[maybe]] == letters[y[maybe]]).all(1)
    run = np.cumsum(~same)
    own = seg[at]
    off = at - begin[own]
    by = np.lexsort((place[order][own] + off, batch[order][own], run))
    repeat = np.zeros(len(at), bool)
    repeat[by[1:]] = run[by[1:]] == run[by[:-1]]
    own, off = own[repeat], off[repeat]
    by = np.lexsort((off, own))
    own, off = own[by], off[by]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)
    heads = np.flatnonzero(new)
    return order[own[heads]], off[heads], np.diff(np.append(heads, len(own)))


def _compare(key, pdf):
    batch, place = pdf["batch"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
    who, off, n = equal_strings(pdf["anchor"].to_numpy(np.int64), batch, place, list(pdf["bytes"]))
    return pd.DataFrame({"batch": batch[who], "place": place[who] + off, "n": n})


def _finer(k: int):
    """Cuts a batch's segments again, by anchors of k bytes."""
    def cut_again(key, pdf):
        b, ends = _joined(list(pdf["bytes"]))
        start, n, anchor, content = segments(b, ends, k)
        which = np.searchsorted(ends, start, "right")
        place = pdf["place"].to_numpy(np.int64)[which] + start - np.concatenate([[0], ends])[which]
        return _distinct(key[0], b.tobytes(), start, n, mix(anchor + np.uint64(k)), content, place, np.ones(len(n), bool))

    return cut_again


def repeats(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(batch, place, others, n): n strings from the place and each of the
    others on are repeats."""
    d = batched(docs)
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = 1 << max(0, size // 35 // SHARD).bit_length()
    found = repeated_segments(packed, again(d, shards), shards)
    out = None
    for k in (*LEVELS[1:], None):
        # of equal segments the earliest stays; a batch has one row of them
        first = F.row_number().over(Window.partitionBy("anchor", "content").orderBy("batch")) == 1
        found = cut(found.withColumn("first", first), "segments", ROWS)
        whole = found.filter("NOT first OR others IS NOT NULL").select("batch", F.expr("if(first, null, place)").alias("place"), "others", "n")
        out = out.union(whole) if out else whole
        rest = found.filter("first AND bytes IS NOT NULL").select("anchor", "batch", "place", "bytes")
        several = cut(rest.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("bytes")).alias("size")).filter("m > 1"), "anchors")
        met = several.filter(F.col("m") <= CROWD) if k else several
        total = met.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if total:
            bucket = F.pmod(F.xxhash64("anchor", F.lit(1)), F.lit(-(-total // BUCKET)))
            marks = (rest.join(met.select("anchor").hint("shuffle_hash"), "anchor").withColumn("bucket", bucket).groupBy("bucket")
                     .applyInPandas(_compare, "batch long, place long, n long"))
            out = out.union(cut(marks, "marks").select("batch", "place", F.lit(None).cast("binary").alias("others"), "n"))
        crowds = several.filter(F.col("m") > CROWD).select("anchor").hint("shuffle_hash")
        if not k or crowds.isEmpty():
            break
        found = rest.join(crowds, "anchor").select("batch", "place", "bytes").groupBy("batch").applyInPandas(_finer(k), SEGMENTS)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, n_bytes,
    n_removed, n_spans, and kept, the bytes that remain."""
    packed = cut(batched(docs).mapInPandas(_pack, "batch long, ids binary, sizes binary, blob binary"), "packed", ROWS)
    marks = repeats(docs, packed)

    def take(key, texts, marks):
        ids, raw = _unpack(texts)
        b, ends = _joined(raw)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        n = marks["n"].to_numpy(np.int64)
        one, more = marks["place"].notna().to_numpy(), marks["others"].notna().to_numpy()
        others = marks["others"][more]
        at = np.concatenate([marks["place"][one].to_numpy(np.int64), np.frombuffer(b"".join(others), "<i8")])
        n = np.concatenate([n[one], np.repeat(n[more], others.str.len().to_numpy(np.int64) // 8)])
        at = starts[at >> PLACE] + (at & ((1 << PLACE) - 1))
        change = np.zeros(len(b) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + n + (WIDTH - 1), -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        fence = starts[starts < len(b)]
        edge[fence] = gone[fence]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, edge))
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64") if key[0] < LAST else pd.array([None] * len(ids), "Int64"),
                             "n_bytes": ends - starts, "n_removed": total[ends] - total[starts], "n_spans": spans[ends] - spans[starts],
                             "kept": [b[lo:hi][~gone[lo:hi]].tobytes() for lo, hi in zip(starts.tolist(), ends.tolist())]})

    return packed.groupBy("batch").cogroup(marks.groupBy("batch")).applyInPandas(
        take, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(docs: DataFrame) -> DataFrame:
    d = without_repeats(docs)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
