"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the tokenizer's pattern; each piece starts as its bytes,
and the adjacent pair of lowest rank, leftmost first, is merged until no pair
has a rank. A segment tree over the piece's byte positions stores, at
position i, the rank of the pair that starts there; its root is the leftmost
minimum. A merge changes three leaves - the merged pair's, its left
neighbour's, and the one that dies - each with a logarithmic path of minima.

Texts stay in Spark's partitions and are encoded in Arrow batches. New short
pieces of a batch are encoded together, one row of the trees' arrays each;
long pieces one by one. A bounded memo holds recent pieces.

Defined results: a null text is the empty text, with no ids; strings of
special tokens are ordinary text; repeated rows each give their row; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of up to this many bytes are encoded in groups; so many per group.
SHORT, GROUP = 64, 8192
#: Memo entries per worker, and texts of a batch taken together (characters).
MEMO, CHUNK = 600_000, 1_000_000
NONE = np.int64(1 << 62)


class Vocabulary:
    """Tables made from a rank file's bytes (base64 token, rank lines)."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.whole, self.pattern = ranks, regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pair = {(ranks[t[:k]] << 20) | ranks[t[k:]]: r for t, r in ranks.items()
                     for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(self.pair), np.int64)
        self.rank = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        self.memo: dict[str, bytes] = {}

    # one tree per row -------------------------------------------------

    def _ranks(self, left, right):
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def encode_group(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of pieces of up to SHORT bytes."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(n.max())
        leaves = 1 << max(1, (width - 1).bit_length())
        rows = np.arange(len(pieces))
        ids = np.zeros((len(pieces), width + 1), np.int64)
        live = np.arange(width)[None, :] < n[:, None]
        ids[:, :width][live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (len(pieces), 1))
        before = np.tile(np.arange(-1, width), (len(pieces), 1))
        tree = np.full((len(pieces), 2 * leaves), NONE, np.int64)
        if width > 1:
            r = self._ranks(ids[:, :width - 1], ids[:, 1:width])
            ok = (r >= 0) & (np.arange(1, width)[None, :] < n[:, None])
            tree[:, leaves:leaves + width - 1] = np.where(ok, r * leaves + np.arange(width - 1), NONE)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            kids = tree[:, 2 * a:4 * a]
            tree[:, a:2 * a] = np.minimum(kids[:, ::2], kids[:, 1::2])

        def put(rows, at, value):  # point update: the leaf, then the minima above it
            node = at + leaves
            tree[rows, node] = value
            while leaves > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows, at, nxt):
            r = np.where(nxt < n[rows], self._ranks(ids[rows, at], ids[rows, np.minimum(nxt, width)]), -1)
            return np.where(r >= 0, r * leaves + at, NONE)

        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            low = tree[rows, 1]
            at, rank = low % leaves, low // leaves
            gone = after[rows, at]
            nxt = after[rows, gone]
            ids[rows, at], after[rows, at], live[rows, gone] = rank, nxt, False
            before[rows, np.minimum(nxt, width)] = at
            put(rows, gone, NONE)
            put(rows, at, pair(rows, at, nxt))
            prev = before[rows, at]
            has = prev >= 0
            if has.any():
                r, p = rows[has], prev[has]
                put(r, p, pair(r, p, at[has]))
        flat, count = ids[:, :width][live].astype("<u4").tobytes(), live.sum(1).cumsum() * 4
        return [flat[a:b] for a, b in zip([0, *count[:-1].tolist()], count.tolist())]

    def encode_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length."""
        pair, none, n = self.pair, int(NONE), len(piece)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        leaves = 1 << max(1, (n - 1).bit_length())
        tree = np.full(2 * leaves, NONE, np.int64)
        r = self._ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        tree[leaves:leaves + n - 1] = np.where(r >= 0, r * leaves + np.arange(n - 1), NONE)
        a = leaves
        while a > 1:
            tree[a // 2:a] = np.minimum(tree[a:2 * a:2], tree[a + 1:2 * a:2])
            a //= 2
        tree = tree.tolist()
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        live = bytearray(b"\1" * n)

        def put(at, value):
            node = at + leaves
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                m = a if a < b else b
                if tree[node] == m:
                    break
                tree[node] = m

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            nxt = after[gone]
            ids[at], after[at], live[gone] = rank, nxt, 0
            put(gone, none)
            r = pair.get((rank << 20) | ids[nxt]) if nxt < n else None
            put(at, none if r is None else r * leaves + at)
            if nxt < n:
                before[nxt] = at
            p = before[at]
            if p >= 0:
                r = pair.get((ids[p] << 20) | rank)
                put(p, none if r is None else r * leaves + p)
        return np.array(ids, "<u4")[np.frombuffer(live, np.uint8).astype(bool)].tobytes()

    # texts --------------------------------------------------------------

    def _learn(self, pieces) -> None:
        """Put all of ``pieces`` into the memo."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, whole, short = self.memo, self.whole, []
        for p in set(pieces).difference(memo):
            b = p.encode()
            if b in whole:
                memo[p] = whole[b].to_bytes(4, "little")
            elif len(b) <= SHORT:
                short.append(b)
            else:
                memo[p] = self.encode_long(b)
        short.sort(key=len)
        for i in range(0, len(short), GROUP):
            part = short[i:i + GROUP]
            memo.update(zip(map(bytes.decode, part), self.encode_group(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        out, chunk, size = [], [], 0

        def flush():
            split = [self.pattern.findall(t) for t in chunk]
            self._learn(chain.from_iterable(split))
            out.extend(b"".join(map(self.memo.__getitem__, s)) for s in split)

        for t in texts:
            if len(t) > CHUNK:  # a very long text goes in runs of pieces
                if chunk:
                    flush()
                    chunk, size = [], 0
                found, parts = self.pattern.finditer(t), []
                while run := [m[0] for m in islice(found, 100_000)]:
                    self._learn(run)
                    parts.append(b"".join(map(self.memo.__getitem__, run)))
                out.append(b"".join(parts))
                continue
            chunk.append(t)
            size += len(t)
            if size > CHUNK:
                flush()
                chunk, size = [], 0
        if chunk:
            flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, Vocabulary] = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """The tables of a rank file, made once a worker."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Vocabulary(data, pattern)
    return _made[key]


def default_files(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The bytes of the rank file and the pattern, read by the driver (a file
    of about 1 MB, sent to the workers with the job)."""
    import public_tokenizers as tokenizers

    with open(path or tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or tokenizers.PATTERN


def with_ids(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with column ``ids``: the token ids as little-endian unsigned
    32-bit integers, one binary a text."""
    files = docs.sparkSession.sparkContext.broadcast(default_files(path, pattern))

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary(*files.value).encode([t or "" for t in texts]), dtype=object)

    return docs.withColumn(ids, encode(F.col(text)))


def with_text(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with column ``out``: the decoded bytes (binary) of ``ids``."""
    files = df.sparkSession.sparkContext.broadcast(default_files(path, pattern))

    @F.pandas_udf("binary")
    def decode(found: pd.Series) -> pd.Series:
        v = vocabulary(*files.value)
        return pd.Series([v.decode(b or b"") for b in found], dtype=object)

    return df.withColumn(out, decode(F.col(ids)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded bytes."""
    d = with_text(with_ids(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return d.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(docs: DataFrame) -> DataFrame:
    return digests(docs)
