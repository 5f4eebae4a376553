"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

1. ``rebuilt_paths`` makes one path of each conversation: for every turn the
   128-bit identity of the whole sequence up to and including it (SHA-256 of
   the identity before and the turn, cut to 16 bytes) and the number of words
   of its text. Texts go no further. Equal paths are grouped first, so a
   conversation that many others repeat is one path with a weight.
2. Paths are sorted over range partitions, so that those with a common prefix
   are neighbours; the longest common prefix (LCP) of two neighbours is an
   edge. ``forest`` takes a run of sorted neighbours and merges them, edge by
   edge in descending depth, by union-find: a merge of two components at
   depth d makes, or widens, the branching node of depth d. Everything between
   a component's top and the depth where it is merged is a chain of nodes with
   the same members. All nodes but those on the first and the last path of
   the run are then complete.
3. Those two paths remain of a run, contracted: whatever hangs on them stands
   as sums at its depth. They are sorted and merged in the same way, until
   one run holds all of them and the root is complete.

A run is bounded by ``MOST`` rows and ``BYTES`` bytes, whatever the partitions
hold, and each round leaves two paths a run, so rounds are few. Nodes whose
parent lay on an open path get its ``conv_id`` by an equi-join at the end.

The digest of the conversations that end at a node needs their ids in order:
ids are joined to text in slices of ``SLICE`` ids, and one pass over the
sorted slices feeds them to SHA-256 piece by piece, with no group in memory.

Defined results: a null role or text is empty; rows without ``conv_id``
belong to no conversation; turns are ordered by ``turn``, null first, then by
the digest of role and text; repeated rows are turns of their own;
``c % 20`` has the sign of ``c``, as in SQL; no conversation, no node.
The turns of one conversation must fit a task, at 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import CRC32_CTE, crc32_sql, cut, drop, word_count

#: Bytes of an identity.
WIDTH = 16
#: Rows and bytes of paths that are merged at once; a run has LEAST rows, however long they are.
MOST, BYTES, LEAST = 20_000, 32 << 20, 16
#: Ids in a slice of the text that is digested.
SLICE = 4096
#: No member yet.
NONE = 2 ** 63 - 1
EMPTY = hashlib.sha256(b"").hexdigest()

#: Sums that stand at a node of an open path: members, smallest member,
#: children, leaves below, tokens saved below, digest of the ends.
HUNG = ["at", "members", "least", "kids", "leaves", "saved", "ends"]
PATH = ("key binary, size long, words array<long>, at array<long>, members array<long>, least array<long>, "
        "kids array<long>, leaves array<long>, saved array<long>, ends array<string>")
NODE = ("node binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and ``turns``: an array of (digest of role and text, words) in
    the order of the rebuilt conversation."""
    c = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    t = c.select("conv_id", F.struct("turn", F.unhex(F.sha2(said, 256)).alias("digest"), word_count(F.col("text")).alias("words")).alias("t"))
    own = cut(t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "turns")
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    d = own.withColumn("base", F.expr("conv_id - conv_id % 20")).join(heads, "base", "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(dict(own.dtypes)["own"]))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return d.select("conv_id", F.transform(F.concat(head, rest), lambda t: F.struct(t["digest"], t["words"])).alias("turns"))


def _paths(batches):
    for b in batches:
        keys, words = [], []
        for turns in b["turns"]:
            last, key = b"", []
            for t in turns:
                last = hashlib.sha256(last + t["digest"]).digest()[:WIDTH]
                key.append(last)
            keys.append(b"".join(key))
            words.append([t["words"] for t in turns])
        yield pd.DataFrame({"conv_id": b["conv_id"], "key": keys, "words": words})


def _digests(batches):
    """One row per group of slices that follow each other: the digest of the
    slices, comma-joined. The state goes on over the batches of a task."""
    last, state = None, None
    for b in batches:
        out = []
        for key, piece in zip(b["last"], b["piece"]):
            if state is None or key != last:
                if state is not None:
                    out.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pd.DataFrame(out, columns=["last", "ends"])
    if state is not None:
        yield pd.DataFrame([(last, state.hexdigest())], columns=["last", "ends"])


def grouped_paths(conversations: DataFrame) -> DataFrame:
    """Distinct paths (``PATH``): each one's members stand at its end."""
    p = cut(rebuilt(conversations).mapInPandas(_paths, "conv_id long, key binary, words array<long>"), "paths")
    # the last identity names the whole path; the root's path has none
    p = p.withColumn("last", F.substring("key", F.greatest(F.octet_length("key") - WIDTH + 1, F.lit(1)), F.lit(WIDTH)))
    slices = (p.groupBy("last", F.floor(F.col("conv_id") / SLICE).alias("slice"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("piece")))
    ends = (slices.repartition("last").sortWithinPartitions("last", "slice").select("last", "piece")
            .mapInPandas(_digests, "last binary, ends string"))
    one = (p.groupBy("last").agg(F.any_value("key").alias("key"), F.any_value("words").alias("words"),
                                 F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least")).join(ends, "last"))
    size = F.floor(F.octet_length("key") / WIDTH).cast("long")
    none = F.array(F.lit(0).cast("long"))
    return one.select("key", size.alias("size"), "words", F.array(size).alias("at"), F.array("members").alias("members"),
                      F.array("least").alias("least"), none.alias("kids"), none.alias("leaves"), none.alias("saved"),
                      F.array("ends").alias("ends"))


class _Run:
    """The forest of a run of sorted paths. A component is the root of a
    union-find tree; ``hung[c]`` maps depths to what hangs on its path there
    (``HUNG`` without the depth), ``top[c]`` is the depth of its top node."""

    def __init__(self, rows: list[tuple], whole: bool):
        self.rows, self.whole, self.nodes = rows, whole, []
        m = len(rows)
        self.up = list(range(m))
        self.top = [r[1] for r in rows]
        self.hung = [{a: [list(x), []] for a, *x in zip(*r[3:])} for r in rows]
        self.open = [False] * m
        if not whole:
            self.open[0] = self.open[-1] = True
        #: what hangs on the last path alone, below where it leaves the first
        self.tail: dict | None = None

    def find(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def lcp(self, i: int) -> int:
        a, b = self.rows[i][0], self.rows[i + 1][0]
        n = min(len(a), len(b)) // WIDTH
        x = np.frombuffer(a, "V16", n) != np.frombuffer(b, "V16", n)
        return int(x.argmax()) if x.any() else n

    def at(self, c: int, depth: int) -> list:
        return self.hung[c].setdefault(depth, [[0, NONE, 0, 0, 0, None], []])

    def climb(self, c: int, depth: int) -> None:
        """Complete the nodes of a closed component above ``depth``."""
        if self.open[c]:
            return
        key, _, words = self.rows[c][:3]
        for d in range(self.top[c], depth, -1):
            (members, least, kids, leaves, saved, ends), below = self.hung[c].pop(d)
            if d:
                saved += (members - 1) * int(words[d - 1])
            leaves = leaves if kids else 1
            for k in below:
                self.nodes[k][1], self.nodes[k][4] = None, least
            up = key[WIDTH * (d - 2):WIDTH * (d - 1)] if d > 1 else b"" if d else None
            k = len(self.nodes)
            self.nodes.append([key[WIDTH * (d - 1):WIDTH * d] if d else b"", up, least, d, None, members, kids, leaves, saved, ends or EMPTY])
            if d:
                (h, below) = self.at(c, d - 1)
                h[0] += members
                h[1] = min(h[1], least)
                h[2] += 1
                h[3] += leaves
                h[4] += saved
                below.append(k)
        self.top[c] = min(self.top[c], depth)

    def merge(self, a: int, b: int, depth: int) -> None:
        """Join component ``b``, right of ``a``, to it at ``depth``."""
        self.climb(a, depth)
        self.climb(b, depth)
        if self.open[a] and self.open[b]:
            self.tail = {d: x for d, x in self.hung[b].items() if d > depth}
            self.hung[b] = {d: x for d, x in self.hung[b].items() if d <= depth}
        # the path of an open component is the one that goes on; else the smaller goes to the larger
        keep, gone = (a, b) if self.open[a] or not self.open[b] and len(self.hung[a]) >= len(self.hung[b]) else (b, a)
        for d, (x, below) in self.hung[gone].items():
            h, others = self.at(keep, d)
            for k in (0, 2, 3, 4):
                h[k] += x[k]
            h[1] = min(h[1], x[1])
            h[5] = h[5] or x[5]
            others += below
        self.hung[gone] = {}
        self.up[gone] = keep
        self.top[keep] = depth

    def run(self) -> None:
        m = len(self.rows)
        edges = [self.lcp(i) for i in range(m - 1)]
        for i in np.argsort(-np.array(edges, int), kind="stable"):
            self.merge(self.find(i), self.find(i + 1), edges[i])
        if self.whole:
            self.climb(self.find(0), -1)

    def left(self) -> list[tuple]:
        """The first and the last path, with what hangs on them."""
        if self.whole:
            return []
        m = len(self.rows)
        first = self.find(0)
        hung = [self.hung[first]] + ([self.tail] if m > 1 else [])
        out = []
        for r, h in zip([self.rows[0], self.rows[-1]], hung):
            at = sorted(h)
            out.append((*r[:3], at, *([h[d][0][k] for d in at] for k in range(6))))
        return out


def forest(rows: list[tuple], whole: bool) -> tuple[list, list]:
    """Complete nodes (``NODE``) of a run of sorted paths, and the paths that
    are left of it (``PATH``): none if the run is the ``whole``."""
    f = _Run(rows, whole)
    f.run()
    return f.nodes, f.left()


NODES, LEFT = ([x.split()[0] for x in ddl.split(", ")] for ddl in (NODE, PATH))
ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
BOTH = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in f"{NODE}, {PATH}".split(", "))])


def _merging(most: int, size: int, whole: bool):
    def done(rows):
        nodes, left = forest(rows, whole)
        for k in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_pylist([dict(zip(NODES, n)) for n in nodes[k:k + 50_000]], schema=BOTH)
        if left:
            yield pa.RecordBatch.from_pylist([dict(zip(LEFT, p)) for p in left], schema=BOTH)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(r)
                held += len(r[0]) + 64
                if not whole and (len(rows) >= most or held >= size and len(rows) >= LEAST):
                    yield from done(rows)
                    rows, held = [], 0
        if rows:
            yield from done(rows)
    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def trie(conversations: DataFrame, most: int = MOST, size: int = BYTES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations. ``most`` and
    ``size`` bound the rows and the bytes of a run."""
    left = cut(grouped_paths(conversations), "grouped")
    found, known = [], []
    while True:
        rows, held = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
        whole = rows <= most and held <= size or rows <= LEAST
        if whole:
            ordered = left.coalesce(1)
        elif not found:
            ordered = left.repartitionByRange("key")
        else:  # fewer partitions, so that each has many of the paths that are left
            ordered = left.repartitionByRange(max(1, min(-(-max(rows * size, held * most) // (most * size)), rows // LEAST)), "key")
        both = cut(ordered.sortWithinPartitions("key").mapInArrow(_merging(most, size, whole), f"{NODE}, {PATH}"), "forest")
        nodes = both.filter("conv_id IS NOT NULL").select(*NODES)
        if found:  # these may have been open when their children were complete
            known.append(nodes.select("node", F.col("conv_id").alias("above")))
        found.append(nodes)
        last, left = left, None if whole else cut(both.filter("conv_id IS NULL").select(*LEFT), "left")
        drop(last)
        if whole:
            break
    out = _union(found)
    if known:
        out = (out.join(_union(known).withColumnRenamed("node", "up"), "up", "left")
               .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")))
    return out.select(*OUT)


def query(conversations: DataFrame) -> DataFrame:
    return trie(conversations)


def oracle() -> str:
    return rf"""
WITH {CRC32_CTE},
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, s, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS k
  FROM (SELECT conv_id, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS s,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM said)),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said), crc),
heads AS (SELECT c.conv_id, t.k, t.s, t.w FROM convs c JOIN turns t ON t.conv_id = c.base AND t.k <= c.h),
n_heads AS (SELECT c.conv_id, c.h, count(h.k) AS n FROM convs c LEFT JOIN heads h USING (conv_id) GROUP BY ALL),
paths AS (SELECT * FROM heads UNION ALL
  SELECT t.conv_id, n + t.k - h AS k, t.s, t.w FROM turns t JOIN n_heads USING (conv_id) WHERE t.k > h),
steps AS (SELECT conv_id, k AS depth, w, sha256(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY k)) AS node FROM paths
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends FROM steps),
nodes AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, count(*) AS n_convs,
  (count(*) - 1) * any_value(w) AS own, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM linked GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
subtree AS (SELECT a.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(n.own) AS saved
  FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN steps a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN subtree s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.up
"""
