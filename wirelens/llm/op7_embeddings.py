"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label (and length) are compared in tiles. The covariance of
all vectors, summed by Spark, gives a rotation that orders the dimensions by
variance. Tiles follow the first principal coordinate, and a pair of tiles
further apart than the threshold allows is never formed. In a pair of
tiles, inner products are accumulated over blocks of leading dimensions; the
rest of a product is bounded by the norms of the two suffixes, and a pair of
vectors is dropped as soon as its cosine cannot reach the threshold. What
survives is decided by the cosine of the vectors as given, in double
precision.

Equal vectors of a label are one class with a size. A pair of tiles returns,
per class, the number of linked vectors and the smallest id reachable inside
the pair: one row a class, however many links there are.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components, and one with a null label or id, links with nothing
and is its own component; vectors of different lengths don't link; rows that
repeat an id are vectors of their own that reach each other by the id's
other rows' links; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm.common import components, cut

THRESHOLD, TILE = 0.93, 1024
#: Cells of the first coordinate per unit; rows compared at once in a tile.
CELLS, STRIP = 32, 256
#: Leading dimensions after which products are bounded.
STEPS = (8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, by falling variance) of the unit vectors."""
    def sums(batches):
        total = np.zeros((dim + 1, dim))
        n = 0
        for pdf in batches:
            if len(pdf):
                x = _unit(_matrix(pdf["vec"]))
                total[:dim] += x.T @ x
                total[dim] += x.sum(0)
                n += len(x)
        yield pd.DataFrame({"k": np.arange(dim * (dim + 1) + 1), "v": np.append(total.ravel(), float(n))})

    got = (classes.filter(F.col("dim") == dim).select("vec").mapInPandas(sums, "k long, v double")
           .groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy())  # dim * dim numbers
    n, mean = max(got[-1], 1.0), got[dim * dim:-1] / max(got[-1], 1.0)
    values, axes = np.linalg.eigh(got[:dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows whose cosine reaches the threshold."""
    dim = a.shape[1]
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (a, b))  # squares stay in range
    ua, ub = _unit(a) @ axes, _unit(b) @ axes
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    steps = [s for s in STEPS if s < dim] + [dim]
    rest = lambda u: [np.sqrt(np.maximum((u[:, s:] ** 2).sum(1), 0.0)) for s in steps]
    ra, rb = rest(ua), rest(ub)
    least = threshold - 1e-9
    out = np.zeros((len(a), len(b)), bool)
    for lo in range(0, len(a), STRIP):
        rows = slice(lo, min(lo + STRIP, len(a)))
        part = np.zeros((rows.stop - lo, len(b)))
        pairs = None
        for k, s in enumerate(steps):
            start = steps[k - 1] if k else 0
            if pairs is None:
                part += ua[rows, start:s] @ ub[:, start:s].T
                alive = part + ra[k][rows, None] * rb[k][None, :] >= least
                if alive.mean() < 0.1:
                    i, j = np.nonzero(alive)
                    pairs, part = (i + lo, j), part[i, j]
            else:
                i, j = pairs
                part = part + np.einsum("ij,ij->i", ua[i, start:s], ub[j, start:s])
                alive = part + ra[k][i] * rb[k][j] >= least
                pairs, part = (i[alive], j[alive]), part[alive]
        if pairs is None:
            i, j = np.nonzero(alive)
            pairs = i + lo, j
        i, j = pairs
        for at in range(0, len(i), 1 << 16):
            x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
    return out


def reached(adjacent: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches inside the matrix."""
    top = np.iinfo(np.int64).max
    left, right = left.copy(), right.copy()
    while True:
        to_right = np.minimum(right, np.where(adjacent, left[:, None], top).min(0))
        to_left = np.minimum(left, np.where(adjacent, to_right[None, :], top).min(1))
        if (to_right == right).all() and (to_left == left).all():
            return left, right
        left, right = to_left, to_right


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row a vector of ``vectors`` (vec_id, embedding, label): vec_id,
    n_links, component_id, kept."""
    fine = ((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    v = vectors.select("vec_id", "label", F.col("embedding").alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"),
                       F.xxhash64("embedding").alias("vh"))
    classes = cut(v.filter("fine").groupBy("label", F.size("vec").alias("dim"), "vec", "vh")
                  .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "vector-classes")
    common = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 1
    # the most frequent length has principal axes; others keep their own order of dimensions
    axes = classes.sparkSession.sparkContext.broadcast(rotation(classes, dim) if common else np.eye(1))

    @F.pandas_udf("long")
    def cell(vecs: pd.Series) -> pd.Series:
        axis = axes.value[:, 0]
        out = []
        for x in vecs:
            x = np.asarray(x, np.float64)
            x = x / np.abs(x).max()
            out.append(int(np.floor((x @ axis if len(x) == dim else x[0]) / np.sqrt(x @ x) * CELLS)))
        return pd.Series(out)

    placed = cut(classes.withColumn("cell", cell("vec")), "vector-cells")
    # neighbouring cells make tiles of about ``tile`` classes; a fuller tile is split by hash
    upto = Window.partitionBy("label", "dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    size = (placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("tile", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / tile)))
    whole = Window.partitionBy("label", "dim", "tile")
    size = cut(size.withColumn("parts", F.ceil(F.sum("n").over(whole) / (2 * tile)))
               .withColumn("low", F.min("cell").over(whole)).withColumn("high", F.max("cell").over(whole)), "vector-tiles")
    placed = (placed.join(size.select("label", "dim", "cell", "tile", "parts"), ["label", "dim", "cell"])
              .withColumn("part", F.pmod(F.xxhash64("rep", "vh"), F.col("parts"))))
    tiles = (size.select("label", "dim", "tile", "parts", "low", "high").distinct()
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    a = tiles.select("label", "dim", F.col("tile").alias("ac"), F.col("part").alias("ap"), F.col("high").alias("to"))
    b = tiles.select("label", "dim", F.col("tile").alias("bc"), F.col("part").alias("bp"), F.col("low").alias("from"))
    # unit vectors of cosine t differ by at most sqrt(2 - 2t) in a coordinate
    reach = int(np.floor(np.sqrt(max(0.0, 2 - 2 * threshold)) * CELLS)) + 1
    pairs = (a.join(b, ["label", "dim"]).filter((F.struct("ac", "ap") <= F.struct("bc", "bp")) & (F.col("from") - F.col("to") <= reach))
             .drop("from", "to"))
    rows = ["label", "dim", "ac", "ap", "bc", "bp"]

    def side(s, tile_no, part):
        own = placed.select("label", "dim", F.col("tile").alias(tile_no), F.col("part").alias(part), "rep", "vh", "m", "vec")
        return own.join(pairs, ["label", "dim", tile_no, part]).select(*rows, F.lit(s).alias("side"), "rep", "vh", "m", "vec")

    met = side(0, "ac", "ap").union(side(1, "bc", "bp").filter("ac <> bc OR ap <> bp"))

    def compare(key, pdf):
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = len(right) == 0 and key[2:4] == key[4:6]
        right = left if same else right
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "vh": [], "n": [], "low": []})
        x = _matrix(left["vec"])
        y = x if same else _matrix(right["vec"])
        turn = axes.value if x.shape[1] == dim else np.eye(x.shape[1])
        adjacent = linked(x, y, turn, threshold)
        if same:
            np.fill_diagonal(adjacent, False)
        ids, others = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
        low, other_low = reached(adjacent, ids, others)
        n, other_n = adjacent @ right["m"].to_numpy(np.int64), left["m"].to_numpy(np.int64) @ adjacent
        out = [pd.DataFrame({"rep": ids, "vh": left["vh"].to_numpy(), "n": n, "low": low})]
        if not same:
            out.append(pd.DataFrame({"rep": others, "vh": right["vh"].to_numpy(), "n": other_n, "low": other_low}))
        out = pd.concat(out)
        return out[out["n"] > 0]

    found = cut(met.groupBy(*rows).applyInPandas(compare, "rep long, vh long, n long, low long"), "vector-links")
    counts = found.groupBy("rep", "vh").agg(F.sum("n").alias("n"))
    # an id's rows may be of several classes; its classes are joined by the id
    ids = v.filter("fine").select("vec_id", "label", "vh", F.col("vec").alias("vec"))
    member = ids.join(classes.select("label", "vec", "vh", "rep", "m"), ["label", "vec", "vh"]).select("vec_id", "vh", "rep", "m")
    edges = (found.select(F.col("rep").alias("a"), F.col("low").alias("b"))
             .union(member.filter("vec_id <> rep").select("vec_id", "rep")))
    comp = components(edges)
    linked_rows = (member.join(counts, ["rep", "vh"], "left").join(comp, F.col("vec_id") == F.col("id"), "left")
                   .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"),
                           F.coalesce("component", "vec_id").alias("component_id")))
    alone = v.filter("NOT fine").join(comp, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(vectors: DataFrame) -> DataFrame:
    return vector_links(vectors)
