"""Links between points by tiles of blocks: what is written is a forest of each tile, whatever the number of close pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionfx.operators.sampling import numbered
from regionfx.storage import discard, materialize

#: Points of a block, blocks of a tile's other side, and points that are compared at once.
BLOCK, BLOCKS, STRIP = 4096, 8, 1024
#: Blocks that a block meets on average up to which all are compared at once; blocks of open points that are compared with all others at once.
MET, FEW = 8, 4


def close(a: np.ndarray, b: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of a and b within eps.

    Distances come from a product first; those that rounding leaves open are summed term by term.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        over = a @ (-2 * b.T)
        over += (na - eps * eps)[:, None]
        over += nb
        slack = 1e-9 * (na.max(initial=0) + nb.max(initial=0) + eps * eps)
        i, j = np.nonzero(over <= (slack if np.isfinite(slack) else 1e-9 * (na[:, None] + nb + eps * eps)))
        over, slack = over[i, j], 1e-9 * (na[i] + nb[j] + eps * eps)
        inside = over <= slack
        i, j, over, slack = i[inside], j[inside], over[inside], slack[inside]
        open_ = np.flatnonzero(over >= -slack)
        total = np.zeros(len(open_))
        for c in range(a.shape[1]):
            total += (a[i[open_], c] - b[j[open_], c]) ** 2
    keep = np.ones(len(i), dtype=bool)
    keep[open_] = total <= eps * eps
    return i[keep], j[keep]


def hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (least places) after the links i - j."""
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _tile(eps: float, far: float):
    def ends(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(d)
        lo, hi = np.where(known, d, np.inf).min(axis=0), np.where(known, d, -np.inf).max(axis=0)
        none = lo > hi  # vectors of another length than the pivots': nothing is ruled out
        return np.where(none, -np.inf, lo), np.where(none, np.inf, hi)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"k": left["k"][:0], "k2": left["k"][:0]})
        (a, da), (b, db) = [(np.stack(x["v"].to_numpy()), np.stack(x["d"].to_numpy())) for x in (left, right)]
        root = np.arange(len(a) + len(b))
        strips = [(slice(s, s + STRIP), *ends(db[s : s + STRIP])) for s in range(0, len(b), STRIP)]
        for s in range(0, len(a), STRIP):
            lo, hi = ends(da[s : s + STRIP])
            for own, lo2, hi2 in strips:
                if ((lo - far <= hi2) & (lo2 - far <= hi)).all():
                    i, j = close(a[s : s + STRIP], b[own], eps)
                    root = hook(root, i + s, j + len(a) + own.start)
        keys = np.concatenate([left["k"].to_numpy(), right["k"].to_numpy()])
        tied = np.flatnonzero(root != np.arange(len(root)))
        out = pd.DataFrame({"k": keys[root[tied]], "k2": keys[tied]})
        return out[out["k"] != out["k2"]].drop_duplicates()

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that can be reached, of all nodes that edges name; nodes must be comparable.

    Each round hooks every root to its least neighbour, follows hooks to their ends by pointer jumping, and contracts the edges to
    roots; the rounds grow with the logarithm of a component's size, not with the length of its paths.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = materialize(both.where("x <> y").union(both.where("x <> y").select("y", "x")).distinct(), "links")
    roots = materialize(both.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        hooks = materialize(links.groupBy("x").agg(F.min("y").alias("to")).where("to < x"), "hooks")
        while True:
            ends = hooks.select(F.col("x").alias("_x"), F.col("to").alias("_to"))
            jumped = materialize(hooks.join(ends, F.col("to") == F.col("_x"), "left").select("x", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            discard(hooks)
            hooks = jumped.select("x", "to")
            if not moved:
                break
        end = lambda df, c: df.join(hooks.select(F.col("x").alias("_x"), F.col("to").alias("_to")), F.col(c) == F.col("_x"), "left").withColumn(c, F.coalesce("_to", c)).drop("_x", "_to")  # noqa: B023, E731
        new_roots = materialize(end(roots, "root"), "roots")
        new_links = materialize(end(end(links, "x"), "y").where("x <> y").distinct(), "links")
        discard(roots, links, hooks)
        roots, links = new_roots, new_links
    discard(links)
    return roots.select("node", F.col("root").alias("component"))


def _bounds(x: DataFrame, n_pivots: int) -> DataFrame:
    known = lambda i: F.when(~F.isnan(F.col("d")[i]), F.col("d")[i])
    return x.groupBy("dim", "block").agg(F.count("*").alias("n"), *[f(known(i)).alias(f"{n}{i}") for i in range(n_pivots) for n, f in (("lo", F.min), ("hi", F.max))])


def _meeting(a: DataFrame, b: DataFrame, n_pivots: int, far: float, more: Column) -> DataFrame:
    """(dim, own, other) of blocks of two tables of bounds that can have points within reach and fulfil a condition on a.block and b.block."""
    a, b = a.alias("a"), b.alias("b")
    on = (F.col("a.dim") == F.col("b.dim")) & more
    for i in range(n_pivots):  # blocks without a known distance meet all others
        on &= F.coalesce((F.col(f"a.lo{i}") - far <= F.col(f"b.hi{i}")) & (F.col(f"b.lo{i}") - far <= F.col(f"a.hi{i}")), F.lit(True))
    return materialize(a.join(b, on).select("a.dim", F.col("a.block").alias("own"), F.col("b.block").alias("other")), "met")


def _compared(a: DataFrame, b: DataFrame, met: DataFrame, eps: float, far: float, wide: int = 1) -> DataFrame:
    """(k, k2): forests of the links between blocks that meet, in tiles of one block of ``a`` and up to ``wide`` of ``b``."""
    met = met.withColumn("group", F.floor(F.col("other") / wide))
    tile, kind = ["dim", "own", "group"], a.schema["k"].dataType.simpleString()
    left = a.withColumnRenamed("block", "own").join(met.select("dim", "own", "group").distinct(), ["dim", "own"]).select(*tile, "k", "v", "d")
    right = b.withColumnRenamed("block", "other").join(met, ["dim", "other"]).select(*tile, "k", "v", "d")
    left, right = (side.toDF(*side.columns).groupBy(*tile) for side in (left, right))  # both may come from the same table
    return left.cogroup(right).applyInPandas(_tile(eps, far), f"k {kind}, k2 {kind}")


def _without(x: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    return x.join(keys.select(F.col("k").alias("_k")), F.col("k") == F.col("_k"), how)


def tied_points(points: DataFrame, eps: float, pivots: list[list[float]], n_cells: int = 3) -> DataFrame:
    """(k, k2) of points (k, v) that make the same clusters as all pairs within eps: for each tile a forest of its links.

    Points are ordered by cells of their distances to the pivots and cut into blocks.  Two blocks meet if these
    distances allow it, as do their strips inside a tile.  A tile has at most BLOCK points on one side and BLOCKS times as many on the other, so
    neither a task's memory nor what it returns grows with the number of points or of close pairs.

    Where a block meets more than MET others on average, pairs inside one cluster are left out: blocks are compared with themselves and the next one
    first, and the largest cluster found so is closed.  Open points, the rest, are compared with all blocks.  While they are more than FEW
    blocks, they are first compared with some blocks of all, twice as many each time, which closes more of them; that ends at a 16th of the blocks if
    they don't halve.  A pair within eps is inside the closed cluster, or one of the two is open to the end and meets the
    other.  Points that make no large cluster stay open, and all their pairs are compared.
    """
    far, n_pivots = eps * (1 + 1e-9) + 1e-9, len(pivots)
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with("v", F.lit(p), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    x = points.select("k", "v", F.size("v").alias("dim"), F.array(*[F.coalesce(gap(p), F.lit(float("nan"))) for p in pivots]).cast("array<double>").alias("d"))
    cells = F.transform(F.slice("d", 1, n_cells), lambda c: F.floor(c / (2 * far)))
    x = x.withColumn("_o", F.struct(cells.alias("c"), "d", "k"))

    def blocks(rows: DataFrame) -> DataFrame:
        rows = numbered(rows, "_o", "_n", ["dim"])
        return materialize(rows.withColumn("block", F.floor((F.col("_n") - 1) / BLOCK)).drop("_n"), "blocks")

    x = blocks(x)
    bounds = materialize(_bounds(x, n_pivots), "bounds")
    own, other = F.col("a.block"), F.col("b.block")
    n_blocks, met = bounds.count(), _meeting(bounds, bounds, n_pivots, far, own <= other)
    if met.count() <= MET * n_blocks:
        return _compared(x, x, met, eps, far, BLOCKS)
    links = materialize(_compared(x, x, met.where("other - own <= 1"), eps, far), "links")
    closed, n_open, some = None, points.count(), 8
    while True:
        found = components(links, "k", "k2")
        if closed is None:
            closed = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", "component")).alias("c")).first()["c"]
        else:  # the same cluster again, as pairs inside it were left out
            closed = found.where(F.col("node") == F.lit(closed)).first()["component"]
        inside = materialize(found.where(F.col("component") == F.lit(closed)).select(F.col("node").alias("k")), "closed") if closed is not None else points.select("k").limit(0)
        rest = blocks(_without(x, inside).drop("block"))
        links = found.where("node <> component").select(F.col("component").alias("k"), F.col("node").alias("k2"))
        before, n_open = n_open, rest.count()
        ends = materialize(_bounds(rest, n_pivots), "bounds")
        if n_open <= FEW * BLOCK or some > n_blocks // (2 if 2 * n_open <= before else 16):
            wide = 1 if n_open <= FEW * BLOCK else BLOCKS
            among = _compared(rest, rest, _meeting(ends, ends, n_pivots, far, own <= other), eps, far, wide)
            across = _compared(rest, _without(x, inside, "left_semi"), _meeting(ends, bounds, n_pivots, far, F.lit(True)), eps, far, wide)
            return links.unionByName(among).unionByName(across)
        chosen = other % F.lit(n_blocks // some) == 0
        links = materialize(links.unionByName(_compared(rest, x, _meeting(ends, bounds, n_pivots, far, chosen), eps, far)), "links")
        some *= 2
