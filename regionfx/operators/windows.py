"""Neighbourhoods, ranks, runs and block statistics of series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from regionfx.operators.aggregates import shared_out
from regionfx.operators.sampling import numbered, running_sums, with_group
from regionfx.storage import materialize


def neighbour_window(df: DataFrame, region: str, pos: str, f: str, size: int, k: int = 3, out: str = "window", block: int = 4096) -> DataFrame:
    """Feature arrays at offsets -k..+k joined, zeros outside the region.  Positions of a region follow each other without gaps.

    A region is cut into blocks of positions, each with the k rows beyond its ends, so that a long region isn't one task.
    """
    at = lambda p: F.floor(p / block)
    parts = F.array_distinct(F.array(at(F.col(pos) - k), at(F.col(pos)), at(F.col(pos) + k)))
    rows = df.select("*", F.explode(parts).alias("_block"))
    w = Window.partitionBy(region, "_block").orderBy(pos)
    zeros = F.array_repeat(F.lit(0).cast("float"), size)
    near = [F.coalesce(F.lag(f, -o).over(w), zeros) if o < 0 else (F.coalesce(F.lead(f, o).over(w), zeros) if o > 0 else F.col(f)) for o in range(-k, k + 1)]
    return rows.withColumn(out, F.concat(*near)).where(F.col("_block") == at(F.col(pos))).drop("_block")


def normalise_by_mean(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Value over its group's mean (null for a mean of 0); null keys are a group; the means are grouped and joined, so a hot group isn't sorted in one task."""
    means = df.groupBy(key).agg(F.avg(col).alias("_m"))
    return with_group(df, means, key).withColumn(out, F.try_divide(F.col(col), F.col("_m"))).drop("_m")


def zscore(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """(x - mean) / population std per group; null values are ignored, a group without spread gives null; null keys are a group."""
    s = df.groupBy(key).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    return with_group(df, s, key).withColumn(out, (F.col(col) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def avg_rank(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, value, n, rank): average ranks from the table of distinct values; nulls are left out."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, keys, "value", {"_below": "n"}).withColumn("rank", F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).drop("_below")


def aligned_segments(df: DataFrame, key: str, a: str, b: str, gap: str = "-", min_len: int = 5) -> DataFrame:
    """(key, a_start, a_end, b_start, b_end): runs where both aligned strings have letters, in places (from 1) of the letters of each.

    A key is one row's pair of strings, of which only the runs leave the task that reads it; nothing is shuffled.  Null strings give no rows.
    """
    kind = df.schema[key].dataType
    places = ("a_start", "a_end", "b_start", "b_end")
    schema = StructType([StructField(key, kind), *[StructField(n, LongType()) for n in places]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], [np.zeros((4, 0), dtype=np.int64)]
            for i in range(batch.num_rows):
                x, y = [np.frombuffer(batch.column(c)[i].as_py().encode("utf-32-le"), dtype="<u4") != ord(gap) for c in (1, 2)]
                n = min(len(x), len(y))
                both = np.diff(np.concatenate([[0], (x[:n] & y[:n]).astype(np.int8), [0]]))
                first, last = np.flatnonzero(both == 1), np.flatnonzero(both == -1) - 1
                long = last - first + 1 >= min_len
                first, last = first[long], last[long]
                in_a, in_b = np.cumsum(x), np.cumsum(y)
                found.append(np.stack([in_a[first], in_a[last], in_b[first], in_b[last]]))
                keys.append(np.full(len(first), i))
            at = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c) for c in np.concatenate(found, axis=1)]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *places])

    return df.select(key, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).mapInArrow(run, schema)


def identity_pct(a, b, gap: str = "-"):
    """Percentage of equal letters where both aligned strings have one; null where none do."""
    both = F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda c: (c["x"] != gap) & (c["y"] != gap))
    return F.try_divide(F.size(F.filter(both, lambda c: c["x"] == c["y"])) * 100.0, F.size(both))


def with_index(df: DataFrame, series: str, order: list[str]) -> DataFrame:
    """t from 0 and the series' length n; a long series is numbered in ranges, over many tasks."""
    sizes = df.groupBy(F.col(series).alias("_series")).agg(F.count("*").alias("n"))
    rows = numbered(df.drop("t", "n"), order, "_i", [series])
    return rows.join(sizes, rows[series].eqNullSafe(sizes["_series"])).withColumn("t", F.col("_i") - 1).drop("_i", "_series")


def autocorrelation(df: DataFrame, series: str, max_lag: int) -> DataFrame:
    """(series, lag, r) for lags 0..max_lag of (series, t, x)."""
    s = df.groupBy(series).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("*").alias("n"))
    a = df.select(series, "x", F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"), "t").withColumn("u", F.col("t") + F.col("lag"))
    b = df.select(series, F.col("t").alias("u"), F.col("x").alias("y"))
    r = F.sum((F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))) / (F.first("v") * (F.first("n") - F.col("lag")))
    return a.join(b, [series, "u"]).join(s, series).groupBy(series, "lag").agg(r.alias("r"))


def divisors(n: Column) -> Column:
    """All divisors of n (at least 1) in ascending order, n and 1 among them: those up to its root, and their counterparts."""
    low = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n.cast("double"))).cast("long")), lambda d: n % d == 0)
    return F.array_sort(F.array_union(low, F.transform(low, lambda d: F.floor(n / d).cast("long"))))


def block_squares(df: DataFrame, series: str, cells: int) -> DataFrame:
    """(series, n, blocks, squares): for each number of blocks of a series, 2 and more, the sum over blocks of the squared sum of each cell.

    df: (series, t, n, cell from 0, value), t from 0 to n - 1.  Rows are shuffled once, into ranges of (series, t).  A task adds up a stretch
    of a series for all block lengths by differences at block ends; it gives the squares of the blocks that lie in the stretch,
    and the sums of the at most two that reach beyond it, which are then put together.
    """
    kind = df.schema[series].dataType.simpleString()

    def run(batches):
        sizes = {}
        for batch in batches:
            names, t, cell, value, length = (batch.column(c) for c in (series, "t", "cell", "value", "n"))
            keys, t, length = names.to_pylist(), t.to_numpy(), length.to_numpy()
            cell, value = cell.to_numpy(), value.to_numpy()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            out = {"n": [], "size": [], "block": [], "sums": []}
            own = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = int(length[a])
                if n not in sizes:
                    low = [d for d in range(1, math.isqrt(n) + 1) if n % d == 0]
                    sizes[n] = sorted({*low, *[n // d for d in low]} - {n})
                first, last = int(t[a]), int(t[b - 1])
                for size in sizes[n]:
                    k = first // size
                    count = last // size - k + 1
                    sums = np.bincount((t[a:b] // size - k) * cells + cell[a:b], weights=value[a:b], minlength=count * cells).reshape(count, cells)
                    lo, hi = int(first % size > 0), count - int((last + 1) % size > 0)
                    rows = [(k, sums[0])] * lo + ([(k + count - 1, sums[-1])] if hi < count and (count > 1 or not lo) else [])
                    if hi > lo:
                        rows.append((None, (sums[lo:hi] ** 2).sum(axis=0)))
                    for block, x in rows:
                        own.append(keys[a])
                        out["n"].append(n)
                        out["size"].append(size)
                        out["block"].append(block)
                        out["sums"].append(x.tolist())
            columns = [pa.array(own, names.type), pa.array(out["n"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["sums"], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["series", "n", "size", "block", "sums"])

    rows = df.select(series, F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"), F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value"))
    parts = rows.repartitionByRange(series, "t").sortWithinPartitions(series, "t").mapInArrow(run, f"series {kind}, n long, size long, block long, sums array<double>")
    each = [F.sum(F.get("sums", F.lit(i))) for i in range(cells)]
    # whole blocks are squares already, others are summed to blocks first
    part = parts.groupBy("series", "n", "size", "block").agg(*[e.alias(f"s{i}") for i, e in enumerate(each)])
    square = lambda i: F.when(F.col("block").isNull(), F.col(f"s{i}")).otherwise(F.col(f"s{i}") * F.col(f"s{i}"))
    whole = part.groupBy("series", "n", "size").agg(F.array(*[F.sum(square(i)) for i in range(cells)]).alias("squares"))
    return whole.select(F.col("series").alias(series), "n", (F.col("n") / F.col("size")).cast("long").alias("blocks"), "squares")


def block_average_error(df: DataFrame, series: str) -> DataFrame:
    """(series, blocks, err, err_err) for each divisor of the length from 2 on, of (series, t, n, x).

    Rows are shuffled once, whatever the number of divisors.  A null value counts as the mean of its series; null series are one.
    """
    means = materialize(df.groupBy(series).agg(F.avg("x").alias("_m")), "means")  # of a size that Spark knows, so few series are broadcast
    rows = with_group(df, means, series).select(series, "t", "n", F.lit(0).alias("cell"), F.coalesce(F.col("x") - F.col("_m"), F.lit(0.0)).alias("value"))
    size = F.col("n") / F.col("blocks")
    spread = F.col("squares")[0] / (size * size) / F.col("blocks")  # the mean of the block means is 0
    err = F.sqrt(spread / (F.col("blocks") - 1))
    out = block_squares(rows, series, 1).select(series, "blocks", err.alias("err"))
    return out.withColumn("err_err", F.col("err") / F.sqrt(2.0 * (F.col("blocks") - 1)))


def trim_for_blocking(df: DataFrame, series: str, min_divisors: int = 20, max_trim: int = 101) -> DataFrame:
    """(series, n, trimmed): the longest length from n - 1 down to n - max_trim that has enough divisors; where none has, the last length tried.

    A length that has enough divisors itself stays as it is.  Divisors are counted from 2 on, the length itself among them.  Lengths below 1 aren't tried.
    """
    lengths = df.groupBy(series).agg(F.count("*").alias("n"))
    tries = F.sequence(F.col("n"), F.greatest(F.col("n") - max_trim, F.lit(1)), F.lit(-1).cast("long"))
    good = F.filter(tries, lambda m: F.size(divisors(m)) - 1 >= min_divisors)
    return lengths.withColumn("trimmed", F.coalesce(F.get(good, F.lit(0)), F.element_at(tries, -1)))


def block_sem(errors: DataFrame, series: str) -> DataFrame:
    """(series, blocks, err, n_inside): the block number whose error lies in the intervals of most others with fewer blocks; ties: more blocks."""
    a, b = errors.alias("a"), errors.alias("b")
    on = (F.col(f"a.{series}") == F.col(f"b.{series}")) & (F.col("b.blocks") < F.col("a.blocks")) & (F.abs(F.col("a.err") - F.col("b.err")) <= F.col("b.err_err"))
    inside = a.join(b, on, "left").groupBy(F.col(f"a.{series}").alias(series), F.col("a.blocks").alias("blocks"), F.col("a.err").alias("err")).agg(F.count("b.blocks").alias("n_inside"))
    return inside.groupBy(series).agg(F.max_by(F.struct("blocks", "err", "n_inside"), F.struct("n_inside", "blocks")).alias("_r")).select(series, "_r.blocks", "_r.err", "_r.n_inside")


def block_hist_error(df: DataFrame, series: str, bins: int = 50, kt: float = 2.479, interval: tuple[float, float] | None = None) -> DataFrame:
    """(series, blocks, err, err_err) for each divisor of the length from 2 on, of (series, t, n, x, w).

    A block's histogram is its weights in each bin over its length.  The error of a bin is the standard error over the blocks from
    the whole series' histogram, times kT, over the whole's bin; err is the mean over the bins that aren't empty.  Bins are of equal
    width over ``interval``, or over each series' own range; values outside of it are in none.  Null values and weights are
    in none either; a series without a filled bin gives no row; null series are one.
    """
    from regionfx.operators.aggregates import bin_of

    bounds = df.groupBy(series).agg(*([F.min("x").alias("_lo"), F.max("x").alias("_hi")] if interval is None else [F.lit(float(interval[0])).alias("_lo"), F.lit(float(interval[1])).alias("_hi")]))
    bin_ = bin_of(F.col("x"), F.col("_lo"), F.col("_hi"), bins)
    rows = with_group(df, materialize(bounds, "bounds"), series).select(series, "t", "n", F.coalesce(bin_, F.lit(0)).alias("cell"), F.when(bin_.isNotNull(), F.coalesce("w", F.lit(0.0))).otherwise(0.0).alias("value"))
    whole = rows.groupBy(series).agg(F.array(*[F.sum(F.when(F.col("cell") == i, F.col("value")).otherwise(0.0)) for i in range(bins)]).alias("_whole"))
    found = with_group(block_squares(rows, series, bins), whole, series)
    size, blocks = F.col("n") / F.col("blocks"), F.col("blocks")
    pair = F.filter(F.arrays_zip(F.col("squares").alias("q"), F.transform("_whole", lambda x: x / F.col("n")).alias("u")), lambda b: b["u"] != 0)
    # the histograms of the blocks have the whole's as their mean
    each = F.transform(pair, lambda b: F.sqrt(F.greatest(b["q"] / (size * size) - blocks * b["u"] * b["u"], F.lit(0.0)) / (blocks * (blocks - 1))) * kt / b["u"])
    out = found.withColumn("_e", each).where(F.size("_e") > 0)
    err = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x) / F.size("_e")
    return out.select(series, "blocks", err.alias("err")).withColumn("err_err", F.col("err") / F.sqrt(2.0 * (blocks - 1)))


def free_energy(density: DataFrame, series: str, kt: float, most: float | None = None) -> DataFrame:
    """Adds free_energy = -kT ln(density), shifted to a least value of 0 per series, above ``most`` null."""
    top = density.where("density > 0").groupBy(series).agg(F.max("density").alias("_d"))
    e = -kt * F.ln(F.when(F.col("density") > 0, F.col("density")) / F.col("_d"))
    return with_group(density, top, series).withColumn("free_energy", F.when(e <= most, e) if most is not None else e).drop("_d")


def block_density_error(df: DataFrame, series: str, blocks: int = 5, grid: int = 20, fine: int | None = None) -> DataFrame:
    """(series, x, density, error): mean and standard error over blocks of a density on a shared grid, of (series, t, n, x).

    With ``fine`` each block's values are first shared out to that many places (``shared_out``), so what is shuffled and spread over the grid
    doesn't grow with the rows; a block's density then differs by at most ``binned_error`` from the exact one.  Null values take no part;
    null series are one; a series without spread gives no rows.
    """
    df = df.where(F.col("x").isNotNull())
    stats = df.groupBy(series).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.stddev_samp("x").alias("_sd"), F.count("*").alias("_n"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n") / F.lit(float(blocks)), F.lit(-0.2))).where("_h > 0")
    rows = df.select(series, "x", F.least(F.floor(F.col("t") * blocks / F.col("n")), F.lit(blocks - 1)).alias("block"))
    if fine:
        rows = shared_out(with_group(rows, stats, series), [series, "block"], "x", "_lo", "_hi", fine)
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    rows = with_group(rows, stats, series).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("g") / (grid - 1)
    z = (at - F.col("x")) / F.col("_h")
    density = F.sum(F.col("weight") * F.exp(-0.5 * z * z)) / F.sum("weight") / (F.first("_h") * math.sqrt(2 * math.pi))
    per = rows.groupBy(series, "g", "block").agg(density.alias("d"), F.first(at).alias("x"))
    return per.groupBy(series, "g").agg(F.first("x").alias("x"), F.avg("d").alias("density"), (F.stddev_samp("d") / math.sqrt(blocks)).alias("error")).drop("g")


def mean_with_error(density: DataFrame, series: str) -> DataFrame:
    """(series, mean, mean_error): density-weighted mean of x and its error from the densities' errors."""
    total = F.sum("density")
    return density.groupBy(series).agg((F.sum(F.col("x") * F.col("density")) / total).alias("mean"), (F.sqrt(F.sum(F.pow(F.col("x") * F.col("error"), F.lit(2.0)))) / total).alias("mean_error"))


def boltzmann_weights(df: DataFrame, series: str, bias: str, kt: float, low: float | None = None, up: float | None = None) -> DataFrame:
    """Adds weight = exp((bias - max)/kT), summing to 1 per series; only values in low..up take part; null series are a series."""
    if low is not None or up is not None:
        df = df.where(F.col(bias).between(F.lit(low if low is not None else float("-inf")), F.lit(up if up is not None else float("inf"))))
    top = df.groupBy(series).agg(F.max(bias).alias("_b"))
    raw = with_group(df, top, series).withColumn("_w", F.exp((F.col(bias) - F.col("_b")) / kt))
    return with_group(raw, raw.groupBy(series).agg(F.sum("_w").alias("_t")), series).withColumn("weight", F.col("_w") / F.col("_t")).drop("_b", "_w", "_t")
