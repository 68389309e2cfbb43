"""Grouped summaries: counts, means, histograms, contact and geometry statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def group_mean(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric per key; rows with a null key are left out."""
    return df.na.drop(subset=keys).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n) of all pairs that occur; null categories are left out."""
    return df.na.drop(subset=[row, col]).groupBy(row, col).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, cols: list[str], n: int | None = None) -> DataFrame:
    out = df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)
    return out.limit(n) if n else out


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a stated order, by one aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def conflict_filter(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Without the keys that carry more than one label."""
    bad = df.groupBy(*keys).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo <> _hi").select(*keys)
    return df.join(bad, keys, "left_anti")


def minmax_scale(df: DataFrame, col: str, out: str, negate: bool = False) -> DataFrame:
    """Scaled to 0..1 over the whole table; a table of one value gives 0.  The two bounds are one row."""
    x = -F.col(col) if negate else F.col(col)
    bounds = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.join(F.broadcast(bounds)).withColumn(out, F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)))).drop("_lo", "_hi")


def contact_frequency(df: DataFrame, keys: list[str], kind: str, kinds: dict[str, str], n_frames: DataFrame, on: str) -> DataFrame:
    """Rows per key and channel over the number of frames (one row per ``on``); unknown kinds are dropped."""
    channel = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in kinds.items()])
    counted = df.withColumn("channel", channel).where("channel is not null").groupBy(*keys, "channel").agg(F.count("*").alias("n"))
    return counted.join(n_frames, on).withColumn("frequency", F.col("n") / F.col("n_frames")).drop("n", "n_frames")


def contact_degree(pairs: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """(region, pos, channel, degree): cells above the cutoff in a position's row and column; the diagonal counts twice."""
    ends = pairs.where(F.col("value") > cutoff).select("region", "channel", F.explode(F.array("i", "j")).alias("pos"))
    return ends.groupBy("region", "pos", "channel").agg(F.count("*").alias("degree"))


def zscored_row_col_mean(cells: DataFrame) -> DataFrame:
    """(region, pos, z): mean of a matrix's z-scores over row and column pos, from sums only.

    cells: (region, i, j, value), all cells of square matrices.  Standard deviation over the population.
    """
    whole = cells.groupBy("region").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    ends = cells.select("region", "value", F.explode(F.array(F.struct(F.col("i").alias("pos"), F.lit(0).alias("side")), F.struct(F.col("j").alias("pos"), F.lit(1).alias("side")))).alias("e"))
    means = ends.groupBy("region", "e.pos", "e.side").agg(F.avg("value").alias("m"))
    return means.join(whole, "region").groupBy("region", "pos").agg((F.sum((F.col("m") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))) / 2).alias("z"))


def state_fractions(df: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """Share of each state per key, in fixed columns; missing ones are 0."""
    share = [(F.count(F.when(F.col(state) == s, 1)) / F.count("*")).alias(f"frac_{s}") for s in states]
    return df.groupBy(key).agg(*share)


def bin_of(x: Column, lo: float | Column, hi: float | Column, bins: int) -> Column:
    """Bin 0..bins-1 of equal width; the last one holds its right edge; null outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    k = F.least(F.floor((x - lo) * bins / F.nullif(hi - lo, F.lit(0))).cast("int"), F.lit(bins - 1))
    return F.when((x >= lo) & (x <= hi), F.coalesce(k, F.lit(0)))


def angle_histogram(df: DataFrame, key: str, col: str, bins: int = 12, lo: float = -math.pi, hi: float = math.pi) -> DataFrame:
    """(key, hist): shares of the bins per key; 1/bins where a key has no values."""
    b = bin_of(F.col(col), lo, hi, bins)
    counts = [F.count(F.when(b == i, 1)) for i in range(bins)]
    n = F.count(b)
    return df.groupBy(key).agg(F.array(*[F.when(n == 0, F.lit(1.0 / bins)).otherwise(c / F.nullif(n, F.lit(0))) for c in counts]).alias("hist"))


def mean_std(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def rms_fluctuation(df: DataFrame, entity: str, frame: str, xyz: list[str], reference: str = "mean") -> DataFrame:
    """Root of the mean squared displacement per entity from its mean or its first frame, in one pass of moments."""
    if reference == "mean":
        total = sum((F.var_pop(c) for c in xyz[1:]), F.var_pop(xyz[0]))
        return df.groupBy(entity).agg(F.sqrt(total).alias("rmsf"))
    first = F.min_by(F.struct(*xyz), frame).alias("_r")
    moments = [m for c in xyz for m in (F.avg(c).alias(f"_m_{c}"), F.avg(F.col(c) * F.col(c)).alias(f"_q_{c}"))]
    g = df.groupBy(entity).agg(first, *moments)
    parts = [F.col(f"_q_{c}") - 2 * F.col(f"_m_{c}") * F.col(f"_r.{c}") + F.col(f"_r.{c}") * F.col(f"_r.{c}") for c in xyz]
    return g.select(entity, F.sqrt(F.greatest(sum(parts[1:], parts[0]), F.lit(0.0))).alias("rmsf"))


def _tile_pairs(cells: DataFrame, frame: str, cell: list[str]) -> DataFrame:
    """(frame, ta, tb, a, b) for the pairs of tiles ta <= tb of each frame, of one row for each (frame, tile, slot)."""
    tiles = cells.groupBy(frame, "tile").agg(F.collect_list(F.struct("slot", *cell)).alias("cells"))
    a = tiles.select(frame, F.col("tile").alias("ta"), F.col("cells").alias("a"))
    b = tiles.select(frame, F.col("tile").alias("tb"), F.col("cells").alias("b"))
    return a.join(b, frame).where("ta <= tb")


def _filled(cells, names: list[str], size: int) -> np.ndarray:
    """Numbers of a list of structs by slot: one row for each name."""
    slots = cells.field("slot").to_numpy()
    out = np.zeros((len(names), size))
    for i, n in enumerate(names):
        out[i, slots] = cells.field(n).to_numpy(zero_copy_only=False)
    return out


def pair_covariance(df: DataFrame, entity: str, frame: str, xyz: list[str], tile: int = 64) -> DataFrame:
    """(a, b, cov) for a <= b: sample covariance over shared frames, summed over the coordinates; null below two shared values.

    The output grows with the square of the entities of a frame.  The work is done in tiles of entities: a row for each frame and tile,
    products of tiles added up over the frames that a task sees, so what is shuffled grows with tiles and not with pairs in each frame.  Null
    entities and frames take no part, a null coordinate none in its coordinate's sums; several rows of an entity in a frame count each.
    """
    from regionfx.operators.sampling import numbered

    df = df.where(F.col(entity).isNotNull() & F.col(frame).isNotNull())
    # sums are taken from each entity's means, which covariances don't depend on
    own = numbered(df.groupBy(entity).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(xyz)]), entity, "_at").withColumnRenamed(entity, "_name")
    near = df.join(own, df[entity] == own["_name"])
    numbers = ["r", *[f"{k}{i}" for i in range(len(xyz)) for k in "ns"]]
    sums = [F.count("*").cast("double").alias("r"), *[e for i, c in enumerate(xyz) for e in (F.count(c).cast("double").alias(f"n{i}"), F.coalesce(F.sum(F.col(c) - F.col(f"_m{i}")), F.lit(0.0)).alias(f"s{i}"))]]
    at = F.col("_at") - 1
    cells = near.groupBy(frame, F.floor(at / tile).alias("tile"), (at % tile).cast("int").alias("slot"), F.col(entity).alias("name")).agg(*sums)
    pairs = _tile_pairs(cells, frame, ["name", *numbers]).select("ta", "tb", "a", "b").sortWithinPartitions("ta", "tb")
    kind, d = df.schema[entity].dataType.simpleString(), len(xyz)
    out = [f"{k}{i}" for i in range(d) for k in ("n", "sa", "sb", "sab")]

    def products(batches):
        import pyarrow as pa

        held, sums, names, arrow = None, None, None, None

        def flush():
            shared = sums[0] > 0
            if held[0] == held[1]:
                shared &= np.tri(tile, dtype=bool).T
            i, j = np.nonzero(shared)
            return pa.RecordBatch.from_arrays([pa.array([names[0][k] for k in i], arrow), pa.array([names[1][k] for k in j], arrow), *[pa.array(s[i, j]) for s in sums[1:]]], names=["a", "b", *out])

        for batch in batches:
            for ta, tb, a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                if (ta, tb) != held:
                    if held:
                        yield flush()
                    held, sums, names = (ta, tb), np.zeros((1 + 4 * d, tile, tile)), ({}, {})
                x, y = _filled(a.values, numbers, tile), _filled(b.values, numbers, tile)
                arrow = a.values.field("name").type
                for own, cell in ((names[0], a.values), (names[1], b.values)):
                    own.update(zip(cell.field("slot").to_pylist(), cell.field("name").to_pylist(), strict=True))
                sums[0] += np.outer(x[0], y[0])
                for k in range(d):
                    (n, s), (m, t) = x[1 + 2 * k : 3 + 2 * k], y[1 + 2 * k : 3 + 2 * k]
                    for place, (u, v) in enumerate(((n, m), (s, m), (n, t), (s, t))):
                        sums[1 + 4 * k + place] += np.outer(u, v)
        if held:
            yield flush()

    found = pairs.mapInArrow(products, f"a {kind}, b {kind}, " + ", ".join(f"{n} double" for n in out)).groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in out])
    col = lambda k, i: F.col(f"{k}{i}")
    cov = [F.when(col("n", i) > 1, (col("sab", i) - col("sa", i) * col("sb", i) / col("n", i)) / (col("n", i) - 1)) for i in range(d)]
    return found.select("a", "b", sum(cov[1:], cov[0]).alias("cov"))


def radius_of_gyration(df: DataFrame, frame: str, xyz: list[str], mass: str) -> DataFrame:
    """(frame, rg), mass-weighted, from sums."""
    m = F.sum(mass)
    square = F.sum(F.col(mass) * sum((F.col(c) * F.col(c) for c in xyz[1:]), F.col(xyz[0]) * F.col(xyz[0]))) / m
    centre = [F.pow(F.sum(F.col(mass) * F.col(c)) / m, F.lit(2.0)) for c in xyz]
    return df.groupBy(frame).agg(F.sqrt(F.greatest(square - sum(centre[1:], centre[0]), F.lit(0.0))).alias("rg"))


def end_to_end(df: DataFrame, frame: str, pos: str, xyz: list[str]) -> DataFrame:
    """(frame, ete): distance of the first position from the last; null positions are passed over, a null end coordinate gives null, a frame of one position 0."""
    g = df.groupBy(frame).agg(F.min_by(F.struct(*xyz), pos).alias("_a"), F.max_by(F.struct(*xyz), pos).alias("_b"))
    d = [F.pow(F.col(f"_a.{c}") - F.col(f"_b.{c}"), F.lit(2.0)) for c in xyz]
    return g.select(frame, F.sqrt(sum(d[1:], d[0])).alias("ete"))


def distance_by_separation(df: DataFrame, frame: str, pos: str, xyz: list[str], least: int = 2, most: int | None = None, tile: int = 64) -> DataFrame:
    """(separation, rms) over pairs of a frame at j-i >= least, for whole positions; ``most`` bounds the pairs of a frame to its length times it.

    Without ``most`` pairs are taken tile by tile of positions and added up by separation in each task, so what is shuffled grows with
    tiles and separations and not with pairs.  Rows with a null frame, position or coordinate take no part; several rows of a position count each.
    """
    d = [F.pow(F.col(c) - F.col(f"_a_{c}"), F.lit(2.0)) for c in xyz]
    if most is not None:
        a = df.select(frame, F.col(pos).alias("_i"), *[F.col(c).alias(f"_a_{c}") for c in xyz])
        steps = df.withColumn("_i", F.explode(F.sequence(F.col(pos) - most, F.col(pos) - least)))
        return steps.join(a, [frame, "_i"]).groupBy((F.col(pos) - F.col("_i")).alias("separation")).agg(F.sqrt(F.avg(sum(d[1:], d[0]))).alias("rms"))
    rows = df.select(F.col(frame).alias("_frame"), F.col(pos).cast("long").alias("_p"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(xyz)]).na.drop()
    means = rows.groupBy("_frame").agg(*[F.avg(f"_c{i}").alias(f"_m{i}") for i in range(len(xyz))])  # distances don't depend on them
    numbers = ["n", *[f"{k}{i}" for i in range(len(xyz)) for k in "sq"]]
    from_mean = [F.col(f"_c{i}") - F.col(f"_m{i}") for i in range(len(xyz))]
    sums = [F.count("*").cast("double").alias("n"), *[e for i, x in enumerate(from_mean) for e in (F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"))]]
    cells = rows.join(means, "_frame").groupBy("_frame", F.floor(F.col("_p") / tile).alias("tile"), F.pmod("_p", F.lit(tile)).cast("int").alias("slot")).agg(*sums)
    pairs = _tile_pairs(cells, "_frame", numbers).select("ta", "tb", "a", "b")

    def by_gap(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        step = (np.arange(tile)[None, :] - np.arange(tile)[:, None] + tile - 1).ravel()
        for batch in batches:
            for ta, tb, a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                x, y = _filled(a.values, numbers, tile), _filled(b.values, numbers, tile)
                square = sum(np.outer(x[2 + 2 * i], y[0]) + np.outer(x[0], y[2 + 2 * i]) - 2 * np.outer(x[1 + 2 * i], y[1 + 2 * i]) for i in range(len(xyz)))
                both = np.stack([np.bincount(step, weights=m.ravel(), minlength=2 * tile - 1) for m in (np.outer(x[0], y[0]), square)])
                held[tb - ta] = held.get(tb - ta, 0) + both
        gaps = [(k * tile + np.arange(1 - tile, tile), v) for k, v in held.items()]
        flat = lambda f: np.concatenate([f(g, v) for g, v in gaps]) if gaps else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(flat(lambda g, v: g).astype(np.int64)), pa.array(flat(lambda g, v: v[0])), pa.array(flat(lambda g, v: v[1]))], names=["separation", "n", "square"])

    found = pairs.mapInArrow(by_gap, "separation long, n double, square double").where(F.col("separation") >= least)
    total = found.groupBy("separation").agg(F.sum("n").alias("n"), F.sum("square").alias("square")).where("n > 0")
    return total.select("separation", F.sqrt(F.greatest(F.col("square") / F.col("n"), F.lit(0.0))).alias("rms"))


def power_law_fit(df: DataFrame, series: str, x: str, y: str, min_x: float = 5.0, start=(0.4, 0.5)) -> DataFrame:
    """(series, r0, nu) of y = r0 * x**nu by least squares over x > min_x; a group is one series' curve.  Fewer than two points give nulls."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[series].iloc[0]
        part = pdf[(pdf[x] > min_x) & (pdf[x] > 0) & pdf[y].notna()]
        a, b = start
        if len(part) < 2:
            return pd.DataFrame({series: [key], "r0": [None], "nu": [None]})
        u, v = part[x].to_numpy(float), part[y].to_numpy(float)
        if (v > 0).all():
            b, a = np.polyfit(np.log(u), np.log(v), 1)
            a = math.exp(a)
        for _ in range(50):
            p = u**b
            jac = np.stack([p, a * p * np.log(u)], 1)
            move = np.linalg.lstsq(jac, v - a * p, rcond=None)[0]
            a, b = a + move[0], b + move[1]
            if np.abs(move).max() < 1e-12:
                break
        return pd.DataFrame({series: [key], "r0": [a], "nu": [b]})

    kind = dict(df.dtypes)[series]
    return df.select(series, x, y).groupBy(series).applyInPandas(fit, f"{series} {kind}, r0 double, nu double")


def entropy(counts: DataFrame, keys: list[str], n: str, base: float = 2.0) -> DataFrame:
    """Shannon entropy of counts per key; null where all are 0.  H = log(N) - sum(n log n)/N in one pass."""
    total, logs = F.sum(n), F.sum(F.when(F.col(n) > 0, F.col(n) * F.ln(n)).otherwise(0.0))
    h = (F.ln(F.nullif(total, F.lit(0))) - logs / F.nullif(total, F.lit(0))) / math.log(base)
    return counts.groupBy(*keys).agg(h.alias("entropy"))


def with_norm(df: DataFrame, vector: Column) -> DataFrame:
    """Adds ``_v``, the vector as doubles, and ``_norm``, its length: columns of their own, so that a row's are computed once and not for each sum."""
    return df.withColumn("_v", vector.cast("array<double>")).withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v)))


def cosine_sums(size: int) -> tuple[list[Column], Column]:
    """(sums, mean cosine over all pairs) for an aggregation of rows of ``with_norm`` and for a column after it."""
    unit = lambda i: F.when(F.col("_norm") > 0, F.get("_v", F.lit(i)) / F.col("_norm")).otherwise(0.0)
    sums = [F.count("*").alias("_n"), F.sum((F.col("_norm") > 0).cast("double")).alias("_q"), *[F.sum(unit(i)).alias(f"_s{i}") for i in range(size)]]
    square = F.aggregate(F.array(*[F.col(f"_s{i}") for i in range(size)]), F.lit(0.0), lambda a, v: a + v * v)
    return sums, F.when(F.col("_n") > 1, (square - F.col("_q")) / (F.col("_n") * (F.col("_n") - 1)))


def mean_pairwise_cosine(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Mean cosine over all pairs of a group from its sums: (|sum u|^2 - sum |u|^2) / (n(n-1)); zero vectors count as 0, null below two."""
    sums, cosine = cosine_sums(size)
    return with_norm(df.select(key, vector), F.col(vector)).groupBy(key).agg(*sums).select(key, cosine.alias("mean_cosine"))


def mean_with_sem(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, sem) of the values that aren't null; sem is null below two; a null group is one."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def histogram(df: DataFrame, col: str, bins: int, group: str | None = None, density: bool = False) -> DataFrame:
    """([group,] bin, n or density): equal widths over the whole column's range; null values are left out, bins without values too; a null group is one."""
    bounds = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    keys = [group] if group else []
    g = df.where(F.col(col).isNotNull()).join(F.broadcast(bounds)).groupBy(*keys, bin_of(F.col(col), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    if not density:
        return g.drop("_lo", "_hi")
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return g.select(*keys, "bin", (F.col("n") / (total * (F.col("_hi") - F.col("_lo")) / bins)).alias("density"))


def shared_out(rows: DataFrame, keys: list[str], value: str, lo: str, hi: str, fine: int) -> DataFrame:
    """(keys, value, weight): each value's weight of one on the two places beside it of ``fine`` places from lo to hi, added up.

    At most ``fine`` rows for each key and task are shuffled.
    """
    u = (F.col(value) - F.col(lo)) / (F.col(hi) - F.col(lo)) * (fine - 1)
    k = F.least(F.floor(u), F.lit(fine - 2))
    sums = rows.withColumn("_u", u).withColumn("_k", k).groupBy(*keys, "_k").agg(F.sum(1 - (F.col("_u") - F.col("_k"))).alias("_a"), F.sum(F.col("_u") - F.col("_k")).alias("_b"), F.first(lo).alias("_x0"), F.first(hi).alias("_x1"))
    sides = F.inline(F.array(F.struct(F.col("_k").alias("_p"), F.col("_a").alias("w")), F.struct((F.col("_k") + 1).alias("_p"), F.col("_b").alias("w"))))
    at = F.first("_x0") + (F.first("_x1") - F.first("_x0")) * F.col("_p") / (fine - 1)
    return sums.select(*keys, "_x0", "_x1", sides).groupBy(*keys, "_p").agg(at.alias(value), F.sum("w").alias("weight")).where("weight > 0").drop("_p")


def binned_error(width: float, bandwidth: float, fine: int) -> float:
    """How far a density of ``fine`` shared-out places over a range of ``width`` can be from the exact one, at any point.

    Sharing out is linear interpolation of the kernel between places d apart, which is off by at most d*d/8 times its greatest
    second derivative, 1 / (sqrt(2 pi) h**3).
    """
    return (width / (fine - 1)) ** 2 / (8 * math.sqrt(2 * math.pi) * bandwidth**3)


def kde_1d(df: DataFrame, group: str, value: str, grid: int = 50, bw_adjust: float = 1.0, fine: int | None = None) -> DataFrame:
    """(group, x, density): Gaussian density on a grid over each group's range, bandwidth n**(-1/5) times the standard deviation.

    Exact: values are first counted per group, so repeated ones cost once; each is
    spread over the fixed number of grid places and summed before the shuffle.  With ``fine`` values are shared out to that many
    places first (``shared_out``): what is shuffled no longer grows with the rows, and no density is further off than ``binned_error``.
    Null values take no part; a null group is one; a group without spread gives no rows.
    """
    from regionfx.operators.sampling import with_group

    df = df.where(F.col(value).isNotNull())
    stats = df.groupBy(group).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * bw_adjust).where("_h > 0")
    if fine:
        counts = shared_out(with_group(df.select(group, value), stats, group), [group], value, "_lo", "_hi", fine).withColumnRenamed("weight", "_c")
    else:
        counts = df.groupBy(group, value).agg(F.count("*").alias("_c"))
    rows = with_group(counts, stats, group).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_g") / (grid - 1)
    z = (x - F.col(value)) / F.col("_h")
    term = F.col("_c") * F.exp(-0.5 * z * z) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return rows.groupBy(group, x.alias("x")).agg(F.sum(term).alias("density"))


def hist_2d(df: DataFrame, x: str, y: str, bins: int, group: str) -> DataFrame:
    """(bx, by, group, n) of the cells that occur, equal widths over the whole range of each axis; rows with a null coordinate are left out, a null group is one."""
    b = df.agg(*[f(c).alias(n) for c, n, f in ((x, "_x0", F.min), (x, "_x1", F.max), (y, "_y0", F.min), (y, "_y1", F.max))])
    return df.na.drop(subset=[x, y]).join(F.broadcast(b)).groupBy(bin_of(F.col(x), F.col("_x0"), F.col("_x1"), bins).alias("bx"), bin_of(F.col(y), F.col("_y0"), F.col("_y1"), bins).alias("by"), group).agg(F.count("*").alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, slope, intercept, r2) over the rows with both values; nulls where there are fewer than two or x is constant; a null key is a group."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


#: Characters that are counted at once, and cells of a task's tables up to which it goes on counting before it hands them on.
LETTERS_AT_ONCE, LETTER_CELLS = 1 << 22, 1 << 24


def letter_counts(df: DataFrame, group: str, seq: str) -> DataFrame:
    """(group, pos from 0, letter, n): how many sequences of a group have a letter at a place.

    A task counts in tables of letters and places, one for each group, and hands on their cells when it ends or the tables are full, so
    no row is made for each letter.  The null group is one like others; null sequences have no letters.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[group].dataType

    def counted(batches):
        import pyarrow as pa

        places, letters, tables = np.full(0x110000, -1, dtype=np.int32), [], {}

        def rows(name, codes, pos, n):
            of = pa.array(letters)
            for i in range(0, len(n), 1 << 16):
                cut = slice(i, i + (1 << 16))
                own = pa.array([name], to_arrow_type(kind)).take(pa.array(np.zeros(len(n[cut]), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([own, pa.array(pos[cut].astype(np.int32)), of.take(pa.array(codes[cut])), pa.array(n[cut].astype(np.int64))], names=[group, "pos", "letter", "n"])

        def full():
            for name, table in tables.items():
                codes, pos = np.nonzero(table)
                yield from rows(name, codes, pos, table[codes, pos])
            tables.clear()

        def count(name, texts):
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            if not len(codes):
                return
            for new in np.unique(codes[places[codes] < 0]):
                places[new] = len(letters)
                letters.append(chr(new))
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            longest, own = int(sizes.max()), places[codes].astype(np.int64)
            if len(letters) * longest > LETTER_CELLS:  # too many for a table
                key, n = np.unique(pos * len(letters) + own, return_counts=True)
                yield from rows(name, key % len(letters), key // len(letters), n)
                return
            table = np.bincount(own * longest + pos, minlength=len(letters) * longest).reshape(len(letters), longest)
            old = tables.get(name, table[:0, :0])
            if old.shape[0] < table.shape[0] or old.shape[1] < longest:
                tables[name] = np.zeros(np.maximum(old.shape, table.shape), dtype=np.int64)
                tables[name][: old.shape[0], : old.shape[1]] = old
            tables[name][:, :longest] += table
            if sum(t.size for t in tables.values()) > LETTER_CELLS:
                yield from full()

        waiting, size = {}, 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                waiting.setdefault(name, []).append(text)
                size += len(text)
                if size >= LETTERS_AT_ONCE:
                    for k, texts in waiting.items():
                        yield from count(k, texts)
                    waiting, size = {}, 0
        for k, texts in waiting.items():
            yield from count(k, texts)
        yield from full()

    counts = [StructField("pos", IntegerType()), StructField("letter", StringType()), StructField("n", LongType())]
    parts = df.select(group, seq).mapInArrow(counted, StructType([StructField(group, kind), *counts]))
    return parts.groupBy(group, "pos", "letter").agg(F.sum("n").alias("n"))
