"""Keyed, interval and status joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionfx.operators.sampling import numbered, running_sums
from regionfx.storage import materialize


def equi_join(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Join on pairs of columns; of clashing names the right side's gets the suffix; null keys never match; right keys are left out."""
    drop = {r for _, r in keys}
    clash = {c: c + suffix for c in b.columns if c in a.columns and c not in drop}
    left, right = a.alias("_a"), b.withColumnsRenamed({**clash, **{r: f"_key_{r}" for r in drop}})
    on = reduce(lambda x, y: x & y, [F.col(f"_a.{p}") == right[f"_key_{r}"] for p, r in keys])
    return left.join(right, on, how).drop(*[f"_key_{r}" for r in drop])


#: Rows of both sides that one tile of ``many_to_many`` has, about, and the pairs that a task makes.
TILE_LEFT, TILE_RIGHT, TASK_PAIRS = 8192, 512, 8 * 8192 * 512


def spread_tiles(df: DataFrame, pairs: float, *keys: str) -> DataFrame:
    """Rows of tiles dealt over tasks of so many pairs, four tasks a core at least: columns of a task's pairs have few values, and files stay small."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS)), *keys)


def many_to_many(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """As ``equi_join`` (inner or left) for keys with many rows on both sides; columns of both sides have different names.

    A key's pairs are cut into tiles of so many rows of either side, which are dealt over the tasks; a row is copied for each tile of its own, one for some
    hundreds of pairs.  Each row of the left side meets the same few rows of the right side in the same order as the one before it, so that columnar files of
    the pairs hold short patterns again and again, whatever the size of a key.
    """
    if how not in ("inner", "left"):
        raise ValueError("tiles are for inner and left joins")
    right = b.withColumnsRenamed({r: f"_r{i}" for i, (_, r) in enumerate(keys)})
    rest, left_keys, right_keys = [c for c in right.columns if c in b.columns], [p for p, _ in keys], [f"_r{i}" for i in range(len(keys))]
    equal = lambda x, y: reduce(lambda p, q: p & q, [F.col(c) == F.col(k) for c, k in zip(x, y, strict=True)])
    tile_keys = [f"_k{i}" for i in range(len(keys))]
    n_left = a.groupBy(*[F.col(c).alias(k) for c, k in zip(left_keys, tile_keys, strict=True)]).agg(F.count("*").alias("_l"))
    n_right = right.groupBy(*right_keys).agg(F.count("*").alias("_r"))
    tiles = materialize(n_left.join(n_right, equal(tile_keys, right_keys)).select(*tile_keys, F.ceil(F.col("_l") / TILE_LEFT).alias("_nl"), F.ceil(F.col("_r") / TILE_RIGHT).alias("_nr"), (F.col("_l").cast("double") * F.col("_r")).alias("_pairs")), "tiles")  # so that a small table's size is known to the joins
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    n_pairs = tiles.agg(F.sum("_pairs")).first()[0] or 0
    one = a.join(tiles, equal(left_keys, tile_keys)).withColumn("_pl", F.pmod(F.xxhash64(*a.columns), F.col("_nl"))).withColumn("_pr", all_("_nr")).select(*a.columns, "_pl", "_pr")
    two = numbered(right, rest or right_keys, "_n", right_keys)  # tiles of the full size, as patterns of such a length are packed alike each time
    two = two.join(tiles, equal(right_keys, tile_keys)).withColumn("_qr", F.floor((F.col("_n") - 1) / TILE_RIGHT)).withColumn("_ql", all_("_nl")).select(*right.columns, "_ql", "_qr")
    out = spread_tiles(one, n_pairs, *left_keys, "_pl", "_pr").join(two.hint("merge"), equal([*left_keys, "_pl", "_pr"], [*right_keys, "_ql", "_qr"])).select(*a.columns, *rest)
    if how == "inner":
        return out
    alone = a.join(tiles.select(*tile_keys), equal(left_keys, tile_keys), "left_anti")
    return out.unionByName(alone, allowMissingColumns=True)


def annotate_chain(base: DataFrame, dims: list[tuple[DataFrame, list[tuple[str, str]]]]) -> DataFrame:
    """Left joins one after the other; each dimension has one row per key."""
    for dim, keys in dims:
        base = equi_join(base, dim, keys, "left")
    return base


def join_with_status(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that says for each row whether it found a partner (``status``: both or left_only)."""
    flagged = b.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return a.join(flagged, keys, "left").withColumn("status", F.when(F.col("_hit"), "both").otherwise("left_only")).drop("_hit")


def right_only(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """Rows of b without a partner in a."""
    return b.join(a, on, "left_anti")


def semi_reduce(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of a large table whose key occurs in a smaller one, each once; null keys never match."""
    return big.join(keys.select(on).distinct(), on, "left_semi")


#: Points and intervals of a bin that one tile of its join has, about.
TILE_POINTS, TILE_REGIONS = 8192, 512
#: Widths of bins grow by this factor from level to level; so many levels are told apart at most.
LEVEL_BASE, MOST_LEVELS = 4, 12


def interval_levels(regions: DataFrame, start: str, end: str) -> list[int]:
    """The levels of bins that the lengths of the intervals ask for, found in one small aggregation.

    A level's width is LEVEL_BASE ** level, and an interval's level is the least whose width isn't below its length.  Where lengths span more than
    MOST_LEVELS levels, neighbouring ones are put together, the shorter intervals into the wider bins.
    """
    length = (F.col(end) - F.col(start)).cast("double")
    level = F.when(length > 0, F.ceil(F.log(float(LEVEL_BASE), length)).cast("int"))
    found = sorted(r[0] for r in regions.where(length >= 0).select(level.alias("k")).distinct().where("k is not null").collect())  # one for each power of the base
    step = -(-len(found) // MOST_LEVELS) or 1
    return found[::-1][::step][::-1] or [0]


def multilevel_hits(points: DataFrame, regions: DataFrame, key: str, pos: str, start: str, end: str) -> DataFrame:
    """Pairs of points and the intervals around them by bins of several levels: an interval is in at most two bins, of its own level.

    A point is in one bin of each level that occurs, and goes on only where that bin has intervals.  The join is on (key, level, bin), so neither long intervals nor a hot key make
    many rows or one large group.  A full bin is cut into tiles of so many points and intervals, which are dealt over the tasks; rows are
    copied for each tile of theirs, one for some hundreds of pairs that are compared.  As in ``many_to_many`` a tile's intervals are few, so that files of the pairs are small.
    Columns: those of both sides but the intervals' key.
    """
    levels = interval_levels(regions, start, end)
    width = lambda level: float(LEVEL_BASE) ** level
    place = lambda x, w: F.floor(x.cast("double") / w)
    length = (F.col(end) - F.col(start)).cast("double")
    own = F.coalesce(*[F.when(length <= width(k), F.lit(k)) for k in levels])
    other = regions.where(length >= 0).withColumnRenamed(key, "_key").withColumn("_rlevel", own)
    w = F.coalesce(*[F.when(F.col("_rlevel") == k, F.lit(width(k))) for k in levels])
    other = other.withColumn("_rbin", F.explode(F.sequence(place(F.col(start), w), place(F.col(end), w))))
    bins = F.array(*[F.struct(F.lit(k).alias("level"), place(F.col(pos), width(k)).alias("bin")) for k in levels])
    asked = points.where(F.col(pos).isNotNull()).withColumn("_b", F.explode(bins))
    held = materialize(other.groupBy("_key", "_rlevel", "_rbin").agg(F.count("*").alias("_nr")), "bins")  # so that a small table's size is known to the join
    found = lambda bins: (F.col(key) == bins["_key"]) & (F.col("_b.level") == bins["_rlevel"]) & (F.col("_b.bin") == bins["_rbin"])
    met = asked.select(key, "_b").join(held, found(held)).groupBy("_key", "_rlevel", "_rbin").agg(F.count("*").alias("_p"), F.first("_nr").alias("_r"))
    met = met.select("_key", "_rlevel", "_rbin", F.ceil(F.col("_p") / TILE_POINTS).alias("_np"), F.ceil(F.col("_r") / TILE_REGIONS).alias("_nr"), (F.col("_p").cast("double") * F.col("_r")).alias("_pairs"))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tiles = materialize(met.withColumn("_pairs", F.col("_pairs") / (F.col("_np") * F.col("_nr"))).withColumn("_pi", all_("_np")).withColumn("_ri", all_("_nr")), "tiles")
    n_pairs = tiles.agg(F.sum("_pairs")).first()[0] or 0
    tiles = tiles.drop("_pairs")
    own = tiles.withColumnsRenamed({"_key": "_k", "_rlevel": "_level", "_rbin": "_bin", "_pi": "_pj", "_ri": "_rj"})
    asked = asked.join(own, (F.col(key) == F.col("_k")) & (F.col("_b.level") == F.col("_level")) & (F.col("_b.bin") == F.col("_bin")) & (F.pmod(F.xxhash64(*points.columns), F.col("_np")) == F.col("_pj")))
    asked = spread_tiles(asked.drop("_np", "_nr", "_b"), n_pairs, "_k", "_level", "_bin", "_pj", "_rj")
    same_bin = tiles.withColumnsRenamed({"_key": "_tk", "_rlevel": "_tl", "_rbin": "_tb"})
    other = numbered(other, regions.withColumnRenamed(key, "_key").columns, "_n", ["_key", "_rlevel", "_rbin"])
    other = other.join(same_bin, (F.col("_key") == F.col("_tk")) & (F.col("_rlevel") == F.col("_tl")) & (F.col("_rbin") == F.col("_tb")) & (F.floor((F.col("_n") - 1) / TILE_REGIONS) == F.col("_ri"))).drop("_tk", "_tl", "_tb", "_np", "_nr", "_n")
    on = (F.col("_k") == F.col("_key")) & (F.col("_level") == F.col("_rlevel")) & (F.col("_bin") == F.col("_rbin")) & (F.col("_pj") == F.col("_pi")) & (F.col("_rj") == F.col("_ri"))
    return asked.join(other.hint("merge"), on & F.col(pos).between(F.col(start), F.col(end))).drop("_k", "_level", "_bin", "_pj", "_rj", "_rlevel", "_rbin", "_key", "_ri", "_pi")


def point_in_region(points: DataFrame, regions: DataFrame, key: str, pos: str, start: str, end: str, bin_width: float | str | None = None, how: str = "inner") -> DataFrame:
    """Points within start..end (inclusive) of regions of the same key; null keys, positions and bounds never match.

    One hash join on the key, the range as its further condition.  With
    ``bin_width`` regions are also spread over the bins they touch and the
    bin joins the key, so that one hot key falls into many groups: choose about the
    usual length of a region, or "levels" for regions of mixed lengths (inner joins only).
    """
    if bin_width == "levels":
        if how != "inner":
            raise ValueError("bins of several levels are for inner joins")
        return multilevel_hits(points, regions, key, pos, start, end)
    other = regions.withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & F.col(pos).between(F.col(start), F.col(end))
    if bin_width:
        points = points.withColumn("_bin", F.floor(F.col(pos) / bin_width).cast("long"))
        other = other.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col(start) / bin_width).cast("long"), F.floor(F.greatest(start, end) / bin_width).cast("long"))))
        return points.join(other, (F.col("_bin") == F.col("_rbin")) & on, how).drop("_bin", "_rbin", "_key")
    return points.join(other, on, how).drop("_key")


def annotate_first_interval(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, end: str, kind: str, order: str, point_id: str, default: str, bin_width: float | str | None = None) -> DataFrame:
    """Each point with the type, start and end of its first interval in ``order``; ``default`` and nulls where there is none.

    The join gives the candidates, min_by combines them before the shuffle, and points
    without one come back by their id.  With ``bin_width`` "levels" the pairs aren't formed: see ``first_by_segments``.
    """
    if bin_width == "levels":
        return first_by_segments(points, intervals, key, pos, start, end, kind, order, default)
    hits = point_in_region(points.select(point_id, key, pos), intervals.select(key, start, end, kind, order), key, pos, start, end, bin_width)
    first = hits.groupBy(point_id).agg(F.min_by(F.struct(kind, start, end), order).alias("_f"))
    return points.join(first, point_id, "left").select(*[points[c] for c in points.columns], F.coalesce(F.col(f"_f.{kind}"), F.lit(default)).alias("annotation"), F.col(f"_f.{start}").alias("a_start"), F.col(f"_f.{end}").alias("a_end"))


def first_by_segments(points: DataFrame, intervals: DataFrame, key: str, pos: str, start: str, end: str, kind: str, order: str, default: str) -> DataFrame:
    """As ``annotate_first_interval``; the work grows with rows times the logarithm of a key's bounds, whatever the number of intervals around a point.

    The distinct bounds of a key cut its line into segments: each bound, and what is between it and the next.  An interval is the union of two nodes at most of each level
    of a binary tree over the segments; a node keeps its first interval, a segment takes the first of the nodes above it,
    and a point that of its segment, which is found by counting the bounds before it.  Null orders come last.
    """
    valid = intervals.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end))).select(F.col(key).alias("_key"), F.col(start).alias("_lo"), F.col(end).alias("_hi"), F.struct(kind, start, end).alias("_f"), F.struct(F.col(order).isNull().alias("_no"), F.col(order).alias("_by"), F.col(start).alias("_s"), F.col(end).alias("_e")).alias("_order"))
    cuts = valid.select("_key", F.col("_lo").alias("_x")).union(valid.select("_key", "_hi")).distinct()
    cuts = materialize(numbered(cuts, "_x", "_n", ["_key"]), "cuts")
    most = cuts.agg(F.max("_n")).first()[0] or 1
    levels = F.array(*[F.lit(k) for k in range((2 * most).bit_length())])
    place = lambda c, n: cuts.select(F.col("_key").alias(f"{n}_key"), F.col("_x").alias(f"{n}_x"), (F.col("_n") * 2 - c).alias(n))  # noqa: E731  a bound's segment has an even number
    a, b = place(2, "_a"), place(1, "_b")  # the second one is beyond the end
    both = valid.join(a, (F.col("_key") == a["_a_key"]) & (F.col("_lo") == a["_a_x"])).join(b, (F.col("_key") == b["_b_key"]) & (F.col("_hi") == b["_b_x"]))
    wide = lambda k: F.pow(F.lit(2.0), k)

    def nodes(k: Column) -> Column:
        lo, hi = F.ceil(F.col("_a") / wide(k)).cast("long"), F.floor(F.col("_b") / wide(k)).cast("long")
        at = lambda odd, n: F.when((lo < hi) & (odd % 2 == 1), F.struct(k.alias("level"), n.alias("node")))
        return F.filter(F.array(at(lo, lo), at(hi, hi - 1)), lambda x: x.isNotNull())

    first = F.min_by("_f", "_order").alias("_f"), F.min("_order").alias("_order")
    tree = both.select("_key", "_f", "_order", F.explode(F.flatten(F.transform(levels, nodes))).alias("_t")).groupBy("_key", "_t").agg(*first)
    segment = F.col("_n") * 2 - F.when(F.col("_gap"), 1).otherwise(2)
    above = cuts.select("_key", "_n", F.explode(F.array(F.lit(False), F.lit(True))).alias("_gap")).select("_key", "_n", "_gap", F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor(segment / wide(k)).cast("long").alias("node")))).alias("_t"))
    own = above.join(tree.hint("merge"), ["_key", "_t"]).groupBy("_key", "_n").agg(*[F.min_by(F.when(F.col("_gap") == g, F.col("_f")), F.when(F.col("_gap") == g, F.col("_order"))).alias(n) for g, n in ((False, "_at"), (True, "_after"))])
    c = cuts.select(F.col("_key").alias("_ck"), F.col("_n").alias("_cn"), "_x")
    own = c.join(own, (F.col("_ck") == F.col("_key")) & (F.col("_cn") == F.col("_n"))).select("_ck", "_cn", F.col("_x").alias("_cx"), "_at", "_after")
    rows = points.select(F.struct(*points.columns).alias("_row"), F.col(key).alias("_key"), F.col(pos).alias("_x"), F.lit(0).cast("long").alias("_w"))
    bounds = cuts.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_key", "_x", F.lit(1).cast("long").alias("_w"))
    placed = running_sums(bounds.union(rows), ["_key"], F.struct("_x", (1 - F.col("_w")).alias("_p")), {"_c": "_w"}).where("_w = 0")
    out = placed.join(own.hint("merge"), (F.col("_key") == F.col("_ck")) & (F.col("_c") == F.col("_cn")), "left").withColumn("_f", F.when(F.col("_x") == F.col("_cx"), F.col("_at")).otherwise(F.col("_after")))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in points.columns], F.coalesce(F.col("_f").getField(kind), F.lit(default)).alias("annotation"), F.col("_f").getField(start).alias("a_start"), F.col("_f").getField(end).alias("a_end"))


def saturation(positions: DataFrame, letter: str, alphabet: list[str], changed: str = "changed") -> DataFrame:
    """Each position with every other letter; the alphabet is a literal, so nothing is joined."""
    return positions.withColumn(changed, F.explode(F.array(*[F.lit(a) for a in alphabet]))).where(F.col(changed) != F.col(letter))


def baseline_altered(altered: DataFrame, baseline: DataFrame, name: str, features: str, pseudo: float = 1e-3) -> DataFrame:
    """Rows of altered entities beside their baselines, with ``difference`` and ``ratio`` of the feature arrays.

    A name is ``<id>_<start>_<end>_<old>:<location>:<new>``: its region is what stands before the last underscore, and
    the place in it (pos, from 1) is the location less the start.  baseline: (region_id, pos, features).  Names of another form and
    places without a baseline drop out; the ratio has a small count added to both sides.
    """
    form = r"^((?:.*_)?(\d+)_\d+)_[^_:]*:(\d+):[^_:]*$"
    part = lambda i: F.regexp_extract(name, form, i)
    named = altered.where(F.col(name).rlike(form)).withColumn("region_id", part(1)).withColumn("pos", (part(3).cast("long") - part(2).cast("long") + 1).cast("int"))
    both = named.join(baseline.select("region_id", "pos", F.col(features).alias("_base")), ["region_id", "pos"])
    return both.withColumn("difference", F.zip_with(features, "_base", lambda x, y: x - y)).withColumn("ratio", F.zip_with(features, "_base", lambda x, y: (x + pseudo) / (y + pseudo))).drop("_base")
