"""Order, limits, reproducible sampling and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionfx.storage import materialize


def top_n(df: DataFrame, col: str, n: int, tiebreak: str) -> DataFrame:
    """The n rows with the largest values, ties by ``tiebreak``; nulls come last, fewer rows are all returned."""
    return df.orderBy(F.desc(col), F.col(tiebreak)).limit(n)


def sort_by(df: DataFrame, *cols: str) -> DataFrame:
    """For a sink only: an order that later steps would lose."""
    return df.orderBy(*cols)


def hash_order(key: str | Column, seed: int) -> Column:
    """A shuffled order that is the same however the rows are partitioned."""
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def seeded_shuffle(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows (all, if fewer) in a shuffled order of their keys; rows of one key stay together, null keys are a key."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def same(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    """Equal keys of two tables, nulls among them."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


#: Tables read in all up to which a window by key is taken instead of written ranges.
SMALL_BYTES = 16 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the tables that a plan reads are small by Spark's own figures; those of unknown size aren't.

    Like the size check of a broadcast it chooses between two plans with equal results and starts no job.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) <= SMALL_BYTES


class Ranges:
    """Rows written once in ranges of (keys, order), each range and key in it a group of its own (``_part``, keys).

    What a range needs of the others is a row for each range and key in it: counts, sums or its outermost rows.  So no
    task holds all rows of a key.  Rows have their place in ``_at``, which grows with the order.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column]):
        ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
        self.keys, self.rows = keys, materialize(ranged.withColumn("_part", F.shiftright("_at", 33)), "ranges")
        self.inside = Window.partitionBy("_part", *keys).orderBy("_at")
        self.across = Window.partitionBy(*keys).orderBy("_part")

    def summed(self, *parts: Column) -> DataFrame:
        return self.rows.groupBy("_part", *self.keys).agg(*parts)

    def joined(self, rows: DataFrame, parts: DataFrame, *columns: Column) -> DataFrame:
        """Rows with columns of their range's row in ``parts``."""
        own = parts.select(F.col("_part").alias("__part"), *[F.col(k).alias(f"_{k}") for k in self.keys], *columns)
        return rows.join(own, same(["_part", *self.keys], rows, own))


def with_group(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Rows with what a summary by ``key`` says of their group; rows with a null key are a group like any other."""
    own = groups.withColumnRenamed(key, f"_{key}")
    return df.join(own, df[key].eqNullSafe(own[f"_{key}"])).drop(f"_{key}")


def numbered(df: DataFrame, order: str | list[str], name: str = "row_no", keys: list[str] | None = None, small: bool | None = None) -> DataFrame:
    """Rows numbered from 1 in a stated order, over the whole table or within each key, without one task for all rows or for a key.

    The rows are written once in ranges; the numbers of rows of a key in each range are added up and joined back.  Rows
    that are equal in ``order`` are numbered in any order; null keys are a key.  An empty table gives no rows.  Small tables (or
    ``small``) have a window instead.
    """
    keys, order = keys or [], [order] if isinstance(order, str) else order
    rest = [c for c in df.columns if c != name]
    if is_small(df) if small is None else small:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).select(*rest, name)
    r = Ranges(df, keys, order)
    sizes = r.summed(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = r.across.rowsBetween(Window.unboundedPreceding, -1)
    out = r.joined(r.rows, sizes, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return out.select(*rest, (F.col("_at") + F.col("_shift")).alias(name))


def running_sums(df: DataFrame, keys: list[str], order: str | Column, sums: dict[str, str], descending: bool = False, small: bool | None = None) -> DataFrame:
    """Adds for each (name: column) the sum of the column over the rows of the key before this one; ranges as in ``numbered``.

    Rows of a key must differ in ``order``; null keys are a key.
    """
    order = F.col(order) if isinstance(order, str) else order
    order = order.desc() if descending else order.asc()
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = [c for c in df.columns if c not in sums]
    if is_small(df) if small is None else small:
        return df.select(*rest, *[before(c, Window.partitionBy(*keys).orderBy(order)).alias(n) for n, c in sums.items()])
    r = Ranges(df, keys, [order])
    parts = r.summed(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    out = r.joined(r.rows.withColumns({f"_w_{n}": before(c, r.inside) for n, c in sums.items()}), parts, *[before(f"_s_{n}", r.across).alias(f"_b_{n}") for n in sums])
    return out.select(*rest, *[(F.col(f"_b_{n}") + F.col(f"_w_{n}")).alias(n) for n in sums])


def neighbours(df: DataFrame, keys: list[str], order: str, after: dict[str, str] | None = None, before: dict[str, str] | None = None, small: bool | None = None) -> DataFrame:
    """Adds columns of the next row of a key (``after``, name: column) and of the one before; null at the ends of a key.

    Each range hands its first and last rows to the ranges beside it, so a long key is many tasks' work.  Rows of a key must
    differ in ``order``, nulls first; null keys are a key.  An empty table gives no rows.
    """
    after, before = after or {}, before or {}
    pick = lambda names: F.struct(F.lit(True).alias("_"), *[F.col(c).alias(n) for n, c in names.items()])  # noqa: E731  never null itself
    if is_small(df) if small is None else small:
        w = Window.partitionBy(*keys).orderBy(order)
        out = df.withColumns({"_next": F.lead(pick(after)).over(w), "_last": F.lag(pick(before)).over(w)})
    else:
        r = Ranges(df, keys, [order])
        ends = r.summed(F.min_by(pick(after), "_at").alias("_head"), F.max_by(pick(before), "_at").alias("_tail"))
        inner = r.rows.withColumns({"_in": F.lead(pick(after)).over(r.inside), "_il": F.lag(pick(before)).over(r.inside)})
        out = r.joined(inner, ends, F.lead("_head").over(r.across).alias("_on"), F.lag("_tail").over(r.across).alias("_ol"))
        out = out.withColumns({"_next": F.coalesce("_in", "_on"), "_last": F.coalesce("_il", "_ol")})
    return out.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in after], *[F.col(f"_last.{n}").alias(n) for n in before])


def batch_slice(df: DataFrame, order: str, start: int, size: int = 20) -> DataFrame:
    """Rows start .. start+size-1 (from 1) of an ordered list, with their ``row_no``; whatever the start, no task sorts them all.

    Equal rows in ``order`` come in any order, nulls first; beyond the end there are no rows.
    """
    return numbered(df, order).where(F.col("row_no").between(start, start + size - 1))


def burn_in_sample(df: DataFrame, series: str, order: str, share: float, k: int, seed: int) -> DataFrame:
    """Per series: drop the first floor(share*n) rows, then take k of the others by a seeded hash."""
    sizes = df.groupBy(F.col(series).alias("_series")).agg(F.count("*").alias("_n"))
    rows = numbered(df, order, "_i", [series])
    late = rows.join(sizes, rows[series].eqNullSafe(sizes["_series"])).where(F.col("_i") > F.floor(F.col("_n") * share))
    chosen = Window.partitionBy(series).orderBy(hash_order(order, seed), order)  # a task keeps k rows of a series before the shuffle
    return late.withColumn("_k", F.row_number().over(chosen)).where(F.col("_k") <= k).drop("_i", "_n", "_k", "_series")


def union_by_name(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def complement(df: DataFrame, *subsets: Column) -> DataFrame:
    """Rows in none of the subsets; a condition that is null holds for no row."""
    for s in subsets:
        df = df.where(~F.coalesce(s, F.lit(False)))
    return df
