"""Hard negatives by an exact search in a multiway hyperplane tree.

A node of the tree has several split points; a vector belongs to the subtree of
the nearest one.  For each split point and each sibling subtree the node holds
the least and greatest distance between them.  Whoever looks for vectors at
a distance of r1 to r2 from a query (an annulus) knows by the triangle
inequality how far these can be from a split point, and leaves out each sibling
whose range doesn't meet that.  What is left is compared exactly.

Scores are inner products.  With M the greatest length, a vector x is taken as
(x, sqrt(M*M - |x|*|x|)) and a query q as (q, 0), so that their squared distance is
|q|*|q| + M*M - 2 q.x: scores between two bounds are an annulus.

The tree is made from a bounded sample of split candidates; every vector is in
one leaf, in blocks of bounded size, so a leaf with many vectors is many
blocks.  Queries are taken in tiles; a tile meets a block as one matrix product.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionfx.llm.storage import discard, materialize

FANOUT, LEVELS, TILE = 8, 4, 256
BOUND = 1 << 24
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Tree:
    """Split points, their children and the ranges between them; at most FANOUT ** LEVELS leaves."""

    def __init__(self, sample: np.ndarray, square: int, leaves: int):
        self.square, self.nodes, self.leaves = float(square), [], 0
        self.paths: list[list[tuple[int, int]]] = []  # of each leaf: (node, child)
        depth = next(d for d in range(LEVELS + 1) if FANOUT**d >= leaves or d == LEVELS)
        self._grow(sample.astype(np.float64), depth, [])
        self.ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _grow(self, points: np.ndarray, depth: int, path):
        """The number of the node made, or of a leaf less 1 from -1 down."""
        distinct = np.unique(points, axis=0) if depth else points[:0]
        if len(distinct) < 2:
            self.paths.append(path)
            self.leaves += 1
            return -self.leaves
        full = self.lift(distinct)
        chosen = [0]
        nearest = self.gap(full, full[:1])[:, 0]
        while len(chosen) < min(FANOUT, len(distinct)):
            far = int(nearest.argmax())
            if nearest[far] <= 0:
                break
            chosen.append(far)
            nearest = np.minimum(nearest, self.gap(full, full[far : far + 1])[:, 0])
        splits = full[chosen]
        at = len(self.nodes)
        self.nodes.append([splits, []])
        owner = self.gap(full, splits).argmin(axis=1)
        for j in range(len(splits)):
            self.nodes[at][1].append(self._grow(distinct[owner == j], depth - 1, [*path, (at, j)]))
        return at

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", x, x), 0))[:, None]])

    @staticmethod
    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of a from all rows of b."""
        square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
        return np.sqrt(np.maximum(square, 0))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(x), np.int32), self.lift(x)
        open_ = [(0 if self.nodes else -1, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            if at < 0:
                out[rows] = -at - 1
                continue
            splits, children = self.nodes[at]
            owner = self.gap(full[rows], splits).argmin(axis=1)
            open_ += [(child, rows[owner == j]) for j, child in enumerate(children) if (owner == j).any()]
        return out

    def distances(self, leaf: int, x: np.ndarray):
        """(least, greatest) distance of the rows from each split point of the nodes above the leaf."""
        full = self.lift(x)
        gaps = [self.gap(full, self.nodes[at][0]) for at, _ in self.paths[leaf]]
        return [v for g in gaps for v in g.min(axis=0).tolist()], [v for g in gaps for v in g.max(axis=0).tolist()]

    def set_ranges(self, leaves) -> None:
        """leaves: (leaf, least, greatest distances as above) of all leaves that hold vectors."""
        for at, (splits, _) in enumerate(self.nodes):
            m = len(splits)
            self.ranges[at] = (np.full((m, m), np.inf), np.full((m, m), -np.inf))
        for leaf, low, high in leaves:
            k = 0
            for at, j in self.paths[leaf]:
                m = len(self.nodes[at][0])
                lo, hi = self.ranges[at]
                lo[:, j] = np.minimum(lo[:, j], low[k : k + m])
                hi[:, j] = np.maximum(hi[:, j], high[k : k + m])
                k += m

    def annulus(self, q: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        """(r1, r2) of each query for scores from low to high; an empty window has r1 > r2."""
        base = np.einsum("ij,ij->i", q, q)[:, None] + self.square
        slack = 1e-6 * np.sqrt(base + 1)
        r1 = np.sqrt(np.maximum(base - 2 * highs, 0)) - slack
        r2 = np.sqrt(np.maximum(base - 2 * lows, 0)) + slack
        return np.where(highs < lows, np.inf, r1), np.where(highs < lows, -np.inf, r2)

    @staticmethod
    def meets(gap: np.ndarray, r1: np.ndarray, r2: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries with a window that may hold vectors at distances low..high from the split points that they are ``gap`` from."""
        a, b, g = r1[:, :, None], r2[:, :, None], gap[:, None, :]
        return ((g + b >= low) & (np.maximum(g - b, a - g) <= high)).all(axis=2).any(axis=1)

    def route(self, q: np.ndarray, r1: np.ndarray, r2: np.ndarray):
        """(leaf, queries that have to see it) for all leaves that aren't ruled out."""
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        alive = np.flatnonzero((r1 <= r2).any(axis=1))
        open_, out = [(0 if self.nodes else -1, alive)], []
        while open_:
            at, rows = open_.pop()
            if not len(rows):
                continue
            if at < 0:
                out.append((-at - 1, rows))
                continue
            splits, children = self.nodes[at]
            gap, (lo, hi) = self.gap(lifted[rows], splits), self.ranges[at]
            open_ += [(child, rows[self.meets(gap, r1[rows], r2[rows], lo[:, j], hi[:, j])]) for j, child in enumerate(children)]
        return out


def scored(x: np.ndarray, y: np.ndarray, square: int) -> np.ndarray:
    """All inner products, exact: in 32- or 64-bit floating point while their whole numbers allow it."""
    kind = np.float32 if square < 1 << 24 else np.float64 if square < 1 << 53 else np.int64
    return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    out = np.zeros((len(column), dims), np.int64)
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _groups(table, size: int, by: str | None = None):
    """Slices of at most ``size`` rows with one value of ``by``, in the order of the rows."""
    keys = table.column(by).to_numpy() if by else np.zeros(table.num_rows)
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b, size):
            yield table.slice(i, min(size, b - i))


class Index:
    """All vectors in blocks of the leaves of a tree, written to the shared folder.

    rows: (id, label, v array<long>), without nulls, each row once.  ``sample_size`` split candidates at most are
    brought to the driver; what grows with the input stays in tables.
    """

    def __init__(self, rows: DataFrame, sample_size: int = 16_384, rows_per_block: int = 1024):
        self.spark, self.rows_per_block = rows.sparkSession, rows_per_block
        # copies of a vector with one label tie with each other everywhere: the first few by id can be results, more can't
        place = Window.partitionBy("label", "v").orderBy("id")
        self.rows = materialize(rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= 10).drop("_n"), "vectors")
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
        whole = self.rows.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.size("v")).alias("dims")).first()
        self.n, self.square, self.dims = whole["n"], whole["square"] or 0, whole["dims"] or 0
        part = F.pmod(F.xxhash64("id", "label"), F.lit(max(1, self.n))) < sample_size // 2
        sample = self.rows.where(part).select("v").limit(sample_size).toArrow().column("v").combine_chunks()
        self.tree = Tree(_matrix(sample, self.dims), self.square, -(-self.n // (2 * rows_per_block)))
        self.blocks = materialize(self._blocks(), "blocks")
        span = self.blocks.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy("leaf", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        leaves = span.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("x")).select("leaf", "x.low", "x.high").collect()  # a row for each of the tree's leaves
        self.tree.set_ranges(leaves)
        self.shared = self.spark.sparkContext.broadcast(self.tree)

    def close(self) -> None:
        discard(self.rows, self.blocks)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their leaf, in ranges of it; a leaf with many rows is spread over ranges."""
        tree, dims = self.spark.sparkContext.broadcast(self.tree), self.dims

        def place(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.leaf_of(_matrix(b.column("v"), dims)))], names=[*b.schema.names, "leaf"])

        placed = rows.select("id", "label", "v").mapInArrow(place, "id long, label long, v array<long>, leaf int")
        return placed.repartitionByRange(max(1, self.n // (32 * self.rows_per_block)), "leaf", F.xxhash64("id", "label"), "id").sortWithinPartitions("leaf")

    def _blocks(self) -> DataFrame:
        tree, dims, size = self.spark.sparkContext.broadcast(self.tree), self.dims, self.rows_per_block

        def pack(batches):
            import pyarrow as pa

            number, part, held = 0, TaskContext.get().partitionId(), None

            def made(t):
                nonlocal number
                x, leaf = _matrix(t.column("v").combine_chunks(), dims), t.column("leaf")[0].as_py()
                low, high = tree.value.distances(leaf, x)
                number += 1
                raw = [x.astype("<i4").tobytes(), t.column("id").to_numpy().astype("<i8").tobytes(), t.column("label").to_numpy().astype("<i8").tobytes()]
                return pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + number], pa.int64()), "leaf": pa.array([leaf], pa.int32()), "vectors": [raw[0]], "ids": [raw[1]], "labels": [raw[2]], "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64()))})

            for b in batches:
                held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held else pa.Table.from_batches([b])
                if held.num_rows > 4 * size:
                    *whole, last = _groups(held, size, "leaf")
                    yield from map(made, whole)
                    held = last
            if held:
                yield from map(made, _groups(held, size, "leaf"))

        return self._placed(self.rows).mapInArrow(pack, "block long, leaf int, vectors binary, ids binary, labels binary, low array<double>, high array<double>")

    def tiles(self, queries: DataFrame) -> DataFrame:
        """Queries (id, label, v), near ones together: (tile, vectors, ids, labels, leaves)."""
        dims = self.dims

        def pack(batches):
            import pyarrow as pa

            number, part = 0, TaskContext.get().partitionId()
            for b in batches:
                for t in _groups(pa.Table.from_batches([b]), TILE):
                    number += 1
                    raw = [_matrix(t.column("v").combine_chunks(), dims).astype("<i4").tobytes(), *[t.column(c).to_numpy().astype(k).tobytes() for c, k in (("id", "<i8"), ("label", "<i8"), ("leaf", "<i4"))]]
                    yield pa.RecordBatch.from_pydict({"tile": pa.array([(part << 32) + number], pa.int64()), **{n: [x] for n, x in zip(("vectors", "ids", "labels", "leaves"), raw, strict=True)}})

        return self._placed(queries).mapInArrow(pack, "tile long, vectors binary, ids binary, labels binary, leaves binary")

    def search(self, tiles: DataFrame, windows: DataFrame, same_label: bool, k: int, home: bool) -> DataFrame:
        """(query, w, score, id): for each window the k best vectors of the query's own label, or of others.

        windows: (tile, query, windows array<struct<w int, low long, high long>>), of at most TILE queries for a tile.
        home: only the leaves that the queries themselves fall into are looked at, for a first bound.
        """
        shared, dims, square = self.shared, self.dims, self.square
        state = windows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("query", "windows"))).alias("state"))
        asked = materialize(tiles.join(state, "tile"), "asked")

        def opened(row):
            q = np.frombuffer(row["vectors"], "<i4").reshape(-1, dims).astype(np.float64)
            state = {s["query"]: s["windows"] for s in row["state"]}
            width = max((len(x) for x in state.values()), default=0)
            lows, highs, names = (np.full((len(q), width), v, np.int64) for v in (1, 0, -1))
            for i, x in enumerate(np.frombuffer(row["ids"], "<i8").tolist()):
                for j, w in enumerate(state.get(x, ())):
                    lows[i, j], highs[i, j], names[i, j] = w["low"], w["high"], w["w"]
            return q, lows, highs, names

        def route(batches):
            import pyarrow as pa

            tree = shared.value
            for b in batches:
                for row in b.to_pylist():
                    q, lows, highs, _ = opened(row)
                    r1, r2 = tree.annulus(q, lows, highs)
                    if home:
                        leaf = np.frombuffer(row["leaves"], "<i4")
                        hit = [(x, np.flatnonzero((leaf == x) & (r1 <= r2).any(axis=1))) for x in np.unique(leaf).tolist()]
                    else:
                        hit = tree.route(q, r1, r2)
                    hit = [(x, rows) for x, rows in hit if len(rows)]
                    yield pa.RecordBatch.from_pydict({"tile": pa.array([row["tile"]] * len(hit), pa.int64()), "leaf": pa.array([x for x, _ in hit], pa.int32()), "rows": pa.array([rows.astype("<i4").tobytes() for _, rows in hit], pa.binary())})

        met = asked.mapInArrow(route, "tile long, leaf int, rows binary")
        pairs = met.join(self.blocks.select("leaf", "block"), "leaf").drop("leaf")
        pairs = pairs.join(asked.select("tile", F.col("vectors").alias("asked"), "ids", "labels", "state").withColumnsRenamed({"ids": "asked_ids", "labels": "asked_labels"}), "tile").join(self.blocks, "block")

        def compare(batches):
            import pyarrow as pa

            tree, best, n_held = shared.value, {}, 0

            def flush():
                rows = [(key, s, i) for key, (s, i) in best.items()]
                sizes = [len(s) for _, s, _ in rows]
                flat = lambda c: pa.array(np.concatenate([r[c] for r in rows]) if rows else [], pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(np.repeat([key[0] for key, _, _ in rows], sizes), pa.int64()), pa.array(np.repeat([key[1] for key, _, _ in rows], sizes), pa.int32()), flat(1), flat(2)], names=["query", "w", "score", "id"])

            for b in batches:
                for row in b.to_pylist():
                    q, lows, highs, names = opened({"vectors": row["asked"], "ids": row["asked_ids"], "state": row["state"]})
                    rows = np.frombuffer(row["rows"], "<i4")
                    path = tree.paths[row["leaf"]]
                    if path and not home:  # the block's own ranges are narrower than its subtree's
                        r1, r2 = tree.annulus(q[rows], lows[rows], highs[rows])
                        lifted = np.hstack([q[rows], np.zeros((len(rows), 1))])
                        gap = np.hstack([tree.gap(lifted, tree.nodes[at][0]) for at, _ in path])
                        rows = rows[tree.meets(gap, r1, r2, np.array(row["low"]), np.array(row["high"]))]
                    if not len(rows):
                        continue
                    x, ids, labels = np.frombuffer(row["vectors"], "<i4").reshape(-1, dims), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    scores = scored(q[rows], x, square)
                    own, of = np.frombuffer(row["asked_labels"], "<i8")[rows], np.frombuffer(row["asked_ids"], "<i8")[rows]
                    fits = (own[:, None] == labels) == same_label
                    for i, at in enumerate(rows.tolist()):
                        for j in np.flatnonzero(highs[at] >= lows[at]).tolist():
                            hit = np.flatnonzero(fits[i] & (scores[i] >= lows[at, j]) & (scores[i] <= highs[at, j]))
                            if not len(hit):
                                continue
                            s, x_ids, key = scores[i, hit], ids[hit], (int(of[i]), int(names[at, j]))
                            if key in best:
                                s, x_ids = np.append(best[key][0], s), np.append(best[key][1], x_ids)
                            keep = best_of(s, x_ids, k)
                            n_held += len(keep) - (len(best[key][0]) if key in best else 0)
                            best[key] = s[keep], x_ids[keep]
                    if n_held > 200_000:
                        yield flush()
                        best, n_held = {}, 0
            yield flush()

        found = pairs.select("rows", "asked", "asked_ids", "asked_labels", "state", "leaf", "vectors", "ids", "labels", "low", "high").mapInArrow(compare, "query long, w int, score long, id long")
        order = Window.partitionBy("query", "w").orderBy(F.desc("score"), "id")
        out = materialize(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"), "found")
        discard(asked)
        return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, rows_per_block: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, v array<long>).

    An anchor's positives are its ``n_positives`` (at most 9) best other rows of its label by inner product, ties by the smaller id; for
    each the ``n_negatives`` (at most 10) best rows of other labels whose score is from ``low`` to ``high`` percent of the
    positive's.  Rows with a null id, label, vector or component take no part; rows that repeat another one in all three count once, and
    a row of the anchor's own id isn't its positive.  Vectors of different lengths are taken as if filled up with zeros, and components
    are held within 2**24 of zero.  A positive with a negative score has no window.  An empty table gives no rows; further columns are ignored.
    """
    clean = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    held = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(BOUND)), F.lit(-BOUND)).cast("long"))
    clean = materialize(clean.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), held.alias("v"), is_anchor.alias("_anchor")).distinct(), "clean")
    index = Index(clean.drop("_anchor"), rows_per_block=rows_per_block)
    if not index.n:
        return clean.sparkSession.createDataFrame([], OUT)
    # anchors with the same vector and label differ in their positives only, so such a group is one query
    anchors = clean.where("_anchor")
    queries = materialize(anchors.select("label", "v").distinct().withColumn("id", F.monotonically_increasing_id()), "queries")
    tiles = materialize(index.tiles(queries), "tiles")
    members = materialize(_members(tiles), "members")

    def both_rounds(windows, same_label, k):
        """The k-th best of the home leaves bounds what the second round looks for."""
        first = index.search(tiles, windows, same_label, k, home=True)
        bound = first.groupBy("query", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select(F.col("query").alias("_query"), F.col("w").alias("_w"), "s")
        flat = windows.select("tile", "query", F.inline("windows")).join(bound, (F.col("query") == F.col("_query")) & (F.col("w") == F.col("_w")), "left")
        tight = flat.groupBy("tile", "query").agg(F.collect_list(F.struct("w", F.greatest("low", "s").alias("low"), "high")).alias("windows"))
        return index.search(tiles, tight, same_label, k, home=False)

    top = F.lit(2 * index.square + 1).cast("long")
    near = both_rounds(members.withColumn("windows", F.array(F.struct(F.lit(0).alias("w"), (-top).alias("low"), top.alias("high")))), True, n_positives + 1)
    bands = near.where("score >= 0").select("query", "score").distinct().withColumn("w", F.row_number().over(Window.partitionBy("query").orderBy("score")))
    bands = materialize(bands.withColumn("low", F.expr(f"(score * {low} + 99) div 100")).withColumn("high", F.expr(f"score * {high} div 100")), "bands")
    windows = bands.groupBy("query").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows")).join(members, "query").select("tile", "query", "windows")
    far = both_rounds(materialize(windows, "windows"), False, n_negatives)
    best = lambda df, *keys: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))  # noqa: E731  at most k rows each
    negatives = bands.select("query", "w", F.col("score").alias("positive_score")).join(best(far, "query", "w"), ["query", "w"]).select("query", "positive_score", F.col("best").alias("negatives"))
    asked = anchors.join(queries.withColumnRenamed("id", "query"), ["label", "v"]).select(F.col("id").alias("anchor_id"), "query")
    own = asked.join(best(near, "query"), "query").select("anchor_id", "query", F.explode(F.slice(F.filter("best", lambda x: x["id"] != F.col("anchor_id")), 1, n_positives)).alias("p"))
    full = own.select("anchor_id", "query", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("positive_score")).join(negatives, ["query", "positive_score"])
    full = full.select("anchor_id", "positive_id", "positive_score", F.posexplode("negatives").alias("_k", "n"))
    out = materialize(full.select("anchor_id", "positive_id", (F.col("_k") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score")), "negatives")
    index.close()
    discard(clean, queries, tiles, members, near, bands, far)
    return out


def _members(tiles: DataFrame) -> DataFrame:
    def read(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["tile"]] * len(ids), pa.int64()), pa.array(ids)], names=["tile", "query"])

    return tiles.select("tile", "ids").mapInArrow(read, "tile long, query long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: rows whose vec_id is divisible by 100; every seventh label is moved on; components are floor(256 x)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS own, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS s FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scores WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5),
hits AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.s DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
    FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.own AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT * FROM hits WHERE rank <= 10
"""
