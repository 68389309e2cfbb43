"""What spans ranges of rows: neighbours, curves, bins of several levels, block errors, clusters, null keys, scratch folders."""

import collections
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionfx import storage
from regionfx.operators import joins, sampling, statistics, windows
from regionfx.plans import features, links, models
from regionfx.sources import tables
from tests.plans import made_rows, shuffled_rows


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture
def ranges_only(monkeypatch):
    monkeypatch.setattr(sampling, "SMALL_BYTES", -1)


def test_ranges_equal_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2])) for i in range(500)] + [("one", 1, 7)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    both = [[f(small) for small in (True, False)] for f in (
        lambda s: sampling.neighbours(df, ["k"], "o", after={"n": "v", "no": "o"}, before={"p": "v"}, small=s),
        lambda s: sampling.neighbours(df, [], "o", before={"p": "o"}, small=s).where("o <> 1"),
        lambda s: sampling.numbered(df, "o", "n", ["k"], small=s),
        lambda s: sampling.running_sums(df.withColumn("w", F.coalesce("v", F.lit(0))), ["k"], "o", {"s": "w"}, small=s),
    )]
    for a, b in both:
        assert _rows(a) == _rows(b) and a.columns == b.columns
    by_key = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        by_key[r[0]].append(r)
    want = [(*r, *(x[i + 1][:0:-1] if i + 1 < len(x) else (None, None)), x[i - 1][2] if i else None) for x in by_key.values() for i, r in enumerate(x)]
    assert _rows(both[0][1]) == sorted(map(str, want))
    assert sampling.neighbours(df.limit(0), ["k"], "o", after={"n": "v"}, small=False).isEmpty()


def test_long_curve_is_spread_over_tasks(spark, ranges_only):
    n = 2_000_000
    score = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) * (1 << 22) + F.col("id")  # all different
    df = spark.range(n).select(F.lit(1).alias("fold"), score.alias("s"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(100)) < 30 + F.col("s") / float(1 << 62) * 40).cast("int").alias("y"))
    with storage.scratch(spark):
        got = statistics.roc_on_grid(df, "s", "y", ["fold"])
        parts = got.sparkSession.read.parquet(*[f"{storage.shared_root(spark)}/{p}" for p in os.listdir(storage.shared_root(spark).removeprefix("file:")) if p.startswith("ranges-")][-1:])
        assert parts.select("_part").distinct().count() >= 4
        got = {r["g"]: r["tpr"] for r in got.collect()}
    data = df.select("s", "y").toPandas()
    y = data["y"].to_numpy()[np.argsort(-data["s"].to_numpy())]
    tpr, fpr = np.cumsum(y) / y.sum(), np.cumsum(1 - y) / (1 - y).sum()
    at, first = np.unique(np.append(0.0, fpr), return_index=True)
    top = np.maximum.reduceat(np.append(0.0, tpr), first)
    want = np.interp(np.arange(100) / 99, at, top)
    assert len(got) == 100 and got[0] == 0
    assert all(math.isclose(got[g], want[g], abs_tol=1e-6) for g in range(1, 100))


def test_runs_of_long_strings(spark, ranges_only):
    rng = random.Random(2)
    pairs = [(k, "".join(rng.choice("ab-") if rng.random() < 0.1 else "a" for _ in range(n)), "".join("-" if rng.random() < 0.05 else "b" for _ in range(n))) for k, n in enumerate([0, 1, 5, 3000])]
    want = []
    for k, a, b in pairs:
        for both, run in itertools.groupby(range(len(a)), key=lambda i: a[i] != "-" and b[i] != "-"):
            run = list(run)
            if both and len(run) >= 5:
                place = lambda s, i: len(s[: i + 1].replace("-", ""))
                want.append((k, place(a, run[0]), place(a, run[-1]), place(b, run[0]), place(b, run[-1])))
    df = spark.createDataFrame([*pairs, (9, None, "abc")], "k int, a string, b string")
    assert _rows(windows.aligned_segments(df, "k", "a", "b")) == sorted(map(str, want))


def test_intervals_of_mixed_lengths(spark):
    rng = random.Random(3)
    intervals = [(rng.choice("kl"), s := rng.uniform(-1e6, 1e6), s + 10 ** rng.uniform(-1, 6), i) for i in range(300)]
    intervals += [("k", 5.0, 5.0, 1000), ("k", 5.0, 4.0, 1001), (None, 0.0, 9.0, 1002), ("k", None, 9.0, 1003), ("k", -1e6, 1e6, 1004)]
    points = [(i, rng.choice(["k", "l", None]), rng.uniform(-1e6, 1e6)) for i in range(800)] + [(9000, "k", 5.0), (9001, "k", None)] + [(10_000 + i, "k", 77.0) for i in range(50)]
    p = spark.createDataFrame(points, "id int, key string, pos double")
    r = spark.createDataFrame(intervals, "key string, lo double, hi double, name int")
    levels = joins.interval_levels(r, "lo", "hi")
    assert 6 <= len(levels) <= joins.MOST_LEVELS
    got = joins.point_in_region(p, r, "key", "pos", "lo", "hi", bin_width="levels")
    want = [(i, n) for i, k, x in points for l, a, b, n in intervals if k and k == l and None not in (a, b, x) and a <= x <= b]
    assert _rows(got.select("id", "name")) == sorted(map(str, want))
    assert made_rows(got, "Generate") <= 3 * len(intervals) + len(levels) * len(points)
    empty = joins.point_in_region(p, r.limit(0), "key", "pos", "lo", "hi", bin_width="levels")
    assert empty.isEmpty()


def test_block_errors_shuffle_rows_once(spark):
    n = 50_400  # 108 divisors
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, n)
    df = spark.createDataFrame([(None, i, n, float(v), 1.0 + i % 3) for i, v in enumerate(x)], "s string, t long, n long, x double, w double")
    found = windows.block_average_error(df, "s")
    assert shuffled_rows(found) < 2 * n
    got = {r["blocks"]: (r["err"], r["err_err"]) for r in found.collect()}
    for d in (d for d in range(2, n + 1) if n % d == 0):
        err = math.sqrt(x.reshape(d, -1).mean(1).var() / (d - 1))
        assert math.isclose(got[d][0], err, rel_tol=1e-6) and math.isclose(got[d][1], err / math.sqrt(2 * (d - 1)), rel_tol=1e-6)
    assert len(got) == 107
    w, span = 1.0 + np.arange(n) % 3, (1e6 - 1.5, 1e6 + 2.0)
    whole, edges = np.histogram(x, bins=50, range=span, weights=w)
    got = {r["blocks"]: r["err"] for r in windows.block_hist_error(df, "s", kt=2.0, interval=span).collect()}
    for d in (2, 3, 7, 60, 2520, 25_200):
        each = np.array([np.histogram(a, bins=edges, weights=b)[0] / (n // d) for a, b in zip(x.reshape(d, -1), w.reshape(d, -1), strict=True)])
        u = whole / n
        e = 2.0 * np.sqrt(((each - u) ** 2).sum(0)[u > 0] / (d * (d - 1))) / u[u > 0]
        assert math.isclose(got[d], e.mean(), rel_tol=1e-6)


def test_clusters_by_pivots(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (60, 32))
    x = np.concatenate([c + rng.normal(0, 0.05, (12, 32)) for c in centres])
    x = np.concatenate([x, x[:40], rng.normal(0, 60, (50, 32))])
    keys = [int(k) for k in rng.permutation(len(x))]
    df = spark.createDataFrame([*zip(keys, x.tolist(), strict=True), (5000, None), (None, x[0].tolist())], "k long, v array<double>")
    eps = 0.5
    distinct = df.where("k is not null and v is not null").groupBy("v").agg(F.min("k").alias("k"))
    candidates = models.epsilon_candidates(distinct, eps).count()
    n = distinct.count()
    assert candidates < 0.05 * n * (n - 1) / 2
    gap = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    label = dict(zip(keys, keys, strict=True))
    for _ in range(40):
        for i in range(len(x)):
            label[keys[i]] = min(label[keys[j]] for j in np.flatnonzero(gap[i]))
    want = {k: label[k] if gap[i].sum() > 1 else -1 for i, k in enumerate(keys)}
    got = {r["k"]: r["cluster"] for r in models.dbscan_pairs(df, "k", "v", eps).collect()}
    assert got == {**want, 5000: -1, None: -1}
    assert models.dbscan_pairs(df.limit(0), "k", "v", eps).collect() == []


def test_long_paths_have_one_component(spark):
    order = list(range(1, 400))
    random.Random(1).shuffle(order)
    edges = [*zip(order, order[1:], strict=False), (1000, 1001), (1001, 1000), (2000, 2000)]
    got = {r["node"]: r["component"] for r in models.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 1 for k in order}, 1000: 1000, 1001: 1000, 2000: 2000}


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 4.0), ("a", None)], "k string, x double")
    assert _rows(windows.normalise_by_mean(df, "k", "x", "y").select("k", "y")) == sorted(["(None, 0.5)", "(None, 1.5)", "('a', 1.0)", "('a', None)"])
    assert _rows(windows.zscore(df, "k", "x", "z").select("k", "z")) == sorted(["(None, -1.0)", "(None, 1.0)", "('a', None)", "('a', None)"])
    assert windows.boltzmann_weights(df, "k", "x", 1.0).count() == 4
    density = df.withColumnRenamed("x", "density")
    assert windows.free_energy(density, "k", 1.0).count() == 4
    folds = features.group_kfold(df, "k", 2, 1)
    assert folds.count() == 4 and {r[0] for r in folds.select("fold").collect()} == {1, 2}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 95])
def test_share_of_groups_is_exact(spark, n):
    df = spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("k")).union(spark.range(n).select("id").where("id > 0"))
    keys = features.group_split(df, "k", 0.1, 3).groupBy("k").agg(F.count_distinct("is_test").alias("n"), F.first("is_test").alias("t")).collect()
    assert len(keys) == n and all(r["n"] == 1 for r in keys) and sum(r["t"] for r in keys) == math.ceil(0.1 * n)


def test_fasta_headers_may_hold_any_sign(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">sp|P1|A b->c binding\r\nMK\r\nVL\r\n>P2 x > y\r\n>P3\r\n\r\n>tr|P4|z\r\nA\r\n")
    (tmp_path / "b.fasta").write_text("\n>P5 a\nGG>\nAA\n")
    (tmp_path / "c.fasta").write_text("")
    got = tables.read_fasta(spark, str(tmp_path / "*.fasta"))
    assert _rows(got) == sorted(["('P1', 'MKVL')", "('P2', '')", "('P3', '')", "('P4', 'A')", "('P5', 'GG>AA')"])


def test_slices_far_from_the_start(spark, ranges_only):
    df = spark.range(50_000).select((F.col("id") * 7 % 50_000).alias("o"))
    assert sorted(r["o"] for r in sampling.batch_slice(df, "o", 40_001, 5).collect()) == [40_000, 40_001, 40_002, 40_003, 40_004]
    assert sampling.batch_slice(df, "o", 50_001, 5).isEmpty()


def test_scratch_folders_go(spark, ranges_only):
    root = storage.shared_root(spark).removeprefix("file:").replace("//", "/")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    with storage.scratch(spark):
        ranks = windows.avg_rank(df, "x", ["k"]).collect()
        assert set(os.listdir(root)) > before
    assert len(ranks) == 1000 and set(os.listdir(root)) == before


def test_size_check_reads_sizes_of_tables(spark, sf_dir, tmp_path):
    assert sampling.is_small(spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").count())
    assert not sampling.is_small(spark.createDataFrame([(1,)], "x int").rdd.toDF())


def test_matrices_are_read_line_by_line(spark, tmp_path):
    for k in range(2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "same.csv").write_bytes(b"aa,x%d,y\r\nr1,1,2\r\n\r\nr2,no,4,5\r\nr3,6\r\n" % k)
    (tmp_path / "1" / "head.csv").write_text("aa,z\n")
    (tmp_path / "1" / "none.csv").write_text("")
    got = tables.matrix_to_long(spark, f"{tmp_path}/*/*.csv")
    want = [("same.csv", r, c, v) for k in range(2) for r, c, v in (("r1", f"x{k}", 1.0), ("r1", "y", 2.0), ("r2", f"x{k}", None), ("r2", "y", 4.0), ("r2", None, 5.0), ("r3", f"x{k}", 6.0))]
    assert _rows(got) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["t4_spearman", "t2_mean_roc", "w11_block_average_error", "m14_dbscan_pruned", "m10_saturation_by_region"])
def test_queries_leave_nothing_in_a_scope(spark, sf_dir, ranges_only, name):
    import __spark_entry__

    root = storage.shared_root(spark).removeprefix("file:").replace("//", "/")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    with storage.scratch(spark):
        __spark_entry__.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before


def test_clusters_of_many_close_points(spark):
    """Points of which each has hundreds of others within the radius: the links that are written are fewer than the points."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 1, (1500, 2)), [[3.0, 3.0], [3.0, 3.5], [9.0, 9.0]]])
    eps = 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    links = models.tied_points(df, eps, [[0.0, 0.0], [1.0, 0.0]])
    assert links.count() < len(x)
    got = {r["k"]: r["cluster"] for r in models.dbscan_pairs(df, "k", "v", eps).collect()}
    assert got == dict.fromkeys(range(1500), 0) | {1500: 1500, 1501: 1500, 1502: -1}


@pytest.mark.parametrize("small", [True, False])
def test_first_interval_without_pairs(spark, monkeypatch, small):
    """Bounds that meet, empty and turned intervals, nulls, and far more intervals around each point than rows are made."""
    monkeypatch.setattr(sampling, "SMALL_BYTES", sampling.SMALL_BYTES if small else 0)
    rng = random.Random(3)
    intervals = [(rng.choice("ab"), x := rng.randint(0, 40) / 2, x + rng.randint(-1, 30) / 2, f"i{n}", n) for n in rng.sample(range(300), 300)] + [(None, 0.0, 50.0, "none", 0), ("c", 1.0, 2.0, "late", None)]
    points = [(i, rng.choice("abd"), rng.randint(-4, 160) / 4) for i in range(300)] + [(900, None, 1.0), (901, "a", None), (902, "c", 1.5)]
    want = {}
    for i, k, x in points:
        hit = [r for r in intervals if None not in (k, x) and r[0] == k and r[1] <= x <= r[2]]
        r = min(hit, key=lambda r: (r[4] is None, r[4]), default=(None, None, None, "No", None))
        want[i] = (k, x, r[3], r[1], r[2])
    p = spark.createDataFrame(points, "id long, key string, pos double")
    q = spark.createDataFrame(intervals, "key string, lo double, hi double, kind string, ord long")
    got = joins.annotate_first_interval(p, q, "key", "pos", "lo", "hi", "kind", "ord", "id", "No", bin_width="levels")
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want
    assert not made_rows(got, "Join") and made_rows(got, "SortMergeJoin") < 300 * 40


def test_aligned_segments_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "ab-cdéfgh", "xy-zwvuts"), (2, "", ""), (3, "a" * 6, "b" * 9), (4, "-----😀abcde", "abcde😀abcde"), (5, None, "abcdef")], "k long, a string, b string")
    got = windows.aligned_segments(df, "k", "a", "b")
    assert shuffled_rows(got) == 0
    assert sorted(map(tuple, got.collect())) == [(1, 3, 8, 3, 8), (3, 1, 6, 1, 6), (4, 1, 6, 6, 11)]


@pytest.mark.parametrize("name", ["m6_train_classifier", "m8_predict", "s11_save_load_model"])
def test_fits_read_texts_once(spark, sf_dir, name):
    import __spark_entry__

    assert not [f for f in __spark_entry__.queries()[name](spark, sf_dir).inputFiles() if "documents" in f]


def test_close_pairs_at_the_radius():
    """Far from the origin a product of the vectors loses the last digits; pairs at the radius are as sums term by term say."""
    from regionfx.plans.links import close

    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (300, 8)) / 4 + 1e4
    i, j = close(x, x, 1.25)
    want = (((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= 1.25**2).nonzero()
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(want[0].tolist(), want[1].tolist()))


@pytest.mark.parametrize("shape", ["one cluster", "many clusters", "far apart"])
def test_pairs_inside_the_largest_cluster_are_left_out(spark, monkeypatch, shape):
    """Points that the pivots can't tell apart: few blocks are compared where most points are one cluster, all pairs where they aren't."""
    monkeypatch.setattr(links, "BLOCK", 16)
    monkeypatch.setattr(links, "MET", 2)
    monkeypatch.setattr(links, "FEW", 2)
    whole, seen = links._compared, []

    def compared(a, b, met, *rest):
        seen.append(met.count())
        return whole(a, b, met, *rest)

    monkeypatch.setattr(links, "_compared", compared)
    rng = np.random.default_rng(9)
    if shape == "many clusters":
        centres = rng.normal(0, 1, (40, 24))
        x = np.concatenate([c / np.linalg.norm(c) + rng.normal(0, 0.01, (12, 24)) for c in centres])
        eps = 0.2
    else:
        x = rng.normal(0, 1, (480, 12 if shape == "one cluster" else 40))
        x /= np.linalg.norm(x, axis=1)[:, None]
        eps = 1.1 if shape == "one cluster" else 0.7
    x = np.concatenate([x, x[:3], 3 * x[5:6], 3 * x[5:6] + 1e-3])
    keys = [int(k) for k in rng.permutation(len(x))]
    df = spark.createDataFrame([*zip(keys, x.tolist(), strict=True), (5000, [1.0]), (5001, [1.5]), (5002, [9.0])], "k long, v array<double>")
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    label = np.array(keys)
    while (label != (least := np.where(near, label[None], 10**6).min(axis=1))).any():
        label = least
    want = {k: int(label[i]) if near[i].sum() > 1 else -1 for i, k in enumerate(keys)}
    got = {r["k"]: r["cluster"] for r in models.dbscan_pairs(df, "k", "v", eps).collect()}
    assert got == {**want, 5000: 5000 if eps >= 0.5 else -1, 5001: 5000 if eps >= 0.5 else -1, 5002: -1}
    n = math.ceil(len(x) / 16)
    assert len(seen) > 2
    assert shape != "one cluster" or sum(seen) < n * (n + 1) / 4
