"""Tiled products, shared-out densities and name matching against plain Python, and what they shuffle."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionfx.operators import aggregates, windows
from regionfx.sources import tables
from tests.plans import nodes, shuffled_rows


def test_covariance_in_tiles(spark):
    rng = np.random.default_rng(2)
    rows = []
    for e in range(23):
        for f in range(40):
            if rng.random() < 0.8:
                rows.append((f"e{e:02}", f, *(float(v) if rng.random() < 0.95 else None for v in 1e5 + rng.normal(size=2))))
    rows += [(None, 1, 1.0, 2.0), ("e01", None, 1.0, 2.0), ("alone", 999, 1.0, 1.0), rows[0]]
    df = spark.createDataFrame(rows, "e string, f int, x double, y double")
    got = {(r["a"], r["b"]): r["cov"] for r in aggregates.pair_covariance(df, "e", "f", ["x", "y"], tile=5).collect()}
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for e, f, *v in rows:
        if e is not None and f is not None:
            by[e][f].append(v)
    want = {}
    for a in by:
        for b in by:
            pairs = [(p, q) for f in by[a] for p in by[a][f] for q in by[b].get(f, [])] if a <= b else []
            if pairs:
                parts = []
                for i in range(2):
                    both = np.array([(p[i], q[i]) for p, q in pairs if p[i] is not None and q[i] is not None]).reshape(-1, 2)
                    parts.append(np.cov(both.T)[0, 1] if len(both) > 1 else None)
                want[a, b] = None if None in parts else sum(parts)
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else math.isclose(got[k], v, abs_tol=1e-6) for k, v in want.items())


def test_tiles_shuffle_less_than_pairs(spark):
    n, frames = 60, 50
    df = spark.range(n * frames).select((F.col("id") % n).alias("e"), F.floor(F.col("id") / n).alias("f"), F.rand(1).alias("x"))
    found = aggregates.pair_covariance(df, "e", "f", ["x"])
    assert found.count() == n * (n + 1) / 2
    pairs = frames * n * (n + 1) / 2
    assert shuffled_rows(found) < pairs / 4
    assert shuffled_rows(aggregates.distance_by_separation(df, "f", "e", ["x"])) < pairs / 8


@pytest.mark.parametrize("tile", [3, 64])
def test_distances_by_separation_in_tiles(spark, tile):
    rng = np.random.default_rng(5)
    rows = [(f, p, *map(float, 1e3 + rng.normal(size=2))) for f in range(3) for p in range(-7, 40) if rng.random() < 0.8]
    rows += [(0, 3, 1000.5, 999.0), (None, 1, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 2, None, 0.0)]
    df = spark.createDataFrame(rows, "f int, p int, x double, y double")
    sums = collections.defaultdict(list)
    good = [r for r in rows if None not in r]
    for a in good:
        for b in good:
            if a[0] == b[0] and b[1] - a[1] >= 2:
                sums[b[1] - a[1]].append((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
    got = {r["separation"]: r["rms"] for r in aggregates.distance_by_separation(df, "f", "p", ["x", "y"], tile=tile).collect()}
    assert got.keys() == sums.keys() and all(math.isclose(got[k], math.sqrt(np.mean(v)), rel_tol=1e-6) for k, v in sums.items())


def test_shared_out_densities_keep_their_bound(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(x)) for g, s in (("a", 1.0), ("b", 30.0), (None, 0.1)) for x in rng.normal(0, s, 2000)] + [("one", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    exact = {(r["g"], round(r["x"], 9)): r["density"] for r in aggregates.kde_1d(df, "g", "x").collect()}
    for fine in (32, 512):
        near = {(r["g"], round(r["x"], 9)): r["density"] for r in aggregates.kde_1d(df, "g", "x", fine=fine).collect()}
        assert near.keys() == exact.keys() and {k[0] for k in exact} == {"a", "b", None}
        for g in ("a", "b", None):
            x = np.array([r[1] for r in rows if r[0] == g and r[1] is not None])
            bound = aggregates.binned_error(x.max() - x.min(), x.std(ddof=1) * len(x) ** -0.2, fine)
            gap = max(abs(near[k] - exact[k]) for k in exact if k[0] == g)
            assert gap <= bound * (1 + 1e-9)
    few, many = (shuffled_rows(aggregates.kde_1d(spark.range(n).select(F.lit("a").alias("g"), F.rand(3).alias("x")), "g", "x", fine=64)) for n in (20_000, 200_000))
    assert many < 1.2 * few


def test_block_densities_shared_out(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("s", i, 1000, float(x)) for i, x in enumerate(rng.normal(size=1000))], "s string, t long, n long, x double")
    exact, near = ({round(r["x"], 9): (r["density"], r["error"]) for r in windows.block_density_error(df, "s", fine=fine).collect()} for fine in (None, 2000))
    assert exact.keys() == near.keys() and all(np.allclose(exact[k], near[k], atol=1e-5) for k in exact)


def test_names_that_hold_parts(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd_") for _ in range(n))
    files = [(word(rng.randint(0, 12)), i) for i in range(400)] + [(None, 900), ("aaaa", 901), ("aaaa", 901)]
    parts = [(word(rng.randint(1, 5)), i) for i in range(80)] + [("", 500), (None, 501), ("zzz", 502), ("aaa", 503), ("aaa", 504)]
    f, w = spark.createDataFrame(files, "name string, i int"), spark.createDataFrame(parts, "part string, j int")
    for must in (None, "a"):
        got = tables.match_files(f, w, "name", "part", must)
        want = [(n, i, p, j) for n, i in files for p, j in parts if n is not None and p and p in n and (must or "") in n]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert tables.match_files(f, w.limit(0), "name", "part").isEmpty() and tables.match_files(f.limit(0), w, "name", "part").isEmpty()


def test_many_parts_meet_many_names_by_key(spark):
    n = 100_000
    files = spark.range(n).select(F.concat(F.lit("run_"), F.sha2(F.col("id").cast("string"), 256).substr(1, 20), F.lit(".csv")).alias("name"))
    parts = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).substr(4, 10).alias("part"))
    got = tables.match_files(files, parts, "name", "part")
    assert got.count() == n
    names = [node.getClass().getSimpleName() for node in nodes(got._jdf.queryExecution().executedPlan())]
    assert not [x for x in names if "NestedLoop" in x or "Cartesian" in x]


def test_terms_against_the_rest(spark):
    from regionfx.operators import statistics

    rng = random.Random(8)
    for k in (2, 5):
        rows = [(rng.choice("abcdefgh"), rng.randrange(k)) for _ in range(400)] + [("x", 0)] * 30 + [("y", k - 1)] * 25 + [(None, 1), ("a", None)]
        df = spark.createDataFrame(rows, "t string, c int")
        got = {r["term"]: r for r in statistics.one_vs_rest_chi2(df, "t", "c", 6, alpha=2.0).collect()}
        good = [r for r in rows if None not in r]
        cells, terms, whole = collections.Counter(good), collections.Counter(t for t, _ in good), collections.Counter(c for _, c in good)
        assert got.keys() == {t for t, _ in sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:6]}
        for t, r in got.items():
            table = np.array([[cells[t, c] for c in whole], [whole[c] - cells[t, c] for c in whole]], float)
            expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
            gap = np.abs(table - expected)
            gap -= np.minimum(0.5, gap) * (k == 2)
            assert r["dof"] == k - 1 and math.isclose(r["chi2"], (gap**2 / expected).sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_summaries_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 6.0), ("a", None, 1.0), (None, 5.0, None)], "g string, x double, y double")
    rows = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert rows(aggregates.mean_with_sem(df, "g", "x")) == ["('a', 2, 2.0, 1.0)", "(None, 1, 5.0, None)"]
    assert rows(aggregates.histogram(df, "x", 2, "g")) == ["('a', 0, 1)", "('a', 1, 1)", "(None, 1, 1)"]
    assert rows(aggregates.hist_2d(df, "x", "y", 2, "g")) == ["(0, 0, 'a', 1)", "(1, 1, 'a', 1)"]
    assert aggregates.linear_fit(df, "x", "y", "g").where("g = 'a'").first()["slope"] == 2.0
    assert rows(aggregates.end_to_end(df, "g", "x", ["y"])) == ["('a', 4.0)", "(None, None)"]
    empty = df.limit(0)
    for d in (aggregates.mean_with_sem(empty, "g", "x"), aggregates.histogram(empty, "x", 2, "g"), aggregates.hist_2d(empty, "x", "y", 2, "g"), aggregates.linear_fit(empty, "x", "y", "g"), aggregates.end_to_end(empty, "g", "x", ["y"]), aggregates.kde_1d(empty, "g", "x"), aggregates.pair_covariance(empty, "g", "x", ["y"])):
        assert d.collect() == []
