"""Queries that SQL doesn't express, against values worked out row by row."""

import collections
import math
import statistics as stats

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regionfx.plans import features, models
from regionfx.queries import models as queries


@pytest.fixture(scope="module")
def table(sf_dir):
    return lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: [r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()]


def _series(table):
    out = collections.defaultdict(list)
    for e in sorted(table("events"), key=lambda e: (e["ts"], e["event_id"])):
        out[e["event_type"]].append(e["value"])
    return out


def test_shuffle_and_samples(spark, run, table):
    got = [r["o_orderkey"] for r in run("l3_seeded_shuffle")]
    keys = [o["o_orderkey"] for o in table("orders")]
    assert len(set(got)) == min(800, len(keys)) and set(got) <= set(keys) and got != sorted(got)
    order = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.xxhash64("k", F.lit(42))).collect()}
    assert got == sorted(keys, key=lambda k: (order[k], k))[:800]
    own = collections.defaultdict(list)
    for e in table("events"):
        own[e["user_id"]].append(e["event_id"])
    ids = spark.createDataFrame([(e,) for x in own.values() for e in x], "e long").select("e", F.xxhash64("e", F.lit(7)))
    order = dict(map(tuple, ids.collect()))
    want = set()
    for user, x in own.items():
        late = sorted(x)[math.floor(len(x) * 0.02) :]
        want |= {(user, e) for e in sorted(late, key=lambda e: (order[e], e))[:20]}
    assert {(r["user_id"], r["event_id"]) for r in run("l5_burn_in_sample")} == want


def test_group_split(run, table):
    rows = run("m5_group_split")
    sides = collections.defaultdict(set)
    for r in rows:
        sides[r["o_custkey"]].add(r["is_test"])
    assert len(rows) == len(table("orders")) and all(len(s) == 1 for s in sides.values())
    assert sum(s == {True} for s in sides.values()) == math.ceil(0.1 * len(sides))


def test_one_vs_rest(run, table):
    parts = [(p["p_type"], p["p_size"] > 25) for p in table("part")]
    whole, cells = collections.Counter(c for _, c in parts), collections.Counter(parts)
    top = sorted(collections.Counter(t for t, _ in parts).items(), key=lambda x: (-x[1], x[0]))[:10]
    got = {r["term"]: r for r in run("t6_one_vs_rest_chi2")}
    assert got.keys() == {t for t, _ in top}
    for term, n in top:
        want = 0.0
        for c in whole:
            for o, row in ((cells[term, c], n), (whole[c] - cells[term, c], len(parts) - n)):
                e = row * whole[c] / len(parts)
                gap = abs(o - e)
                want += (gap - min(0.5, gap)) ** 2 / e
        assert math.isclose(got[term]["chi2"], want, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[term]["p"], math.erfc(math.sqrt(want / 2)), rel_tol=1e-6)


def test_block_errors(run, table):
    series = _series(table)
    for r in run("w13_block_hist_error"):
        x = np.array(series[r["series"]])
        n, blocks, w = len(x), r["blocks"], 1 + x % 2
        whole, edges = np.histogram(x, bins=20, weights=w)
        each = np.array([np.histogram(a, bins=edges, weights=b)[0] / (n // blocks) for a, b in zip(x.reshape(blocks, -1), w.reshape(blocks, -1), strict=True)])
        u = whole / n
        e = 2.479 * np.sqrt(((each - u) ** 2).sum(0)[u > 0] / (blocks * (blocks - 1))) / u[u > 0]
        assert n % blocks == 0 and math.isclose(r["err"], e.mean(), abs_tol=1e-6) and math.isclose(r["err_err"], e.mean() / math.sqrt(2 * (blocks - 1)), abs_tol=1e-6)
    found = collections.defaultdict(list)
    for r in run("w15_block_density"):
        found[r["series"]].append((r["x"], r["density"], r["error"], r["free_energy"]))
    means = {r["series"]: r for r in run("w15_mean_with_error")}
    for s, rows in found.items():
        x = np.array(series[s])
        n, blocks = len(x), 5
        block = np.minimum(np.arange(n) * blocks // n, blocks - 1)
        h = np.std(x, ddof=1) * (n / blocks) ** -0.2
        at = np.linspace(x.min(), x.max(), 20)
        d = np.array([[np.exp(-0.5 * ((a - x[block == b]) / h) ** 2).mean() / (h * math.sqrt(2 * math.pi)) for b in range(blocks)] for a in at])
        mean, error = d.mean(1), d.std(1, ddof=1) / math.sqrt(blocks)
        energy = -2.479 * np.log(mean / mean.max())
        for (gx, gd, ge, gf), wx, wd, we, wf in zip(sorted(rows), at, mean, error, energy, strict=True):
            assert np.allclose((gx, gd, ge), (wx, wd, we), rtol=1e-9)
            assert gf is None if wf > 15 else math.isclose(gf, wf, abs_tol=1e-9)
        assert math.isclose(means[s]["mean"], (at * mean).sum() / mean.sum(), rel_tol=1e-9)
        assert math.isclose(means[s]["mean_error"], math.sqrt(((at * error) ** 2).sum()) / mean.sum(), rel_tol=1e-9)


def test_region_profile(spark):
    rng = np.random.default_rng(3)
    rows = [(int(e), int(f), "ab"[int(rng.integers(2))], *map(float, rng.normal(size=5))) for e in range(3) for f in range(120)]
    df = spark.createDataFrame(rows, "e long, f long, s string, area double, phi double, x double, y double, z double")
    for r in features.region_profile(df, "e", "f", "s", ["a", "b", "c"], "area", ["phi"], list("xyz"), k=10_000).collect():
        late = [w for w in rows if w[0] == r["e"] and w[1] >= 2]
        area = [w[3] for w in late]
        xyz = np.array([w[5:] for w in late])
        hist, _ = np.histogram([w[4] for w in late], bins=12, range=(-math.pi, math.pi))
        want = [stats.fmean(area), stats.pstdev(area), math.sqrt(xyz.var(0).sum()), *[sum(w[2] == c for w in late) / len(late) for c in "abc"], *(hist / hist.sum())]
        assert np.allclose(r["profile"], want)


def test_site_features(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("aestrk-"), 24)) for _ in range(30)]
    msa = spark.createDataFrame([("p", s) for s in seqs] + [("p", "short")], "protein string, seq string")
    sites = spark.createDataFrame([("p", 3), ("p", 12), ("p", 22)], "protein string, site int")
    clusters = ["ae", "st"]
    for r in features.msa_site_features(sites, msa, "protein", "site", "seq", "ae", "st", clusters, "st").collect():
        letters = [s[r["site"]] for s in seqs]
        assert math.isclose(r["p_set"], sum(c in "st" for c in letters) / 30)
        n = collections.Counter(c for c in letters if c != "-")
        assert math.isclose(r["site_entropy"], -sum(v / n.total() * math.log2(v / n.total()) for v in n.values()), abs_tol=1e-9)
        i, h = r["site"], 9
        ctx = [s[i - h : i] + s[i + 1 : i + h + 1] if h <= i < 24 - h else s[:h] + s[h + 1 : 19] if i < h else s[5:14] + s[15:] for s in seqs]
        v = np.array([[sum(c in k for c in x) for k in clusters] for x in ctx], float)
        v = v[np.linalg.norm(v, axis=1) > 0]
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        cos = u @ u.T
        assert math.isclose(r["mean_cosine"], cos[np.triu_indices(len(u), 1)].mean(), rel_tol=1e-6)


def test_scores_out_of_fold(spark, sf_dir):
    t = queries.materialize(queries._training(spark, sf_dir), "training")
    few = {k: models.CLASSIFIERS[k] for k in ("AAIndex", "Res_Pair")}
    got = {r["doc_id"]: r for r in models.out_of_fold_scores(t, "fold", few, "label", 5, **queries.FAST).collect()}
    assert got.keys() == {r["doc_id"] for r in t.select("doc_id").collect()}
    own = models.train_classifier(t.where("fold <> 2"), models.feature_columns(t, few["Res_Pair"]), "label", **queries.FAST)
    for r in models.predict(own, t.where("fold = 2"), "p").collect():
        assert math.isclose(got[r["doc_id"]]["Res_Pair"], r["p"], abs_tol=1e-12)
    assert models.feature_columns(t, ["residue_aa"]) == ["Res_AA_1", "Res_AA_2"] and models.feature_columns(t, ["length"]) == ["Region Length"]
    both = models.score_ensemble(spark.createDataFrame([(0.25, 0.75), (None, 0.5), (None, None)], "a double, b double"), ["a", "b"], "m")
    assert [r["m"] for r in both.collect()] == [0.5, 0.5, None]


def test_clusters_and_projections(run, table):
    vectors = np.array([e["embedding"] for e in table("embeddings")])
    ids = [e["vec_id"] for e in table("embeddings")]
    pc = {r["vec_id"]: r["pc"] for r in run("m12_pca")}
    centred = vectors - vectors.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    want = centred @ axes[:5].T
    got = np.array([pc[i] for i in ids])
    signs = np.sign((got * want).sum(0))
    assert np.allclose(got * signs, want, atol=1e-4)
    found = {r["vec_id"]: r["cluster"] for r in run("m13_kmeans")}
    assert found.keys() == set(ids) and len(set(found.values())) == 4
    own = np.array([found[i] for i in ids])
    centres = np.array([vectors[own == k].mean(0) for k in sorted(set(own))])
    near = ((vectors[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (near == np.searchsorted(sorted(set(own)), own)).mean() > 0.9


def test_power_law(spark):
    from regionfx.operators.aggregates import power_law_fit

    rows = [(k, float(x), 0.5 * k * x**0.6) for k in (1, 2) for x in range(1, 60)] + [(3, 9.0, 1.0)]
    got = {r["k"]: r for r in power_law_fit(spark.createDataFrame(rows, "k int, x double, y double"), "k", "x", "y").collect()}
    assert math.isclose(got[2]["r0"], 1.0, rel_tol=1e-6) and math.isclose(got[1]["nu"], 0.6, rel_tol=1e-6) and got[3]["nu"] is None


def test_permutation_importance(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=1500), rng.normal(size=1500)
    df = spark.createDataFrame([(i, float(x), float(y), float(x > 0)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "k long, a double, b double, label double")
    model = models.train_classifier(df, ["a", "b"], "label", trees=10, depth=4)
    got = {r["feature"]: r["drop"] for r in models.permutation_importance(model, df, ["a", "b"], "label", "k", repeats=3).collect()}
    assert 0.35 < got["a"] < 0.6 and abs(got["b"]) < 0.05
