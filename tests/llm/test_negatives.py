"""Hard negatives: whole results against brute force, and what the tree leaves out."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from regionfx.llm import negatives


def _brute(rows, n_positives=5, n_negatives=10):
    """rows: (id, label, vector of whole numbers), distinct."""
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, vb, strict=False)), b, lb) for b, lb, vb in rows if b != a)
        for s, p, lp in [x for x in scores if x[2] == la][:n_positives]:
            hits = [(x, b) for x, b, lb in scores if lb != la and 30 * -s <= 100 * -x <= 90 * -s]
            out += [(a, p, k + 1, b, -s, -x) for k, (x, b) in enumerate(hits[:n_negatives])]
    return sorted(out)


@pytest.fixture(scope="module")
def table():
    """Clusters, a vector that a third of all rows share, ties, nulls, components that aren't finite."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist() if i % 3 else [0.5, 0.25, -0.125, 0.0, 1.0, 0.5, 0.5, -0.5]
        rows.append([i, int(rng.integers(0, 4)) if i % 3 else i // 3 % 2, [float(x) for x in v]])
    rows[10][1] = None
    rows[20][2] = None
    rows[31][2][3] = float("nan")
    rows[41][2][0] = float("-inf")
    rows[100][2] = [0.0] * 8
    rows.append([None, 1, [1.0] * 8])
    rows.append([rows[50][0], rows[50][1], list(rows[50][2])])
    rows.append([2000, 9, [0.1] * 8])
    rows.append([2001, 9, []])
    rows.append([2002, 1, [0.5, None, 0.5]])
    return rows


def test_op11_hard_negatives(spark, table, tmp_path):
    t = pa.table({"vec_id": pa.array([r[0] for r in table], pa.int64()), "embedding": pa.array([r[2] for r in table], pa.list_(pa.float32())), "label": pa.array([r[1] for r in table], pa.int32()), "query": ["x"] * len(table), "id": [0] * len(table)})
    pq.write_table(t, tmp_path / "embeddings.parquet")
    rows = set()
    for i, label, v in zip(t["vec_id"].to_pylist(), t["label"].to_pylist(), t["embedding"].to_pylist(), strict=True):
        if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v):
            rows.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * x)) for x in v)))
    got = negatives.op11_hard_negatives(spark, str(tmp_path)).collect()
    want = _brute(sorted(rows))
    assert len(want) > 100
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == want


def test_small_blocks_and_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), [int(x) for x in rng.integers(-(1 << 23), 1 << 23, 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>").repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, rows_per_block=16).collect()
    assert sorted(tuple(r) for r in got) == _brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, v array<long>")
    assert negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, 1, [5, 6])], "vec_id long, label int, v array<long>")
    assert negatives.hard_negatives(one, F.col("vec_id") % 100 == 0).collect() == []


def test_ranges_rule_out_leaves_and_lose_nothing():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-40, 40, (200, 6)) + c for c in rng.integers(-2000, 2000, (30, 6))]).astype(np.int64)
    square = int((x * x).sum(axis=1).max())
    tree = negatives.Tree(x[rng.permutation(len(x))[:2000]], square, 60)
    leaf = tree.leaf_of(x)
    tree.set_ranges([(k, *tree.distances(k, x[leaf == k])) for k in np.unique(leaf)])
    q, seen = x[::150], 0
    scores = negatives.scored(q, x, square)
    assert (scores == q @ x.T).all()
    high = np.sort(scores, axis=1)[:, -20]
    low = np.sort(scores, axis=1)[:, -60]
    routed = tree.route(q.astype(float), *tree.annulus(q.astype(float), low[:, None], high[:, None]))
    met = {(int(i), k) for k, rows in routed for i in rows}
    for i in range(len(q)):
        wanted = np.unique(leaf[(scores[i] >= low[i]) & (scores[i] <= high[i])])
        assert {(i, int(k)) for k in wanted} <= met
    seen = sum((leaf == k).sum() for _, k in met)
    assert seen < 0.4 * len(q) * len(x)
