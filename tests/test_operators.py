"""Hand-computed values, properties and plans."""

import math

import pytest
from pyspark.sql import functions as F

from regionfx.functions import pvalues, scalars
from regionfx.operators import aggregates, joins, sampling, statistics, windows
from regionfx.plans import features
from regionfx.sources import tables


def test_chi2_tail():
    assert pvalues.chi2_tail(2.7777778, 2) == pytest.approx(0.2493522, abs=1e-6)


def test_correlation_p():
    assert pvalues.correlation_p(0.8207827, 5) == pytest.approx(0.0885870, abs=1e-6)


def test_mann_whitney(spark):
    data = [("a", float(x)) for x in (19, 22, 16, 29, 24)] + [("b", float(x)) for x in (20, 11, 17, 12)] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    r = statistics.mann_whitney_pairs(df, "g", "v", exact_up_to=0).first()
    assert r["u"] == 17 and r["p"] == pytest.approx(0.1113469, abs=1e-6)
    assert statistics.mann_whitney_pairs(df, "g", "v").first()["p"] == pytest.approx(1 / 9)


def test_chi2_contingency(spark):
    data = [(r, c, n) for r, row in enumerate([[10, 10, 20], [20, 20, 20]]) for c, n in enumerate(row)]
    r = statistics.chi2_contingency(spark.createDataFrame(data, "r int, c int, n long"), "r", "c").first()
    assert (round(r["chi2"], 6), r["dof"]) == (2.777778, 2) and r["p"] == pytest.approx(0.2493522, abs=1e-6)


def test_spearman(spark):
    data = [("k", 1.0, 5.0), ("k", 2.0, 6.0), ("k", 3.0, 7.0), ("k", 4.0, 8.0), ("k", 5.0, 7.0), ("k", None, 1.0)]
    r = statistics.spearman(spark.createDataFrame(data, "k string, x double, y double"), "x", "y", ["k"]).first()
    assert r["rho"] == pytest.approx(0.8207827, abs=1e-6) and r["p"] == pytest.approx(0.0885870, abs=1e-6)


def test_auroc_of_the_negated_score(spark):
    df = spark.createDataFrame([(i % 7, int(i * i % 5 < 2)) for i in range(60)], "s int, y int").withColumn("n", -F.col("s")).withColumn("k", F.lit(1))
    a, b = (statistics.auroc(df, c, "y", ["k"]).first()["auroc"] for c in ("s", "n"))
    assert a + b == pytest.approx(1.0)


def test_lists_of_different_length_are_an_error(spark):
    df = spark.createDataFrame([(1, "a;b", "c")], "i int, x string, y string")
    with pytest.raises(Exception, match="differ in length"):
        scalars.split_explode_zipped(df, ["x", "y"]).collect()
    null = spark.createDataFrame([(1, None, None)], "i int, x string, y string")
    assert [tuple(r) for r in scalars.split_explode_zipped(null, ["x", "y"]).collect()] == [(1, None, None)]


def test_first_interval_in_order_and_default(spark):
    points = spark.createDataFrame([(1, "k", 5), (2, "k", 50), (3, None, 5)], "id int, key string, pos int")
    intervals = spark.createDataFrame([("k", 0, 9, "late", 2), ("k", 4, 6, "early", 1)], "key string, lo int, hi int, kind string, ord int")
    for width in (None, 3.0):
        out = joins.annotate_first_interval(points, intervals, "key", "pos", "lo", "hi", "kind", "ord", "id", "none", width)
        assert {r["id"]: r["annotation"] for r in out.collect()} == {1: "early", 2: "none", 3: "none"}


def test_pairwise_cosine_with_a_zero_vector(spark):
    vectors = [[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([("g", v) for v in vectors], "g string, v array<double>")
    expected = (1 / math.sqrt(2) + 0 + 0) / 3
    assert aggregates.mean_pairwise_cosine(df, "g", "v", 2).first()["mean_cosine"] == pytest.approx(expected)


def test_windows_at_the_ends(spark):
    df = spark.createDataFrame([("r", i, [float(i)]) for i in (1, 2, 3)], "region string, pos int, f array<float>")
    out = {r["pos"]: list(r["window"]) for r in windows.neighbour_window(df, "region", "pos", "f", 1, 1).collect()}
    assert out == {1: [0, 1, 2], 2: [1, 2, 3], 3: [2, 3, 0]}


def test_even_window_is_an_error():
    with pytest.raises(ValueError, match="odd"):
        scalars.context_window(F.lit("abc"), F.lit(1), 2)


def test_overlap_without_interval_is_zero(spark):
    df = spark.createDataFrame([(1, 10, None, None), (1, 10, 5, 20)], "a int, b int, c int, d int")
    out = [r[0] for r in df.select(scalars.interval_overlap_pct(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert out == [0.0, pytest.approx(5 / 9 * 100)]


def test_folds_keep_keys_together(spark):
    df = spark.createDataFrame([(i % 23, i) for i in range(200)], "k int, i int")
    out = features.group_kfold(df, "k", 5, 1)
    assert out.count() == 200
    assert out.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["n"] for r in out.groupBy("fold").agg(F.count_distinct("k").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1


def test_no_cartesian_product_in_the_flagship(spark, sf_dir):
    from regionfx.queries.tables import annotated

    plan = annotated(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_numbers_are_whole_over_many_ranges(spark):
    n = 2_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit("more").alias("further"), (F.col("id") % 7).cast("string").alias("row_no"))
    out = sampling.numbered(df, "k").agg(F.count_distinct("row_no"), F.min("row_no"), F.max("row_no")).first()
    assert tuple(out) == (n, 1, n)
    per = sampling.numbered(df, "k", keys=["g"]).groupBy("g").agg(F.count_distinct("row_no").alias("d"), F.count("*").alias("n"), F.max("row_no").alias("m")).collect()
    assert len(per) == 3 and all(r["d"] == r["n"] == r["m"] for r in per)
    folds = features.group_kfold(df.select("k", "further"), "k", 5, 1).groupBy("fold").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in folds) == [n // 5] * 5


def test_numbers_and_sums_with_nulls_and_ties(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 3, None), ("a", 1, 2), ("a", 2, 9), ("b", None, 4)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(3)
    got = {(r["g"], r["o"]): r["i"] for r in sampling.numbered(df, "o", "i", ["g"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", None): 1}
    sums = {(r["g"], r["o"]): r["s"] for r in sampling.running_sums(df, ["g"], "o", {"s": "x"}).collect()}
    assert sums == {(None, 1): 0, (None, 2): 5, ("a", 1): 0, ("a", 2): 2, ("a", 3): 11, ("b", None): 0}
    assert sampling.numbered(df.where("false"), "o").isEmpty() and sampling.running_sums(df.where("false"), ["g"], "o", {"s": "x"}).isEmpty()


def test_neighbour_windows_over_block_ends(spark):
    df = spark.createDataFrame([(r, p, [float(p)]) for r in "ab" for p in range(1, 24)], "r string, p int, f array<float>")
    for row in windows.neighbour_window(df, "r", "p", "f", 1, k=3, block=5).collect():
        assert row["window"] == [float(q) if 1 <= q <= 23 else 0.0 for q in range(row["p"] - 3, row["p"] + 4)]


def test_lengths_for_blocking(spark):
    count = lambda m: sum(m % b == 0 for b in range(2, m + 1))
    sizes = [1, 2, 100, 200, 240, 341, 342, 5041, 5100, 7561]
    df = spark.createDataFrame([(str(n),) for n in sizes], "s string").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("s").cast("int"))))
    for r in windows.trim_for_blocking(df, "s").collect():
        tries = [r["n"], *range(r["n"] - 1, max(r["n"] - 102, 0), -1)]
        assert r["trimmed"] == next((m for m in tries if count(m) > 19), tries[-1])


def test_chi2_with_empty_cells(spark):
    for table in ([("a", "x", 5), ("b", "y", 9)], [("a", "x", 5), ("b", "y", 9), ("a", "y", 2)], [("a", "x", 5), ("b", "y", 9), ("c", "y", 2), ("c", "z", 4)]):
        r = statistics.chi2_contingency(spark.createDataFrame(table, "r string, c string, n long"), "r", "c").first()
        rows, cols = sorted({t[0] for t in table}), sorted({t[1] for t in table})
        o = {(a, b): sum(n for x, y, n in table if (x, y) == (a, b)) for a in rows for b in cols}
        t, want = sum(o.values()), 0.0
        for a in rows:
            for b in cols:
                e = sum(o[a, y] for y in cols) * sum(o[x, b] for x in rows) / t
                gap = abs(o[a, b] - e)
                gap -= min(0.5, gap) if len(rows) == len(cols) == 2 else 0
                want += gap * gap / e
        assert math.isclose(r["chi2"], want, rel_tol=1e-9) and r["dof"] == (len(rows) - 1) * (len(cols) - 1)


def test_lines_after_a_preamble(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.tsv").write_text("one\n# two\n" + "".join(f"{k}{i}\tx\n" for i in range(4)))
    got = tables.read_tsv(spark, str(tmp_path), "a int, b string", skip=2)
    assert sorted(r["a"] for r in got.collect()) == sorted(int(f"{k}{i}") for k in range(3) for i in range(4))
    (tmp_path / "w").write_text("head\n--\nname_x  P1-2 7 ph\nP3 9  ac\n11 no\n")
    assert sorted(map(tuple, tables.read_mixed_layout(spark, str(tmp_path / "w")).collect())) == [("P1", "7", "ph"), ("P3", "9", "ac")]
    (tmp_path / "blanks").write_text("a   1\n\n b 2 3\n")
    assert sorted(map(str, map(tuple, tables.read_whitespace(spark, str(tmp_path / "blanks"), ["n", "v", "z"]).collect()))) == ["('a', '1', None)", "('b', '2', '3')"]


def test_streams_take_each_file_once(spark, tmp_path):
    from regionfx.streaming import incremental

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k long, v double")
    rows.write.parquet(source)
    score = incremental.by_key_mean("k", "v")
    incremental.stream_scoring(spark, source, rows.schema, score, out, state)
    incremental.stream_scoring(spark, source, rows.schema, score, out, state)
    spark.createDataFrame([(3, 1.0)], rows.schema).write.mode("append").parquet(source)
    incremental.stream_scoring(spark, source, rows.schema, score, out, state)
    assert sorted(map(tuple, incremental.read_finished(spark, out).collect())) == [(1, 3.0), (2, 5.0), (3, 1.0)]


def test_exact_rank_test(spark):
    import itertools

    a, b, c = [1.5, 9.0, 2.5], [3.0, 4.0, 8.0, 10.0, 11.0], [1.5, 9.0, 7.0, 9.0]
    rows = [("a", x) for x in a] + [("b", x) for x in b] + [("c", x) for x in c]
    got = {(r["a"], r["b"]): r for r in statistics.mann_whitney_pairs(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    u = lambda x, y: sum((p > q) + (p == q) / 2 for p in x for q in y)
    both = sorted(a + b)
    every = [u(x, [y for y in both if y not in x]) for x in map(list, itertools.combinations(both, 3))]
    far = max(u(a, b), 15 - u(a, b))
    assert math.isclose(got["a", "b"]["p"], min(1, 2 * sum(x >= far for x in every) / len(every)))
    assert got["a", "c"]["u"] == u(a, c) and not math.isclose(got["a", "c"]["p"], pvalues.exact_rank_p(u(a, c), 3, 4))  # ties
    assert pvalues.rank_counts(2, 2) == [1, 1, 2, 1, 1]
