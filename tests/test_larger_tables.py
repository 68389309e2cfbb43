"""Rows and signs that only larger tables showed."""

import math

import numpy as np
from pyspark.sql import functions as F


def test_parsed_pairs_zero_has_no_sign(spark, tmp_path):
    """A difference that rounds to zero, once from above and once from below."""
    import duckdb

    import __spark_entry__

    f = np.linspace(0.1, 0.9, 64)
    f[20], f[43] = 0.5, 0.5 + 1e-7
    spark.createDataFrame([(1, f.tolist(), 3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["j14_parsed_pairs"]).fetchall()
    got = __spark_entry__.queries()["j14_parsed_pairs"](spark, str(tmp_path)).collect()
    assert [repr(list(x)) for x in got] == [repr(list(x)) for x in want]
    assert all(math.copysign(1, x) == 1 for x in got[0]["difference"] if x == 0)


def test_gamma_of_many_sequences_at_once(spark):
    """Null, empty, short and overlong sequences, signs beyond 16 bits, letters of both charges; a sequence is read once, not for each segment."""
    from regionfx.functions import scalars

    texts = [None, "", "a", "aeiou", "strnaeioubcdfghxyz", "aaaaaaaaaaaaaaaaaasss", "a\U0001f600strn\U0001f600eiaxxxstrn", "saeioustrnaeioustr"]

    def sigma(x, p, m):
        a, b = sum(c in p for c in x), sum(c in m for c in x)
        return (a - b) ** 2 / (a + b) if a + b else 0.0

    def gamma(x, p, m):
        return None if x is None else sum((sigma(x[2 * k : 2 * k + 5], p, m) - sigma(x, p, m)) ** 2 for k in range(10)) / 10

    df = spark.createDataFrame(list(enumerate(texts)), "k int, seq string").coalesce(1)
    for p, m in (("aeiou", "strn"), ("aeis", "strn")):
        out = df.select("k", scalars.charge_gamma(F.col("seq"), 18, p, m).alias("g"))
        assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = dict(out.collect())
        assert {k: None if g is None else round(g, 12) for k, g in got.items()} == {k: None if x is None else round(gamma(x, p, m), 12) for k, x in enumerate(texts)}


def test_norms_are_computed_once_per_row(spark):
    from regionfx.operators import aggregates

    df = spark.createDataFrame([("a", [3.0, 4.0, 0.0]), ("a", [0.0, 2.0, 0.0]), ("a", [0.0, 0.0, 0.0]), ("a", None), ("b", [1.0, 1.0, 1.0])], "g string, v array<double>")
    out = aggregates.mean_pairwise_cosine(df, "g", "v", 3)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("SQRT(") == 1
    assert dict(out.collect()) == {"a": (0.8 * 2 + 2 - 2) / 12, "b": None}


def test_alike_rows_are_scored_once(spark):
    """Scores by a join equal those of each row; null is a value, rows without features drop out, features are made once for each kind."""
    from regionfx.operators import joins
    from regionfx.plans import models

    data = [(i, i % 3 if i % 7 else None, "ANR"[i % 3 - 1] if i % 5 else None) for i in range(60)]
    positions = spark.createDataFrame(data, "id int, place int, letter string")
    seen = []

    def add(rows):
        seen.append(rows.count())
        rows = rows.where("place IS NULL OR place <> 1")
        return rows.withColumn("Res_MD_1", F.coalesce(F.col("place"), F.lit(9)) + 0.0).withColumn("Res_MD_2", F.ascii("changed") / 100.0)

    train = add(joins.saturation(positions, "letter", list("ANR"))).withColumn("label", (F.col("id") % 2).cast("double"))
    weighted = train.groupBy("Res_MD_1", "Res_MD_2", "label").agg(F.count("*").cast("double").alias("n"))
    model = models.train_classifier(weighted, ["Res_MD_1", "Res_MD_2"], "label", trees=2, depth=3, weight="n")
    one = models.saturation_scores(positions, "letter", list("ANR"), add, {"p": model})
    all_ = models.saturation_scores(positions, "letter", list("ANR"), add, {"p": model}, alike=["place", "letter", "changed"])
    assert sorted(map(str, one.select("id", "changed", "p").collect())) == sorted(map(str, all_.select("id", "changed", "p").collect()))
    assert seen[2] < seen[1]


def test_joins_that_make_many_rows_have_many_tasks(spark, sf_dir):
    import __spark_entry__

    for name in ("j9_site_annotation", "j7_point_in_region"):
        parts = __spark_entry__.queries()[name](spark, sf_dir).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1, name


def test_sequences_of_a_hot_protein_stay_in_their_tasks(spark):
    """What is shuffled are counts, a few rows of each task, whatever the number of sequences."""
    from regionfx.plans import features
    from tests.plans import shuffled_rows

    msa = spark.range(20000, numPartitions=4).select(F.lit("p").alias("protein"), F.repeat(F.lit("aeioustrnb"), 3).alias("seq"))
    sites = spark.createDataFrame([("p", 3), ("p", 12)], "protein string, site int")
    out = features.msa_site_features(sites, msa, "protein", "site", "seq", "aeiou", "strn", ["aeiou", "strn"], "sty")
    assert shuffled_rows(out) < 2000
    assert [r["site_entropy"] for r in out.collect()] == [0.0, 0.0]


def test_full_bins_of_intervals_are_cut_into_tiles(spark, monkeypatch):
    """Pairs equal those of a plain join; one hot bin, copies of rows and bins without intervals among them; points without intervals near aren't shuffled."""
    from regionfx.operators import joins
    from tests.plans import shuffled_rows

    monkeypatch.setattr(joins, "TILE_POINTS", 16, raising=False)
    monkeypatch.setattr(joins, "TILE_REGIONS", 8, raising=False)
    points = spark.createDataFrame([(i, i % 2 if i % 9 else None, float(i % 70) if i % 11 else None) for i in range(300)] + [(0, 1, 5.0)] * 3 + [(-i, 1, 1e6 + i) for i in range(5000)], "id long, key int, pos double")
    regions = spark.createDataFrame([(i, i % 3 if i % 8 else None, float(i), float(i + 4 ** (i % 4))) for i in range(60)] + [(99, 1, 3.0, 9.0)] * 20 + [(100, 1, 9.0, 3.0)], "ord int, key int, lo double, hi double")
    got = joins.point_in_region(points, regions, "key", "pos", "lo", "hi", bin_width="levels")
    want = joins.point_in_region(points, regions, "key", "pos", "lo", "hi")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert shuffled_rows(got) < 5000


def test_letter_counts(spark, monkeypatch):
    """Null and empty sequences, a null group, signs beyond 16 bits, full tables, tables that would be too large; no row for each letter."""
    import collections

    from regionfx.operators import aggregates

    data = [("a", "abca"), ("a", "ab"), ("a", None), ("a", ""), (None, "zz"), ("b", "\U0001f600xé"), ("b", "q" * 300)] + [("c", "abcabc")] * 2000
    want = collections.Counter((g, i, x) for g, s in data for i, x in enumerate(s or ""))
    for at_once, cells in ((1 << 22, 1 << 24), (3, 40), (1 << 22, 40)):
        monkeypatch.setattr(aggregates, "LETTERS_AT_ONCE", at_once)
        monkeypatch.setattr(aggregates, "LETTER_CELLS", cells)
        out = aggregates.letter_counts(spark.createDataFrame(data, "g string, s string").coalesce(2), "g", "s")
        assert {(r["g"], r["pos"], r["letter"]): r["n"] for r in out.collect()} == want


def test_residue_counts_make_no_row_for_each_letter(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.queries()["f9_residue_counts"](spark, sf_dir)
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_lengths_keep_the_widest_intervals(spark, sf_dir):
    """Every interval around an order's place is there, those of 20,000 and 200,000 too."""
    import __spark_entry__

    got = {r["k"]: r["n"] for r in __spark_entry__.queries()["j7_mixed_lengths"](spark, sf_dir).groupBy((F.col("name") % 7).alias("k")).agg(F.count("*").alias("n")).collect()}
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 5).alias("key"), (F.col("o_totalprice") / 10).alias("pos"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 7 >= 5").select((F.col("p_partkey") % 7).alias("k"), (F.col("p_size") % 5).alias("key"), F.col("p_retailprice").alias("x"))
    half = F.when(F.col("k") == 5, 10000.0).otherwise(100000.0)
    want = {r["k"]: r["n"] for r in o.join(p, "key").where((F.col("pos") >= F.col("x") * 10 - half) & (F.col("pos") <= F.col("x") * 10 + half)).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert want and {k: got.get(k) for k in want} == want


def test_search_scores_blocks_of_like_documents_only(tmp_path, monkeypatch):
    """Queries of two languages at once: hits equal exhaustive scores, and tiles of the other language are never scored; many hits and few."""
    import pyarrow as pa
    from pyarrow import fs

    from regionfx.llm import search

    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x}{i}" for i in rng.integers(0, 60, 25)) + f" own{n}" for n, x in enumerate("ab" * 700)]
    texts += ["a1 a2 a3 rare", "a1 a2 a3 rare"] + ["b5 b6 b7 seldom"] * 30 + [""]
    content, words, df, n_words = search.build_shard(pa.array(range(len(texts))), pa.array(texts))
    (tmp_path / "s.npz").write_bytes(content)
    asked = [sorted(set(t.split())) for t in texts[:40] + texts[1400:1404]]
    dictionary = pa.array(sorted({w for a in asked for w in a} | {"nowhere"}))
    at = {w: i for i, w in enumerate(dictionary.to_pylist())}
    count = dict(zip(words.to_pylist(), df.tolist(), strict=True))
    idf = np.array([math.log(1 + (len(texts) - count.get(w, 0) + 0.5) / (count.get(w, 0) + 0.5)) for w in at])
    mean = n_words / len(texts)
    shard = search.Shard(fs.LocalFileSystem(), str(tmp_path / "s.npz"), mean, dictionary, idf)

    def score(words, text):
        tf = {w: text.split().count(w) for w in set(text.split())}
        return sum(idf[at[w]] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)) for w in words if w in tf)

    exact = [[score(a, t) for t in texts] for a in asked]
    place = {int(d): i for i, d in enumerate(shard.doc_ids)}
    scored = []

    class Spy:
        __array_ufunc__ = None

        def __init__(self, weights):
            self.weights = weights

        def __rmatmul__(self, a):
            scored.append(len(a))
            return a @ self.weights

    shard.tiles = [(has, Spy(weights)) for has, weights in shard.tiles]
    ends = np.append(0, np.cumsum([len(a) for a in asked]))
    rows = shard.row[[at[w] for a in asked for w in a]]
    for least in (np.zeros(len(asked)), np.array([sorted(x)[-10] for x in exact])):
        scored.clear()
        query, docs, scores = shard.best(rows, ends, least, 10)
        for q in range(len(asked)):
            found = dict(zip(docs[query == q].tolist(), scores[query == q].tolist(), strict=True))
            tenth = sorted(exact[q])[-10]
            assert {place[i] for i, s in enumerate(exact[q]) if s > 0 and s >= tenth - 1e-9} <= found.keys()
            assert all(abs(found[place[i]] - s) < 1e-9 for i, s in enumerate(exact[q]) if place[i] in found)
    assert sum(scored) < 0.75 * len(asked) * len(shard.tiles)


def test_searches_are_dealt_over_the_cores(spark):
    from regionfx.llm import search

    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x"), F.col("id")).alias("text"))
    out = search.top_k(docs, docs.withColumnRenamed("doc_id", "query_id"), 3)
    tasks = out.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == min(6, spark.sparkContext.defaultParallelism)


def test_tiles_of_a_join_of_many_to_many(spark, monkeypatch):
    """Pairs equal those of a plain join: null keys, keys of one side only, copies of rows, two keys."""
    import pytest

    from regionfx.operators import joins

    monkeypatch.setattr(joins, "TILE_LEFT", 16)
    monkeypatch.setattr(joins, "TILE_RIGHT", 4)
    a = spark.createDataFrame([(i, None if i % 11 == 0 else i % 4, i % 2) for i in range(200)] + [(1, 1, 1)] * 40, "id long, k int, m int")
    b = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5 + 1, i % 2) for i in range(60)] + [(5, 1, 1)] * 9, "ord long, bk int, bm int")
    for how in ("inner", "left"):
        for keys in ([("k", "bk")], [("k", "bk"), ("m", "bm")]):
            got, want = (f(a, b, keys, how) for f in (joins.many_to_many, joins.equi_join))
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert joins.many_to_many(a, b.limit(0), [("k", "bk")], "left").count() == 240 and joins.many_to_many(a.limit(0), b, [("k", "bk")]).isEmpty()
    with pytest.raises(ValueError):
        joins.many_to_many(a, b, [("k", "bk")], "right")


def test_site_annotation_takes_little_disk(spark, tmp_path):
    """One nation with many customers and suppliers, whose keys are in no order: the pairs take less than a quarter of a byte each."""
    import __spark_entry__

    key = lambda n: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * 4096 + F.col("id") % 4096
    spark.range(2000).select(key(0).alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).select(key(1).alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    __spark_entry__.queries()["j9_site_annotation"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1_500_000


def test_points_in_wide_regions_take_little_disk(spark, tmp_path):
    """All points are in all regions, whose names are in no order: the pairs take less than a quarter of a byte each, and the work is dealt over tasks."""
    from regionfx.operators import joins

    name = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1 << 30)) * 4096 + F.col("id") % 4096
    points = spark.range(2000).select(name(0).alias("id"), F.floor(F.col("id") / 1e6).alias("key"), (F.col("id") / 7).alias("pos"))
    regions = spark.range(4000).select(name(1).alias("name"), F.floor(F.col("id") / 1e6).alias("key"), (-1 - F.col("id") / 3).alias("lo"), (1000 + F.col("id") / 5).alias("hi"))
    joins.point_in_region(points, regions, "key", "pos", "lo", "hi", bin_width="levels").select("id", "name").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 8_000_000
    files = [f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < 2_000_000 and len(files) > 1
