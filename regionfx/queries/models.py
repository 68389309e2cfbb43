"""Feature tables, folds, models and incremental scoring on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionfx.catalog import query, table
from regionfx.functions.scalars import sign_counts
from regionfx.operators import joins as J
from regionfx.plans import features as P
from regionfx.plans import models as M
from regionfx.queries.basics import _folder, _pieces
from regionfx.queries.statistics import scored
from regionfx.queries.tables import ATOMS, CELLS, PAIRS, atoms, cells, pairs, residues
from regionfx.storage import materialize
from regionfx.streaming import incremental as I

LETTERS = list("ANR")


def _variants(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("variant_id"), (F.col("l_suppkey") % 10).alias("key"), (F.col("l_partkey") % 60).alias("location"), F.col("l_returnflag").alias("orig"))
    return li.withColumn("changed", F.lit("R"))


def _regions(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("region_id")).distinct().select("region_id", F.col("region_id").cast("long").alias("key"), F.lit(5).alias("start"), F.lit(54).alias("end"))


def _props(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("aa")).agg(F.array(F.avg("l_tax"), F.avg("l_discount")).alias("props"))


def _feature_table(spark, d):
    return P.variant_feature_table(_variants(spark, d), _regions(spark, d), residues(spark, d), pairs(spark, d), cells(spark, d), _props(spark, d), LETTERS, LETTERS, 64, k=1, rmsf=2)


@query("m1_variant_feature_table", f"""WITH e AS (SELECT label AS region_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, embedding AS f, avg(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS ms, avg(embedding[3]::DOUBLE) OVER (PARTITION BY label) AS mr FROM embeddings),
s AS (SELECT region_id, pos, ms, mr, list_concat(list_concat(f[1:2], [(f[3] / mr)::FLOAT]), f[4:64]) AS f, list_transform(f, lambda x: 0::FLOAT) AS zeros FROM e),
w AS (SELECT region_id, pos, ms, mr, list_concat(list_concat(coalesce(lag(f) OVER v, zeros), f), coalesce(lead(f) OVER v, zeros)) AS win FROM s WINDOW v AS (PARTITION BY region_id ORDER BY pos)),
g AS (SELECT region, pos, sum((channel = 'A')::INT) AS da, sum((channel = 'N')::INT) AS dn, sum((channel = 'R')::INT) AS dr FROM (SELECT region, channel, i AS pos FROM {PAIRS} WHERE value > 0.4 UNION ALL SELECT region, channel, j FROM {PAIRS} WHERE value > 0.4) GROUP BY ALL),
c AS (SELECT *, avg(value) OVER (PARTITION BY region) AS mu, stddev_pop(value) OVER (PARTITION BY region) AS sd FROM {CELLS}),
z AS (SELECT region, pos, sum(m) / 2 AS z FROM (SELECT region, i AS pos, avg((value - mu) / sd) AS m FROM c GROUP BY ALL UNION ALL SELECT region, j, avg((value - mu) / sd) FROM c GROUP BY ALL) GROUP BY ALL),
a AS (SELECT l_returnflag AS aa, avg(l_tax) AS t, avg(l_discount) AS s FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_suppkey % 10) AS k, l_partkey % 60 AS location, l_returnflag AS orig FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS variant_id, w.region_id, w.pos::INT AS pos, round(win[1], 5) AS prev_a, round(win[131], 5) AS next_c, round(list_sum(list_transform(win, lambda v: v::DOUBLE)), 4) AS window_sum,
round(ms, 6) AS mean_sasa, round(mr, 6) AS mean_rmsf, [coalesce(da, 0)::DOUBLE, coalesce(dn, 0)::DOUBLE, coalesce(dr, 0)::DOUBLE, round(coalesce(z.z, 0.0), 6)] AS pair, [round(r.t - o.t, 9), round(r.s - o.s, 9)] AS aa, [-(orig = 'A')::INT, -(orig = 'N')::INT, 1 - (orig = 'R')::INT] AS one_hot
FROM x JOIN w ON x.k = w.region_id AND w.pos = location - 4 AND location BETWEEN 5 AND 54 LEFT JOIN g ON g.region = w.region_id AND g.pos = w.pos LEFT JOIN z ON z.region = w.region_id AND z.pos = w.pos JOIN a o ON o.aa = orig JOIN a r ON r.aa = 'R'""")
def m1(spark, d):
    at = lambda c, i: F.get(c, F.lit(i))
    near = lambda c, n: F.transform(c, lambda x: F.round(x, n)).alias(c)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return _feature_table(spark, d).select("variant_id", "region_id", "pos", F.round(at("window", 0), 5).alias("prev_a"), F.round(at("window", 130), 5).alias("next_c"), F.round(total, 4).alias("window_sum"), F.round("mean_sasa", 6).alias("mean_sasa"), F.round("mean_rmsf", 6).alias("mean_rmsf"), near("pair", 6), near("aa", 9), "one_hot")


@query("m2_mean_pair_features", "SELECT region, i AS pos, channel, round(avg(value), 9) AS mean FROM (SELECT (l_suppkey % 10)::INT AS region, (l_partkey % 20)::INT AS i, l_linenumber AS j, l_returnflag AS channel, avg(l_discount * 10) AS value FROM lineitem GROUP BY ALL) WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 GROUP BY ALL")
def m2(spark, d):
    return P.mean_pair_features(pairs(spark, d), 2, 5).withColumn("mean", F.round("mean", 9))


@query("m3_group_kfold", "SELECT f AS fold, (SELECT count(*) FROM customer) // 5 + CASE WHEN f <= (SELECT count(*) FROM customer) % 5 THEN 1 ELSE 0 END AS n FROM (SELECT unnest(range(1, 6))::INT AS f)")
def m3(spark, d):
    return P.group_kfold(table(spark, d, "customer").select("c_custkey"), "c_custkey", 5, 42).groupBy("fold").agg(F.count("*").alias("n"))


@query("m4_mixed_source_folds", """WITH s AS (SELECT source, quality AS label FROM labels JOIN documents USING (doc_id)), q AS (SELECT count(*) FILTER (WHERE source = 'src1' AND label = 0) AS a, count(*) FILTER (WHERE source = 'src0' AND label = 0) AS b, count(*) AS t FROM s)
SELECT 'train' AS part, 5 * a + 4 * (t - a - b) AS n FROM q UNION ALL SELECT 'val', t - a FROM q""")
def m4(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return P.mixed_source_folds(x, "doc_id", "doc_id", "quality", "source", "src1", "src0", 5, 3).groupBy("part").agg(F.count("*").alias("n"))


@query("m5_group_split")
def m5(spark, d):
    return P.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.1, 42)


def _training(spark, d):
    sets = {"symbols": "#*$%&|", "digits": "0123456789", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": ".,;:!?", "lines": "\n", "vowels": "aeiou"}
    counted = table(spark, d, "documents").select("doc_id", F.length("text").alias("length"), sign_counts(F.col("text"), list(sets.values())).alias("n"))
    x = scored(spark, d).join(counted, "doc_id")  # no text is shuffled
    n = {name: F.get("n", F.lit(i)) for i, name in enumerate([*sets, "words"])}
    rows = x.select(
        "doc_id", "fold", F.col("quality").cast("double").alias("label"), F.col("score").cast("double").alias("Region Length"),
        *[(F.col("lang") == c).cast("double").alias(f"One_Hot_{c}") for c in ("de", "en", "es", "fr")],
        (n["symbols"] / n["words"]).alias("Res_AA_1"), (n["digits"] / n["words"]).alias("Res_AA_2"), (n["capitals"] / n["words"]).alias("Res_MD_1"), (n["marks"] / n["words"]).alias("Res_MD_2"),
        n["words"].alias("Pair_MD_1"), (F.col("length") / n["words"]).alias("Pair_MD_2"), (n["lines"] / n["words"]).alias("Cons_1"), (n["vowels"] / F.col("length")).alias("ESM1b_1"),
    )
    return materialize(rows, "training")  # fits and scores read numbers, not texts


FAST = {"trees": 10, "depth": 5}


@query("m6_train_classifier")
def m6(spark, d):
    t = _training(spark, d)
    return M.predict(M.train_classifier(t, M.feature_columns(t, ["residue_aa", "residue_md", "pair_md"]), "label", **FAST), t, "p").select("doc_id", "label", "p")


@query("m6_classifier_variants")
def m6_variants(spark, d):
    t = _training(spark, d)
    rows = t
    for name, model in M.train_variants(t, M.CLASSIFIERS, "label", **FAST).items():
        rows = M.predict(model, rows, name)
    return rows.select("doc_id", "label", *M.CLASSIFIERS)


@query("m7_train_regressor")
def m7(spark, d):
    t = _training(spark, d)
    rows = t
    for name, model in M.train_variants(t, M.REGRESSORS, "Region Length", M.train_regressor, **FAST).items():
        rows = M.predict(model, rows, name)
    return rows.select("doc_id", F.col("Region Length").alias("length"), *M.REGRESSORS)


@query("m8_predict")
def m8(spark, d):
    t = _training(spark, d)
    model = M.train_classifier(t.where("fold <> 1"), M.feature_columns(t, ["residue_md"]), "label", **FAST)
    return M.predict(model, t.where("fold = 1"), "p").select("doc_id", "p")


@query("s11_save_load_model")
def s11(spark, d):
    t, path = _training(spark, d), _folder(spark, "model")
    M.save_model(M.train_classifier(t, M.feature_columns(t, ["residue_md"]), "label", **FAST), path)
    return M.predict(M.load_model(path), t, "p").select("doc_id", "p")


@query("m9_out_of_fold_scores")
def m9(spark, d):
    t = _training(spark, d)
    return M.out_of_fold_scores(t, "fold", M.CLASSIFIERS, "label", 5, **FAST).select("doc_id", "fold", "label", *M.CLASSIFIERS)


@query("m11_model_ensemble")
def m11_models(spark, d):
    t = _training(spark, d)
    families = {k: M.CLASSIFIERS[k] for k in ("Res_Pair", "ESM1b_MD_Cons")}
    return M.score_ensemble(M.out_of_fold_scores(t, "fold", families, "label", 5, **FAST), list(families), "ensemble").select("doc_id", "label", *families, "ensemble")


@query("m10_saturation_scores")
def m10(spark, d):
    t = _training(spark, d)
    model = M.train_classifier(t, M.feature_columns(t, ["residue_md"]), "label", **FAST)
    positions = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("Res_MD_1"))
    add = lambda x: x.withColumn("Res_MD_2", F.ascii("changed").cast("double") / 100)
    return M.saturation_scores(positions, "l_returnflag", LETTERS, add, {"p": model}).select("l_orderkey", "l_partkey", "l_linenumber", "changed", "p")


@query("m10_saturation_by_region", """SELECT key AS region, count(*) AS n, count(DISTINCT location) AS positions, count(DISTINCT variant_id) AS variants FROM
(SELECT l_orderkey::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR || '-' || l_linenumber::VARCHAR AS variant_id, l_suppkey % 10 AS key, l_partkey % 60 AS location, c FROM lineitem, (VALUES ('A'), ('N'), ('R')) t(c) WHERE c <> l_returnflag AND l_returnflag <> 'R'), (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) e
WHERE key = label AND location BETWEEN 5 AND 54 AND location - 4 <= size GROUP BY 1""")
def m10_regions(spark, d):
    """All variants of all regions with the features of the variant table, scored by region; stopped half-way and run again.

    Variants of a place with the same letters have the same features, so the model is trained on each kind of them with its number as weight.
    """
    vectors = {"Res_MD": ("window", 192), "Pair_MD": ("pair", 4), "Res_AA": ("aa", 2), "One_Hot": ("one_hot", 3)}
    sides = [materialize(x(spark, d), "sides") for x in (_regions, residues, pairs, cells, _props)]  # read by every batch
    add = lambda rows: M.named_features(P.variant_feature_table(rows, *sides, LETTERS, LETTERS, 64, k=1, rmsf=2), vectors)
    positions, alike = _variants(spark, d).drop("changed"), ["key", "location", "orig", "changed"]
    kinds = J.saturation(positions, "orig", LETTERS).groupBy(*alike).agg(F.count("*").cast("double").alias("weight"))
    train = materialize(add(kinds).withColumn("label", (F.col("key") % 2).cast("double")), "training")
    model = M.train_classifier(train, M.feature_columns(train, ["residue_md", "pair_md", "residue_aa"]), "label", trees=3, depth=3, weight="weight")
    path, columns = _folder(spark, "saturation"), ["key", "variant_id", "location", "changed", "p"]
    for part in (positions.where("key % 3 = 0"), positions):
        M.saturation_by_region(part, "key", "orig", LETTERS, add, {"p": model}, path, columns, regions_per_batch=4, alike=alike)
    rows = I.read_finished(spark, path).where("p BETWEEN 0 AND 1")
    return rows.groupBy(F.col("key").cast("long").alias("region")).agg(F.count("*").alias("n"), F.count_distinct("location").alias("positions"), F.count_distinct("variant_id").alias("variants"))


@query("m11_score_ensemble", "SELECT doc_id, round((n_chars + doc_id) / 2.0::DOUBLE, 6) AS p FROM documents")
def m11(spark, d):
    from regionfx.functions.scalars import row_mean

    return table(spark, d, "documents").select("doc_id", F.round(row_mean(["n_chars", "doc_id"]), 6).alias("p"))


@query("m12_pca")
def m12(spark, d):
    out, _ = M.pca(table(spark, d, "embeddings"), "embedding", 5)
    return out.select("vec_id", "pc")


@query("m13_kmeans")
def m13(spark, d):
    return M.kmeans(table(spark, d, "embeddings"), "embedding", 4).select("vec_id", "cluster")


EPS = 1.08
_EPS = f"""(SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPS})"""


@query("m14_dbscan", f"""WITH RECURSIVE e AS MATERIALIZED {_EPS}, r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings WHERE vec_id IN (SELECT a FROM e) UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT vec_id, coalesce(c, -1) AS cluster FROM embeddings LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) ON v = vec_id""")
def m14(spark, d):
    return M.dbscan_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", EPS)


_NEAR = """(SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey AND sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (1000.0::DOUBLE * a.c_nationkey - 1000.0::DOUBLE * b.c_nationkey) ** 2) <= 60)"""


@query("m14_dbscan_pruned", f"""WITH RECURSIVE e AS MATERIALIZED {_NEAR}, r AS (SELECT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT c_custkey, coalesce(c, -1) AS cluster FROM customer LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) ON v = c_custkey""")
def m14_pruned(spark, d):
    """Points with a narrow radius: distances to pivots leave a few candidates of each; chains of links have one label."""
    points = table(spark, d, "customer").select("c_custkey", F.array("c_acctbal", F.col("c_nationkey") * 1000.0).alias("v"))
    return M.dbscan_pairs(points, "c_custkey", "v", 60.0)


@query("m15_msa_site_features")
def m15(spark, d):
    msa = _pieces(spark, d, 64).select("protein", "seq")
    sites = msa.select("protein").distinct().withColumn("site", F.explode(F.array(F.lit(3), F.lit(32), F.lit(60))))
    return P.msa_site_features(sites, msa, "protein", "site", "seq", "aeiou", "strn", ["aeiou", "strn", "bcdfg", "hjklm"], "sty")


@query("m16_edit_worklist", """SELECT region_id || '_' || orig || ':' || pos::VARCHAR || ':' || changed AS work_id FROM (SELECT DISTINCT c_mktsegment AS region_id, 'A' AS orig, (c_custkey % 5 + 1) AS pos, 'C' AS changed FROM customer WHERE c_nationkey = 3)""")
def m16(spark, d):
    v = table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), (F.col("c_custkey") % 5 + 10).alias("location"), F.lit("A").alias("orig"), F.lit("C").alias("changed"), "c_nationkey")
    r = table(spark, d, "customer").select(F.col("c_mktsegment").alias("key")).distinct().select("key", F.col("key").alias("region_id"), F.lit(10).alias("start"), F.lit(20).alias("end"), F.lit("AAAAAAAAAAA").alias("sequence"))
    return P.edit_worklist(v, r, F.col("c_nationkey") == 3, 1000, 1).select("work_id")


@query("t9_feature_importance")
def t9(spark, d):
    t = _training(spark, d)
    cols = M.feature_columns(t, ["residue_md", "pair_md", "length"])
    return M.feature_importance([M.train_classifier(t.where(F.col("fold") != i), cols, "label", **FAST) for i in (1, 2)], cols, spark)


@query("t10_permutation_importance")
def t10(spark, d):
    t = _training(spark, d)
    cols = M.feature_columns(t, ["residue_md"])
    return M.permutation_importance(M.train_classifier(t, cols, "label", **FAST), t, cols, "label", "doc_id", repeats=2)


@query("a32_region_profile")
def a32(spark, d):
    e = table(spark, d, "events")
    frames = e.select("user_id", "event_id", "event_type", "value", (F.col("value") % 6.28 - 3.14).alias("phi"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(0.0).alias("z"))
    return P.region_profile(frames, "user_id", "event_id", "event_type", ["click", "view", "error"], "value", ["phi"], list("xyz"), k=40)


@query("a32_pair_profile", f"""WITH c AS (SELECT least(l_suppkey % 10, l_linenumber) AS a, greatest(l_suppkey % 10, l_linenumber) AS b, l_returnflag AS kind FROM lineitem), n AS (SELECT count(DISTINCT pos) AS n FROM {ATOMS}),
h AS (SELECT a, b, sum((kind = 'A')::INT) AS x, sum((kind = 'R')::INT) AS y FROM c GROUP BY ALL),
v AS (SELECT a.frame AS a, b.frame AS b, covar_samp(a.x, b.x) + covar_samp(a.y, b.y) + covar_samp(a.z, b.z) AS cov FROM {ATOMS} a JOIN {ATOMS} b ON a.pos = b.pos AND a.frame <= b.frame GROUP BY 1, 2)
SELECT v.a::INT AS a, v.b::INT AS b, [round(coalesce(x, 0) / n, 6), round(coalesce(y, 0) / n, 6), round(cov, 6)] AS profile FROM v LEFT JOIN h ON v.a = h.a AND v.b = h.b, n""")
def a32_pairs(spark, d):
    ends = [F.col("l_suppkey") % 10, F.col("l_linenumber").cast("long")]
    contacts = table(spark, d, "lineitem").select(F.least(*ends).cast("int").alias("a"), F.greatest(*ends).cast("int").alias("b"), F.col("l_returnflag").alias("kind"))
    p = P.pair_profile(contacts, atoms(spark, d), "frame", "pos", "kind", {"A": "close", "R": "far"}, list("xyz"))
    return p.select("a", "b", F.transform("profile", lambda x: F.round(x, 6)).alias("profile"))


@query("st1_incremental_scoring", "SELECT user_id, round(avg(value), 6) AS score FROM events GROUP BY 1")
def st1(spark, d):
    e, path = table(spark, d, "events"), _folder(spark, "scores")
    score = I.by_key_mean("user_id", "value")
    I.incremental_scoring(e.where("user_id % 2 = 0"), "user_id", score, path)
    I.incremental_scoring(e, "user_id", score, path)
    return I.read_finished(spark, path).withColumn("score", F.round("score", 6))
