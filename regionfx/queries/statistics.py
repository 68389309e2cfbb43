"""Rank tests, contingency tests, curves and profiles on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionfx.catalog import query, table
from regionfx.operators import aggregates as A
from regionfx.operators import statistics as T
from regionfx.queries.basics import _nulls
from regionfx.queries.tables import FIRST, WTMUT, annotated, wtmut

SCORED = "(SELECT doc_id, n_chars AS score, quality, toxic, (doc_id % 5 + 1)::INT AS fold, lang FROM labels JOIN documents USING (doc_id))"


def scored(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return x.select("doc_id", F.col("n_chars").alias("score"), "quality", "toxic", (F.col("doc_id") % 5 + 1).cast("int").alias("fold"), "lang")


def _auc(by, src=SCORED, label="quality"):
    return f"""SELECT {by}, round((sum(CASE WHEN {label} = 1 THEN r END) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) / (sum({label}) * (count(*) - sum({label}))), 9) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS r FROM {src}) GROUP BY ALL"""


@query("t1_auroc", _auc("fold"))
def t1(spark, d):
    return T.auroc(scored(spark, d), "score", "quality", ["fold"]).select("fold", F.round("auroc", 9).alias("auroc"))


_ROC = f"""t AS (SELECT fold, score, sum(quality) AS p, count(*) - sum(quality) AS n FROM {SCORED} GROUP BY ALL),
c AS (SELECT fold, sum(n) OVER w / sum(n) OVER (PARTITION BY fold) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY fold) AS tpr FROM t WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
q AS (SELECT fold, fpr, max(tpr) AS tpr FROM (SELECT * FROM c UNION ALL SELECT DISTINCT fold, 0, 0 FROM t) GROUP BY ALL),
s AS (SELECT *, lead(fpr) OVER w AS nf, lead(tpr) OVER w AS nt FROM q WINDOW w AS (PARTITION BY fold ORDER BY fpr)),
g AS (SELECT fold, g::INT AS g, g / 99.0::DOUBLE AS x, CASE WHEN g = 0 THEN 0.0 WHEN nf IS NULL THEN tpr ELSE tpr + (nt - tpr) * (g / 99.0::DOUBLE - fpr) / (nf - fpr) END AS y FROM s, range(100) r(g)
 WHERE g >= ceil(fpr * 99 - 1e-9) AND g < ceil(coalesce(nf * 99, 100.0) - 1e-9))"""


@query("t2_mean_roc", f"WITH {_ROC} SELECT g, round(avg(y), 6) AS tpr, round(stddev_samp(y) / sqrt(count(*)), 6) AS sem FROM g GROUP BY g")
def t2(spark, d):
    return T.mean_roc(scored(spark, d), "score", "quality", "fold").select("g", F.round("tpr", 6).alias("tpr"), F.round("sem", 6).alias("sem"))


@query("t2_roc_curve", f"WITH {_ROC} SELECT fold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM (SELECT * FROM c UNION ALL SELECT DISTINCT fold, 0, 0 FROM t)")
def t2_curve(spark, d):
    return T.roc_curve(scored(spark, d), "score", "quality", ["fold"]).select("fold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


_LINES = "(SELECT l_linenumber AS fold, l_extendedprice AS score, (l_returnflag = 'R')::INT AS quality FROM lineitem)"


@query("t2_curves_of_many_scores", f"WITH {_ROC.replace(SCORED, _LINES)} SELECT fold, g, round(y, 6) AS tpr FROM g")
def t2_many(spark, d):
    """Curves over scores that hardly repeat: their points are in ranges, and each range hands on its first ones."""
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("quality"))
    return T.roc_on_grid(rows, "score", "quality", ["fold"]).select("fold", "g", F.round("tpr", 6).alias("tpr"))


@query("t2b_partial_auroc", f"WITH {_ROC} SELECT fold, round(sum((nx - x) * (y + ny) / 2) / 0.1, 6) AS pauroc FROM (SELECT fold, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM g WINDOW w AS (PARTITION BY fold ORDER BY g)) WHERE nx <= 0.1 GROUP BY 1")
def t2b(spark, d):
    return T.partial_auroc(scored(spark, d), "score", "quality", ["fold"], 0.1, legacy=True).select("fold", F.round("pauroc", 6).alias("pauroc"))


@query("t2b_partial_auroc_exact")
def t2b_exact(spark, d):
    return T.partial_auroc(scored(spark, d), "score", "quality", ["fold"], 0.1)


def _u(src, group, value, by=""):
    b = f"{by}, " if by else ""
    on = f"x.{by} = y.{by} AND " if by else ""
    pb = f"x.{by}, " if by else ""
    return f"""WITH f AS (SELECT {b}{group} AS g, {value} AS v, count(*) AS c FROM {src} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY ALL)
SELECT {pb}x.g AS a, y.g AS b, round(sum(x.c * y.c * CASE WHEN x.v > y.v THEN 1.0::DOUBLE WHEN x.v = y.v THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 3) AS u FROM f x JOIN f y ON {on}x.g < y.g GROUP BY ALL"""


@query("t3_mann_whitney_u", _u("events", "event_type", "value"))
def t3(spark, d):
    return T.mann_whitney_pairs(table(spark, d, "events"), "event_type", "value").select("a", "b", F.round("u", 3).alias("u"))


@query("t3_mann_whitney_p")
def t3_p(spark, d):
    return T.mann_whitney_pairs(table(spark, d, "events"), "event_type", "value")


@query("t4_spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def t4(spark, d):
    return T.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", F.round("rho", 6).alias("rho"))


@query("t4_spearman_p")
def t4_p(spark, d):
    return T.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


def _chi2(src, row, col, by=""):
    b, j = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    g = f"GROUP BY {by}" if by else ""
    return f"""WITH k AS (SELECT {b}{row} AS r, {col} AS c, count(*) AS n FROM {src} WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY ALL),
rr AS (SELECT {b}r, sum(n) AS rn FROM k GROUP BY ALL), cc AS (SELECT {b}c, sum(n) AS cn FROM k GROUP BY ALL), tt AS (SELECT {b}sum(n) AS tn, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM k {g}),
e AS (SELECT {b}r, c, rn * cn / tn::DOUBLE AS e, dof FROM rr JOIN cc {j} JOIN tt {j}),
x AS (SELECT {b}e, dof, abs(coalesce(n, 0) - e) AS d FROM e LEFT JOIN k USING ({b}r, c))
SELECT {b}round(sum((d - CASE WHEN dof = 1 THEN least(0.5, d) ELSE 0 END) ** 2 / e), 6) AS chi2, any_value(dof)::INT AS dof FROM x {g}"""


@query("t5_chi2", _chi2(f"(SELECT annotation <> 'No Domain' AS inside, cat FROM {FIRST})", "inside", "cat"))
def t5(spark, d):
    """The minimum slice: points annotated by intervals, then the table of annotation by category and its chi-square."""
    x = annotated(spark, d).withColumn("inside", F.col("annotation") != "No Domain")
    return T.chi2_contingency(A.crosstab(x, "inside", "cat"), "inside", "cat").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("t5_chi2_yates", _chi2("(SELECT quality, toxic FROM labels)", "quality", "toxic"))
def t5_yates(spark, d):
    return T.chi2_contingency(A.crosstab(table(spark, d, "labels"), "quality", "toxic"), "quality", "toxic").select(F.round("chi2", 6).alias("chi2"), "dof")


@query("t5_chi2_p")
def t5_p(spark, d):
    x = _nulls(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return T.chi2_contingency(A.crosstab(x, "status", "o_orderpriority"), "status", "o_orderpriority")


@query("t6_one_vs_rest_chi2")
def t6(spark, d):
    p = table(spark, d, "part").withColumn("big", F.col("p_size") > 25)
    return T.one_vs_rest_chi2(p, "p_type", "big", 10, alpha=1.1)


@query("t7_group_effect", _u(f"(SELECT CASE WHEN annotation = 'No Domain' THEN 'outside' ELSE 'inside' END AS side, cat, pos FROM {FIRST} WHERE cat IN ('MACHINERY', 'HOUSEHOLD'))", "cat", "pos", "side"))
def t7(spark, d):
    x = annotated(spark, d).where(F.col("cat").isin("MACHINERY", "HOUSEHOLD")).withColumn("side", F.when(F.col("annotation") == "No Domain", "outside").otherwise("inside"))
    return T.mann_whitney_pairs(x, "cat", "pos", ["side"]).select("side", "a", "b", F.round("u", 3).alias("u"))


@query("t8_bonferroni_by_feature", _u("(SELECT l_returnflag, feature, value FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'N') ON l_quantity, l_discount, l_tax INTO NAME feature VALUE value))", "l_returnflag", "value", "feature"))
def t8(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag <> 'N'").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "feature", "value")
    return T.mann_whitney_pairs(x, "l_returnflag", "value", ["feature"]).select("feature", "a", "b", F.round("u", 3).alias("u"))


_MODELS = f"(SELECT 'chars' AS model, CASE WHEN score > 2000 THEN 'long' ELSE 'short' END AS stratum, score::DOUBLE AS score, quality FROM {SCORED} UNION ALL SELECT 'id', CASE WHEN score > 2000 THEN 'long' ELSE 'short' END, doc_id::DOUBLE, quality FROM {SCORED})"


@query("t11_score_comparison", _auc("model, stratum", _MODELS))
def t11(spark, d):
    x = scored(spark, d).withColumn("stratum", F.when(F.col("score") > 2000, "long").otherwise("short"))
    long = x.select("stratum", "quality", F.col("score").cast("double").alias("chars"), F.col("doc_id").cast("double").alias("id")).unpivot(["stratum", "quality"], ["chars", "id"], "model", "score")
    return T.auroc(long, "score", "quality", ["model", "stratum"]).select("model", "stratum", F.round("auroc", 9).alias("auroc"))


_STRATA = f"""(SELECT s || '|' || m || '|' || fold::VARCHAR AS fold, v AS score, quality FROM (SELECT *, unnest(['chars', 'id']) AS m, unnest([score::DOUBLE, doc_id::DOUBLE]) AS v FROM {SCORED}),
 (SELECT unnest(['all', 'long', 'short']) AS s) WHERE s = 'all' OR (s = 'long') = (score > 2000))"""


def _report():
    area = lambda c, n: f"p{n} AS (SELECT fold, round(sum((nx - x) * (y + ny) / 2) / {c}, 6) AS pauroc FROM (SELECT fold, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM g WINDOW w AS (PARTITION BY fold ORDER BY g)) WHERE nx <= {c} GROUP BY 1)"
    return f"""WITH {_ROC.replace(SCORED, _STRATA)}, {area(0.1, 1)}, {area(0.05, 2)}, a AS ({_auc("fold", _STRATA)})
SELECT split_part(a.fold, '|', 1) AS stratum, split_part(a.fold, '|', 2) AS model, split_part(a.fold, '|', 3)::INT AS fold, CASE WHEN isfinite(auroc) THEN auroc END AS auroc, CASE WHEN isfinite(auroc) THEN p1.pauroc END AS pauroc_1, CASE WHEN isfinite(auroc) THEN p2.pauroc END AS pauroc_2 FROM a LEFT JOIN p1 ON a.fold = p1.fold LEFT JOIN p2 ON a.fold = p2.fold"""


@query("t11_report_cutoffs", _report())
def t11_report(spark, d):
    x = scored(spark, d).withColumn("chars", F.col("score")).withColumn("id", F.col("doc_id"))
    r = T.score_comparison_report(x, ["chars", "id"], "quality", "fold", {"long": F.col("score") > 2000, "short": F.col("score") <= 2000}, [0.1, 0.05])
    return r.select("stratum", "model", "fold", F.round("auroc", 9).alias("auroc"), F.round("`pauroc_0.1`", 6).alias("pauroc_1"), F.round("`pauroc_0.05`", 6).alias("pauroc_2"))


@query("t12_effect_delta", _u(f"(SELECT feature, cat, value FROM (UNPIVOT (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS cat, round(b - a, 6) AS diff, round((b + 0.001) / (a + 0.001), 6) AS ratio FROM {WTMUT}) ON diff, ratio INTO NAME feature VALUE value))", "cat", "value", "feature"))
def t12(spark, d):
    a, b = F.col("a"), F.col("b")
    x = wtmut(spark, d).select(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("cat"), F.round(b - a, 6).alias("diff"), F.round((b + 0.001) / (a + 0.001), 6).alias("ratio"))
    return T.mann_whitney_pairs(x.unpivot(["cat"], ["diff", "ratio"], "feature", "value"), "cat", "value", ["feature"]).select("feature", "a", "b", F.round("u", 3).alias("u"))


@query("t13_profile", 'SELECT * FROM (SELECT \'l_quantity\' AS "column", count(*) AS n, count(*) - count(l_quantity) AS nulls, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT \'l_tax\', count(*), count(*) - count(l_tax), min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem)')
def t13(spark, d):
    return T.profile(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumn("mean", F.round("mean", 6))
