"""Ranking, rank tests, contingency tests and evaluation curves, from tables of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionfx.functions import pvalues
from regionfx.operators.sampling import neighbours, running_sums


def _score_table(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, s, p, n): positives and negatives of each distinct score; nulls are left out."""
    return df.na.drop(subset=[score, label]).groupBy(*by, F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))


def auroc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, auroc, n_pos, n_neg): ties count half; null where one class is missing."""
    t = _score_table(df, score, label, by)
    below = running_sums(t, by, "s", {"b": "n"})
    g = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("b") + F.col("n") / F.lit(2.0))).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return g.select(*by, F.try_divide(F.col("u"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auroc"), "n_pos", "n_neg")


def roc_curve(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, s, fpr, tpr) from the highest score down, with the start (0, 0) at a null score."""
    t = _score_table(df, score, label, by)
    whole = t.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    steps = running_sums(t, by, "s", {"cp": "p", "cn": "n"}, descending=True).withColumns({"cp": F.col("cp") + F.col("p"), "cn": F.col("cn") + F.col("n")})
    steps = steps.join(whole, by) if by else steps.crossJoin(whole)  # one row
    curve = steps.select(*by, "s", F.try_divide(F.col("cn"), F.col("_n")).alias("fpr"), F.try_divide(F.col("cp"), F.col("_p")).alias("tpr"))
    zero = whole.select(*by, F.lit(None).cast(dict(curve.dtypes)["s"]).alias("s"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return zero.unionByName(curve)


def roc_on_grid(df: DataFrame, score: str, label: str, by: list[str], grid: int = 100) -> DataFrame:
    """(by, g, fpr, tpr): the curve interpolated at g/(grid-1); the highest value at a vertical step, 0 at the first place.

    Each segment of the curve gives the grid places within it, so no
    search per place is needed.  A point's next one may be in another range, so a curve of many
    distinct scores is spread over tasks.
    """
    points = roc_curve(df, score, label, by).groupBy(*by, "fpr").agg(F.max("tpr").alias("tpr"))
    seg = neighbours(points, by, "fpr", after={"nf": "fpr", "nt": "tpr"})
    g0, g1 = F.ceil(F.col("fpr") * (grid - 1) - 1e-9).cast("int"), F.ceil(F.coalesce(F.col("nf") * (grid - 1), F.lit(float(grid))) - 1e-9).cast("int") - 1
    hit = seg.where(g1 >= g0).withColumn("g", F.explode(F.sequence(g0, F.least(g1, F.lit(grid - 1)))))
    x = F.col("g") / F.lit(float(grid - 1))
    y = F.when(F.col("g") == 0, 0.0).when(F.col("nf").isNull(), F.col("tpr")).otherwise(F.col("tpr") + (F.col("nt") - F.col("tpr")) * F.try_divide(x - F.col("fpr"), F.col("nf") - F.col("fpr")))
    return hit.select(*by, "g", x.alias("fpr"), y.alias("tpr"))


def mean_roc(df: DataFrame, score: str, label: str, fold: str, grid: int = 100) -> DataFrame:
    """(g, fpr, tpr, sem) over folds."""
    per = roc_on_grid(df, score, label, [fold], grid)
    return per.groupBy("g").agg(F.first("fpr").alias("fpr"), F.avg("tpr").alias("tpr"), (F.stddev_samp("tpr") / F.sqrt(F.count("*"))).alias("sem"))


def partial_auroc(df: DataFrame, score: str, label: str, by: list[str], cutoff: float, legacy: bool = False, grid: int = 100) -> DataFrame:
    """(by, pauroc): area under the gridded curve up to the cutoff, over the cutoff.  legacy: only whole grid steps below the cutoff are summed."""
    w = Window.partitionBy(*by).orderBy("g")
    seg = roc_on_grid(df, score, label, by, grid).withColumn("nf", F.lead("fpr").over(w)).withColumn("nt", F.lead("tpr").over(w)).where("nf is not null")
    if legacy:
        part = seg.where(F.col("nf") <= cutoff)
        end, high = F.col("nf"), F.col("nt")
    else:
        part = seg.where(F.col("fpr") < cutoff)
        end = F.least("nf", F.lit(cutoff))
        high = F.col("tpr") + (F.col("nt") - F.col("tpr")) * (end - F.col("fpr")) / (F.col("nf") - F.col("fpr"))
    return part.groupBy(*by).agg((F.sum((end - F.col("fpr")) * (F.col("tpr") + high) / 2) / cutoff).alias("pauroc"))


def mann_whitney_pairs(df: DataFrame, group: str, value: str, by: list[str] | None = None, exact_up_to: int = 8) -> DataFrame:
    """(by, a, b, n1, n2, u, p, p_adj) for all pairs of groups a < b: U of a, two-sided p, times the number of pairs.

    The p is that of the normal distribution with ties and continuity; where there are no ties and one group has at most
    ``exact_up_to`` values (and the other at most 1,000, beyond which the counts get long) that of all orders.  Pairs of groups, not of rows, are formed, over the table of distinct values.
    """
    by = by or []
    counts = df.na.drop(subset=[group, value]).groupBy(*by, F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    names = counts.select(*by, "g").distinct()
    a, b = names.withColumnRenamed("g", "a"), names.withColumnRenamed("g", "b")
    pairs = (a.join(b, by) if by else a.crossJoin(b)).where("a < b")  # of groups: a row for each pair in the result
    x = counts.select(*by, F.col("g").alias("_g"), "v", "c")
    side = pairs.withColumn("_g", F.explode(F.array("a", "b"))).join(x, [*by, "_g"])
    t = side.groupBy(*by, "a", "b", "v").agg(F.sum(F.when(F.col("_g") == F.col("a"), F.col("c")).otherwise(0)).alias("ca"), F.sum(F.when(F.col("_g") == F.col("b"), F.col("c")).otherwise(0)).alias("cb"))
    t = running_sums(t, [*by, "a", "b"], "v", {"below": "cb"}).withColumn("k", (F.col("ca") + F.col("cb")).cast("double"))
    g = t.groupBy(*by, "a", "b").agg(F.sum("ca").alias("n1"), F.sum("cb").alias("n2"), F.sum(F.col("ca") * (F.col("below") + F.col("cb") / F.lit(2.0))).alias("u"), F.sum(F.pow("k", F.lit(3.0)) - F.col("k")).alias("ties"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, F.sqrt(var))
    m = F.count("*").over(Window.partitionBy(*by))
    few = (F.col("ties") == 0) & (F.least("n1", "n2") <= exact_up_to) & (F.greatest("n1", "n2") <= 1000) & (F.least("n1", "n2") > 0)
    p = F.coalesce(pvalues.exact_rank_test_p(F.when(few, F.col("u")), F.col("n1"), F.col("n2")), pvalues.normal_p(F.greatest(z, F.lit(0.0))))
    out = g.withColumn("p", p).withColumn("_m", m)
    return out.select(*by, "a", "b", "n1", "n2", "u", "p", F.least(F.col("p") * F.col("_m"), F.lit(1.0)).alias("p_adj"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho, p): Pearson of average ranks over complete rows, with ranks from the tables of distinct values."""
    from regionfx.operators.windows import avg_rank

    full = df.na.drop(subset=[x, y]).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c"))
    rows = df.na.drop(subset=[x, y])
    rx = avg_rank(rows, x, by).select(*by, F.col("value").alias("_x"), F.col("rank").alias("_rx"))
    ry = avg_rank(rows, y, by).select(*by, F.col("value").alias("_y"), F.col("rank").alias("_ry"))
    r = full.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    c, a, b = F.col("_c").cast("double"), F.col("_rx"), F.col("_ry")
    g = r.groupBy(*by).agg(F.sum(c).alias("n"), *[F.sum(c * e).alias(k) for k, e in (("sx", a), ("sy", b), ("sxx", a * a), ("syy", b * b), ("sxy", a * b))])
    n = F.col("n")
    top = F.col("sxy") - F.col("sx") * F.col("sy") / n
    low = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n))
    out = g.select(*by, n.cast("long").alias("n"), F.try_divide(top, low).alias("rho"))
    return out.withColumn("p", pvalues.rank_correlation_p(F.col("rho"), F.col("n")))


def chi2_contingency(counts: DataFrame, row: str, col: str, by: list[str] | None = None) -> DataFrame:
    """(by, chi2, dof, p) of a table (row, col, n), cells that don't occur included; Yates' correction for one degree of freedom.

    No grid of all cells is formed: an empty cell adds its expected count, and
    all expected counts add up to the total.  In a table of two by two all cells are
    equally far from their expected counts, so one cell and the marginals give the corrected sum.
    """
    by = by or []
    r = counts.groupBy(*by, row).agg(F.sum("n").alias("_r"))
    c = counts.groupBy(*by, col).agg(F.sum("n").alias("_c"))
    inverse = lambda t, x, name: t.groupBy(*by).agg(F.sum(F.try_divide(F.lit(1.0), F.col(x))).alias(name), F.count("*").alias(f"_n{name}"))
    total = counts.groupBy(*by).agg(F.sum("n").cast("double").alias("_t"))
    of = lambda a, b: a.join(b, by) if by else a.crossJoin(b)  # noqa: E731  one row each without keys
    t = of(of(total, inverse(r, "_r", "_ir")), inverse(c, "_c", "_ic"))
    cells = of(counts.join(r, [*by, row]).join(c, [*by, col]), t)
    e = F.col("_r") * F.col("_c") / F.col("_t")
    gap = F.abs(F.col("n") - e)
    g = cells.groupBy(*by).agg(F.sum(F.coalesce(F.try_divide(gap * gap, e), F.lit(0.0)) - e).alias("_s"), F.max(gap).alias("_g"), *[F.first(x).alias(x) for x in ("_t", "_ir", "_ic", "_n_ir", "_n_ic")])
    dof = ((F.col("_n_ir") - 1) * (F.col("_n_ic") - 1)).cast("int")
    less = F.col("_g") - F.least(F.lit(0.5), F.col("_g"))
    chi2 = F.when(dof == 1, less * less * F.col("_t") * F.col("_ir") * F.col("_ic")).otherwise(F.greatest(F.col("_s") + F.col("_t"), F.lit(0.0)))
    return g.select(*by, chi2.alias("chi2"), dof.alias("dof")).withColumn("p", pvalues.chi2_p(F.col("chi2"), F.col("dof")))


def one_vs_rest_chi2(df: DataFrame, term: str, category: str, top_n: int, alpha: float = 0.05) -> DataFrame:
    """(term, chi2, dof, p) of term/other by category for the most frequent terms, all tables in one pass; p below alpha, least first.

    No grid of terms and categories is formed.  With d the distance of a cell from its expected count, both sides of a table are d away, so
    chi2 is the sum of d*d*N/W over the categories (totals W) times 1/T + 1/(N-T) for a term of T rows; categories that a term
    doesn't have add T*T/N times what is left of N.  Two categories have Yates' correction.  Null terms and categories are left out,
    as is a term of all rows; equally frequent terms are taken in their own order.
    """
    counts = df.na.drop(subset=[term, category]).groupBy(F.col(term).alias("term"), F.col(category).alias("category")).agg(F.count("*").alias("n"))
    top = counts.groupBy("term").agg(F.sum("n").cast("double").alias("_t")).orderBy(F.desc("_t"), "term").limit(top_n)
    whole = counts.groupBy(F.col("category").alias("_c")).agg(F.sum("n").cast("double").alias("_w"))
    all_rows = whole.agg(F.sum("_w").alias("_n"), F.count("*").alias("_k"), F.sum(1 / F.col("_w")).alias("_i"))  # one row
    cells = counts.join(F.broadcast(top), "term").join(whole, F.col("category") == F.col("_c")).join(F.broadcast(all_rows))
    d = F.col("n") - F.col("_t") * F.col("_w") / F.col("_n")
    g = cells.groupBy("term", "_t", "_n", "_k", "_i").agg(F.sum(d * d * F.col("_n") / F.col("_w")).alias("_s"), F.sum("_w").alias("_p"), F.max(F.abs(d)).alias("_d"))
    less = F.col("_d") - F.least(F.lit(0.5), F.col("_d"))
    square = F.when(F.col("_k") == 2, less * less * F.col("_n") * F.col("_i")).otherwise(F.col("_s") + F.col("_t") * F.col("_t") / F.col("_n") * (F.col("_n") - F.col("_p")))
    chi2 = square * (1 / F.col("_t") + F.try_divide(F.lit(1.0), F.col("_n") - F.col("_t")))
    out = g.select("term", chi2.alias("chi2"), (F.col("_k") - 1).cast("int").alias("dof"))
    return out.withColumn("p", pvalues.chi2_p(F.col("chi2"), F.col("dof"))).where(F.col("p") < alpha).orderBy("p", "term")


def score_comparison_report(df: DataFrame, scores: list[str], label: str, fold: str, strata: dict[str, Column], cutoffs: list[float]) -> DataFrame:
    """(stratum, model, fold, auroc, n_pos, n_neg, pauroc_<cutoff>...) of each score column, over all rows and over each stratum (name: condition).

    A row is in ``all`` and in every stratum whose condition holds; folds without both classes have null areas.
    """
    names = F.filter(F.array(F.lit("all"), *[F.when(c, n) for n, c in strata.items()]), lambda x: x.isNotNull())
    rows = df.select(F.explode(names).alias("stratum"), F.col(fold).alias("fold"), F.col(label).alias("_label"), *[F.col(c).cast("double").alias(c) for c in scores])
    long, by = rows.unpivot(["stratum", "fold", "_label"], scores, "model", "_score"), ["stratum", "model", "fold"]
    out = auroc(long, "_score", "_label", by)
    for c in cutoffs:
        out = out.join(partial_auroc(long, "_score", "_label", by, c, legacy=True).withColumnRenamed("pauroc", f"pauroc_{c}"), by, "left")
    return out.withColumns({f"pauroc_{c}": F.when(F.col("auroc").isNotNull(), F.col(f"`pauroc_{c}`")) for c in cutoffs})


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, nulls, min, max, mean) of numeric columns in one pass; NaN counts as null."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")) for c, x in clean.items()]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
