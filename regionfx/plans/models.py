"""Tree ensembles, projections and clusters over feature columns, with folds, scores and importances."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionfx.functions.scalars import row_mean
from regionfx.operators.sampling import hash_order, same
from regionfx.plans import forests
from regionfx.plans.links import components, tied_points
from regionfx.storage import materialize, new_folder

#: One registry of feature groups by column-name pattern, for training, scoring and importances alike.  Fixed values.
FEATURE_GROUPS = {"one_hot": "One_Hot_", "residue_aa": "Res_AA_", "residue_md": "Res_MD", "pair_md": "Pair_MD", "conservation": "Cons_", "embedding": "ESM2_", "conformation": "Conf_", "likelihood": "ESM1b_", "length": "^Region Length$"}

#: The feature groups of each classifier and of each regressor.  Fixed values.
CLASSIFIERS = {
    "One_Hot": ["one_hot"],
    "AAIndex": ["residue_aa"],
    "Res": ["residue_aa", "residue_md"],
    "Res_Pair": ["residue_aa", "residue_md", "pair_md"],
    "ESM1b": ["residue_aa", "likelihood"],
    "MD_Cons": ["residue_aa", "residue_md", "pair_md", "conservation"],
    "ESM1b_MD_only": ["residue_aa", "residue_md", "pair_md", "likelihood"],
    "Length": ["residue_aa", "length"],
    "ESM1b_MD_Cons": ["residue_aa", "residue_md", "pair_md", "conservation", "likelihood"],
}
REGRESSORS = {"AAIndex_DMS": ["residue_aa"], "Res_DMS": ["residue_aa", "residue_md"], "Res_Pair_DMS": ["residue_aa", "residue_md", "pair_md"]}


def feature_columns(df: DataFrame, groups: list[str]) -> list[str]:
    import re

    return [c for c in df.columns if any(re.search(FEATURE_GROUPS[g], c) for g in groups)]


def train_classifier(df: DataFrame, columns: list[str], label: str, trees: int = 100, depth: int = 15, seed: int = 42, weight: str | None = None) -> PipelineModel:
    """With ``weight`` a row stands for so many equal ones, which resampling would hardly change: trees then differ by their features alone."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="_features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed)
    if weight:
        forest = forest.setWeightCol(weight).setBootstrap(False)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip"), forest]).fit(df)


def train_regressor(df: DataFrame, columns: list[str], target: str, trees: int = 100, depth: int = 15, seed: int = 42) -> PipelineModel:
    forest = RandomForestRegressor(labelCol=target, featuresCol="_features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip"), forest]).fit(df)


def predict(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Adds the probability of class 1, or a regression's value."""
    scored = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(out, value).drop("_features", "rawPrediction", "probability", *([] if out == "prediction" else ["prediction"]))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_variants(df: DataFrame, variants: dict[str, list[str]], label: str, train=train_classifier, at_once: int = 4, **options) -> dict[str, PipelineModel]:
    """A model for each variant (name: feature groups), some fitted at once; each fit is a distributed job of its own."""
    with ThreadPoolExecutor(at_once) as pool:
        fits = {name: pool.submit(train, df, feature_columns(df, groups), label, **options) for name, groups in variants.items()}
        return {name: fit.result() for name, fit in fits.items()}


def out_of_fold_scores(df: DataFrame, fold: str, variants: dict[str, list[str]], label: str, k: int, train_rows=None, at_once: int = 4, train=train_classifier, path: str | None = None, **options) -> DataFrame:
    """Each row with a score column per variant, of models that didn't see its fold.

    train_rows: a function from a fold to its training rows, where these aren't all rows of the other folds.  The models are saved below
    ``path`` (a scratch folder without one), from where ``forests.score_by_fold`` can score other tables by them; all of them score
    a row in one pass, or one after the other if they are too large to be sent to all tasks.  Rows with a null or
    NaN in a used column drop out.
    """
    models = {}
    for i in range(1, k + 1):
        rows = train_rows(i) if train_rows else df.where(F.col(fold) != i)
        models |= {(i, name): m for name, m in train_variants(rows, variants, label, train, at_once=at_once, **options).items()}
    path = path or new_folder(df.sparkSession, "models")
    forests.save_models(models, path)
    found = forests.read_forests(df.sparkSession, path)
    if found is not None:
        return forests.score_by_fold(df, fold, found)

    def scored(i: int) -> DataFrame:
        rows = df.where(F.col(fold) == i)
        for name in sorted(variants):
            rows = predict(models[i, name], rows, name)
        return rows

    return reduce(DataFrame.unionByName, [scored(i) for i in range(1, k + 1)])


def score_ensemble(df: DataFrame, families: list[str], out: str) -> DataFrame:
    """Adds the mean of the model families' scores of a row, without those that are missing."""
    return df.withColumn(out, row_mean(families))


def feature_importance(models: list[PipelineModel], columns: list[str], spark, top_n: int = 10) -> DataFrame:
    """(feature, mean, std) over models, largest first: one number per feature and model."""
    rows = [(c, float(v)) for m in models for c, v in zip(columns, m.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, v double").groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).orderBy(F.desc("mean"), "feature").limit(top_n)


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], label: str, key: str, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(feature, drop): mean loss of accuracy as one column's values move to other rows.

    Values move within buckets of about a thousand rows by a seeded order, so no row order over the whole table is
    needed.  Each repeat has one order for all columns; rows meet the ones whose values they get in one join, and a row is
    scored once for each column and repeat, all in one job.  ``columns`` are the model's; rows with a null or NaN in one drop out.
    """
    n = max(1, df.count() // 1000)
    hit = (F.col("prediction") == F.col(label)).cast("double")
    base = model.transform(df).agg(F.avg(hit).alias("a")).first()["a"]
    rows = df.select(*columns, label, key).withColumn("_b", F.pmod(hash_order(key, seed), F.lit(n)))
    place = lambda order, *by: F.row_number().over(Window.partitionBy("_b", *by).orderBy(order, key))
    rows = rows.withColumn("_i", place(hash_order(key, seed + 1))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = hash_order(F.concat_ws("|", F.col("_r").cast("string"), F.col(key).cast("string")), seed + 2)
    moved = rows.select("_b", "_r", place(order, "_r").alias("_i"), F.struct(*columns).alias("_v"))
    rows = rows.join(moved, ["_b", "_r", "_i"])
    path = new_folder(df.sparkSession, "models")
    forests.save_models({(0, "own"): model}, path)
    found = forests.read_forests(df.sparkSession, path)
    if found is not None:  # a row isn't copied for each column
        hits = forests.hits_without(forests.usable_rows(rows, columns), found[0, "own"], label, "_v")
        return hits.where(F.col("feature").isin(columns)).groupBy("feature").agg((F.lit(base) - F.avg("hit")).alias("drop"))
    rows = rows.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    rows = rows.withColumns({c: F.when(F.col("feature") == c, F.col("_v").getField(c)).otherwise(F.col(f"`{c}`")) for c in columns})
    return model.transform(rows).groupBy("feature").agg((F.lit(base) - F.avg(hit)).alias("drop"))


def pca(df: DataFrame, vector: str, k: int):
    """(rows with ``pc``, shares of variance in percent): centred, then projected."""
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(scaler.transform(rows))
    out = model.transform(scaler.transform(rows)).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p")
    return out, [float(x) * 100 for x in model.explainedVariance]


def kmeans(df: DataFrame, vector: str, k: int = 4, seed: int = 42) -> DataFrame:
    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(rows).transform(rows).drop("_v")


def _pivots(points: DataFrame, n_pivots: int, sample_rows: int = 2048) -> list[list[float]]:
    """Points far from each other, by farthest-first choice from a bounded sample in the order of a hash."""
    n = points.count()
    part = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(max(1, n))) < sample_rows // 2
    rows = [r[0] for r in points.where(part).select("v").limit(sample_rows).collect()]
    sample = np.array([r for r in rows if len(r) == len(rows[0])])
    if not len(sample):
        return []
    chosen = [sample[0]]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < n_pivots + 1:
        nearest = np.minimum(nearest, np.linalg.norm(sample - chosen[-1], axis=1))
        chosen.append(sample[int(nearest.argmax())])
    return [p.tolist() for p in chosen[1:]]  # the first one was only a start


def epsilon_candidates(points: DataFrame, eps: float, n_pivots: int = 4, n_cells: int = 3) -> DataFrame:
    """Pairs (k, v, k2, v2), k < k2, of (k, v) that the triangle inequality allows to be within eps of each other.

    Points have their distances to a few pivots; two of them can be close only if none of these differ by more than eps.  Cells of
    width 2 eps in the distances to the first ``n_cells`` pivots are the join key: a point is at home in one cell and is also seen in those that
    its eps reaches into.  The other pivots' distances are compared before the vectors are.
    """
    pivots = _pivots(points, n_pivots)
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with("v", F.lit(p), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    x = points.select("k", "v", F.array(*[gap(p) for p in pivots]).cast("array<double>").alias("d"))
    far, cells = eps * (1 + 1e-9) + 1e-9, range(min(n_cells, len(pivots)))
    cell = lambda i, move: F.floor((F.col("d")[i] + move) / (2 * far))
    home = x.withColumn("cell", F.array(*[cell(i, 0.0) for i in cells]).cast("array<long>"))
    seen = x.withColumn("cell", F.array().cast("array<long>"))
    for i in cells:
        seen = seen.withColumn("_c", F.explode(F.sequence(cell(i, -far), cell(i, far)))).withColumn("cell", F.concat("cell", F.array("_c"))).drop("_c")
    other = seen.select(F.col("k").alias("k2"), F.col("v").alias("v2"), F.col("d").alias("d2"), "cell")
    near = ~F.exists(F.zip_with("d", "d2", lambda a, b: F.abs(a - b)), lambda g: g > far)
    return home.join(other.hint("merge"), "cell").where((F.col("k") < F.col("k2")) & near).select("k", "v", "k2", "v2")


def dbscan_pairs(df: DataFrame, key: str, vector: str, eps: float, n_pivots: int = 4) -> DataFrame:
    """Clusters of points linked within eps (two points make one): (key, cluster), the smallest key of the cluster, -1 for single points.

    Exact.  Equal vectors are one point, so copies aren't paired with each other; others are compared in tiles of blocks that their distances to
    pivots bring together, and a tile hands on a forest of its links, not all of them.
    Where eps is as wide as the spread of those distances, as with long random vectors, they rule nothing out and all
    pairs are compared.  Rows with a null key, a null vector or a null component are single points.
    """
    usable = F.col("v").isNotNull() & F.col("k").isNotNull() & ~F.exists("v", lambda c: c.isNull())
    x = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    groups = materialize(x.groupBy("v").agg(F.min("k").alias("k"), F.count("*").alias("n")), "points")
    edges = materialize(tied_points(groups.select("k", "v"), eps, _pivots(groups, n_pivots)), "edges")
    found = components(edges, "k", "k2")
    own = groups.join(found, groups["k"] == found["node"], "left").select(F.col("v").alias("_v"), F.coalesce("component", F.when(F.col("n") > 1, F.col("k")), F.lit(-1)).alias("_c"))
    labelled = x.join(own, x["v"] == own["_v"]).select(F.col("k").alias("_k"), "_c").distinct()
    return df.select(F.col(key).alias("k")).join(labelled, F.col("k") == F.col("_k"), "left").select(F.col("k").alias(key), F.coalesce("_c", F.lit(-1)).alias("cluster"))


def saturation_scores(positions: DataFrame, letter: str, alphabet: list[str], add_features, models: dict[str, PipelineModel], alike: list[str] | None = None) -> DataFrame:
    """Every position with every other letter, its features and one score column per model.

    ``alike``: the columns that features depend on, the changed letter among them.  Each of their combinations has its features made and is scored once, and
    rows get the scores (not the features) by a join; null is a value like others, and rows without features drop out.
    """
    from regionfx.operators.joins import saturation

    rows = saturation(positions, letter, alphabet)
    found = add_features(rows.select(*alike).distinct() if alike else rows)
    for name, model in models.items():
        found = predict(model, found, name)
    if not alike:
        return found
    own = materialize(found.select(*[F.col(c).alias(f"_{c}") for c in alike], *models), "alike")  # so that a small table's size is known to the join
    return rows.join(own, same(alike, rows, own)).drop(*[f"_{c}" for c in alike])


def saturation_by_region(positions: DataFrame, region: str, letter: str, alphabet: list[str], add_features, models: dict[str, PipelineModel], path: str, columns: list[str] | None = None, regions_per_batch: int = 1000, alike: list[str] | None = None) -> int:
    """``saturation_scores`` written by region, in batches; the number of new regions.  Read it with ``incremental.read_finished``.

    Regions of finished batches are skipped, a null region among them, so a stopped run goes on where it was and each region is in
    the output once.  ``columns``: what is written, all by default.
    """
    from regionfx.streaming.incremental import incremental_scoring

    def score(rows: DataFrame) -> DataFrame:
        out = saturation_scores(rows, letter, alphabet, add_features, models, alike)
        return out.select(*columns) if columns else out

    return incremental_scoring(positions, region, score, path, regions_per_batch, [region])


def named_features(df: DataFrame, vectors: dict[str, tuple[str, int]]) -> DataFrame:
    """Elements of feature arrays as columns: name: (array, length) gives name_1, name_2, ..."""
    return df.withColumns({f"{n}_{i + 1}": F.get(c, F.lit(i)).cast("double") for n, (c, size) in vectors.items() for i in range(size)})
