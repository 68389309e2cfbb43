"""Saved tree ensembles as arrays: many models score a row in one pass over the table.

Models are saved by (fold, variant); their nodes are read back in one scan and, where they are small enough to be sent to all
tasks, walked there for whole batches of rows, all trees of a model at once.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes of node arrays up to which models are sent to all tasks.
MOST_BYTES = 256 << 20
NODE_BYTES = 40


class Forest:
    """A model's nodes in arrays; leaves lead to themselves."""

    def __init__(self, columns: list[str], classifies: bool, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "id"], kind="stable")
        tree, first = np.unique(nodes["tree"].to_numpy(), return_index=True)
        self.columns, self.classifies, self.roots = columns, classifies, first.astype(np.int32)
        own = np.arange(len(nodes), dtype=np.int32)
        base = first[np.searchsorted(tree, nodes["tree"].to_numpy())]
        leaf = nodes["left"].to_numpy() < 0
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32)
        self.threshold = np.where(leaf, np.inf, nodes["threshold"].to_numpy(dtype=float))
        self.left = np.where(leaf, own, nodes["left"].to_numpy() + base).astype(np.int32)
        self.right = np.where(leaf, own, nodes["right"].to_numpy() + base).astype(np.int32)
        if classifies:
            stats = np.stack(nodes["stats"].to_numpy())
            self.value = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
        else:
            self.value = nodes["prediction"].to_numpy(dtype=float)[:, None]

    def votes(self, x: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """Sums over the trees of class shares, or of values: rows x classes."""
        out = []
        for i in range(0, len(x), at_once):
            part = x[i : i + at_once]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            while True:
                to = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
            out.append(self.value[at].sum(axis=1))
        return np.concatenate(out) if out else np.zeros((0, self.value.shape[1]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, or the value."""
        v = self.votes(x)
        return v[:, 1] / v.sum(axis=1) if self.classifies else v[:, 0] / len(self.roots)


def save_models(models: dict[tuple[int, str], PipelineModel], path: str, at_once: int = 8) -> None:
    """Save the models of (fold, variant) below a folder, some at once."""
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(lambda x: x[1].write().overwrite().save(f"{path}/fold={x[0][0]}/variant={x[0][1]}"), models.items()))


def load_model_of(path: str, fold: int, variant: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/fold={fold}/variant={variant}")


def read_forests(spark: SparkSession, path: str) -> dict[tuple[int, str], Forest] | None:
    """All models of a folder by (fold, variant), from one scan of their nodes; None if they are more than MOST_BYTES."""
    place = [F.regexp_extract("_metadata.file_path", "/fold=([^/]*)/", 1).cast("int").alias("fold"), F.regexp_extract("_metadata.file_path", "/variant=([^/]*)/", 1).alias("variant")]
    nodes = spark.read.parquet(f"{path}/fold=*/variant=*/stages/1_*/data")
    split = F.col("nodeData.split")
    nodes = nodes.select(*place, F.col("treeID").alias("tree"), "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
    if nodes.count() * NODE_BYTES > MOST_BYTES:
        return None
    said = lambda stage: {(r["fold"], r["variant"]): json.loads(r["value"]) for r in spark.read.text(f"{path}/fold=*/variant=*/stages/{stage}_*/metadata").select("value", *place).collect()}  # noqa: E731  a line for each model
    first, last = said(0), said(1)
    rows = nodes.toPandas()  # of the size checked above
    return {k: Forest(first[k]["paramMap"]["inputCols"], "Classif" in last[k]["class"], own) for k, own in rows.groupby(["fold", "variant"])}


def usable_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in the columns, as the models' assemblers keep them."""
    for c in columns:
        df = df.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")))
    return df


def score_by_fold(df: DataFrame, fold: str, forests: dict[tuple[int, str], Forest]) -> DataFrame:
    """Adds a column for each variant: the score by the model of the row's own fold; rows of other folds drop out.

    All models see a batch of rows together, so the table is read once whatever their number.  Rows with a null or NaN in a
    column that any of the models uses drop out.
    """
    variants = sorted({v for _, v in forests})
    columns = sorted({c for f in forests.values() for c in f.columns})
    places = {k: [columns.index(c) for c in f.columns] for k, f in forests.items()}
    sent = df.sparkSession.sparkContext.broadcast(forests)

    @pandas_udf("array<double>")
    def run(x: pd.Series, own: pd.Series) -> pd.Series:
        rows, folds = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(columns))), own.to_numpy()
        out = np.full((len(rows), len(variants)), np.nan)
        for (i, name), forest in sent.value.items():
            hit = np.flatnonzero(folds == i)
            if len(hit):
                out[hit, variants.index(name)] = forest.scores(rows[hit][:, places[i, name]])
        return pd.Series(list(out))

    rows = usable_rows(df, columns).where(F.col(fold).isin(sorted({i for i, _ in forests})))
    rows = rows.withColumn("_scores", run(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]), F.col(fold)))
    return rows.withColumns({v: F.get("_scores", F.lit(i)) for i, v in enumerate(variants)}).drop("_scores")


def hits_without(rows: DataFrame, forest: Forest, label: str, moved: str) -> DataFrame:
    """(feature, hit): for each row and column whether the class is right when that column's value is the one in ``moved``."""
    sent, columns = rows.sparkSession.sparkContext.broadcast(forest), forest.columns

    @pandas_udf("array<double>")
    def run(x: pd.Series, other: pd.Series, label: pd.Series) -> pd.Series:
        own, v, y = np.stack(x.to_numpy()), np.stack(other.to_numpy()), label.to_numpy()
        out = np.empty(own.shape)
        for i in range(own.shape[1]):
            changed = own.copy()
            changed[:, i] = v[:, i]
            out[:, i] = sent.value.votes(changed).argmax(axis=1) == y
        return pd.Series(list(out))

    cells = lambda of: F.array(*[of(c).cast("double") for c in columns])
    hits = rows.select(run(cells(lambda c: F.col(f"`{c}`")), cells(lambda c: F.col(moved).getField(c)), F.col(label)).alias("h"))
    return hits.select(F.explode(F.arrays_zip(F.lit(columns).alias("feature"), F.col("h").alias("hit"))).alias("x")).select("x.feature", "x.hit")
