"""Models against an evaluation of their saved trees in plain Python."""

import collections
import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from regionfx.functions import scalars
from regionfx.plans import forests, models
from regionfx.queries import models as queries


def _trees(path):
    """{tree: {id: node}} of a saved model."""
    out = collections.defaultdict(dict)
    for r in pq.read_table(path).to_pylist():
        out[r["treeID"]][r["nodeData"]["id"]] = r["nodeData"]
    return out


def _leaf(nodes, x):
    at = nodes[0]
    while at["leftChild"] >= 0:
        split = at["split"]
        at = nodes[at["leftChild"] if x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0] else at["rightChild"]]
    return at


def _probability(trees, x):
    votes = [0.0, 0.0]
    for nodes in trees.values():
        stats = _leaf(nodes, x)["impurityStats"]
        for i in range(2):
            votes[i] += stats[i] / sum(stats)
    return votes[1] / sum(votes)


@pytest.fixture(scope="module")
def training(spark, sf_dir):
    return queries.materialize(queries._training(spark, sf_dir), "training")


@pytest.fixture(scope="module")
def saved(training, tmp_path_factory):
    """A classifier and a regressor with their columns and saved trees."""
    out = {}
    for name, fit, label, groups in (("class", models.train_classifier, "label", ["residue_aa", "residue_md", "pair_md"]), ("value", models.train_regressor, "Region Length", ["residue_aa", "residue_md"])):
        columns = models.feature_columns(training, groups)
        model, path = fit(training, columns, label, **queries.FAST), str(tmp_path_factory.mktemp(name) / "m")
        models.save_model(model, path)
        out[name] = model, columns, path, _trees(f"{path}/stages/1_{model.stages[-1].uid}/data")
    return out


def test_scores_are_those_of_the_saved_trees(training, saved):
    model, columns, path, trees = saved["class"]
    for own in (model, models.load_model(path)):
        rows = models.predict(own, training, "p").collect()
        assert len(rows) == training.count() and len({r["p"] for r in rows}) > 5
        assert all(math.isclose(r["p"], _probability(trees, [r[c] for c in columns]), abs_tol=1e-12) for r in rows)
    model, columns, path, trees = saved["value"]
    for r in models.predict(model, training, "v").collect():
        want = sum(_leaf(nodes, [r[c] for c in columns])["prediction"] for nodes in trees.values()) / len(trees)
        assert math.isclose(r["v"], want, rel_tol=1e-9)


def test_importances_are_those_of_the_saved_trees(spark, saved):
    model, columns, _, trees = saved["class"]
    whole = [0.0] * len(columns)
    for nodes in trees.values():
        own = [0.0] * len(columns)
        for n in nodes.values():
            if n["leftChild"] >= 0:
                own[n["split"]["featureIndex"]] += n["gain"] * sum(n["impurityStats"])
        if sum(own):
            whole = [a + b / sum(own) for a, b in zip(whole, own, strict=True)]
    want = {c: v / sum(whole) for c, v in zip(columns, whole, strict=True)}
    got = {r["feature"]: r["mean"] for r in models.feature_importance([model, model], columns, spark, top_n=100).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], abs_tol=1e-9) for c in want)


def test_one_pass_scores_of_many_models(spark, training, tmp_path, monkeypatch):
    variants = {k: models.CLASSIFIERS[k] for k in ("AAIndex", "Length", "Res_Pair")}
    gone = training.limit(1).withColumn("Res_AA_1", F.lit(float("nan"))).withColumn("doc_id", F.lit(-1).cast("long"))
    rows, path = training.unionByName(gone), str(tmp_path / "models")
    one = models.out_of_fold_scores(rows, "fold", variants, "label", 5, path=path, **queries.FAST)
    got = {r["doc_id"]: [r[v] for v in variants] for r in one.collect()}
    assert got.keys() == {r["doc_id"] for r in training.select("doc_id").collect()}
    for fold in (1, 4):
        for j, v in enumerate(variants):
            own = forests.load_model_of(path, fold, v)
            for r in models.predict(own, training.where(F.col("fold") == fold), "p").collect():
                assert math.isclose(got[r["doc_id"]][j], r["p"], abs_tol=1e-12)
    # other rows by the models of their own fold, from the folder alone
    again = forests.score_by_fold(training.where("fold = 2"), "fold", forests.read_forests(spark, path)).collect()
    assert all(math.isclose(r["Length"], got[r["doc_id"]][1], abs_tol=1e-12) for r in again) and again
    monkeypatch.setattr(forests, "MOST_BYTES", 100)
    assert forests.read_forests(spark, path) is None
    slow = models.out_of_fold_scores(rows, "fold", {"AAIndex": variants["AAIndex"]}, "label", 5, **queries.FAST).where("doc_id >= 0").collect()
    assert all(math.isclose(r["AAIndex"], got[r["doc_id"]][0], abs_tol=1e-12) for r in slow)


def test_importance_by_permutation_is_the_same_both_ways(spark, training, saved, monkeypatch):
    model, columns, _, _ = saved["class"]
    run = lambda: {r["feature"]: r["drop"] for r in models.permutation_importance(model, training, columns, "label", "doc_id", repeats=2).collect()}
    fast = run()
    monkeypatch.setattr(forests, "MOST_BYTES", 0)
    slow = run()
    assert fast.keys() == slow.keys() == set(columns) and all(math.isclose(fast[c], slow[c], abs_tol=1e-12) for c in columns)


def test_saturation_scores_are_those_of_the_saved_trees(spark, tmp_path):
    train = spark.range(300).select(F.rand(1).alias("Res_MD_1"), F.rand(2).alias("Res_MD_2")).withColumn("label", (F.col("Res_MD_1") > F.col("Res_MD_2")).cast("double"))
    model, path = models.train_classifier(train, ["Res_MD_1", "Res_MD_2"], "label", trees=5, depth=4), str(tmp_path / "m")
    models.save_model(model, path)
    trees = _trees(f"{path}/stages/1_{model.stages[-1].uid}/data")
    positions = spark.range(50).select("id", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("letter"), F.rand(3).alias("Res_MD_1"))
    out = models.saturation_scores(queries.materialize(positions, "positions"), "letter", list("ANR"), lambda x: x.withColumn("Res_MD_2", F.ascii("changed") / 100.0), {"p": model}).collect()
    assert len(out) == 100 and all(r["letter"] != r["changed"] for r in out)
    assert all(math.isclose(r["p"], _probability(trees, [r["Res_MD_1"], r["Res_MD_2"]]), abs_tol=1e-12) for r in out)


def test_signs_are_counted_in_one_pass(spark, sf_dir, monkeypatch):
    """Counts equal those of translate and split, for texts of any signs, and no text is shuffled for the training rows."""
    sets = ["#*$%&|", "0123456789", "aeiou", "\n"]
    texts = ["", " ", " a  b\t", "a\u00a0b\u2003c é\U0001f600#1", "\n\x0b\f\r\x1c\x85x", "a1#" * 500, "a" * 9 + " \n" * 7, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    plain = [(F.length("text") - F.length(F.translate("text", s, ""))).cast("double") for s in sets]
    rows = df.select("text", scalars.sign_counts(F.col("text"), sets).alias("got"), F.when(F.col("text").isNotNull(), F.array(*plain, F.size(F.split("text", r"\s+")).cast("double"))).alias("want"))
    assert rows.where("text IS NOT NULL").count() > 100 and rows.where("NOT got <=> want").isEmpty()
    monkeypatch.setattr(queries, "materialize", lambda df, name: df)
    joins, below = [], [queries._training(spark, sf_dir)._jdf.queryExecution().optimizedPlan()]
    for plan in below:
        below += [plan.children().apply(i) for i in range(plan.children().size())]
        joins += [plan.output().toString()] * (plan.nodeName() == "Join")
    assert joins and not any("text#" in output for output in joins)
