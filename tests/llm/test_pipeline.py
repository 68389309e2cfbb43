"""The pipeline on the smallest tables, stage by stage."""

import random

import corpus_pipeline
from regionfx.llm.storage import materialize
from tests.compare import connect, rows


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.limit(5))  # repeated rows
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert docs.select("doc_id").distinct().count() == counts[3] == docs.select("text").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[3]


def test_quality_sql(spark, sf_dir):
    from regionfx.llm.quality import OP10_SQL, op10_quality_rules

    df, expected = op10_quality_rules(spark, sf_dir), connect(sf_dir).sql(OP10_SQL)
    assert rows(df.collect(), df.columns) == rows(expected.fetchall(), expected.columns)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(120))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, e), (None, e + " and more"), (3, f), (3, f), (4, f.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    want = [(None, a), (None, b), (7, c), (7, d), (9, e), (3, f)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").isEmpty()
