"""From raw documents to packed token sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and gives it to the next stage.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.packing import document_pieces, pack_pieces
from regionfx.llm.personal_data import find_personal_data
from regionfx.llm.quality import accepted
from regionfx.llm.similar import near_duplicate_groups, with_node
from regionfx.llm.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules accept."""
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the smallest id, null ids last.

    Of several texts with that id in a group the one with the smallest hash of its words
    stays, of rows with equal ids and words one.
    """
    found = materialize(near_duplicate_groups(docs, words_per_shingle=5), "groups")
    rows = found.groupBy("root", "id", "node").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "node", "n")).alias("x"))
    kept = materialize(least.select("x.id", "x.node", "x.n"), "kept")
    own = with_node(docs)
    out = own.join(kept, (own["_node"] == kept["node"]) & own["doc_id"].cast("long").eqNullSafe(kept["id"]), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_node"])
    return out.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds; n_chars is that of the text it leaves."""
    out = find_personal_data(docs, redact=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack_pieces(document_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048), capacity=2048)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]

#: Fingerprints, the field's segments and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
