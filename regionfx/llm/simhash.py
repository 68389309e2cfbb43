"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints within distance 3 meet on a variant: if their distance is
even, on one that lies within 1 of both; if it is odd, one of them has even
parity, and they meet on one within 2 of that and within 1 of the other.  So
odd fingerprints emit all variants within 1, even ones all within 2.  On one
variant, any fingerprint within 1 of it links to every other one found there
(1 + 2 bits at most differ; two even ones can't differ in 3).  A variant has at most
2,081 neighbours, so these groups are bounded whatever the data, and linking
each to one of them gives all components without forming pairs.

Before that, fingerprints that have no other one within 1 bit on either
32-bit half are set aside: they can't have a partner within 3.  Halves of unrelated fingerprints
meet by chance as well: about n / 65 million others within 1 bit of a half for n distinct fingerprints, so
from some 10 million on this sets few aside, and every fingerprint costs its whole ball.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionfx.llm.storage import discard, materialize
from regionfx.llm.words import chunks_of

RADIUS = 3


def shingle_hashes(texts: list[bytes], words_per_shingle: int, text_seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in a row, their number in each text, a hash of each text's words).

    Words: runs of other than ASCII white space, A-Z in lower case.
    """
    import xxhash

    digest, lower = xxhash.xxh64_intdigest, bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    hashes, counts, wholes = [], [], []
    for text in texts:
        words = text.translate(lower).split()
        n = len(words) - words_per_shingle + 1
        joined = b" ".join(words)
        wholes.append(digest(joined, text_seed))
        if n <= 1:
            hashes += [digest(joined, 42)] if words else []
            counts.append(min(len(words), 1))
        else:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            begins = (np.append(0, ends[:-1])[:n]).tolist()
            hashes += [digest(joined[a:b], 42) for a, b in zip(begins, (ends[words_per_shingle - 1 :] - 1).tolist(), strict=True)]
            counts.append(n)
    return np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64), np.array(wholes, dtype=np.uint64)


def word_hashes(texts: list[bytes], text_seed: int = 0) -> np.ndarray:
    """The last part of shingle_hashes alone."""
    import xxhash

    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    return np.array([xxhash.xxh64_intdigest(b" ".join(x.translate(lower).split()), text_seed) for x in texts], dtype=np.uint64)


def fingerprints_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from the hashes of their shingles."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at = np.append(0, np.cumsum(counts[full]))
        sums = np.zeros((len(full), 64), dtype=np.int64)
        for k in range(0, len(full), 64):  # a bounded number of bits at a time
            hi = min(len(full), k + 64)
            bits = np.unpackbits(values[at[k] : at[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[k:hi] = np.add.reduceat(bits, at[k:hi] - at[k], axis=0, dtype=np.int64)
        out[full] = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_batch(texts: list[bytes], words_per_shingle: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts."""
    values, counts, _ = shingle_hashes(texts, words_per_shingle)
    return fingerprints_of(values, counts)


def fingerprints(docs: DataFrame, words_per_shingle: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): 64-bit fingerprints as long; null texts count as empty, and texts without words have fingerprint 0."""

    def hashed(batches):
        import pyarrow as pa

        for table in chunks_of(batches, text, 1 << 20):
            values = fingerprint_batch([x.encode() for x in table.column(text).to_pylist()], words_per_shingle)
            yield pa.RecordBatch.from_arrays([table.column(id_col).combine_chunks(), pa.array(values.view(np.int64), pa.int64())], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text), F.lit("")).alias(text))
    return source.mapInArrow(hashed, "id long, fp long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def with_near_half(fps: DataFrame) -> DataFrame:
    """Fingerprints (fp, distinct) that have another one within 1 bit on one of the two 32-bit halves; a task makes the balls of 20,000."""
    fps = fps.repartition(max(1, fps.count() // 20_000), "fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32))
    halves = fps.select("fp", F.explode(F.array(low, high)).alias("half"))
    ball = F.concat(F.array("half"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("half").bitwiseXOR(_bit(i))))
    crowded = halves.select(F.explode(ball).alias("half")).groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    return halves.join(crowded, "half", "left_semi").select("fp").distinct()


def ball(fps: DataFrame) -> DataFrame:
    """(fp, r, variant): all variants within half of RADIUS, rounded down for odd and up for even parity; r: bits changed."""
    zero_to = lambda a, b: F.sequence(a, F.lit(b))
    one = F.transform(zero_to(F.lit(0), 63), lambda i: F.struct(F.lit(1).alias("r"), F.col("fp").bitwiseXOR(_bit(i)).alias("variant")))
    two = F.flatten(F.transform(zero_to(F.lit(0), 62), lambda i: F.transform(zero_to(i + 1, 63), lambda j: F.struct(F.lit(2).alias("r"), F.col("fp").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j)).alias("variant")))))
    own = F.array(F.struct(F.lit(0).alias("r"), F.col("fp").alias("variant")))
    even = F.bit_count("fp") % 2 == 0
    return fps.select("fp", F.inline(F.when(even, F.concat(own, one, two)).otherwise(F.concat(own, one))))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within RADIUS that connect every group."""
    w = Window.partitionBy("variant").orderBy("r", "fp")
    near = materialize(with_near_half(fps), "near-half")
    near = near.repartition(max(1, near.count() // 1_000), "fp")  # each makes up to 2,081 rows
    met = ball(near).withColumn("lead", F.first(F.struct("r", "fp")).over(w)).where("lead.r <= 1 and lead.fp <> fp")
    pairs = met.select(F.col("fp").alias("a"), F.col("lead.fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of undirected edges (a, b): the smallest label reaches the whole component.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so paths shorten by half or more.  Every round is
    written to the shared folder; joins are between written tables, so that
    Spark can split a hot node.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = materialize(labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("near")), "labels")
        discard(labels)
        jump = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = materialize(step.join(jump, "near").select("node", "old", F.least("near", "far").alias("root")), "labels")
        discard(step)
        if new.where("root <> old").isEmpty():
            discard(both)
            return new.select("node", "root")
        labels = new.select("node", "root")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, fp (long), component_id (the smallest id among documents reachable by links).

    Copies share a fingerprint, so they are in one component; documents
    without words have fingerprint 0.  Null ids keep their row; a component of
    null ids only has a null component_id.  Repeated rows stay; an empty table
    gives no rows; further columns of ``docs`` are ignored.
    """
    own = materialize(fingerprints(docs, words_per_shingle, text, id_col), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    edges = materialize(links(distinct.select("fp")), "links")
    roots = components(edges)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = materialize(named.join(least, "root").select("fp", "component_id"), "components")
    discard(distinct, edges, roots)
    return own.join(by_fp, "fp").select("id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words_per_shingle=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
