"""Near-duplicate groups by fingerprints and, beyond their reach, by the similarity of shingle sets.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ
in about ten bits of a 64-bit SimHash, which ball hashing can't cover.  So
texts also get band signatures of minima of their shingles' hashes; texts that
share a band are compared by their whole sets.  A band's texts are compared
with leaders, never each with each: first with one of the band, after which a text leaves that by its
distance from this leader and its own shingles nothing in the band can be similar to; then members that have a rare shingle
in common, which are few; then, as far as distances allow with rare shingles taken as nobody else's, with
texts that are still outside of the band's largest component, as far as both distances allow.  A leader leaves the
band after its turn, and the band is done when all its texts are in one component, so that
no two texts of a band are left that might be similar and are neither compared nor linked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionfx.llm.simhash import components, fingerprints_of, links, shingle_hashes, word_hashes
from regionfx.llm.storage import discard, materialize
from regionfx.llm.words import chunks_of

#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** ROWS) ** BANDS = 6e-5.
BANDS, ROWS = 32, 6
NODE_SEED, MINIMA_SEED = 7, 11
#: A shingle is rare among a leader's members if at most so many have it; those are compared with each other.
RARE = 16


def band_signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS signatures (a row for each text that has shingles) of the shingle hashes of texts in a row."""
    rng = np.random.default_rng(MINIMA_SEED)
    factors = rng.integers(1 << 32, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    offsets = rng.integers(1 << 32, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    at = np.append(0, np.cumsum(counts[counts > 0]))[:-1]
    out = np.zeros((len(at), BANDS), dtype=np.uint64)
    if not len(at):
        return out
    for band in range(BANDS):
        mixed = np.full(len(at), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((values * factors[i] + offsets[i]) >> np.uint64(32), at)
            mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out[:, band] = mixed
    return out


def signatures(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(id, node, fp, bands) of documents (id, text): node is a hash of the text's words, bands is null without words."""

    def hashed(batches):
        import pyarrow as pa

        for table in chunks_of(batches, "text", 1 << 20):
            values, counts, nodes = shingle_hashes([x.encode() for x in table.column("text").to_pylist()], words_per_shingle, NODE_SEED)
            bands = band_signatures(values, counts)
            ends = np.append(0, np.cumsum(counts > 0) * BANDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(nodes.view(np.int64)), pa.array(fingerprints_of(values, counts).view(np.int64)), lists], names=["id", "node", "fp", "bands"])

    return docs.mapInArrow(hashed, "id long, node long, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each text."""

    def hashed(batches):
        import pyarrow as pa

        for table in chunks_of(batches, "text", 1 << 20):
            values, counts, nodes = shingle_hashes([x.encode() for x in table.column("text").to_pylist()], words_per_shingle, NODE_SEED)
            sets = [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
            ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(hashed, "node long, shingles array<long>")


def fingerprint_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) whose fingerprints are equal or linked by ball hashing."""
    lead = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "distinct-fingerprints")
    same = nodes.join(lead, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    near = links(lead.select("fp"))
    for end in ("a", "b"):
        near = near.join(lead.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_node")), end)
    return same.union(near.select("a_node", "b_node"))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with the sizes of their shingle sets and of what these share."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")), end)
    return pairs.select("a", "b", F.size("a_set").alias("a_size"), F.size("b_set").alias("b_size"), F.size(F.array_intersect("a_set", "b_set")).alias("shared"))


def crowded_bands(sigs: DataFrame) -> DataFrame:
    """(sig, node, weight) of band signatures that several nodes have; weight: how many texts a node meets in its bands."""
    crowded = sigs.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(sigs.join(crowded, "sig"), "met")
    return met.join(met.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("sig", "node", "weight")


def differences(met: DataFrame, known: DataFrame) -> DataFrame:
    """met (sig, node, root, lead) with size, that of the node's set, and d, its symmetric difference from the leader's, by the comparisons ``known``."""
    gap = (F.col("a_size") + F.col("b_size") - 2 * F.col("shared")).alias("d")
    of = known.select(F.col("a").alias("node"), F.col("b").alias("lead"), F.col("a_size").alias("size"), gap)
    return met.join(of.union(known.select("b", "a", "b_size", gap)), ["node", "lead"])


def single_shingles(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, u): how many shingles of members and leaders no other one of these has."""
    own = sets.join(met.select("node").union(met.select("lead")).distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    return own.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("u"))


def rare_shingles(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, shingle, node, n): the shingles of a leader's members that it lacks and that at most RARE of them (n) have."""
    pairs = met.select("node", "lead").distinct().join(sets, "node").withColumnRenamed("shingles", "_own")
    pairs = pairs.join(sets.select(F.col("node").alias("lead"), "shingles"), "lead")
    added = materialize(pairs.select("lead", "node", F.explode(F.array_except("_own", "shingles")).alias("shingle")), "added-shingles")
    few = added.groupBy("lead", "shingle").agg(F.count("*").alias("n")).where(F.col("n") <= RARE)
    return added.join(few, ["lead", "shingle"]).select("lead", "shingle", "node", "n")


def hopeful(rows: DataFrame, similarity: float) -> DataFrame:
    """The members of bands that another one of their band may still be similar enough to, with ``high`` and ``low``.

    rows: (sig, node, root, lead, size, d, u), the members of a band, the leader they were
    compared with and by how much they differ.  The distance of two texts is
    the symmetric difference of their differences from the leader.  If u of a text's shingles, which the leader lacks,
    are in no two differences, x and y differ in at least
    d(x) + d(y) - 2 min(d(x) - u(x), d(y) - u(y)) shingles, and similar ones in at most
    share * (size(x) + size(y)).  With high = d - 2u + share * size and low = d - share * size a
    pair needs high(y) >= low(x) and high(x) >= low(y).  Members are held against
    summaries of their band in steps of low, each with its greatest high and least low.
    """
    slack = (1 - similarity) / (1 + similarity) * F.col("size") + 1e-6
    high, low = F.col("d") - 2 * F.coalesce("u", F.lit(0)) + slack, F.col("d") - slack
    step = (8 * F.log2(F.greatest(F.col("d"), F.lit(1)))).cast("int")
    rows = materialize(rows.select("sig", "node", "root", "lead", "size", "d", high.alias("high"), low.alias("low"), step.alias("step")), "bounds")
    steps = rows.groupBy("sig", "step").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min("root").alias("first"), F.max("root").alias("last"))
    bands = steps.groupBy("sig").agg(F.collect_list(F.struct("high", "low", "first", "last")).alias("steps"))  # at most 8 for each doubling of d
    may = F.exists("steps", lambda s: (s["high"] >= F.col("low")) & (s["low"] <= F.col("high")) & ((s["first"] != F.col("root")) | (s["last"] != F.col("root"))))
    return rows.join(bands, "sig").where(may).select("sig", "node", "lead", "size", "d", "high", "low")


def merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components (node, root) after further links (a, b); only components that the links join are gone through again."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        pairs = pairs.join(own, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    moved = components(pairs.where("a <> b"))
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return materialize(old.union(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")


def similar_groups(members: DataFrame, edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root): components of ``edges`` and of the links between members of a band that are similar enough.

    First each band's members are compared with one leader, the one that meets most
    others in its bands: the text that a family of near copies was made from links them all.  Members that
    nothing in their band can be similar to leave it.  Of the others, those of a leader that have a rare shingle in common are compared, at most RARE
for each of their shingles; no two that are left share one, so rare shingles count like those that only one text has, and again members leave.
After that, leaders are texts outside of their
    band's largest component, and each is compared with the members of other components that may be similar to it.
    """
    roots = components(edges)
    ranges = [F.min("root").alias("first"), F.max("root").alias("last")]

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("shared") >= similarity * (F.col("a_size") + F.col("b_size") - F.col("shared")) - 1e-9).select("a", "b")

    leads = rooted(members).groupBy("sig").agg(F.min(F.struct((-F.col("weight")).alias("order"), F.col("node").alias("lead"))).alias("x"), *ranges).where("first <> last")
    met = materialize(members.join(leads.select("sig", "x.lead"), "sig").where("node <> lead").select("sig", "node", "lead"), "met-leads")
    pairs = met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    tested = materialize(compared(pairs, sets), "compared")
    roots = merged(roots, linked(tested))
    met = materialize(rooted(met), "met-leads")
    open_bands = met.groupBy("sig").agg(*ranges).where("first <> last").select("sig")
    met = met.join(open_bands, "sig", "left_semi")
    active, n_leads = materialize(hopeful(differences(met, tested).join(single_shingles(met, sets), "node", "left"), similarity), "hopeful"), 64
    if not active.isEmpty():
        rare = materialize(rare_shingles(active, sets), "rare-shingles")
        two = rooted(rare.where("n > 1")).select("lead", "shingle", "node", "root")
        pairs = two.join(two.select("lead", "shingle", F.col("node").alias("node2"), F.col("root").alias("root2")), ["lead", "shingle"]).where("node < node2 and root <> root2")
        known = materialize(compared(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), sets), "compared")
        tested, roots = tested.union(known), merged(roots, linked(known))
        few = rare.groupBy("lead", "node").agg(F.count("*").alias("u"))
        active = materialize(hopeful(rooted(active.select("sig", "node", "lead", "size", "d")).join(few, ["lead", "node"], "left"), similarity), "hopeful")
    active = active.select("sig", "node", "high", "low")
    while True:
        seen = materialize(rooted(active), "band-members")
        sizes = seen.groupBy("sig", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("x"), F.count("*").alias("roots")).where("roots > 1").select("sig", F.col("x.root").alias("largest"))
        outside = seen.join(largest, "sig").where("root <> largest")
        leads = outside.groupBy("sig", F.pmod(F.xxhash64("node"), F.lit(n_leads)).alias("part")).agg(F.min(F.struct("node", "root", "high", "low")).alias("x"))
        leads = materialize(leads.select("sig", F.col("x.node").alias("lead"), F.col("x.root").alias("lead_root"), F.col("x.high").alias("lead_high"), F.col("x.low").alias("lead_low")), "leads")
        if leads.isEmpty():
            return roots
        met = seen.join(leads, "sig").where("root <> lead_root and high >= lead_low and lead_high >= low")
        pairs = met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        known = materialize(compared(pairs.join(tested, ["a", "b"], "left_anti"), sets), "compared")
        tested = tested.union(known)
        more = linked(known)
        if not more.isEmpty():
            roots = merged(roots, more)
        left = seen.join(leads.select("sig").distinct(), "sig", "left_semi").drop("root")  # a band without leaders is done
        active = materialize(left.join(leads.select("sig", F.col("lead").alias("node")), ["sig", "node"], "left_anti"), "bands")
        n_leads *= 4


def near_duplicate_groups(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """near_duplicates with the columns node (a hash of the text's words) and root (one for each component) besides."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = materialize(signatures(source, words_per_shingle), "signatures")
    nodes = materialize(own.groupBy("node").agg(F.min("id").alias("least_id"), F.min("fp").alias("fp")), "nodes")
    members = materialize(crowded_bands(materialize(own.select("node", F.explode("bands").alias("sig")).distinct(), "band-signatures")), "bands")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    chosen = source.join(wanted.select(F.col("least_id").alias("id")).where("id is not null"), "id", "left_semi").union(source.where("id is null"))
    sets = materialize(shingle_sets(chosen, words_per_shingle).groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    edges = materialize(fingerprint_edges(nodes), "links")
    named = nodes.join(similar_groups(members, edges, sets, similarity), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = materialize(named.join(least, "root").select("node", "root", "component_id"), "components")
    discard(nodes, members, sets, edges)
    return own.join(by_node, "node").select("id", "fp", "component_id", "node", "root")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, fp (long), component_id (the smallest id among documents reachable by links).

    Links: equal words, fingerprints within three bits, or shingle sets with a
    Jaccard similarity of at least ``similarity``.  Null and empty texts are linked to
    one another; texts with fewer words than a shingle have their whole sequence as the only one.
    Null ids keep their row; a component of null ids only has a null component_id.
    Repeated rows stay; an empty table gives no rows; further columns of
    ``docs`` are ignored.  Texts count as equal if a 64-bit hash of their words is.
    """
    return near_duplicate_groups(docs, words_per_shingle, similarity, text, id_col).select("id", "fp", "component_id")


def with_node(docs: DataFrame, text: str = "text", name: str = "_node") -> DataFrame:
    """``docs`` and the node of each text (a null one counts as empty)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select("*", F.lit(None).cast("long").alias(name)).schema

    def hashed(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            nodes = word_hashes([(x or "").encode() for x in batch.column(text).to_pylist()], NODE_SEED)
            yield pa.RecordBatch.from_arrays([*[c.cast(arrow.field(k).type) for k, c in enumerate(batch.columns)], pa.array(nodes.view(np.int64))], schema=arrow)

    return docs.mapInArrow(hashed, schema)
