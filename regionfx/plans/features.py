"""Feature tables: variants with residue, pair, property and sequence features; trajectory profiles; work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionfx.functions import scalars as S
from regionfx.operators import aggregates as A
from regionfx.operators import joins as J
from regionfx.operators import sampling as L
from regionfx.operators.sampling import with_group
from regionfx.operators.windows import neighbour_window
from regionfx.storage import materialize


def residue_features(residue: DataFrame, size: int, k: int, rmsf: int | None = None) -> DataFrame:
    """(region_id, pos, window, mean_sasa, mean_rmsf): one row per residue, made once per region and not per variant.

    Element ``rmsf`` (from 0) is divided by its region's mean before the windows are
    built; padding stays 0.
    """
    r = residue
    if rmsf is not None:
        means = r.groupBy("region_id").agg(F.avg(F.get("f", F.lit(0))).alias("mean_sasa"), F.avg(F.get("f", F.lit(rmsf))).alias("mean_rmsf"))
        scaled = F.transform("f", lambda x, i: F.when(i == rmsf, F.try_divide(x, F.col("mean_rmsf"))).otherwise(x).cast("float"))
        r = r.join(means, "region_id").withColumn("f", scaled)
    else:
        r = r.withColumn("mean_sasa", F.lit(None).cast("double")).withColumn("mean_rmsf", F.lit(None).cast("double"))
    return neighbour_window(r, "region_id", "pos", "f", size, k).drop("f")


def pair_features(contacts: DataFrame, cov: DataFrame | None, channels: list, cutoff: float = 0.4) -> DataFrame:
    """(region_id, pos, pair): contact degree of each channel, then the z-scored covariance mean."""
    d = A.contact_degree(contacts, cutoff)
    degree = d.groupBy("region", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("degree"))), F.lit(0)).cast("double").alias(f"_c{i}") for i, c in enumerate(channels)])
    names = [f"_c{i}" for i in range(len(channels))]
    if cov is not None:
        degree = degree.join(A.zscored_row_col_mean(cov), ["region", "pos"], "full_outer")
        names.append("z")
    return degree.select(F.col("region").alias("region_id"), "pos", F.array(*[F.coalesce(F.col(n), F.lit(0.0)) for n in names]).alias("pair"))


def property_diff(df: DataFrame, props: DataFrame, orig: str, new: str) -> DataFrame:
    """Adds ``aa``: property vector of the new letter minus that of the original; props (aa, props) has a row per letter of the alphabet."""
    o, n = props.select(F.col("aa").alias(orig), F.col("props").alias("_o")), props.select(F.col("aa").alias(new), F.col("props").alias("_n"))
    return df.join(o, orig).join(n, new).withColumn("aa", S.vector_diff(F.col("_n"), F.col("_o"))).drop("_o", "_n")


def variant_feature_table(variants: DataFrame, regions: DataFrame, residue: DataFrame, contacts: DataFrame, cov: DataFrame | None, props: DataFrame, alphabet: list[str], channels: list, size: int, k: int = 3, rmsf: int | None = None, bin_width: float | None = 500.0) -> DataFrame:
    """One row per variant in a region with tensors.

    variants (variant_id, key, location, orig, changed), regions (key, region_id, start, end), residue
    (region_id, pos, f), contacts (region, i, j, channel, value). Columns added: region_id, pos, window, mean_sasa, mean_rmsf,
    pair, aa, one_hot.  Regions without residues drop out by the inner join; positions without contacts have zeros.
    ``bin_width``: about the usual length of a region; a hot key is spread over its bins.
    """
    placed = J.point_in_region(variants, regions, "key", "location", "start", "end", bin_width).withColumn("pos", (F.col("location") - F.col("start") + 1).cast("int"))
    wide = placed.join(residue_features(residue, size, k, rmsf), ["region_id", "pos"])
    width = len(channels) + (cov is not None)
    wide = wide.join(pair_features(contacts, cov, channels), ["region_id", "pos"], "left").withColumn("pair", F.coalesce("pair", F.array_repeat(F.lit(0.0), width)))
    return property_diff(wide, props, "orig", "changed").withColumn("one_hot", S.one_hot_diff(F.col("changed"), F.col("orig"), alphabet))


def mean_pair_features(pairs: DataFrame, lo: int, hi: int) -> DataFrame:
    """(region, pos, channel, mean) of a range of positions: the control table without windows."""
    inside = pairs.where(F.col("i").between(lo, hi) & F.col("j").between(lo, hi))
    return inside.groupBy("region", F.col("i").alias("pos"), "channel").agg(F.avg("value").alias("mean"))


def msa_site_features(variants: DataFrame, msa: DataFrame, protein: str, site: str, seq: str, positive: str, negative: str, clusters: list[str], members: str, w: int = 19) -> DataFrame:
    """Per (protein, site): mean_cosine, site_entropy, region_entropy, gamma_mean, gamma_std, p_set of the aligned sequences.

    variants (protein, site from 0); msa (protein, seq).  Counts are keyed by the letter; gaps are left out.  A sequence meets the sites of its
    protein as one array; contexts are cut from it in one projection, and what goes on are these and not the sequence.  Sequences that
    end before a site or the window take no part there; null proteins, sites and sequences take none, repeated sequences count each.
    """
    sites = variants.select(protein, site).na.drop().distinct().groupBy(protein).agg(F.collect_list(site).alias("_sites"))  # places of one protein
    sites = materialize(sites, "sites")  # so that the join knows a small table's size, and a hot protein's sequences needn't meet in one task
    fits = lambda i: F.length(seq) >= F.greatest(F.lit(w), i + 1)
    cut = lambda i: F.struct(i.alias("site"), F.substring(F.col(seq), i + 1, F.lit(1)).alias("letter"), S.context_window(F.col(seq), i, w).alias("ctx"))
    x = msa.select(protein, seq).where(F.col(seq).isNotNull()).join(sites, protein).select(protein, F.inline(F.transform(F.filter("_sites", fits), cut)))
    x, keys = x.withColumnRenamed("site", site), [protein, site]
    sums, cosine = A.cosine_sums(len(clusters))
    own = A.with_norm(x, S.cluster_counts(F.col("ctx"), clusters)).withColumn("_g", S.charge_gamma(F.col("ctx"), w - 1, positive, negative))
    whole = own.groupBy(*keys).agg(F.avg("_g").alias("gamma_mean"), F.stddev_pop("_g").alias("gamma_std"), F.avg(F.col("letter").isin(*members).cast("double")).alias("p_set"), *sums)
    whole = whole.select(*keys, "gamma_mean", "gamma_std", "p_set", cosine.alias("mean_cosine"))
    # the site's own letter is place 0, its neighbours follow
    cells = x.select(*keys, F.posexplode(F.split(F.concat("letter", "ctx"), "")).alias("_p", "_c")).where("_c <> '-' and _c <> ''").groupBy(*keys, "_p", "_c").agg(F.count("*").alias("n"))
    e = A.entropy(cells, [*keys, "_p"], "n").groupBy(*keys).agg(F.max(F.when(F.col("_p") == 0, F.col("entropy"))).alias("site_entropy"), F.avg(F.when(F.col("_p") > 0, F.col("entropy"))).alias("region_entropy"))
    return whole.join(e, keys, "left").select(*keys, "gamma_mean", "gamma_std", "p_set", "mean_cosine", "site_entropy", "region_entropy")


def region_profile(frames: DataFrame, entity: str, frame: str, state: str, states: list[str], area: str, angles: list[str], xyz: list[str], burn_in: float = 0.02, k: int = 800, seed: int = 0) -> DataFrame:
    """(entity, profile): area mean and deviation, fluctuation, state shares and angle histograms of sampled frames, in this order."""
    s = L.burn_in_sample(frames, entity, frame, burn_in, k, seed)
    parts = A.mean_std(s, entity, [area]).join(A.rms_fluctuation(s, entity, frame, xyz), entity).join(A.state_fractions(s, entity, state, states), entity)
    cols: list[Column] = [F.col(f"{area}_mean"), F.col(f"{area}_std"), F.col("rmsf"), *[F.col(f"frac_{x}") for x in states]]
    for a in angles:
        parts = parts.join(A.angle_histogram(s, entity, a).withColumnRenamed("hist", f"_h_{a}"), entity)
    return parts.select(entity, F.concat(F.array(*cols), *[F.col(f"_h_{a}") for a in angles]).alias("profile"))


def pair_profile(contacts: DataFrame, frames: DataFrame, entity: str, frame: str, kind: str, kinds: dict[str, str], xyz: list[str]) -> DataFrame:
    """(a, b, profile): for each pair of entities a <= b of shared frames the frequency of each contact channel, then their covariance.

    contacts (a, b, kind); kinds names the channel of each kind of contact, others are left out.  Frequencies are over all
    frames; pairs without contacts have zeros.
    """
    channels = list(dict.fromkeys(kinds.values()))
    of = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in kinds.items()])
    hits = contacts.groupBy("a", "b").agg(*[F.count(F.when(of == c, 1)).alias(f"_c{i}") for i, c in enumerate(channels)])
    n = frames.agg(F.count_distinct(frame).alias("_n"))
    both = A.pair_covariance(frames, entity, frame, xyz).join(hits, ["a", "b"], "left").crossJoin(F.broadcast(n))  # one row
    return both.select("a", "b", F.array(*[F.coalesce(F.col(f"_c{i}"), F.lit(0)) / F.col("_n") for i in range(len(channels))], "cov").alias("profile"))


def edit_worklist(variants: DataFrame, regions: DataFrame, category: Column, n: int, seed: int) -> DataFrame:
    """(work_id, region_id, seq): edited sequences of a seeded choice of variants of a category in regions (key, region_id, start, end, sequence)."""
    placed = J.point_in_region(variants.where(category), regions, "key", "location", "start", "end")
    pos = F.col("location") - F.col("start") + 1
    name = F.concat_ws(":", F.concat_ws("_", "region_id", "orig"), pos.cast("string"), "changed")
    work = placed.select(name.alias("work_id"), "region_id", S.apply_substitution(F.col("sequence"), pos.cast("int"), F.col("changed")).alias("seq")).dropDuplicates(["work_id"])
    return L.seeded_shuffle(work, "work_id", seed, n)


def group_kfold(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Adds fold 1..k by key: no key in two folds, sizes of folds in keys differ by at most one.

    Distinct keys (null is one) get a place in a hashed order by ranges and counts, so no
    task sees all keys.
    """
    keys = df.select(key).distinct().withColumn("_h", L.hash_order(key, seed))
    keys = keys.withColumn("_o", F.struct("_h", key))
    placed = L.numbered(keys, "_o", "_r")
    return with_group(df, placed.select(key, ((F.col("_r") - 1) % k + 1).cast("int").alias("fold")), key)


def group_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Adds is_test: the first ceil(share * n) of the n distinct keys in a hashed order; null is a key."""
    keys = df.select(key).distinct().withColumn("_h", L.hash_order(key, seed)).withColumn("_o", F.struct("_h", key))
    placed = L.numbered(keys, "_o", "_r")
    n = placed.agg(F.ceil(F.count("*") * share).alias("_n"))
    return with_group(df, placed.crossJoin(F.broadcast(n)).select(key, (F.col("_r") <= F.col("_n")).alias("is_test")), key)  # one row


def mixed_source_folds(df: DataFrame, key: str, row_id: str, label: str, source: str, a: str, b: str, k: int, seed: int) -> DataFrame:
    """(fold, part, rows): train has the positives of other folds' keys and all negatives of source a; validation the fold's positives and 1/k of source b's negatives.

    Positives: all rows but negatives of the two sources (null-safe).
    """
    neg_a = F.coalesce((F.col(source) == a) & (F.col(label) == 0), F.lit(False))
    neg_b = F.coalesce((F.col(source) == b) & (F.col(label) == 0), F.lit(False))
    folds = F.sequence(F.lit(1), F.lit(k))
    pos = group_kfold(df.where(~neg_a & ~neg_b), key, k, seed).withColumnRenamed("fold", "_own")
    pos = pos.withColumn("fold", F.explode(folds)).withColumn("part", F.when(F.col("fold") == F.col("_own"), "val").otherwise("train")).drop("_own")
    train = df.where(neg_a).withColumn("fold", F.explode(folds)).withColumn("part", F.lit("train"))
    val = group_kfold(df.where(neg_b), row_id, k, seed).withColumn("part", F.lit("val"))
    return L.union_by_name(pos, train, val)
