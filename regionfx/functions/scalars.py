"""Column functions: keys and labels in strings, categories, sequence windows and vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_region_key(key: Column, sep: str = "_") -> tuple[Column, Column, Column]:
    """id, start and end of ``id_start_end``."""
    p = F.split(key, re.escape(sep))
    return p[0], F.get(p, F.lit(1)).try_cast("int"), F.get(p, F.lit(2)).try_cast("int")


def region_length(start: Column, end: Column) -> Column:
    return end - start + 1


def parse_mutation(col: Column) -> tuple[Column, Column, Column]:
    """Original letter, position and changed letter of the first ``A12G``; null where there is none."""
    part = lambda i: F.nullif(F.regexp_extract(col, r"([A-Z])(\d+)([A-Z])", i), F.lit(""))
    return part(1), part(2).try_cast("int"), part(3)


def parse_variant_suffix(col: Column) -> tuple[Column, Column]:
    """First run of digits and last capital letter at the end."""
    return F.regexp_extract(col, r"(\d+)", 1).try_cast("int"), F.nullif(F.regexp_extract(col, r"([A-Z])$", 1), F.lit(""))


def parse_mutation_id(col: Column) -> tuple[Column, Column, Column, Column]:
    """Region, original letter, position and changed letter of ``region_O:pos:C``."""
    part = lambda i: F.nullif(F.regexp_extract(col, r"^(.*)_([A-Z]):(\d+):([A-Z])$", i), F.lit(""))
    return part(1), part(2), part(3).try_cast("int"), part(4)


def first_field(col: Column, sep: str) -> Column:
    return F.substring_index(col, sep, 1)


def strip_first(col: Column) -> Column:
    return F.substring(col, 2, 2**31 - 1)


def null_safe_ne(col: Column, value) -> Column:
    """Not equal, and true for null."""
    return ~col.eqNullSafe(F.lit(value))


def label_binary(col: Column, yes: str = "Pathogenic", no: str = "Benign") -> Column:
    return F.when(col == 1, yes).otherwise(no)


def case_select(cases: list[tuple[Column, object]], default=None) -> Column:
    """The value of the first true condition; ``default`` (null unless given) where none is."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(F.lit(default))


def pair_class(orig: Column, new: Column, members: list[str], inside: str = "In", outside: str = "Out") -> Column:
    """In/out transition, each side judged by its own value."""
    side = lambda c: F.when(c.isin(members), inside).otherwise(outside)
    return F.concat_ws(" --> ", side(orig), side(new))


def charge_class(letter: Column, positive=("K", "R", "H"), negative=("D", "E")) -> Column:
    return F.when(letter.isin(*positive), "Positive").when(letter.isin(*negative), "Negative").otherwise("Uncharged")


def apply_substitution(seq: Column, pos: Column, letter: Column) -> Column:
    return F.overlay(seq, letter, pos, F.lit(1))


def rename_values(col: Column, mapping: dict) -> Column:
    """Mapped value; null where there is none."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def select_by_pattern(df: DataFrame, patterns: list[str], drop: bool = False) -> DataFrame:
    """Columns whose name matches one of the patterns, or the others; decided from the schema alone."""
    hit = [c for c in df.columns if any(re.search(p, c) for p in patterns)]
    return df.drop(*hit) if drop else df.select(*hit)


def context_window(seq: Column, idx: Column, w: int) -> Column:
    """The w-1 neighbours of a place (from 0), without the place itself; at the ends the window stays inside and its middle is left out."""
    if w % 2 == 0:
        raise ValueError("the window must be odd")
    h, n = w // 2, F.length(seq)
    cut = lambda a, size: F.substring(seq, a + 1, F.lit(size) if isinstance(size, int) else size)
    middle = F.concat(cut(idx - h, h), cut(idx + 1, h))
    start = F.concat(cut(F.lit(0), h), cut(F.lit(h + 1), w - h - 1))
    end = F.concat(cut(n - w, w - h - 1), cut(n - h, h))
    return F.when(n < w, F.lit(None)).when(idx < h, start).when(idx >= n - h, end).otherwise(middle)


def segment_windows(seq: Column, length: int, n: int = 10, size: int = 5) -> Column:
    """n overlapping segments of a sequence of a known length; the last ones may be short or empty."""
    stride = size - (size * n - length) // (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(seq, k * stride + 1, F.lit(size)))


def count_of(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def charge_sigma(seq: Column, positive: str = "KR", negative: str = "DE") -> Column:
    """(p-n)^2/(p+n), 0 without charges."""
    p, n = count_of(seq, positive).cast("double"), count_of(seq, negative).cast("double")
    return F.coalesce(F.try_divide((p - n) * (p - n), p + n), F.lit(0.0))


def charge_gamma(seq: Column, length: int, positive: str, negative: str, n: int = 10, size: int = 5) -> Column:
    """Mean squared deviation of the segments' sigma from that of the whole; segments as in ``segment_windows``.

    Charges are added up once along all sequences of an Arrow batch, so a segment's are two differences.  An aggregate over it needs it as a column first.
    """
    stride = size - (size * n - length) // (n - 1)

    @F.pandas_udf("double")
    def gamma(seqs: pd.Series) -> pd.Series:
        texts = seqs.tolist()
        known = np.array([t is not None for t in texts], dtype=bool)
        texts = [t or "" for t in texts]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = np.append(0, ends)[:-1]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sums = [np.append(0, np.cumsum(np.isin(codes, [ord(c) for c in letters]), dtype=np.int64)) for letters in (positive, negative)]

        def sigma(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            p, m = (s[b] - s[a] for s in sums)
            return (p - m) * (p - m) / np.maximum(p + m, 1)

        whole, total = sigma(starts, ends), np.zeros(len(texts))
        for k in range(n):
            a = np.clip(starts + k * stride, starts, ends)
            total += (sigma(a, np.minimum(a + size, ends)) - whole) ** 2
        return pd.Series(np.where(known, total / n, None), dtype=object)

    return gamma(seq)


def cluster_counts(seq: Column, clusters: list[str]) -> Column:
    """Letters of each cluster in a sequence; others are ignored."""
    return F.array(*[count_of(seq, c) for c in clusters])


def one_hot_diff(new: Column, orig: Column, alphabet: list[str]) -> Column:
    return F.array(*[(F.coalesce(new == a, F.lit(False)).cast("int") - F.coalesce(orig == a, F.lit(False)).cast("int")) for a in alphabet])


def vector_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def ratio(a: Column, b: Column, pseudo: float = 1e-3) -> Column:
    """Element by element, with the same small count added to both sides first."""
    return F.zip_with(a, b, lambda x, y: (x + pseudo) / (y + pseudo))


def arcsin_sqrt(x: Column) -> Column:
    return F.asin(F.sqrt(x))


def log10_shift(x: Column, shift: float = 1e-4) -> Column:
    return F.log10(x + shift)


def significance_stars(p: Column, levels=((0.001, "***"), (0.01, "**"), (0.05, "*")), inclusive: bool = True) -> Column:
    out = None
    for level, stars in levels:
        hit = (p <= level) if inclusive else (p < level)
        out = F.when(hit, stars) if out is None else out.when(hit, stars)
    return out.otherwise("ns")


def interval_overlap_pct(s1: Column, e1: Column, s2: Column, e2: Column, inclusive: bool = False) -> Column:
    """Overlap as a percentage of the shorter interval; 0 where a bound is missing or an interval has no length."""
    extra = 1 if inclusive else 0
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + extra, F.lit(0))
    shorter = F.least(e1 - s1 + extra, e2 - s2 + extra)
    missing = s1.isNull() | e1.isNull() | s2.isNull() | e2.isNull() | (shorter <= 0)
    return F.when(missing, 0.0).otherwise(shared / F.nullif(shorter, F.lit(0)) * 100.0)


def split_explode_zipped(df: DataFrame, columns: list[str], sep: str = ";") -> DataFrame:
    """Split several columns and explode them in step; lists of different lengths are an error, null cells stay one row of nulls."""
    parts = [F.split(c, re.escape(sep)) for c in columns]
    same = F.lit(True)
    for p in parts[1:]:
        same = same & (F.coalesce(F.size(p), F.lit(-1)) == F.coalesce(F.size(parts[0]), F.lit(-1)))
    zipped = F.when(same, F.arrays_zip(*[p.alias(c) for p, c in zip(parts, columns, strict=True)])).otherwise(F.raise_error(F.lit(f"lists in {columns} differ in length")))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode_outer(zipped).alias("_z")).select(*rest, *[F.col("_z").getField(c).alias(c) for c in columns])


def split_explode_ranges(df: DataFrame, column: str) -> DataFrame:
    """``a-b,c-d+e-f`` -> one row per range with ints start and end; parts whose start is no number are dropped."""
    rows = df.withColumn("_r", F.explode(F.split(column, "[,+]")))
    p = F.split("_r", "-")
    return rows.where(p[0].rlike(r"^\d+$")).withColumn("start", p[0].cast("int")).withColumn("end", F.get(p, F.lit(1)).try_cast("int")).drop("_r")


def explode_feature_names(df: DataFrame, column: str, n: int, prefix: str) -> DataFrame:
    """An array column as n named columns."""
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{prefix}_{i + 1}") for i in range(n)])


def row_mean(columns: list[str]) -> Column:
    """Mean of a row's columns without its nulls."""
    present = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))


def sign_counts(text: Column, sets: list[str]) -> Column:
    """How many signs of each set a text has, then the pieces that ``split`` makes of it at ``\\s+``: an array of doubles, null for null.

    Signs must be ASCII, so that bytes are counted, all sets in one pass, whatever else the text holds.
    """
    member, space = np.zeros((256, len(sets))), bytes(c in b" \t\n\x0b\f\r" for c in range(256))
    for i, signs in enumerate(sets):
        member[list(signs.encode("ascii")), i] = 1

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            blank = np.frombuffer(t.translate(space), np.uint8)
            runs = np.count_nonzero(blank[1:] > blank[:-1]) + np.count_nonzero(blank[:1])
            out.append(np.append(np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ member, runs + 1.0))
        return pd.Series(out, dtype=object)

    return run(text.cast("binary"))
