"""Scans and sinks: delimited, white-space, FASTA and matrix text, many files at once, and written tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from regionfx.operators.sampling import numbered


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, rename: dict[str, str] | None = None, select: list[str] | None = None, fmt: str | None = None) -> DataFrame:
    """A CSV or Parquet table with renamed and chosen columns; the choice reaches the scan.  CSV needs a schema."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    df = df.withColumnsRenamed(rename or {})
    return df.select(*select) if select else df


def _placed_lines(spark: SparkSession, path: str | list[str], upto: int) -> DataFrame:
    """(value, file, path, at): the lines of text files in one scan; at: the line's place in its file, from 0, up to ``upto``, and that beyond it.

    A file's first split comes to a task from its first line on, so its lines are counted as they pass; lines of later splits are
    beyond the first ones.
    """

    def count(batches):
        import numpy as np

        own, seen = None, 0
        for batch in batches:
            files, starts = batch.column("_path").to_pylist(), batch.column("_block").to_pylist()
            at = np.empty(len(files), np.int32)
            for i, split in enumerate(zip(files, starts, strict=True)):
                if split != own:
                    own, seen = split, 0 if split[1] == 0 else upto
                at[i] = min(seen, upto)
                seen += 1
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("file"), batch.column("_path"), pa.array(at)], names=["value", "file", "path", "at"])

    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return lines.mapInArrow(count, "value string, file string, path string, at int")


def read_lines(spark: SparkSession, path: str | list[str], skip: int = 0) -> DataFrame:
    """(value): the lines of text files without the first ``skip`` of each file, which must be in its first split.  Files with fewer lines give none."""
    return _placed_lines(spark, path, skip).where(F.col("at") >= skip).select("value") if skip else spark.read.text(path)


def read_tsv(spark: SparkSession, path: str, schema: str, preamble: str = "#", usecols: list[str] | None = None, skip: int = 0) -> DataFrame:
    """Tab-separated text whose preamble lines begin with a sign that no data line begins with, or are the first ``skip`` of each file."""
    if skip:
        df = read_lines(spark, path, skip).where(F.trim("value") != "").select(F.from_csv("value", F.lit(schema), {"sep": "\t"}).alias("_r")).select("_r.*")
    else:
        df = spark.read.schema(schema).csv(path, sep="\t", comment=preamble)
    return df.select(*usecols) if usecols else df


def whitespace_fields(line: Column, names: list[str]) -> list[Column]:
    """The fields of a line split on runs of white space; missing ones are null."""
    parts = F.split(F.trim(line), r"\s+")
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def read_whitespace(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The first fields of each line under the given names; missing ones are null, further ones and blank lines are left out."""
    return spark.read.text(path).where(F.trim("value") != "").select(*whitespace_fields(F.col("value"), names))


def read_many(spark: SparkSession, paths: list[str] | str, tag: str, pattern: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """All files of a glob in one scan, with a column taken from each file's name by a pattern's first group."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema else reader).load(paths)
    return df.withColumn(tag, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def _grams(text: Column, size: int) -> Column:
    """The different stretches of ``size`` signs of a text."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def match_files(files: DataFrame, wanted: DataFrame, name: str, part: str, must: str | None = None, gram: int = 3) -> DataFrame:
    """Rows of ``files`` whose name contains a row's ``part`` of the metadata (and ``must``), with that row.

    Both tables may have any size: a part is looked up by the rarest of its stretches of ``gram`` signs among all names (shorter parts by
    themselves), and what that finds is held against the whole part.  A part with a stretch that no name has is left out before.  Null and
    empty parts match nothing; repeated rows of either table count each.
    """
    kept = files.where(F.contains(F.col(name), F.lit(must))) if must else files
    names = kept.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    parts = wanted.select(F.col(part).alias("_part")).where("length(_part) > 0").distinct().withColumn("_size", F.least(F.length("_part"), F.lit(gram)))
    sizes = sorted(r[0] for r in parts.select("_size").distinct().collect())  # at most ``gram`` of them
    of = lambda text, size: F.coalesce(*[F.when(size == k, _grams(F.col(text), k)) for k in sizes]) if sizes else F.array().cast("array<string>")
    inside = names.select("_name", F.explode(F.concat(*[_grams(F.col("_name"), k) for k in sizes]) if sizes else F.array().cast("array<string>")).alias("_gram"))
    counts = inside.groupBy("_gram").agg(F.count("*").alias("_n"))
    listed = parts.select("_part", F.explode(of("_part", F.col("_size"))).alias("_gram"))
    rarest = listed.join(counts, "_gram", "left").groupBy("_part").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all")).where("_all")
    hits = inside.join(rarest.select("_part", "_gram"), "_gram").where(F.contains("_name", F.col("_part"))).select("_name", "_part")
    return kept.join(hits, kept[name] == hits["_name"]).join(wanted, F.col("_part") == wanted[part]).drop("_name", "_part")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): the id is the second field of a header with bars, else its first word.

    A record begins with ``>`` at the start of a line, so headers may hold that sign; line ends may be of either kind.  A header
    without a sequence gives an empty one; a file begins with a header or with blank lines.
    """
    # records are cut at "\n>": only what a file begins with still has its own sign
    parts = spark.read.option("lineSep", "\n>").text(path).where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    records = parts.select(F.regexp_replace("value", "^>", "").alias("value"))
    head = F.rtrim(F.split("value", "\n")[0], F.lit("\r"))
    bars = F.split(head, r"\|")
    name = F.when(F.size(bars) > 1, bars[1]).otherwise(F.split(head, r"\s")[0])
    body = F.regexp_replace(F.substring(F.col("value"), F.length(F.split("value", "\n")[0]) + 1, F.length("value")), r"\s", "")
    return records.select(name.alias("id"), body.alias("seq"))


def mixed_layout(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, location, type) of lines in two layouts.

    A first field with an underscore is a name before the fields; one that
    begins with a letter is the id; other lines are dropped.  An isoform
    suffix after a hyphen is cut from the id.
    """
    p = F.split(F.trim(F.col(column)), r"\s+")
    named, plain = F.contains(p[0], F.lit("_")), p[0].rlike("^[A-Za-z]")
    pick = lambda i: F.when(named, F.get(p, F.lit(i + 1))).otherwise(F.get(p, F.lit(i)))
    return lines.where(named | plain).select(F.split(pick(0), "-")[0].alias("id"), pick(1).alias("location"), pick(2).alias("type"))


def read_mixed_layout(spark: SparkSession, path: str | list[str], skip: int = 2) -> DataFrame:
    """mixed_layout of the lines of files, each with ``skip`` header lines."""
    return mixed_layout(read_lines(spark, path, skip))


def matrix_to_long(spark: SparkSession, paths: list[str] | str, sep: str = ",") -> DataFrame:
    """Matrices with a header of their own per file -> (file, row, column, value); cells that are no numbers are null.

    Lines are rows of their own, so a large matrix is many tasks' work; they meet the header of their file by its path.
    Cells beyond the header have no column name; missing ones give no row; blank lines and files with a header only give none.
    """
    lines = _placed_lines(spark, paths, 1)
    of = lambda: F.split(F.rtrim("value", F.lit("\r")), sep)
    heads = lines.where("at = 0").select(F.col("path").alias("_path"), of().alias("head"))
    rows = lines.where("at > 0 AND trim(value) <> ''").join(heads, F.col("path") == F.col("_path")).select("file", "head", of().alias("cells"))
    cells = rows.select("file", "head", F.col("cells")[0].alias("row"), F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("j", "cell"))
    return cells.select("file", "row", F.get("head", F.col("j") + 1).alias("column"), F.expr("try_cast(cell AS DOUBLE)").alias("value"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def region_tensor(df: DataFrame, region: str, order: str, features: str) -> DataFrame:
    """Residue table (region_id, pos, f): positions count from 1 within a region, which may be spread over tasks."""
    rows = numbered(df.select(F.col(region).alias("region_id"), F.col(order).alias("_order"), F.col(features).alias("f")), "_order", "_pos", ["region_id"])
    return rows.select("region_id", F.col("_pos").cast("int").alias("pos"), "f")
