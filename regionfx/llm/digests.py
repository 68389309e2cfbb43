"""Conversations as groups of ordered rows: keys that are never null, places, and digests of long groups."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionfx.operators.sampling import numbered


def group_key(column: str) -> Column:
    """A text that is never null and differs for different values, null among them."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def placed_turns(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (key, turn, role, text) numbered from 1 within each key (``place``) by turn, nulls first.

    Rows of one turn follow each other by role, then by a hash of the text, then by ``more``; equal rows in any order.  Ranges of the
    order are dealt over tasks, so no task holds a long conversation.
    """
    named = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    return numbered(named, ["turn", "role", "_tie", *more, "_row"], "place", ["key"], small=False).drop("_tie", "_row")


def text_digests(rows: DataFrame, order: list[str], piece: Column, separator: str = "") -> DataFrame:
    """(key, digest): SHA-256 of the pieces of each key in order, in hexadecimal.

    A digest is made from one end to the other, so one task reads all pieces of a key; it reads them as a stream from
    a sort that spills, and holds a batch at a time whatever the length of the group.  Null pieces are left out.
    """

    def run(batches):
        import pyarrow as pa

        own, digest, between = None, None, separator.encode()
        for batch in batches:
            keys, digests = [], []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece"), strict=True):
                if key != own:
                    if own is not None:
                        keys.append(own)
                        digests.append(digest.hexdigest())
                    own, digest = key, hashlib.sha256()
                elif between:
                    digest.update(between)
                digest.update(piece.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], names=["key", "digest"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([digest.hexdigest()])], names=["key", "digest"])

    pieces = rows.select("key", *order, piece.alias("piece")).where("piece is not null")
    return pieces.repartition("key").sortWithinPartitions("key", *order).select("key", "piece").mapInArrow(run, "key string, digest string")
