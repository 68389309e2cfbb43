"""Packing of token pieces into sequences of a fixed capacity, certified by lower bounds.

Pieces are dealt over partitions of bounded size.  Each partition is packed by
best-fit decreasing, and a lower bound from dual-feasible functions says how
many sequences it needs at least.  What lies in the emptiest sequences of a
partition (those beyond the bound, and the last part-filled ones) is exchanged:
neighbouring partitions' pieces meet in the next round and are packed again,
until one partition is left.  Only those few open sequences move, so the
rounds after the first are small.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.storage import materialize
from regionfx.llm.words import chunks_of, library_vocabulary

COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best bound of two families of dual-feasible functions.

    u_k maps x to floor((k+1)x/C) / k, or to x/C where (k+1)x/C is whole; the
    other family maps x to 1, x/C or 0 for x > C-t, t <= x <= C-t and x < t.
    A function f is dual-feasible if f sums to at most 1 over any full
    sequence; the sum of f over all pieces then bounds their number.  All is
    computed in whole numbers.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 33):
        q, r = np.divmod((k + 1) * sizes, capacity)
        # times k * capacity: whole multiples keep x/C, others floor/k
        value = np.where(r == 0, k * sizes, q * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    for t in np.unique(np.append(sizes[sizes <= capacity // 2], capacity // 2)).tolist():
        value = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that has room.

    Bins with the same room are interchangeable, so they are kept in one stack
    per room; a bit set over the rooms finds the fullest bin that fits.
    """
    bins = np.zeros(len(lengths), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if room > size:
            stacks[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def split_document(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have the full capacity."""
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)] if n_tokens else []


def document_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode ``text`` (null: empty), add ``end_id`` and cut; one row per piece, without the ids themselves."""

    def cut(batches):
        import pyarrow as pa

        vocabulary = library_vocabulary(tokenizer_path)
        for table in chunks_of(batches, "text", 1 << 20):
            values, counts = vocabulary.encode_texts(table.column("text").combine_chunks())
            values, counts = np.insert(values, np.cumsum(counts), end_id), counts + 1
            raw, at, out = memoryview(values.astype("<u4").tobytes()), 0, []
            for doc_id, n in zip(table.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                out += [(doc_id, k, s, size, zlib.crc32(raw[4 * (at + s) : 4 * (at + s + size)])) for k, (s, size) in enumerate(split_document(n, capacity))]
                at += n
            a = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.int64()), pa.array(a[4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(cut, COLUMNS)


def pack_pieces(pieces: DataFrame, capacity: int, pieces_per_part: int = 40_000, meet: int = 8) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32; lengths 1 to capacity).

    Every row is placed exactly once, repeated rows and null ids included; an
    empty table gives no rows.  ``meet`` partitions' open sequences are packed
    together in each further round.
    """
    return certified_packing(pieces, capacity, pieces_per_part, meet)[0]


def certified_packing(pieces: DataFrame, capacity: int, pieces_per_part: int = 40_000, meet: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pack_pieces' rows, certificates).

    Certificates: a row for each partition of each round (turn, part, pieces, sequences, bound, closed): its
    best-fit decreasing packing has ``sequences``, no packing of its pieces has fewer than ``bound``, and ``closed`` of
    them stay as they are while the others' pieces go on to the next round.
    """
    pieces = materialize(pieces, "pieces")
    parts = max(1, -(-pieces.count() // pieces_per_part))

    def pack(last: bool, turn: int):
        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(pdf["part"].iloc[0])
            pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            lengths = pdf["length"].to_numpy()
            bins = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            bound = lower_bound(lengths, capacity)
            gap = len(fill) - bound
            free = capacity - fill
            # open: the emptiest sequences, one more for each that the bound doesn't certify, and as many as could be filled from them
            openings = np.zeros(len(fill), dtype=bool)
            if not last:
                openings[np.argsort(-free, kind="stable")[: 4 * (gap + 1)]] = True
                openings &= free > 0
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            begins = np.append(0, np.cumsum(fill))[:-1]
            offset = np.empty(len(pdf), dtype=np.int64)
            offset[order] = ends - lengths[order] - begins[bins[order]]
            pdf["sequence_id"] = (np.int64(turn) << 56) + (np.int64(part) << 24) + bins
            pdf["offset"] = offset
            pdf["is_open"] = openings[bins]
            pdf["n_sequences"], pdf["bound"], pdf["n_closed"] = len(fill), bound, len(fill) - int(openings.sum())
            pdf["piece"] = pdf["piece"].astype("int32")
            return pdf

        return f

    row = F.xxhash64(F.monotonically_increasing_id())
    todo = pieces.withColumn("part", F.pmod(row, F.lit(parts)).cast("int"))
    done, proofs, turn = [], [], 0
    while True:
        packed = materialize(todo.groupBy("part").applyInPandas(pack(parts == 1, turn), f"{COLUMNS}, part int, sequence_id long, offset long, is_open boolean, n_sequences long, bound long, n_closed long"), "packed")
        proofs.append(packed.groupBy(F.lit(turn).alias("turn"), "part").agg(F.count("*").alias("pieces"), *[F.first(f).alias(t) for f, t in (("n_sequences", "sequences"), ("bound", "bound"), ("n_closed", "closed"))]))
        packed = packed.drop("n_sequences", "bound", "n_closed")
        done.append(packed.where(~F.col("is_open")).drop("is_open", "part"))
        if parts == 1:
            break
        parts, turn = -(-parts // meet), turn + 1
        todo = packed.where("is_open").drop("is_open", "sequence_id", "offset").withColumn("part", F.floor(F.col("part") / meet).cast("int"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, proofs)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_pieces(document_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048), capacity=2048)
