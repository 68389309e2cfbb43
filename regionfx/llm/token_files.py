"""Token-id files with directly addressable codes.

Ids are cut into 8-bit chunks, least significant first.  Level k of a file
holds the k-th chunk of every id that has one, one bitmap per level says which
of its ids go on in the next level, and a rank directory holds the number of
set bits before every 512th bit.  The place of an id in the next level is the
rank of its bit, so any id or range of ids is read by a few small range reads,
and no block is decoded.

File layout (little endian): magic ``RFXDAC01``; uint32 number of levels;
uint64 number of documents; uint64 number of ids; for each level a uint64
number of chunks; then doc_id (int64 each), a null flag (uint8 each) and the
first id of each document and one past the last (uint64, documents + 1); then for each
level its chunks (uint8), bitmap (uint64 words) and rank directory (uint64).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionfx.llm.storage import materialize, new_folder, open_filesystem, write_bytes
from regionfx.llm.words import chunks_of, library_vocabulary

MAGIC = b"RFXDAC01"
STEP = 512


def pack(ids: np.ndarray, doc_ids, starts: np.ndarray) -> list[bytes]:
    """The parts of a file.  doc_ids: a list, None allowed; starts: documents + 1 places in ids."""
    levels, left = [], ids.astype(np.uint64)
    while True:
        more = left > 255
        levels.append(((left & 255).astype(np.uint8), more))
        if not more.any():
            break
        left = left[more] >> np.uint64(8)
    head = MAGIC + struct.pack(f"<IQQ{len(levels)}Q", len(levels), len(doc_ids), len(ids), *(len(x) for x, _ in levels))
    out = [head, np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes(), np.array([x is None for x in doc_ids], dtype=np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for chunk, more in levels:
        bits = np.zeros(-(-len(more) // STEP) * STEP, dtype=bool)
        bits[: len(more)] = more
        words = np.packbits(bits, bitorder="little")
        counts = bits.reshape(-1, STEP).sum(axis=1)
        out += [chunk.tobytes(), words.tobytes(), np.append(0, np.cumsum(counts)).astype("<u8").tobytes()]
    return out


class TokenFile:
    """Random access to one file by range reads; only the header is held."""

    def __init__(self, uri: str):
        filesystem, path = open_filesystem(uri)
        self.file = filesystem.open_input_file(path)
        magic, n_levels, self.n_docs, self.n_ids = struct.unpack("<8sIQQ", self.file.read_at(28, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        sizes = struct.unpack(f"<{n_levels}Q", self.file.read_at(8 * n_levels, 28))
        at = 28 + 8 * n_levels
        self.docs_at, self.nulls_at, self.starts_at = at, at + 8 * self.n_docs, at + 9 * self.n_docs
        at += 9 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels = []
        for n in sizes:
            blocks = -(-n // STEP)
            self.levels.append((at, at + n, at + n + blocks * STEP // 8))
            at += n + blocks * STEP // 8 + 8 * (blocks + 1)

    def documents(self):
        """(doc ids with None for null, first id of each and one past the last)."""
        ids = np.frombuffer(self.file.read_at(8 * self.n_docs, self.docs_at), dtype="<i8").tolist()
        nulls = self.file.read_at(self.n_docs, self.nulls_at)
        starts = np.frombuffer(self.file.read_at(8 * (self.n_docs + 1), self.starts_at), dtype="<u8").astype(np.int64)
        return [None if z else x for x, z in zip(ids, nulls, strict=True)], starts

    def _bits(self, level: int, a: int, b: int):
        """Continuation bits a..b-1 of a level, and how many bits before a are set."""
        _, bits_at, ranks_at = self.levels[level]
        block = a // STEP
        last = -(-b // STEP)
        words = self.file.read_at((last - block) * STEP // 8, bits_at + block * STEP // 8)
        bits = np.unpackbits(np.frombuffer(words, dtype=np.uint8), bitorder="little").astype(bool)
        before = struct.unpack("<Q", self.file.read_at(8, ranks_at + 8 * block))[0] + int(bits[: a - block * STEP].sum())
        return bits[a - block * STEP : b - block * STEP], before

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the file."""
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        out = np.zeros(b - a, dtype=np.uint32)
        rows, level = np.arange(b - a), 0
        while b > a:
            chunk = np.frombuffer(self.file.read_at(b - a, self.levels[level][0] + a), dtype=np.uint8)
            out[rows] |= chunk.astype(np.uint32) << np.uint32(8 * level)
            more, before = self._bits(level, a, b)
            rows, a, level = rows[more], before, level + 1
            b = a + len(rows)
        return out

    def token(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, ids_per_file: int = 4_000_000, folder: str | None = None) -> DataFrame:
    """Encode ``text`` and write token files in ascending doc_id order; one row per file.

    The documents are range-partitioned by doc_id (null first; ties: by a hash
    of the text, repeated rows in any order, so that many rows of one id are split)
    before they are encoded; what is sampled for the ranges is those small
    keys.  Each task writes files of about ``ids_per_file`` ids (a longer
    document is a file of its own).  Null
    texts count as empty; an empty table gives no file.
    Columns: part, file_no, uri, n_docs, n_ids; they are written before this
    function returns.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = ordered.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def write(batches):
        import pyarrow as pa

        vocabulary = library_vocabulary(tokenizer_path)
        part, file_no = TaskContext.get().partitionId(), 0
        held, doc_ids, lengths, total = [], [], [], 0

        def flush():
            nonlocal held, doc_ids, lengths, total, file_no
            uri = f"{folder}/part-{part:06d}-{file_no:06d}.dac"
            write_bytes(uri, pack(np.concatenate(held), doc_ids, np.append(0, np.cumsum(lengths))))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file_no": pa.array([file_no], pa.int32()), "uri": [uri], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([total], pa.int64())})
            held, doc_ids, lengths, total, file_no = [], [], [], 0, file_no + 1
            return row

        for table in chunks_of(batches, "text", 1 << 20):
            values, counts = vocabulary.encode_texts(table.column("text").combine_chunks())
            if end_id is not None:
                values, counts = np.insert(values, np.cumsum(counts), end_id), counts + 1
            held.append(values.astype(np.uint32))
            doc_ids += table.column("doc_id").to_pylist()
            lengths += counts.tolist()
            total += len(values)
            if total >= ids_per_file:
                yield flush()
        if doc_ids:
            yield flush()

    return materialize(ordered.mapInArrow(write, "part int, file_no int, uri string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents in earlier files and places.  The
    window below runs over one row per file, not over documents.
    """
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = files.repartition(max(1, manifest.count()), "uri")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(uri)
                doc_ids, starts = file.documents()
                crcs = []
                for lo in range(0, file.n_docs, 512):
                    hi = min(file.n_docs, lo + 512)
                    ids = memoryview(file.read(int(starts[lo]), int(starts[hi])).astype("<u4").tobytes())
                    cuts = ((starts[lo : hi + 1] - starts[lo]) * 4).tolist()
                    crcs += [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(starts), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
