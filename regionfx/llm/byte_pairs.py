"""Byte-level BPE by higher-order functions over distinct words, and decoding.

A first pass cuts the texts into pieces and counts in how many tasks each distinct piece
occurs.  Pieces that several tasks have are folded once for the corpus: a
projection of built-in higher-order functions runs the ranked merges over the
bytes of each, with the rank map as a literal of the plan, of the fixed size
of the vocabulary.  This table is kept to a stated number of pieces (the most
frequent ones) and written to the shared folder.  In the second pass an Arrow step gives the
pieces that neither the table nor the task has had before, the same
projection folds them, and a second Arrow step puts the documents' ids
together.  So only distinct pieces are shuffled, no group is collected, and
no task holds more than the table and a bounded number of pieces of its own.

The two Arrow steps of the second pass and the projection between them are narrow, so they form one stage, in which
rows keep their order: a document's row comes after those of its pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.storage import discard, materialize, open_filesystem
from regionfx.llm.words import chunks_of, once, ragged_take, room, split_pieces

LONG = 256  # bytes of a piece
BUCKETS = 1 << 14
NO_RANK = 2**31 - 1
PLACE = 1 << 31


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of lines with a base64 token and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: buckets by the CRC-32 of a token, each with its tokens and their ranks."""
    buckets = [{"k": [], "v": []} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        b = buckets[zlib.crc32(token) % BUCKETS]
        b["k"].append(base64.b64encode(token).decode())
        b["v"].append(rank)
    return F.from_json(F.lit(json.dumps(buckets)), "array<struct<k:array<binary>,v:array<int>>>")


def rank_of(table: Column, token: Column) -> Column:
    """The rank of a token (binary), or NO_RANK."""
    bucket = F.get(table, F.pmod(F.crc32(token), F.lit(BUCKETS)).cast("int"))
    return F.coalesce(F.get(bucket["v"], F.array_position(bucket["k"], token).cast("int") - 1), F.lit(NO_RANK))


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def fold_merges(words: Column, table: Column) -> Column:
    """Token ids of each of an array of words (binary, not empty): the pair of lowest rank, the first among equals, is merged until none has a rank.

    The fold's state has one number for each part: the rank of the part joined
    with the next one (NO_RANK after the last), then the part's first byte in the word.  The
    smallest number is the next merge; it takes one part away and looks up
    two ranks anew.
    """

    def folded(t: Column, word: Column) -> Column:
        n = F.length(word)
        begin = lambda key: key.bitwiseAND(PLACE - 1).cast("int")
        begin_of = lambda keys, i: F.coalesce(begin(F.get(keys, i)), n)
        rank = lambda a, z: rank_of(t, F.substring(word, a + 1, z - a))
        key = lambda rank, a: rank.cast("long") * PLACE + a
        last = key(F.lit(NO_RANK), n - 1)
        start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, key(rank(i, i + 2), i)).otherwise(last))

        def merge(keys: Column, low: Column, at: Column) -> Column:
            """at: the pair's first part, from 1."""
            left = key(rank(begin_of(keys, at - 2), begin_of(keys, at + 1)), begin_of(keys, at - 2))
            right = F.when(F.size(keys) > at + 1, key(rank(begin(low), begin_of(keys, at + 2)), begin(low))).otherwise(key(F.lit(NO_RANK), begin(low)))
            return F.transform(F.array_remove(keys, F.get(keys, at)), lambda k, i: F.when(i == at - 1, right).when(i == at - 2, left).otherwise(k))

        def step(keys: Column, _: Column) -> Column:
            pair = lambda low: F.when(low >= NO_RANK * PLACE, keys).otherwise(let(F.array_position(keys, low).cast("int"), lambda at: merge(keys, low, at)))
            return let(F.array_min(keys), pair)

        merged = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda keys: F.transform(keys, lambda k, i: rank(begin(k), begin_of(keys, i + 1))))
        return let(rank_of(t, word), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(merged))

    return let(table, lambda t: F.transform(words, lambda word: folded(t, word)))


def long_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a piece of any length, with the pairs in a heap: n log n steps instead of n * n."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end, heap = list(range(1, n + 1)), []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if end[i] != middle or after[i] >= n or end[after[i]] != last:
            continue  # one of the two parts has been merged meanwhile
        j = after[i]
        end[j], after[i], end[i] = 0, after[j], last
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def coded_pieces(texts, slice_bytes: int = 1 << 20):
    """(distinct pieces, place of each piece among them, pieces of each text); texts are cut a slice at a time."""
    import pyarrow as pa

    parts, counts = [], []
    for table in chunks_of(pa.table({"text": texts}).to_batches(), "text", slice_bytes):
        pieces, n = split_pieces(table.column("text").combine_chunks())
        parts.append(pieces)
        counts.append(n)
    if not parts:
        return pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    coded = pa.chunked_array(parts).dictionary_encode().unify_dictionaries()
    indices = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
    return coded.chunk(0).dictionary, indices, np.concatenate(counts)


def unseen(words, known):
    """(place of each word among ``known``, new ones behind them; the new words)."""
    import pyarrow.compute as pc

    found = pc.index_in(words, value_set=known)
    new = words.filter(found.is_null())
    index = pc.fill_null(found, -1).to_numpy().astype("<i4")
    index[index < 0] = np.arange(len(known), len(known) + len(new))
    return index, new


def frequent_words(source: DataFrame, ranks: dict[bytes, int], table_words: int, chunk_bytes: int, task_bytes: int) -> DataFrame:
    """(word, ids): the pieces of ``source`` (id, text) that several tasks have, at most ``table_words`` of them, those in the most tasks; written to the shared folder."""

    def distinct(batches):
        import pyarrow as pa

        known = pa.array([], pa.binary())
        for table in chunks_of(batches, "text", chunk_bytes):
            words, _, _ = coded_pieces(table.column("text").combine_chunks())
            _, new = unseen(words, known)
            known = pa.concat_arrays([known, new])
            for k in range(0, len(new), 10_000):
                yield pa.RecordBatch.from_arrays([new[k : k + 10_000]], names=["word"])
            if known.nbytes > task_bytes:
                known = known[:0]
            del words, new
            pa.default_memory_pool().release_unused()

    short = source.mapInArrow(distinct, "word binary").where(F.length("word") <= LONG)
    counts = materialize(short.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").withColumn("level", F.floor(8 * F.log2("n"))), "words")
    total, least = 0, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):  # 8 rows for each doubling of the tasks
        least = r["level"] if total + r["n"] <= table_words else r["level"] + 1
        total += r["n"]
        if least != r["level"]:
            break
    chosen = counts.where(F.col("level") >= least).select("word").repartition(max(8, min(total, table_words) // 10_000), "word")
    table = materialize(chosen.select("word", F.get(fold_merges(F.array("word"), rank_table(ranks)), 0).alias("ids")), "word-table")
    discard(counts)
    return table


def read_word_table(folder: str | None, column: str):
    """The column ``word`` or ``ids`` (pyarrow) of a table that frequent_words wrote, in the order of the files' names; read once in a worker."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    kind = {"word": pa.binary(), "ids": pa.list_(pa.int32())}[column]

    def read():
        filesystem, path = open_filesystem(folder)
        files = sorted(x.path for x in filesystem.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
        parts = [pq.ParquetFile(filesystem.open_input_file(f)).read(columns=[column]).column(column) for f in files]
        return pa.concat_arrays([c.cast(kind) for p in parts for c in p.chunks] or [pa.array([], kind)])

    return once(("word table", folder, column), read) if folder else pa.array([], kind)


def encode(docs: DataFrame, ranks: dict[bytes, int], chunk_bytes: int = 4 << 20, table_words: int = 750_000, task_bytes: int = 16 << 20, text: str = "text", id_col: str = "doc_id", then=None) -> DataFrame:
    """(id, ids): one row per document, ids as an array of int.

    then: (schema, function of Arrow batches of (id, ids)) for what the same
    worker makes of them instead.

    Null and empty texts have no ids.  Rows are encoded each by itself
    (repeated rows and null ids stay); an empty table gives no rows; other columns are left out.
    A text longer than ``chunk_bytes`` is a chunk of its own.  A task keeps ``task_bytes`` of pieces
    besides the table of at most ``table_words`` frequent ones and then starts anew.  Pieces of more than LONG bytes,
    for which the fold's n * n steps are too many, are merged with a heap.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = frequent_words(source, ranks, table_words, chunk_bytes, task_bytes)
    folder = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(words=None, given=None, docs=None):
            n = len(next(x for x in (words, given, docs and docs[0]) if x is not None))
            kinds = (pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())), pa.int64(), pa.binary())
            columns = [words, given, *(docs or (None, None))]
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, kinds, strict=True)], names=["words", "given", "id", "places"])

        common = read_word_table(folder, "word")
        known, own = common, 0
        for table in chunks_of(batches, "text", chunk_bytes):
            if own > task_bytes:
                known, own = common, 0
            if not own:  # an empty list stands for a new start
                yield rows(given=pa.array([[]], pa.list_(pa.list_(pa.int32()))))
            words, indices, counts = coded_pieces(table.column("text").combine_chunks())
            index, new = unseen(words, known)
            is_long = pc.greater(pc.binary_length(new), LONG)
            if pc.any(is_long).as_py():  # long ones first
                order = np.argsort(~is_long.to_numpy(zero_copy_only=False), kind="stable")
                place = np.empty(len(order), "<i4")
                place[order] = np.arange(len(order))
                index = np.where(index >= len(known), len(known) + place[np.maximum(index - len(known), 0)], index).astype("<i4")
                new = new.take(pa.array(order))
                n_long = pc.sum(is_long).as_py()
                yield rows(given=pa.array([[long_piece(x, ranks) for x in new[:n_long].to_pylist()]], pa.list_(pa.list_(pa.int32()))))
                short = new[n_long:]
            else:
                short = new
            known, own = pa.concat_arrays([known, new]), own + max(1, new.nbytes)
            cuts = [*range(0, len(short), 1024), len(short)] if len(short) else []
            for k in range(0, len(cuts) - 1, 16):
                part = cuts[k : k + 17]
                yield rows(words=pa.ListArray.from_arrays(pa.array([x - part[0] for x in part], pa.int32()), short[part[0] : part[-1]]))
            places = index[indices].tobytes()
            ends = np.append(0, np.cumsum(counts) * 4).tolist()
            for k in range(0, table.num_rows, 256):
                hi = min(table.num_rows, k + 256)
                yield rows(docs=(table.column("id").slice(k, hi - k).combine_chunks(), pa.array([places[a:b] for a, b in zip(ends[k:hi], ends[k + 1 : hi + 1], strict=True)], pa.binary())))
            del words, indices, index, new, short, places
            pa.default_memory_pool().release_unused()

    def gather(batches):
        import pyarrow as pa

        common = read_word_table(folder, "ids")
        common_words, common_values = len(common), len(common.values)
        values, offsets = np.zeros(common_values + (1 << 16), np.int32), np.zeros(common_words + (1 << 14), np.int64)
        values[:common_values], offsets[1 : common_words + 1] = common.values.to_numpy(), np.cumsum(common.value_lengths().to_numpy())
        n_words, n_values = common_words, common_values
        for batch in batches:
            is_words = batch.column("places").is_null().to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(is_words[1:] != is_words[:-1]) + 1).tolist(), len(batch)]
            for at, end in zip(turns, turns[1:], strict=False):
                part = batch.slice(at, end - at)
                if at < end and is_words[at]:
                    for lists in part.column("ids"):
                        ids = lists.values
                        if not len(ids):
                            n_words, n_values = common_words, common_values
                            continue
                        lengths, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
                        values, offsets = room(values, n_values + len(flat)), room(offsets, n_words + len(lengths) + 1)
                        values[n_values : n_values + len(flat)] = flat
                        offsets[n_words + 1 : n_words + 1 + len(lengths)] = n_values + np.cumsum(lengths)
                        n_words, n_values = n_words + len(lengths), n_values + len(flat)
                elif at < end:
                    places = part.column("places").cast(pa.large_binary())
                    bounds = np.frombuffer(places.buffers()[1], np.int64)[places.offset : places.offset + len(places) + 1]
                    index = np.frombuffer(places.buffers()[2] or b"", "<i4")[bounds[0] // 4 : bounds[-1] // 4]
                    flat, sizes = ragged_take(values, offsets[: n_words + 1], index.astype(np.int64))
                    last = np.append(0, np.cumsum(sizes))[(bounds - bounds[0]) // 4]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(flat, pa.int32()))], names=["id", "ids"])

    rows = source.mapInArrow(cut, "words array<binary>, given array<array<int>>, id long, places binary")
    folded = rows.select("id", "places", F.coalesce(fold_merges(F.col("words"), rank_table(ranks)), F.col("given")).alias("ids"))
    schema, last = then or ("id long, ids array<int>", lambda batches: batches)
    return folded.mapInArrow(lambda batches: last(gather(batches)), schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded`` (binary): the token bytes of ``ids`` joined.  Null ids give null; an id that isn't in the vocabulary is an error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema
    parts = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        parts[rank] = token

    def join(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            ids = batch.column("ids")
            out = pa.array([None if x is None else b"".join([parts[i] for i in x]) for x in ids.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.cast(arrow.field(k).type) for k, c in enumerate(batch.columns)], out], schema=arrow)

    return encoded.mapInArrow(join, schema)


def digests(ranks: dict[bytes, int], step: int = 1 << 20):
    """For encode's ``then``: (doc_id, n_tokens, ids_sha256, decoded_sha256); the ids are decoded and both forms hashed, about ``step`` ids at a time."""
    size = max(ranks.values(), default=-1) + 1

    def hashed(batches):
        import pyarrow as pa

        def tables():
            parts = [b""] * size
            for token, rank in ranks.items():
                parts[rank] = token
            return pa.array(parts, pa.binary()), pa.array([b"%d," % i for i in range(size)], pa.binary())

        parts, names = once(("digest tables", size, len(ranks)), tables)

        def joined(table, ids):
            """(the chosen rows joined, where each begins)"""
            got = table.take(ids)
            raw = got.buffers()[2]
            return memoryview(raw if raw is not None else b""), np.frombuffer(got.buffers()[1] or b"", np.int32)

        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            a, b, at = [], [], 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, side="right")) - 1)
                part = ids[int(ends[at]) : int(ends[to])]
                own = (ends[at : to + 1] - ends[at]).tolist()
                raw, begins = joined(names, part)
                a += [hashlib.sha256(raw[begins[x] : begins[y] - 1] if y > x else b"").hexdigest() for x, y in zip(own, own[1:], strict=False)]
                raw, begins = joined(parts, part)
                b += [hashlib.sha256(raw[begins[x] : begins[y]] if y > x else b"").hexdigest() for x, y in zip(own, own[1:], strict=False)]
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", hashed


def op1_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ranks, then=digests(ranks))
