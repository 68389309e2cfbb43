"""Exact BM25 top-k over sharded inverted indexes with block-max WAND pruning.

Tasks that read documents write shards: postings by word, with the documents of
a shard in blocks of like ones.  Scores use statistics of all documents, so what the shards give
merges to the exact best of all.

A task owns some queries and walks all shards with them, many queries at a time.  The k-th best score so
far is carried from shard to shard as a query's threshold.  The postings of a query's rare words are
walked, its frequent words only bounded: a block of documents goes on only
if its documents' greatest sum of rare words and the frequent words' greatest weights in the block reach the threshold.
Blocks that go on get the frequent words' weights added as products of tiles (queries by documents) in
single precision, whose error is part of the bound, and what reaches the threshold then is scored
in full in double precision.  All steps are array operations.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.licences import WORD_BYTES, words_of
from regionfx.llm.storage import materialize, new_folder, open_filesystem, write_bytes
from regionfx.llm.words import chunks_of

K1, B = 1.2, 0.75
BLOCK_DOCS = 32
#: Blocks side by side that are scored in one product.
TILE_BLOCKS = 8
#: Words that more than this share of a shard's documents have are frequent: held as rows of weights by document, with their greatest ones by block.
DENSE_SHARE = 1 / 24
#: Queries that meet a shard at once.
QUERIES_AT_ONCE = 256
#: Of a query with more hits than this in a shard all postings are walked; the weights of fewer are looked up.
FEW_HITS = 12
#: A task gets so many queries at least.
LEAST_QUERIES = 128
SLACK = 1e-6  # of bounds, for rounding
FLOAT_ERROR = 2.0**-24


def by_likeness(table: np.ndarray, size: np.ndarray, groups: int = 8) -> np.ndarray:
    """An order of the rows of a table (rows by words) that puts like ones side by side: by the nearest of some rows far from each other, of which like ones follow each other, then by size."""
    n_words = (table > 0).sum(axis=1)
    unit = table / np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-9)
    full, near, chosen = n_words >= 0.5 * np.median(n_words), [], [int(np.argmax(n_words))]
    for _ in range(groups):
        near.append(unit @ unit[chosen[-1]])
        chosen.append(int(np.argmin(np.where(full, np.max(near, axis=0), 2))))
    near, turn = np.array(near), [0]
    while len(turn) < groups:
        turn.append(max(set(range(groups)) - set(turn), key=lambda i: near[i, chosen[turn[-1]]]))
    return np.lexsort((size, np.argmax(near[turn], axis=0)))


def build_shard(doc_ids, texts) -> tuple[bytes, object, np.ndarray, int]:
    """(file content, the words (pyarrow), document frequency of each, number of words) of arrays (pyarrow) of ids and texts without nulls."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pa.array([t.as_py().encode().translate(WORD_BYTES).decode() for t in texts], pa.string()))
    n = max(1, len(texts))
    pairs = np.repeat(np.arange(len(texts), dtype=np.int64), lists.value_lengths().to_numpy())
    coded = lists.flatten().dictionary_encode()
    del lists
    words, codes = coded.dictionary, coded.indices.to_numpy()
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        full = codes != empty
        pairs, codes = pairs[full], codes[full]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
    n_words, lengths = len(codes), np.bincount(pairs, minlength=len(texts)).astype(np.int32)
    pairs += codes.astype(np.int64) * n
    del coded, codes
    pairs.sort()
    begins = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if n_words else np.zeros(0, np.int64)
    tf = np.diff(np.append(begins, n_words)).astype(np.int32)
    pairs = pairs[begins]
    at, code = (pairs % n).astype(np.int32), pairs // n
    df = np.bincount(code, minlength=len(words)).astype(np.int64)
    often = np.flatnonzero(df > DENSE_SHARE * n)
    row = np.full(len(words), -1, np.int32)
    row[often] = np.arange(len(often))
    common = row[code] >= 0
    table = np.zeros((len(texts), len(often)), np.float32)
    table[at[common], row[code[common]]] = 1
    order = by_likeness(table, lengths)
    place = np.empty(len(texts), np.int32)
    place[order] = np.arange(len(texts), dtype=np.int32)
    at = place[at]
    again = np.argsort(code * n + at)
    at, tf, lengths, doc_ids = at[again], tf[again], lengths[order], doc_ids.take(pa.array(order))
    text, ends = b"".join(w.encode() for w in words.to_pylist()), np.append(0, np.cumsum(pc.binary_length(words).to_numpy()))
    out = io.BytesIO()
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
    np.savez(out, doc_ids=pc.fill_null(doc_ids, 0).to_numpy(), nulls=nulls, lengths=lengths, words=np.frombuffer(text, np.uint8), ends=ends.astype(np.int32), df=df, doc=at, tf=tf)
    return out.getvalue(), words, df, n_words


class Shard:
    """An index of some documents as queries meet it that have these words (pyarrow) with these inverse document frequencies."""

    def __init__(self, filesystem, path: str, mean_length: float, words, idf: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        with filesystem.open_input_file(path) as f:
            z = np.load(io.BytesIO(f.read()))
        own = pa.StringArray.from_buffers(len(z["df"]), pa.py_buffer(z["ends"].tobytes()), pa.py_buffer(z["words"].tobytes()))
        self.doc_ids, self.nulls, self.df, self.doc = z["doc_ids"], z["nulls"], z["df"], z["doc"].astype(np.int64)
        self.n = len(self.doc_ids)
        tf, length = z["tf"].astype(np.float64), z["lengths"].astype(np.float64)
        norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        #: The row of each of the words, -1 for those that no document here has.
        self.row = pc.fill_null(pc.index_in(words, value_set=own), -1).to_numpy().astype(np.int64)
        factor = np.zeros(len(self.df))
        factor[self.row[self.row >= 0]] = idf[self.row >= 0]
        self.weight = np.repeat(factor, self.df) * (tf * (K1 + 1) / (tf + norm[self.doc]))
        self.at = np.append(0, np.cumsum(self.df))
        self.key = np.repeat(np.arange(len(self.df)) * self.n, self.df) + self.doc  # ascending
        dense = np.flatnonzero((self.df > max(8, DENSE_SHARE * self.n)) & (factor > 0))
        self.dense_row = np.full(len(self.df), -1, np.int64)
        self.dense_row[dense] = np.arange(len(dense))
        self.n_blocks = -(-self.n // (BLOCK_DOCS * TILE_BLOCKS)) * TILE_BLOCKS
        self.width = self.n_blocks * BLOCK_DOCS
        rows = np.zeros((len(dense), self.width), np.float32)
        posts = _ranges(self.at[dense], self.df[dense])
        rows.ravel()[np.repeat(np.arange(len(dense)) * self.width, self.df[dense]) + self.doc[posts]] = self.weight[posts]
        self.block_greatest = rows.reshape(len(dense), self.n_blocks, BLOCK_DOCS).max(axis=2)
        #: For each tile the frequent words that it has, and their weights by document.
        self.tiles = []
        for i in range(0, self.n_blocks, TILE_BLOCKS):
            has = np.flatnonzero(self.block_greatest[:, i : i + TILE_BLOCKS].any(axis=1))
            self.tiles.append((has, rows[has, i * BLOCK_DOCS : (i + TILE_BLOCKS) * BLOCK_DOCS]))

    def best(self, words: np.ndarray, ends: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, documents, scores) of some queries, whose words (rows, or -1) end at ``ends``: all documents of the k best that score at least a query's ``least`` and above 0, and perhaps some more."""
        n_queries = len(ends) - 1
        query = np.repeat(np.arange(n_queries), np.diff(ends))[words >= 0]
        words = words[words >= 0]
        row = self.dense_row[words]
        dense = row >= 0
        asked = np.zeros((n_queries, len(self.block_greatest)), np.float32)
        asked[query[dense], row[dense]] = 1
        score = np.zeros((n_queries, self.width), np.float32)
        rare = words[~dense]
        for q, part in _runs(query[~dense]):
            score[q] = self._sums(rare[part])
        error = (asked.shape[1] + 64) * FLOAT_ERROR  # of sums in single precision, as a share
        low = least * (1 - error) - SLACK
        bound = asked @ self.block_greatest + score.reshape(n_queries, self.n_blocks, BLOCK_DOCS).max(axis=2)
        reach = ((bound >= low[:, None]) & (bound > 0)).reshape(n_queries, len(self.tiles), TILE_BLOCKS).any(axis=2)
        for i, (has, weights) in enumerate(self.tiles):
            part = slice(i * TILE_BLOCKS * BLOCK_DOCS, (i + 1) * TILE_BLOCKS * BLOCK_DOCS)
            who = np.flatnonzero(reach[:, i])
            score[who, part] += asked[who[:, None], has] @ weights
        new = np.flatnonzero(least <= 0)
        if len(new) and self.width > k:  # the k-th best here is a threshold too
            low[new] = np.maximum(low[new], np.partition(score[new], -k, axis=1)[:, -k] * (1 - 2 * error) - SLACK)
        hit_query, hit = np.nonzero((score >= low[:, None]) & (score > 0))
        return hit_query, hit, self._full(words, query, hit_query, hit)

    def _sums(self, words: np.ndarray) -> np.ndarray:
        """Sums of the words' weights by document."""
        posts = _ranges(self.at[words], self.df[words])
        return np.bincount(self.doc[posts], weights=self.weight[posts], minlength=self.width)

    def _full(self, words: np.ndarray, query: np.ndarray, hit_query: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Full scores of hits in order of their queries."""
        out = np.zeros(len(hit))
        n_hits = np.bincount(hit_query, minlength=int(query[-1]) + 1 if len(query) else 0)
        many = n_hits[query] > FEW_HITS
        for q, part in _runs(query[many]):
            mine = slice(*np.searchsorted(hit_query, [q, q + 1]))
            out[mine] = self._sums(words[many][part])[hit[mine]]
        few = np.flatnonzero(n_hits[hit_query] <= FEW_HITS)
        begins, ends = (np.searchsorted(query, hit_query[few], side) for side in ("left", "right"))
        at = _ranges(begins, ends - begins)
        key = words[at] * self.n + np.repeat(hit[few], ends - begins)
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = self.key[found] == key
        out[few] = np.bincount(np.repeat(np.arange(len(few)), ends - begins)[same], weights=self.weight[found[same]], minlength=len(few))
        return out


def _runs(values: np.ndarray):
    """(value, where) of runs of equal values."""
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    for a, b in zip(begins, np.append(begins, len(values))[1:], strict=True):
        yield values[a], slice(a, b)


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... for each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def build_index(docs: DataFrame, folder: str, shard_bytes: int = 16 << 20) -> DataFrame:
    """Write shards of (doc_id, text).  Returns rows (n_docs, n_words) of the shards and (word, df) of their words.

    Input splits are put together to about a shard each, with no shuffle, as every query meets every shard.
    """

    def write(batches):
        import pyarrow as pa

        for k, table in enumerate(chunks_of(batches, "text", shard_bytes)):
            content, words, df, n_words = build_shard(table.column("doc_id").combine_chunks(), table.column("text").combine_chunks())
            write_bytes(f"{folder}/shard-{TaskContext.get().partitionId():06d}-{k:06d}.npz", [content])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([n_words], pa.int64())], names=["word", "df", "n_docs", "n_words"])
            for i in range(0, len(words), 10_000):
                part = words[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([part, pa.array(df[i : i + 10_000], pa.int64()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())], names=["word", "df", "n_docs", "n_words"])
            del content, words
            pa.default_memory_pool().release_unused()

    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    source = source.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes)))
    return materialize(source.mapInArrow(write, "word string, df long, n_docs long, n_words long"), "index-rows")


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, shard_bytes: int = 16 << 20, queries_per_task: int = 8192, words_at_once: int = 2_000_000) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents with the highest BM25 score for each query (query_id, text).

    A query's distinct words count once each; documents without any of them
    aren't listed.  Equal scores (rounded to 9 places) are ranked by doc_id, null ids first.
    Rows of one query_id count as one query with the largest text; null and empty texts give no
    rows; repeated documents are ranked each by itself; empty tables give no rows; further columns are ignored.
    A task holds one shard and queries of ``words_at_once`` words; it gives k rows for each query, whatever the number of shards.
    Each task reads all shards, so queries are dealt over few tasks: as many as there are cores, or a multiple where these would have more than ``queries_per_task``.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "search")
    index = build_index(docs, folder, shard_bytes)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    n_docs = total["docs"] or 0
    mean = (total["words"] or 0) / max(1, n_docs)
    df = index.where("word is not null").groupBy("word").agg(F.sum("df").alias("df"))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for q, t in zip(batch.column("query_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = sorted(set(words_of(t)))
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(words), pa.int64()), pa.array([w.decode() for w in words])], names=["query_id", "word"])

    asked = queries.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.max("text").alias("text"))
    asked = asked.mapInArrow(split, "query_id long, word string")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df, "word").select("query_id", F.struct("word", idf.alias("idf")).alias("x")).groupBy("query_id").agg(F.sort_array(F.collect_list("x")).alias("words"))
    weighted = materialize(weighted, "queries")
    n_queries, cores = weighted.count(), spark.sparkContext.defaultParallelism
    n_tasks = max(1, min(-(-n_queries // min(LEAST_QUERIES, queries_per_task)), -(-n_queries // (queries_per_task * cores)) * cores))

    def search(batches):
        import pyarrow as pa
        from pyarrow import fs

        def like(held):
            """An order of queries by their usual words, as those side by side meet a shard at once."""
            words = pa.concat_arrays([w for _, w, _ in held]).dictionary_encode().indices.to_numpy()
            sizes = np.array([len(w) for _, w, _ in held])
            often = np.argsort(-np.bincount(words), kind="stable")[:1000]
            row = np.full(words.max() + 1, -1)
            row[often] = np.arange(len(often))
            found = row[words] >= 0
            table = np.zeros((len(held), len(often)), np.float32)
            table[np.repeat(np.arange(len(held)), sizes)[found], row[words[found]]] = 1
            return by_likeness(table, sizes)

        def walk(held):
            """The rows of some queries, from all shards."""
            held = [held[i] for i in like(held)]
            ids = [q for q, _, _ in held]
            words = pa.concat_arrays([w for _, w, _ in held])
            ends = np.append(0, np.cumsum([len(w) for _, w, _ in held]))
            coded = words.dictionary_encode()
            own = coded.indices.to_numpy()
            idf = np.zeros(len(coded.dictionary))
            idf[own] = np.concatenate([x for _, _, x in held])
            best = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))] * len(ids)  # score, id not null, id
            least = np.zeros(len(ids))
            filesystem, path = open_filesystem(folder)
            for name in sorted(x.path for x in filesystem.get_file_info(fs.FileSelector(path)) if x.path.endswith(".npz")):
                shard = Shard(filesystem, name, mean, coded.dictionary, idf)
                for first in range(0, len(ids), QUERIES_AT_ONCE):
                    part = ends[first : first + QUERIES_AT_ONCE + 1]
                    query, docs, scores = shard.best(shard.row[own[part[0] : part[-1]]], part - part[0], least[first : first + QUERIES_AT_ONCE], k)
                    scores, query = np.round(scores, 9), query + first
                    for i, mine in _runs(query):
                        s, named, at = best[i]
                        s, named, at = np.append(s, scores[mine]), np.append(named, ~shard.nulls[docs[mine]]), np.append(at, shard.doc_ids[docs[mine]])
                        keep = np.lexsort((at, named, -s))[:k]
                        best[i] = s[keep], named[keep], at[keep]
                        if len(keep) == k:
                            least[i] = s[keep[-1]]
            sizes = [len(s) for s, _, _ in best]
            rank = np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)
            s, named, at = (np.concatenate(x) for x in zip(*best, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes), pa.int64()) if None not in ids else pa.array([q for q, n in zip(ids, sizes, strict=True) for _ in range(n)], pa.int64()), pa.array(rank), pa.array(at, pa.int64(), mask=~named), pa.array(s)], names=["query_id", "rank", "doc_id", "score"])

        held, n = [], 0
        for batch in batches:
            for q, words in zip(batch.column("query_id").to_pylist(), batch.column("words"), strict=True):
                held.append((q, words.values.field("word"), words.values.field("idf").to_numpy()))
                n += len(words)
                if n >= words_at_once:
                    yield walk(held)
                    held, n = [], 0
        if held:
            yield walk(held)

    return weighted.repartition(n_tasks, "query_id").mapInArrow(search, "query_id long, rank int, doc_id long, score double")


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose doc_id is divisible by 50, by its whole text, against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id")
    return top_k(docs, queries)
