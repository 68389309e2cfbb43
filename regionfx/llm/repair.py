"""Cheapest repair of conversations to turn order, by a checkpointed dynamic program.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``.  A row is kept, deleted or given another role, and
rows may be inserted; the state before a row is what has been read so far: nothing, s, u or a.  The least cost from each
state to the end (a vector of four numbers) is worked out backwards.  Only vectors at checkpoints are stored; walking forward
from a checkpoint, the vectors up to the next one are made again, and of the edits that reach the least cost the
one with the least letter is taken (D, I, K, R).

Checkpoints are on two levels.  A conversation is cut into blocks of rows, each a task's work: a block is first a matrix of
costs from state to state, from these come the vectors at the ends of blocks, then each block is
walked from every state that it may be entered in.  Within a block of n rows vectors are stored at about every sqrt(n)-th row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.digests import group_key, placed_turns, text_digests
from regionfx.llm.storage import discard, materialize

BLANKS = " \t\n\v\f\r"
START, S, U, A = range(4)
AFTER = np.array([U, U, A, U])  # state after an inserted or renamed row
DELETE, INSERT, RENAME, TRUNCATED, NEVER = 4, 3, 3, 3, 1 << 40
CODES = "suaoSUAOx."  # role's initial (o: another), large for truncated rows; x: must go; .: no row
#: Least costs of inserts alone, from state to state.
INSERTS = np.array([[0, NEVER, 3, 6], [NEVER, 0, 3, 6], [NEVER, NEVER, 0, 3], [NEVER, NEVER, 3, 0]])
#: From each state to the end of a conversation without further rows.
LAST = INSERTS[:, [START, A]].min(axis=1)


def _kept(code: str) -> np.ndarray:
    """State after keeping a row in each state, -1 where that isn't allowed."""
    return np.array({"s": [S, -1, -1, -1], "u": [U, U, -1, U], "a": [-1, -1, A, -1]}.get(code.lower(), [-1] * 4))


def _steps() -> np.ndarray:
    """Costs of one row of each code from state to state, inserts before it among them."""
    out = []
    for code in CODES:
        row = np.full((4, 4), NEVER)
        np.fill_diagonal(row, 0 if code == "." else DELETE)
        if code not in "x.":
            more = TRUNCATED * code.isupper()
            for i in range(4):
                row[i, AFTER[i]] = min(row[i, AFTER[i]], RENAME + more)
                if _kept(code)[i] >= 0:
                    row[i, _kept(code)[i]] = more
        out.append(row if code == "." else (INSERTS[:, :, None] + row[None]).min(axis=1))
    return np.array(out)


STEPS, KEPT = _steps(), np.array([_kept(c) for c in CODES])


def coded(blocks: list[str]) -> np.ndarray:
    """Numbers of the codes of each block, filled up with those of no row."""
    table = np.zeros(128, np.int8)
    table[[ord(c) for c in CODES]] = range(len(CODES))
    out = np.full((len(blocks), max(map(len, blocks), default=0)), len(CODES) - 1, np.int8)
    for i, b in enumerate(blocks):
        out[i, : len(b)] = table[np.frombuffer(b.encode(), np.uint8)]
    return out


def block_costs(codes: np.ndarray) -> np.ndarray:
    """Least costs from state to state over each block."""
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(codes), 4, 4))
    for t in range(codes.shape[1]):
        out = np.minimum((out[:, :, :, None] + STEPS[codes[:, t]][:, None]).min(axis=2), NEVER)
    return out


def backward(codes: np.ndarray, ends: np.ndarray, a: int, b: int, every: int = 1) -> dict[int, np.ndarray]:
    """Cost vectors before rows a..b of all blocks, from those before row b; stored where (row - a) is divisible by ``every``."""
    out, v = {b: ends}, ends
    for t in range(b - 1, a - 1, -1):
        v = (STEPS[codes[:, t]] + v[:, None, :]).min(axis=2)
        if (t - a) % every == 0:
            out[t] = v
    return out


def walks(codes: np.ndarray, ends: np.ndarray):
    """(letters, states, exits) of each block and each state that it is entered in: blocks x 4 x edits, zeros where there is none.

    ends: the cost vector after each block.  The edits are the least in letters among the cheapest.
    """
    n, length = codes.shape
    every = max(1, math.isqrt(length))
    points = backward(codes, ends, 0, length, every)
    at = np.broadcast_to(np.arange(4), (n, 4)).copy()
    row = np.arange(n)[:, None]
    letters, states = [], []
    for start in range(0, length, every):
        stop = min(length, start + every)
        v = backward(codes, points[stop], start, stop)
        for t in range(start, stop):
            code, here, there = codes[:, t][:, None], v[t], v[t + 1]
            left = np.broadcast_to(code != len(CODES) - 1, (n, 4)).copy()
            must = code == CODES.index("x")
            more = np.where((code >= 4) & (code < 8), TRUNCATED, 0)
            for turn in range(3):
                best = here[row, at]
                cut = left & (DELETE + there[row, at] == best)
                add = left & ~cut & (INSERT + here[row, AFTER[at]] == best) if turn < 2 else np.zeros_like(left)
                to = KEPT[code, at]
                keep = left & ~cut & ~add & ~must & (to >= 0) & (more + there[row, np.maximum(to, 0)] == best)
                other = left & ~cut & ~add & ~keep
                letters.append(np.select([cut, add, keep, other], [ord("D"), ord("I"), ord("K"), ord("R")], 0).astype(np.uint8))
                at = np.select([cut, add, keep, other], [at, AFTER[at], to, AFTER[at]], at)
                states.append(at.astype(np.uint8))
                left = add
                if not left.any():
                    break
    none = np.zeros((n, 4, 0), np.uint8)
    return (np.stack(letters, 2), np.stack(states, 2), at) if letters else (none, none, at)


def _sorted(*columns):
    return F.sort_array(F.collect_list(F.struct(*columns)))


def cost_matrices(blocks: DataFrame, at_once: int = 512) -> DataFrame:
    """(key, block, costs) of (key, block, codes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                flat = block_costs(coded(part.column("codes").to_pylist())).reshape(-1, 16)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("block"), pa.array(list(flat), pa.list_(pa.int64()))], names=["key", "block", "costs"])

    return blocks.select("key", "block", "codes").mapInArrow(run, "key string, block long, costs array<long>")


def border_vectors(matrices: DataFrame) -> DataFrame:
    """(key, cost, ends): the least cost of each conversation and the vectors after its blocks, from a row for each block."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cost, ends = [], []
            for x in batch.column("x").to_pylist():
                v, out = LAST, []
                for block in reversed(x):
                    out.append({"block": block["block"], "vector": v.tolist()})
                    v = np.minimum((np.array(block["costs"]).reshape(4, 4) + v).min(axis=1), NEVER)
                cost.append(int(v[START]))
                ends.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cost, pa.int64()), pa.array(ends, pa.list_(pa.struct([("block", pa.int64()), ("vector", pa.list_(pa.int64()))])))], names=["key", "cost", "ends"])

    per = matrices.groupBy("key").agg(_sorted("block", "costs").alias("x"))
    return per.mapInArrow(run, "key string, cost long, ends array<struct<block:long,vector:array<long>>>")


def block_walks(blocks: DataFrame, at_once: int = 256) -> DataFrame:
    """(key, block, exits, edits) of (key, block, codes, vector): for each state that a block is entered in its exit and its edits, a letter and the state after it each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                letters, states, exits = walks(coded(part.column("codes").to_pylist()), np.array(part.column("vector").to_pylist()))
                both = np.stack([letters, np.frombuffer(b"-sua", np.uint8)[states]], 3).reshape(*letters.shape[:2], -1)
                used = np.repeat(letters > 0, 2, axis=2)
                edits = [[x[u].tobytes().decode() for x, u in zip(*pair, strict=True)] for pair in zip(both, used, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("block"), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(edits, pa.list_(pa.string()))], names=["key", "block", "exits", "edits"])

    return blocks.select("key", "block", "codes", "vector").mapInArrow(run, "key string, block long, exits array<int>, edits array<string>")


def repair(conversations: DataFrame, rows_per_block: int = 1024):
    """(summary, repaired, scratch) of (conv_id, turn, role, text); scratch: written tables that these two read.

    summary: conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit.  repaired: conv_id, key, place, sub, role, text, edit in
    the order of (place, sub).  Rows are taken by turn, nulls first; those of one turn by role, a hash of the text and ``_copy``, if
    there is such a column.  A null role or text is one space; rows with a null conv_id are one conversation.  A blank row has nothing but
    white space, a duplicate's role and text came earlier, a truncated one doesn't end in a mark; the first of these
    counts.  Blank and duplicate rows go; of repairs with equal cost the one with the least audit is taken.  An empty
    table gives no rows, further columns are ignored.
    """
    more = ["_copy"] if "_copy" in conversations.columns else []
    rows = conversations.select(group_key("conv_id").alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), *more)
    rows = materialize(placed_turns(rows, *more), "turns")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = materialize(rows.select("key", "place", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), same.alias("same")), "facts")
    # the first row of each text is a place of its own, so the join back has no hot key
    first = facts.groupBy("key", "same").agg(F.min("place").alias("place")).select(F.col("key").alias("_key"), F.col("place").alias("_place"))
    marked = facts.join(first, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")), "left").withColumn("again", F.col("_key").isNull())
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("open"), "t").otherwise("-")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("blank") | F.col("again"), "x").when(F.col("open"), F.upper(role)).otherwise(role)
    cell = marked.select("key", "place", ((F.col("place") - 1) / rows_per_block).cast("long").alias("block"), "initial", fault.alias("fault"), code.alias("code"))
    per = cell.groupBy("key", "block").agg(_sorted("place", "initial", "code").alias("x"), *[F.count(F.when(F.col("fault") == f, 1)).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    pairs = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x")), lambda a, b: F.concat(a["initial"], b["initial"]))
    legal = ["su", "ua", "au"]
    blocks = per.select("key", "block", "blank", "duplicate", "truncated", F.array_join(F.transform("x", lambda c: c["code"]), "").alias("codes"), F.size(F.filter(pairs, lambda p: ~p.isin(legal))).cast("long").alias("illegal"), F.col("x")[0]["initial"].alias("head"), F.element_at("x", -1)["initial"].alias("tail"))
    blocks = materialize(blocks, "blocks")
    borders = materialize(border_vectors(cost_matrices(blocks)), "borders")
    vectors = borders.select("key", F.inline("ends"))
    walked = materialize(block_walks(blocks.select("key", "block", "codes").join(vectors, ["key", "block"])), "walks")
    # the state that each block is entered in, by a fold over the exits of those before it
    route = walked.groupBy("key").agg(_sorted("block", "exits").alias("x"))
    path = F.aggregate("x", F.array(F.lit(START)), lambda acc, b: F.concat(acc, F.array(F.get(b["exits"], F.element_at(acc, -1)))))
    route = route.select("key", F.element_at(path, -1).alias("last"), F.arrays_zip(F.transform("x", lambda b: b["block"]).alias("block"), F.slice(path, F.lit(1), F.size("x")).alias("entry")).alias("e"))
    route = materialize(route, "route")
    chosen = walked.join(route.select("key", F.inline("e")), ["key", "block"]).select("key", "block", F.get("edits", F.col("entry")).alias("edits"))
    chosen = materialize(chosen, "chosen")
    closing = F.when(F.col("last") == U, "I").when(F.col("last") == S, "II").otherwise("")
    audits = chosen.groupBy("key").agg(_sorted("block", "edits").alias("x")).join(route.select("key", closing.alias("closing")), "key").select("key", F.concat(F.regexp_replace(F.array_join(F.transform("x", lambda b: b["edits"]), ""), "(.).", "$1"), "closing").alias("audit"))
    between = F.zip_with(F.slice("b", F.lit(1), F.size("b") - 1), F.slice("b", F.lit(2), F.size("b")), lambda a, b: F.concat(a["tail"], b["head"]))
    counts = blocks.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], _sorted("block", "head", "tail").alias("b"))
    counts = counts.withColumn("illegal", F.col("illegal") + F.size(F.filter(between, lambda p: ~p.isin(legal)))).drop("b")
    turns = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = turns.join(counts, "key").join(borders.select("key", "cost"), "key").join(audits, "key").select("conv_id", "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, _repaired(rows, chosen, route, rows_per_block), [rows, facts, blocks, borders, walked, route, chosen]


def _repaired(rows: DataFrame, chosen: DataFrame, route: DataFrame, rows_per_block: int) -> DataFrame:
    """Rows after the edits of their blocks, each row's own letters looked up by its place; then what is inserted at the ends."""
    own = F.posexplode(F.regexp_extract_all("edits", F.lit("((?:I.)*[DKR].)"), F.lit(1))).alias("_i", "own")
    cut = chosen.select(F.col("key").alias("_key"), "block", own).select("_key", (F.col("block") * rows_per_block + F.col("_i") + 1).alias("_place"), "own")
    both = rows.join(cut, (F.col("key") == F.col("_key")) & (F.col("place") == F.col("_place")))
    named = lambda state: F.when(state == "u", "user").otherwise("assistant")
    row = lambda sub, role, text, edit: F.struct(sub.cast("int").alias("sub"), role.alias("role"), text.alias("text"), edit.alias("edit"))
    letter, state = F.substring("own", -2, 1), F.substring("own", -1, 1)
    added = F.transform(F.regexp_extract_all("own", F.lit("I(.)"), F.lit(1)), lambda s, i: row(i, named(s), F.lit(""), F.lit("I")))
    kept = F.when(letter == "D", F.array()).otherwise(F.array(row(F.lit(9), F.when(letter == "R", named(state)).otherwise(F.col("role")), F.col("text"), letter)))
    inner = both.select("conv_id", "key", "place", F.inline(F.concat(added, kept)))
    tail = F.when(F.col("last") == U, F.array(F.lit("assistant"))).when(F.col("last") == S, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array().cast("array<string>"))
    ends = route.select("key", F.posexplode(tail).alias("sub", "role"))
    ends = ends.join(rows.where("place = 1").select("key", "conv_id"), "key").select("conv_id", "key", F.lit(1 << 62).alias("place"), "sub", "role", F.lit("").alias("text"), F.lit("I").alias("edit"))
    return inner.unionByName(ends)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by a checksum of conversation and turn; nulls of the checked text, roles and texts are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("_k")).where("_k <> 0")
    copies = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    summary, repaired, scratch = repair(damaged(source))
    digests = text_digests(repaired, ["place", "sub"], F.concat("role", F.lit(":"), "text"), "\n")
    every = source.select("conv_id").distinct().withColumn("key", group_key("conv_id"))
    out = every.join(summary.drop("conv_id"), "key", "left").join(digests, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = materialize(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repairs")
    discard(*scratch)
    return out
