"""Conversations formatted as training windows of a token budget, with a loss mask.

A turn is written as ``<turn>role``, a line end, the text and ``</turn>`` with a line end.  In roles and texts a backslash becomes
two and ``<`` becomes ``\\l`` (in roles also a line end ``\\n``), so a formatted text has ``<`` in marks only and reads back without loss.

Prefix sums of the turns' tokens choose spans of whole turns: a window has the conversation's leading system turn, a few
turns that an earlier window ended with, then new turns as long as they fit.  Only the texts of new assistant turns are under the
loss mask, so each is a target once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.digests import group_key, placed_turns, text_digests
from regionfx.llm.storage import discard, materialize
from regionfx.llm.words import chunks_of, library_vocabulary

OPEN, CLOSE, TARGET = "<turn>", "</turn>\n", "assistant"
SPANS = "array<struct<start:int,end:int>>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column, role: bool = False) -> Column:
    """What ``escaped`` was given: parts between doubled backslashes, each with its marks read back."""

    def part(p):
        p = F.replace(p, F.lit("\\l"), F.lit("<"))
        return F.replace(p, F.lit("\\n"), F.lit("\n")) if role else p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))


def spans(tokens: np.ndarray, n_context: int, system: int, budget: int, history: int, history_tokens: int) -> list[tuple[int, int, int]]:
    """(first repeated turn, first new turn, one past the last) of the windows of a section.

    tokens: of ``n_context`` turns before the section, then of its own; system: tokens that each window spends on the system turn.
    A turn that doesn't fit even alone is a window of its own, beside the system turn.
    """
    sums = np.append(0, np.cumsum(tokens))
    out, i = [], n_context
    while i < len(tokens):
        lead = max(0, i - history)
        while lead < i and (sums[i] - sums[lead] > history_tokens or system + sums[i + 1] - sums[lead] > budget):
            lead += 1
        end = max(i + 1, int(np.searchsorted(sums, sums[lead] + budget - system, side="right")) - 1)
        out.append((lead, i, end))
        i = end
    return out


def with_tokens(rows: DataFrame, piece: str, tokenizer_path: str) -> DataFrame:
    """Adds ``tokens``, the number of tokens of a column's texts, and drops that column."""
    kept = [f for f in rows.schema.fields if f.name != piece]

    def count(batches):
        import pyarrow as pa

        vocabulary = library_vocabulary(tokenizer_path)
        for table in chunks_of(batches, piece, 1 << 20):
            counts = vocabulary.encode_texts(table.column(piece).combine_chunks())[1]
            yield from table.drop_columns([piece]).append_column("tokens", pa.array(counts, pa.int64())).combine_chunks().to_batches()

    return rows.select(*[f.name for f in kept], piece).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens long")


def window_plan(turns: DataFrame, budget: int, history: int, history_tokens: int, turns_per_section: int) -> DataFrame:
    """(key, section, window, place, repeated) for each turn of each window, of (key, place, tokens, is_system).

    Windows are chosen within sections of a fixed number of turns, each with the few turns before it as its history, so a long
    conversation is many small groups.  ``window`` is the place of its first new turn; repeated: 2 for the system turn, 1 for history.
    """
    section = ((F.col("place") - 1) / turns_per_section).cast("long")
    bare = turns.select("key", "place", "tokens", section.alias("section"))
    late = (F.col("place") - 1) % turns_per_section >= turns_per_section - history
    rows = bare.withColumn("context", F.lit(0)).unionByName(bare.where(late).withColumn("section", F.col("section") + 1).withColumn("context", F.lit(1)))
    per = rows.groupBy("key", "section").agg(F.sort_array(F.collect_list(F.struct("place", "tokens", "context"))).alias("x"), F.max(1 - F.col("context")).alias("own")).where("own = 1")
    systems = turns.where("is_system").select("key", F.col("tokens").alias("system"))
    per = per.join(systems, "key", "left")

    def plan(batches):
        import pyarrow as pa

        for batch in batches:
            for key, section, x, system in zip(*[batch.column(c).to_pylist() for c in ("key", "section", "x", "system")], strict=True):
                # the system turn itself leads the first section, and isn't history
                x = [t for t in x if not (system is not None and t["place"] == 1)] if system is not None else x
                first = section == 0 and system is not None
                places = np.array([t["place"] for t in x], np.int64)
                found = spans(np.array([t["tokens"] for t in x], np.int64), sum(t["context"] for t in x), system or 0, budget, history, history_tokens)
                out = {"window": [], "place": [], "repeated": []}
                if first and not found:
                    found = [(0, 0, 0)]
                for n, (lead, new, end) in enumerate(found):
                    own = first and n == 0  # here the system turn is new
                    window = 1 if own else int(places[new])
                    listed = ([1] if system is not None else []) + places[lead:end].tolist()
                    flags = ([0 if own else 2] if system is not None else []) + [1] * (new - lead) + [0] * (end - new)
                    out["window"] += [window] * len(listed)
                    out["place"] += listed
                    out["repeated"] += flags
                n = len(out["place"])
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([section] * n, pa.int64()), pa.array(out["window"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["repeated"], pa.int32())], names=["key", "section", "window", "place", "repeated"])

    return per.select("key", "section", "x", "system").mapInArrow(plan, "key string, section long, window long, place long, repeated int")


def format_conversations(conversations: DataFrame, tokenizer_path: str, budget: int = 2048, history: int = 2, history_share: float = 0.25, turns_per_section: int = 4096):
    """(windows, scratch) of (conv_id, turn, role, text); scratch: written tables that windows reads.

    windows: conv_id, key, window (place of its first new turn), text, loss (spans of code points under the mask), n_repeated (turns at its front
    that an earlier window has too), n_turns, n_tokens.  Turns are taken by turn, nulls first, those of one turn by role and a hash of the text.
    Null roles and texts are empty; rows with a null conv_id are one conversation.  A leading turn of the role ``system`` is in each window.
    History is at most ``history`` turns and that share of the budget, and gives way where a new turn wouldn't fit; a turn that doesn't
    fit alone makes a window beyond the budget, never cut.  Windows don't go across multiples of ``turns_per_section``
    turns.  Tokens are counted turn by turn, marks among them.  An empty table gives no windows; further columns are ignored.
    """
    rows = conversations.select(group_key("conv_id").alias("key"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = F.concat(head(F.col("role")), escaped(F.col("text")), F.lit(CLOSE))
    turns = materialize(with_tokens(placed_turns(rows).withColumn("_piece", piece), "_piece", tokenizer_path), "turns")
    small = turns.select("key", "place", "tokens", ((F.col("place") == 1) & (F.col("role") == "system")).alias("is_system"))
    plan = materialize(window_plan(small, budget, history, int(budget * history_share), turns_per_section), "plan")
    # a system turn meets the windows of one section at a time, so that a long conversation's isn't one join key
    systems = turns.where("place = 1 and role = 'system'").join(plan.where("repeated = 2").select(F.col("key").alias("_key"), "section").distinct(), F.col("key") == F.col("_key")).drop("_key")
    p = plan.withColumnsRenamed({"key": "_key", "place": "_place", "section": "_section"})
    own = p.where("repeated < 2").join(turns, (F.col("_key") == F.col("key")) & (F.col("_place") == F.col("place"))).drop("turn")
    lead = p.where("repeated = 2").join(systems, (F.col("_key") == F.col("key")) & (F.col("_section") == F.col("section"))).drop("section", "turn")
    listed = own.unionByName(lead).select("key", "conv_id", "window", F.struct((F.col("repeated") != 2).alias("rest"), "place", "repeated", "role", "text", "tokens").alias("t"))
    grouped = listed.groupBy("key", "window").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("t")).alias("t"))
    cell = F.transform("t", lambda t: F.struct(head(t["role"]).alias("head"), escaped(t["text"]).alias("body"), ((t["role"] == TARGET) & (t["repeated"] == 0)).alias("loss")))
    grouped = grouped.withColumn("c", cell)

    def step(acc, c):
        start = acc["at"] + F.length(c["head"])
        end = start + F.length(c["body"])
        mask = F.when(c["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), mask.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    loss = F.aggregate("c", zero, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("c", lambda c: F.concat(c["head"], c["body"], F.lit(CLOSE))), "")
    n_repeated = F.size(F.filter("t", lambda t: t["repeated"] > 0))
    n_tokens = F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return grouped.select("conv_id", "key", "window", text.alias("text"), loss.alias("loss"), n_repeated.alias("n_repeated"), F.size("t").alias("n_turns"), n_tokens.alias("n_tokens")), [turns, plan]


def read_turns(windows: DataFrame) -> DataFrame:
    """(key, window, i, role, text) of the turns that a window has new, read from its text."""
    parts = F.slice("parts", F.col("n_repeated") + 1, F.size("parts"))
    cut = windows.withColumn("parts", F.split("text", CLOSE, -1)).withColumn("parts", F.slice("parts", F.lit(1), F.size("parts") - 1))
    flat = cut.select("key", "window", F.posexplode(parts).alias("i", "p"))
    line = F.instr("p", "\n")
    role = F.substring(F.col("p"), F.lit(len(OPEN) + 1), line - len(OPEN) - 1)
    return flat.select("key", "window", "i", unescaped(role, role=True).alias("role"), unescaped(F.substring(F.col("p"), line + 1, F.length("p"))).alias("text"))


def read_targets(windows: DataFrame) -> DataFrame:
    """(key, window, i, target) of the texts under the loss mask, unescaped."""
    flat = windows.select("key", "window", "text", F.posexplode("loss").alias("i", "s"))
    return flat.select("key", "window", "i", unescaped(F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))).alias("target"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more (-7) of two turns that hold the marks of templates; read back from the written windows."""
    import public_tokenizers

    source = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    kind = {f.name: f.dataType for f in source.schema.fields}
    own = spark.range(1).select(F.lit(-7).cast(kind["conv_id"]).alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast(kind["turn"]).alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in ((0, "user"), (1, TARGET))])))
    made, scratch = format_conversations(source.unionByName(own), public_tokenizers.path("byte_bpe_50k.json"))
    windows = materialize(made, "windows")
    discard(*scratch)
    turns, targets = read_turns(windows), read_targets(windows)
    order = ["window", "i"]
    turn_digests = text_digests(turns, order, F.concat("role", F.lit("\n"), "text", F.lit("\n"))).withColumnRenamed("digest", "turns_sha256")
    loss_digests = text_digests(targets, order, F.col("target")).withColumnRenamed("digest", "loss_sha256")
    sizes = windows.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sum(F.col("n_turns") - F.col("n_repeated")).alias("n_turns"), F.sum(F.length("text")).alias("formatted_chars"))
    loss = targets.groupBy("key").agg(F.sum(F.length("target")).alias("loss_chars"))
    out = sizes.join(turn_digests, "key").join(loss, "key", "left").join(loss_digests, "key", "left")
    out = materialize(out.select("conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).cast("long").alias("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars"), "conversations")
    discard(windows)
    return out
