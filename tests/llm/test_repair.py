"""Repair of conversations: whole results against a forward dynamic program over whole conversations."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from regionfx.llm import digests, repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def _put(states, state, value):
    if state not in states or value[:2] < states[state][:2]:
        states[state] = value


def _inserted(states):
    for _ in range(3):
        for state in list(states):
            cost, audit, lines = states[state]
            _put(states, NEXT[state], (cost + 3, audit + "I", [*lines, f"{NAMES[NEXT[state]]}:"]))
    return states


def _best(rows, faults):
    states = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in _inserted(states).items():
            _put(after, state, (cost + 4, audit + "D", lines))
            if fault in "bd":
                continue
            more, i, to = 3 * (fault == "t"), role[:1], NEXT[state]
            if (i == "s" and state == "") or (i == "u" and state != "u") or (i == "a" and state == "u"):
                _put(after, i, (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            _put(after, to, (cost + more + 3, audit + "R", [*lines, f"{NAMES[to]}:{text}"]))
        states = after
    states = _inserted(states)
    return min((states[s] for s in ("", "a") if s in states), key=lambda v: v[:2])


def expected(source):
    """source: (conv_id, turn, role, text); the rows of the query."""
    held = collections.defaultdict(list)
    for conv, turn, role, text in source:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind, role, text = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, shown[2], shown[3]
        rows = held[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns, seen, faults = [r[0] for r in rows if r[0] is not None], set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        first = [r[1][:1] for r in rows]
        cost, audit, lines = _best(rows, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _write(path, rows):
    table = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}
    pq.write_table(pa.table({**table, "key": ["x"] * len(rows), "place": [1] * len(rows), "block": ["y"] * len(rows)}), path / "conversations.parquet")


def _rows():
    rng, rows = random.Random(7), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["ok.", "yes!", "is it?", "no mark", "", " \t", "same.", "été.", None, "line\nline. \r\n", "x" * 3000 + "."]
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((conv, None if rng.random() < 0.02 else turn + 2 * (rng.random() < 0.1) * 100, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    hot = [(1000, turn, rng.choice(roles), rng.choice(texts[:8]) if rng.random() < 0.5 else f"turn {turn}.") for turn in range(1500)]
    kept = {}  # rows of one turn differ in no way, so that any order of them gives one result
    for r in [*rows, *hot]:
        kept.setdefault(r[:2], r)
    return list(kept.values())


def test_op12_conversation_repair(spark, tmp_path):
    rows = _rows()
    _write(tmp_path, rows)
    got = repair.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_small_blocks_give_the_same(spark, tmp_path):
    rows = [(*r[:2], r[2] or "r", r[3] or "t") for r in _rows()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for size in (7, 1024):
        summary, repaired, _ = repair.repair(df, rows_per_block=size)
        digest = digests.text_digests(repaired, ["place", "sub"], F.concat("role", F.lit(":"), "text"), "\n")
        found.append(sorted(map(str, summary.join(digest, "key").collect())))
        order = repaired.orderBy("key", "place", "sub").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sub", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("x"))
        assert order.where("NOT x RLIKE '^(s?(ua)+)?$'").isEmpty()
    assert found[0] == found[1]


def test_empty_and_repeated_rows(spark, tmp_path):
    _write(tmp_path, [])
    assert repair.op12_conversation_repair(spark, str(tmp_path)).collect() == []
    df = spark.createDataFrame([(1, 1, "user", "a.")] * 3 + [(1, 2, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    row = repair.repair(df)[0].first()
    assert (row.duplicate, row.cost, row.audit, row.gaps) == (2, 8, "KDDK", 0)


@pytest.mark.parametrize("length", [0, 1, 2, 5, 40])
def test_walks_are_cheapest_and_least_in_letters(length):
    rng = np.random.default_rng(length)
    codes = rng.integers(0, 9, (50, length)).astype(np.int8)
    ends = np.tile(repair.LAST, (50, 1))
    letters, _, exits = repair.walks(codes, ends)
    costs = (repair.block_costs(codes) + ends[:, None, :]).min(axis=2)
    for i in range(50):
        rows, faults = [], []
        for c in codes[i]:
            code = repair.CODES[c]
            rows.append((0, {"o": "z", "x": "user"}.get(code.lower(), code.lower()), "t"))
            faults.append("b" if code == "x" else "t" if code.isupper() else "-")
        cost, audit, _ = _best(rows, faults)
        own = letters[i, 0]
        closing = {repair.U: "I", repair.S: "II"}.get(int(exits[i, 0]), "")
        assert costs[i, 0] == cost
        assert bytes(own[own > 0]).decode() + closing == audit
