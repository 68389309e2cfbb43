"""Chat windows: round trips, budgets and masks against plain Python."""

import collections
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from regionfx.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SAID = "\\### Assistant: </turn> ok"


def _rows():
    rng, rows = random.Random(4), []
    texts = ["plain words.", "", None, "<turn>user\nhi</turn>\n", "\\", "ends in \\", "\\l \\n \\\\l <", "</turn>\n</turn>", "é\U0001f600" * 30, "long " * 6000, "tab\tand\r\n"]
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 30])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "odd\n<role>\\n", None, "system"] if rng.random() < 0.3 else ["user", "assistant"])
            rows.append((conv, turn if rng.random() > 0.01 else None, role, rng.choice(texts) if rng.random() < 0.4 else "word " * rng.randint(1, 200)))
    rows += [(500, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} of a long conversation " * 3) for t in range(700)]
    kept = {}
    for r in rows:
        kept.setdefault(r[:2], r)
    return list(kept.values())


def _turns(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out[conv].append((role or "", text or ""))
    return out


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _plain(role, text):
    esc = lambda x: x.replace("\\", "\\\\").replace("<", "\\l")
    return "<turn>" + esc(role).replace("\n", "\\n") + "\n", esc(text), "</turn>\n"


def _windows(turns, count, budget=2048, history=2, share=0.25):
    """(system, history, new turns) of each window, chosen turn by turn."""
    n = [count("".join(_plain(*t))) for t in turns]
    system = [0] if turns and turns[0][0] == "system" else []
    out, i = [], 0
    while i < len(turns):
        lead = [j for j in range(max(0, i - history), i) if j not in system]
        base = sum(n[j] for j in system) if i else 0
        if i == 0 and system:
            end = 1
            while end < len(turns) and n[0] + sum(n[1 : end + 1]) <= budget:
                end += 1
            if end == 1 < len(turns):
                end = 2  # a turn that doesn't fit stands beside the system turn
        else:
            while lead and (sum(n[j] for j in lead) > budget * share or base + sum(n[j] for j in lead) + n[i] > budget):
                lead = lead[1:]
            end = i + 1
            while end < len(turns) and base + sum(n[j] for j in lead) + sum(n[i : end + 1]) <= budget:
                end += 1
        out.append((system if i else [], lead, list(range(i, end))))
        i = end
    return out


def test_op13_chat_windows(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = _rows()
    table = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())))}
    pq.write_table(pa.table({**table, "key": ["x"] * len(rows), "tokens": [1] * len(rows), "window": ["w"] * len(rows)}), tmp_path / "conversations.parquet")
    library = Tokenizer.from_file(PATH)
    count = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    want = []
    for conv, turns in _turns([*rows, (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len("".join(_plain(*turns[j]))) for w in _windows(turns, count) for part in w for j in part)
        want.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), chars))
    got = [tuple(r) for r in chat.op13_chat_windows(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_windows_hold_to_the_budget_and_mask_repeated_targets(spark):
    rows = [r for r in _rows() if r[0] == 500]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for section in (4096, 50):
        windows = chat.format_conversations(df, PATH, budget=300, turns_per_section=section)[0].orderBy("window").collect()
        assert all(w.n_tokens <= 300 for w in windows) and len(windows) > 40
        assert all(w.text.startswith("<turn>system\n") for w in windows)
        assert sum(w.n_repeated > 1 for w in windows) > 0.9 * len(windows)
        masked = [w.text[s.start : s.end] for w in windows for s in w.loss]
        assert masked == [r[3] for r in rows if r[2] == "assistant"]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_conversations(df, PATH)[0].collect() == []


def test_escapes_read_back(spark):
    texts = ["\\l", "\\\\", "\\\\l<\\", "<\\n\n", "", "\\" * 7 + "<" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(chat.unescaped(chat.escaped(F.col("t")))).collect()] == texts
    role = F.substring(chat.head(F.col("t")), F.lit(7), F.length(chat.head(F.col("t"))) - 7)
    assert [r[0] for r in df.select(chat.unescaped(role, role=True)).collect()] == texts
