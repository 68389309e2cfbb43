"""Groups of similar texts against all pairs by brute force."""

import collections
import random

import pytest

from regionfx.llm import similar, simhash


def _set(text, w=5):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return frozenset(b" ".join(words[i : i + w]) for i in range(max(1, len(words) - w + 1))) if words else frozenset()


def _groups(pairs):
    out = collections.defaultdict(list)
    for node, root in pairs:
        out[root].append(node)
    return sorted(map(sorted, out.values()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    out = [None, "", " \n", "one two", "One\ttwo", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 25)):  # from nearly equal to clearly different
            near = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
        out.append(" ".join([word() for _ in range(80)] + passage))
    return [*out, out[6], " ".join(["again and again"] * 20000)]


def _check(spark, texts, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands array<int>, node string").repartition(3)
    got = similar.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [x.view("int64").item() for x in simhash.fingerprint_batch([(t or "").encode() for t in texts], 5)]
    sets, root = [_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (prints[i] % 2**64 ^ prints[j] % 2**64).bit_count() <= 3 or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = _groups((i, find(i)) for i in range(len(texts)))
    assert _groups({r["id"]: r["component_id"] for r in got if r["id"] is not None}.items()) == groups
    return got, groups


def test_groups_equal_brute_force(spark, texts):
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)] + [(9, texts[9], [2], "y"), (None, texts[10], [3], "z"), (None, "only here", [4], "z")]
    got, _ = _check(spark, texts, rows)
    assert [r["component_id"] for r in got if r["id"] is None].count(None) == 1


def test_large_families_equal_brute_force(spark):
    """Copies of a text around the least similarity, with changes that several of them have in common, and copies of copies."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 2000)}"
    texts = []
    for size, most, few in ((150, 9, 6), (60, 4, 3), (300, 18, 400)):
        base = [word() for _ in range(size)]
        family = [base]
        for _ in range(120):
            near = list(base if rng.random() < 0.8 else rng.choice(family))
            for _ in range(rng.randint(1, most)):
                near[rng.randrange(len(near))] = f"x{rng.randint(0, few)}"
            family.append(near[rng.choice((0, 0, 0, 3)) :])
        texts += [" ".join(x) for x in family]
    texts = list(dict.fromkeys(texts))
    _, groups = _check(spark, texts, [(i, t, [1], "x") for i, t in enumerate(texts)])
    assert max(map(len, groups)) > 30 and sum(len(g) == 1 for g in groups) > 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.near_duplicates(docs).isEmpty()


def test_members_of_a_large_family_are_not_all_compared(spark, monkeypatch):
    """Copies that differ in many words, some of which a few have in common: pairs compared grow with the copies, not with their square."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(500):
        near = list(base)
        for _ in range(rng.choice((2, 3, 4, 5))):
            near[rng.randrange(150)] = f"x{rng.randint(0, 3)}"
        texts.append(" ".join(near))
    texts, made = list(dict.fromkeys(texts)), []
    compared = similar.compared

    def counted(pairs, sets):
        out = compared(pairs, sets)
        made.append(out.count())
        return out

    monkeypatch.setattr(similar, "compared", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = similar.near_duplicates(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in got) > 200 and len(got) > 100
    assert sum(made) < 30 * len(texts), made
