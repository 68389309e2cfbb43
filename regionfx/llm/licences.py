"""Licence notices in texts by a positional rare-token index of licence templates.

A template's words are indexed by position.  Of each template's words that a file
holds, those with the highest inverse document frequency over all files are looked up,
so many that no alignment without any of them can score; a template whose words the file lacks too much
of is left out by them.  The postings of the others are intersected by relative
position (file position minus template position), all alignments at once: each has the
share of the template's word weight found at its places, and a
label also needs the template's key phrases within the aligned range.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm import licence_texts as texts

#: Base phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

LEAST_SCORE = 0.75
SLACK = 2  # positions that a word may be off its alignment


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: phrases that must stand in the aligned range
    required: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version", ("gnu general public license", "version 3")),
    Template("gpl-2", "under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("mit", texts.MIT, ("permission is hereby granted", "without restriction", "noninfringement")),
    Template("bsd-2", texts.BSD_2, ("source and binary forms", "following conditions are met", "even if advised of the possibility of such damage")),
    Template("bsd-3", texts.BSD_3, ("source and binary forms", "neither the name of", "even if advised of the possibility of such damage")),
    Template("isc", texts.ISC, ("for any purpose with or without fee", "disclaims all warranties")),
    Template("zlib", texts.ZLIB, ("must not be misrepresented", "altered source versions")),
    Template("unlicense", texts.UNLICENSE, ("free and unencumbered software", "public domain")),
    Template("bsl-1", texts.BOOST, ("person or organization obtaining a copy", "machine executable object code")),
    Template("apache-2", texts.APACHE_NOTICE, ("apache license version 2 0", "limitations under the license")),
    Template("gpl-3", texts.gnu_notice("General Public License", "3"), ("gnu general public license", "version 3")),
    Template("gpl-2", texts.gnu_notice("General Public License", "2"), ("gnu general public license", "version 2")),
    Template("lgpl-3", texts.gnu_notice("Lesser General Public License", "3"), ("lesser general public license", "version 3")),
    Template("lgpl-2.1", texts.gnu_notice("Lesser General Public License", "2.1"), ("lesser general public license", "version 2 1")),
    Template("agpl-3", texts.gnu_notice("Affero General Public License", "3"), ("affero general public license", "version 3")),
    Template("mpl-2", texts.MPL_NOTICE, ("mozilla public license v 2 0",)),
)

#: Every byte that no word holds becomes a blank; A-Z in lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def places(words: list[bytes], phrase: list[bytes], lo: int = 0, hi: int | None = None) -> list[int]:
    """Starts of the places in words[lo:hi] where the phrase's words stand consecutively."""
    n, out = len(phrase), []
    hi = len(words) if hi is None else hi
    at = lo - 1
    while True:
        try:
            at = words.index(phrase[0], at + 1, hi)
        except ValueError:
            return out
        if at + n <= hi and words[at : at + n] == phrase:
            out.append(at)


class TemplateIndex:
    """Word -> (template, position) postings, with the words' weights."""

    def __init__(self, templates, weights: dict[bytes, float]):
        self.templates = [(t.label, words_of(t.text), [p.encode().split() for p in t.required]) for t in templates]
        self.weights = weights
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for _, words, _ in self.templates for w in words))}
        self.postings = [np.array([self.numbers[w] for w in words], np.int64) for _, words, _ in self.templates]
        self.own_weights = [np.array([weights[w] for w in words]) for _, words, _ in self.templates]
        self.totals = [sum(weights[w] for w in words) for _, words, _ in self.templates]

    def rare_words(self, k: int, present: set[bytes]) -> list[bytes]:
        """The rarest present words of template k, one of which every alignment with LEAST_SCORE has at its place.

        So many that the weight of these and of the absent words is more than a scoring alignment can lack; none
        if the absent words alone weigh that much.
        """
        words = self.templates[k][1]
        found = sum(self.weights[w] for w in words if w in present)
        least, out = LEAST_SCORE * self.totals[k] * (1 - 1e-9), []
        for w in sorted(present.intersection(words), key=lambda w: (-self.weights[w], w)):
            if found < least:
                break
            found -= words.count(w) * self.weights[w]
            out.append(w)
        return out

    def shift_weights(self, k: int, keys: np.ndarray, n_words: int) -> tuple[int, np.ndarray]:
        """(first shift, weight found at each shift) of template k: all its postings intersected by relative position at once.

        keys: word number * n_words + place, sorted.  A word of the template counts at the shifts that bring it within SLACK of one of its places
        in the text, once each: what its places share is cut from the later one, and the weights are added at the ends of these stretches.
        """
        numbers, weights = self.postings[k], self.own_weights[k]
        first, last = np.searchsorted(keys, numbers * n_words), np.searchsorted(keys, (numbers + 1) * n_words)
        counts = last - first
        q = np.repeat(np.arange(len(numbers)), counts)
        at = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts) + first[q]
        ends = keys[at] - numbers[q] * n_words - q + SLACK
        begins = ends - 2 * SLACK
        same = np.flatnonzero(q[1:] == q[:-1]) + 1
        begins[same] = np.maximum(begins[same], ends[same - 1] + 1)
        least = int(begins.min()) if len(q) else 0
        size = int(ends.max()) - least + 2 if len(q) else 0
        return least, np.cumsum(np.bincount(begins - least, weights[q], size) - np.bincount(ends + 1 - least, weights[q], size))

    def score(self, k: int, shift: int, keys: np.ndarray, n_words: int) -> float:
        """The share of template k's weight that an alignment finds."""
        numbers = self.postings[k]
        q = np.arange(len(numbers)) + shift
        low, high = numbers * n_words + np.maximum(q - SLACK, 0), numbers * n_words + np.minimum(q + SLACK, n_words - 1)
        at = np.searchsorted(keys, low)
        hit = (q + SLACK >= 0) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= high)
        return sum(self.own_weights[k][hit].tolist()) / self.totals[k]

    def match(self, words: list[bytes], at_once: int = 1 << 17) -> dict[str, float]:
        """Labels and the best score of each, over all alignments of all templates.

        A template takes part if its rarest words show that some alignment may reach LEAST_SCORE.  A long text is gone through in stretches of
        ``at_once`` shifts, so what is held doesn't grow with it.
        """
        present = self.numbers.keys() & set(words)
        wanted = []
        for k, (_, _, required) in enumerate(self.templates):
            if self.rare_words(k, present) and all(places(words, r) for r in required):
                wanted.append(k)
        out: dict[str, float] = {}
        longest = max((len(self.postings[k]) for k in wanted), default=0)
        for start in range(-longest - SLACK, len(words) + SLACK, at_once) if wanted else ():
            base = max(0, start - SLACK)
            part = words[base : start + at_once + longest + SLACK]  # all places that these shifts can use
            numbers = np.array([self.numbers.get(w, -1) for w in part], np.int64)
            own = np.flatnonzero(numbers >= 0)
            n = len(part)
            keys = np.sort(numbers[own] * n + own)
            for k in wanted:
                label, template, required = self.templates[k]
                least, found = self.shift_weights(k, keys, n)
                near = found / self.totals[k]
                some = np.flatnonzero(near >= LEAST_SCORE - 1e-9)
                for i in some[np.argsort(-near[some], kind="stable")].tolist():
                    shift = least + i + base
                    if near[i] <= out.get(label, 0.0) + 1e-9:  # no better than one that has its phrases
                        break
                    if not start <= shift < start + at_once:
                        continue
                    score = self.score(k, shift - base, keys, n)
                    lo, hi = max(0, shift - SLACK), min(len(words), shift + len(template) + SLACK)
                    if score >= LEAST_SCORE and score > out.get(label, 0.0) and all(places(words, r, lo, hi) for r in required):
                        out[label] = score
        return out


def word_weights(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of every template word over all rows (null text: empty).

    Tasks count the template words that each text holds, so what is shuffled
    and collected is bounded by the templates' words.
    """
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    known = frozenset(vocabulary)

    def count(batches):
        import pyarrow as pa

        counts, n = Counter(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(known.intersection(words_of(x)))
                n += 1
        names = [w.decode() for w in counts]
        yield pa.RecordBatch.from_pydict({"word": pa.array([*names, ""], pa.string()), "n": pa.array([*counts.values(), n], pa.int64())})

    rows = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    total = found.get(b"", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary}


def find_licences(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """The documents' columns, then n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0; a base phrase gives score 1; repeated
    rows are scanned each by itself; an empty table gives no rows; input
    columns of these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    docs = docs.drop(*added)
    schema = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    index = TemplateIndex(templates, word_weights(docs, templates, text))
    base = [(p.encode().split(), label) for p, label in phrases]

    def scan(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for x in batch.column(text).to_pylist():
                words = words_of(x)
                found = [(at, label) for phrase, label in base for at in places(words, phrase)]
                own = {label for _, label in found}
                more = index.match(words)
                starts = [at for at, _ in found]
                out.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more.keys())), 1.0 if found else max(more.values(), default=0.0)))
            columns = list(zip(*out, strict=True)) if out else [()] * len(added)
            fresh = [pa.array(c, arrow.field(n).type) for c, n in zip(columns, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.cast(arrow.field(k).type) for k, c in enumerate(batch.columns)], *fresh], schema=arrow)

    return docs.mapInArrow(scan, schema)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licences(docs).drop("text")
