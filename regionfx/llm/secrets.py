"""Secrets in texts: key patterns, and windows of high character entropy, by built-in expressions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
#: Runs shorter than the limits can't hold a match, so the limits are part of the patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: a window of ``window`` characters counts from ``least_bits`` of entropy on."""

    kind: str
    pattern: str
    window: int
    least_bits: float
    #: what a candidate must also hold (Java patterns)
    needs: tuple[str, ...] = ()


CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 2.9, (r"[0-9]", r"[A-Fa-f]")),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{24,}={0,2}", 24, 3.9, (r"[0-9]", r"[A-Z]", r"[a-z]")),
)

#: Not secret: samples, counted alphabets, one sign over and over, paths of plain words.
ALLOWED = r"(?i:example|sample|placeholder|changeme|your[_-]?(?:key|token|secret))|0123456789|(?i:abcdefghij)|(.)\1{7,}|^(?:/?[a-z]+)(?:/[a-z]+){2,}$"
#: A span that holds such a part counts all the same if so many characters in a row are outside of these parts.
SECRET_LENGTH = 32


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a pattern's matches in code points, end exclusive.

    The texts between the matches (a split) and the matches themselves
    alternate; the lengths summed up give the places.  keep: a condition over
    the match's text and its second group.
    """
    code = KINDS.index(kind)
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.arrays_zip(F.transform(pieces, lambda x: F.length(x)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size"), (F.regexp_extract_all(text, F.lit(pattern), 2) if keep else whole).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin, end = s["at"] + x["gap"], s["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(code).alias("kind"), end.alias("end")))
        good = x["size"].isNotNull() & (keep(x["value"]) if keep else F.lit(True))
        return F.struct(end.alias("at"), F.when(good, F.concat(s["found"], span)).otherwise(s["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda s: s["found"])


def entropy_spans(candidate: Column, rule: CharacterClass) -> Column:
    """Spans within a candidate that windows of high entropy cover, overlapping ones joined.

    One pass with incremental counts: as a character enters and another
    leaves the window, only their counts and the sum of c*log2(c) change.
    The candidate's characters, their alphabet and their codes are each computed once.
    """
    w = rule.window
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])

    def scan(codes: Column, n_signs: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.when(i >= w, F.get(codes, i - w)).alias("go"), i.cast("int").alias("i")))
        start = F.struct(F.array_repeat(F.lit(0), n_signs).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(SPAN).alias("found"))

        def step(s: Column, x: Column) -> Column:
            come, go = x["come"], x["go"]
            same = go.isNotNull() & (come == go)
            in_count, out_count = F.get(s["counts"], come), F.get(s["counts"], F.coalesce(go, F.lit(0)))
            f = lambda c: F.get(weights, c)
            entered = F.when(same, 0.0).otherwise(f(in_count + 1) - f(in_count))
            left = F.when(same | go.isNull(), 0.0).otherwise(f(out_count - 1) - f(out_count))
            counts = F.transform(s["counts"], lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(go.isNotNull() & (k == go), 1).otherwise(0))
            total = s["sum"] + entered + left
            high = (x["i"] >= w - 1) & (F.round(F.lit(math.log2(w)) - total / w, 9) >= rule.least_bits)
            begin, end, last = x["i"] - (w - 1), x["i"] + 1, F.get(s["found"], F.size(s["found"]) - 1)
            code = F.lit(KINDS.index(rule.kind)).alias("kind")
            joins = F.coalesce(last["end"] >= begin, F.lit(False))
            joined = F.concat(F.slice(s["found"], F.lit(1), F.greatest(F.size(s["found"]) - 1, F.lit(0))), F.array(F.struct(F.coalesce(last["start"], F.lit(0)).alias("start"), code, end.alias("end"))))
            added = F.concat(s["found"], F.array(F.struct(begin.alias("start"), code, end.alias("end"))))
            return F.struct(F.when(same, s["counts"]).otherwise(counts).alias("counts"), total.alias("sum"), F.when(~high, s["found"]).when(joins, joined).otherwise(added).alias("found"))

        return F.aggregate(steps, start, step, lambda s: s["found"])

    coded = lambda signs, alphabet: let(F.transform(signs, lambda x: F.array_position(alphabet, x).cast("int") - 1), lambda codes: scan(codes, F.size(alphabet)))
    return let(F.split(candidate, ""), lambda signs: let(F.array_distinct(signs), lambda alphabet: coded(signs, alphabet)))


def suppressed(span: Column) -> Column:
    """Whether the allow-list explains the text of a span: it has such a part, and too little in a row beside these to be a secret."""
    longest = F.array_max(F.transform(F.split(span, ALLOWED, -1), lambda x: F.length(x)))
    return span.rlike(ALLOWED) & (longest < SECRET_LENGTH)


def entropy_matches(text: Column, rule: CharacterClass) -> Column:
    """Entropy spans of all candidates of a text that the allow-list doesn't suppress."""
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    parts = F.arrays_zip(F.transform(pieces, lambda x: F.length(x)).alias("gap"), whole.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,value:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        value = F.coalesce(x["value"], F.lit(""))
        begin = s["at"] + x["gap"]
        good = F.length(value) >= rule.window
        for p in rule.needs:
            good = good & value.rlike(p)
        return F.struct((begin + F.length(value)).alias("at"), F.when(good, F.concat(s["found"], F.array(F.struct(begin.alias("at"), value.alias("value"))))).otherwise(s["found"]).alias("found"))

    def inner(c: Column) -> Column:
        kept = F.filter(entropy_spans(c["value"], rule), lambda e: ~suppressed(F.substring(c["value"], e["start"] + 1, e["end"] - e["start"])))
        return F.transform(kept, lambda e: F.struct((e["start"] + c["at"]).alias("start"), e["kind"].alias("kind"), (e["end"] + c["at"]).alias("end")))

    return F.flatten(F.transform(F.aggregate(parts, start, step, lambda s: s["found"]), inner))


def rendered(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns, then base_spans and spans: arrays of (start, kind, end) in code points.

    Null and empty texts have no spans; repeated rows are scanned each by
    itself; an empty table gives no rows; input columns named base_spans or
    spans are replaced.  Each pattern runs only over texts
    that a first test finds to hold it, so most texts cost one pass per kind.
    """
    docs = docs.drop("base_spans", "spans", "_more")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    guard = lambda p, spans: F.when(t.rlike(p), spans).otherwise(none)
    base = F.concat(
        guard(ASSIGN, matches(t, ASSIGN, "assign", lambda value: F.length(value) >= ASSIGN_MIN)),
        F.when(t.contains("AKIA"), guard(ACCESS, matches(t, ACCESS, "access"))).otherwise(none),
        guard(HEX, matches(t, HEX, "hex")),
    )
    more = F.concat(*[guard(r.pattern, entropy_matches(t, r)) for r in CLASSES])
    found = docs.select("*", F.sort_array(base).alias("base_spans"), more.alias("_more"))
    return found.select(*docs.columns, "base_spans", F.sort_array(F.concat("base_spans", "_more")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(rendered(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
