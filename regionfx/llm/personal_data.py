"""Personal data in texts: key patterns, and a semi-Markov conditional random field over candidate segments.

The field scores whole segments: each candidate (a run of tokens of bounded
length around digits or an at sign) has features of its full text, and dynamic
programming over the tokens chooses the segments, their boundaries and their
types together.  Every candidate holds a digit, an at sign or the word "at", so only
windows around these are decoded, as many tokens wide as a segment and the
features before it reach.  That gives the same result as decoding the whole text, as tokens
outside can only be left alone.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from itertools import accumulate, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionfx.llm.words import once

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:int,kind:int,end:int>>"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the key patterns, leftmost and non-overlapping per kind, each in linear time.

    An e-mail's local part is the longest run before the at sign that the match before leaves;
    an address in digits starts where a run of digits does, so no run is scanned again from each of its places.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 10 else not x.strip("0") or int(x[-10:]) <= 255 and not x[:-10].strip("0") for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field -------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)
MAX_TOKENS = 36  # of a segment
CONTEXT, AFTER = 6, 4  # tokens before and after a segment that its features look at
NONE = len(KINDS)
SCALE = 1 << 20  # of scores when they are summed up
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]  # digit sums of twice a digit


#: What may stand behind a blank before the at sign and before a dot, and what in front of one.
BEFORE_AT, BEFORE_DOT, SIGNS = frozenset(["@", "at", "(", "["]), frozenset(["dot", "(", "[", ")", "]"]), frozenset(["@", "at", "dot", "(", "[", ")", "]"])


def candidates(tokens: list[str]):
    """(first, past the last, type) of the segments that may be an entity of that type."""
    n = len(tokens)
    wordy = [t[0].isalnum() for t in tokens]
    for i in range(n):
        first = tokens[i]
        if not (wordy[i] or first in "+(") or (i and wordy[i] and wordy[i - 1]):
            continue
        digits, ats, dots, hosted, letters, odd, mail = 0, 0, 0, 0, 0, False, True
        for j in range(i, min(n, i + MAX_TOKENS)):
            t = tokens[j]
            if t in "\n\r" or odd and not ats and digits == 0:
                break
            if t.isspace():  # in an address only beside its signs
                after = tokens[j + 1].lower() if j + 1 < n else ""
                if ats and after not in BEFORE_DOT and tokens[j - 1].lower() not in SIGNS:
                    break
                mail = mail and (ats > 0 or after in BEFORE_AT)
            if t.isdigit() and t.isascii():
                digits += len(t)
            elif t.isalpha():
                letters += 1
                ats += t.lower() == "at"
                dots += t.lower() == "dot"
                hosted += ats > 0 and t.lower() == "dot"
            elif t == "@":
                ats += 1
            elif t == ".":
                dots += 1
                hosted += ats > 0
                if j + 1 < n and tokens[j + 1].isspace() and j > i and not tokens[j - 1].isspace():
                    break  # the end of a sentence
            elif t not in " -()+/_[]%":
                odd = True
            if odd or digits > 19 and not letters or (letters or ats) and not mail:
                break
            if not wordy[j] or (j + 1 < n and wordy[j + 1]):
                continue
            if ats == 1 and hosted and letters > 1 and first.lower() != "at":
                yield i, j + 1, 0
            if not letters and not ats:
                if dots == 3 and 4 <= digits <= 12:
                    yield i, j + 1, 1
                if 12 <= digits <= 19 and dots in (0, 3) and first not in "+(":
                    yield i, j + 1, 2
                if 7 <= digits <= 15 and dots <= 4:
                    yield i, j + 1, 3


#: A dot of a host as it may be spelt, and a host after these are put as dots.
DOT = re.compile(r"\s*[(\[]?\s*\bdot\b\s*[)\]]?\s*|[(\[]?\.[)\]]?")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+\Z")


def address_features(tokens: list[str], i: int, j: int) -> list[str]:
    """Features of the segment i..j-1 as an e-mail address: its name, sign and host as wholes, and whether it is cut off on either side."""
    part = [t.lower() for t in tokens[i:j]]
    at = next((k for k, t in enumerate(part) if t in ("@", "at")), 0)
    left, right = "".join(part[:at]), "".join(part[at + 1 :])
    name, host = left.rstrip(" (["), right.lstrip(" )]")
    sign = left[len(name) :] + part[at] + right[: len(right) - len(host)]
    plain = DOT.sub(".", host)
    spelt = "dot" if "dot" in part[at:] else ".." if plain != host else "."
    labels = plain.split(".")
    whole = HOST.match(plain) is not None
    before, after = "".join(tokens[max(0, i - 2) : i]).lower(), "".join(tokens[j : j + AFTER]).lower()
    shape = "none" if not name else "blank" if re.search(r"\s", name) else "odd" if re.search(r"[()\[\]/]", name) else "digits" if name.isdigit() else "good"
    return [
        f"email|name={shape}",
        f"email|host={'good' if whole else 'blank' if re.search(r'[^ -~]| ', plain) else 'odd'}",
        f"email|labels={min(4, len(labels))}",
        f"email|tail={'letters' if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6 else 'other'}",
        f"email|sign={sign}",
        f"email|dots={spelt}|{part[at]}",
        f"email|whole={shape == 'good' or shape == 'digits'}{whole}{spelt}|{sign}",
        f"email|cut before={bool(re.search(r'[a-z0-9][._%+-]$|[a-z0-9]$', before))}",
        f"email|cut after={bool(re.match(r'[.-][a-z0-9]|[a-z0-9]| ?[(\[]?dot\b', after))}",
    ]


def features(tokens: list[str], i: int, j: int, kind: int) -> list[str]:
    """Features of the whole segment i..j-1 as an entity of this type."""
    part = tokens[i:j]
    text = "".join(part)
    digits = "".join(c for c in text if c.isdigit())
    k = KINDS[kind]
    out = [k]
    before = [t.lower() for t in tokens[max(0, i - CONTEXT) : i] if t.isalpha()][-2:]
    out += [f"{k}|before={w}" for w in before]
    if kind == 0:
        out += address_features(tokens, i, j)
    else:
        groups = re.findall("[0-9]+", text)
        shape = "-".join(str(len(g)) for g in groups)
        out += [f"{k}|shape={shape}", f"{k}|signs={''.join(sorted({c for c in text if not c.isdigit()}))}"]
        if kind == 1:
            out += [f"{k}|octets={len(groups) == 4 and all(int(g) <= 255 for g in groups)}", f"{k}|spaced={' ' in text}"]
        elif kind == 2:
            out += [f"{k}|luhn={luhn(digits)}", f"{k}|n={len(digits)}", f"{k}|groups={min(6, len(groups))}", f"{k}|even={even(groups)}{len({c for c in text if not c.isdigit()})}"]
        else:
            out += [f"{k}|n={len(digits)}", f"{k}|plus={text[0] == '+'}", f"{k}|paren={'(' in text}", f"{k}|balanced={text.count('(') == text.count(')')}", f"{k}|groups={min(6, len(groups))}", f"{k}|lead={lead(text, digits)}", f"{k}|lead={lead(text, digits)}|{''.join(sorted({c for c in text if not c.isdigit()}))}", f"{k}|even={even(groups)}"]
    return out


def lead(text: str, digits: str) -> str:
    """What a number begins with: a sign, a bracket, the zeros of a code to dial, or a digit."""
    return text[0] if text[0] in "+(" else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "digit"


def even(groups: list[str]) -> bool:
    """Whether four groups of four digits follow each other, as on cards."""
    return [len(g) for g in groups] == [4, 4, 4, 4]


def _sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Semi-Markov conditional random field with a chain over segment types."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def segments(self, tokens: list[str]):
        by_end = defaultdict(list)
        for i, j, k in candidates(tokens):
            names = features(tokens, i, j, k)
            by_end[j].append((i, k, names, sum(self.weights.get(f, 0.0) for f in names)))
        return by_end

    def scores(self, tokens: list[str]):
        """(start, type, score) of the candidates by their ends, as ``segments`` has them.

        What the ends of a start share is carried on from one to the next; numbers alike in all that features see have one
        list of weights, which is looked up once.
        """
        get, by_end, own, known = self.weights.get, defaultdict(list), None, self.known
        if len(known) > 50_000:
            known.clear()
        for i, j, kind in candidates(tokens):
            if kind == 0:
                by_end[j].append((i, 0, sum([get(f, 0.0) for f in features(tokens, i, j, 0)])))
                continue
            if i != own:
                own, upto, shape, mark, n, high, opened, before = i, i, "", "", 0, 0, 0, {}
                sums = [0, 0]  # of all digits so far, with every second doubled, from the first or from the second on
                first = tokens[i] if tokens[i] in "+(" else ""
                zeros = ""
            while upto < j:
                t = tokens[upto]
                if t.isdigit():
                    shape = f"{shape}-{len(t)}" if shape else str(len(t))
                    high = max(high, len(t) > 3 or int(t) > 255)
                    if n < 2:
                        zeros = (zeros + t)[:2]
                    for d in t:
                        d = ord(d) - 48
                        sums[n & 1] += DOUBLED[d]
                        sums[1 - (n & 1)] += d
                        n += 1
                else:
                    opened += (t == "(") - (t == ")")
                    if t not in mark:
                        mark = "".join(sorted(mark + t))
                upto += 1
            if kind not in before:
                words = [t.lower() for t in tokens[max(0, i - CONTEXT) : i] if t.isalpha()][-2:]
                before[kind] = [get(f, 0.0) for f in (KINDS[kind], *[f"{KINDS[kind]}|before={w}" for w in words])]
            # the last digit isn't doubled, so the length says which of the sums counts
            mood = high if kind == 1 else sums[n & 1] % 10 if kind == 2 else (first, zeros[0] == "0", zeros == "00", opened)
            key = kind, shape, mark, mood
            if key not in known:
                known[key] = [get(f, 0.0) for f in features(tokens, i, j, kind) if not f.startswith(f"{KINDS[kind]}|before=")][1:]
            by_end[j].append((i, kind, sum(before[kind] + known[key])))
        return by_end

    def step(self, a: int, b: int) -> float:
        return self.weights.get(f"step {a}>{b}", 0.0)

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (first token, type, past the last).

        Scores are summed as whole numbers, so that which of several equal segmentations is
        chosen doesn't hang on the tokens before them.
        """
        by_end, n = self.scores(tokens), len(tokens)
        if not by_end:
            return []
        steps = [[round(SCALE * self.step(p, k)) for k in range(NONE + 1)] for p in range(NONE + 1)]
        best = [[-math.inf] * (NONE + 1) for _ in range(n + 1)]
        back: list[list] = [[None] * (NONE + 1) for _ in range(n + 1)]
        best[0][NONE] = 0
        for j in range(1, n + 1):
            moves = [(j - 1, NONE, 0), *((i, k, round(SCALE * s)) for i, k, s in by_end.get(j, ()))]
            for i, k, s in moves:
                for p in range(NONE + 1):
                    v = best[i][p] + s + steps[p][k]
                    if v > best[j][k]:
                        best[j][k], back[j][k] = v, (i, p)
        out, j, k = [], n, max(range(NONE + 1), key=lambda x: best[n][x])
        while j:
            i, p = back[j][k]
            if k != NONE:
                out.append((i, k, j))
            j, k = i, p
        return out[::-1]

    def learn(self, tokens: list[str], gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log-likelihood of a window's entities, by forward and backward sums."""
        by_end, n = self.segments(tokens), len(tokens)
        by_start = defaultdict(list)
        for j, found in by_end.items():
            for i, k, names, s in found:
                by_start[i].append((j, k, names, s))
        size = NONE + 1
        fore = [[-math.inf] * size for _ in range(n + 1)]
        aft = [[-math.inf] * size for _ in range(n + 1)]
        fore[0][NONE] = 0.0
        aft[n] = [0.0] * size
        for j in range(1, n + 1):
            for k in range(size):
                ways = [fore[i][p] + s + self.step(p, k) for i, s in [(j - 1, 0.0)] * (k == NONE) + [(i, s) for i, y, _, s in by_end.get(j, ()) if y == k] for p in range(size)]
                if ways:
                    fore[j][k] = _sum(ways)
        for i in range(n - 1, -1, -1):
            for p in range(size):
                aft[i][p] = _sum([aft[i + 1][NONE] + self.step(p, NONE), *(aft[j][k] + s + self.step(p, k) for j, k, _, s in by_start.get(i, ()))])
        whole = _sum(fore[n])
        gradient: dict[str, float] = defaultdict(float)
        for i in range(n):
            for j, k, names, s in [(i + 1, NONE, [], 0.0), *by_start.get(i, ())]:
                for p in range(size):
                    chance = fore[i][p] + self.step(p, k) + s + aft[j][k] - whole
                    if chance > -30:
                        x = math.exp(chance)
                        gradient[f"step {p}>{k}"] -= x
                        for f in names:
                            gradient[f] -= x
        i, p = 0, NONE
        starts = {a: (k, b) for a, k, b in gold}
        while i < n:
            k, j = starts.get(i, (NONE, i + 1))
            gradient[f"step {p}>{k}"] += 1
            if k != NONE:
                for f in features(tokens, i, j, k):
                    gradient[f] += 1
            i, p = j, k
        for f, g in gradient.items():
            self.weights[f] = (1 - 0.002 * rate) * self.weights.get(f, 0.0) + rate * g


def training_windows(n: int, seed: int):
    """Labelled windows from a seeded generator: (tokens, entities).  Half of the numbers in them are none of the types."""
    rng = random.Random(seed)
    syllables = "ta ren ho li mu es on der que la sto vi ne cha".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good=True):
        x = rng.choice("345") + num(rng.choice((14, 14, 13)))
        check = next(d for d in "0123456789" if luhn(x + d) == good)
        x += check
        sep = rng.choice(("", " ", "-", " ", "-", "."))
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4)) if len(x) == 16 else x

    def email():
        local = rng.choice((word(), f"{word()}.{word()}", f"{word()}_{word()}", word() + num(2), num(2)))
        host = [word() for _ in range(rng.choice((1, 1, 2)))] + [*rng.choice((["com"], ["org"], ["net"], ["de"], ["fr"], ["co", "uk"]))]
        sign, dot = rng.choice((("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] ")))
        return local + sign + dot.join(host)

    def ip():
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice((".", ".", "[.]", " . ")).join(parts)

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {num(2)} {num(3)} {num(4)}", f"+{rng.randint(20, 99)}{num(9)}", f"{a}.{b}.{c}", national(), national(), f"00{rng.choice((' ', ''))}{rng.randint(20, 99)} {num(rng.randint(2, 3))} {num(rng.randint(6, 8))}"))

    def national():
        """A code that begins with a zero, then one to three groups."""
        code, rest = "0" + rng.choice("123456789") + num(rng.randint(1, 3)), rng.choice(([num(rng.randint(5, 8))], [num(6)], [num(3), num(4)], [num(4), num(4)], [num(2), num(2), num(2)], [num(rng.randint(6, 7))]))
        return rng.choice((code + " ", code + "-", code + "/", f"({code}) ")) + rng.choice((" ", "-", " ")).join(rest)

    def other():
        y = f"{rng.randint(1900, 2030)}"
        return rng.choice((f"{y}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{y}", f"{num(rng.randint(1, 6))}", f"{num(3)}.{num(2)}", f"{num(16)}0", card(False), f"{rng.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{num(13)}", f"{word()}@{word()}", f"{word()} at {word()} {num(4)}", f"{rng.choice((word(), num(3)))} at {word()}. {word().title()}", f"{num(3)} at {word()}. {word().title()}", f"{word()} at {num(rng.randint(1, 5))}. {word()}", f"{num(8)}-{num(4)}", f"{y}-{y}", f"{num(4)} {num(4)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"{num(10)}", f"{num(1)}.{num(1)}.{num(1)}", f"0{num(rng.randint(3, 9))}", f"0.{num(rng.randint(2, 9))}", f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", f"0{num(1)}:{num(2)}:{num(2)}", f"0{num(1)}.0{num(1)}.{y}", f"0{num(1)}-{num(2)}-{num(2)}"))

    makers = {0: (email, "mail write contact address"), 1: (ip, "host server address ip"), 2: (card, "card visa pay number"), 3: (phone, "call phone tel fax")}
    for _ in range(n):
        tokens, gold = [], set()
        for _ in range(rng.randint(1, 3)):
            filler = " ".join(word() for _ in range(rng.randint(2, 5)))
            kind = rng.choice((0, 1, 2, 3, NONE, NONE, NONE))
            hint = ""
            if kind != NONE and rng.random() < 0.3:
                hint = " " + rng.choice(makers[kind][1].split()) + rng.choice((":", ""))
            elif kind == NONE and rng.random() < 0.3:
                hint = " " + rng.choice("order version id on number page".split())
            if not hint and rng.random() < 0.2:
                hint = " at"
            tokens += TOKEN.findall(filler + hint + " ")
            part = TOKEN.findall(makers[kind][0]() if kind != NONE else other())
            if kind != NONE and (0, len(part), kind) in set(candidates(part)):
                gold.add((len(tokens), kind, len(tokens) + len(part)))
                tokens += part
            elif kind == NONE:
                tokens += part
            tokens += TOKEN.findall(rng.choice((" ", ", ", ". ")))
        yield tokens, gold


def trained_field(n_windows: int = 700, passes: int = 4, seed: int = 7) -> Field:
    """A field fitted to ``n_windows`` generated windows (the bound of what it learns from); made once in a process."""

    def make():
        field, windows = Field({}), list(training_windows(n_windows, seed))
        for k in range(passes):
            for tokens, gold in windows:
                field.learn(tokens, gold, 0.3 / (1 + k))
        return field

    return once(("personal data field", n_windows, passes, seed), make)


#: What every candidate holds: digits, an at sign or the token "at" in any case.
TRIGGER = re.compile(r"[0-9]+|@|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the field's entities in a text."""
    out = []
    for begin, end in windows(text):
        tokens = TOKEN.findall(text, begin, end)
        entities = field.decode(tokens)
        if entities:
            at = [begin]
            for t in tokens:
                at.append(at[-1] + len(t))
            out += [(at[i], k, at[j]) for i, k, j in entities]
    return out


def windows(text: str):
    """Places (begin, end) around triggers, far enough apart to be decoded each by itself.

    A segment reaches MAX_TOKENS - 1 tokens from a trigger in it.  Triggers with more than twice
    MAX_TOKENS tokens between them fall into two windows; a window also holds the
    tokens that features look at and one more on each side, which no segment covers.
    """
    begin = end = None
    for m in TRIGGER.finditer(text):
        if begin is not None and (m.start() - end <= 2 * MAX_TOKENS or tokens_after(text, end, 2 * MAX_TOKENS) >= m.start()):
            end = m.end()
            continue
        if begin is not None:
            yield tokens_before(text, begin, MAX_TOKENS + CONTEXT), tokens_after(text, end, MAX_TOKENS + AFTER)
        begin, end = m.span()
    if begin is not None:
        yield tokens_before(text, begin, MAX_TOKENS + CONTEXT), tokens_after(text, end, MAX_TOKENS + AFTER)


def tokens_after(text: str, at: int, n: int) -> int:
    """The end of the n-th token after a token's end, or of the text."""
    for m in islice(TOKEN.finditer(text, at), n):
        at = m.end()
    return at


def tokens_before(text: str, at: int, n: int) -> int:
    """The start of the n-th token before a token's start, or of the text."""
    size = 8 * n
    while size < at:
        starts = [m.start() for m in TOKEN.finditer(text, at - size, at)]
        if len(starts) > n:  # the first of them may be the rest of a longer token
            return starts[-n]
        size *= 4
    starts = [m.start() for m in TOKEN.finditer(text, 0, at)]
    return starts[-n] if len(starts) >= n else 0


def all_spans(text: str, field: Field):
    """(base spans, base spans and the field's further ones), each sorted by start, then kind."""
    base = base_spans(text)
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))  # the furthest end of the spans so far
    free = lambda s: not (k := bisect.bisect_left(starts, s[2])) or reach[k - 1] <= s[0]
    return base, sorted(base + [s for s in field_spans(text, field) if free(s)])


def redacted(text: str, spans) -> str:
    """The text with each span's signs replaced by its kind in brackets; overlapping spans count as one."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def find_personal_data(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """The documents' columns, then base_spans and spans: arrays of (start, kind, end) in code points, end exclusive.

    redact: the text column holds the redacted text instead, and no columns
    are added.  Null texts have no spans and stay null, empty ones stay empty; rows are
    scanned each by itself, so repeated rows and hot keys cost nothing more; an empty
    table gives no rows.  Input columns named base_spans or spans are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    field = trained_field()
    docs = docs if redact else docs.drop("base_spans", "spans")
    schema = docs.schema if redact else docs.select("*", F.lit(None).cast(SPANS).alias("base_spans"), F.lit(None).cast(SPANS).alias("spans")).schema

    def scan(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)

        def spans(rows):
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r))
            flat = [x for r in rows for x in r]
            parts = [pa.array([x[k] for x in flat], pa.int32()) for k in range(3)]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["start", "kind", "end"]))

        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [all_spans(x or "", field) for x in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if redact:
                columns[text] = pa.array([None if x is None else redacted(x, s) for x, (_, s) in zip(texts, found, strict=True)], batch.column(text).type)
            else:
                columns |= {"base_spans": spans([b for b, _ in found]), "spans": spans([s for _, s in found])}
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(n).type) for n, c in columns.items()], schema=arrow)

    return docs.mapInArrow(scan, schema)


def rendered(spans: Column) -> Column:
    """kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda i: F.size(F.filter("base_spans", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return find_personal_data(docs).select("doc_id", *[count(i) for i in range(4)], F.sha2(rendered(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"))
