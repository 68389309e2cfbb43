"""Vectorised split of texts into the pieces of a byte-level BPE pattern, and their distinct words.

The pattern is the one of ``public_tokenizers.PATTERN``: contractions,
letters, numbers or other signs with one space before them, and runs of white
space.  It is evaluated with array operations over the code points of a batch
of texts instead of a regular expression per text.
"""

from __future__ import annotations

import sys
import types

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def once(key, make):
    """A value made once in each Python process and kept for its later tasks."""
    kept = sys.modules.setdefault("_regionfx_kept", types.ModuleType("_regionfx_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def code_point_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    return once("code point classes", _classes)


def _classes() -> np.ndarray:
    """As the libraries' own patterns say, whose Unicode tables are newer than Python's; a test holds them against each other."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    patterns = {LETTER: r"\p{L}", NUMBER: r"\p{N}", SPACE: r"\s"}
    matchers = {kind: tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={}) for kind, p in patterns.items()}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for start in range(0, 0x110000, 0x2000):  # a few at a time, so that little memory is taken in each process
        if not 0xD800 <= start < 0xE000:
            some = "".join(map(chr, range(start, min(start + 0x2000, 0xD800) if start < 0xD800 else start + 0x2000)))
            for kind, matcher in matchers.items():
                # signs that the pattern doesn't match are left out of what is encoded
                matched = bytes(matcher.encode_ordinary(some)).decode()
                table[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a piece begins.  points: code points of all texts in a row; text_starts: where texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = code_point_classes()[points]
    first = np.zeros(n, dtype=bool)
    first[text_starts[text_starts < n]] = True
    same = np.empty(n, dtype=bool)  # same run as the code point before
    same[0] = False
    np.equal(kind[1:], kind[:-1], out=same[1:])
    same &= ~first
    starts = ~same
    is_space = kind == SPACE
    # a run of white space that a text goes on after: its last sign stands apart, or leads the next piece if it is a blank
    runs_on = np.zeros(n, dtype=bool)
    runs_on[:-1] = is_space[:-1] & ~is_space[1:] & ~first[1:]
    ends = np.flatnonzero(runs_on)
    starts[ends] = True
    blank = ends[points[ends] == 0x20]
    starts[blank + 1] = False
    # contractions: an apostrophe that begins a piece of its own and has letters after it
    marks = np.flatnonzero((points == 0x27) & starts)
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == LETTER) & ~first[marks + 1]]
    for at in marks.tolist():
        for end in CONTRACTIONS:
            stop = at + 1 + len(end)
            if stop <= n and not first[at + 1 : stop].any() and all(points[at + 1 + i] == ord(c) for i, c in enumerate(end)):
                starts[at + 1] = False
                if stop < n and not first[stop] and kind[stop] == LETTER:
                    starts[stop] = True
                break
    return starts


def split_pieces(texts):
    """(pieces as a pyarrow BinaryArray, pieces of each text) for a pyarrow StringArray or LargeStringArray without nulls."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = raw[lead].astype(np.int32) if len(lead) == len(raw) else np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.int32)
    text_starts = np.searchsorted(lead, offsets[:-1])
    at = lead[piece_starts(points, text_starts)]
    counts = np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])
    cuts = np.append(at, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())])
    return pieces, counts


def chunks_of(batches, column: str, chunk_bytes: int):
    """Regroup Arrow batches: tables with about ``chunk_bytes`` of text each (one row at least, whole rows always)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for cut in range(batch.num_rows):
            if size and size + int(lengths[cut]) > chunk_bytes:
                if cut > start:
                    held.append(batch.slice(start, cut - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, cut
            size += int(lengths[cut])
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray):
    """Rows ``index`` of a ragged array, one after the other: (values, length of each row)."""
    lengths = (offsets[1:] - offsets[:-1])[index]
    total = int(lengths.sum())
    if not total:
        return values[:0], lengths
    ends = np.cumsum(lengths)
    at = np.repeat(offsets[:-1][index] - (ends - lengths), lengths)
    at += np.arange(total)
    return values[at], lengths


class Vocabulary:
    """Token ids of the pieces met so far in this process; starts anew beyond ``limit`` pieces.

    encode: a function from a list of pieces (bytes) to a list of id lists.
    added: tokens that stand in texts as they are; texts that hold one are
    given whole to encode_text, a function from a text to a list of ids.
    """

    def __init__(self, encode, limit: int = 1_000_000, added: tuple[str, ...] = (), encode_text=None):
        self.encode, self.limit, self.added, self.encode_text = encode, limit, added, encode_text
        self.clear()

    def clear(self):
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros(1 << 16, dtype=np.int32)
        self.offsets = np.zeros(1 << 14, dtype=np.int64)

    def index(self, pieces: list[bytes]) -> np.ndarray:
        """The row of each piece; unknown ones are encoded and added."""
        if len(self.rows) > self.limit:
            self.clear()
        get = self.rows.get
        found = np.fromiter((get(x, -1) for x in pieces), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            ids = self.encode(new)
            n, at = len(self.rows), int(self.offsets[len(self.rows)])
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.values = room(self.values, at + int(lengths.sum()))
            self.offsets = room(self.offsets, n + len(new) + 1)
            self.values[at : at + int(lengths.sum())] = [x for y in ids for x in y]
            self.offsets[n + 1 : n + 1 + len(new)] = at + np.cumsum(lengths)
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
            found[missing] = np.arange(n, n + len(new))
        return found

    def encode_texts(self, texts):
        """(ids of all texts in a row, number of ids of each text)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        held = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            held |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not held.any():
            return self.encode_pieces(texts)
        values, counts = self.encode_pieces(pc.if_else(pa.array(held), pa.scalar("", texts.type), texts))
        whole = [self.encode_text(x) for x in texts.filter(pa.array(held)).to_pylist()]
        lengths = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        places = np.repeat((np.cumsum(counts) - counts)[held], lengths)
        counts[held] = lengths
        return np.insert(values, places, [x for y in whole for x in y]), counts

    def encode_pieces(self, texts):
        """encode_texts for texts without added tokens."""
        pieces, counts = split_pieces(texts)
        if not len(pieces):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        words = pieces.dictionary_encode()
        rows = self.index(words.dictionary.to_pylist())
        values, lengths = ragged_take(self.values, self.offsets, rows[words.indices.to_numpy()])
        ends = np.append(0, np.cumsum(lengths))
        last = np.cumsum(counts)
        return values, ends[last] - ends[last - counts]


def room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    grown[: len(array)] = array
    return grown


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_vocabulary(path: str) -> Vocabulary:
    """Encodes single pieces with the tokenizers library's model from a byte-level BPE file, texts with its added tokens by the library."""

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, names = tokenizer.model, byte_characters()
        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        return Vocabulary(lambda pieces: [[t.id for t in model.tokenize(x.decode("latin-1").translate(names))] for x in pieces], added=added, encode_text=lambda x: tokenizer.encode(x, add_special_tokens=False).ids)

    return once(("library vocabulary", path), make)
