"""Pieces of texts against both libraries, over all code points."""

import public_tokenizers
import pyarrow as pa
import pytest

from regionfx.llm import byte_pairs, words

POINTS = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
FORMS = {"alone": "{0}\n", "in a word": "a{0}'s ", "after a blank": "1 {0}2 ", "doubled": "!{0}{0}x"}


def _texts(form):
    return ["".join(FORMS[form].format(c) for c in POINTS[i : i + 2000]) for i in range(0, len(POINTS), 2000)]


def _pieces(texts):
    pieces, counts = words.split_pieces(pa.array(texts))
    flat, out, at = pieces.to_pylist(), [], 0
    for n in counts:
        out.append(flat[at : at + n])
        at += n
    return out


@pytest.mark.parametrize("form", FORMS)
def test_pieces_are_the_tokenizers_library_s(form):
    from tokenizers.pre_tokenizers import ByteLevel

    texts = _texts(form)
    split, names = ByteLevel(add_prefix_space=False, use_regex=True), {v: bytes([k]) for k, v in words.byte_characters().items()}
    for text, own in zip(texts, _pieces(texts), strict=True):
        assert own == [b"".join(names[c] for c in piece) for piece, _ in split.pre_tokenize_str(text)]


@pytest.mark.parametrize("form", FORMS)
def test_pieces_give_the_ids_of_tiktoken(form):
    import tiktoken

    ranks = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts, met = _texts(form), {}
    for text, own in zip(texts, _pieces(texts), strict=True):
        ids = []
        for piece in own:
            if piece not in met:
                met[piece] = library._encode_single_piece(piece)
            ids += met[piece]
        assert ids == library.encode_ordinary(text)


def test_letters_newer_than_python_s_tables(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), words.library_vocabulary(path)
    texts = ["ᲊ's", "Ɤ's 1", "x \U00013460's", "Ᲊ ᲊ"]
    ids, counts = own.encode_texts(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(counts) == 4
