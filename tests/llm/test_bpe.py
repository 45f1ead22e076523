import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TABLE = bpe.parse_ranks(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
SPLIT = regex.compile(public_tokenizers.PATTERN)


def ids(text):
    return [i for piece in SPLIT.findall(text) for i in bpe.merge_piece(piece.encode(), TABLE)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a", "a" * 5000, "ab" * 3000, "é" * 999, "\x1c\x1d \x85\xa0  x", "don't  'S 12345² \n\n\t x", "\U0001f600" * 50, "<|endoftext|>", "日本語テキスト" * 40])
def test_chosen_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert LIBRARY.decode_bytes(ids(text)) == text.encode()


def test_ties_go_left():
    ranks = {bytes([b]): b for b in b"ab"} | {b"aa": 200, b"aaa": 201}
    assert bpe.merge_piece(b"aaaaa", ranks) == [200, 201]
    assert bpe.merge_piece(b"baab", ranks) == [98, 200, 98]


def test_table(spark, documents, odd):
    coded = bpe.encode(documents(odd), RANKS, public_tokenizers.PATTERN)
    rows = bpe.decode(coded, RANKS).collect()
    want = [(r[0], LIBRARY.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd]
    assert sorted(str((r["doc_id"], r["ids"], bytes(r["decoded"]))) for r in rows) == sorted(map(str, want))
    assert bpe.decode(bpe.encode(documents([]), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []


def test_trees_side_by_side():
    """Random pieces of every length class against a tree of their own."""
    import random

    r = random.Random(6)
    pieces = bpe._Pieces(TABLE)
    words = {"".join(r.choice("aeio tnsrh.é日0") for _ in range(r.randint(1, 40))) for _ in range(3000)} | {"th", "a", "é", "the" * 21}
    pieces.learn(words)
    for w in words:
        assert np.frombuffer(pieces[w], "<i4").tolist() == bpe.merge_piece(w.encode(), TABLE), w


def test_full_table_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    pieces = bpe._Pieces(TABLE)
    for words in ({"some", "words"}, {"some", "more"}, {"then", "and", "again", "others", "too"}, {"x"}):
        pieces.learn(words)
        assert words <= set(pieces) and len(pieces) <= max(3, len(words))
        for w in words:
            assert np.frombuffer(pieces[w], "<i4").tolist() == LIBRARY.encode_ordinary(w)
