import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lucidframe.llm import pieces
from lucidframe.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(tokenizer_file())


TEXTS = ["", " ", "a", " a  b\n\nc", "x▁y ▁▁ z", "é😀 \t\r\0 <s> <0x41> </s>", "word" * 400, "日本語テスト " * 30, "🤦🏼‍♂️", "a b c", "\n", "   \n  ", "aaaaaaaabbbbbbb" * 20, "<0x0A>", "é", "ﬁ ½"]


def whole(vocabulary, text):
    """The ids of a text, by the coder."""
    coder = pieces.Coder(vocabulary)
    return [i for group in coder.parts([text]) for ids in coder.encode([x[2] for x in group]) for i in ids]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoding_equal_the_library(vocabulary, text):
    ids = whole(vocabulary, text)
    assert ids == vocabulary.library.encode(text)
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tabcethinoér▁ß😀<0x41>中.,"), max_size=120))
def test_random_texts(vocabulary, text):
    ids = whole(vocabulary, text)
    assert ids == vocabulary.library.encode(text)
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_matrix_and_heap_agree(vocabulary):
    words = ["▁international", "▁thhaedin", "zzzz", "▁▁▁▁x", "ß", "中", "x" * pieces.WIDE]
    ids, counts = vocabulary._matrix(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [vocabulary._heap(w) for w in words]


def test_a_wrong_id_is_noticed(vocabulary):
    with pytest.raises(ValueError, match="word"):
        vocabulary.check(["▁word"], np.array([1, 2, 3], np.int32), np.array([3]))


def test_a_wrong_text_is_noticed(vocabulary, monkeypatch):
    coder = pieces.Coder(vocabulary)
    monkeypatch.setattr(vocabulary, "decode", lambda ids: "other")
    with pytest.raises(ValueError):
        coder.decode(vocabulary.library.encode("word"), True)


def test_every_kind_of_character_is_cut_where_no_piece_joins(vocabulary):
    text = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    mixed = " ".join(a + b for a in "aéж中7.▁ę" for b in text[:2000:7])
    for t in (text, mixed):
        assert whole(vocabulary, t) == vocabulary.library.encode(t)


def test_memory_is_bounded_and_changes_no_id(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 50)
    coder = pieces.Coder(vocabulary)
    for k in range(40):
        text = " ".join(f"w{chr(97 + (k * j) % 26)}{'xyz'[j % 3] * (j % 7)}q" for j in range(60)) + " the same words"
        assert [i for g in coder.parts([text]) for ids in coder.encode([x[2] for x in g]) for i in ids] == vocabulary.library.encode(text)
        assert len(coder.number) <= 50 + 200


@pytest.mark.parametrize("text", ["the cat\n" * 5000, "  é😀 x" * 4000, "a" * 30_000, "▁ " * 20_000, "7" * 9000])
def test_long_texts_in_parts(vocabulary, monkeypatch, text):
    monkeypatch.setattr(pieces, "TOGETHER", 1000)
    n, ids, decoded, own, back = (x[0] for x in pieces._coded(pieces.Coder(vocabulary), [text], True))
    theirs = vocabulary.library.encode(text)
    assert (n, own, back) == (len(theirs), theirs, vocabulary.library.decode(theirs))
    assert ids == hashlib.sha256(",".join(map(str, theirs)).encode()).hexdigest()
    assert decoded == hashlib.sha256(back.encode()).hexdigest()


def test_other_columns_may_have_any_name(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "k", 5), (1, "a b", "k", 5)], "doc_id long, text string, __lf_text string, n_tokens int")
    got = pieces.encode(df, tokenizer_file()).collect()
    assert [r.n_tokens for r in got] == [len(vocabulary.library.encode("a b"))] * 2
    odd = pieces.encode(df.withColumnRenamed("doc_id", "__lf_id").withColumnRenamed("text", "__lf_t"), tokenizer_file(), "__lf_id", "__lf_t")
    assert odd.columns[0] == "__lf_id" and odd.count() == 2


def test_frame(spark, vocabulary):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (5, "the cat\n" * 30_000)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file(), with_ids=True).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] or 0, len(x[1] or "")))):
        ids = vocabulary.library.encode(t or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()
        assert r.decoded == vocabulary.library.decode(ids)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0
