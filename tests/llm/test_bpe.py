import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kilim.llm import bpe

MERGES = bpe.Merges()
PEER = Tokenizer.from_file(bpe.PATH)
PEER.encode_special_tokens = True


def peer(texts):
    return [x.ids for x in PEER.encode_batch(texts, add_special_tokens=False)]


FIXED = ["", " ", "  a", "aaaaaaaaa aaa", "I'll we've İstanbul'a", "12 34½", "\n\n x \t", "👩‍💻👍🏽 é", "<|endoftext|>", "Ã¼ þ ğ", "日本語 テスト", "x" * 3000, "ab" * 2000 + " the end"]


def test_fixed_texts():
    assert bpe.Encoder(MERGES)(FIXED) == peer(FIXED)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Cc"]), max_size=40), max_size=5))
def test_as_the_public_library(texts):
    e = bpe.Encoder(MERGES)
    assert e(texts) == peer(texts) == e(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c'sxyzüğ\n", max_size=60))
def test_round_trip(text):
    assert MERGES.decode(bpe.Encoder(MERGES)([text])[0]) == text


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (4, " ", "z")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    hello = peer(["hello world"])[0]
    assert got == [(1, hello), (1, hello), (2, []), (3, []), (4, peer([" "])[0])]
    assert bpe.encode(df.limit(0)).count() == 0


def test_missing_file():
    with pytest.raises(OSError):
        bpe.Merges("/nowhere.json")
