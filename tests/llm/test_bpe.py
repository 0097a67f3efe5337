import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarkash.llm import bpe

RANKS = bpe.load_ranks()
ENCODER = bpe.Encoder(RANKS)
THEIRS = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
THEIRS.encode_special_tokens = True


def ours(text):
    import numpy as np

    return np.frombuffer(ENCODER.packed(text), dtype="<i4").tolist()


def theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab' \n\t  .,1क्षা٣é<|endoftext|>'s"), max_size=40))
def test_equals_the_public_library(text):
    assert ours(text) == theirs(text)


def test_whole_table():
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ours(text or "") == theirs(text or "")


def test_long_pretoken():
    text = "abcdefgh" * 20_000
    assert ours(text) == theirs(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "  ", "z"), (4, "hello world", None), (4, "hello world", None)], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect())
    assert rows == [(1, []), (2, []), (3, theirs("  ")), (4, theirs("hello world")), (4, theirs("hello world"))]
    assert bpe.encode(df.limit(0)).count() == 0
    assert {(r.doc_id, r.tokens) for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {(1, 0), (2, 0), (3, len(theirs("  "))), (4, 2)}

