import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.common import TOKENIZER_DIR, encoding

V = f"{TOKENIZER_DIR}/{bpe.VOCABULARY}"


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_pretokens_split_as_the_vocabulary_does(t):
    t = t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    words = bpe.pretokens(t)
    assert "".join(words) == t
    enc = encoding(V)
    assert [i for w in words for i in enc.encode_ordinary(w)] == enc.encode_ordinary(t)


def check(df):
    enc, n = encoding(V), 0
    for r in df.collect():
        n += 1
        if r.text is None:
            assert r.token_ids is None and r.decoded is None
        else:
            assert r.token_ids == enc.encode_ordinary(r.text) and r.decoded == r.text
    return n


def test_documents_equal_whole_encodings_and_come_back(documents):
    assert check(bpe.decode(bpe.encode(documents, V, block_chars=50_000, part_bytes=100_000), V)) == documents.count()


def test_encoding_and_decoding_in_one_pass(nasty, documents):
    both = documents.unionByName(nasty).withColumn("Decoded", F.lit(1)).withColumn("rows", F.lit(2))
    got = bpe.encode(both, V, block_chars=20_000, decoded="decoded")
    assert got.columns == [*documents.columns, "rows", "token_ids", "decoded"] and check(got) == both.count()
    assert bpe.encode(both.limit(0), V, decoded="decoded").count() == 0
    assert check(bpe.encode(both, V, decoded="decoded", apart=True)) == both.count()


def test_decoding_does_not_depend_on_blocks(nasty, documents):
    both = documents.unionByName(nasty).withColumn("rows", F.lit(1)).withColumn("id", F.lit("x"))
    assert check(bpe.decode(bpe.encode(both, V), V, block_tokens=100)) == both.count()


def test_nasty_rows_and_clashing_columns(nasty):
    df = nasty.withColumn("token_ids", F.lit("mine")).withColumn("block", F.lit(3)).withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(df, V), V)
    assert check(got) == df.count() and [r.block for r in got.collect()] == [3] * df.count()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "token_ids", "decoded"]


def test_empty_table(empty):
    assert bpe.decode(bpe.encode(empty, V), V).count() == 0


def test_unknown_ids_and_broken_bytes_decode_to_what_is_left(spark):
    df = spark.createDataFrame([([15496, 999_999],), ([],), (None,), ([encoding(V).encode_ordinary("é")[0], 220],)], "token_ids array<int>")
    got = [r.decoded for r in bpe.decode(df, V).collect()]
    assert got[:3] == ["Hello", "", None] and got[3] is not None


def test_query(spark, sf_dir, documents):
    got = bpe.op1_bpe(spark, sf_dir).join(documents.select("doc_id", "text"), "doc_id")
    assert got.where("decoded <> text or n_tokens <> size(token_ids)").count() == 0 and got.count() == documents.count()
    assert np.all([r.n_tokens > 0 for r in got.where("text <> ''").select("n_tokens").collect()])
