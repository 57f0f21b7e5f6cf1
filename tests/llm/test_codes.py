import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import codes as c
from weftline.llm.bpe import VOCABULARY
from weftline.llm.common import TOKENIZER_DIR, encoding

V = f"{TOKENIZER_DIR}/{VOCABULARY}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**32 - 1)), max_size=1200))
def test_any_ids_come_back_whole_and_one_by_one(ids):
    r = c.Codes(c.pack(np.array(ids, np.uint64)))
    assert r.all().tolist() == ids and [r[i] for i in range(len(ids))] == ids and r.end == len(r.blob)


def test_bounds():
    r = c.Codes(c.pack(np.array([5], np.uint64)))
    for i in (-1, 1):
        with pytest.raises(IndexError):
            r[i]
    with pytest.raises(ValueError):
        c.pack(np.array([1 << 32], np.uint64))


def test_tables(spark):
    df = spark.createDataFrame([(1, [1, 70_000, 3], 1), (2, [], 0), (3, None, 0), (4, [9], None), (5, [7], 4)], "id int, token_ids array<bigint>, at int").withColumn("codes", F.lit("mine"))
    got = c.access(c.encode_ids(df), "at").collect()
    assert [r.token_id for r in got] == [70_000, None, None, None, None] and got[2].codes is None
    back = c.read_ids(c.encode_ids(df).drop("token_ids")).collect()
    assert [r.token_ids for r in back] == [[1, 70_000, 3], [], None, [9], [7]]
    assert c.encode_ids(df.limit(0)).count() == 0


def test_query_holds_the_ids_of_whole_texts(spark, sf_dir, documents, nasty):
    enc = encoding(V)
    got = {r.doc_id: r for r in c.op7_codes(spark, sf_dir).collect()}
    for r in documents.collect():
        assert c.Codes(got[r.doc_id].codes).all().tolist() == enc.encode_ordinary(r.text) and got[r.doc_id].n_bytes == len(got[r.doc_id].codes)
    for r in c.encode_texts(nasty, V).collect():
        assert r.codes is None if r.text is None else c.Codes(r.codes).all().tolist() == enc.encode_ordinary(r.text)
