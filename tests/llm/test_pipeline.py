import pytest

import corpus_pipeline as p
from weftline.llm import decontaminate, jaccard, pii, toxicity
from weftline.llm.bpe import VOCABULARY
from weftline.llm.common import TOKENIZER_DIR, encoding, table


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    return {r.doc_id: r for r in p.run(spark, sf_dir).collect()}


def test_against_the_stages_one_document_at_a_time(spark, sf_dir, result):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    model = toxicity.fit_tables(spark, sf_dir)
    scores = toxicity.Scorer(model).score([toxicity.tokens(r.text) for r in docs.values()])
    left = [i for i, s in zip(docs, scores) if s[0] < model.threshold]
    kept = spark.createDataFrame([docs[i] for i in left], table(spark, sf_dir, "documents").schema)
    left = sorted(r.doc_id for r in jaccard.dedup(kept).select("doc_id").collect())
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    scan = decontaminate.Scanner(items, decontaminate.Config())
    left = [i for i in left if not scan.spans(docs[i].text)]
    assert sorted(result) == left
    sample = pii.sample(spark.createDataFrame([docs[i] for i in left], kept.schema), pii.Config().max_docs)
    found = pii.fit(sample)
    enc = encoding(f"{TOKENIZER_DIR}/{VOCABULARY}")
    for i in left:
        text = docs[i].text
        (y,) = found.labels([pii.codes(text)])
        text = pii.redact(text, found.spans(y))
        r = result[i]
        assert r.text == text == r.decoded and r.token_ids == enc.encode_ordinary(text) and r.n_tokens == len(r.token_ids) and r.n_chars == len(text)


def test_every_stage_but_the_last_returns_the_columns_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_nasty_rows_and_an_empty_table(spark, sf_dir, nasty, empty):
    for docs, least in ((nasty, 7), (empty, 0)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()
        assert docs.count() >= least
