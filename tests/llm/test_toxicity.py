import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import toxicity as t

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    return t.sample(docs, labels, 1200)


@pytest.fixture(scope="session")
def split(labelled):
    order = np.random.default_rng(0).permutation(len(labelled))
    cut = len(order) * 7 // 10
    return [labelled[i] for i in order[:cut]], [labelled[i] for i in order[cut:]]


@pytest.fixture(scope="session")
def model(split):
    return t.fit(split[0])


def test_held_out_accuracy(model, split):
    got = np.array([s[0] >= model.threshold for s in t.Scorer(model).score([t.tokens(x) for x, _ in split[1]])])
    want = np.array([y == 1 for _, y in split[1]])
    assert (got == want).mean() >= 0.95 and (got & ~want).sum() <= 0.02 * (~want).sum()
    assert (got & want).sum() >= 0.75 * want.sum()


def test_every_word_is_in_a_window():
    cfg = t.Config(window=8, stride=3)
    for n in range(1, 60):
        seen = {k for s in t.windows_of(n, cfg) for k in range(s, min(n, s + cfg.window))}
        assert seen == set(range(n))


def test_a_score_is_that_of_the_worst_window(model, labelled):
    bad = next(x for x, y in labelled if y == 1 and t.Scorer(model).score([t.tokens(x)])[0][0] > model.threshold)
    clean = " ".join(t.tokens(next(x for x, y in labelled if y == 0 and len(t.tokens(x)) > 50)))
    for text in (bad, clean + " " + bad, bad + " " + (clean + " ") * 40):
        words = t.tokens(text)
        alone = [t.Scorer(model).score([words[s : s + model.cfg.window]])[0][0] for s in t.windows_of(len(words), model.cfg)]
        got = t.Scorer(model).score([words])[0]
        assert abs(got[0] - max(alone)) < 1e-5 and got[2] == len(alone)


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    h = 3
    p = {"uf": rng.standard_normal((h, 3 * h)), "ub": rng.standard_normal((h, 3 * h)), "wa": rng.standard_normal((2 * h, 2)), "ba": np.zeros(2), "va": rng.standard_normal(2), "wo": rng.standard_normal(2 * h), "bo": np.zeros(1)}
    p = {k: v.astype("f4") for k, v in p.items()}
    proj, ids = rng.standard_normal((5, 6 * h)).astype("f4"), rng.integers(1, 5, (4, 2))
    _, state = t._forward(p, proj, ids, keep=True)
    grad, _ = t._backward(p, np.ones(2, "f4"), state)
    for k, at in (("uf", (1, 4)), ("ub", (0, 7)), ("wa", (3, 1)), ("wo", (2,))):
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-2
        up = t._forward(q, proj, ids)[0].sum()
        q[k][at] -= 2e-2
        down = t._forward(q, proj, ids)[0].sum()
        assert abs((up - down) / 2e-2 - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at]))


def test_nasty_rows_clashes_and_empty(model, nasty, empty):
    df = nasty.withColumn("toxic", F.lit("mine"))
    got = t.score(df, model).collect()
    assert len(got) == df.count() and all((r.toxicity, r.toxic, r.windows) == (0.0, False, 0) for r in got if not t.tokens(r.text))
    assert t.score(empty, model).count() == 0
    kept = t.clean(df, model)
    assert kept.schema == df.schema and kept.count() == sum(not r.toxic for r in got)


def test_without_both_classes_nothing_is_rejected(nasty):
    for rows in ([], [("a b", 0)], [("a b", 1), (None, 0)]):
        m = t.fit(rows)
        assert not m.trained and t.clean(nasty, m).count() == nasty.count()


def test_query_equals_one_document_at_a_time(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in t.op8_toxicity(spark, sf_dir).collect()}
    assert sorted(got) == sorted(docs)
    model = t.fit_tables(spark, sf_dir)
    for i, text in docs.items():
        ((score, over, windows),) = t.Scorer(model).score([t.tokens(text)])
        r = got[i]
        assert abs(r.toxicity - score) < 1e-5 and r.windows == windows and abs(r.toxic_windows - over) <= 1
        assert r.toxic == (windows > 0 and model.trained and score >= model.threshold) or abs(score - model.threshold) < 1e-4


def test_windows_cover_the_text_and_the_worst_counts(model):
    cfg = model.cfg
    for n in (0, 1, 63, 64, 65, 200, 1000):
        starts = t.windows_of(n, cfg)
        assert {w for s in starts for w in range(s, min(n, s + cfg.window))} == set(range(n))
    words = t.tokens(" ".join(f"word{i % 50}" for i in range(300)))
    whole = t.Scorer(model).score([words])[0]
    each = [t.Scorer(model).score([words[s : s + cfg.window]])[0][0] for s in t.windows_of(300, cfg)]
    assert abs(whole[0] - max(each)) < 1e-5 and whole[2] == len(each)
