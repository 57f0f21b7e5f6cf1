"""Searches in parts of bounded memory have the results of brute force."""

import numpy as np
import pytest

from weftline.functions import vectors


def brute(rows, queries, k, may=lambda q, i: True):
    out = {}
    for q, v in queries:
        sims = sorted((-(round(float(np.dot(v or [0.0] * 4, w or [0.0] * 4)), 9) + 0.0), i) for i, w in rows if may(q, i))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sims[:k])}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vectors, "FEW", 5)
    monkeypatch.setattr(vectors, "SHARD_BYTES", 320)  # ten queries
    monkeypatch.setattr(vectors, "CELLS", 64)


def table():
    m = np.round(np.random.default_rng(2).standard_normal((60, 4)), 1)
    return [(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(60, None), (61, [0.0] * 4), (62, [float(x) for x in m[3]]), (63, [float(x) for x in m[3]])]


def test_shards_of_queries_have_all_rows(spark, small):
    rows = table()
    items = spark.createDataFrame(rows, "i bigint, embedding array<double>").repartition(3)
    q = items.selectExpr("i q", "embedding")
    got = {(r.q, r["rank"]): (r.i, r.similarity) for r in vectors.top_k(q, items, 5, "q", "i").collect()}
    assert got == brute(rows, rows, 5)


def test_shards_of_queries_keep_rules_and_text_ids(spark, small):
    rows = table()
    items = spark.createDataFrame([(f"n{i:02}", v, "ab"[i % 2], ["g"] if i % 3 else None) for i, v in rows], "i string, embedding array<double>, tenant_id string, acl array<string>")
    q = spark.createDataFrame([(i, v, "ab"[i % 2] if i % 5 else None, ["g"] if i % 4 else []) for i, v in rows], "q bigint, embedding array<double>, tenant_id string, principals array<string>")
    got = {(r.q, r["rank"]): (int(r.i[1:]), r.similarity) for r in vectors.top_k(q, items, 5, "q", "i", rules=True).collect()}
    assert got == brute(rows, rows, 5, lambda q, i: q % 5 and q % 2 == i % 2 and (i % 3 == 0 or q % 4 > 0))


def test_a_task_holds_no_more_similarities_than_it_may():
    m = np.ones((4000, 8))
    best = vectors.Nearest(m, 3, 9)
    assert best.rows() * len(m) <= vectors.CELLS < 2048 * len(m)
    for lo in range(0, 3000, 500):  # all tie
        best.add(np.arange(lo, lo + 500)[::-1], np.ones((500, 8)))
    q, i, s = best.found()
    assert len(q) == 12000 and i.reshape(-1, 3).tolist() == [[0, 1, 2]] * 4000 and set(s) == {8.0}


def test_texts_are_cut_into_pieces_by_size():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 5, 30, 0, 1, 9, 9, 50)] + [None, ""]
    got = list(vectors.pieces(pa.array(texts), 20, 3))
    assert [a for a, _ in got] == [0, *np.cumsum([n for _, n in got])[:-1].tolist()] and sum(n for _, n in got) == len(texts)
    assert all(n == 1 or n <= 3 and sum(len(t or "") for t in texts[a : a + n]) <= 20 + max(len(t or "") for t in texts[a : a + n]) for a, n in got)
    assert list(vectors.pieces(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("few", [5, 4096])
def test_cells_near_to_a_query_are_searched_exactly(spark, small, monkeypatch, few):
    from weftline.operators import ann

    monkeypatch.setattr(vectors, "FEW", few)
    monkeypatch.setattr(vectors, "SHARD_BYTES", 320 if few == 5 else 16 << 20)
    rows = [(i, v) for i, v in table() if v]
    centers = [(c, rows[7 * c + 1][1]) for c in range(9)]
    cell = {i: i * 5 % 9 for i, _ in rows}
    looks = {q: {c for c, _ in sorted(centers, key=lambda x: (-float(np.dot(v, x[1])), x[0]))[:4]} for q, v in rows}
    items = spark.createDataFrame([(i, v, cell[i]) for i, v in rows], "i bigint, embedding array<double>, cell int").repartition(3)
    q, c = items.selectExpr("i q", "embedding"), spark.createDataFrame(centers, "cell int, centroid array<double>")
    got = {(r.q, r["rank"]): (r.i, r.similarity) for r in ann.search(q, items, c, 5, 4, "q", "i").collect()}
    assert got == brute(rows, rows, 5, lambda q, i: cell[i] in looks[q])
    assert ann.near(q, c, 4).count() == len(rows)  # a row a query, not one for each of its cells


def test_vectors_made_in_the_search_are_those_of_embed(spark):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(texts, "i bigint, text string").repartition(3)
    q = vectors.embed(docs.where("i < 7").selectExpr("i q", "text"))
    plans = [vectors.top_k(q, vectors.embed(docs), 5, "q", "i"), vectors.top_k(q, docs, 5, "q", "i", item_text="text")]
    want, got = (sorted(map(tuple, p.collect())) for p in plans)
    assert got == want and len(got) == 35
    stages = [p._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for p in plans]
    assert stages[1] == stages[0] - 1  # one Python stage less over the documents


def test_words_as_a_matrix_and_as_rows_have_the_same_scores(spark, monkeypatch):
    from weftline.operators import retrieve

    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{n}" for n in rng.integers(0, 12, i % 11)), "ab"[i % 2], ["g"] if i % 3 else []) for i in range(80)] + [(80, None, "a", []), (81, "Ünï w1 w1", "a", None)]
    items = spark.createDataFrame(docs, "i bigint, text string, tenant_id string, acl array<string>").repartition(3)
    req = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} nowhere", "ab"[q % 2] if q else None, ["g"] if q > 3 else []) for q in range(8)] + [(8, None, "a", []), (9, "", "a", [])], "request_id bigint, user_message string, tenant_id string, principals array<string>")
    found = lambda: sorted(map(tuple, retrieve.lexical_top_k(req, items, 4, "i").collect()))
    dense = found()
    assert {r[0] for r in dense} == set(range(1, 8))
    for terms in (500_000, 2):  # known terms alone, or all
        monkeypatch.setattr(vectors, "FEW", 3)
        monkeypatch.setattr(retrieve, "TERMS", terms)
        assert found() == dense
