import io
import json

import pytest
from pyspark.sql import functions as F

from weftline.config import Config, Weights
from weftline.engine import Engine
from weftline.evaluation import RetrievalEvaluator, evaluate_files
from weftline.operators import evaluate, memory
from weftline.service import Keys, Service


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    keys = Keys.of({"ka": {"tenant_id": "acme", "principals": ["g1"]}, "kb": {"tenant_id": "other"}})
    return Service(Engine(spark, str(tmp_path_factory.mktemp("service") / "index")), keys, now=lambda: 100.0)


def call(service, method, path, body=None, key="ka", raw=None):
    data = raw if raw is not None else json.dumps(body or {}).encode()
    said = {}
    env = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(data)), "wsgi.input": io.BytesIO(data)}
    env |= {"HTTP_AUTHORIZATION": f"Bearer {key}"} if key else {}
    out = b"".join(service(env, lambda status, headers: said.update(status=int(status[:3]), kind=dict(headers)["Content-Type"])))
    return said["status"], json.loads(out) if said["kind"] == "application/json" else out.decode()


def test_routes_and_tenants(service):
    assert call(service, "GET", "/health", key=None) == (200, {"status": "ok", "auth": "enabled"})
    docs = [{"text": "The ZX-81 pump needs oil every week.", "doc_id": "d1", "metadata": {"year": 2020}}, {"text": "Secret of group two.", "doc_id": "d2", "acl": ["g2"]}]
    assert call(service, "POST", "/ingest", {"documents": docs})[1] == {"chunks_added": 2, "tenant_id": "acme"}
    assert call(service, "POST", "/ingest", {"documents": docs})[1]["chunks_added"] == 0
    assert call(service, "GET", "/stats")[1]["chunks"] == 2 and call(service, "GET", "/stats", key="kb")[1]["chunks"] == 0
    ask = {"user_message": "How often does the ZX-81 pump need oil?", "preferences": {"style": "short"}}
    status, got = call(service, "POST", "/query", ask)
    assert status == 200 and got["tenant_id"] == "acme" and [s["doc_id"] for s in got["sources"]] == ["d1"] and got["backend"] == "mock"
    assert call(service, "POST", "/query", ask, key="kb")[1]["sources"] == []
    assert call(service, "POST", "/query", ask | {"metadata_filter": {"year": 2021}})[1]["sources"] == []
    events = call(service, "POST", "/query/stream", ask)[1]
    assert events.startswith("event: meta") and events.endswith("event: done\ndata: {}\n\n")
    assert "".join(json.loads(x[6:])["text"] for x in events.split("\n") if x.startswith('data: {"text"')) == got["answer"]
    assert call(service, "POST", "/documents/update", {"documents": [{"text": "Oil it daily.", "doc_id": "d1"}]})[1]["chunks"] == 1
    assert call(service, "DELETE", "/documents/d1", key="kb")[0] == 404
    assert call(service, "DELETE", "/documents/d1")[1] == {"chunks_removed": 1}


def test_refusals(service):
    assert call(service, "POST", "/query", {"user_message": "x"}, key="wrong")[0] == 401 and call(service, "GET", "/stats", key=None)[0] == 401
    assert call(service, "POST", "/query", raw=b"{")[0] == 400 and call(service, "POST", "/query", {})[0] == 422
    assert call(service, "POST", "/ingest", {"documents": [{"text": 1}]})[0] == 422 and call(service, "POST", "/ingest", {"documents": [{"text": "t", "source": "nowhere"}]})[0] == 422
    assert call(service, "GET", "/nothing")[0] == 404


def test_keys_from_file_and_environment(tmp_path, monkeypatch):
    (tmp_path / "keys.json").write_text(json.dumps({"k": {"tenant_id": "t", "principals": ["p"]}}))
    monkeypatch.setenv("WEFTLINE_API_KEYS", (tmp_path / "keys.json").read_text())
    for keys in (Keys.from_file(str(tmp_path / "keys.json")), Keys.from_env()):
        assert keys.identify("k").principals == ("p",) and keys.identify("x") is None and keys.identify(None) is None
    assert Keys().identify(None).tenant_id == "default"


CORPUS = [("pump", "The pump of the boiler needs oil every week and a new seal each year."), ("cat", "Cats sleep all day and hunt at night in the garden."), ("tax", "Value added tax is due on the tenth of the following month."), ("sea", "The sea was calm and the boats lay in the harbour."), ("bread", "Bread needs flour, water, salt and a long rest before baking.")] + [(f"n{i}", f"Filler note number {i} about nothing at all.") for i in range(30)]
QUERIES = [("how often does the pump need oil", ["pump"]), ("when do cats hunt", ["cat"]), ("when is value added tax due", ["tax"]), ("calm sea and boats", ["sea"]), ("flour water salt bread", ["bread"])]


def test_evaluation_of_files_in_one_call(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"doc_id": i, "text": t}) + "\n" for i, t in CORPUS))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"query": q, "relevant": r}) + "\n" for q, r in QUERIES))
    got, weights = evaluate_files(spark, str(tmp_path / "corpus.jsonl"), str(tmp_path / "queries.jsonl"), str(tmp_path / "index"), Config(dim=256), tune=5)
    recall = {r.config: r["mean"] for r in got.means.where("metric = 'recall'").collect()}
    assert set(recall) == {"random", "vector", "lexical", "fused", "reranked", "null"} and recall["fused"] >= 0.8 > recall["null"] and all("control" in x for x in got.failures)
    assert {r.config for r in got.report.collect()} == set(recall) and got.significance["mrr"].count() == 1 and got.first_rank.count() == 6
    assert isinstance(weights, Weights) and abs(weights.rerank + weights.similarity + weights.bm25 + weights.recency - 0.88) < 1e-3


def test_random_ranks_and_containing(spark):
    docs = spark.createDataFrame([(i, f"text {i} end") for i in range(50)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "text 4 end"), (2, "text 4"), (3, "text 4 end"), (4, "nothing")], "query_id bigint, message string")
    drawn = evaluate.random_ranks(q.select("query_id"), docs, 6).collect()
    assert len(drawn) == 24 and len({(r.query_id, r.doc_id) for r in drawn}) == 24 and all(1 <= r["rank"] <= 6 for r in drawn)
    got = sorted((r.query_id, r.doc_id) for r in evaluate.containing(docs, q).collect())
    assert got == sorted([(1, 4), (3, 4), *[(2, i) for i in (4, *range(40, 50))]])
    assert evaluate.containing(docs, q.limit(0)).count() == 0


def test_unsupported_claims(spark):
    a = spark.createDataFrame([(1, 0, "first", [1.0, 0.0]), (1, 1, "second", [0.0, 1.0]), (2, 0, "third", [1.0, 0.0])], "k int, claim_id int, claim string, embedding array<double>")
    s = spark.createDataFrame([(1, [1.0, 0.0])], "k int, embedding array<double>")
    assert {r.k: r.unsupported for r in evaluate.unsupported(a, s, "k").collect()} == {1: ["second"], 2: ["third"]}


def test_memory_is_forgotten_and_counted_by_scope(spark):
    m = spark.createDataFrame([("a", 1, 0.0, None), ("a", 2, 0.0, 5.0), ("b", 1, 0.0, None)], "scope string, memory_id int, created double, ttl_s double")
    left = memory.forget(m, spark.createDataFrame([("a", 1)], "scope string, memory_id int"))
    assert sorted((r.scope, r.memory_id) for r in left.collect()) == [("a", 2), ("b", 1)]
    assert {r.scope: r.records for r in memory.count(m, F.lit(10.0)).collect()} == {"a": 1, "b": 1}
