from pyspark.sql import functions as F

from weftline.engine import Engine
from weftline.sources import files, sync
from weftline.streaming import pipelines


def test_files_and_sync(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"plain \xff text")
    (root / "sub" / "b.HTML").write_text("<p>hi<script>x</script> you</p>")
    (root / "c.bin").write_text("no")
    got = {r.metadata["filename"]: r for r in files.load(spark, str(root), acl=["g"], tenant_id="t").collect()}
    assert set(got) == {"a.txt", "b.HTML"} and got["b.HTML"].text.split() == ["hi", "you"]
    assert "�" in got["a.txt"].text and got["a.txt"].acl == ["g"] and got["a.txt"].tenant_id == "t"

    first = sync.listing(spark, str(root))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert {r.action for r in sync.diff(first, first.limit(0)).collect()} == {"added"}
    (root / "a.txt").write_text("new")
    (root / "sub" / "b.HTML").unlink()
    (root / "d.md").write_text("# d")
    now = sync.listing(spark, str(root))
    seen = {r.path.rsplit("/", 1)[-1]: r.action for r in sync.diff(now, first).collect()}
    assert seen == {"a.txt": "updated", "b.HTML": "deleted", "d.md": "added"}
    assert sync.apply(first, now).count() == 2


def test_a_directory_and_the_engine_are_kept_in_line(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    (root / "b.txt").write_text("beta")
    e = Engine(spark, str(tmp_path / "index"))
    nothing = spark.createDataFrame([], "tenant_id string, root string, path string, sha1 string")
    manifest, changes = sync.run(e, str(root), nothing)
    assert {r.action for r in changes.collect()} == {"added"} and sorted(r.text for r in e.chunks().collect()) == ["alpha", "beta"]
    (root / "a.txt").write_text("gamma")
    (root / "b.txt").unlink()
    manifest, changes = sync.run(e, str(root), manifest)
    assert sorted(r.action for r in changes.collect()) == ["deleted", "updated"] and [r.text for r in e.chunks().collect()] == ["gamma"]
    (root / "a.txt").unlink()
    manifest, _ = sync.run(e, str(root), manifest)
    assert manifest.count() == 0 and e.chunks().count() == 0


def test_feedback_becomes_labelled_queries(spark, tmp_path):
    at = str(tmp_path / "feedback")
    files.write_feedback(spark.createDataFrame([("q1", 1, ["d1"]), ("q2", -1, ["d9"])], "query string, rating int, relevant array<string>"), at)
    files.write_feedback(spark.createDataFrame([("q1", 1, ["d2", "d1"]), ("q3", 1, None)], "query string, rating int, relevant array<string>"), at)
    assert {r["query"]: r.relevant for r in files.feedback_queries(spark, at).collect()} == {"q1": ["d1", "d2"], "q3": []}


def test_unknown_suffix(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        files.load_file(spark, str(tmp_path / "x.exe"))


def test_json_lines_round_trip(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"text": "a", "doc_id": "1", "tenant_id": "t", "acl": ["g"]}\n\n{"text": "b"}\n')
    docs = files.read_corpus(spark, str(p))
    files.write_corpus(docs, str(tmp_path / "out"))
    back = sorted(files.read_corpus(spark, str(tmp_path / "out")).collect(), key=lambda r: r.text)
    assert [(r.doc_id, r.text, r.tenant_id, r.acl) for r in back] == [("1", "a", "t", ["g"]), ("", "b", "default", [])]


def test_streams(spark, tmp_path):
    src = tmp_path / "docs"
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "gamma")], "doc_id string, text string")
    docs.write.parquet(str(src))
    e = Engine(spark, str(tmp_path / "idx"))
    pipelines.ingest_stream(spark.readStream.schema(docs.schema).parquet(str(src)), e, str(tmp_path / "cp")).awaitTermination()
    assert e.chunks().count() == 2
    ask = tmp_path / "ask"
    req = spark.createDataFrame([(1, "alpha")], "request_id bigint, user_message string")
    req.write.parquet(str(ask))
    pipelines.answer_stream(spark.readStream.schema(req.schema).parquet(str(ask)), e, str(tmp_path / "out"), str(tmp_path / "cp2"), lambda: F.lit(0.0)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
