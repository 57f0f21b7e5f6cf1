from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import rows
from tests.oracle import same
from weftline.llm import decontaminate as d


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    same(d.op4_decontaminate(spark, sf_dir), d.OP4_SQL, sf_dir)


WORDS = st.lists(st.sampled_from("a b c d".split()), max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=3))
def test_spans_against_brute_force(text, items):
    cfg = d.Config(n=3, min_words=2)
    got = {(i, a, n) for i, a, n, _, _, _ in d.Scanner(list(enumerate(items)), cfg).spans(text)}
    w = text.split()
    want = set()
    for i, t in enumerate(items):
        p = t.split()
        if len(p) < cfg.min_words:
            want |= {(i, 0, len(p))} if p and p == w else set()
            continue
        n = min(cfg.n, len(p))
        grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
        at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams]
        run = []
        for k in at:
            if run and k <= run[-1][1] + 1:
                run[-1][1] = k
            else:
                run.append([k, k])
        want |= {(i, a, z - a + n) for a, z in run}
    assert got == want


def test_offsets_hold_where_lower_casing_changes_the_length():
    t = "İİ pre One TWO three Four, end"
    (span,) = d.Scanner([(1, "one two three four")], d.Config()).spans(t)
    assert t[span[3] : span[4]] == "One TWO three Four"


def test_nasty_rows_and_empty_tables(spark, nasty, empty):
    items = spark.createDataFrame([(1, "the same text that several rows share, word for word"), (2, None), (3, ""), (4, "x"), (None, "that several rows share word for word line")], "item_id bigint, text string")
    got = rows(d.spans(nasty, items), "doc_id", "item_id")
    assert got == [(4, 1), (4, 1), (4, None), (4, None), (5, 1), (5, None), (7, 4), (None, 1), (None, None)]
    assert sorted(str(r.doc_id) for r in d.clean(nasty, items).collect()) == sorted(["1", "2", "3", "6", "8", "9", "10", "None"])
    assert d.spans(empty, items).count() == 0 and d.spans(nasty, items.limit(0)).count() == 0 and d.clean(nasty, items.limit(0)).count() == nasty.count()


def test_short_items_long_texts_ties_and_clashes(spark, sf_dir):
    items = spark.createDataFrame([(1, "Paris"), (2, "PARIS!"), (3, "it is"), (4, "one two three four five six seven eight nine")], "item_id bigint, text string")
    long = "x " * 200_000 + "one two three four five six seven eight" + " y" * 200_000
    docs = spark.createDataFrame([(1, " paris.", 1, 2), (2, "Paris in spring", 1, 2), (3, long, 1, 2), (3, long, 1, 2), (4, "It is", 1, 2)], "doc_id bigint, text string, item_id int, start int")
    got = d.spans(docs, items)
    assert rows(got, "doc_id", "item_id", "first_word", "words") == sorted([(1, 1, 0, 1), (1, 2, 0, 1), (3, 4, 200_000, 8), (3, 4, 200_000, 8), (4, 3, 0, 2)], key=lambda r: tuple(map(str, r)))
    left = d.clean(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_short_items_are_whole_texts_in_sql_too(spark, tmp_path):
    spark.createDataFrame([(1, "Paris"), (2, "Paris in spring"), (3, "")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "paris"), (8, "in the spring of it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.sql(f"create view {n} as select * from '{tmp_path}/{n}.parquet/*.parquet'")
    assert con.sql(d.OP4_SQL).fetchall() == [(1, 7, 0, 1, 0, 5, True)] == [tuple(r) for r in d.op4_decontaminate(spark, str(tmp_path)).collect()]


def test_several_automata_find_what_one_does(spark, documents, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, many = d.spans(documents, items), d.spans(documents, items, d.Config(shard_chars=9000))
    assert rows(one, *one.columns) == rows(many, *many.columns)
