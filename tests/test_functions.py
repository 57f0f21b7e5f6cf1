import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import chunking, text, vectors

WORDS = st.lists(st.sampled_from(["alpha", "beta.", "gamma!", "delta", "x" * 40, "eps?"]), max_size=120)


def test_headings_make_paths_and_code_stays_whole():
    t = "# A\nintro.\n## B\nbody one. body two.\n```\ncode line. one\n\ncode two\n```\n# C\n\n"
    got = chunking.chunks(t, 8, 0)
    assert got[0] == "A\nintro."
    assert all(c.startswith("A > B\n") for c in got[1:])
    assert any("```\ncode line. one\n\ncode two\n```" in c for c in got)


def test_heading_in_code_splits_unless_fence_aware():
    t = "# A\n```\n# not a heading\n```\nend"
    assert len(chunking.chunks(t)) == 2
    assert len(chunking.chunks(t, fence_aware=True)) == 1


def test_empty_and_null_have_no_chunks():
    assert chunking.chunks(None) == chunking.chunks("") == chunking.chunks(" \n ") == []


@settings(max_examples=60, deadline=None)
@given(WORDS, st.integers(5, 60), st.integers(0, 20))
def test_pack_keeps_every_unit_in_order(words, target, overlap):
    body = " ".join(words).strip()
    if not body:
        return
    packed = chunking.pack(body, target, overlap)
    units = chunking.units(body)
    if len(packed) > 1:
        at = 0
        joined = "\x00".join(packed)
        for u in units:
            assert u in joined
        for c in packed:
            assert c
        assert packed[-1].endswith(units[-1])
        at = sum(chunking.tokens(u) for u in units)
        assert sum(chunking.tokens(c) for c in packed) >= at - len(units) - len(packed)


def test_hash_vectors_are_unit_or_zero():
    v = vectors.hash_embed(["a b b", "", None, "A"], 384)
    assert math.isclose(float(v[0] @ v[0]), 1.0) and not v[1].any() and not v[2].any()
    assert v[3][int(hashlib.md5(b"a").hexdigest(), 16) % 384] == 1.0


def test_top_k_is_exact_with_ties_by_id(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.standard_normal((40, 4)), 1)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(40, None), (41, [0.0] * 4), (42, [float(x) for x in m[3]])]
    items = spark.createDataFrame(rows, "i bigint, embedding array<double>").repartition(5)
    q = spark.createDataFrame(rows[:5], "q bigint, embedding array<double>")
    got = {(r.q, r.rank): r.i for r in vectors.top_k(q, items, 6, "q", "i").collect()}
    for k in range(5):
        sims = sorted((-round(float(np.dot(rows[k][1], v or [0.0] * 4)), 9), i) for i, v in rows)
        assert [got[k, r + 1] for r in range(6)] == [i for _, i in sims[:6]]


def test_top_k_of_nothing(spark):
    e = spark.createDataFrame([], "i bigint, embedding array<double>")
    assert vectors.top_k(e.withColumnRenamed("i", "q"), e, 3, "q", "i").count() == 0


def test_text_functions(spark):
    r = spark.createDataFrame([("Hello,  wörld! Bye.\nEnd", "")], "a string, b string").select(
        text.terms("a").alias("t"), text.token_count("a").alias("n"), text.token_count("b").alias("z"), text.sentences("a").alias("s"), text.preview("a", 10).alias("p"), text.html_text(F.lit("<p>a<script>b</script>c</p>")).alias("h")
    ).first()
    assert r.t == ["hello", "w", "rld", "bye", "end"] and (r.n, r.z) == (6, 1)
    assert r.s == ["Hello,  wörld!", "Bye.", "End"] and r.p == "Hello, ..." and r.h.split() == ["a", "c"]
