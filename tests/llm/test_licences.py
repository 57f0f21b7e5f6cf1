from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import same
from weftline.llm import licences as l

WORDS = "licensed under the apache license version 2 0 mit released cc by nc 4 all rights reserved x y".split()
INDEX = l.Index()


def brute(text, cfg=l.Config()):
    w, out = l.words_of(text), []
    for name, _, body, phrases in l.TEMPLATES:
        t = l.words_of(body)
        for d in range(-len(t), len(w)):
            hit = sum(0 <= d + i < len(w) and w[d + i] == x for i, x in enumerate(t))
            near = " " + " ".join(w[max(0, d - cfg.slack) : max(0, d + len(t) + cfg.slack)]) + " "
            if hit >= cfg.coverage * len(t) - 1e-9 and all(f" {' '.join(l.words_of(p))} " in near for p in phrases):
                out.append((name, max(0, d), hit))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30).map(" ".join), st.sampled_from([t[2] for t in l.TEMPLATES]), st.integers(0, 40))
def test_against_every_alignment(noise, body, drop):
    w = body.split()
    if drop < len(w):
        w[drop] = "zzz"
    text = f"{noise}\n{' '.join(w)}. {noise}"
    assert sorted((m[0], m[2], m[6]) for m in INDEX.matches(text)) == brute(text)


def test_offsets_and_several_places():
    t = "İ x. Released under the MIT License. y " * 2
    got = [m for m in INDEX.matches(t) if m[0] == "mit-short"]
    assert len(got) == 2 and all(t[m[4] : m[5]] == "Released under the MIT License" for m in got)


def test_each_template_finds_itself():
    for name, licence, body, _ in l.TEMPLATES:
        assert (name, licence, 1.0) in {(m[0], m[1], m[7]) for m in INDEX.matches(f"some words before {body} and after")}


def test_nasty_rows_and_empty(spark, nasty, empty):
    assert l.scan(nasty).count() == 0 and l.scan(empty).count() == 0
    df = spark.createDataFrame([(1, "All rights reserved.", 1), (1, "All rights reserved.", 1), (None, "all RIGHTS reserved", 2)], "doc_id bigint, text string, template int")
    assert l.scan(df).count() == 3


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    same(l.op9_licences(spark, sf_dir), l.sql(), sf_dir)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_a_whole_licence_is_found_clause_by_clause():
    got = {(m[0], m[7]) for m in INDEX.matches("Copyright 2020 someone\n\n" + MIT)}
    assert {(n, 1.0) for n in ("mit-grant", "mit-1", "mit-notice", "mit-2", "mit-3")} <= got
    changed = MIT.replace("of this software", "of all of this software").replace("OTHER DEALINGS", "SOME OTHER DEALINGS")
    assert {"mit-1", "mit-notice", "mit-2"} <= {m[0] for m in INDEX.matches(changed)}


def test_one_posting_is_not_enough():
    rare = max(INDEX.postings, key=lambda w: INDEX.idf[w])
    assert all(INDEX.agree[t] > 1 for t, _ in INDEX.postings[rare]) and INDEX.candidates([rare]) == []
