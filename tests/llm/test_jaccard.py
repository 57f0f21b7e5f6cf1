from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import jaccard as j


def grams(text, n=3):
    w = j.WORD.findall(text.lower()) if text else []
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs, threshold):
    """All pairs of different documents at the threshold, by inverted index."""
    sets, where, both = {i: grams(t) for i, t in docs if grams(t)}, defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        for a, b in combinations(sorted(ids), 2):
            both[a, b] += 1
    return {(a, b) for (a, b), n in both.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold}


def roots(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        if x != y:
            parent[y] = x
    return {i: root(i) for i in ids}


def rows(df):
    got = df.collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: r for r in got}


def holds(got, docs, cfg, least=0.95):
    """Every row against all pairs: no link that isn't there, at least the target recall, classes as of the links."""
    want = brute(docs, cfg.threshold)
    links = Counter(x for p in want for x in p)
    assert sorted(got) == sorted(i for i, _ in docs)
    assert all(r.links <= links[i] for i, r in got.items())
    assert sum(r.links for r in got.values()) >= least * sum(links.values())
    true = roots(got, want)
    assert all(true[r.class_id] == true[i] and r.class_id <= i for i, r in got.items())  # never two of them as one
    size = Counter(r.class_id for r in got.values())
    assert all(r.class_size == size[r.class_id] for r in got.values())
    return want, true


@pytest.fixture(scope="module")
def spread(spark, documents):
    """The documents and variants of them with words left out."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    more = []
    for i, t in rows:
        w = t.split()
        for k in (11, 17, 40):
            more.append((1000 * k + i, " ".join(x for p, x in enumerate(w) if p % k != 3)))
    return rows + more


def test_recall_and_exactness_against_all_pairs(spark, spread):
    cfg = j.Config()
    got = rows(j.join(spark.createDataFrame(spread, "doc_id bigint, text string"), cfg))
    want, true = holds(got, spread, cfg)
    assert len(want) > 100
    assert sum(r.class_id == true[i] for i, r in got.items()) >= 0.98 * len(got)


def test_copies_with_replaced_words_are_found(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect() if len(grams(r.text)) >= 60]
    copies = {}
    for i, t in docs:
        for k in (9, 11, 14):  # each k-th word
            copies[i, 10_000 * k + i] = " ".join(f"new{p}" if p % k == 4 else x for p, x in enumerate(t.split()))
    by = dict(docs)
    alike = {p: len(grams(by[p[0]]) & grams(t)) / len(grams(by[p[0]]) | grams(t)) for p, t in copies.items()}
    want = {p for p, x in alike.items() if 0.5 <= x < 0.7}
    got = rows(j.join(spark.createDataFrame(docs + [(p[1], t) for p, t in copies.items()], "doc_id bigint, text string")))
    assert len(want) > 100 and sum(got[a].class_id == got[b].class_id for a, b in want) >= 0.95 * len(want)


def test_small_slices_give_links_as_good(spark, spread):
    cfg = j.Config(slice_grams=2000)
    holds(rows(j.join(spark.createDataFrame(spread, "doc_id bigint, text string"), cfg)), spread, cfg)


def test_a_group_of_exact_copies_is_one_class_in_few_rows(spark):
    text = "a text that many sites have copied word for word from each other"
    docs = [(i, text) for i in range(300)] + [(1000, text + " and one more"), (2000, "nothing of the kind")]
    got = rows(j.join(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert len(got) == 302 and all(got[i].class_id == 0 and got[i].links == 300 for i in range(300))
    assert got[1000].class_id == 0 and got[1000].links == 300 and got[2000].links == 0 and got[2000].class_id == 2000


def test_dedup_leaves_one_of_each_class(spark, spread):
    df = spark.createDataFrame(spread, "doc_id bigint, text string")
    want = {r.class_id for r in j.join(df).collect()}
    assert {r.doc_id for r in j.dedup(df).collect()} == want


def test_nasty_rows_clashes_and_empty(nasty, empty):
    names = ("key", "labels", "component", "drop", "rows", "fp", "links", "class", "_wl_first", "m")
    df = nasty.withColumns({n: F.lit(1) for n in names})
    got = [(r.doc_id, r.class_id, r.links) for r in j.join(df).collect()]
    assert sorted(got) == sorted([(i, i, 0) for i in (1, 2, 3, 6, 7, 8, 9, 10)] + [(4, 4, 1), (5, 4, 1)])
    kept = j.dedup(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "6", "7", "8", "9", "10", "None", "None"])
    assert j.join(empty).count() == 0 and j.dedup(empty).count() == 0


def test_floors_give_the_recall_and_no_more():
    cfg = j.Config()
    low = j.floors(cfg)
    assert j.met(cfg.threshold, low) >= cfg.recall
    one = low.copy()
    one[np.flatnonzero(low == low.min())[-1]] += 1
    assert j.met(cfg.threshold, one) < cfg.recall


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), max_size=5))
def test_words_are_those_of_the_expression(docs):
    s = j.Shingler(j.Config(), chars=8)
    words = [j.WORD.findall(t.lower()) if t else [] for t in docs]
    got = s.words(docs)
    assert [len(w) for w in words] == [len(h) for h in got]
    pairs = {(w, int(h)) for ws, hs in zip(words, got) for w, h in zip(ws, hs)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def forest(sets, cfg):
    """The same forest with sorted tries of dictionaries, one node and one pair at a time."""
    s = j.Shingler(cfg)
    paths = [[tuple(int(p).to_bytes(8, "big")) for p in s.paths(g)] for g in sets]
    going, met, partners = set(range(len(sets))), {}, defaultdict(list)
    sim = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    for depths, _, missing in j.steps(cfg):
        now = set()
        for t in range(cfg.trees):
            trie = defaultdict(list)
            for i in range(len(sets)):
                trie[paths[i][t][: depths[t]]].append(i)
            now |= {p for run in trie.values() for p in combinations(run, 2)}
        for a, b in now - set(met):
            if a in going or b in going:
                met[a, b] = sim(a, b)
                if met[a, b] >= cfg.threshold:
                    partners[a].append(met[a, b])
                    partners[b].append(met[a, b])
        edge = lambda x: cfg.threshold + min(int((x - cfg.threshold) / (1 - cfg.threshold) * j.BINS), j.BINS - 1) * (1 - cfg.threshold) / j.BINS
        going = {i for i in range(len(sets)) if len(partners[i]) < cfg.recall * (sum(1 / float(j.met(edge(x), depths)) for x in partners[i]) + missing)}
    return {p for p, x in met.items() if x >= cfg.threshold}, len(met)


def test_a_group_is_a_forest_of_sorted_tries(spread):
    cfg = j.Config(trees=24)
    base = [t for i, t in spread if i < 40]
    many = [" ".join(x for p, x in enumerate(base[3].split()) if (p * 7 + k) % 29) for k in range(40)]  # a dense neighbourhood
    s = j.Shingler(cfg)
    sets = [g for g in s.sets([t for i, t in spread if i % 1000 < 40] + many) if len(g)]
    sets = list({g.tobytes(): g for g in sets}.values())
    got = j.Group(sets, np.stack([s.paths(g) for g in sets]), np.ones(len(sets), np.int64), None, cfg, pairs=True, block=37).run()
    want, compared = forest(sets, cfg)
    assert {(a, b) for a, b, _ in got.pairs} == want and len(want) > 100
    links = Counter(x for p in want for x in p)
    assert got.links.tolist() == [links[i] for i in range(len(sets))]
    assert len(set(roots(range(len(sets)), got.bonds).values())) == len(set(roots(range(len(sets)), want).values())) == len(sets) - len(got.bonds)


def test_query(spark, sf_dir, documents):
    holds(rows(j.op6_jaccard_pairs(spark, sf_dir)), [(r.doc_id, r.text) for r in documents.collect()], j.Config())
