import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_dedup as nd


def brute(rows, num, den):
    """component by id, over all pairs of exact shingle sets."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and den * len(x & y) >= num * len(x | y):
            parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        low[r] = i if r not in low else min(low[r], i)
    return {i: (len(s), low[root(k)]) for k, (i, s) in enumerate(sets)}


def corpus(seed, copies, words=60):
    """A group of near copies of one base, documents around a common passage, copies and odd ones."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    base, passage = [word() for _ in range(words)], [word() for _ in range(40)]
    texts = []
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(rng.randrange(3, 12))] + passage + [word() for _ in range(rng.randrange(3, 30))]) for _ in range(60)]
    texts += [texts[3]] * 5 + ["A b", "a  B", "a b c", "", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,num", [(1, 85), (2, 80), (3, 50)])
def test_groups_equal_brute_force(spark, seed, num):
    rows = corpus(seed, 150)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num, 100).collect()}
    assert got == brute(rows, num, 100)


def test_members_outside_the_star_are_found(spark, monkeypatch):
    """With tiny lists all go through centres and the comparison of what these leave out."""
    monkeypatch.setattr(nd, "SHORT_LIST", 2)
    rows = corpus(5, 80, words=30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()}
    assert got == brute(rows, 85, 100)


def test_long_chain_is_one_component(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(100)]
    assert {r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100).collect()} == {0}


def test_edges_of_the_input(spark):
    long_text = " ".join(f"x{i}" for i in range(30000))
    rows = [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "A B c d e f", 3), (3, long_text, 4), (2, long_text + " y", 5), (None, None, 6), (9, "", 7), (9, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, nd.near_duplicates(df).collect()), key=repr)
    want = [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (3, 29996, 2, False), (2, 29997, 2, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert got == sorted(want, key=repr)
    assert nd.near_duplicates(df.limit(0)).count() == 0
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "")[:5], r.component_id) for r in kept.collect()), key=repr)
    assert got in [sorted([(2, "x0 x1", 5), (7, t, i), (9, "", 7), (9, "", 7), (None, "", 6)], key=repr) for t, i in (("a b c", 2), ("A B c", 3))]
    assert nd.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_one_row_of_each_group_stays(spark, monkeypatch, few):
    monkeypatch.setattr(nd, "BROADCAST_GONE", few)
    rows = [(0, "z y x w v u", "a"), (1, "z y x w v u", "b"), (1, "other words stand here now again", "c"), (2, "twice the same row in here ok", "d"), (2, "twice the same row in here ok", "d"), (2, "twice the same row in here ok", "e"), (None, "z y x w v u", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    got = sorted((r.doc_id, r.text[:5]) for r in nd.keep_one(df).collect())
    assert got == [(0, "z y x"), (1, "other"), (2, "twice")]
    random_rows = corpus(11, 60)
    kept = {r.doc_id for r in nd.keep_one(spark.createDataFrame(random_rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, (n, c) in brute(random_rows, 80, 100).items() if i == c}


def test_long_lists_are_dealt_in_parts(spark, monkeypatch):
    from lodestone.llm import shared

    monkeypatch.setattr(nd, "PART_MEMBERS", 7)
    monkeypatch.setattr(shared, "HEAVY_ROWS", 7)  # values met more often are broadcast
    rows = corpus(4, 200)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()}
    assert got == brute(rows, 85, 100)


def test_sql_says_the_same(spark, sf_dir):
    from conftest import held_against_sql

    from lodestone.llm import catalog

    mine, theirs = held_against_sql(spark, sf_dir, catalog.op6_near_duplicates, nd.oracle(85, 100))
    assert mine == theirs


def test_candidates_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    """Hundreds of near copies: the candidate pairs are a multiple of the members, far below all pairs."""
    seen = {}

    def counted(df, label, real=nd.written):
        table = real(df, label)
        if label in ("near-likely", "near-pairs", "near-rest"):
            seen[label] = max(seen.get(label, 0), table.count())
        return table

    monkeypatch.setattr(nd, "written", counted)
    sizes = {}
    for copies in (150, 600):
        seen.clear()
        rows = corpus(9, copies)
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 100).collect()}
        assert len(got) == len(rows)
        sizes[copies] = sum(seen.values())
    assert sizes[600] < 6 * sizes[150] and sizes[600] < 600 * 599 / 2 / 3, sizes


def test_tables_between_are_deleted(spark):
    import os

    from lodestone.llm import shared

    folder = shared.shared_dir(spark).removeprefix("file://") + "/lodestone"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    result = nd.near_duplicates(spark.createDataFrame(corpus(2, 40), "doc_id long, text string"))
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["groups"]
    assert result.count() == result.count()
