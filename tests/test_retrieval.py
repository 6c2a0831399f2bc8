import math

import pytest

from lodestone.operators import fts, fusion, relations, snippets


def _ranked(spark, ids):
    return spark.createDataFrame([(i, r + 1) for r, i in enumerate(ids)], "id long, rank int")


def test_rrf_formula_and_ties(spark):
    one = fusion.rrf([_ranked(spark, [1])], ["a"]).collect()
    assert one[0].rrf_score == pytest.approx(1 / 61)
    both = fusion.with_rank(fusion.rrf([_ranked(spark, [1, 2, 3]), _ranked(spark, [2, 1, 4])], ["a", "b"]), 10).collect()
    assert [r.id for r in both] == [1, 2, 3, 4]


def test_rrf_weight_zero_adds_nothing(spark):
    lists = [_ranked(spark, [1, 2]), _ranked(spark, [3, 2])]
    zero = {r.id: r.rrf_score for r in fusion.rrf(lists, ["a", "b"], [1.0, 0.0]).collect()}
    alone = {r.id: r.rrf_score for r in fusion.rrf(lists[:1], ["a"]).collect()}
    assert {k: v for k, v in zero.items() if v} == pytest.approx(alone)


def test_rrf_needs_a_weight_for_each_list(spark):
    with pytest.raises(ValueError):
        fusion.rrf([_ranked(spark, [1])], ["a"], [1.0, 2.0])


def test_query_language():
    assert fts.split_prefix("lex,vec: find me") == ("find me", ["lex", "vec"])
    assert fts.split_prefix("find: me") == ("find: me", ["lex", "vec"])
    assert fts.sanitize('a "b*') == '"a" "b*"'
    assert fts.sanitize("(a", advanced=True) == "a"
    for bad in ("a OR", "retry-backoff", "NEAR(a b, 2"):
        with pytest.raises((fts.QuerySyntaxError, ValueError)):
            fts.Query(bad)


def test_bm25_formula_and_malformed_queries(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue cat"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.id: r.score for r in fts.bm25(docs, "fox").collect()}
    idf, avg = math.log((5 - 1 + 0.5) / 1.5), 7 / 5
    assert got == pytest.approx({1: -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))})
    assert fts.bm25(docs, "a OR", advanced=True).count() == 0
    assert {r.id for r in fts.bm25(docs, '"red dog"', advanced=True).collect()} == {2}
    assert {r.id for r in fts.bm25(docs, "red NOT dog", advanced=True).collect()} == {1}
    assert {r.id for r in fts.bm25(docs, "NEAR(red dog, 0)", advanced=True).collect()} == {2}


def test_knn_zero_query_and_zero_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.id for r in fusion.knn(v, [1.0, 0.0], 3).collect()] == [1, 3, 2]
    assert fusion.knn(v, [0.0, 0.0], 3).count() == 0


def test_short_circuit(spark):
    s = spark.createDataFrame([(-30.0,), (-1.0,)], "score double")
    assert fusion.is_strong(s).first().strong
    assert not fusion.is_strong(spark.createDataFrame([(-30.0,), (-29.0,)], "score double")).first().strong
    assert not fusion.is_strong(s.limit(0)).first().strong


def test_snippets(spark):
    docs = spark.createDataFrame([(1, "a\nfox here\nfox and hound\nz"), (2, "")], "doc_id long, text string")
    assert {r.id: r.line_no for r in snippets.best_lines(docs, "fox hound").collect()} == {1: 2, 2: 0}
    near = [snippets.Enclosing(2, 40, "class X:"), snippets.Enclosing(10, 30, "    def y(self):")]
    assert snippets.render(["a", "b", "c"], 1, 20, 0, near) == (" 2 | class X:\n         ...  (7 lines)\n10 |     def y(self):\n             ...  (10 lines)\n21 | b\n             ...  (9 lines)", 21, 21)
    assert snippets.render(["a", "b", "c"], 1, 20, 0, near, max_depth=1)[0] == "10 |     def y(self):\n         ...  (10 lines)\n21 | b\n         ...  (9 lines)"
    assert snippets.render(["a", "b", "c"], 1, 9, 0, near, 1, full=True) == ("10 | b\n11 | c", 10, 30)
    assert snippets.render(["a", "b", "c"], 1, 9) == (" 9 | a\n10 | b\n11 | c", 9, 11)


def test_nearest_lines_equal_brute_force(spark):
    import numpy as np

    from lodestone.operators.models import hashed_embedder

    assert snippets.windows(list("abcd")) == ["a\nb\nc", "a\nb\nc", "b\nc\nd", "b\nc\nd"] and snippets.windows(["a"]) == ["a"]
    texts = {1: "one two\nthree fox\nfox hound\nhound\nfive\nsix", 2: "", 3: None, 4: "hound"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    embed = hashed_embedder()
    q = embed(["fox hound"])[0]
    want = {}
    for i, t in texts.items():
        if t is not None:
            lines = t.split("\n")
            scores = []
            for n in range(len(lines)):
                a = max(0, n - 1)
                b = min(len(lines), a + 3)
                a = max(0, b - 3) if b - a < 3 else a
                v = embed(["\n".join(lines[a:b])])[0]
                scores.append(float(v @ q) / (float(np.linalg.norm(v) * np.linalg.norm(q)) + 1e-9))
            want[i] = int(np.argmax(np.round(scores, 9)))
    assert {r.id: r.line_no for r in snippets.nearest_lines(docs, q.tolist(), hashed_embedder).collect()} == want


def test_symbol_fallback_only_without_exact_match(spark):
    s = spark.createDataFrame([(1, "run"), (2, "rerun"), (3, "stop")], "id long, name string")
    assert {r.id for r in relations.lookup_symbols(s, "run").collect()} == {1}
    assert {r.id for r in relations.lookup_symbols(s, "ru").collect()} == {1, 2}
    assert {r.id for r in relations.lookup_symbols(s, "re*").collect()} == {2}


def test_drift_rotation_recovers_a_rotation(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    old = rng.normal(size=(50, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(old, old @ q.T, strict=True)], "old array<double>, new array<double>")
    assert np.allclose(relations.drift_rotation(pairs, "old", "new", 4), q, atol=1e-6)


def test_knn_many_against_numpy_in_any_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]  # many ties, some zeros
    v = spark.createDataFrame([*rows, (200, None)], "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([*rows[:30], (30, None), (31, [0.0] * 4)], "query_id long, q array<double>")
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in rows}
    want = set()
    for q, x in rows[:30]:
        if any(x):
            best = sorted(unit, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:7]
            want |= {(q, i, r + 1) for r, i in enumerate(best)}
    for block in (1024, 7):
        got = fusion.knn_many(v, queries, 7, block=block)
        assert {(r.query_id, r.id, r.rank) for r in got.collect()} == want
    assert fusion.knn_many(v, queries.limit(0), 7).count() == 0 and fusion.knn_many(v.limit(0), queries, 7).count() == 0


def test_knn_many_scores_few_vectors_at_once(spark, monkeypatch):
    """One batch of 3,000 vectors and 40 queries: no array of more than SCORE_ROWS scores a query."""
    import numpy as np

    v = np.random.default_rng(6).normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    queries = rows.filter("vec_id < 40").selectExpr("vec_id AS query_id", "embedding AS q")
    monkeypatch.setattr(fusion, "SCORE_ROWS", 100)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(unit[:40] @ unit.T, 12)
    want = {(q, int(i), r + 1) for q in range(40) for r, i in enumerate(np.lexsort((np.arange(3000), -scores[q]))[:7])}
    assert {(r.query_id, r.id, r.rank) for r in fusion.knn_many(rows, queries, 7).collect()} == want


def test_metrics_by_label_equal_those_by_pairs(spark):
    """A label's rows are counted, not paired with its queries; null labels are relevant to nothing."""
    labels = spark.createDataFrame([(i, None if i % 11 == 0 else i % 3) for i in range(60)], "id long, label int")
    ranked = spark.createDataFrame([(q, (q * 7 + r * r) % 60, r) for q in range(0, 60, 5) for r in range(1, 13)], "query_id long, id long, rank int").dropDuplicates(["query_id", "id"])
    pairs = labels.selectExpr("id AS query_id", "label").filter("query_id % 5 = 0").join(labels, "label").select("query_id", "id")
    got, want = relations.label_metrics(ranked, labels), relations.retrieval_metrics(ranked, pairs)
    show = lambda df: sorted(tuple(round(float(x), 9) for x in r) for r in df.collect())
    assert show(got) == show(want) and got.count() == 10


def test_fan_out_takes_turns_and_demotes(spark):
    from lodestone.operators import fanout

    schema = "rank int, id long, path string, content string"
    code = spark.createDataFrame([(1, 1, "a.py", "x load"), (2, 2, "README.md", "y"), (3, 3, None, None)], schema)
    general = spark.createDataFrame([(1, 4, "d.md", "load user"), (2, 1, "a.py", "x load"), (3, 5, "e.md", "z")], schema)
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(fanout.fan_out(code, general, "q", rerank=False)) == [1, 4, 2, 3, 5]
    assert ids(fanout.fan_out(code, general, "q", weight=2, demote=True, rerank=False)) == [1, 4, 5, 3, 2]
    assert [(r.id, r.rerank_score) for r in fanout.fan_out(code, general, "load user", top_k=2).collect()] == [(4, 1.0), (1, 0.5)]
    assert fanout.fan_out(code.limit(0), general.limit(0), "q").count() == 0
    assert fanout.route("doc").source_types == ("markdown", "json") and fanout.route("none").rerank


@pytest.mark.parametrize("query", ["wa wb", '"wa wb"', "wa NOT wb", "w*", '"wa w"*', "NEAR(wa wb, 2)", 'NEAR("wa wb" wc, 3)', "wa OR (wb AND wc)", "zz", "wa AND zz", "NOT", '"!!"', "\u00e9l* OR wa"])
def test_postings_equal_the_scan(spark, tmp_path, query):
    import random

    from lodestone.operators import postings

    rng = random.Random(5)
    words = ["wa", "wb", "wc", "wab", "\u00c9lan", "x1"]
    rows = [(i % 50, f"p{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(120)] + [(200, None, None), (201, "p0", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    index = postings.build(docs, f"file://{tmp_path}/index", project_col="source")
    for options in ({}, {"project_col": "source"}, {"where": docs.doc_id < 20}):
        scan = fts.bm25(docs, query, advanced=True, **options)
        read = fts.bm25(docs, query, advanced=True, index=index, **options)
        show = lambda df: sorted((r.id, r.project, round(r.score, 9)) for r in df.collect())
        if "where" in options:  # ids stand for rows there
            scan = scan.filter("id < 20")
        assert show(scan) == show(read), options


def test_index_follows_its_table(spark, tmp_path):
    from lodestone.operators import postings

    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(path)
    first = postings.of_table(spark, path)
    assert postings.of_table(spark, path).path == first.path
    spark.createDataFrame([(2, "one three")], "doc_id long, text string").write.mode("append").parquet(path)
    second = postings.of_table(spark, path)
    assert second.path != first.path and second.postings.filter("term = 'one'").count() == 2


def test_postings_are_pruned(spark, sf_dir):
    from lodestone.plans import retrieval

    index = retrieval.index(spark, sf_dir)
    plan = fts.bm25(spark.read.parquet(f"{sf_dir}/documents.parquet"), "thing eron", index=index)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(In(term" in plan or "PushedFilters: [In(term" in plan
    assert "documents.parquet" not in plan
    assert "StringStartsWith(term" in fts.bm25(index.postings, "attio*", advanced=True, index=index)._jdf.queryExecution().toString()


def test_posting_lists_are_made_row_by_row(monkeypatch):
    """No shuffle of words: each row's lists come from its own words, whatever rows are grouped at once."""
    import pyarrow as pa

    from lodestone.operators import postings

    rows = [["a", "b", "a"], [], None, ["b"], ["c", "a", "c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([7, 7, 8, None, 9]), pa.array(["x", None, "x", "y", "y"]), pa.array(rows, pa.list_(pa.string()))], names=["row", "id", "project", "t"])
    for most in (1, 3, 100):
        monkeypatch.setattr(postings, "WORDS", most)
        got = [r for b in postings._lists(iter([batch])) for r in b.to_pylist()]
        want = {(w, i, tuple(p + 1 for p, x in enumerate(t or []) if x == w)) for i, t in enumerate(rows) for w in [*(t or []), None]}
        assert len(got) == len(want) and {(r["term"], r["row"], tuple(r["at"])) for r in got} == want
        assert all(r["dl"] == len(rows[r["row"]] or []) and r["id"] == [7, 7, 8, None, 9][r["row"]] for r in got)
