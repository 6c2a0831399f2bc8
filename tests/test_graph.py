import numpy as np

from lodestone.operators import graph


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def test_pagerank_equals_power_iteration(spark):
    pairs = [(0, i) for i in range(1, 6)] + [(1, 2), (2, 3), (3, 0)]
    a = np.zeros((6, 6))
    for x, y in pairs:
        a[x, y] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    s = np.array([1.0, 0, 0, 0, 0, 0])
    p = s
    for _ in range(12):
        p = 0.85 * a.T @ p + 0.15 * s
    got = {r.id: r.score for r in graph.personalized_pagerank(_edges(spark, pairs), [0], 12).collect()}
    assert np.allclose([got.get(i, 0) for i in range(6)], p)
    half = {r.id: r.score for r in graph.personalized_pagerank(_edges(spark, pairs), [0, 99], 1, tolerance=1e-9).collect()}
    assert half[99] == 0.075


def test_components_of_chain_and_cliques(spark):
    pairs = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 22), (22, 20)]
    got = {r.id: r.component for r in graph.components(_edges(spark, pairs), spark.createDataFrame([(50,)], "id long")).collect()}
    assert {got[i] for i in range(13)} == {0} and {got[i] for i in (20, 21, 22)} == {20} and got[50] == 50


def test_bfs_stops_and_leaves_seeds_out(spark):
    e = _edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in graph.forward_bfs(e, seeds, 2).collect()} == {(2, 1), (3, 2)}


def test_impact_by_id_name_and_containment(spark):
    symbols = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "child")], "id long, name string")
    refs = spark.createDataFrame([(2, 1, "a", "calls"), (3, None, "b", "type_reference")], "from_id long, to_id long, to_name string, kind string")
    inside = spark.createDataFrame([(1, 4)], "parent long, child long")
    assert {(r.id, r.depth) for r in graph.impact(symbols, refs, inside, "a", 5).collect()} == {(2, 1), (4, 1), (3, 2)}
    assert {r.id for r in graph.impact(symbols, refs, inside, "a", 5, False).collect()} == {2, 4}


def test_resolution_tiers(spark):
    symbols = spark.createDataFrame([(1, "run", "function", "a/x.py"), (2, "run", "function", "b/c/y.py"), (3, "Only", "class", "z.py"), (4, "Only", "variable", "q.py"), (5, "pkg.Tail", "class", "t.py")], "id long, name string, kind string, path string")
    refs = spark.createDataFrame([(1, "run", "b/c/z.py"), (2, "run", "none/z.py"), (3, "Only", "u.py"), (4, "other.Tail", "u.py"), (5, "missing", "u.py")], "ref_id long, name string, path string")
    got = {r.ref_id: (r.symbol_id, r.tier) for r in graph.resolve(refs, symbols).collect()}
    assert got == {1: (2, "proximity"), 3: (3, "strict"), 4: (5, "suffix")}


def test_edges_from_extracted_file(spark):
    from lodestone.operators import extract

    source = "import os\n\nclass A:\n    def go(self):\n        return help()\n\nclass B(A):\n    def go(self):\n        super().go()\n\ndef make():\n    b = B()\n    b.go()\n    return b\n"
    files = spark.createDataFrame([("f.py", "python", source)], "file string, language string, content string")
    symbols, refs = extract.symbols_table(files), extract.refs_table(files)
    assert symbols.count() == 7 and refs.count() == 6
    edges = {(r.src, r.dst, r.type) for r in graph.build_edges(refs, symbols).collect()}
    assert edges == {("B", "A", "extends"), ("go", "go", "calls"), ("make", "B", "calls"), ("make", "go", "calls"), ("A", "go", "contains"), ("B", "go", "contains")}


def _random_edges(seed, n, m):
    r = np.random.default_rng(seed)
    return sorted({(int(a), int(b)) for a, b in r.integers(0, n, (m, 2))})


def test_pagerank_moves_no_edges_in_its_rounds(spark, monkeypatch):
    """All mass starts on one side of a bipartite graph, so that nearly all rounds are needed."""
    pairs = [(a, 1000 + b) for a, b in _random_edges(1, 40, 300)]
    both = _edges(spark, pairs + [(b, a) for a, b in pairs])
    seeds = spark.createDataFrame([(a,) for a in sorted({a for a, _ in pairs})], "id long")
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or real(df))
    got = {r.id: r.score for r in graph.personalized_pagerank(both, seeds, tolerance=1e-6).collect()}
    assert len(cuts) <= 1
    a = np.zeros((2000, 2000))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    start = np.zeros(2000)
    start[[a for a, _ in pairs]] = 1 / len({a for a, _ in pairs})
    p = start
    for _ in range(50):
        old, p = p, 0.85 * a.T @ p + 0.15 * start
        if np.linalg.norm(p - old) < 1e-6:
            break
    assert np.allclose([got.get(i, 0) for i in range(2000)], p, atol=1e-9)


def test_pagerank_with_weights_and_dead_ends_by_lists_and_by_joins(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b, 1.0 + (a * b) % 3) for a, b in _random_edges(2, 60, 150) if a % 7], "src int, dst int, weight double")
    monkeypatch.setattr(graph.adjacency, "PIECE", 5)  # owners stand in several pieces
    lists = {r.id: r.score for r in graph.personalized_pagerank(edges, [1, 2, 999], 3).collect()}
    monkeypatch.setattr(graph.adjacency, "NODES", 0)
    joins = {r.id: r.score for r in graph.personalized_pagerank(edges, [1, 2, 999], 3).collect()}
    assert lists.keys() == joins.keys() and all(abs(lists[x] - joins[x]) < 1e-12 for x in lists)


def test_components_checkpoint_no_round(spark, monkeypatch):
    pairs = _random_edges(3, 400, 260) + [(900 + i, 899 + i) for i in range(50)] + [(2000, i) for i in range(2001, 2040)] + [(i, 3000) for i in range(3001, 3040)] + [(5, 5)]
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or real(df))
    monkeypatch.setattr(graph.adjacency, "PIECE", 7)
    got = {r.id: r.component for r in graph.components(_edges(spark, pairs), spark.createDataFrame([(5000,), (5,)], "id long")).collect()}
    want = {x: x for e in pairs for x in e} | {5000: 5000}
    while any(want[a] != want[b] for a, b in pairs):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and not cuts


def test_bfs_by_name_looks_up_each_name_once(spark):
    """2,000 unresolved uses of a name with 2,000 definitions: no table of four million hops."""
    refs = spark.createDataFrame([(1, 2, "two")] + [(2, None, "many")] * 2000 + [(i, None, "many") for i in range(10, 2000)], "from_id long, to_id long, to_name string")
    symbols = spark.createDataFrame([(2, "two")] + [(10_000 + i, "many") for i in range(2000)], "id long, name string")
    got = {r.id: r.depth for r in graph.forward_bfs_named(refs, symbols, spark.createDataFrame([(1,)], "id long"), 3).collect()}
    assert got == {2: 1} | {10_000 + i: 2 for i in range(2000)}
