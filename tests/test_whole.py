"""Queries over all rows, dimensions and rounds, against plain versions."""

import numpy as np
import pyarrow.parquet as pq

from lodestone.plans import catalog

QUERIES = catalog.queries()


def _column(sf_dir, table, name):
    return pq.read_table(f"{sf_dir}/{table}.parquet", columns=[name])[name].to_pylist()


def test_graph_of_all_lineitems(spark, sf_dir):
    edges = set(zip(_column(sf_dir, "lineitem", "l_suppkey"), (p + 1_000_000 for p in _column(sf_dir, "lineitem", "l_partkey"))))
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for x in up}
    assert {r.id: r.component for r in QUERIES["connected_components"](spark, sf_dir).collect()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    most = min(sizes, key=lambda c: (-sizes[c], c))
    assert tuple(QUERIES["largest_component"](spark, sf_dir).first()) == (most, sizes[most])
    gate = QUERIES["sparse_gate"](spark, sf_dir).first()
    density, share = len(edges) / len(up), sizes[most] / len(up)
    assert tuple(gate) == (len(up), len(edges), round(density, 6), round(share, 6), len(up) < 100 or density < 0.75 or share < 0.5)


def test_all_references_are_read(spark, sf_dir):
    refs = set(zip(_column(sf_dir, "lineitem", "l_orderkey"), _column(sf_dir, "lineitem", "l_linenumber")))
    assert QUERIES["name_resolution"](spark, sf_dir).count() > len(refs) / 20


def test_covariance_of_all_dimensions(spark, sf_dir):
    e = dict(zip(_column(sf_dir, "embeddings", "vec_id"), _column(sf_dir, "embeddings", "embedding")))
    a, b = (np.array([e[i + k] for i in sorted(e) if i % 2 == 0 and i + 1 in e], float) for k in (0, 1))
    want = (a - a.mean(0)).T @ (b - b.mean(0))
    got = QUERIES["drift_cross_covariance"](spark, sf_dir).collect()
    assert len(got) == want.size == 64 * 64 and all(abs(r.value - want[r.i, r.j]) < 1e-4 for r in got)


def test_pagerank_converges(spark, sf_dir):
    customer = dict(zip(_column(sf_dir, "orders", "o_orderkey"), _column(sf_dir, "orders", "o_custkey")))
    items = zip(_column(sf_dir, "lineitem", "l_orderkey"), _column(sf_dir, "lineitem", "l_suppkey"))
    edges = {(customer[o], 10_000_000 + s) for o, s in items if o in customer}
    ids = {x: i for i, x in enumerate(sorted({x for e in edges for x in e} | {3, 10_000_004}))}
    a = np.zeros((len(ids), len(ids)))
    for x, y in edges:
        a[ids[x], ids[y]] = a[ids[y], ids[x]] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    s = np.zeros(len(ids))
    s[[ids[3], ids[10_000_004]]] = 0.5
    p = s
    for _ in range(50):
        old, p = p, 0.85 * a.T @ p + 0.15 * s
        if np.linalg.norm(p - old) < 1e-6:
            break
    got = {r.id: r.score for r in QUERIES["pagerank_personalized"](spark, sf_dir).collect()}
    assert all(abs(got.get(x, 0) - p[i]) < 2e-7 for x, i in ids.items())
    best = {}
    for x, nation in zip(_column(sf_dir, "customer", "c_custkey"), _column(sf_dir, "customer", "c_nationkey")):
        best[nation] = max(best.get(nation, 0), p[ids[x]] if x in ids else 0)
    ranked = QUERIES["ppr_ranked_chunks"](spark, sf_dir).collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r.rank)] == sorted(best, key=lambda n: (-round(best[n], 12), n))[:10]
