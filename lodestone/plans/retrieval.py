"""Retrieval queries over documents, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import unit_norm
from lodestone.operators import adjacency, fanout, fts, fusion, graph, postings, relations, snippets

from .registry import query, table

TOKENS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"
Q_AND, Q_ONE = "thing eron", "thtion"


def _leaf_sql(words: list[str], prefix: bool = False) -> tuple[str, str]:
    """Occurrences of a phrase in token list t, and their start places."""
    tests = [f"starts_with(t[i + {j}], '{w}')" if prefix and j == len(words) - 1 else f"t[i + {j}] = '{w}'" for j, w in enumerate(words)]
    places = f"list_filter(range(1, len(t) - {len(words) - 2}), lambda i: {' AND '.join(tests)})"
    return f"len({places})", places


def bm25_sql(leaves: list[tuple], match: str, limit: int | None = 10, where: str = "true", project: str = "'all'", per: int | None = None, scored: list[int] | None = None, near: int | None = None) -> str:
    """CTEs ending in ``hit(id, project, score)``: the published BM25 formula, term by term."""
    cols, stats, score = [], [], []
    for k, leaf in enumerate(leaves):
        f, places = _leaf_sql(*leaf)
        n = f"{f} > 0"
        if near is not None:
            other = _leaf_sql(*leaves[1 - k])[1]
            f = f"len(list_filter({places}, lambda p: len(list_filter({other}, lambda q: abs(q - p) - 1 <= {near})) > 0))"
        cols.append(f"{f} AS f{k}, {n} AS any{k}")
        stats.append(f"count(*) FILTER (any{k}) AS n{k}")
        if scored is None or k in scored:
            idf = f"CASE WHEN (N - n{k} + 0.5) / (n{k} + 0.5) > 1 THEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END"
            score.append(f"{idf} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))")
    cut = f"ORDER BY score, id LIMIT {limit}" if limit and not per else ""
    rank = f"QUALIFY row_number() OVER (PARTITION BY project ORDER BY score, id) <= {per}" if per else ""
    return f"""WITH tok AS (SELECT doc_id AS id, {project} AS project, lang, source, {TOKENS} AS t FROM documents),
cnt AS (SELECT id, project, lang, source, len(t) AS dl, {', '.join(cols)} FROM tok),
st AS (SELECT project, count(*) AS N, avg(dl) AS avgdl, {', '.join(stats)} FROM cnt GROUP BY project),
hit AS (SELECT id, project, -({' + '.join(score)}) AS score FROM cnt JOIN st USING (project) WHERE ({match}) AND ({where}) {rank} {cut})"""


FIN = "SELECT id, round(score, 6) AS score FROM hit"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def index(spark: SparkSession, d: str) -> postings.Postings:
    """The documents' inverted index: built when first asked for, read by all keyword queries."""
    return postings.of_table(spark, f"{d}/documents.parquet", project_col="source")


def _search(spark: SparkSession, d: str, query: str, limit: int = 10, **options) -> DataFrame:
    return fts.keyword_search(_docs(spark, d), query, limit, index=index(spark, d), **options)


def _done(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


@query(bm25_sql([(["thing"],), (["eron"],)], "f0 > 0 AND f1 > 0") + FIN)
def bm25_and(spark, d):
    return _done(_search(spark, d, Q_AND))


@query(bm25_sql([(["thtion"],)], "f0 > 0") + FIN)
def bm25_single(spark, d):
    return _done(_search(spark, d, Q_ONE))


@query(bm25_sql([(["thing"],), (["eron"],)], "f0 > 0 AND f1 > 0", limit=None) + "SELECT id, round(greatest(0, least(1, -score / (1 + abs(score)))), 6) AS norm FROM hit")
def bm25_norm(spark, d):
    return fts.bm25(_docs(spark, d), Q_AND, index=index(spark, d)).select("id", F.round(tx.normalize_bm25(F.col("score")), 6).alias("norm"))


@query(bm25_sql([(["que"],)], "f0 > 0", where="coalesce(lang, 'code') IN ('fr', 'es')") + FIN)
def bm25_source_filter(spark, d):
    return _done(_search(spark, d, "que", where=F.coalesce("lang", F.lit("code")).isin("fr", "es")))


@query(bm25_sql([(["thing"],)], "f0 > 0", project="source", per=3) + "SELECT id, project, round(score, 6) AS score FROM hit")
def bm25_project_stats(spark, d):
    hits = fts.bm25(_docs(spark, d), "thing", project_col="source", index=index(spark, d)).withColumn("score", -F.col("score"))
    from pyspark.sql.window import Window

    r = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return hits.withColumn("r", r).filter("r <= 3").select("id", "project", F.round(-F.col("score"), 6).alias("score"))


@query(bm25_sql([(["of", "the"],)], "f0 > 0") + FIN)
def fts_phrase(spark, d):
    return _done(_search(spark, d, '"of the"', advanced=True))


@query(bm25_sql([(["thing"],), (["eron"],)], "f0 > 0 AND f1 = 0", scored=[0]) + FIN)
def fts_not(spark, d):
    return _done(_search(spark, d, "thing NOT eron", advanced=True))


@query(bm25_sql([(["attio"], True)], "f0 > 0") + FIN)
def fts_prefix(spark, d):
    return _done(_search(spark, d, "attio*", advanced=True))


@query(bm25_sql([(["thing"],), (["que"],)], "f0 > 0 OR f1 > 0") + FIN)
def fts_or(spark, d):
    return _done(_search(spark, d, "thing OR que", advanced=True))


@query(bm25_sql([(["thing"],), (["the"],)], "f0 > 0 AND f1 > 0", near=3) + FIN)
def fts_near(spark, d):
    return _done(_search(spark, d, "NEAR(thing the, 3)", advanced=True))


@query(bm25_sql([(["of"],), (["the"],), (["of", "the"],), (["ofthe"],), (["of", "the"],)], "(f0 > 0 AND f1 > 0) OR f2 > 0 OR f3 > 0 OR f4 > 0") + FIN)
def query_expansion(spark, d):
    return _done(_search(spark, d, tx.name_variants("of the"), advanced=True))


def _vector(spark, d, i: int) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == i).first().embedding)


def _query_vectors(spark, d) -> DataFrame:
    """The stated query set of the vector searches: every row whose id is divisible by 20."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {COS} DESC, id LIMIT 10")
def knn_cosine(spark, d):
    return _done(fusion.knn(table(spark, d, "embeddings"), _vector(spark, d, 0), 10))


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5")
def knn_multi(spark, d):
    return fusion.knn_many(table(spark, d, "embeddings"), _query_vectors(spark, d), 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT e.vec_id AS id, e.label, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 3 ORDER BY s DESC, id LIMIT 30) WHERE label <= 4 ORDER BY s DESC, id LIMIT 10")
def knn_filtered_overfetch(spark, d):
    return _done(fusion.knn(table(spark, d, "embeddings"), _vector(spark, d, 3), 10, where=F.col("label") <= 4))


KW = bm25_sql([(["thing"],), (["eron"],)], "f0 > 0 AND f1 > 0", limit=30)
VEC = f"vec AS (SELECT e.vec_id AS id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY s DESC, id LIMIT 30)"
LISTS = f"{KW}, {VEC}, ranked AS (SELECT id, 0 AS src, row_number() OVER (ORDER BY score, id) AS rank FROM hit UNION ALL SELECT id, 1, row_number() OVER (ORDER BY s DESC, id) FROM vec)"


def _fused_sql(w0: float, w1: float, limit: int = 20) -> str:
    return f""", fused AS (SELECT id, sum(CASE src WHEN 0 THEN {w0} ELSE {w1} END / (60 + rank)) AS s, min(src * 1000 + rank) AS tie FROM ranked GROUP BY id)
SELECT id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, tie, id) AS rank FROM fused ORDER BY s DESC, tie, id LIMIT {limit}"""


def _lists(spark, d):
    a = fusion.ranked(_search(spark, d, Q_AND, 30), "keyword", ascending=True)
    return [a, fusion.ranked(fusion.knn(table(spark, d, "embeddings"), _vector(spark, d, 0), 30), "semantic")]


def _fused(df: DataFrame, limit: int = 20) -> DataFrame:
    return fusion.with_rank(df, limit).select("id", F.round("rrf_score", 6).alias("score"), F.col("rrf_rank").cast("long").alias("rank"))


@query(LISTS + _fused_sql(1.0, 1.0))
def rrf_two_way(spark, d):
    return _fused(fusion.rrf(_lists(spark, d), ["keyword", "semantic"]))


@query(LISTS + _fused_sql(1.0, 1.2))
def rrf_weighted(spark, d):
    return _fused(fusion.rrf(_lists(spark, d), ["keyword", "semantic"], [1.0, 1.2]))


@query(LISTS + ", r3 AS (SELECT * FROM ranked UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY n_chars DESC, doc_id) FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 30)" + _fused_sql(1.0, 1.2).replace("FROM ranked", "FROM r3").replace("WHEN 0 THEN 1.0", "WHEN 0 THEN 1.0 WHEN 2 THEN 0.8"))
def rrf_three_way(spark, d):
    third = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return _fused(fusion.rrf([*_lists(spark, d), fusion.ranked(third, "graph")], ["keyword", "semantic", "graph"], [1.0, 1.2, 0.8]))


@query(LISTS + _fused_sql(1.0, 1.2, 10))
def hybrid_search(spark, d):
    out = fusion.hybrid_search(_docs(spark, d), table(spark, d, "embeddings"), Q_AND, _vector(spark, d, 0), limit=10, pool=30, index=index(spark, d))
    return out.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(bm25_sql([(["gnu"],), (["version"],)], "f0 > 0 AND f1 > 0", limit=30) + """, n AS (SELECT id, score, -score / (1 - score) AS s, row_number() OVER (ORDER BY score, id) AS r FROM hit),
f AS (SELECT max(s) FILTER (r = 1) AS a, coalesce(max(s) FILTER (r = 2), -1) AS b FROM n)
SELECT coalesce(a >= 0.85 AND (b < 0 OR a - b >= 0.15), false) AS strong, round(a, 6) AS first FROM f""")
def hybrid_short_circuit(spark, d):
    hits = _search(spark, d, "gnu version", 30)
    best = hits.agg(F.round(F.max(tx.normalize_bm25(F.col("score"))), 6).alias("first")).withColumn("one", F.lit(1))
    return fusion.is_strong(hits).withColumn("one", F.lit(1)).join(best, "one").select("strong", "first")


BASE = "regexp_extract(url, '([^/]*)$', 1)"
DEPTH = "length(url) - length(replace(url, '/', ''))"


@query(f"SELECT page_id, CAST(0.1 * len(list_intersect(['de', 'en', 'ref'], list_distinct(regexp_extract_all(lower({BASE}), '[a-z]+')))) AS DOUBLE) AS boost FROM pages")
def filename_boost(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(fusion.filename_boost(F.col("url"), "de EN ref", 0.1), 6).alias("boost"))


@query(f"SELECT page_id, round(CAST(0.02 AS DOUBLE) * ({DEPTH}), 6) AS penalty FROM pages")
def depth_penalty(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(fusion.depth_penalty(F.col("url"), 0.02), 6).alias("penalty"))


@query("SELECT host AS path, page_id AS id, score FROM (SELECT page_id, split_part(url, '/', 3) AS host, CAST(length(html) AS DOUBLE) AS score FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) = 1")
def file_dedup(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.element_at(F.split("url", "/"), 3).alias("path"), F.length("html").cast("double").alias("score"))
    return fusion.first_per_file(rows).select("path", "id", "score")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS file_id, extract('dayofyear' FROM o_orderdate) AS lo FROM orders),
s AS (SELECT o_orderkey AS sid, o_custkey AS sf, lower(o_orderpriority) AS name, extract('dayofyear' FROM o_orderdate) AS line FROM orders)
SELECT c.id, CAST(0.5 * arg_min(len(list_intersect(['not', 'specified', 'urgent'], list_distinct(regexp_extract_all(name, '[a-z]+')))), sid) AS DOUBLE) AS boost
FROM c JOIN s ON sf = file_id AND line BETWEEN lo AND lo + 20 WHERE len(list_intersect(['not', 'specified', 'urgent'], list_distinct(regexp_extract_all(name, '[a-z]+')))) > 0 GROUP BY c.id""")
def symbol_boost(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lower("o_orderpriority").alias("name"), F.dayofyear("o_orderdate").alias("line"))
    chunks = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.col("line").alias("start_line"), (F.col("line") + 20).alias("end_line"))
    symbols = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), "name", "line")
    return fusion.symbol_boost(chunks, symbols, "urgent not specified", 0.5)


@query("""SELECT doc_id AS id, source AS project, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
FROM documents QUALIFY rank <= 3 ORDER BY score DESC, project, rank LIMIT 15""")
def federated_topk(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("n_chars").cast("double").alias("score"))
    return fusion.federated_topk(rows, 3, 15).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '000000' ELSE substr(sha256(text), 1, 6) END AS docid FROM documents")
def docid(spark, d):
    return _docs(spark, d).select("doc_id", tx.docid(F.col("text")).alias("docid"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dupes(spark, d):
    return _docs(spark, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


LINES = """WITH l AS (SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT id, line_no, len(list_intersect(['eron', 'the', 'thing'], list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')))) AS overlap FROM l)"""


@query(LINES + " SELECT id, CAST(line_no AS BIGINT) AS line_no, CAST(overlap AS BIGINT) AS overlap FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, line_no) = 1")
def snippet_best_line(spark, d):
    b = snippets.best_lines(_docs(spark, d), "thing eron the")
    return b.select("id", F.col("line_no").cast("long").alias("line_no"), F.col("overlap").cast("long").alias("overlap"))


@query(LINES + ", w AS (SELECT id, line_no, sum(overlap) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS total FROM s) SELECT id, CAST(line_no AS BIGINT) AS line_no, CAST(total AS BIGINT) AS overlap FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY total DESC, line_no) = 1")
def snippet_window(spark, d):
    b = snippets.best_windows(_docs(spark, d), "thing eron the")
    return b.select("id", F.col("line_no").cast("long").alias("line_no"), F.col("overlap").cast("long").alias("overlap"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|svg|noscript)[^>]*>.*?</(script|style|svg|noscript)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_text_regex(spark, d):
    return table(spark, d, "pages").select("page_id", tx.visible_text(F.col("html")).alias("text"))


METRICS = """WITH a AS (SELECT e.vec_id AS query_id, f.vec_id AS id, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(f.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, f.vec_id) AS rank, e.label = f.label AS good
  FROM embeddings e, embeddings f WHERE e.vec_id % 20 = 0 QUALIFY rank <= 10),
r AS (SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings q JOIN embeddings x ON x.label = q.label WHERE q.vec_id % 20 = 0 GROUP BY 1),
p AS (SELECT query_id, min(rank) FILTER (good) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (good), 0) AS dcg FROM a GROUP BY 1)
"""
PER_QUERY = """SELECT query_id, coalesce(1 / f, 0) AS rr, dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
 CAST(coalesce(f <= 1, false) AS INTEGER) AS top1, CAST(coalesce(f <= 3, false) AS INTEGER) AS top3, CAST(coalesce(f <= 5, false) AS INTEGER) AS top5, CAST(coalesce(f <= 10, false) AS INTEGER) AS topk FROM p JOIN r USING (query_id)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    with adjacency.held(fusion.knn_many(e, _query_vectors(spark, d), 10).select("query_id", "id", "rank")) as near:
        return graph.cut(relations.label_metrics(near, e.select(F.col("vec_id").alias("id"), "label")))  # a row a query


@query(METRICS + f"SELECT * REPLACE (round(rr, 6) AS rr, round(ndcg, 6) AS ndcg) FROM ({PER_QUERY})")
def metrics_mrr_ndcg(spark, d):
    return _metrics(spark, d).withColumn("rr", F.round("rr", 6)).withColumn("ndcg", F.round("ndcg", 6))


@query(METRICS + f", m AS (SELECT m.*, label AS category FROM ({PER_QUERY}) m JOIN embeddings ON vec_id = query_id) SELECT category, count(*) AS queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in relations.MEASURES)} FROM m GROUP BY GROUPING SETS ((category), ())")
def metrics_by_category(spark, d):
    categories = _query_vectors(spark, d).select("query_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category")), "query_id")
    return relations.mean_metrics(_metrics(spark, d), categories).select("category", "queries", *[F.round(m, 6).alias(m) for m in relations.MEASURES])


@query(METRICS + f", m AS (SELECT label, {', '.join(f'avg({m}) AS {m}' for m in relations.MEASURES)} FROM ({PER_QUERY}) m JOIN embeddings ON vec_id = query_id GROUP BY label) SELECT count(*) AS categories, {', '.join(f'round(avg({m}), 6) AS {m}' for m in relations.MEASURES)} FROM m")
def metrics_blended(spark, d):
    categories = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    return relations.blended_metrics(_metrics(spark, d), categories).select("categories", *[F.round(m, 6).alias(m) for m in relations.MEASURES])


@query("SELECT label, count(*) AS n, round(avg(x), 6) AS mean_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS x FROM embeddings) GROUP BY label")
def mean_norm_by_label(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(unit_norm(F.col("embedding"))), 6).alias("mean_norm"))


DRIFT = """WITH p AS (SELECT a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
x AS (SELECT unnest(range(64)) AS i, a, b FROM p), y AS (SELECT i, a[i + 1] AS x, unnest(range(64)) AS j, b FROM x)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x * b[j + 1]) - sum(x) * sum(b[j + 1]) / count(*), 4) AS value FROM y GROUP BY ALL"""


def _covariance(spark: SparkSession, e: DataFrame) -> DataFrame:
    a = e.filter("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("a"))
    pairs = a.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return relations.cross_covariance(pairs, "a", "b").withColumn("value", F.round("value", 4))


@query(DRIFT)
def drift_cross_covariance(spark, d):
    return _covariance(spark, table(spark, d, "embeddings").select("vec_id", "embedding"))


@query("SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(embedding[dim]::DOUBLE), 6) AS mean FROM embeddings, unnest(range(1, 65)) AS t(dim) GROUP BY 1")
def drift_column_means(spark, d):
    return relations.column_means(table(spark, d, "embeddings"), "embedding").withColumn("mean", F.round("mean", 6))


def _list_sql(query: int) -> str:
    return f"(SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT e.vec_id AS id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = {query} ORDER BY s DESC, id LIMIT 15))"


@query(f"""WITH u AS (SELECT id, 'first' AS origin, rank - 1 + (rank - 1) // 2 AS place FROM {_list_sql(0)} UNION ALL SELECT id, 'second', rank * 3 - 1 FROM {_list_sql(3)})
SELECT id, arg_min(origin, place) AS origin, CAST(min(place) AS BIGINT) AS place FROM u GROUP BY id ORDER BY place, id LIMIT 15""")
def interleave(spark, d):
    e = table(spark, d, "embeddings")
    a, b = (fusion.ranked(fusion.knn(e, _vector(spark, d, i), 15), str(i)) for i in (0, 3))
    return fusion.interleave(a, b, 2, 15)


FAN_PATH = "CASE WHEN doc_id % 5 = 0 THEN coalesce(source, '') || '/README.md' ELSE coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) END"


@query(f"""WITH u AS (SELECT id, 'code' AS origin, (rank - 1) * 3 AS place FROM {_list_sql(0)} UNION ALL SELECT id, 'general', (rank - 1) // 2 * 3 + 1 + (rank - 1) % 2 FROM {_list_sql(3)}),
d AS (SELECT u.*, text, {FAN_PATH} AS path FROM u JOIN documents ON doc_id = id),
m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY path, left(coalesce(text, ''), 100) ORDER BY place) = 1 ORDER BY place LIMIT 30),
r AS (SELECT *, row_number() OVER (ORDER BY path LIKE '%/README.md', place) AS rank FROM m)
SELECT id, origin, rank, len(list_filter(['the', 'eron', 'que'], lambda w: list_contains({TOKENS}, w))) / 3.0 AS rerank_score FROM r WHERE rank <= 20 ORDER BY rerank_score DESC, rank LIMIT 10""")
def fan_out(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("id"), F.expr(FAN_PATH.replace("VARCHAR", "STRING")).alias("path"), F.col("text").alias("content"))
    code, general = (fusion.ranked(fusion.knn(table(spark, d, "embeddings"), _vector(spark, d, i), 15), str(i)).join(docs, "id") for i in (0, 3))
    out = fanout.fan_out(code, general, "que the eron", weight=2, demote=True)
    return out.select("id", "origin", F.col("rank").cast("long").alias("rank"), "rerank_score")


@query("SELECT doc_id, source, round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS round FROM documents) ORDER BY round, source LIMIT 50")
def stratified_sample(spark, d):
    s = relations.stratified(_docs(spark, d).select("doc_id", "source"), "source", F.md5(F.col("doc_id").cast("string")), 50)
    return s.withColumn("round", F.col("round").cast("long"))

