"""Vector search, rank fusion, boosts and the hybrid search built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lodestone.functions import text as tx
from lodestone.functions.vectors import cosine_to
from lodestone.operators import adjacency, fts
from lodestone.operators import graph as graphs

RRF_K = 60
WEIGHTS = {"keyword": 1.0, "semantic": 1.2, "graph": 0.8}
STRONG, GAP = 0.85, 0.15
OVERFETCH = 3
#: Query vectors that a task holds at once, and vectors that it scores with them at once (4 MB of scores).
QUERY_BLOCK, SCORE_ROWS = 512, 1024


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """id and score of the k rows of largest cosine; a zero query finds nothing.

    With ``where``, three times k neighbours are taken first and filtered afterwards, so
    fewer than k rows can come back: a post-filter on purpose.
    """
    if not any(query):
        return vectors.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    scored = vectors.withColumn("id", F.col(id_col)).withColumn("score", cosine_to(F.col(vec_col), query))
    order = [F.desc("score"), F.asc("id")]
    if where is None:
        return scored.select("id", "score").orderBy(*order).limit(k)
    return scored.orderBy(*order).limit(OVERFETCH * k).filter(where).select("id", "score").orderBy(*order).limit(k)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score and rank of the k nearest rows of every query (query_id, q).

    Queries go to the tasks in blocks of about ``block`` vectors, one scan of the vectors a
    block. A task multiplies each Arrow batch with the block and keeps k rows a query, so
    only those are shuffled. Scores are exact cosines to 12 digits, equal ones by id. Rows
    of norm 0 score 0; null vectors, and queries that are null or of norm 0, find nothing.
    """
    import numpy as np

    fields = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")

    def nearest(names: list, unit: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple]] = [[] for _ in names]
            for batch in (b.slice(i, SCORE_ROWS) for b in batches for i in range(0, b.num_rows, SCORE_ROWS)):
                # A slice of vectors and the block's scores of it are in memory, however large the batch.
                ids, lists = batch.column(0).to_pylist(), batch.column(1)
                if len(set(lists.value_lengths().to_pylist())) > 1:
                    raise ValueError("vectors of different lengths")
                m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
                m /= np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
                scores = np.round(unit @ m.T, 12)
                at = max(0, len(ids) - k)
                least = np.maximum(np.partition(scores, at, axis=1)[:, at], [x[k - 1][0] * -1 if len(x) == k else -np.inf for x in best])
                found: dict[int, list[tuple]] = {}
                for q, i in zip(*map(np.ndarray.tolist, np.nonzero(scores >= least[:, None])), strict=True):
                    found.setdefault(q, []).append((-float(scores[q, i]), ids[i]))
                for q, more in found.items():
                    best[q] = sorted(best[q] + more)[:k]
            flat = [(q, i, -s) for q, hits in zip(names, best, strict=True) for s, i in hits]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], t) for c, t in enumerate(types)], names=fields.names)

        return run

    types = [f.type for f in to_arrow_schema(fields)]
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = queries.filter(F.col("q").isNotNull() & (F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)) == b)).select("query_id", "q").collect()  # about `block` rows
        held = [(r.query_id, v / n) for r in part if (n := np.linalg.norm(v := np.asarray(r.q, np.float64))) > 0]
        if held:
            hits = rows.mapInArrow(nearest([q for q, _ in held], np.array([v for _, v in held])), fields)
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = rows.sparkSession.createDataFrame([], fields)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def ranked(hits: DataFrame, label: str, ascending: bool = False) -> DataFrame:
    """A ranked list: id, list label and 1-based rank (for lists already cut to a limit)."""
    order = F.asc("score") if ascending else F.desc("score")
    return hits.select("id", F.lit(label).alias("list"), F.row_number().over(Window.partitionBy(F.lit(label)).orderBy(order, F.asc("id"))).alias("rank"))


def rrf(lists: Sequence[DataFrame], labels: Sequence[str], weights: Sequence[float] | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists: id, rrf_score, sources and the tie key.

    Ties keep the order of insertion: the first list that holds the id, then its rank there.
    """
    if weights is not None and len(weights) != len(lists):
        raise ValueError("one weight for each list is needed")
    w = weights or [1.0] * len(lists)
    rows = None
    for i, (df, label) in enumerate(zip(lists, labels, strict=True)):
        part = df.select("id", F.lit(i).alias("at"), F.lit(label).alias("list"), "rank", (F.lit(float(w[i])) / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(
        F.sum("part").alias("rrf_score"), F.min(F.struct("at", "rank")).alias("tie"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("sources")
    )


def with_rank(fused: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` fused rows with their rank: a top-k first, so one task ranks ``limit`` rows."""
    top = fused.orderBy(F.desc("rrf_score"), F.asc("tie"), F.asc("id")).limit(limit)
    return top.withColumn("rrf_rank", F.row_number().over(Window.orderBy(F.desc("rrf_score"), F.asc("tie"), F.asc("id"))))


def is_strong(keyword: DataFrame) -> DataFrame:
    """One row: whether the best keyword hit is good and far enough ahead to stand alone."""
    norm = keyword.select(tx.normalize_bm25(F.col("score")).alias("s"))
    best = norm.orderBy(F.desc("s")).limit(2).agg(F.max("s").alias("first"), F.min("s").alias("second"), F.count("*").alias("n"))
    strong = (F.col("first") >= STRONG) & ((F.col("n") == 1) | (F.col("first") - F.col("second") >= GAP))
    return best.select(F.coalesce(strong, F.lit(False)).alias("strong"))


def filename_boost(path: Column, query: str, boost: float) -> Column:
    words = F.array_distinct(F.array(*[F.lit(w) for w in _query_words(query)])) if _query_words(query) else F.array().cast("array<string>")
    return F.lit(boost) * F.size(F.array_intersect(words, tx.words_only(tx.basename(path))))


def depth_penalty(path: Column, penalty: float) -> Column:
    return F.lit(penalty) * tx.depth(path)


def _query_words(query: str) -> list[str]:
    import re

    return sorted(set(re.findall("[a-z]+", query.lower())))


def symbol_boost(chunks: DataFrame, symbols: DataFrame, query: str, boost: float) -> DataFrame:
    """chunk id and boost: the first symbol (by id) inside a chunk's lines that shares words with the query.

    chunks: id, file_id, start_line, end_line; symbols: id, file_id, name, line. The equal
    file key carries the join, the line range is its residual condition.
    """
    words = F.array(*[F.lit(w) for w in _query_words(query)]) if _query_words(query) else F.array().cast("array<string>")
    s = symbols.select(F.col("id").alias("sid"), F.col("file_id").alias("sf"), "line", F.size(F.array_intersect(words, tx.words_only("name"))).alias("overlap")).filter("overlap > 0")
    met = chunks.join(s, (F.col("file_id") == F.col("sf")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("id").agg((F.lit(boost) * F.min_by("overlap", "sid")).alias("boost"))


def first_per_file(results: DataFrame, score: str = "score", path: str = "path") -> DataFrame:
    """The best row of each path, equal scores by id."""
    return results.withColumn("__r", F.row_number().over(Window.partitionBy(path).orderBy(F.desc(score), F.asc("id")))).filter("__r = 1").drop("__r")


def federated_topk(per_project: DataFrame, per: int, limit: int) -> DataFrame:
    """Each project's best ``per`` rows, then the global best; equal scores keep project order."""
    r = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), F.asc("id")))
    return per_project.withColumn("rank", r).filter(F.col("rank") <= per).orderBy(F.desc("score"), F.asc("project"), F.asc("rank")).limit(limit)


def interleave(first: DataFrame, second: DataFrame, ratio: int, limit: int) -> DataFrame:
    """``ratio`` rows of the first ranked list for each of the second; an id keeps its earliest place."""
    a = first.select("id", F.lit("first").alias("origin"), (F.col("rank") - 1 + F.floor((F.col("rank") - 1) / ratio)).cast("long").alias("place"))
    b = second.select("id", F.lit("second").alias("origin"), (F.col("rank") * (ratio + 1) - 1).cast("long").alias("place"))
    best = a.unionByName(b).groupBy("id").agg(F.min_by("origin", F.struct("place", "origin")).alias("origin"), F.min("place").alias("place"))
    return best.orderBy("place", "id").limit(limit)


def parse_weights(text: str) -> dict[str, float]:
    """Weights given as ``keyword=1.5,semantic=1.0``."""
    try:
        return {k.strip(): float(v) for k, v in (pair.strip().split("=") for pair in text.split(","))} if text.strip() else {}
    except ValueError as e:
        raise ValueError(f"weights are written keyword=1.5,semantic=1.0,graph=0.8, not {text!r}") from e


def graph_list(query: str, lists: Sequence[DataFrame], symbols: DataFrame, symbol_chunks: DataFrame, edges: DataFrame, limit: int, tolerance: float = 1e-6, symmetric: bool = False) -> DataFrame | None:
    """The third list of a search, id and rank: chunks by personalised PageRank, or None where the gates are shut.

    symbols: id, name; symbol_chunks: symbol_id, chunk_id; edges: src, dst, weight
    (``symmetric``: every edge both ways). The query must name a symbol (tokens of two characters or more, any case), and the graph of
    the symbols must not be sparse. The walk restarts at all symbols of the chunks that the
    other lists found (limited lists, so few); its scores go to chunks by their best symbol.
    """
    import re

    tokens = sorted({t.lower() for t in re.findall(r"[A-Za-z_]\w+", query)})
    if not tokens or symbols.filter(F.lower("name").isin(tokens)).isEmpty():
        return None
    nodes = symbols.select("id").distinct()
    found = lists[0].select("id")
    for more in lists[1:]:
        found = found.unionByName(more.select("id"))
    seeds = symbol_chunks.join(found.distinct().withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi").select(F.col("symbol_id").alias("id")).join(nodes, "id", "left_semi")
    with adjacency.held(edges) as known, adjacency.held(graphs.load(known, nodes, graphs.parts(known))) as inside:
        if graphs.sparse_gate(inside, nodes, symmetric, unique=True).first().sparse:
            return None
        scores = graphs.personalized_pagerank(inside, seeds, tolerance=tolerance)
    return graphs.ranked_chunks(scores, symbol_chunks, limit).select("id", "rank")


def hybrid_search(
    docs: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: Sequence[float] | None,
    limit: int = 10,
    pool: int = 50,
    weights: dict[str, float] | None = None,
    graph: DataFrame | None = None,
    paths: DataFrame | None = None,
    file_boost: float = 0.0,
    penalty: float = 0.0,
    one_per_file: bool = False,
    where: Column | None = None,
    expand: bool = False,
    short_circuit: bool = True,
    advanced: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    vector_id_col: str = "vec_id",
    project_col: str | None = None,
    index: fts.Postings | None = None,
    restrict: bool = False,
    kinds: Sequence[str] | None = None,
    graph_of: Callable[[str, list[DataFrame]], DataFrame | None] | None = None,
    boosts: DataFrame | None = None,
) -> DataFrame:
    """id, score, rank and rank sources of the fused search, one lazy plan.

    ``index`` holds the postings of the texts: the keyword list then reads no text, and
    ``restrict`` keeps it to the ids in ``docs``.
    A ``lex:``, ``vec:`` or ``hyde:`` prefix chooses the lists. If the keyword list is a
    strong signal, the other lists are emptied by a one-row flag and boosts are left out.
    ``kinds`` overrides the prefix. ``graph`` is a ranked list of its own (id, rank), or
    ``graph_of`` makes it from the query and the other lists; ``paths`` gives id and path,
    ``boosts`` adds to the score by id (symbol boosts).
    """
    clean, prefixed = fts.split_prefix(query)
    kinds = list(kinds or prefixed)
    text = tx.name_variants(clean) if expand else clean
    w = WEIGHTS | (weights or {})
    lists, labels = [], []
    if "lex" in kinds:
        keyword = fts.keyword_search(docs, text, pool, id_col=id_col, text_col=text_col, project_col=project_col, where=where, advanced=advanced or (expand and text != clean), index=index, restrict=restrict)
        lists.append(ranked(keyword, "keyword", ascending=True))
        labels.append("keyword")
    flag = is_strong(keyword) if labels and short_circuit else None

    def unless_strong(df: DataFrame) -> DataFrame:
        return df if flag is None else df.withColumn("__one", F.lit(1)).join(flag.withColumn("__one", F.lit(1)), "__one").filter("not strong").drop("__one", "strong")

    if {"vec", "hyde"} & set(kinds) and query_vector is not None:
        lists.append(unless_strong(ranked(knn(vectors, query_vector, pool, vector_id_col), "semantic")))
        labels.append("semantic")
    if graph_of is not None and lists:
        graph = graph_of(clean, lists)
    if graph is not None:
        lists.append(unless_strong(graph.select("id", F.lit("graph").alias("list"), "rank")))
        labels.append("graph")
    if not lists:
        raise ValueError("the query asks for no list that can be made")
    fused = rrf(lists, labels, [w.get(x, 1.0) for x in labels])
    if paths is not None and (file_boost or penalty or one_per_file):
        named = fused.join(paths.select("id", "path"), "id", "left")
        change = filename_boost(F.col("path"), clean, file_boost) - depth_penalty(F.col("path"), penalty)
        fused = named.withColumn("rrf_score", F.col("rrf_score") + F.coalesce(change, F.lit(0.0)))
        if one_per_file and boosts is None:
            fused = first_per_file(fused, "rrf_score", "path")
    if boosts is not None:
        fused = fused.join(boosts.select("id", "boost"), "id", "left").withColumn("rrf_score", F.col("rrf_score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
        if one_per_file and paths is not None:
            fused = first_per_file(fused if "path" in fused.columns else fused.join(paths.select("id", "path"), "id", "left"), "rrf_score", "path")
    return with_rank(fused, limit).select("id", F.col("rrf_score").alias("score"), F.col("rrf_rank").alias("rank"), "sources")
