"""Queries that join the retrieval lists with the graph's."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import adjacency, fusion

from . import relational as rel
from . import retrieval as ret
from .registry import query, table

PPR = rel._ppr_sql("", "(SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT id FROM ranked))").removeprefix("WITH RECURSIVE ")


@query(
    ret.LISTS.replace("WITH tok", "WITH RECURSIVE tok", 1)
    + f", {PPR}, b AS (SELECT c_custkey AS id, round(score, 12) AS raw FROM ppr JOIN customer ON c_custkey = ppr.id), r3 AS (SELECT * FROM ranked UNION ALL SELECT id, 2, row_number() OVER (ORDER BY raw DESC, id) FROM b QUALIFY row_number() OVER (ORDER BY raw DESC, id) <= 30)"
    + ret._fused_sql(1.0, 1.2, 10).replace("FROM ranked", "FROM r3").replace("WHEN 0 THEN 1.0", "WHEN 0 THEN 1.0 WHEN 2 THEN 0.8")
)
def hybrid_with_graph(spark, d):
    """Keywords, vectors and the gated PageRank list; customers and suppliers stand for symbols, a customer's chunk is the document of its number."""
    symbols = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + rel.SUPPLIER).alias("id"), F.col("s_name").alias("name")))
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_custkey").alias("chunk_id"))
    lists = ret._lists(spark, d)
    with adjacency.held(rel._calls(spark, d)) as one:
        third = fusion.graph_list("BUILDING blocks", lists, symbols, held, rel._both_ways(one), 30, rel.TOLERANCE, symmetric=True)
    out = fusion.hybrid_search(ret._docs(spark, d), table(spark, d, "embeddings"), ret.Q_AND, ret._vector(spark, d, 0), limit=10, pool=30, graph=third, index=ret.index(spark, d))
    return out.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
