"""Chunking, discovery and formatting queries over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunkers
from lodestone.sources import discovery, sinks
from lodestone.streaming.incremental import windowed_counts

from .registry import query, table


@query()
def plaintext_chunks(spark, d):
    return chunkers.chunk_table(table(spark, d, "documents"), chunkers.chunk_plain)


@query()
def markdown_chunks(spark, d):
    return chunkers.chunk_table(table(spark, d, "documents"), chunkers.chunk_markdown)


@query()
def html_chunks(spark, d):
    return chunkers.chunk_table(table(spark, d, "pages"), chunkers.chunk_markup, "page_id", "html")


@query("SELECT event_id AS id, 'k' AS key_path, 'k: ' || (props->>'k') AS content FROM events")
def json_chunks(spark, d):
    return chunkers.chunk_table(table(spark, d, "events"), chunkers.chunk_json, "event_id", "props").select("id", "key_path", "content")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    return windowed_counts(table(spark, d, "events"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '([^/]*)$', 1) LIKE '%.html' THEN 'html' END AS route, NOT (url LIKE '%..%') AS safe FROM pages WHERE NOT regexp_matches(url, '(^|/)build/')")
def file_routes(spark, d):
    pages = table(spark, d, "pages")
    kept = pages.filter(~discovery.ignored(F.col("url")))
    return kept.select("page_id", F.when(discovery.route(F.col("url")) == "html", "html").alias("route"), discovery.safe_path(F.col("url")).alias("safe"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS place, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def format_json(spark, d):
    n = table(spark, d, "nation").withColumn("place", F.col("n_nationkey").cast("long"))
    return sinks.formatted(n, "json", "place", ["n_nationkey", "n_name"]).withColumnRenamed("__order", "place")


@query("SELECT n_regionkey AS place, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation")
def format_markdown(spark, d):
    return sinks.formatted(table(spark, d, "nation"), "markdown", "n_regionkey", ["n_nationkey", "n_name"]).withColumnRenamed("__order", "place")


@query("SELECT min(page_id) AS place, split_part(url, '/', 3) AS line FROM pages GROUP BY 2")
def format_files(spark, d):
    p = table(spark, d, "pages").withColumn("path", F.split_part("url", F.lit("/"), F.lit(3)))
    return sinks.formatted(p, "files", "page_id").withColumnRenamed("__order", "place")


@query("SELECT a.doc_id AS a, b.doc_id AS b, CAST(CASE WHEN a.source <> b.source THEN 0 WHEN a.lang <> b.lang THEN 1 ELSE 2 END AS BIGINT) AS shared FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def path_proximity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.lit("f")).alias("p"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b"), F.col("p").alias("q"))
    return docs.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), "b", tx.common_segments(F.col("p"), F.col("q")).alias("shared"))
