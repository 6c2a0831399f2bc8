"""Symbol, event, graph, federation and control-plane queries over the star-schema tables.

Parts stand for symbols, events for event registrations and emissions, customers and
suppliers (tied by orders and line items) for callers and callees, nations for projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import adjacency, graph, relations

from .registry import query, table

SUPPLIER, NATION, REGION = 10_000_000, 20_000_000, 30_000_000


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name = 'red widget'")
def symbol_lookup_exact(spark, d):
    return relations.lookup_symbols(_parts(spark, d), "red widget").select("id", "name")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE 'red%' AND p_type = 'ECONOMY'")
def symbol_lookup_glob(spark, d):
    return relations.lookup_symbols(_parts(spark, d), "RED*", kind="ECONOMY").select("id", "name")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name ILIKE '%widg%'")
def symbol_lookup_fallback(spark, d):
    return relations.lookup_symbols(_parts(spark, d), "widg").select("id", "name")


EVENTS = "(SELECT event_id, user_id || '_' || (props->>'k') AS name, CASE WHEN event_type IN ('signup', 'view') THEN 'registers_on' ELSE 'fires' END AS kind FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    name = F.concat_ws("_", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    kind = F.when(F.col("event_type").isin("signup", "view"), relations.REGISTERS).otherwise(relations.FIRES)
    return e.select("event_id", name.alias("name"), kind.alias("kind"))


@query(f"SELECT event_id, name, kind FROM {EVENTS} WHERE kind = 'registers_on'")
def event_list(spark, d):
    return relations.list_events(_events(spark, d), kinds=[relations.REGISTERS])


@query(f"SELECT event_id, name, kind FROM {EVENTS} WHERE name ILIKE '1_3%'")
def event_like(spark, d):
    return relations.list_events(_events(spark, d), "1_3%")


@query(f"SELECT event_id, name, kind FROM {EVENTS} ORDER BY name, kind, event_id LIMIT 25 OFFSET 50")
def event_page(spark, d):
    return relations.page(relations.list_events(_events(spark, d)), ["name", "kind", "event_id"], 50, 25)


MISMATCH = f"(SELECT name, count(*) FILTER (kind = 'registers_on') AS registrations, count(*) FILTER (kind = 'fires') AS fires FROM {EVENTS} GROUP BY name)"
STATUS = "CASE WHEN fires = 0 THEN 'ORPHANED_LISTENER' WHEN registrations = 0 THEN 'UNFIRED_EVENT' ELSE 'healthy' END"


@query(f"SELECT name, registrations, fires, {STATUS} AS status FROM {MISMATCH}")
def event_mismatch(spark, d):
    return relations.event_mismatches(_events(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (s <> 'healthy') AS mismatches, count(*) FILTER (s = 'ORPHANED_LISTENER') AS orphaned, count(*) FILTER (s = 'UNFIRED_EVENT') AS unfired, count(*) FILTER (s = 'healthy') AS healthy FROM (SELECT {STATUS} AS s FROM {MISMATCH})")
def event_mismatch_summary(spark, d):
    return relations.event_summary(_events(spark, d))


CALLS = "(SELECT DISTINCT o_custkey AS src, 10000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
SYMBOLS = "(SELECT c_custkey AS id, c_name AS name, c_nationkey AS project FROM customer UNION ALL SELECT 10000000 + s_suppkey, s_name, s_nationkey FROM supplier)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") + SUPPLIER).alias("dst"))
    n = graph.parts(li)  # as many rows a task, however many line items there are
    return li.repartition(n, "o_orderkey").join(o, "o_orderkey").select("src", "dst").repartition(n, "src", "dst").distinct().withColumn("weight", F.lit(1.0))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("project"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("project"))
    return c.unionByName(s)


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Calls, resolved for even suppliers and left to their name for odd ones."""
    return _named(_calls(spark, d), _symbols(spark, d))


def _named(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    named = calls.join(symbols.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "dst")
    return named.select(F.col("src").alias("from_id"), F.when(F.col("dst") % 2 == 0, F.col("dst")).alias("to_id"), "to_name", F.lit("calls").alias("kind"))


@query(f"SELECT DISTINCT c_custkey AS id, c_name AS name FROM {CALLS} JOIN customer ON c_custkey = src WHERE dst = 10000007")
def callers(spark, d):
    return relations.callers(_refs(spark, d), _symbols(spark, d), "Supplier#000000007").select("id", "name")


@query(f"SELECT s_name AS to_name, 'calls' AS kind FROM {CALLS} JOIN supplier ON 10000000 + s_suppkey = dst WHERE src = 5")
def callees(spark, d):
    return relations.refs_of(_refs(spark, d).withColumn("line", F.lit(0)), _symbols(spark, d), "Customer#000000005").select("to_name", "kind")


@query(f"SELECT CASE WHEN dst % 2 = 0 THEN dst ELSE 0 END AS to_id, count(*) AS n FROM {CALLS} GROUP BY 1")
def caller_ref_view(spark, d):
    refs = _refs(spark, d).withColumn("ref_id", F.lit(0))
    return relations.caller_refs(refs).groupBy("to_id").agg(F.count("*").alias("n"))


USES = "(SELECT s_name AS name, c_nationkey AS project FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"
XREF = f"(SELECT u.name, s_nationkey AS def_project, u.project AS use_project, count(*) AS uses FROM {USES} u JOIN supplier ON s_name = u.name WHERE s_nationkey <> u.project GROUP BY ALL)"


def _uses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return li.join(o, "o_orderkey").join(c, "o_custkey").join(s, "s_suppkey").select("name", "project")


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("project"))


@query(f"SELECT * FROM {XREF}")
def cross_project_refs(spark, d):
    return relations.cross_refs(_definitions(spark, d), _uses(spark, d))


@query(f"SELECT use_project AS from_project, def_project AS to_project, CAST(sum(uses) AS BIGINT) AS refs, count(*) AS names FROM {XREF} GROUP BY ALL")
def project_map(spark, d):
    return relations.project_map(_definitions(spark, d), _uses(spark, d))


RESOLVE = """WITH s AS (SELECT p_partkey AS id, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS p, p_brand || '/' || p_size || '/x' AS path FROM part),
r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, p_name AS name, p_brand || '/' || CAST(l_linenumber AS VARCHAR) || '/y' AS path FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey),
q AS (SELECT ref_id, CASE WHEN ref_id % 3 = 0 THEN 'pkg.mod.' || name WHEN ref_id % 7 = 0 THEN 'none' ELSE name END AS name, path FROM r),
c AS (SELECT ref_id, s.id AS symbol_id, p, q.path AS a, s.path AS b, 'strict' AS tier FROM q JOIN s ON s.name = q.name
  UNION ALL SELECT ref_id, s.id, p, q.path, s.path, 'suffix' FROM q JOIN s ON s.name = regexp_extract(q.name, '([^.]*)$', 1) WHERE q.name NOT IN (SELECT name FROM s)),
n AS (SELECT *, CASE WHEN split_part(a, '/', 1) <> split_part(b, '/', 1) THEN 0 WHEN split_part(a, '/', 2) <> split_part(b, '/', 2) THEN 1 ELSE 2 END AS near FROM c QUALIFY p = min(p) OVER (PARTITION BY ref_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, row_number() OVER (PARTITION BY ref_id ORDER BY near DESC, symbol_id) AS r, lead(near) OVER (PARTITION BY ref_id ORDER BY near DESC, symbol_id) AS nx FROM n),
done AS (SELECT ref_id, symbol_id, CASE WHEN n = 1 THEN tier ELSE 'proximity' END AS tier FROM k WHERE r = 1 AND (n = 1 OR near > nx)) """


def _open_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    kind = F.when(F.col("p_type") == "ECONOMY", "function").when(F.col("p_type") == "STANDARD", "class").when(F.col("p_type") == "PROMO", "method").otherwise("variable")
    symbols = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), F.lit("x")).alias("path"))
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), "l_linenumber", "l_partkey")
    li = li.groupBy("ref_id", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"))
    name = F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("pkg.mod."), "p_name")).when(F.col("ref_id") % 7 == 0, "none").otherwise(F.col("p_name"))
    refs = li.join(p.select("p_partkey", "p_name", "p_brand"), "p_partkey").select("ref_id", name.alias("name"), F.concat_ws("/", "p_brand", F.col("l_linenumber").cast("string"), F.lit("y")).alias("path"))
    return refs, symbols


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolve(*_open_refs(spark, d))


@query(RESOLVE + "SELECT * FROM done")
def name_resolution(spark, d):
    return _resolved(spark, d)


@query(RESOLVE + "SELECT tier, count(*) AS n, count(DISTINCT symbol_id) AS targets FROM done GROUP BY tier")
def resolution_stats(spark, d):
    return _resolved(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("symbol_id").alias("targets"))


@query(RESOLVE + """SELECT count(*) AS total_unresolved, count(*) FILTER (tier = 'strict') AS resolved_strict, count(*) FILTER (tier = 'proximity') AS resolved_proximity, count(*) FILTER (tier = 'suffix') AS resolved_suffix,
 count(*) FILTER (tier IS NULL AND has) AS ambiguous_dropped, count(*) FILTER (tier IS NULL AND NOT has) AS no_candidate, count(DISTINCT (path, symbol_id)) FILTER (symbol_id IS NOT NULL) AS edges_created
FROM (SELECT q.*, tier, symbol_id, q.name IN (SELECT name FROM s) OR regexp_extract(q.name, '([^.]*)$', 1) IN (SELECT regexp_extract(name, '([^.]*)$', 1) FROM s) AS has FROM q LEFT JOIN done USING (ref_id))""")
def resolution_counters(spark, d):
    refs, symbols = _open_refs(spark, d)
    return graph.resolution_counters(refs.withColumn("from_id", F.col("path")), symbols, graph.resolve(refs, symbols))


@query("SELECT p_name AS name, count(*) AS definitions, array_to_string(list_sort(list_distinct(array_agg(p_brand))), ',') AS projects FROM part WHERE p_name <> '' GROUP BY 1")
def symbol_projects(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("project"))
    return relations.symbol_projects(p).withColumn("projects", F.array_join("projects", ","))


@query("SELECT event_id, event_type AS kind, c_name AS symbol, n_name AS path FROM events JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def event_sites(spark, d):
    refs = table(spark, d, "events").select("event_id", F.col("user_id").alias("from_id"), F.col("event_type").alias("kind"))
    symbols = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("file_id"))
    files = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path"))
    return relations.event_sites(refs, symbols, files)


CONTAINS = "(SELECT 30000000 + n_regionkey AS src, 20000000 + n_nationkey AS dst FROM nation UNION ALL SELECT 20000000 + c_nationkey, c_custkey FROM customer UNION ALL SELECT 20000000 + s_nationkey, 10000000 + s_suppkey FROM supplier)"


def _contains(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select((F.col("n_regionkey") + REGION).cast("long").alias("src"), (F.col("n_nationkey") + NATION).cast("long").alias("dst"))
    c = table(spark, d, "customer").select((F.col("c_nationkey") + NATION).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    s = table(spark, d, "supplier").select((F.col("s_nationkey") + NATION).cast("long").alias("src"), (F.col("s_suppkey") + SUPPLIER).alias("dst"))
    return n.unionByName(c).unionByName(s)


@query(f"WITH RECURSIVE e AS (SELECT * FROM {CONTAINS} UNION ALL SELECT * FROM {CALLS}), r(id, depth) AS (SELECT 30000001, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 3) SELECT CAST(id AS BIGINT) AS id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> 30000001 GROUP BY id")
def forward_bfs(spark, d):
    edges = _contains(spark, d).unionByName(_calls(spark, d).select("src", "dst"))
    return graph.forward_bfs(edges, spark.createDataFrame([(REGION + 1,)], "id bigint"), 3)


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {CALLS} UNION ALL SELECT dst, src FROM {CALLS}), r(id, depth) AS (SELECT 10000007, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 2) SELECT CAST(id AS BIGINT) AS id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE id <> 10000007 GROUP BY id")
def forward_bfs_by_name(spark, d):
    """Hops to resolved symbols, and to all symbols of the name where a reference is unresolved; suppliers call back by name."""
    symbols, names = _symbols(spark, d), _symbols(spark, d).select("id", "name")
    with adjacency.held(_calls(spark, d).select("src", "dst")) as calls:
        there = calls.join(names, calls.dst == names.id).select(F.col("src").alias("from_id"), F.when(F.col("dst") % 2 == 0, F.col("dst")).alias("to_id"), F.col("name").alias("to_name"))
        back = calls.join(names, calls.src == names.id).select(F.col("dst").alias("from_id"), F.lit(None).cast("bigint").alias("to_id"), F.col("name").alias("to_name"))
        return graph.forward_bfs_named(there.unionByName(back), symbols, spark.createDataFrame([(SUPPLIER + 7,)], "id bigint"), 2)


IMPACT = f"""WITH RECURSIVE s AS (SELECT * FROM {SYMBOLS} UNION ALL SELECT 20000000 + n_nationkey, n_name, n_nationkey FROM nation),
e AS (SELECT dst AS a, src AS b FROM {CALLS} UNION SELECT src, dst FROM {CONTAINS}),
r(id, depth) AS (SELECT id, 0 FROM s WHERE name = 'NATION_3' UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.id WHERE depth < 2)
SELECT CAST(id AS BIGINT) AS id, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY id"""


def _impact(spark: SparkSession, d: str, types: bool) -> DataFrame:
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + NATION).cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("project"))
    down = _contains(spark, d).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
    refs = _refs(spark, d).withColumn("kind", F.when(F.col("from_id") % 5 == 0, "type_reference").otherwise("calls"))
    return graph.impact(_symbols(spark, d).unionByName(nations), refs, down, "NATION_3", 2, types).select("id", "depth")


@query(IMPACT)
def impact_bfs(spark, d):
    return _impact(spark, d, True)


@query(IMPACT.replace(f"src AS b FROM {CALLS}", f"src AS b FROM {CALLS} WHERE src % 5 <> 0"))
def impact_no_types(spark, d):
    return _impact(spark, d, False)


SUPPLIES = "(SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem)"
# Labels fall to the smallest neighbour's until none falls: the same rows that pointer jumping reaches in fewer rounds.
LABELS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM {SUPPLIES} UNION ALL SELECT dst, src FROM {SUPPLIES}),
c(id, component) USING KEY (id) AS (SELECT a, a FROM e GROUP BY a
  UNION SELECT e.a, min(c.component) FROM c JOIN e ON e.b = c.id JOIN recurring.c AS k ON k.id = e.a GROUP BY e.a HAVING min(c.component) < min(k.component)) """


def _supplies(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and part of every line item; the same pair can come several times."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst"))


@query(LABELS + "SELECT id, component FROM c")
def connected_components(spark, d):
    return graph.components(_supplies(spark, d))


@query(LABELS + "SELECT component, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, component LIMIT 1")
def largest_component(spark, d):
    return graph.components(_supplies(spark, d)).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)


@query(LABELS + f", g AS (SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM {SUPPLIES}) AS edges, (SELECT max(n) FROM (SELECT count(*) AS n FROM c GROUP BY component)) AS largest) SELECT CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, round(edges / nodes, 6) AS density, round(largest / nodes, 6) AS largest_share, nodes < 100 OR edges / nodes < 0.75 OR largest / nodes < 0.5 AS sparse FROM g")
def sparse_gate(spark, d):
    all_ = _supplies(spark, d)
    with adjacency.held(all_.repartition(graph.parts(all_), "src", "dst").distinct()) as e:
        g = graph.cut(graph.sparse_gate(e, unique=True))
    return g.withColumn("density", F.round("density", 6)).withColumn("largest_share", F.round("largest_share", 6))


TOLERANCE = 1e-6


def _ppr_sql(before: str, seeds: str) -> str:
    """CTEs ending in ``ppr(id, score)``: power iteration until the L2 change is under the tolerance, 50 rounds at most."""
    return f"""WITH RECURSIVE {before}k AS MATERIALIZED (SELECT * FROM {CALLS}),
m AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k)),
s AS MATERIALIZED (SELECT id, 1.0::DOUBLE / count(*) OVER () AS score FROM (SELECT DISTINCT id FROM {seeds})),
p(i, id, score, old) AS (SELECT 0, id, score, 10.0::DOUBLE FROM s
  UNION ALL SELECT i + 1, id, sum(score), sum(old) FROM (
    SELECT p.i, m.dst AS id, p.score * m.share * 0.85 AS score, 0.0 AS old FROM p JOIN m ON m.src = p.id
    UNION ALL SELECT t.i, s.id, s.score * 0.15, 0.0 FROM (SELECT DISTINCT i FROM p) t, s
    UNION ALL SELECT i, id, 0.0, score FROM p) WHERE i < 50 AND (SELECT sum((score - old) * (score - old)) FROM p) >= 1e-12 GROUP BY i, id),
ppr AS (SELECT id, score FROM p WHERE i = (SELECT max(i) FROM p) AND score > 1e-10)"""


def _both_ways(one: DataFrame) -> DataFrame:
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _ppr(spark: SparkSession, d: str) -> DataFrame:
    with adjacency.held(_calls(spark, d)) as one:
        return graph.personalized_pagerank(_both_ways(one), [3, SUPPLIER + 4], graph.ROUNDS, tolerance=TOLERANCE)


SEEDS = "(VALUES (3), (10000004)) AS v(id)"


@query(_ppr_sql("", SEEDS) + " SELECT CAST(id AS BIGINT) AS id, round(score, 7) AS score FROM ppr")
def pagerank_personalized(spark, d):
    return _ppr(spark, d).select("id", F.round("score", 7).alias("score"))


@query(_ppr_sql("", SEEDS) + ", b AS (SELECT c_nationkey AS id, round(max(score), 12) AS raw FROM ppr JOIN customer ON c_custkey = id GROUP BY 1) SELECT id, round(raw / max(raw) OVER (), 6) AS score, CAST(row_number() OVER (ORDER BY raw DESC, id) AS INTEGER) AS rank FROM b ORDER BY raw DESC, id LIMIT 10")
def ppr_ranked_chunks(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("chunk_id"))
    return graph.ranked_chunks(_ppr(spark, d), c, 10).withColumn("score", F.round("score", 6))


@query(_ppr_sql(f"reach(id, depth) AS (SELECT 10000007, 0 UNION SELECT e.src, depth + 1 FROM reach JOIN {CALLS} e ON e.dst = reach.id WHERE depth < 2), ", "(SELECT id FROM reach WHERE depth > 0)") + " SELECT CAST(id AS BIGINT) AS id, CAST(min(depth) AS INTEGER) AS depth, round(coalesce(max(score), 0), 7) AS ppr_relevance FROM reach LEFT JOIN ppr USING (id) WHERE depth > 0 GROUP BY id")
def impact_ranked(spark, d):
    """What a change of one symbol can reach, with the PageRank that restarts at all of it, behind the sparse gate."""
    with adjacency.held(_calls(spark, d)) as one:
        down = _contains(spark, d).select(F.col("src").alias("parent"), F.col("dst").alias("child"))
        hit = graph.cut(graph.impact(_symbols(spark, d), _named(one, _symbols(spark, d)), down, "Supplier#000000007", 2).select("id", "depth"))
        both = _both_ways(one)
        if graph.sparse_gate(both, symmetric=True, unique=True).first().sparse:
            return hit.withColumn("ppr_relevance", F.lit(None).cast("double"))
        scores = graph.personalized_pagerank(both, hit, tolerance=TOLERANCE)
    return hit.join(scores, "id", "left").select("id", "depth", F.round(F.coalesce("score", F.lit(0.0)), 7).alias("ppr_relevance"))


@query(f"SELECT src, count(*) AS out_edges, CAST(count(*) AS DOUBLE) AS out_weight FROM {CALLS} GROUP BY src")
def degree_density(spark, d):
    return graph.degree(_calls(spark, d))


@query("SELECT o_orderkey AS id, o_custkey AS file_id FROM orders WHERE o_custkey = 4 AND extract('dayofyear' FROM o_orderdate) <= 200 AND extract('dayofyear' FROM o_orderdate) + 150 >= 200")
def ancestor_range(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.dayofyear("o_orderdate").alias("line"))
    return relations.ancestors(o.withColumn("end_line", F.col("line") + 150), 4, 200).select("id", "file_id")


@query("""SELECT a.o_orderkey AS id, string_agg(CAST(b.o_orderkey AS VARCHAR), ',' ORDER BY b.o_orderkey) AS symbol_ids
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND extract('dayofyear' FROM b.o_orderdate) BETWEEN extract('dayofyear' FROM a.o_orderdate) AND extract('dayofyear' FROM a.o_orderdate) + 30 GROUP BY 1""")
def symbols_in_chunks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.dayofyear("o_orderdate").alias("line"))
    chunks = o.select("id", "file_id", F.col("line").alias("start_line"), (F.col("line") + 30).alias("end_line"))
    return relations.symbols_in_chunks(chunks, o).select("id", F.array_join(F.col("symbol_ids").cast("array<string>"), ",").alias("symbol_ids"))


@query("SELECT n_name AS name FROM nation WHERE n_nationkey IN (1, 2) OR n_regionkey = 3")
def scope_filter(spark, d):
    projects = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("c"), F.col("n_regionkey")).alias("collection"))
    sessions = spark.createDataFrame([("s1", "collection", ["NATION_1", "NATION_2"], ["c3"])], "session_id string, level string, projects array<string>, collections array<string>")
    return relations.allowed_projects(sessions, projects, "s1").select("name")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 30 MINUTE >= TIMESTAMP '2000-06-01 00:00:00'")
def session_expiry(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES")).alias("valid_until"))
    return relations.live_sessions(o, F.lit("2000-06-01 00:00:00").cast(o.schema["valid_until"].dataType)).select("id")


@query("SELECT r_name AS collection, count(*) AS members, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def collection_members(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.groupBy(F.col("r_name").alias("collection")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


SNAP = "old AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 < 8), new AS (SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 10 > 0)"


@query(f"WITH {SNAP} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.path = new.path WHERE old.hash IS DISTINCT FROM new.hash")
def snapshot_changes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    old = docs.filter("path % 10 < 8").select("path", F.sha2("text", 256).alias("hash"))
    new = docs.filter("path % 10 > 0").select("path", F.sha2(F.concat("text", F.when(F.col("path") % 7 == 0, "!").otherwise("")), 256).alias("hash"))
    return relations.changed(old, new)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return relations.upsert(c.withColumn("state", F.lit("old")), c.filter("id % 2 = 0").withColumn("state", F.lit("new")), ["id"])


EXT = "lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([A-Za-z0-9]+)$', 1))"


@query(f"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, {EXT} AS ext, length(url) - length(replace(url, '/', '')) AS depth, CAST(round(length(html) / 1024.0, 1) AS DOUBLE) AS kb FROM pages")
def asset_metadata(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.basename(u).alias("name"), tx.extension(u).alias("ext"), tx.depth(u).cast("long").alias("depth"), F.round(F.length("html") / 1024.0, 1).alias("kb"))


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1")
def index_stats(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT (SELECT count(*) FROM nation) AS projects, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM events) AS audits")
def status_counts(spark, d):
    one = lambda t, n: table(spark, d, t).agg(F.count("*").alias(n)).withColumn("k", F.lit(1))
    return one("nation", "projects").join(one("orders", "jobs"), "k").join(one("events", "audits"), "k").drop("k")


@query("SELECT event_id AS id, user_id AS agent, ts AS at FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_recent(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("agent"), F.col("ts").alias("at"))
    return relations.recent_audit(e, 20, 8)


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS solid FROM documents")
def solid_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.solid_chars(F.col("text")).cast("long").alias("solid"))


@query("SELECT DISTINCT user_id AS file, 'e' || event_type AS src, 'e' || CAST(floor(value) AS INTEGER) % 3 AS dst, 'calls' AS type FROM events WHERE CAST(floor(value) AS INTEGER) % 3 < 2")
def build_edges(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), F.concat(F.lit("e"), "event_type").alias("from_name"), F.concat(F.lit("e"), (F.floor("value") % 3).cast("string")).alias("to_name"), F.lit("calls").alias("kind"))
    files = e.select("file").distinct().select("file", F.explode(F.array(F.lit("e0"), F.lit("e1"))).alias("name"), F.lit("").alias("scope"))
    return graph.build_edges(e, files)


SCOPES = """
WITH s AS (SELECT l_orderkey AS f, l_linenumber AS line, l_linenumber + CAST(l_quantity AS INT) % 3 AS stop, 'p' || l_partkey AS name,
  CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'method' ELSE 'import' END AS kind, CASE WHEN l_linestatus = 'O' THEN 's' || l_suppkey ELSE '' END AS scope FROM lineitem),
c AS (SELECT o_orderkey AS id, 1 + o_custkey % 4 AS a FROM orders),
m AS (SELECT id, count(f) AS n, arg_min(name, (line, line - stop, name)) FILTER (kind = 'class') AS of, arg_min(name, (line, line - stop, name)) FILTER (kind = 'method') AS method,
  arg_min(scope, (line, line - stop, name)) FILTER (kind = 'method') AS scope FROM c LEFT JOIN s ON f = id AND line <= a + 1 AND stop >= a GROUP BY id),
w AS (SELECT id, n, concat_ws(', ', coalesce(of, nullif(scope, '')) || ' class', method || ' method') AS words FROM m)
SELECT id, CASE WHEN n = 0 THEN '' WHEN words = '' THEN id || '.py: ' ELSE words || ' in ' || id || '.py: ' END AS prefix FROM w"""


@query(SCOPES)
def scope_prefixes(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    kind = F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "method").otherwise("import")
    symbols = items.select(
        F.col("l_orderkey").alias("file_id"), F.concat(F.lit("p"), "l_partkey").alias("name"), kind.alias("kind"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("s"), "l_suppkey")).otherwise("").alias("scope"),
        F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end_line"),
    )
    start = 1 + F.col("o_custkey") % 4
    chunks = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("file_id"), F.concat(F.lit("src/"), "o_orderkey", F.lit(".py")).alias("path"), start.alias("start_line"), (start + 1).alias("end_line"))
    return relations.scope_prefix(chunks, symbols)
