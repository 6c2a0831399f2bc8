"""Dependency-graph analytics as joins and aggregations.

Edges are (src, dst[, weight, type]). Loops have a fixed or bounded number of rounds and
write their edges once. PageRank and components read them as neighbour lists and keep one
value a node on the driver, up to ``adjacency.NODES`` nodes; beyond, and where ids are no
whole numbers, they join, and cut their plans by reliable checkpoints. Searches by breadth
scan the edges against a frontier that is broadcast while it is small.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.text import last_segment
from lodestone.operators import adjacency

MAX_DEPTH = 10
ALPHA, ROUNDS, KEEP_ABOVE = 0.15, 50, 1e-10
MIN_NODES, MIN_DENSITY, MIN_CONNECTED = 100, 0.75, 0.5
#: Rows of a frontier that is broadcast; rows that a task sorts and groups.
FRONTIER, PART_ROWS = 500_000, 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only on a single machine, where that is unset, a temporary folder is taken.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not known:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            known = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(known)
    return df.checkpoint()


def parts(table: DataFrame) -> int:
    """Partitions of about ``PART_ROWS`` rows of a stored table, whose files tell their number."""
    return max(1, -(-table.count() // PART_ROWS))


def load(edges: DataFrame, nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges with both ends known, weights of 0 or null taken as 1, parallel edges added up."""
    if partitions:
        edges = edges.repartition(partitions, "dst")
    w = F.when(F.coalesce(F.col("weight"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    known = nodes.select(F.col("id").alias("src")).distinct()
    # Grouped as dealt for the first join; the second one moves the sums.
    sums = edges.join(known.withColumnRenamed("src", "dst"), "dst", "left_semi").groupBy("src", "dst").agg(F.sum(w).alias("weight"))
    return sums.join(known, "src", "left_semi").select("src", "dst", "weight")


def _whole(df: DataFrame, *columns: str) -> bool:
    return all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for c in columns)


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_edges"), F.sum("weight").alias("out_weight"))


def personalized_pagerank(edges: DataFrame, seeds: Sequence[int] | DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, tolerance: float | None = None) -> DataFrame:
    """id and score after ``rounds`` steps p = (1 - alpha) A' p + alpha s.

    Rows of A are normalised by weighted out-degree; what reaches a node without out-edges
    is lost. Each distinct seed (a list, or a column id) gets 1 / count, seeds without edges
    included in the count. With a tolerance the loop ends once the L2 change is below it
    (an action a round).
    """
    spark = edges.sparkSession
    if isinstance(seeds, DataFrame):
        start = cut(seeds.select(F.col("id").cast("long")).distinct())
        n = start.count()
    else:
        n = len(seeds := sorted(set(seeds)))
        start = spark.createDataFrame([(s,) for s in seeds], "id bigint")
    if not n:
        return spark.createDataFrame([], "id bigint, score double")
    if n <= adjacency.NODES and _whole(edges, "src", "dst"):
        got = adjacency.pagerank(edges, adjacency.numbers(start.filter("id is not null"))[0], 1.0 / n, rounds, alpha, tolerance)
        if got is not None:
            ids, p = got
            return adjacency.frame(spark, "id bigint, score double", [ids[p > KEEP_ABOVE], p[p > KEEP_ABOVE]])
    return _pagerank_by_joins(edges, start.withColumn("score", F.lit(1.0 / n)), rounds, alpha, tolerance)


def _pagerank_by_joins(edges: DataFrame, start: DataFrame, rounds: int, alpha: float, tolerance: float | None) -> DataFrame:
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).repartition("src"))
    p = start
    for i in range(rounds):
        flow = steps.join(p, steps.src == p.id).select(F.col("dst").alias("id"), (F.col("share") * F.col("score") * (1 - alpha)).alias("score"))
        new = flow.unionByName(start.withColumn("score", F.col("score") * alpha)).groupBy("id").agg(F.sum("score").alias("score"))
        if tolerance is not None or i % 4 == 3:
            new = cut(new)
        if tolerance is not None:
            diff = new.unionByName(p.withColumn("score", -F.col("score"))).groupBy("id").agg(F.sum("score").alias("d")).agg(F.sqrt(F.sum(F.col("d") * F.col("d")))).first()[0]
            p = new
            if diff < tolerance:
                break
        p = new
    return p.filter(F.col("score") > KEEP_ABOVE)


def ranked_chunks(scores: DataFrame, symbol_chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks by the largest score of their symbols, scaled to a maximum of 1: id, score, rank.

    Scores equal to 12 digits tie, whatever the order in which parts were added up.
    """
    best = scores.join(symbol_chunks.withColumnRenamed("symbol_id", "id"), "id").groupBy("chunk_id").agg(F.round(F.max("score"), 12).alias("raw"))
    top = best.orderBy(F.desc("raw"), "chunk_id").limit(limit)
    w = Window.orderBy(F.desc("raw"), "chunk_id")
    return top.select(F.col("chunk_id").alias("id"), (F.col("raw") / F.max("raw").over(Window.partitionBy())).alias("score"), F.row_number().over(w).alias("rank"))


def components(edges: DataFrame, nodes: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """id and component (smallest id reachable, direction ignored); ``symmetric``: every edge is there both ways."""
    kind = edges.schema["src"].dataType
    ends = [edges.select(F.col(a).alias("a"), F.coalesce(b, a).alias("b")) for a, b in (("src", "dst"), ("dst", "src"))[: 1 if symmetric else 2]]
    both = (ends[0] if symmetric else ends[0].unionByName(ends[1])).filter("a is not null")
    if _whole(edges, "src", "dst") and (nodes is None or _whole(nodes, "id")):
        alone = None if nodes is None else nodes.select(F.col("id").cast("long")).filter("id is not null").distinct()
        if alone is None or alone.count() <= adjacency.NODES:
            got = adjacency.components(both, adjacency.numbers(alone)[0] if alone is not None else adjacency.np.empty(0, "int64"))
            if got is not None:
                return adjacency.frame(edges.sparkSession, "id bigint, component bigint", list(got)).select(*[F.col(c).cast(kind) for c in ("id", "component")])
    return _components_by_joins(both, nodes)


def _components_by_joins(both: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Labels fall to the smallest neighbour's and jump to their label's label, so that the
    rounds grow with the logarithm of a component's diameter.
    """
    both = cut(both.distinct())
    ids = both.select(F.col("a").alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id"))
    labels = ids.distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        jump = low.join(labels.select(F.col("id").alias("mid"), F.col("component").alias("next")), "mid")
        step = cut(jump.select("id", "old", F.least("mid", "next").alias("component")))
        labels = step.select("id", "component")
        if step.filter(F.col("component") < F.col("old")).isEmpty():
            return labels


def sparse_gate(edges: DataFrame, nodes: DataFrame | None = None, symmetric: bool = False, unique: bool = False) -> DataFrame:
    """One row: nodes, distinct edges, density, share of the largest component and the verdict.

    Without ``nodes`` the ends of the edges count. ``symmetric``: every edge is there both ways; ``unique``: no edge is there twice, so a plain count tells their number.
    """
    sizes = components(edges, nodes, symmetric).groupBy("component").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.sum("n").alias("nodes"), F.max("n").alias("largest"))
    pairs = edges.select("src", "dst")
    lines = (pairs if unique else pairs.distinct()).agg(F.count("*").alias("edges"))
    one = shape.withColumn("k", F.lit(1)).join(lines.withColumn("k", F.lit(1)), "k").drop("k")
    density, share = F.col("edges") / F.col("nodes"), F.col("largest") / F.col("nodes")
    return one.select("nodes", "edges", density.alias("density"), share.alias("largest_share"), ((F.col("nodes") < MIN_NODES) | (density < MIN_DENSITY) | (share < MIN_CONNECTED)).alias("sparse"))


def _small(frontier: DataFrame) -> DataFrame:
    """Broadcast if its rows, which are at hand, are few: the edges are then scanned and not shuffled."""
    return F.broadcast(frontier) if frontier.count() <= FRONTIER else frontier


def _breadth(seeds: DataFrame, depth: int, step) -> DataFrame:
    """id and depth of what ``step``, from a frontier's id to the next ids, reaches from the seeds."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = cut(step(_small(frontier.select("id"))).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def forward_bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id and depth (least number of hops, at most ``MAX_DEPTH``) of what the seeds reach, without them."""
    with adjacency.held(edges.select("src", "dst")) as hops:
        return _breadth(seeds, depth, lambda at: hops.join(at.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")))


def forward_bfs_named(refs: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The same over references: to the resolved symbol, and where there is none, to every symbol of that name.

    refs: from_id, to_id (null if unresolved), to_name; symbols: id, name. Names are looked up
    for what a frontier asks for only, each once.
    """
    named = symbols.filter("name <> ''").select("name", "id")
    with adjacency.held(refs.select("from_id", "to_id", F.when(F.col("to_id").isNull(), F.col("to_name")).alias("name"))) as hops:

        def step(at: DataFrame) -> DataFrame:
            met = cut(hops.join(at.withColumnRenamed("id", "from_id"), "from_id").select("to_id", "name").distinct())
            names = _small(cut(met.filter("to_id is null").select("name").distinct()))
            return met.filter("to_id is not null").select(F.col("to_id").alias("id")).unionByName(named.join(names, "name").select("id"))

        return _breadth(seeds, depth, step)


def impact(symbols: DataFrame, refs: DataFrame, contains: DataFrame, name: str, depth: int, include_types: bool = True) -> DataFrame:
    """Symbols that a change of ``name`` can reach: callers by id or by name, and contained children.

    symbols: id, name; refs: from_id, to_id (null if unresolved), to_name, kind; contains:
    parent, child. The two ways to be a caller are two equi-joins united, as one join on
    either condition would compare all pairs. Seeds are left out.
    """
    calls = refs if include_types else refs.filter("kind <> 'type_reference'")
    down = contains.select(F.col("parent").alias("id"), F.col("child").alias("next"))
    own = symbols.select("id", "name")
    seen = cut(own.filter(F.col("name") == name).withColumn("depth", F.lit(0)))
    frontier = seen
    with adjacency.held(calls.select("to_id", "to_name", F.col("from_id").alias("next"))) as used, adjacency.held(down) as inside:
        for d in range(1, min(depth, MAX_DEPTH) + 1):
            ids, names = _small(frontier.select("id")), _small(cut(frontier.select("name").distinct()))
            nxt = used.join(ids, used.to_id == ids.id).select("next").unionByName(inside.join(ids, "id").select("next")).unionByName(used.join(names, used.to_name == names.name).select("next"))
            new = cut(nxt.select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"))
            frontier = cut(own.join(_small(new), "id").withColumn("depth", F.lit(d)))
            seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


KIND_ORDER = ["function", "class", "method"]


def _folders(path: Column) -> Column:
    """All leading folder paths of a path, from none to all, file name left out."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _nearest(refs: DataFrame, defs: DataFrame, tier: str) -> DataFrame:
    """ref_id, symbol_id, tier by key: the only best definition, or the only nearest of several.

    References meet counts of definitions by key and leading folders, never the definitions
    themselves, so a name with very many definitions and uses costs no product of the two.
    """
    top = defs.groupBy("key").agg(F.min("p").alias("top"))
    best = defs.join(top, "key").filter("p = top")
    held = best.select("key", "symbol_id", F.posexplode(_folders(F.col("path"))).alias("level", "folder"))
    table = held.groupBy("key", "level", "folder").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id"))
    asked = refs.select("ref_id", "key", F.posexplode(_folders(F.col("path"))).alias("level", "folder"))
    met = asked.join(table, ["key", "level", "folder"])
    near = met.groupBy("ref_id").agg(F.max_by(F.struct("n", "symbol_id"), "level").alias("x"), F.max(F.when(F.col("level") == 0, F.col("n"))).alias("all"))
    return near.filter("x.n = 1").select("ref_id", "x.symbol_id", F.when(F.col("all") == 1, tier).otherwise("proximity").alias("tier"))


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Link unresolved references to definitions: ref_id, symbol_id, tier.

    refs: ref_id, name, path; symbols: id, name, kind, path. A reference takes the exact
    name's definitions or, if there are none, those equal after the last dot or backslash.
    Of them the best kind counts (function, class, method, others). A single one is taken
    (``strict`` or ``suffix``); of several, the one that shares the most leading folders,
    if it shares strictly more than the next (``proximity``).
    """
    priority = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    defs = symbols.select(F.col("id").alias("symbol_id"), "name", "path", priority.alias("p"))
    exact = _nearest(refs.withColumn("key", F.col("name")), defs.withColumn("key", F.col("name")), "strict")
    loose = refs.join(defs.select("name").distinct(), "name", "left_anti")
    tails = defs.withColumn("key", last_segment(F.col("name"))).filter("key <> ''")
    return exact.unionByName(_nearest(loose.withColumn("key", last_segment(F.col("name"))), tails, "suffix"))


def resolution_counters(refs: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: how many references were open, resolved by each tier, dropped as ambiguous or without a candidate.

    refs: ref_id, from_id, name; symbols: id, name; resolved: the result of ``resolve``.
    edges_created counts distinct pairs of a reference's symbol and its target.
    """
    names = symbols.select("name").distinct()
    tails = symbols.select(last_segment(F.col("name")).alias("tail")).filter("tail <> ''").distinct()
    exact = refs.join(names.withColumn("exact", F.lit(True)), "name", "left")
    known = exact.withColumn("tail", last_segment(F.col("name"))).join(tails.withColumn("loose", F.lit(True)), "tail", "left")
    all_ = known.join(resolved, "ref_id", "left")
    has = F.coalesce("exact", F.lit(False)) | F.coalesce("loose", F.lit(False))
    tiers = [F.count_if(F.col("tier") == t).alias(f"resolved_{t}") for t in ("strict", "proximity", "suffix")]
    rest = [F.count_if(F.col("tier").isNull() & has).alias("ambiguous_dropped"), F.count_if(F.col("tier").isNull() & ~has).alias("no_candidate")]
    return all_.agg(F.count("*").alias("total_unresolved"), *tiers, *rest, F.count_distinct("from_id", "symbol_id").alias("edges_created"))


def build_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, type of each file: references whose target is a symbol of the file, and containment."""
    s = symbols.filter("name <> ''")
    targets = s.select("file", F.col("name").alias("to_name")).distinct()
    calls = refs.join(targets, ["file", "to_name"], "left_semi").select("file", F.col("from_name").alias("src"), F.col("to_name").alias("dst"), F.col("kind").alias("type"))
    inner = s.filter("scope <> ''").select("file", F.col("scope").alias("src"), F.col("name").alias("dst"), F.lit("contains").alias("type"))
    return calls.unionByName(inner).dropDuplicates(["file", "src", "dst", "type"])

