"""Symbols, references, events, federation and the control plane as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx
from lodestone.functions.text import glob_to_like

REGISTERS, FIRES = "registers_on", "fires"
LEVELS = ["project", "collection", "global"]


# Symbols and references


def lookup_symbols(symbols: DataFrame, query: str, kind: str | None = None, language: str | None = None, path_glob: str | None = None, project: int | None = None) -> DataFrame:
    """Symbols by exact name, or by glob if the query has ``*``; if no name is equal, by ``*query*``.

    The fall-back needs no action: both kinds of match are computed and partial ones stay
    only if no exact one exists.
    """
    rows = symbols
    for name, value in (("kind", kind), ("language", language), ("project_id", project)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if path_glob is not None:
        rows = rows.filter(F.col("path").ilike(glob_to_like(path_glob)))
    if "*" in query:
        return rows.filter(F.col("name").ilike(glob_to_like(query)))
    near = rows.filter(F.col("name").ilike(f"%{query}%")).withColumn("exact", F.col("name") == query)
    any_exact = near.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("some")).withColumn("one", F.lit(1))
    return near.withColumn("one", F.lit(1)).join(any_exact, "one").filter(F.col("exact") | ~F.col("some")).drop("exact", "some", "one")


def ancestors(symbols: DataFrame, file_id: int, line: int) -> DataFrame:
    """Symbols of a file around a line, outermost first; open-ended ones never match."""
    return symbols.filter((F.col("file_id") == file_id) & (F.col("line") <= line) & (F.col("end_line") >= line)).orderBy("line", F.desc("end_line"), "id")


def symbols_in_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk id and the ordered ids of the symbols that start inside its lines (equi-join plus range)."""
    s = symbols.select(F.col("id").alias("sid"), F.col("file_id").alias("sf"), "line")
    met = chunks.join(s, (F.col("file_id") == F.col("sf")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("id").agg(F.array_sort(F.collect_list("sid")).alias("symbol_ids"))


def scope_prefix(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk id and the words that tell a model where the chunk stands: ``X class, m method in file: ``.

    chunks: id, file_id, path, start_line, end_line; symbols: file_id, name, kind, scope,
    line, end_line (null: one line). The first class and the first function or method whose
    lines overlap the chunk's are named, the method's own class if no class overlaps; a chunk
    that only other symbols overlap gets the file's name, a chunk without any an empty prefix.
    """
    s = symbols.filter("kind <> 'module'").select(F.col("file_id").alias("sf"), "name", "kind", "scope", "line", F.coalesce("end_line", "line").alias("stop"))
    own = chunks.select("id", "file_id", "path", "start_line", "end_line")
    met = own.join(s, (F.col("file_id") == F.col("sf")) & (F.col("line") <= F.col("end_line")) & (F.col("stop") >= F.col("start_line")), "left")
    at = F.struct("line", (F.col("line") - F.col("stop")).alias("span"), "name")
    is_class, is_method = F.col("kind") == "class", F.col("kind").isin("method", "function")
    first = lambda what, which: F.min_by(F.when(which, F.col(what)), F.when(which, at))
    found = met.groupBy("id").agg(F.first("path").alias("path"), F.count("sf").alias("n"), first("name", is_class).alias("of"), first("name", is_method).alias("method"), first("scope", is_method).alias("scope"))
    owner = F.coalesce("of", F.when(F.col("scope") != "", F.col("scope")))
    words = F.concat_ws(", ", F.concat(owner, F.lit(" class")), F.concat(F.col("method"), F.lit(" method")))
    file = F.concat(tx.basename(F.col("path")), F.lit(": "))
    return found.select("id", F.when(F.col("n") == 0, "").when(words == "", file).otherwise(F.concat(words, F.lit(" in "), file)).alias("prefix"))


def symbol_chunks(chunks: DataFrame) -> DataFrame:
    """symbol_id, chunk_id from JSON id lists; bad JSON and nulls are skipped."""
    ids = F.from_json("symbol_ids", "array<bigint>")
    return chunks.select(F.col("id").alias("chunk_id"), F.explode(ids).alias("symbol_id")).filter("symbol_id is not null")


def callers(refs: DataFrame, symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Distinct symbols that refer to ``name`` by resolved id or by name: two semi-joins, united."""
    r = refs if kind is None else refs.filter(F.col("kind") == kind)
    target = symbols.filter(F.col("name") == name).select(F.col("id").alias("to_id"))
    sources = r.join(target, "to_id", "left_semi").select("from_id").unionByName(r.filter(F.col("to_name") == name).select("from_id"))
    return symbols.join(sources.distinct().withColumnRenamed("from_id", "id"), "id", "left_semi")


def refs_of(refs: DataFrame, symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """References that start at a symbol of that name, by line."""
    own = symbols.filter(F.col("name") == name).select(F.col("id").alias("from_id"))
    rows = refs.join(own, "from_id", "left_semi")
    return (rows if kind is None else rows.filter(F.col("kind") == kind)).orderBy("line")


def caller_refs(refs: DataFrame) -> DataFrame:
    """The reverse index as a plain view: unresolved targets have id 0."""
    return refs.select(F.coalesce("to_id", F.lit(0)).alias("to_id"), "to_name", "from_id", "ref_id", "kind")


def file_context(symbols: DataFrame, refs: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Symbols of a file by line and the references that start in it, one row each; the first project that has the path counts."""
    file = files.filter(F.col("path") == path).orderBy("project_id", "id").limit(1).select(F.col("id").alias("file_id"))
    own = symbols.join(file, "file_id", "left_semi")
    out = refs.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return own.select(F.lit("symbol").alias("what"), "name", "kind", "line").unionByName(out.select(F.lit("reference").alias("what"), F.col("to_name").alias("name"), "kind", "line")).orderBy(F.desc("what"), "line", "name")


# Events


def list_events(events: DataFrame, name: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Events by name (a pattern if it holds % or _) and kind."""
    rows = events.filter(F.col("kind").isin(kinds or [REGISTERS, FIRES]))
    if name is not None:
        rows = rows.filter(F.col("name").ilike(name) if "%" in name or "_" in name else F.col("name") == name)
    return rows


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 0) -> DataFrame:
    """A page of ordered rows; limit 0 is unlimited."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def event_mismatches(events: DataFrame) -> DataFrame:
    """name, registrations, fires and status of each event."""
    counts = events.groupBy("name").agg(F.count_if(F.col("kind") == REGISTERS).alias("registrations"), F.count_if(F.col("kind") == FIRES).alias("fires"))
    status = F.when(F.col("fires") == 0, "ORPHANED_LISTENER").when(F.col("registrations") == 0, "UNFIRED_EVENT").otherwise("healthy")
    return counts.withColumn("status", status)


def event_summary(events: DataFrame) -> DataFrame:
    m = event_mismatches(events)
    c = lambda s: F.count_if(F.col("status") == s)
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "healthy").alias("mismatches"), c("ORPHANED_LISTENER").alias("orphaned"), c("UNFIRED_EVENT").alias("unfired"), c("healthy").alias("healthy"))


# Federation


def cross_refs(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses of a name in other projects than one that defines it: name, def_project, use_project, uses."""
    d = definitions.select("name", F.col("project").alias("def_project")).distinct()
    u = uses.groupBy("name", F.col("project").alias("use_project")).agg(F.count("*").alias("uses"))
    return d.join(u, "name").filter("def_project <> use_project")


def project_map(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Edges between projects: from (uses), to (defines), number of references and of distinct names."""
    x = cross_refs(definitions, uses)
    return x.groupBy(F.col("use_project").alias("from_project"), F.col("def_project").alias("to_project")).agg(F.sum("uses").alias("refs"), F.count("*").alias("names"))


# Control plane


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def changed(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """path and change (added, modified, deleted) between two snapshots."""
    o, n = old.select(F.col(key).alias("k"), F.col(digest).alias("a")), new.select(F.col(key).alias("k"), F.col(digest).alias("b"))
    full = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), "k", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return full.select(F.col("k").alias(key), change.alias("change")).filter("change is not null")


def delete_files(files: DataFrame, gone: DataFrame, symbols: DataFrame, refs: DataFrame, edges: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Remove files with all that hangs on them; other files' references to them become unresolved."""
    ids = files.join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    dead = symbols.join(ids, "file_id", "left_semi").select("id")
    own = refs.join(dead.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    marked = own.join(dead.select(F.col("id").alias("to_id"), F.lit(True).alias("lost")), "to_id", "left")
    kept = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return {
        "files": files.join(gone.select("path"), "path", "left_anti"),
        "symbols": symbols.join(ids, "file_id", "left_anti"),
        "refs": marked.withColumn("to_id", F.when(F.col("lost").isNull(), F.col("to_id"))).drop("lost").select(*refs.columns),
        "edges": kept.select(*edges.columns),
        "chunks": chunks.join(ids, "file_id", "left_anti"),
    }


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("valid_until") >= now)


def allowed_projects(sessions: DataFrame, projects: DataFrame, session_id: str) -> DataFrame:
    """The projects a session may see: all for level global, else those named or in its collections; denied by default."""
    s = sessions.filter(F.col("session_id") == session_id)
    named = s.select(F.explode("projects").alias("name"))
    shelves = s.filter(F.col("level") != "project").select(F.explode("collections").alias("collection"))
    world = s.filter(F.col("level") == "global").select(F.lit(1).alias("one"))
    everything = projects.withColumn("one", F.lit(1)).join(world, "one", "left_semi").drop("one")
    return projects.join(named, "name", "left_semi").unionByName(projects.join(shelves, "collection", "left_semi")).unionByName(everything).distinct()


def recent_audit(audit: DataFrame, limit: int, agent: str | None = None) -> DataFrame:
    rows = audit if agent is None else audit.filter(F.col("agent") == agent)
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def stratified(rows: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """Round-robin sample: first rows of all groups, then second ones ... until there are n."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("round", r).filter(F.col("round") <= n).orderBy("round", group).limit(n)


# Evaluation


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query: reciprocal rank, NDCG@k (binary), hit@1/3/5/k. ranked: query_id, id, rank; relevant: query_id, id."""
    rel = relevant.select("query_id", "id").distinct()
    hits = ranked.filter(F.col("rank") <= k).join(rel.withColumn("good", F.lit(1)), ["query_id", "id"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    return _measures(hits, rel.groupBy("query_id").agg(F.count("*").alias("n_relevant")), k)


def label_metrics(ranked: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """The same where a row is relevant to the queries of its label: queries meet a count by label, never all rows of it.

    ranked: query_id, id, rank; labels: id, label, of the queries as well. Labels of null are relevant to nothing.
    """
    known = labels.select("id", "label").filter("label is not null").distinct()
    asked = ranked.filter(F.col("rank") <= k)
    own = asked.select("query_id").distinct().join(known.withColumnRenamed("id", "query_id"), "query_id")
    totals = own.join(known.groupBy("label").agg(F.count("*").alias("n")), "label").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))
    met = asked.join(known, "id").join(own, ["query_id", "label"], "left_semi").select("query_id", "id").distinct()
    hits = asked.join(met.withColumn("good", F.lit(1)), ["query_id", "id"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    return _measures(hits, totals, k)


def _measures(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    per = hits.groupBy("query_id").agg(F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.sum(F.col("good") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    hit = lambda n: F.coalesce((F.col("first") <= n).cast("int"), F.lit(0))
    return per.join(totals, "query_id").select("query_id", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg"), hit(1).alias("top1"), hit(3).alias("top3"), hit(5).alias("top5"), hit(k).alias("topk"))


MEASURES = ["rr", "ndcg", "top1", "top3", "top5", "topk"]


def mean_metrics(per_query: DataFrame, categories: DataFrame) -> DataFrame:
    """category, queries and the means of all measures, with a row of category null for the blend of all queries.

    per_query: query_id and measures, as of ``retrieval_metrics``; categories: query_id, category.
    """
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in MEASURES]
    named = per_query.join(categories, "query_id")
    return named.rollup("category").agg(F.count("*").alias("queries"), F.grouping("category").alias("__all"), *means).withColumn("category", F.when(F.col("__all") == 0, F.col("category"))).drop("__all")


def blended_metrics(per_query: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: categories, and each measure's mean over the categories' means, in which every category weighs alike."""
    means = mean_metrics(per_query, categories).filter("category is not null")
    return means.agg(F.count("*").alias("categories"), *[F.avg(m).alias(m) for m in MEASURES])


def symbol_projects(symbols: DataFrame) -> DataFrame:
    """name, definitions and the sorted projects that define it."""
    return symbols.filter("name <> ''").groupBy("name").agg(F.count("*").alias("definitions"), F.array_sort(F.collect_set("project")).alias("projects"))


def event_sites(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Event references with the symbol that makes them and, where known, its file.

    refs: event_id, from_id, kind; symbols: id, name, file_id; files: file_id, path.
    """
    made = refs.join(symbols.select(F.col("id").alias("from_id"), F.col("name").alias("symbol"), "file_id"), "from_id")
    return made.join(files.select("file_id", "path"), "file_id", "left").select("event_id", "kind", "symbol", "path")


def column_means(vectors: DataFrame, vec_col: str) -> DataFrame:
    return vectors.select(F.posexplode(vec_col).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cross_covariance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """i, j, value of the centred cross-covariance sum of two vector columns: d x d rows.

    Sums of products are centred afterwards, so one pass over the pairs is enough. A task
    multiplies the matrices of each batch and hands on one row of sums for each pair of
    lengths, so no row is made for a product. Null vectors and elements count for nothing.
    """
    import pyarrow as pa

    def sums(batches):
        import numpy as np

        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            sides = [[None if v is None else np.array([x or 0.0 for x in v] if None in v else v, float) for v in batch.column(k).to_pylist()] for k in (0, 1)]
            groups: dict[tuple[int, int], list[int]] = {}
            for r, (x, y) in enumerate(zip(*sides, strict=True)):
                if x is not None and y is not None and len(x) and len(y):
                    groups.setdefault((len(x), len(y)), []).append(r)
            for shape, rows in groups.items():
                x, y = (np.stack([side[r] for r in rows]) for side in sides)
                got = [x.T @ y, np.repeat(x.sum(0)[:, None], shape[1], 1), np.repeat(y.sum(0)[None, :], shape[0], 0), np.full(shape, len(rows))]
                total[shape] = [p + q for p, q in zip(total[shape], got, strict=True)] if shape in total else got
        for (m, n), parts in total.items():
            i, j = (v.ravel() for v in np.indices((m, n)))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v.ravel(), pa.float64()) for v in parts]], names=["i", "j", "xy", "x", "y", "n"])

    d = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(sums, "i int, j int, xy double, x double, y double, n double")
    return d.groupBy("i", "j").agg((F.sum("xy") - F.sum("x") * F.sum("y") / F.sum("n")).alias("value"))


def drift_rotation(pairs: DataFrame, old: str, new: str, dims: int):
    """The rotation R with new @ R close to old (orthogonal Procrustes): d x d sums by Spark, SVD on the driver."""
    import numpy as np

    m = np.zeros((dims, dims))
    for r in cross_covariance(pairs, new, old).collect():  # dims squared rows
        m[r.i, r.j] = r.value
    u, _, vt = np.linalg.svd(m)
    return u @ vt
