"""The engine: indexing and the nineteen tools, over versioned tables.

Each tool returns a DataFrame; only bounded control rows (projects of a session, seeds of
a walk) come to the driver.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx
from lodestone.operators import chunkers, drift, extract, fts, fusion, grammar, graph, models, postings, relations, snippets
from lodestone.operators.tables import flat_map
from lodestone.sources import discovery, sinks
from lodestone.sources.store import Store

DOCUMENT_TYPES = ["markdown", "pdf", "yaml", "json", "html", "xml", "text", "txt", "rst", "csv", "tsv", "log", "ini", "cfg", "toml", "conf"]
PPR_TOLERANCE = 1e-6
MANIFESTS = ["package.json", "composer.json", "pyproject.toml"]
SESSION_MINUTES = 30
Hook = Callable[[DataFrame], DataFrame]


def parser_digest() -> str:
    """Changes with the code that reads files, so an index made by older code can be told."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in (extract, grammar, chunkers, discovery)).encode()).hexdigest()[:16]


class AccessError(PermissionError):
    """The session is unknown, has expired or may not use the tool."""


class Engine:
    """hooks: functions applied to the chunks before they are embedded and stored.

    The profile says how the embedder's model wants to be used: whether chunks are embedded
    with the words of their scope before them, and what keyword hits weigh.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[], models.Embedder] = models.hashed_embedder, hooks: list[Hook] | None = None, profile: str = "hashed"):
        self.spark, self.store, self.embedder, self.hooks = spark, Store(spark, root), embedder, list(hooks or [])
        found = models.resolve_profile(profile)
        if found is None:
            raise ValueError(f"unknown profile {profile}")
        self.profile = found

    # Sessions and scopes

    def _projects(self, session: str | None, level: str = "project") -> DataFrame:
        """The projects a call may see: all without a session (development), else those of the live session."""
        projects = self.store.read("projects").withColumnRenamed("project", "name")
        if session is None:
            return projects.select(F.col("name").alias("project"))
        live = relations.live_sessions(self.store.read("sessions").filter(F.col("session_id") == session), F.current_timestamp())
        row = live.limit(1).collect()
        if not row:
            raise AccessError("unknown or expired session")
        if relations.LEVELS.index(row[0].level) < relations.LEVELS.index(level):
            raise AccessError(f"needs level {level}")
        return relations.allowed_projects(live, projects, session).select(F.col("name").alias("project"))

    def _seen(self, table: str, session: str | None) -> DataFrame:
        return self.store.read(table).join(F.broadcast(self._projects(session)), "project", "left_semi")  # one row a project

    def _audit(self, tool: str, session: str | None, results: int = 0) -> None:
        rows = self.spark.createDataFrame([(uuid.uuid4().hex, session or "dev", "", tool, results)], "id string, agent string, level string, tool string, results bigint")
        sinks.append_only(rows.withColumn("at", F.current_timestamp()), f"{self.store.root}/audit_log")

    def audit_log(self, limit: int = 100, agent: str | None = None) -> DataFrame:
        return relations.recent_audit(self.spark.read.parquet(f"{self.store.root}/audit_log"), limit, agent)

    def create_scope(self, agent: str, level: str, projects: list[str] | None = None, collections: list[str] | None = None, minutes: int = SESSION_MINUTES) -> str:
        if level not in relations.LEVELS:
            raise ValueError(f"unknown level {level}")
        sid = uuid.uuid4().hex
        row = self.spark.createDataFrame([(sid, agent, level, projects or [], collections or [])], "session_id string, agent string, level string, projects array<string>, collections array<string>")
        new = row.withColumn("valid_until", F.current_timestamp() + F.make_interval(mins=F.lit(minutes)))
        live = relations.live_sessions(self.store.read("sessions"), F.current_timestamp())
        self.store.write("sessions", live.select(*new.columns).unionByName(new))
        return sid

    def revoke_scope(self, agent: str) -> None:
        self.store.write("sessions", self.store.read("sessions").filter(F.col("agent") != agent))

    # Projects and collections

    def register_project(self, project: str, path: str, collection: str | None = None) -> None:
        row = self.spark.createDataFrame([(project, path, collection)], "project string, path string, collection string").withColumn("indexed_at", F.lit(None).cast("timestamp")).withColumn("parser", F.lit(None).cast("string"))
        self.store.write("projects", relations.upsert(self.store.read("projects"), row, ["project"]))

    def create_collection(self, collection: str) -> None:
        row = self.spark.createDataFrame([(collection,)], "collection string").withColumn("created_at", F.current_timestamp())
        self.store.write("collections", relations.upsert(self.store.read("collections"), row, ["collection"]))

    def add_to_collection(self, collection: str, project: str) -> None:
        p = self.store.read("projects")
        self.store.write("projects", p.withColumn("collection", F.when(F.col("project") == project, collection).otherwise(F.col("collection"))))

    def list_collections(self) -> DataFrame:
        members = self.store.read("projects").groupBy("collection").agg(F.array_sort(F.collect_list("project")).alias("projects"))
        return self.store.read("collections").join(members, "collection", "left")

    def delete_collection(self, collection: str) -> None:
        p = self.store.read("projects")
        self.store.write("projects", p.withColumn("collection", F.when(F.col("collection") != collection, F.col("collection"))))
        self.store.write("collections", self.store.read("collections").filter(F.col("collection") != collection))

    # Indexing

    def reindex(self, project: str, full: bool = False) -> str:
        """Bring a project's tables up to date with its folder; returns the job id.

        Only added and modified files are read again (all of them if ``full``); deleted files
        take their rows along and leave others' references unresolved. Names are then resolved
        across the project. A job row tells how it went; jobs found running can be run again.
        """
        job = uuid.uuid4().hex
        self._job(job, project, "running")
        try:
            self._index(project, full, job)
        except Exception as e:
            self._job(job, project, "failed", str(e)[:500])
            raise
        self._job(job, project, "completed")
        self._audit("reindex", None)
        return job

    def _job(self, job: str, project: str, status: str, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(job, project, status, error)], "job string, project string, status string, error string")
        done = F.current_timestamp() if status != "running" else F.lit(None).cast("timestamp")
        started = self.store.read("jobs").select("job", F.col("started_at"))
        new = row.join(started, "job", "left").withColumn("started_at", F.coalesce("started_at", F.current_timestamp())).withColumn("completed_at", done)
        self.store.write("jobs", relations.upsert(self.store.read("jobs"), new.select(*self.store.read("jobs").columns), ["job"]))

    def unfinished_jobs(self) -> DataFrame:
        return self.store.read("jobs").filter("status = 'running'")

    def recover(self) -> list[str]:
        """Run the projects of unfinished jobs again, each once, and close those jobs; returns the new jobs. Call it at the start, before any job runs."""
        left = self.unfinished_jobs().select("job", "project").collect()
        for r in left:
            self._job(r.job, r.project, "failed", "interrupted")
        return [self.reindex(p) for p in sorted({r.project for r in left})]

    def stale_projects(self) -> DataFrame:
        """Projects that were indexed by other parser code than this; a full reindex brings them up to date."""
        return self.store.read("projects").filter(F.col("indexed_at").isNotNull() & ~F.col("parser").eqNullSafe(F.lit(parser_digest()))).select("project", "indexed_at")

    def _index(self, project: str, full: bool, job: str = "") -> None:
        place = self.store.read("projects").filter(F.col("project") == project).first()
        if place is None:
            raise ValueError(f"unknown project {project}")
        mine = F.col("project") == project
        # Hashes of all files are taken once; afterwards only the changed ones are opened again.
        now = graph.cut(discovery.discover(self.spark, place.path).drop("content"))
        old = self.store.read("files", project)
        full = full or place.parser is not None and place.parser != parser_digest()
        change = graph.cut(relations.changed(old, now))
        stale = old.select("path") if full else change.filter("change <> 'added'").select("path")
        changed = now.select("path") if full else change.filter("change <> 'deleted'").select("path")
        opened = [r.path for r in changed.collect()]
        fresh = discovery.discover(self.spark, place.path, only=opened).withColumn("project", F.lit(project))
        named = [r.path for r in now.filter(tx.basename(F.col("path")).isin(MANIFESTS)).select("path").collect()]
        packages = discovery.package_names(now.select("path"), discovery.manifests(discovery.discover(self.spark, place.path, only=named)))
        source = fresh.filter("route <> 'asset'").select("path", "route", discovery.source_type(F.col("path")).alias("source_type"), "language", F.col("content").cast("string").alias("text"))
        code = source.filter("route = 'code'").select(F.col("path").alias("file"), "language", F.col("text").alias("content"))
        key = lambda *c: F.xxhash64(F.lit(project), *c)

        symbols = extract.symbols_table(code).withColumnRenamed("file", "path").withColumn("project", F.lit(project)).withColumn("id", key("path", "name", "kind", "line"))
        refs = extract.refs_table(code).withColumnRenamed("file", "path").withColumn("project", F.lit(project))
        refs = refs.withColumn("ref_id", key("path", "from_name", "to_name", "kind", "line")).dropDuplicates(["ref_id"])
        owner = symbols.groupBy("path", "name").agg(F.min("id").alias("from_id"))
        refs = refs.join(owner.withColumnRenamed("name", "from_name"), ["path", "from_name"], "left").withColumn("to_id", F.lit(None).cast("bigint"))

        def cut(path, source_type, language, text):
            for n, c in enumerate(chunkers.chunk_file(path, text or "", language)):
                yield (path, n, c.content, c.start_line, c.end_line, c.heading, c.parent, c.key_path, c.kind, source_type)

        columns = "path string, chunk int, content string, start_line int, end_line int, heading string, parent string, key_path string, kind string, source_type string"
        chunks = flat_map(source, ["path", "source_type", "language", "text"], columns, cut)
        width, height = discovery.dimensions(F.col("content"))
        assets = fresh.filter(discovery.asset_class(F.col("path")).isNotNull()).select(
            "path", F.lit(-1).alias("chunk"), discovery.asset_text(F.col("path"), F.col("size"), width, height).alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
            *[F.lit("").alias(c) for c in ("heading", "parent", "key_path")], F.lit("asset").alias("kind"), F.lit("asset").alias("source_type"),
        )
        chunks = chunks.unionByName(assets).withColumn("project", F.lit(project)).withColumn("id", key("path", "chunk"))
        for hook in self.hooks:
            chunks = hook(chunks)

        touched = stale.unionByName(fresh.select("path")).distinct()
        without = lambda name: self.store.read(name, project).join(touched, "path", "left_anti")
        as_stored = lambda name, df: df.select(*self.store.read(name, project).columns)
        kept_chunks = graph.cut(without("chunks").select("id"))
        self.store.write("symbols", without("symbols").unionByName(as_stored("symbols", symbols)), project)
        self.store.write("chunks", without("chunks").unionByName(as_stored("chunks", chunks)), project)
        stored = self.store.read("chunks", project)
        keep = self.store.read("embeddings", project).join(kept_chunks, "id", "left_semi")
        fresh_chunks = stored.join(kept_chunks, "id", "left_anti")
        texts = fresh_chunks.select("id", "project", "content")
        if self.profile.scope_prefix:
            scopes = relations.scope_prefix(fresh_chunks.withColumn("file_id", F.col("path")), self.store.read("symbols", project).withColumn("file_id", F.col("path")))
            texts = texts.join(scopes, "id").withColumn("content", F.concat("prefix", "content")).drop("prefix")
        new = models.embed(texts, "content", self.embedder).drop("content")
        self.store.write("embeddings", keep.unionByName(new), project)
        self._resolve(project, without("refs").unionByName(as_stored("refs", refs)))
        files = without("files").drop("package").unionByName(fresh.select([c for c in self.store.read("files", project).columns if c != "package"]))
        self.store.write("files", files.join(packages, "path", "left"), project)
        self.store.write("projects", self.store.read("projects").withColumn("indexed_at", F.when(mine, F.current_timestamp()).otherwise(F.col("indexed_at"))).withColumn("parser", F.when(mine, parser_digest()).otherwise(F.col("parser"))))
        self._count(project, job, len(opened), now.count() - len(opened), change.filter("change = 'deleted'").count(), stored.count() - kept_chunks.count())

    def _count(self, project: str, job: str, processed: int, skipped: int, deleted: int, embedded: int) -> None:
        rows = [self.store.read(t, project).count() for t in ("symbols", "chunks")]
        row = self.spark.createDataFrame([(project, job, processed, skipped, deleted, *rows, embedded)], "project string, job string, processed bigint, skipped bigint, deleted bigint, symbols bigint, chunks bigint, embedded bigint")
        self.store.write("index_stats", self.store.read("index_stats").unionByName(row.withColumn("at", F.current_timestamp())))

    def index_statistics(self, project: str | None = None) -> DataFrame:
        """What each job read, skipped and dropped, and how many symbols, chunks and new vectors there were after it."""
        stats = self.store.read("index_stats")
        return (stats if project is None else stats.filter(F.col("project") == project)).orderBy("at")

    def _resolve(self, project: str, refs: DataFrame) -> None:
        """Targets within the file first, then across the project; edges follow from them."""
        symbols = self.store.read("symbols", project).filter((F.col("name") != "") & (F.col("kind") != "module"))
        mine = refs.drop("to_id")
        local = symbols.groupBy("path", F.col("name").alias("to_name")).agg(F.min("id").alias("local_id"))
        joined = mine.join(local, ["path", "to_name"], "left")
        is_event = F.col("kind").isin(relations.REGISTERS, relations.FIRES)
        open_ = joined.filter(F.col("local_id").isNull() & ~is_event).select("ref_id", F.col("to_name").alias("name"), "path")
        found = graph.resolve(open_, symbols.select("id", "name", "kind", "path")).select("ref_id", "symbol_id")
        done = joined.join(found, "ref_id", "left").withColumn("to_id", F.when(~is_event, F.coalesce("local_id", "symbol_id")))
        self.store.write("refs", done.select(*self.store.read("refs", project).columns), project)
        calls = self.store.read("refs", project).filter(F.col("to_id").isNotNull() & F.col("from_id").isNotNull()).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("kind").alias("type"))
        inner = symbols.filter("scope <> ''").select("path", F.col("scope").alias("name"), F.col("id").alias("dst"))
        holds = inner.join(symbols.filter("kind <> 'method'").select("path", "name", F.col("id").alias("src")), ["path", "name"]).select("src", "dst", F.lit("contains").alias("type"))
        edges = calls.unionByName(holds).distinct().withColumn("project", F.lit(project)).withColumn("weight", F.lit(1.0))
        self.store.write("edges", edges.select(*self.store.read("edges", project).columns), project)

    # Tools

    def search(self, query: str, limit: int = 10, session: str | None = None, source_types: list[str] | None = None, language: str | None = None, weights: dict[str, float] | str | None = None, advanced: bool = False, expand: bool = False, rerank: bool = False, file_boost: float = 0.0, penalty: float = 0.0, one_per_file: bool = False, symbol_boost: float = 0.0, graph_signal: bool = False, mode: str | None = None, snippet: str = "lines", max_depth: int | None = None, by_meaning: bool = False) -> DataFrame:
        """Hybrid search over the permitted projects: rank, project, path, lines, score, sources, docid, trusted, snippet line.

        Keywords are looked up in the inverted index of the chunks in force, with statistics
        of each project. ``weights`` may be text (keyword=1.5,semantic=1.0); ``mode`` (lex,
        vec, hyde or several, comma-separated) overrides a prefix; ``graph_signal`` adds the
        gated PageRank list, which is off by default. ``snippet`` is lines (around the best
        line, under what encloses it), full (all that encloses it) or none; ``by_meaning``
        chooses the best line by the cosine of three lines with the query instead of by words.
        """
        chunks = self._seen("chunks", session)
        if language:
            chunks = chunks.join(self._seen("files", session).filter(F.col("language") == language).select("project", "path"), ["project", "path"], "left_semi")
        kind = F.coalesce("source_type", F.lit("code")).isin(source_types) if source_types else None
        if kind is not None:
            chunks = chunks.filter(kind)
        vectors = self._seen("embeddings", session).join(chunks.select("id"), "id", "left_semi")
        if snippet not in ("lines", "full", "none"):
            raise ValueError(f"snippet is lines, full or none, not {snippet!r}")
        if weights is None and self.profile.keyword_weight != 1:
            weights = {"keyword": self.profile.keyword_weight}
        clean, kinds = fts.split_prefix(query)
        if mode:
            kinds = [m.strip().lower() for m in mode.split(",")]
            if not set(kinds) <= set(fts.TYPES):
                raise ValueError(f"mode is lex, vec, hyde or several of them, not {mode!r}")
        vector = models.embed_query(clean, self.embedder()) if {"vec", "hyde"} & set(kinds) else None
        pool = limit * 3
        stored = self.store.paths("chunks")
        index = postings.of_version(self.spark, stored, "id", "content", "project") if stored and "lex" in kinds else None
        boosts = fusion.symbol_boost(chunks.withColumn("file_id", F.struct("project", "path")), self._seen("symbols", session).withColumn("file_id", F.struct("project", "path")), clean, symbol_boost) if symbol_boost else None
        third = (lambda text, lists: self._graph_list(text, lists, chunks, session, max(50, pool))) if graph_signal else None
        hits = fusion.hybrid_search(
            chunks, vectors, query, vector, limit=pool if rerank else limit, pool=max(50, pool), weights=fusion.parse_weights(weights) if isinstance(weights, str) else weights, expand=expand, advanced=advanced,
            paths=chunks.select("id", "path"), file_boost=file_boost, penalty=penalty, one_per_file=one_per_file, id_col="id", text_col="content", vector_id_col="id", project_col="project", index=index, restrict=True, kinds=kinds, graph_of=third, boosts=boosts,
        )
        rows = hits.join(chunks, "id")
        if rerank:
            rows = models.lexical_rerank(rows, clean, "content", limit)
            rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "rank")))
        rows = graph.cut(rows)  # a limited list, which the steps below read several times
        if by_meaning:
            best = snippets.nearest_lines(rows, vector or models.embed_query(clean, self.embedder()), self.embedder, "id", "content")
        else:
            best = snippets.best_lines(rows, clean, id_col="id", text_col="content").select("id", "line_no")
        out = rows.join(best, "id", "left")
        shown = []
        if snippet != "none":
            out = snippets.rendered(out, self._seen("symbols", session), ["project", "path"], max_depth=max_depth, full=snippet == "full")
            shown = ["snippet", "snippet_start", "snippet_end", "ancestors"]
        self._audit("search", session)
        trusted = (F.coalesce("source_type", F.lit("code")) == "code").alias("trusted")
        line = (F.col("start_line") + F.col("line_no")).alias("best_line")
        return out.select("rank", "id", "project", "path", "start_line", "end_line", "score", "sources", tx.docid(F.col("content")).alias("docid"), trusted, line, "content", *shown).orderBy("rank")

    def _graph_list(self, query: str, lists: list[DataFrame], chunks: DataFrame, session: str | None, limit: int) -> DataFrame | None:
        symbols = self._seen("symbols", session)
        inside = chunks.select(F.col("id").alias("chunk_id"), "project", "path", "start_line", "end_line").join(symbols.select(F.col("id").alias("symbol_id"), "project", "path", "line"), ["project", "path"])
        held = inside.filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("symbol_id", "chunk_id")
        return fusion.graph_list(query, lists, symbols.select("id", "name"), held, self._seen("edges", session), limit, PPR_TOLERANCE)

    def doc_search(self, query: str, limit: int = 10, session: str | None = None, formats: list[str] | None = None, **options) -> DataFrame:
        return self.search(query, limit, session, formats or DOCUMENT_TYPES, **options)

    def symbols(self, query: str = "*", session: str | None = None, kind: str | None = None, path_glob: str | None = None) -> DataFrame:
        return relations.lookup_symbols(self._seen("symbols", session), query, kind=kind, path_glob=path_glob).orderBy("name", "path", "line")

    def references(self, name: str, session: str | None = None, kind: str | None = None) -> dict[str, DataFrame]:
        refs, symbols = self._seen("refs", session), self._seen("symbols", session)
        return {"outgoing": relations.refs_of(refs, symbols, name, kind), "callers": relations.callers(refs, symbols, name, kind)}

    def file_context(self, path: str, session: str | None = None) -> DataFrame:
        symbols = self._seen("symbols", session).filter(F.col("path") == path)
        refs = self._seen("refs", session).filter(F.col("path") == path)
        rows = symbols.select("project", F.lit("symbol").alias("what"), "name", "kind", "line").unionByName(refs.select("project", F.lit("reference").alias("what"), F.col("to_name").alias("name"), "kind", "line"))
        first = rows.agg(F.min("project").alias("project"))
        return rows.join(first, "project", "left_semi").orderBy(F.desc("what"), "line", "name")

    def impact(self, name: str, depth: int = 3, include_types: bool = True, session: str | None = None) -> DataFrame:
        """What a change can reach in each project, with depth; a dense project's rows by PageRank from all of them.

        ppr_relevance is null in projects whose graph is sparse; there depth, name and path order the rows.
        """
        symbols, edges = self._seen("symbols", session), self._seen("edges", session)
        down = edges.filter("type = 'contains'").select(F.col("src").alias("parent"), F.col("dst").alias("child"))
        hit = graph.impact(symbols.select("id", "name"), self._seen("refs", session).filter("from_id is not null"), down, name, depth, include_types)
        found = graph.cut(symbols.join(hit.select("id", "depth"), "id").select("id", "project", "path", "name", "kind", "line", "depth"))
        scores = self.spark.createDataFrame([], "id bigint, ppr_relevance double")
        dense = False
        for r in found.select("project").distinct().collect():
            mine = F.col("project") == r.project
            nodes = symbols.filter(mine).select("id").distinct()
            inside = graph.cut(graph.load(edges.filter(mine), nodes))
            if nodes.count() < graph.MIN_NODES or graph.sparse_gate(inside, nodes).first().sparse:
                continue
            ranks = graph.personalized_pagerank(inside, found.filter(mine).select("id"), tolerance=PPR_TOLERANCE)  # from the answer itself
            affected = found.filter(mine).select("id").distinct().join(ranks, "id", "left")
            scores, dense = scores.unionByName(affected.select("id", F.coalesce("score", F.lit(0.0)).alias("ppr_relevance"))), True
        order = ["project", F.desc_nulls_last(F.round("ppr_relevance", 12))] if dense else []
        return found.join(scores, "id", "left").select("project", "path", "name", "kind", "line", "depth", "ppr_relevance").orderBy(*order, "depth", "name", "path")

    def cross_refs(self, name: str, session: str | None = None) -> DataFrame:
        d = self._seen("symbols", session).filter((F.col("name") == name) & ~F.col("kind").isin("import", "module"))
        return relations.cross_refs(d.select("name", "project"), self._seen("refs", session).filter(F.col("to_name") == name).select(F.col("to_name").alias("name"), "project"))

    def collection_map(self, collection: str | None = None, session: str | None = None) -> DataFrame:
        symbols, refs = self._seen("symbols", session), self._seen("refs", session)
        if collection is not None:
            inside = self.store.read("projects").filter(F.col("collection") == collection).select("project")
            symbols, refs = symbols.join(inside, "project", "left_semi"), refs.join(inside, "project", "left_semi")
        d = symbols.filter("name <> '' and kind not in ('import', 'module')").select("name", "project")
        return relations.project_map(d, refs.select(F.col("to_name").alias("name"), "project"))

    def events(self, name: str | None = None, session: str | None = None, mismatches: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
        e = self._seen("refs", session).filter(F.col("kind").isin(relations.REGISTERS, relations.FIRES)).select(F.col("to_name").alias("name"), "kind", "line", "path", "project")
        if mismatches:
            return relations.page(relations.event_mismatches(e).filter("status <> 'healthy'"), ["name"], offset, limit)
        return relations.page(relations.list_events(e, name), ["name", "kind", "path", "line"], offset, limit)

    def status(self) -> DataFrame:
        """Rows of each control table and of each project's index."""
        own = [self.store.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in ("projects", "collections", "sessions", "jobs", "files", "symbols", "refs", "edges", "chunks")]
        out = own[0]
        for df in own[1:]:
            out = out.unionByName(df)
        return out

    def drift_train(self, old: DataFrame, new: DataFrame, dims: int):
        """The rotation that takes the new model's vectors (id, embedding) to the old one's, from the ids both have."""
        pairs = old.select("id", F.col("embedding").alias("old")).join(new.select("id", F.col("embedding").alias("new")), "id")
        return drift.Rotation.fit(pairs, "old", "new", dims)
