"""Versioned tables in a folder: every write is a new version, the last complete one is read.

Tables of index rows have a folder and versions of their own for each project, so indexing
one project writes nothing of another's.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "projects": "project string, path string, collection string, indexed_at timestamp, parser string",
    "collections": "collection string, created_at timestamp",
    "sessions": "session_id string, agent string, level string, projects array<string>, collections array<string>, valid_until timestamp",
    "jobs": "job string, project string, status string, started_at timestamp, completed_at timestamp, error string",
    "files": "project string, path string, language string, route string, mime string, package string, size bigint, hash string",
    "symbols": "id bigint, project string, path string, name string, kind string, line int, end_line int, scope string, signature string",
    "refs": "ref_id bigint, project string, path string, from_id bigint, from_name string, to_id bigint, to_name string, kind string, line int, subtype string",
    "edges": "project string, src bigint, dst bigint, type string, weight double",
    "chunks": "id bigint, project string, path string, chunk int, content string, start_line int, end_line int, heading string, parent string, key_path string, kind string, source_type string",
    "index_stats": "project string, job string, processed bigint, skipped bigint, deleted bigint, symbols bigint, chunks bigint, embedded bigint, at timestamp",
    "embeddings": "id bigint, project string, embedding array<float>",
}

#: Tables with versions by project; the others are small and whole.
BY_PROJECT = {"files", "symbols", "refs", "edges", "chunks", "embeddings"}


class Store:
    """Readers see whole versions: a write that fails leaves the last version in force."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _children(self, folder: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self, folder: str) -> list[int]:
        found = self._children(folder)
        if not found:
            return []
        fs = found[0].getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def _folders(self, name: str, project: str | None) -> list[str]:
        """A table's folder, or its folders: that of one project, or of all."""
        if name not in BY_PROJECT:
            return [f"{self.root}/{name}"]
        if project is not None:
            return [f"{self.root}/{name}/p-{quote(project, safe='')}"]
        return [f"{self.root}/{name}/{p.getName()}" for p in self._children(f"{self.root}/{name}")]

    def paths(self, name: str, project: str | None = None) -> list[str]:
        """The folders of the versions in force."""
        found = [(f, self._versions(f)) for f in self._folders(name, project)]
        return sorted(f"{f}/v{versions[-1]}" for f, versions in found if versions)

    def read(self, name: str, project: str | None = None) -> DataFrame:
        paths = self.paths(name, project)
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame, project: str | None = None) -> None:
        """A new version of the table, or of the project's part of it; columns are brought into the table's order."""
        if (name in BY_PROJECT) != (project is not None):
            raise ValueError(f"{name} is written {'by project' if name in BY_PROJECT else 'whole'}")
        (folder,) = self._folders(name, project)
        version = (self._versions(folder) or [0])[-1] + 1
        df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.mode("overwrite").parquet(f"{folder}/v{version}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions of every table."""
        for name in SCHEMAS:
            for folder in self._folders(name, None):
                for v in self._versions(folder)[:-keep]:
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}")
                    p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
