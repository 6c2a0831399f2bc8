"""One query over two indexes: routing by kind of query, weighted interleaving, demotion, reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx
from lodestone.operators.models import lexical_rerank

# Names of files that say little about a project's code.
BOILERPLATE = ["readme.txt", "readme.md", "readme.rst", "changelog.md", "changelog.txt", "changes.md", "license.md", "license.txt", "license", "contributing.md", "code_of_conduct.md"]
CONTENT_CHARS = 100


@dataclass(frozen=True)
class Route:
    """How one kind of query is searched; no source types means all."""

    source_types: tuple[str, ...] = ()
    vectors_only: bool = False
    query_prefix: bool = True
    rerank: bool = True


ROUTES = {
    "code": Route(("code",), vectors_only=True, query_prefix=False, rerank=False),
    "doc": Route(("markdown", "json"), vectors_only=True, query_prefix=False),
    "cross": Route(),
}


def route(category: str) -> Route:
    return ROUTES.get(category, ROUTES["cross"])


def fan_out(code: DataFrame, general: DataFrame, query: str, weight: int = 1, pool: int = 20, top_k: int = 10, demote: bool = False, rerank: bool = True) -> DataFrame:
    """The hits of two indexes (rank, id, path, content each) as one list: id, origin, path, content, rank.

    In turn one hit of ``code`` and ``weight`` of ``general``; of hits with equal path and
    beginning of content the earliest stays. ``demote`` puts boilerplate files behind all
    others. With ``rerank``, the first ``pool`` are ordered by the share of query words they
    hold (rerank_score, equal ones by rank) and cut to ``top_k``. Both lists are already cut
    to a limit, so one task ranks them.
    """
    r = F.col("rank") - 1
    places = {
        "code": (code, r * (weight + 1)),
        "general": (general, F.floor(r / weight) * (weight + 1) + 1 + r % weight),
    }
    parts = [df.select("id", "path", "content", F.lit(name).alias("origin"), place.cast("long").alias("place")) for name, (df, place) in places.items()]
    hit = F.struct("id", "path", "content", "origin")
    key = [F.coalesce("path", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, CONTENT_CHARS)]
    one = parts[0].unionByName(parts[1]).groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(key)]).agg(F.min_by(hit, "place").alias("hit"), F.min("place").alias("place"))
    merged = one.select("hit.*", "place").orderBy("place").limit(max(30, pool + 10))
    last = F.lower(tx.basename(F.coalesce("path", F.lit("")))).isin(BOILERPLATE) if demote else F.lit(False)
    ordered = merged.withColumn("rank", F.row_number().over(Window.orderBy(last, "place"))).drop("place")
    return lexical_rerank(ordered.filter(F.col("rank") <= pool), query, "content", top_k) if rerank else ordered
