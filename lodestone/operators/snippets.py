"""The best line of a text for a query, its window, and its rendering."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _overlaps(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id and s, the number of distinct query words in each line; a null text has no row."""
    words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    q = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    lines = F.split(F.lower(F.col(text_col)), "\n")
    s = F.transform(lines, lambda x: F.size(F.array_intersect(q, F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)))))
    return docs.select(F.col(id_col).alias("id"), s.alias("s")).filter("s is not null")


def _first_best(scores: DataFrame) -> DataFrame:
    return scores.select("id", "s", F.array_max("s").alias("overlap")).select("id", (F.array_position("s", F.col("overlap")) - 1).cast("int").alias("line_no"), "overlap")


def best_lines(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0) and overlap of the line of most overlap of each text, the first of equals.

    A row's lines stay in the row, so nothing is shuffled.
    """
    return _first_best(_overlaps(docs, query, id_col, text_col))


def best_windows(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The line whose three-line window overlaps most, the first of equals."""
    s, zero = F.col("s"), F.array(F.lit(0))
    before = F.concat(zero, F.slice(s, F.lit(1), F.size(s) - 1))
    after = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), zero)
    total = F.zip_with(F.zip_with(s, before, lambda a, b: a + b), after, lambda a, b: a + b)
    return _first_best(_overlaps(docs, query, id_col, text_col).select("id", total.alias("s")))


def windows(lines: list[str], size: int = 3) -> list[str]:
    """For each line the ``size`` lines around it; at the text's ends the window moves inward."""
    first = [max(0, min(i - size // 2, len(lines) - size)) for i in range(len(lines))]
    return ["\n".join(lines[a : a + size]) for a in first]


def nearest_lines(docs: DataFrame, vector: Sequence[float], make: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and line_no (from 0) of the line whose three-line window has the largest cosine with a query's vector, the first of equals.

    ``make`` loads the embedder once in each task; a text's windows are embedded together, so
    this is for results already cut to a limit. A null text has no row.
    """
    unit = np.asarray(vector, float) / (np.linalg.norm(vector) + 1e-10)

    @F.pandas_udf("int")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for texts in batches:
            found = []
            for t in texts:
                rows = np.asarray(embed(windows(t.split("\n"))), float)
                found.append(int(np.argmax(rows @ unit / (np.linalg.norm(rows, axis=1) + 1e-10))))
            yield pd.Series(found, dtype="int32")

    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), best(F.col(text_col)).alias("line_no"))


@dataclass(frozen=True)
class Enclosing:
    """A symbol around a line: outermost first in lists."""

    line: int
    end_line: int
    signature: str = ""
    name: str = ""


def render(lines: list[str], best: int, first: int = 1, around: int = 3, enclosing: Sequence[Enclosing] = (), max_depth: int | None = None, full: bool = False) -> tuple[str, int, int]:
    """The chosen line with its neighbours, numbered, under the numbered signatures of what encloses it; its first and last line.

    ``first`` is the number of the text's first line, ``best`` counts from 0. Between what is
    shown, and from there to the end of the innermost symbol, a mark tells how many lines are
    left out. ``max_depth`` keeps the innermost symbols; ``full`` shows all of the outermost
    symbol that the text holds.
    """
    outer = list(enclosing) if max_depth is None else list(enclosing)[max(0, len(enclosing) - max_depth) :]
    a, b = max(0, best - around), min(len(lines), best + around + 1)
    start, end = first + a, first + b - 1
    if outer and full:
        start, end = outer[0].line, outer[0].end_line
        a, b = max(0, start - first), min(len(lines), end - first + 1)
        heads, last = [], 0
    else:
        heads = list(itertools.takewhile(lambda e: e.line < start, outer))
        last = outer[-1].end_line if outer else 0
    width = len(str(max([end, last, *[e.line for e in outer]])))
    show = lambda n, text: f"{n:>{width}} | {text}"
    hide = lambda n, indent: [" " * (width + 3) + f"{indent}...  ({n} lines)"] if n > 0 else []
    out, at = [], 0
    for e in heads:
        text = (e.signature or e.name).split("\n")[0].rstrip()
        out += hide(e.line - at, text[: len(text) - len(text.lstrip())]) if at else []
        out.append(show(e.line, text))
        at = e.line + 1
    deepest = "    " * len(outer)
    out += hide(start - at, deepest) if at else []
    out += [show(first + i, lines[i]) for i in range(a, b)]
    return "\n".join(out + hide(last - end, deepest)), start, end


RENDERED = "snippet string, snippet_start int, snippet_end int"


def rendered(hits: DataFrame, symbols: DataFrame, keys: list[str], id_col: str = "id", text_col: str = "content", around: int = 3, max_depth: int | None = None, full: bool = False) -> DataFrame:
    """Hits (id, keys, content, start_line, line_no) with snippet, its first and last line, and the symbols around the line, outermost first.

    ``keys`` name the file in both tables; symbols have name, kind, line, end_line and
    signature, and open-ended ones enclose nothing. For results already cut to a limit.
    """
    inner = symbols.filter("name <> '' and kind not in ('import', 'module')").select(*keys, F.struct(F.col("line"), (-F.col("end_line")).alias("back"), "end_line", "name", "kind", "signature").alias("__symbol"))
    at = F.col("start_line") + F.col("line_no")
    met = hits.select(id_col, *keys, at.alias("__at")).join(inner, keys).filter(F.col("__at").between(F.col("__symbol.line"), F.col("__symbol.end_line")))
    outer = met.groupBy(id_col).agg(F.array_sort(F.collect_list("__symbol")).alias("__outer"))

    @F.pandas_udf(RENDERED)
    def draw(texts: pd.Series, firsts: pd.Series, bests: pd.Series, outers: pd.Series) -> pd.DataFrame:
        rows = []
        for text, first, best, around_it in zip(texts, firsts, bests, outers, strict=True):
            names = [Enclosing(e["line"], e["end_line"], e["signature"] or "", e["name"]) for e in (around_it if around_it is not None else [])]
            rows.append(render(text.split("\n"), int(best), int(first), around, names, max_depth, full) if text else ("", 0, 0))
        return pd.DataFrame(rows, columns=["snippet", "snippet_start", "snippet_end"])

    joined = hits.join(outer, id_col, "left").withColumn("__drawn", draw(F.col(text_col), "start_line", F.coalesce("line_no", F.lit(0)), "__outer"))
    kept = F.coalesce("__outer", F.array().cast("array<struct<line:int,back:int,end_line:int,name:string,kind:string,signature:string>>"))
    kept = kept if max_depth is None else F.slice(kept, F.greatest(F.size(kept) - max_depth + 1, F.lit(1)), F.lit(max_depth))
    around_line = F.transform(kept, lambda e: F.struct(e["name"].alias("name"), e["kind"].alias("kind"), e["line"].alias("line"), e["end_line"].alias("end_line")))
    return joined.withColumn("ancestors", around_line).select("*", "__drawn.*").drop("__drawn", "__outer")
