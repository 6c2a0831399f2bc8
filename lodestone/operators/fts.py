"""Keyword search: a small query language compiled to columns, ranked by BM25."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import _fold_table, tokens
from lodestone.operators.postings import Postings

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
TYPES = ("lex", "vec", "hyde")


class QuerySyntaxError(ValueError):
    """The advanced query doesn't parse; a search treats it as matching nothing."""


@dataclass(eq=False)
class Leaf:
    words: list[str]
    prefix: bool = False
    near: list["Leaf"] = field(default_factory=list)
    distance: int = 10
    scored: bool = True


def plain_tokens(text: str) -> list[str]:
    a, b = _fold_table()
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(a, b)))


def split_prefix(query: str) -> tuple[str, list[str]]:
    """Leading ``lex:``, ``vec:`` or ``hyde:`` (also comma-separated) and the rest; LEX and VEC by default."""
    m = re.match(rf"\s*((?:{'|'.join(TYPES)})(?:\s*,\s*(?:{'|'.join(TYPES)}))*)\s*:\s*(.*)", query, re.I | re.S)
    if not m:
        return query, ["lex", "vec"]
    return m[2].strip(), list(dict.fromkeys(x.strip().lower() for x in m[1].split(",")))


def sanitize(query: str, advanced: bool = False) -> str:
    """Plain mode quotes every blank-separated word; advanced mode only drops unbalanced parentheses."""
    if advanced:
        return query if query.count("(") == query.count(")") else query.replace("(", "").replace(")", "")
    return " ".join(f'"{w}"' for w in (x.replace('"', "") for x in query.split()) if w)


class Query:
    """Parsed query: ``leaves`` carry statistics, ``tree`` says which rows match."""

    def __init__(self, text: str):
        self.leaves: list[Leaf] = []
        self.items = re.findall(r'"[^"]*"\*?|\(|\)|,|[^\s(),"]+', text)
        self.at = 0
        self.tree = self._either() if self.items else None
        if self.at < len(self.items):
            raise QuerySyntaxError(text)

    def _peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def _take(self) -> str:
        if self.at >= len(self.items):
            raise QuerySyntaxError("the query ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def _either(self):
        parts = [self._all()]
        while self._peek() == "OR":
            self._take()
            parts.append(self._all())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def _all(self):
        parts = [self._but()]
        while self._peek() not in (None, "OR", ")", ","):
            if self._peek() == "AND":
                self._take()
            parts.append(self._but())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def _but(self):
        left = self._one()
        while self._peek() == "NOT":
            self._take()
            first = len(self.leaves)
            right = self._one()
            for leaf in self.leaves[first:]:
                leaf.scored = False
            left = ("not", [left, right])
        return left

    def _one(self):
        x = self._take()
        if x == "(":
            inner = self._either()
            if self._take() != ")":
                raise QuerySyntaxError("a parenthesis stays open")
            return inner
        if x == "NEAR" and self._peek() == "(":
            self._take()
            group = []
            while self._peek() not in (",", ")", None):
                group.append(self._leaf(self._take()))
            distance = 10
            if self._take() == ",":
                distance = int(self._take())
                if self._take() != ")":
                    raise QuerySyntaxError("NEAR stays open")
            for leaf in group:
                leaf.near, leaf.distance = [g for g in group if g is not leaf], distance
            return ("and", [("leaf", self.leaves.index(g)) for g in group])
        if x in (")", ",", "AND", "OR", "NOT"):
            raise QuerySyntaxError(f"unexpected {x}")
        self._leaf(x)
        return ("leaf", len(self.leaves) - 1)

    def _leaf(self, x: str) -> Leaf:
        quoted = x.startswith('"')
        if not quoted and not re.fullmatch(r"\w+\*?", x):
            raise QuerySyntaxError(f"{x} needs quotes")
        leaf = Leaf(plain_tokens(x), x.endswith("*"))
        self.leaves.append(leaf)
        return leaf

    def matches(self, found: list[Column]) -> Column:
        def of(node) -> Column:
            kind, rest = node
            if kind == "leaf":
                return found[rest]
            cols = [of(n) for n in rest]
            if kind == "not":
                return cols[0] & ~cols[1]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if kind == "and" else out | c
            return out

        return of(self.tree) if self.tree else F.lit(False)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, even where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts(toks: Column, leaf: Leaf) -> Column:
    """1-based places at which the leaf's words stand; ``toks`` must be a lambda's variable or a stored column."""
    n = len(leaf.words)
    if n == 0:
        return F.array().cast("array<int>")

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for j, w in enumerate(leaf.words):
            x = F.get(toks, i - 1 + j)
            ok = ok & F.coalesce(x.startswith(w) if leaf.prefix and j == n - 1 else x == w, F.lit(False))
        return ok

    places = F.when(F.size(toks) > 0, F.sequence(F.lit(1), F.size(toks))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, here)


def occurrences(toks: Column, leaf: Leaf) -> Column:
    """How often the leaf occurs; in NEAR, only where every other operand is close enough."""
    if not leaf.near and len(leaf.words) == 1:
        w = leaf.words[0]
        return F.size(F.filter(toks, lambda x: x.startswith(w) if leaf.prefix else x == w))
    if not leaf.near:
        return F.size(starts(toks, leaf))
    return _near(lambda x: starts(toks, x), leaf)


def _near(starts_of, leaf: Leaf) -> Column:
    """How many of the leaf's places have every other operand within its distance."""
    mine = len(leaf.words)

    def close(all_: Column, i: int, other: Leaf):
        n = len(other.words)
        return lambda p: F.exists(all_[f"p{i}"], lambda q: F.when(q > p, q - p - mine).otherwise(p - q - n) <= leaf.distance)

    def count(all_: Column) -> Column:
        places = all_["own"]
        for i, other in enumerate(leaf.near):
            places = F.filter(places, close(all_, i, other))
        return F.size(places)

    every = F.struct(starts_of(leaf).alias("own"), *[starts_of(o).alias(f"p{i}") for i, o in enumerate(leaf.near)])
    return let(every, count)


def _counted(docs: DataFrame, q: Query, id_col: str, text_col: str, project: Column, wanted: Column) -> DataFrame:
    """id, project, wanted, dl, and f (occurrences) of each leaf in every row: one scan of the texts."""

    def count(t: Column) -> Column:
        found = [occurrences(t, leaf).alias(f"f{i}") for i, leaf in enumerate(q.leaves)]
        found += [(F.size(starts(t, leaf)) > 0).alias(f"any{i}") for i, leaf in enumerate(q.leaves) if leaf.near]
        return F.struct(F.size(t).alias("dl"), *found)

    slim = docs.select(F.col(id_col).alias("id"), project.alias("project"), wanted.alias("wanted"), let(tokens(F.col(text_col)), count).alias("c"))
    return slim.select("id", "project", "wanted", "c.*")


def _looked_up(index: Postings, q: Query, project: Column) -> DataFrame:
    """The same of the rows that hold a word of the query, from their postings alone."""
    words = sorted({w for leaf in q.leaves for w in (leaf.words[:-1] if leaf.prefix else leaf.words)})
    heads = sorted({leaf.words[-1] for leaf in q.leaves if leaf.prefix and leaf.words})
    term, nothing = F.col("term"), F.array().cast("array<int>")
    wanted = F.lit(False)
    for test in ([term.isin(words)] if words else []) + [term.startswith(h) for h in heads]:
        wanted = wanted | test
    places = [F.coalesce(F.first(F.when(term == w, F.col("at")), ignorenulls=True), nothing).alias(f"w{i}") for i, w in enumerate(words)]
    places += [F.array_sort(F.flatten(F.collect_list(F.when(term.startswith(h), F.col("at"))))).alias(f"h{i}") for i, h in enumerate(heads)]
    rows = index.postings.filter(wanted).groupBy("row").agg(F.first("id").alias("id"), F.first("project").alias("project"), F.first("dl").alias("dl"), *places)

    def shifted(places: Column, by: int) -> Column:
        return F.transform(places, lambda p: p - by)

    def starts_of(leaf: Leaf) -> Column:
        if not leaf.words:
            return nothing
        at = [F.col(f"w{words.index(w)}") for w in (leaf.words[:-1] if leaf.prefix else leaf.words)]
        at += [F.col(f"h{heads.index(leaf.words[-1])}")] if leaf.prefix else []
        first = at[0]
        for j, other in enumerate(at[1:], 1):  # what is left are starts after which the words follow
            first = F.array_intersect(first, shifted(other, j))
        return first

    found = [(_near(starts_of, leaf) if leaf.near else F.size(starts_of(leaf))).alias(f"f{i}") for i, leaf in enumerate(q.leaves)]
    found += [(F.size(starts_of(leaf)) > 0).alias(f"any{i}") for i, leaf in enumerate(q.leaves) if leaf.near]
    return rows.select("id", project.alias("project"), F.lit(True).alias("wanted"), "dl", *found)


def bm25(
    docs: DataFrame,
    query: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    project_col: str | None = None,
    where: Column | None = None,
    advanced: bool = False,
    index: Postings | None = None,
    restrict: bool = False,
) -> DataFrame:
    """id, project and score (negative BM25, smaller is better) of the matching rows.

    Statistics cover the whole project, ``where`` filters afterwards but before any limit.
    With ``index``, the postings of the query's words are read and no text is (``docs`` only
    if ``where`` or ``restrict`` asks whether an id is among its rows; the index's own
    project counts as the project if ``project_col`` is given). Without, one scan gathers
    statistics and one scores. Statistics are joined on the project key, and the planner
    broadcasts them if they are small. A query that doesn't parse matches nothing.
    """
    try:
        q = Query(sanitize(query, advanced))
    except QuerySyntaxError:
        q = Query("")
    wanted = where if where is not None else F.lit(True)
    if index is None:
        counted = _counted(docs, q, id_col, text_col, F.col(project_col) if project_col else F.lit("all"), wanted)
        sizes = None
    else:
        project = F.col("project") if project_col else F.lit("all")
        counted = _looked_up(index, q, project)
        sizes = index.sizes.groupBy(project.alias("project")).agg(F.sum("docs").alias("N"), (F.sum("words") / F.sum("docs")).alias("avgdl"))
    has = lambda i, leaf: F.col(f"any{i}") if leaf.near else F.col(f"f{i}") > 0
    met = [F.count_if(has(i, leaf)).alias(f"n{i}") for i, leaf in enumerate(q.leaves)]
    own = [] if sizes is not None else [F.count("*").alias("N"), F.avg("dl").alias("avgdl")]
    stats = counted.groupBy("project").agg(F.count("*").alias("rows"), *own, *met)
    stats = stats if sizes is None else stats.join(sizes, "project")
    score = F.lit(0.0)
    for i, leaf in enumerate(q.leaves):
        if leaf.scored:
            f, n = F.col(f"f{i}"), F.col(f"n{i}")
            ratio = (F.col("N") - n + 0.5) / (n + 0.5)
            idf = F.when(ratio > 1, F.log(ratio)).otherwise(F.lit(IDF_FLOOR))
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = counted.filter(q.matches([F.col(f"f{i}") > 0 for i in range(len(q.leaves))]) & F.col("wanted"))
    if index is not None and (where is not None or restrict):
        hit = hit.join(docs.filter(wanted).select(F.col(id_col).alias("id")), "id", "left_semi")
    return hit.join(stats, "project").select("id", "project", (-score).alias("score"))


def keyword_search(docs: DataFrame, query: str, limit: int = 10, **options) -> DataFrame:
    """The best ``limit`` rows by BM25, equal scores by id."""
    return bm25(docs, query, **options).orderBy("score", "id").limit(limit)
