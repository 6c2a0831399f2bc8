"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each Arrow batch of documents (some hundred, 1 MB of text) is a shard. Its words become numbers of the benchmark's
vocabulary; positions from which a match is still possible are sorted into a suffix array
to the depth of one window, and every benchmark suffix is binary-searched in it. Runs of
matches along one item give the longest verbatim matches and their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns

WINDOW = 10
#: Documents of a shard at most; the bytes of an Arrow batch bound it first.
SHARD_ROWS = 10_000
#: Benchmark text held by a task at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and turns every other ASCII byte than 0-9 and a-z into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Suffixes:
    """The suffixes of benchmark items, cut to one window, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        at: dict[tuple[int, ...], list[tuple[int, int]]] = {}  # window -> (item, place)
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for p in range(max(1, len(ids) - window + 1) if ids else 0):
                at.setdefault(tuple(ids[p : p + window]), []).append((k, p))
        self.places = list(at.values())
        self.lengths = [len(w) for w in at]
        self.shortest = min(self.lengths, default=window)
        keys = np.zeros((len(at), window), ">u4")
        for row, w in enumerate(at):
            keys[row, : len(w)] = w
        self.low = _keys(keys)
        high = keys.copy()
        for row, n in enumerate(self.lengths):
            high[row, n:] = 0xFFFFFFFF
        self.high = _keys(high)

    def search(self, shard: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """For each document of the shard, its matches (place, window number) by place."""
        found: list[list[tuple[int, int]]] = [[] for _ in shard]
        if not self.places or not shard:
            return found
        w = self.window
        flat = np.concatenate([np.append(ids, 0) for ids in shard] + [np.zeros(w, np.uint32)]).astype(np.uint32)
        # Known words in a row from each position on; a match needs as many as the shortest window has.
        unknown = np.flatnonzero(flat == 0)
        here = np.flatnonzero(flat)
        run = unknown[np.searchsorted(unknown, here)] - here
        here, run = here[run >= self.shortest], run[run >= self.shortest]
        if not len(here):
            return found
        rows = flat[here[:, None] + np.arange(w)]
        rows[np.arange(w) >= run[:, None]] = 0
        order = np.lexsort(rows.T[::-1])
        array, places = _keys(rows[order].astype(">u4")), here[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        ends = np.cumsum([len(ids) + 1 for ids in shard])
        for q in np.flatnonzero(last > first):
            for p in places[first[q] : last[q]].tolist():
                d = int(np.searchsorted(ends, p, "right"))
                found[d].append((p - int(ends[d]) + len(shard[d]) + 1, int(q)))
        for hits in found:
            hits.sort()
        return found


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def _block_pass(docs: DataFrame, items: list[tuple[str, bytes]], text_col: str, window: int) -> DataFrame:
    """Extend __spans, __items and __longest of each row by the matches with one block of items."""

    def make():
        index = Suffixes(items, window)

        def work(texts, spans, names, longest):
            shard, counts = [], []
            for t in texts:
                ws = words_of(t)
                counts.append(len(ws))
                get = index.vocabulary.get
                shard.append(np.array([get(w, 0) for w in ws], np.uint32))
            out_spans, out_names, out_longest = [], [], []
            for hits, before, known, most in zip(index.search(shard), spans, names, longest, strict=True):
                intervals = [(s["from"], s["to"]) for s in before]
                who = set(known)
                open_: dict[tuple[int, int], int] = {}
                last = -1
                for p, q in hits:
                    n = index.lengths[q]
                    intervals.append((p, p + n))
                    if p != last:
                        previous, open_ = (open_ if p == last + 1 else {}), {}
                        last = p
                    for k, place in index.places[q]:
                        who.add(index.names[k])
                        open_[k, place] = max(n, previous.get((k, place - 1), 0) + 1)
                        most = max(most, open_[k, place])
                merged: list[list[int]] = []
                for a, b in sorted(intervals):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                out_spans.append([{"from": a, "to": b} for a, b in merged])
                out_names.append(sorted(who))
                out_longest.append(most)
            return [counts, out_spans, out_names, out_longest]

        return work

    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    fields = [
        ("n_words", T.LongType(), pa.int64()),
        ("__spans", T.ArrayType(span), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        ("__items", T.ArrayType(T.StringType()), pa.list_(pa.string())),
        ("__longest", T.LongType(), pa.int64()),
    ]
    return add_columns(docs, [text_col, "__spans", "__items", "__longest"], fields, make, SHARD_ROWS)


OWN = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "spans", "items"]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add to each document what it shares verbatim with the benchmark.

    A-Z is lower-cased; words are runs of 0-9, a-z and all non-ASCII characters. Any
    ``window`` consecutive words of an item make a window, an item of fewer words is one,
    an item without words has none. Adds n_words, n_hit (words inside an occurrence),
    n_items and items (items with occurring windows), items_sha256 (of those ids, sorted
    as strings and comma-joined), contaminated (n_hit > 0), longest_match (words of the
    longest verbatim match) and spans (word ranges of the occurrences, merged).

    Null or empty texts have no words and no hits; an item with a null id is listed as
    ``null``; repeated items count once by id; repeated rows each get their answer; an
    empty benchmark leaves all documents clean, an empty table gives an empty result.
    Other columns pass; those named like the operator's own are replaced. Texts are
    searched whole. The benchmark is the stated query set: it is read in blocks of about
    ``block_bytes`` of text, each block in one pass over the documents.
    """
    raw = "__raw"
    work = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OWN or c == text_col],
        F.col(f"`{text_col}`").cast("binary").alias(raw),
        F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)").alias("__spans"),
        F.expr("cast(array() as array<string>)").alias("__items"),
        F.lit(0).cast("long").alias("__longest"),
    )
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"),
        F.col(f"`{item_text_col}`").cast("binary").alias("text"),
    ).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        work = _block_pass(work, [(r.item, bytes(r.text)) for r in part.collect()], raw, window)  # bounded by block_bytes
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    found = work.withColumns({
        "n_hit": n_hit,
        "n_items": F.size("__items").cast("long"),
        "items_sha256": F.sha2(F.array_join("__items", ","), 256),
        "contaminated": n_hit > 0,
        "longest_match": F.col("__longest"),
        "spans": F.col("__spans"),
        "items": F.col("__items"),
    })
    return found.drop(raw, "__spans", "__items", "__longest")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no window with any benchmark item."""
    return find_contamination(docs, benchmark, **options).filter("not contaminated")


def oracle(window: int = WINDOW) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {window}) AS k, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS g
  FROM b, LATERAL unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {words} AS w FROM documents),
gram AS (
  SELECT doc_id, x.k, unnest(list_transform(range(1, len(w) - x.k + 2), lambda i: array_to_string(list_slice(w, i, i + x.k - 1), ' '))) AS g,
    unnest(range(1, len(w) - x.k + 2)) AS i
  FROM d, (SELECT DISTINCT k FROM win) x WHERE len(w) >= x.k),
hit AS (SELECT DISTINCT doc_id, i, gram.k, item FROM gram JOIN win ON win.k = gram.k AND win.g = gram.g),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, LATERAL unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
who AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN who USING (doc_id)
"""
