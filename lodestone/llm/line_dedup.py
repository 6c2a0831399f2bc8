"""Removal of passages of several lines, or of content-defined chunks, that repeat across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns, prepare, scratch, sliced, unused, written

#: A boundary follows a line whose rolling hash is divisible by this: chunks of about as many lines.
DIVISOR = 3
WINDOW_LINES = 2
MIN_LINES = 2
MAX_LINES = 32
#: Hashes of repeated chunks, and places of chunks that go, that are broadcast (some 16 MB); beyond it the joins shuffle.
HELD_HASHES = 1 << 20
_MOD = (1 << 61) - 1
_BASE = 1_000_003


def chunks_of(text: bytes, divisor: int = DIVISOR, window: int = WINDOW_LINES) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of the content-defined chunks of a text.

    The rolling hash over the last ``window`` line hashes decides on a boundary, so equal
    passages are cut alike wherever they stand, from their second line on.
    """
    lines = text.split(b"\n")
    hashes = [xxhash.xxh64_intdigest(x) % _MOD for x in lines]
    out, start, rolling, top = [], 0, 0, pow(_BASE, window, _MOD)
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h - (hashes[i - window] * top if i >= window else 0)) % _MOD
        size = i + 1 - start
        mixed = (rolling * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
        if size >= MAX_LINES or size >= MIN_LINES and mixed % divisor == 0:
            out.append((start, size, b"\n".join(lines[start : i + 1])))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines) - start, b"\n".join(lines[start:])))
    return out


def multi_line(text: bytes | None) -> list[tuple[int, int, bytes]]:
    """(chunk number, hash, bytes) of the chunks of two or more lines that aren't blank."""
    found = []
    for number, (_, size, body) in enumerate(chunks_of(text) if text else []):
        if size >= MIN_LINES and body.strip():
            found.append((number, xxhash.xxh64_intdigest(body) - (1 << 63), body))
    return found


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from each text the multi-line chunks that stand earlier in the corpus.

    Of equal chunks (equal in all bytes) the one in the document with the smallest id, and
    there the first, stays; null ids come last. The text is put together again from the
    lines left, joined by newlines. All columns pass, with text replaced; added are
    n_lines and n_removed_lines (own columns of those names are replaced).

    Null texts stay null, empty texts empty, with 0 lines; a text all of whose chunks are
    repeats becomes empty; single lines are never removed. Rows equal in id and text are
    one document and are treated alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    key = [F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__rk")]
    slim = docs.select(*key, text.cast("binary").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def spread(bodies: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                rows, numbers, hashes, texts = [], [], [], []
                for i, t in enumerate(batch.column(2).to_pylist()):
                    for number, h, body in multi_line(t):
                        rows.append(i)
                        numbers.append(number)
                        hashes.append(h)
                        texts.append(body)
                take = pa.array(rows, pa.int64())
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64())]
                names = ["__id", "__rk", "chunk", "h"]
                if bodies:
                    arrays, names = [*arrays, pa.array(texts, pa.binary())], [*names, "body"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        return slim.mapInArrow(run, f"__id {id_type}, __rk bigint, chunk int, h bigint" + ", body binary" * bodies)

    with scratch(spark) as keep:
        again = written(spread(False).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "line-again")
        bodies = _of_hashes(spread(True), again)
        bodies = written(bodies.withColumn("at", F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__rk", "chunk")), "line-bodies")
        # The first chunk of each hash is the one others are compared with, byte by byte. A chunk
        # that differs in spite of its hash stays; several texts under one hash lose nothing.
        firsts = bodies.groupBy("h").agg(F.min("at").alias("first"))
        first_bodies = bodies.join(firsts.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & (F.col("at") == F.col("first"))).groupBy("h2").agg(F.min("body").alias("first_body"), F.first("first").alias("first"))
        first_bodies = written(first_bodies, "line-firsts")  # a stage of its own, so that the join can split a very common chunk
        same = bodies.join(first_bodies, (F.col("h") == F.col("h2")) & (F.col("body") == F.col("first_body")) & (F.col("at") != F.col("first")))
        gone = same.select("__id", "__rk", "chunk").distinct().groupBy("__id", "__rk").agg(F.collect_list("chunk").alias("gone"))
        gone = keep(written(gone, "line-gone"))
    return _rebuilt(docs, gone, key, text_col, _without_chunks)


def _of_hashes(rows: DataFrame, again: DataFrame) -> DataFrame:
    """The rows whose h is among the given ones, a broadcast if these are few."""
    few = again.count() <= HELD_HASHES
    return rows.join(F.broadcast(again) if few else again, "h", "left_semi")


def pairs_of(text: bytes | None) -> list[tuple[int, int, bytes]]:
    """(first line, last line, bytes) of each line that isn't blank with the next one, and blank lines between."""
    lines = text.split(b"\n") if text else []
    full = [i for i, x in enumerate(lines) if x.strip()]
    return [(i, j, b"\n".join(lines[i : j + 1])) for i, j in zip(full, full[1:])]


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copied_share: float | None = None) -> DataFrame:
    """Remove from each text all passages of two or more lines that stand earlier in the corpus.

    A passage is a run of lines, two of them not blank, equal in all bytes to another run. It is
    a chain of neighbouring lines each pair of which stands earlier, so pairs are compared and
    every line of a pair goes that isn't the pair's first one: whole passages go, whatever
    surrounds them. First is the document with the smallest id, null ids last, and there the
    smallest line. Pairs are equal if their SHA-256 digests are. Every distinct line stays
    where it first stands, and a line repeated alone stays; of a line repeated in a row two stay.

    With ``copied_share``, a document at least this share of whose words stands in passages of
    earlier documents is a copy as a whole and stays as it is, for a later stage to judge whole.

    Columns, null and empty texts, repeated rows and empty tables are as in
    ``remove_repeated_chunks``; a text all of whose lines go becomes empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(f"`{text_col}`")
    key = [F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__rk")]
    slim = docs.select(*key, text.cast("binary").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [xxhash.xxh64_intdigest(body) - (1 << 63) for t in batch.column(0).to_pylist() for _, _, body in pairs_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, numbers, found, digests = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for number, (_, _, body) in enumerate(pairs_of(t)):
                    rows.append(i)
                    numbers.append(number)
                    found.append(xxhash.xxh64_intdigest(body) - (1 << 63))
                    digests.append(hashlib.sha256(body).digest())
            take = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(found, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__rk", "pair", "h", "digest"])

    with scratch(spark) as keep:
        again = written(slim.select("t").mapInArrow(hashes, "h bigint").groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "line-again")
        pairs = _of_hashes(slim.mapInArrow(places, f"__id {id_type}, __rk bigint, pair int, h bigint, digest binary"), again)
        pairs = written(pairs.drop("h").withColumn("at", F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__rk", "pair")), "line-pairs")
        firsts = pairs.groupBy(F.col("digest").alias("d")).agg(F.min("at").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
        firsts = written(firsts, "line-firsts")  # a stage of its own, so that the join can split a very common pair
        own = (F.col("no_id") == F.col("first.no_id")) & F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__rk") == F.col("first.__rk"))
        # In a run of one line, the pair next to the first shares a line with it and is no second passage.
        beside = own & F.col("pair").between(F.col("first.pair"), F.col("first.pair") + 1)
        same = pairs.join(firsts, F.col("digest") == F.col("d")).withColumn("no_id", F.col("at.no_id")).filter(~beside)
        # Pairs that stand first in the document itself are kept apart as -1 - pair.
        signed = F.when(own, -1 - F.col("pair")).otherwise(F.col("pair")).alias("pair")
        gone = same.select("__id", "__rk", signed).distinct().groupBy("__id", "__rk").agg(F.collect_list("pair").alias("gone"))
        gone = keep(written(gone, "line-gone"))
    return _rebuilt(docs, gone, key, text_col, lambda t, found: _without_pairs(t, found, copied_share))


def _without_chunks(t: bytes, gone: set[int]) -> tuple[bytes, int]:
    parts, drop = [], 0
    for number, (_, size, body) in enumerate(chunks_of(t)):
        if number in gone:
            drop += size
        else:
            parts.append(body)
    return b"\n".join(parts), drop


def _without_pairs(t: bytes, gone: set[int], copied_share: float | None = None) -> tuple[bytes, int]:
    spans = pairs_of(t)
    lines_of = lambda numbers: {i for n in numbers for i in range(spans[n][0], spans[n][1] + 1)}
    lines = t.split(b"\n")
    if copied_share is not None:
        copied = sum(len(lines[i].split()) for i in lines_of(n for n in gone if n >= 0))
        if copied >= copied_share * len(t.split()):
            return t, 0
    out = lines_of(n if n >= 0 else -1 - n for n in gone)
    return b"\n".join(x for i, x in enumerate(lines) if i not in out), len(out)


def _rebuilt(docs: DataFrame, gone: DataFrame, key: list[Column], text_col: str, without: Callable[[bytes, set[int]], tuple[bytes, int]]) -> DataFrame:
    """The documents without what ``gone`` (__id, __rk, gone) names; texts move only if that is too much to broadcast."""
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= HELD_HASHES
    i, r, g, raw, out_name = (unused(docs, x) for x in ("__i", "__r", "__gone", "__raw", "__text"))
    gone = gone.select(F.col("__id").alias(i), F.col("__rk").alias(r), F.col("gone").alias(g))
    own = key[0].eqNullSafe(F.col(i)) & (key[1] == F.col(r))
    marked = docs.join(F.broadcast(gone) if few else gone, own, "left").drop(i, r)

    def make():
        def work(texts, gone):
            out, lines, removed = [], [], []
            for t, found in zip(texts, gone, strict=True):
                n = t.count(b"\n") + 1 if t else 0
                drop = 0
                if found:
                    t, drop = without(t, set(found))
                out.append(t.decode() if t is not None else None)
                lines.append(n)
                removed.append(drop)
            return [out, lines, removed]

        return work

    fields = [(out_name, T.StringType(), pa.string()), ("n_lines", T.LongType(), pa.int64()), ("n_removed_lines", T.LongType(), pa.int64())]
    marked = marked.withColumn(raw, F.col(f"`{text_col}`").cast("binary")).drop(text_col)
    done = add_columns(marked, [raw, g], fields, make)
    cols: list[Column] = [F.col(out_name).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in ("n_lines", "n_removed_lines")]
    return done.select(*cols, "n_lines", "n_removed_lines")
