"""Optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dense_numbers

MAX_LEN = 2048
BUCKETS = 8
BATCH_TOKENS = 65536


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; the stand-in for a tokenizer's count."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    Dynamic programming over the histogram's lengths; of equally good divisions the one
    with the fewest buckets, then the smallest cuts, is taken.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    c = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * lengths)])
    m = len(lengths)
    # Lengths i .. j in a bucket of length lengths[j] cost lengths[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i]);
    # one j at a time, so that memory is in proportion to the lengths, not to their square.
    best, cuts = lengths * c[1:] - s[1:], []
    totals = [best[-1]]
    for _ in range(1, min(buckets, m)):
        cut, new = np.zeros(m, np.int64), np.full(m, np.inf)
        for j in range(1, m):
            options = best[:j] + lengths[j] * (c[j + 1] - c[1 : j + 1]) - (s[j + 1] - s[1 : j + 1])
            cut[j] = options.argmin()
            new[j] = options[cut[j]]
        cuts.append(cut)
        best = new
        totals.append(best[-1])
    k = int(np.argmin(totals))
    bounds, j = [], m - 1
    for cut in reversed(cuts[:k]):
        bounds.append(int(lengths[j]))
        j = int(cut[j])
    return sorted([*bounds, int(lengths[j])])


def pack(
    docs: DataFrame,
    length: Column | None = None,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut documents into sequences, sequences into length buckets, buckets into batches.

    A document of more than ``max_len`` tokens becomes several sequences of ``max_len`` and
    a rest, so the histogram of lengths has at most ``max_len`` entries; it covers all
    sequences. Every batch of a bucket holds as many sequences as fit ``batch_tokens`` when
    padded to the bucket's bound (one at least); the last of a bucket may be smaller.
    Within a bucket sequences follow a seeded hash order.

    Returns id, piece, start and length (tokens), bucket, bucket_len, batch (from 0 in each
    bucket), slot and padding. ``length`` is the token count of a document, by default its
    words. A document without tokens (null, empty or blank text) gives one row of length 0
    with bucket, batch and slot null. Null ids and repeated rows are packed like others;
    rows equal in id and length are interchangeable. An empty table gives an empty result;
    other columns are ignored.
    """
    size = word_count(F.col(f"`{text_col}`")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = docs.select(F.col(f"`{id_col}`").alias(id_col), size.alias("__n"))
    last = F.greatest(F.call_function("div", F.col("__n") - 1, F.lit(max_len).cast("long")), F.lit(0).cast("long"))
    pieces = sized.select(id_col, "__n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        id_col,
        "piece",
        (F.col("piece") * max_len).alias("start"),
        F.least(F.col("__n") - F.col("piece") * max_len, F.lit(max_len).cast("long")).alias("length"),
    )
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most max_len + 1 rows
    empty = histogram.pop(0, 0)
    bounds = best_boundaries(histogram, buckets)
    bucket = F.lit(None).cast("int")
    for i, bound in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("length") <= bound, F.lit(i)).otherwise(bucket)
    bucket = F.when(F.col("length") > 0, bucket)
    order = [F.coalesce("bucket", F.lit(-1)), F.xxhash64(F.lit(seed), F.col(id_col), F.col("piece")), F.col(id_col), F.col("piece")]
    rows = dense_numbers(pieces.withColumn("bucket", bucket), order, "__row", "packing")
    first, seen = [], empty
    for i, bound in enumerate(bounds):
        first.append(seen)
        seen += sum(n for x, n in histogram.items() if (bounds[i - 1] if i else 0) < x <= bound)

    def of_bucket(values: list[int]) -> Column:
        # Asked for explicitly: compiled element_at takes a null place for the last element.
        one = F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1) if values else F.lit(None).cast("long")
        return F.when(F.col("bucket").isNotNull(), one)

    each = [max(1, batch_tokens // b) for b in bounds]
    place = F.col("__row") - of_bucket(first)
    return rows.select(
        id_col,
        "piece",
        "start",
        "length",
        "bucket",
        of_bucket(bounds).alias("bucket_len"),
        F.call_function("div", place, of_bucket(each)).alias("batch"),
        (place % of_bucket(each)).alias("slot"),
        (of_bucket(bounds) - F.col("length")).alias("padding"),
    )
