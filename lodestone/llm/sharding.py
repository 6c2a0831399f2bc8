"""Reproducible shuffle into shards by a Feistel permutation with cycle walking."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dense_numbers

PRIME = 2147483647
ROUND_PAIRS = 3
#: A walk leaves [0, n) again with odds of about 1 in sqrt(n) a step, and can't be
#: longer than the number of surplus points.
WALK = 24


def round_keys(seed: int, pairs: int = ROUND_PAIRS) -> list[tuple[int, int]]:
    words = [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") % PRIME for i in range(2 * pairs)]
    return list(zip(words[::2], words[1::2], strict=True))


def sides(n: int) -> tuple[int, int]:
    """The domain is a grid of a x b >= n points, with fewer than a to spare."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def walk_limit(n: int) -> int:
    a, b = sides(n)
    return min(WALK, a * b - n + 1)


def permute(row: int, n: int, seed: int = 0) -> int:
    """The place of a global row number after the shuffle: the same law in plain Python."""
    a, b = sides(n)

    def mix(x: int, key: int) -> int:
        y = ((x + key) % PRIME * 48271 + 11) % PRIME
        return (y * y + key) % PRIME

    while True:
        left, right = divmod(row, b)
        for k1, k2 in round_keys(seed):
            left = (left + mix(right, k1)) % a
            right = (right + mix(left, k2)) % b
        row = left * b + right
        if row < n:
            return row


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number, computed without any data."""
    place = permute(row, n, seed)
    return place % shards, place // shards


def feistel(row: Column, n: int, seed: int) -> Column:
    """``permute`` as one native expression."""
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("k1"), F.lit(y).cast("long").alias("k2")) for x, y in round_keys(seed)])

    def mix(x: Column, key: Column) -> Column:
        y = ((x + key) % PRIME * 48271 + 11) % PRIME
        return (y * y + key) % PRIME

    def pair(s: Column, k: Column) -> Column:
        left = (s["l"] + mix(s["r"], k["k1"])) % a
        return F.struct(left.alias("l"), ((s["r"] + mix(left, k["k2"])) % b).alias("r"))

    def once(p: Column) -> Column:
        start = F.struct(F.call_function("div", p, F.lit(b).cast("long")).alias("l"), (p % b).alias("r"))
        return F.aggregate(keys, start, pair, lambda s: s["l"] * b + s["r"])

    steps = F.sequence(F.lit(1), F.lit(walk_limit(n)))
    place = F.aggregate(steps, once(row), lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk too long: choose another seed")).cast("long"))


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shuffle rows into shards whose counts are at most one apart (law ``rows``).

    Rows are numbered 0 to n - 1 by id, then by a hash of the text; the permuted number p
    gives shard p mod shards and slot p div shards, so slots are gapless and ``locate``
    finds any row without data. Returns id, size (UTF-8 bytes + 8), text_crc32, law,
    shard, slot and grown_shard (null under this law).

    Null ids come first; null texts have size 8 and checksum 0; rows equal in both
    columns are interchangeable and each get a slot; an empty table gives an empty
    result; other columns are ignored. Fewer rows than shards leave shards empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__h"),
    )
    numbered = dense_numbers(slim, [F.col(f"`{id_col}`"), F.col("__h")], label="shards")
    n = numbered.count()
    placed = numbered.withColumn("__p", feistel(F.col("row_no"), n, seed) if n else F.lit(0).cast("long"))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("__p"), F.lit(shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 24, seed: int = 0) -> str:
    """The same shuffle in DuckDB SQL, the checksum included."""
    table = []
    for i in range(256):  # the CRC-32 table by its rule
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)

    def mix(x: str, k: int) -> str:
        y = f"((({x} + {k}) % {PRIME} * 48271 + 11) % {PRIME})"
        return f"(({y} * {y} + {k}) % {PRIME})"

    def rounds(source: str) -> str:
        q = f"SELECT doc_id, n, a, b, p // b AS l, p % b AS r FROM {source}"
        for k1, k2 in round_keys(seed):
            q = f"SELECT doc_id, n, a, b, (l + {mix('r', k1)}) % a AS l, r FROM ({q})"
            q = f"SELECT doc_id, n, a, b, l, (r + {mix('l', k2)}) % b AS r FROM ({q})"
        return f"SELECT doc_id, n, a, b, l * b + r AS p FROM ({q})"

    return f"""
WITH RECURSIVE dims AS (
  SELECT n, a, (n + a - 1) // a AS b FROM (
    SELECT count(*)::BIGINT AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)
), walk AS (
  {rounds('(SELECT doc_id, n, a, b, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents, dims)')}
  UNION ALL
  {rounds('(SELECT * FROM walk WHERE p >= n)')}
), sums AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, x: xor(c >> 8, list_extract(CAST({table} AS BIGINT[]), CAST((xor(c, x) & 255) + 1 AS BIGINT)))), 4294967295::BIGINT) AS text_crc32
  FROM documents
)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, s.text_crc32, 'rows' AS law, CAST(w.p % {shards} AS INTEGER) AS shard,
  CAST(w.p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sums s JOIN walk w USING (doc_id) WHERE w.p < w.n
"""
