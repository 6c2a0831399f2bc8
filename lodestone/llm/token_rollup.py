"""Token counts kept by deltas: signed changes add up to totals by source, language and tokenizer version."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns, discard, fresh_path, joined_by_key, scratch, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32 << 20
#: White space (as the pattern takes it) in runs on which the regex engine would run out of stack.
LONG_RUN = re.compile("[ \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def ranks_of(blob: bytes) -> dict[bytes, int]:
    """The tokens of a vocabulary file with their ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


def count_of(encoding, text: str | None) -> int:
    """Tokens of a whole text.

    A very long run of white space is one piece up to its last character, which belongs to
    what follows (all of it is one at the end); it is encoded as such, past the regex.
    """
    total, at = 0, 0
    for run in LONG_RUN.finditer(text or ""):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : stop].encode()))
        at = stop
    return total + len(encoding.encode_ordinary((text or "")[at:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add the number of byte-pair tokens of every whole text (null and empty: 0).

    The driver reads the vocabulary file, of at most ``MAX_VOCABULARY_BYTES``, and ships it
    with the task, so executors need no path to it.
    """
    with open(vocabulary, "rb") as f:
        blob = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to ship")

    def make():
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks_of(blob), special_tokens={})

        def work(texts):
            return [[count_of(encoding, t) for t in texts]]

        return work

    return add_columns(docs, [text_col], [(name, T.LongType(), pa.int64())], make)


def changes(before: DataFrame, after: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Signed deltas that turn one snapshot of counts into another.

    Both have id, source, lang, tokenizer and n_tokens. A document that is only in ``after``
    is an insert (+), only in ``before`` a delete (-), and a changed count, source, language
    or version is a delete of the old row and an insert of the new one. Rows are added up by
    id first, so repeated rows and null ids keep their weight.
    """
    cols = [id_col, *KEYS]
    signed = after.select(*cols, "n_tokens", F.lit(1).alias("sign")).unionByName(before.select(*cols, "n_tokens", F.lit(-1).alias("sign")))
    net = signed.groupBy(*cols, "n_tokens").agg(F.sum("sign").alias("docs")).filter("docs <> 0")
    return net.select(*KEYS, "docs", (F.col("docs") * F.coalesce("n_tokens", F.lit(0))).alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))


class Rollup:
    """A folder of committed batches, each a small table of signed sums.

    A batch is summed by key, written under its id by Spark's commit protocol and counts
    only once ``_SUCCESS`` stands; committing an id again is a no-op, and what a failed
    attempt left is overwritten. Totals are the sums over committed batches. One writer
    works at a time.

    A compacted batch has a list of the ids it stands for, written before it. They stop
    counting when it is committed, whether or not their folders are gone yet, and stay
    known, so none can come in again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list_of(self, batch: str):
        return self._path(f"{self.root}/_replaced/{batch}")

    def _finished(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(self.root))]
        return sorted(n for n in names if not n.startswith("_") and fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def _replaced(self, finished: list[str]) -> set[str]:
        fs, found = self._fs(), set()
        for n in finished:
            if fs.exists(self._list_of(n)):
                stream = fs.open(self._list_of(n))
                try:
                    found.update(bytes(stream.readAllBytes()).decode().split())
                finally:
                    stream.close()
        return found

    def committed(self) -> list[str]:
        """The batches whose sums make up the totals."""
        finished = self._finished()
        replaced = self._replaced(finished)
        return [n for n in finished if n not in replaced]

    def known(self) -> set[str]:
        """The batches that can't be committed again: those that count, and those compacted."""
        finished = self._finished()
        return set(finished) | self._replaced(finished)

    def _check(self, batch: str) -> None:
        if batch.startswith("_") or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, docs, tokens); False if it is already in."""
        self._check(batch)
        if batch in self.known():
            return False
        self._fs().delete(self._list_of(batch), False)  # of a compaction that failed
        self._sums(deltas).write.mode("overwrite").parquet(f"{self.root}/{batch}")
        return True

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """docs and tokens by source, lang and tokenizer; keys that came to nothing are left out."""
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self._sums(self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{n}" for n in names]))

    def compact(self, batch: str) -> bool:
        """Write the totals as one batch and remove those it stands for; False if the id is already in.

        Totals stay right if this fails at any point, and a second call finishes the work.
        """
        self._check(batch)
        fs = self._fs()
        new = batch not in self.known()
        if new:
            out = fs.create(self._list_of(batch), True)
            try:
                out.write(bytearray("\n".join(sorted(self.known())).encode()))
            finally:
                out.close()
            self.totals().write.mode("overwrite").parquet(f"{self.root}/{batch}")
        finished = self._finished()
        for n in self._replaced(finished).intersection(finished):
            fs.delete(self._path(f"{self.root}/{n}"), True)
        return new


def corpus_rollup(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = "byte_bpe_50k") -> DataFrame:
    """Totals of a corpus after three batches: all documents come in, repeats of a text go,
    and the counts of those that stay are revised to include an end-of-text token.

    Of equal texts the one with the smallest id stays (null ids last; rows equal in id and
    text stay together). Null texts count 0 tokens and are equal to each other, empty texts
    likewise. Null sources and languages are keys of their own. The first batch is committed
    twice, as after a lost acknowledgement, and counts once.
    """
    spark = docs.sparkSession
    digest = F.coalesce(F.sha2(F.col("text"), 256), F.lit("null"))
    slim = docs.select("doc_id", "source", "lang", digest.alias("digest"), F.col("text").alias("__text"))
    root = fresh_path(spark, "token-rollup")
    with scratch(spark) as keep:
        counts = written(count_tokens(slim, vocabulary, "__text").drop("__text").withColumn("tokenizer", F.lit(version)), "token-counts")
        order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
        firsts = written(counts.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")), "token-firsts")
        # A text that very many rows hold is spread over all tasks.
        joined = written(joined_by_key(counts, firsts, "digest", "copies").withColumn("stays", order == F.col("first")).drop("first", "copies"), "token-stays")
        rollup = Rollup(spark, root)
        rollup.commit("load", inserts(counts))
        rollup.commit("load", inserts(counts))
        rollup.commit("repeats", deletes(joined.filter("not stays")))
        stay = joined.filter("stays").select("doc_id", *KEYS, "n_tokens")
        rollup.commit("end-tokens", changes(stay, stay.withColumn("n_tokens", F.col("n_tokens") + 1)))
        totals = keep(written(rollup.totals(), "token-totals"))
    discard(spark, [root])
    return totals
