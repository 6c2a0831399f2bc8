"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram binds its letters' vectors,
permuted (rolled) by their place, into their product; a text bundles (adds) its trigrams'
vectors. A language's prototype bundles its documents; a document gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns, discard, prepare, scratch, sliced, unused, written

DIMENSIONS = 1024
SEED = 20240229
#: Trigram vectors kept by a task (1 byte a dimension).
HELD_TRIGRAMS = 32768
#: Prototypes that a task holds at once (DIMENSIONS numbers each); more are met in blocks.
BLOCK_LANGUAGES = 2048
#: If set, only languages with at least one in so many of the documents that teach are learned; by default all are.
LEARNED: int | None = None
UNKNOWN = "und"
#: Less than any cosine.
NO_COSINE = -2.0
#: Cosines no further apart are equal: far above what rounding does, far below what a letter does.
SAME_COSINE = 1e-12
_MASK = np.uint64((1 << 21) - 1)


class Space:
    """The vectors of letters and trigrams, made when first met; the same in every task."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((256, dimensions), np.int8)
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x10000)])

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def trigrams(self, text: str | None) -> np.ndarray:
        """One number for each trigram of letters, words set off by single spaces; none without a letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        letter = self.is_letter[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF):
            letter[i] = chr(codes[i]).isalpha()
        if not letter.any():
            return np.empty(0, np.uint64)
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
        space = codes == 32
        codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
        return codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """A row for each distinct trigram."""
        if len(self.rows) + len(keys) > HELD_TRIGRAMS:
            self.rows.clear()
        at = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                a, b, c = key >> 42, key >> 21 & int(_MASK), key & int(_MASK)
                self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at[i] = row
        return self.table[at]

    def bundle(self, keys: np.ndarray, damped: bool = False) -> np.ndarray:
        """The sum of the vectors of all trigrams given; exact, as the parts are whole numbers.

        ``damped``: a trigram counts by the root of its number, so that one line repeated
        over and over doesn't outweigh the rest of a text.
        """
        distinct, counts = np.unique(keys, return_counts=True)
        counts = np.sqrt(counts) if damped else counts
        total = np.zeros(self.dimensions)
        for i in range(0, len(distinct), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors(distinct[i : i + 4096]).astype(np.float32)
        return total


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Iterator[dict[str, list[int]]]:
    """The bundle of all documents of each language, in blocks of BLOCK_LANGUAGES in alphabetical order.

    Every language is learned, however many there are and however rare; null texts and
    languages teach nothing, nor do texts without a letter. Each task adds up its own
    documents, Spark adds up the tasks' sums dimension by dimension; the bundles are written
    in alphabetical order, so that only one block of them is on the driver at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("t")).filter("lang is not null and t is not null")
    names = ["lang", "dim", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions)
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():  # the number of documents goes as dimension -1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (dimensions + 1)), pa.array(range(-1, dimensions), pa.int32()), pa.array(np.concatenate([[docs[lang]], total]), pa.int64())], names=names)
            sums.clear()
            docs.clear()

        for batch in sliced(batches):
            keys: dict[str, list[np.ndarray]] = {}
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.setdefault(lang, []).append(space.trigrams(t))
            for lang, parts in keys.items():
                sums[lang] = sums.get(lang, 0) + space.bundle(np.concatenate(parts)).round().astype(np.int64)
                docs[lang] = docs.get(lang, 0) + len(parts)
            if len(sums) > BLOCK_LANGUAGES:
                yield from flush()
        yield from flush()

    sums = written(slim.mapInArrow(run, "lang string, dim int, v bigint").groupBy("lang", "dim").agg(F.sum("v").alias("v")), "language-sums")
    entries = F.sort_array(F.collect_list(F.struct("dim", "v")))
    bundles = sums.groupBy("lang").agg(entries.alias("p")).select("lang", F.col("p.v")[0].alias("docs"), F.slice("p.v", 2, dimensions).alias("p"))
    bundles = written(bundles.repartitionByRange("lang").sortWithinPartitions("lang"), "language-bundles")
    if LEARNED is not None:
        total = bundles.agg(F.sum("docs")).first()[0] or 0
        bundles = bundles.filter(F.col("docs") * LEARNED >= total)
    rest = bundles
    while langs := [r.lang for r in rest.select("lang").orderBy("lang").limit(BLOCK_LANGUAGES).collect()]:
        block = bundles.filter(F.col("lang").between(langs[0], langs[-1]))
        if found := {r.lang: r.p for r in block.select("lang", "p").collect() if any(r.p)}:
            yield found
        rest = bundles.filter(F.col("lang") > langs[-1])


def _nearest(docs: DataFrame, prototypes: dict[str, list[int]], text_col: str, known: tuple[str, str] | None = None) -> DataFrame:
    """Add lang_pred and score, the plain cosine, NO_COSINE where there is none.

    ``known`` names the columns of an earlier block's answer and cosine, which stay unless
    this block has a larger cosine. Cosines that differ by rounding only are equal, so that
    languages with one prototype tie wherever these stand in a block, or in which block.
    """
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    m = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), dimensions)
    m /= np.linalg.norm(m, axis=1, keepdims=True)

    def make():
        space = Space(dimensions)

        def work(texts, *before):
            langs, scores = map(list, before) if before else ([UNKNOWN] * len(texts), [NO_COSINE] * len(texts))
            keys = {i: k for i, t in enumerate(texts) if names and len(k := space.trigrams(t))}
            bundles = [space.bundle(k, damped=True) for k in keys.values()]
            units = np.array([v / (np.linalg.norm(v) or 1.0) for v in bundles]).reshape(len(bundles), dimensions)
            cosines = units @ m.T
            for i, v, row in zip(keys, units, cosines, strict=True):
                k = int((row >= row.max() - SAME_COSINE).argmax())
                score = float(m[k] @ v)  # on its own: equal texts get equal scores, wherever they stand in a batch
                if score > scores[i] + SAME_COSINE:
                    langs[i], scores[i] = names[k], score
            return [langs, scores]

        return work

    fields = [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]
    return add_columns(docs, [text_col, *(known or ())], fields, make)


def _from_0_to_1(answers: DataFrame) -> DataFrame:
    return answers.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")))


def predict(docs: DataFrame, prototypes: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """Add lang_pred and score (cosine with that language's prototype, 0 to 1) to every document.

    A null text, a text without a letter, or a call without prototypes gives ``und`` and
    score 0. Equal cosines go to the language first in alphabetical order. Texts are read
    whole. Repeated rows get equal answers, an empty table an empty result; other columns
    pass and those named like the operator's own are replaced.
    """
    return _from_0_to_1(_nearest(docs, prototypes, text_col))


def held_out(id_col: Column) -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out, then predict every document from its text alone.

    Returns id, held_out, lang_pred and score. A null id isn't held out.
    """
    i, text = F.col(f"`{id_col}`"), unused(docs, "__t")
    slim = docs.select(i.alias(id_col), F.col(f"`{text_col}`").alias(text), held_out(i).alias("held_out"))
    out, known, last = slim, None, None
    with scratch(docs.sparkSession) as keep:
        for block in learn_prototypes(docs.filter(~held_out(i)), text_col, lang_col):
            if known:  # an earlier block's answers are written, so that no stage runs more than one block
                before, last = last, written(out, "language-block")
                if before:
                    discard(docs.sparkSession, [before.table_path])
                out = last
            out, known = _nearest(out, block, text, known), ("lang_pred", "score")
        if last:
            keep(last)
    return _from_0_to_1(out if known else _nearest(slim, {}, text)).drop(text)
