"""Near-duplicate groups from bottom-k sketches of one hash function.

Inverted lists of retained values propose overlaps, the union sketch estimates the
similarity, and full shingle sets decide it. Every list is used rare values first
(a prefix filter), so that a value met everywhere proposes a pair only if the rarer
values leave room for the wanted overlap. Lists longer than ``SHORT_LIST`` are never
expanded into pairs: their members are compared with one centre of the list, and only
members that this leaves outside the list's main group are compared with the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns, joined_by_key, prepare, scratch, sliced, unused, written

SKETCH = 64
SHINGLE_WORDS = 5
SHORT_LIST = 32
#: Members of a longer list that one task compares with the list's centre.
PART_MEMBERS = 1024
#: Keys of rows that go which are broadcast (some 40 bytes each); beyond it the join shuffles.
BROADCAST_GONE = 500_000
#: Standard deviations below the threshold at which a sketch still counts as a candidate.
SLACK = 5.0

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 bytes.

    A-Z is lower-cased; words are runs of other than ASCII white space; fewer words
    than ``width`` make one shingle, none make none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(min(len(h), width)))
        for i in range(min(len(h), width)):
            out = out * _P + h[i : i + n]
            out ^= out >> np.uint64(29)
        out = (out ^ out >> np.uint64(32)) * _Q
        out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, tk (hash of the text), n (size of the shingle set), fp (128-bit digest of the set), sketch (its k smallest hashes)."""

    def make():
        def work(texts):
            sets = [shingle_hashes(t) for t in texts]
            return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s[:k] for s in sets]]

        return work

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("tk"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    fields = [
        ("n", T.LongType(), pa.int64()),
        ("fp", T.BinaryType(), pa.binary()),
        ("sketch", T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    ]
    return add_columns(slim, ["t"], fields, make).drop("t")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nid, n and the whole shingle set of the given nodes, read from one document of each."""
    prepare(docs.sparkSession)
    wanted = nodes.select(F.col("rep.id").alias("rep_id"), F.col("rep.tk").alias("rep_tk"))
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text).alias("tk"), text.cast("binary").alias("t"))
    some = slim.join(wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("tk") == F.col("rep_tk")), "left_semi").select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_hashes(t) for t in batch.column(0).to_pylist()]
            fps = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([fps, pa.array(sets, pa.list_(pa.int64()))], names=["fp", "full"])

    found = some.mapInArrow(run, "fp binary, full array<bigint>")
    one = found.join(nodes.select("nid", "n", "fp"), "fp").groupBy("nid").agg(F.first("n").alias("n"), F.first("full").alias("full"))
    return written(one, "near-sets")


def with_counts(values: DataFrame, name: str) -> DataFrame:
    """The rows whose ``v`` is met more than once, with the number of rows that have it."""
    counts = written(values.groupBy("v").agg(F.count("*").alias(name)).filter(F.col(name) > 1), "near-counts")
    return joined_by_key(values, counts, "v", name)


def pairs_of_short_lists(lists: DataFrame, fits) -> DataFrame:
    """All pairs of lists of at most SHORT_LIST members: a linear number of rows."""
    a = lists.select([F.col(c).alias(f"{c}_a") for c in lists.columns])
    b = lists.select([F.col(c).alias(f"{c}_b") for c in lists.columns])
    on = (F.col("v_a") == F.col("v_b")) & (F.col("nid_a") < F.col("nid_b")) & fits("a", "b")
    return a.join(b, on).select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """nid, label (smallest nid reachable) of every end of the edges (a, b).

    Labels fall to the smallest neighbour's and then jump to their label's label, until
    none changes; each round is written to the shared folder.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("nid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnRenamed("nid", "b"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
        low = labels.join(near, "nid").select("nid", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = low.join(labels.select(F.col("nid").alias("mid"), F.col("label").alias("next")), "mid")
        step = written(jump.select("nid", F.least("mid", "next").alias("label"), (F.least("mid", "next") < F.col("old")).alias("moved")), "near-labels")
        labels = step.select("nid", "label")
        if step.filter("moved").isEmpty():
            return labels


def sketch_pairs(pairs: DataFrame, sets: DataFrame, k: int, least_estimate: float) -> DataFrame:
    """Of candidate pairs (a, b), those whose union sketch doesn't rule them out, with the estimate as ``est``."""
    sk = sets.select("nid", F.slice("full", 1, k).alias("s"))  # full sets are sorted: their first k are the sketch
    with_sk = pairs.distinct().join(sk.toDF("a", "sa"), "a").join(sk.toDF("b", "sb"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    met = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return with_sk.withColumn("est", met / F.size(union)).filter(F.col("est") >= least_estimate).select("a", "b", "est")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the threshold."""
    full = pairs.select("a", "b").join(sets.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("full").alias("fa")), "a").join(
        sets.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("full").alias("fb")), "b"
    )
    both = F.size(F.array_intersect("fa", "fb"))
    return full.withColumn("o", both).filter(F.lit(den + num) * F.col("o") >= F.lit(num) * (F.col("na") + F.col("nb"))).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int, k: int, least_estimate: float, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links enough to connect all that the pairs can connect, with those ``known``, and the labels of their groups.

    First each node meets the partner that its sketch likes best; then only pairs that
    this leaves in different groups are held against each other. A large group of copies
    so ships its sets once or twice a member, not once a pair.
    """
    likely = written(sketch_pairs(pairs, sets, k, least_estimate), "near-likely")
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
    links = verified(best, sets, num, den)
    links = written(links if known is None else links.unionByName(known), "near-links")
    labels = connected(links)
    of = lambda end: labels.select(F.col("nid").alias(end), F.col("label").alias(f"label_{end}"))
    apart = likely.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    tried = best.select("a", "b")
    more = written(verified(apart.join(tried, ["a", "b"], "left_anti"), sets, num, den), "near-links")
    if more.isEmpty():
        return links, labels
    links = links.unionByName(more)
    return links, connected(links)


def _groups(docs: DataFrame, num: int, den: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per input row: id, n, tk (hash of the text), fp, component (smallest id) and first (the smallest id's smallest tk).

    ``first`` is null where a row links with nothing, not even with a copy.
    """
    j = num / den
    # With k values retained, linked documents share fewer than `need` only with odds of about 1e-6.
    need = max(1, int(k * j - SLACK * (k * j * (1 - j)) ** 0.5))
    least_estimate = max(0.0, j - SLACK * (j * (1 - j) / k) ** 0.5)

    base = written(sketched(docs, id_col, text_col, k), "near-base")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "tk")
    nodes = written(
        base.filter("n > 0").groupBy("fp").agg(F.min(place).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("nid", F.monotonically_increasing_id()),
        "near-nodes",
    )

    def ceil_share(n: Column) -> Column:
        return F.call_function("div", n * num + (den - 1), F.lit(den).cast("long"))

    def sizes_fit(a: str, b: str) -> Column:
        x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
        return (x * den >= y * num) & (y * den >= x * num)

    def prefixes(values: DataFrame, total: Column, length: Column, label: str) -> DataFrame:
        """v, nid, n, c (values that another node has too), i (rank of v among those), m (members of the list)."""
        shared = with_counts(values, "df").groupBy("nid").agg(F.first("n").alias("n"), F.first("held").alias("held"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
        room = length - (total - F.size("s"))
        cut = shared.withColumn("room", room).filter("room > 0").select("nid", "n", F.size("s").alias("c"), F.posexplode(F.slice("s", F.lit(1), F.col("room").cast("int"))).alias("i", "x"))
        entries = written(cut.select(F.col("x.v").alias("v"), "nid", "n", "c", "i"), label)
        return written(with_counts(entries, "m"), label)

    held = F.col("held").cast("long")
    by_sketch = prefixes(
        nodes.select("nid", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("v")),
        held,
        held - F.least(F.lit(need).cast("long"), ceil_share(F.col("n"))) + 1,
        "near-lists",
    )
    short = pairs_of_short_lists(by_sketch.filter(F.col("m") <= SHORT_LIST).select("v", "nid", "n"), sizes_fit).distinct()
    short = written(short, "near-pairs")
    crowded = by_sketch.filter(F.col("m") > SHORT_LIST).select("nid").distinct()

    # Members of long lists get a second, exact prefix filter over their full sets.
    ends = short.select(F.col("a").alias("nid")).unionByName(short.select(F.col("b").alias("nid")))
    marked = ends.select("nid", F.lit(0).alias("hot")).unionByName(crowded.select("nid", F.lit(1).alias("hot"))).groupBy("nid").agg(F.max("hot").alias("hot"))
    wanted = written(nodes.drop("sketch").join(marked, "nid"), "near-wanted")
    sets = full_sets(docs, wanted, id_col, text_col)
    hot = sets.join(wanted.filter("hot = 1").select("nid"), "nid", "left_semi")
    total = F.col("n")
    by_set = prefixes(
        hot.select("nid", "n", F.lit(0).alias("held"), F.explode("full").alias("v")),
        total,
        total - ceil_share(total) + 1,
        "near-hot",
    )

    def can_meet(a: str, b: str) -> Column:
        """The overlap left from the first common value on can still reach the threshold."""
        most = F.least(F.col(f"c_{a}") - F.col(f"i_{a}"), F.col(f"c_{b}") - F.col(f"i_{b}"))
        return sizes_fit(a, b) & (most * (den + num) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * num)

    short2 = pairs_of_short_lists(by_set.filter(F.col("m") <= SHORT_LIST).drop("m"), can_meet)
    long_ = by_set.filter(F.col("m") > SHORT_LIST)
    # A long list is dealt in parts of about PART_MEMBERS, each with the centre, so that no task gets a whole one.
    parts = F.call_function("div", F.col("m") + (PART_MEMBERS - 1), F.lit(PART_MEMBERS).cast("long"))
    part, all_parts = F.pmod(F.xxhash64("nid"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    best = F.max_by(F.struct("nid", "n", "c", "i"), F.struct(F.col("c") / F.col("n"), -F.col("nid")))
    centres = long_.groupBy("v").agg(best.alias("x"), F.first("m").alias("m")).select("v", all_parts, "x.*").select([F.col(c).alias(f"{c}_a") for c in ("v", "part", "nid", "n", "c", "i")])
    members = long_.select("*", part).select([F.col(c).alias(f"{c}_b") for c in (*long_.columns, "part")])
    loose = F.least("c_a", "c_b") * (den + num) >= (F.col("n_a") + F.col("n_b")) * num
    stars = centres.join(members, (F.col("v_a") == F.col("v_b")) & (F.col("part_a") == F.col("part_b")) & (F.col("nid_a") != F.col("nid_b")) & sizes_fit("a", "b") & loose)
    stars = stars.select(F.least("nid_a", "nid_b").alias("a"), F.greatest("nid_a", "nid_b").alias("b"))
    links, labels = linked(short.unionByName(short2).unionByName(stars), sets, num, den, k, least_estimate)

    # Members that the centre didn't bring into the list's main group meet the others of the list,
    # those of like size only: sizes in bands a little wider than the threshold differ by one band at most.
    named = long_.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid")).select("*", part)
    tally = named.groupBy("v", "label").agg(F.count("*").alias("q"), F.min("n").alias("low"), F.first("m").alias("m"))
    main = tally.groupBy("v").agg(F.max_by("label", F.struct("q", "label")).alias("main"), F.min("low").alias("low"), F.first("m").alias("m"), F.count("*").alias("groups")).filter("groups > 1")
    named = written(named.join(main.select("v", "main", "low", all_parts), ["v", "part"]).withColumn("band", F.floor(F.log("n") / (math.log(den / num) * 1.000001)) if num < den else F.col("n")), "near-named")
    reach = F.greatest(F.col("low"), ceil_share(F.col("n")))
    outside = named.filter((F.col("label") != F.col("main")) & ((F.col("c") - F.col("i")) * (den + num) >= (F.col("n") + reach) * num))
    outside = outside.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).drop("part").select("*", all_parts)
    cols = ["v", "nid", "n", "c", "i", "label", "main", "band", "part"]
    left, right = outside.select([F.col(c).alias(f"{c}_a") for c in cols]), named.select([F.col(c).alias(f"{c}_b") for c in cols])
    once = (F.col("label_b") == F.col("main_b")) | (F.col("nid_a") < F.col("nid_b"))
    rest = left.join(right, (F.col("v_a") == F.col("v_b")) & (F.col("band_a") == F.col("band_b")) & (F.col("part_a") == F.col("part_b")) & (F.col("label_a") != F.col("label_b")) & can_meet("a", "b") & once)
    rest = written(rest.select(F.least("nid_a", "nid_b").alias("a"), F.greatest("nid_a", "nid_b").alias("b")).distinct(), "near-rest")
    if not rest.isEmpty():
        links, labels = linked(rest, sets, num, den, k, least_estimate, links)

    groups = nodes.select("nid", "fp", "rep").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    named_groups = groups.groupBy("label").agg(F.min("rep").alias("first"))
    by_fp = groups.join(named_groups, "label").select("fp", "first")
    out = base.select("id", "n", "tk", "fp").join(by_fp, "fp", "left")
    return out.withColumn("component", F.when(F.col("first").isNotNull(), F.col("first.id")).otherwise(F.col("id")))


def near_duplicates(
    docs: DataFrame,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SKETCH,
) -> DataFrame:
    """Group documents linked by ``den * |A and B| >= num * |A or B|`` over 5-word shingle sets.

    Returns id, n_shingles, component_id (smallest id reachable, itself included) and
    kept (id = component_id), one row per input row.

    Texts with one shingle set form one node; a node without shingles (null, empty or
    blank text) links with nothing, so each such row is its own component. Rows that
    repeat an id are told apart by their sets. A null id belongs to its group but cannot
    name it; a group of null ids has component_id null and is kept. Very long texts are
    sets like any other. An empty table gives an empty result; other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        out = _groups(docs, num, den, id_col, text_col, k)
        component = F.col("component")
        return keep(written(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")), "near-groups"))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """The documents without the near-duplicates of another: one row of each group stays.

    It is the row with the smallest id (null ids last), of several texts under that id the
    one with the smallest hash, and of rows equal in id and text one: that with the
    smallest hash over all columns. So an id that stays for one text saves no other text
    under it. Rows without shingles (null, empty or blank text) are no one's duplicates:
    all stay. All columns pass as they are; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        rows = _groups(docs, num, den, id_col, text_col, k).filter("n > 0")
        stays = F.struct(F.col("id").isNull().alias("no_id"), "id", "tk") == F.col("first")
        # Of equal texts under one id, several rows may stay up to here.
        gone = rows.groupBy("id", "tk").agg(F.max((~F.coalesce(stays, F.lit(False))).cast("int")).alias("gone"), F.count("*").alias("times")).filter("gone = 1 or times > 1")
        gone = keep(written(gone, "near-gone"))
    few = gone.count() <= BROADCAST_GONE
    i, t, g, n = (unused(docs, x) for x in ("__id", "__tk", "__gone", "__times"))
    gone = gone.select(F.col("id").alias(i), F.col("tk").alias(t), F.col("gone").alias(g), F.col("times").alias(n))
    own = (F.col(i).eqNullSafe(F.col(f"`{id_col}`"))) & (F.col(t) == text_key(F.col(f"`{text_col}`")))
    left = docs.join(F.broadcast(gone) if few else gone, own, "left").filter(F.coalesce(g, F.lit(0)) == 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = left.filter(F.col(n).isNull()).select(*columns)
    again = left.filter(F.col(n).isNotNull()).groupBy(i, t).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return once.unionByName(again)


def oracle(num: int = 85, den: int = 100) -> str:
    """The same groups in DuckDB SQL: all pairs that share a shingle, then reachability."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM w, LATERAL unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sh GROUP BY 1
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {den} * o >= {num} * (p.n + q.n - o)
), r AS (
  SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, e.y FROM r JOIN e ON e.x = r.t
), c AS (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
