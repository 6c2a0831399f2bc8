"""WARC archives: writing, reading back, and an external merge of their sorted indexes.

Spark's text writer makes the archives: with the record separator as line end, every row
is one record, and the commit protocol keeps lost executors harmless. Each archive yields
a run of captures sorted by URL key and time; range partitions of all runs are merged by a
loser tree into one global order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh_path, prepare, scratch, sliced, unused, written

REVISIT_BYTES = 1000
RECORDS_A_FILE = 4000
#: Captures that one merge task holds.
MERGE_ROWS = 100_000
#: Captures of one run that a merge turns into keys at a time.
RUN_ROWS = 1024
#: Groups of equal payloads that are broadcast (some 60 bytes each); beyond it the join shuffles.
BROADCAST_GROUPS = 100_000
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
EPOCH = 1704067200


def plan_records(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Add payload (null: empty), payload_bytes, payload_digest and refers_to.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the largest id is stored, and
    others refer to it. Only digests and ids are grouped; payloads move only if the groups
    are too many to broadcast.
    """
    own = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    own_id = F.col(f"`{id_col}`")
    page = pages.withColumn("payload", own).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    d, b, keeper = names = [unused(page, n) for n in ("__digest", "__bytes", "__keeper")]
    large = page.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy(F.col("payload_digest").alias(d), F.col("payload_bytes").alias(b))
    groups = written(large.agg(F.max(own_id).alias(keeper), F.count("*").alias("c")).filter("c > 1").drop("c"), "warc-groups")
    few = groups.count() <= BROADCAST_GROUPS
    met = page.join(F.broadcast(groups) if few else groups, (F.col("payload_digest") == F.col(d)) & (F.col("payload_bytes") == F.col(b)), "left")
    return met.withColumn("refers_to", F.when(F.col(keeper) != F.coalesce(own_id, F.lit(-1)), F.col(keeper))).drop(*names)


def record_text(url: Column, time: Column, page: Column) -> Column:
    """A record without the separator that ends it; needs the columns of ``plan_records``."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7f]", "%20")
    line = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    again = F.col("refers_to").isNotNull()
    body = F.when(again, http).otherwise(F.concat(http, "payload"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))
    head = [
        F.lit(VERSION + "WARC-Type: "), F.when(again, "revisit").otherwise("response"), line,
        F.lit("WARC-Record-ID: "), name, line,
        F.lit("WARC-Date: "), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), line,
        F.lit("WARC-Target-URI: "), clean, line,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), line,
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
    ]
    return F.concat(*head, F.lit(END), body)


def write_archives(pages: DataFrame, path: str, time: Column, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> None:
    """Write one record per page into gzipped WARC files of at most ``RECORDS_A_FILE`` records; other columns are left out."""
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), time.alias("time"))
    records = plan_records(slim, "html", "id").select(record_text(F.col("url"), F.col("time"), F.col("id")).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


class Reader:
    """Puts records together from the pieces between version lines, by their declared lengths."""

    def __init__(self) -> None:
        self.file, self.open = None, b""
        self.need = -1
        self.at = self.start = 0

    def feed(self, file: str, piece: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Records that end in the piece: without their version line, with their place and length (with it) in the unpacked file."""
        if file != self.file:
            if self.open.strip(b"\r\n"):
                raise ValueError(f"{self.file} ends inside a record")
            self.file, self.open, self.need, self.at = file, b"", -1, 0
            if not piece:  # what stands before the first version line
                return
        elif self.open:
            self.open += VERSION.encode()  # the version line stood inside a payload
        if not self.open:
            self.start = self.at
        self.at += len(VERSION) + len(piece)
        self.open += piece
        if self.need < 0 and (cut := self.open.find(b"\r\n\r\n")) >= 0:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", self.open[:cut])
            if length is None:
                raise ValueError(f"{file}: a record without a length")
            self.need = cut + 4 + int(length[1])
        if 0 <= self.need <= len(self.open):
            record, self.open, self.need = self.open[: self.need], b"", -1
            yield record, self.start, len(VERSION) + len(record)


def parse(record: bytes) -> dict:
    """The fields of one record; digest and size are those of the payload itself where it is stored."""
    head, body = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    http, payload = body.split(b"\r\n\r\n", 1)
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    if kind == "response":
        size, declared, digest = len(payload), digest, hashlib.sha1(payload).hexdigest()
        if digest != declared:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what was archived")

    def page(name: str) -> int | None:
        text = fields.get(name, "<urn:page:null>")[10:-1]
        return None if text == "null" else int(text)

    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "url_key": url_key(fields.get("WARC-Target-URI", "")), "capture_time": fields["WARC-Date"]}


def url_key(url: str) -> str:
    """Host labels in reverse, then the rest: captures of a site sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I | re.S)
    if not m:
        return url
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


CAPTURE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, capture_time string, offset bigint, length bigint"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "offset", "length"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def read_archives(spark, path: str) -> DataFrame:
    """The captures of all archives, each archive a locally sorted run (column run).

    offset and length say where a record stands in its unpacked archive, version line included.
    """
    prepare(spark)
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("_metadata.file_name").alias("run"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in sliced(batches):
            rows, runs = [], []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for record, offset, length in reader.feed(name, piece):
                    rows.append(parse(record) | {"offset": offset, "length": length})
                    runs.append(name)
            arrays = [pa.array([r[n] for r in rows], t) for n, t in zip(NAMES, TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(runs, pa.string())], names=[*NAMES, "run"])

    captures = pieces.mapInArrow(run, CAPTURE + ", run string")
    return captures.sortWithinPartitions("run", "url_key", "capture_time", "page_id")


class LoserTree:
    """Merges k sorted sequences with about log2 k comparisons an item.

    Inner nodes hold the losers of their matches, the root the winner; a drained sequence
    loses against all others, and equal items leave in the order of their sequences.
    """

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._settle(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _settle(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._settle(w)


def merge_runs(captures: DataFrame) -> DataFrame:
    """All captures in the global order of url_key, capture_time and page_id.

    Ranges of that order are cut across all runs, so that a URL with very many captures is
    divided by time; each task merges the runs' parts of its range, which it holds as Arrow
    columns of about ``MERGE_ROWS`` captures and reads ``RUN_ROWS`` of a run at a time.
    Nothing is sorted again: where a shuffle hands over the parts of a run out of order,
    each rising part is a run of its own. merge_part and merge_pos give the order. Null
    keys come first.
    """
    spark = captures.sparkSession
    prepare(spark)
    stored = written(captures, "warc-runs")
    parts = max(1, -(-stored.count() // MERGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored.repartitionByRange(parts, "url_key", "capture_time", "page_id").withColumn("merge_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()

        def keys(start: int, stop: int) -> Iterator[tuple]:
            for at in range(start, stop, RUN_ROWS):
                part = table.slice(at, min(RUN_ROWS, stop - at))
                columns = [part.column(n).to_pylist() for n in ("url_key", "capture_time", "page_id")]
                for i, (u, t, p) in enumerate(zip(*columns, strict=True), at):
                    yield (u is not None, u or ""), t, (p is not None, p or 0), i

        runs, names = [], table.column("run")
        start, last, name = 0, None, None
        for key in keys(0, table.num_rows):
            i = key[-1]
            own = names[i].as_py()
            if last is not None and (own != name or key < last):
                runs.append(keys(start, i))
                start = i
            last, name = key, own
        runs.append(keys(start, table.num_rows))
        rows, place = [], 0

        def merged() -> pa.RecordBatch:
            out = table.take(pa.array(rows, pa.int64())).append_column("merge_pos", pa.array(range(place, place + len(rows)), pa.int64()))
            return out.combine_chunks().to_batches()[0]

        for x in LoserTree(runs):
            rows.append(x[-1])
            if len(rows) == 4096:
                yield merged()
                place += len(rows)
                rows = []
        if rows:
            yield merged()

    return ranged.mapInArrow(run, CAPTURE + ", run string, merge_part int, merge_pos bigint")


def archive_round_trip(pages: DataFrame, time: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every page, read the archives back and merge their indexes.

    ``time`` is the capture time, by default a second a page id from 2024 on. Returns
    page_id, payload_bytes and payload_digest (SHA-1 of the full payload), record_type,
    refers_to, url_key, capture_time, offset, length, run, merge_part and merge_pos, one row per page.

    Null html is an empty payload; a null id is archived as such, is never referred to by
    others unless no id is known, and comes back null; a null url has the key ''; control
    characters and blanks in urls are escaped. Payloads that hold record marks come back
    whole. Rows that repeat an id are archived each. Equal payloads under the storing id
    are all stored. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    when = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0))) if time is None else time
    path = fresh_path(spark, "warc")
    with scratch(spark) as keep:
        write_archives(slim, path, when)
        merged = keep(written(merge_runs(read_archives(spark, path)), "warc-index"))
    discard(spark, [path])  # the round trip's archives; write_archives leaves them to the caller
    return merged


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
