"""Sharding, packing, WARC, HTML, token rollups and the pipeline."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import html_text, packing, sharding, warc
from lodestone.llm import token_rollup as tr


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 997])
def test_permutation_is_one(n):
    assert sorted(sharding.permute(i, n, 7) for i in range(n)) == list(range(n))


def test_shards_equal_the_plain_law(spark):
    texts = [None, "", "é", "same", "same", "x" * 200_000] + [f"t{i}" for i in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    got = {r.doc_id: r for r in sharding.assign_shards(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(b) + 8, zlib.crc32(b))
        assert (got[i].shard, got[i].slot) == sharding.locate(i, len(texts), 24)
    plan = sharding.assign_shards(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_shards_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a")] * 40 + [(None, "b"), (None, None), (2, "")], "doc_id long, text string")
    rows = sharding.assign_shards(df, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 43 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign_shards(df.limit(0)).count() == 0


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_are_the_best():
    rng = random.Random(1)
    for _ in range(60):
        histogram = {rng.randrange(1, 40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        k = rng.randrange(1, 5)
        top = max(histogram)
        best = min(padding(histogram, [*c, top]) for m in range(k) for c in itertools.combinations([x for x in histogram if x != top], m))
        found = packing.best_boundaries(histogram, k)
        assert len(found) <= k and padding(histogram, found) == best
    assert packing.best_boundaries({}, 4) == []


def test_packing_equals_brute_force(spark):
    """Every row of the result from its definition: pieces, best of all divisions into buckets, places in hash order."""
    rng = random.Random(4)
    docs = [(rng.choice([i, i % 20, None]), rng.choice([None, 0, 1, 3, 7, 12, 13, 25, 40, 90])) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, n long").withColumn("text", F.lit("x"))
    got = sorted((tuple(r) for r in packing.pack(df, F.col("n"), max_len=13, buckets=3, batch_tokens=30, seed=5).collect()), key=repr)
    pieces = []
    for i, n in docs:
        n = n or 0
        for k in range(max(1, -(-n // 13))):
            pieces.append((i, k, k * 13, min(13, n - k * 13)))
    lengths = sorted({p[3] for p in pieces if p[3]})
    pad = lambda bounds: sum(min(b for b in bounds if b >= p[3]) - p[3] for p in pieces if p[3])
    bounds = min((c for k in (1, 2, 3) for c in itertools.combinations(lengths, k) if c[-1] == lengths[-1]), key=lambda c: (pad(c), len(c)))
    hashes = {(r.doc_id, r.k): r.h for r in spark.createDataFrame(pieces, "doc_id long, k long, s long, n long").select("doc_id", "k", F.xxhash64(F.lit(5), "doc_id", "k").alias("h")).collect()}
    want = [(i, k, s, n, None, None, None, None, None) for i, k, s, n in pieces if not n]
    for b, bound in enumerate(bounds):
        inside = sorted((p for p in pieces if p[3] and min(x for x in bounds if x >= p[3]) == bound), key=lambda p: (hashes[p[:2]], p[0] is not None, p[0] or 0, p[1], 0))
        each = max(1, 30 // bound)
        want += [(*p, b, bound, at // each, at % each, bound - p[3]) for at, p in enumerate(inside)]
    # Rows equal in id and piece are interchangeable: compare lengths and places apart where they are.
    blur = lambda rows: sorted(((r[4:8], r[0], r[1]) for r in rows), key=repr)
    assert blur(got) == blur(want)
    assert sorted((r[:6] for r in got), key=repr) == sorted((r[:6] for r in want), key=repr) and sum(r[8] or 0 for r in got) == pad(bounds)


def test_packing_keeps_every_token(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randrange(0, 90) for _ in range(150)] + [None, "", " \n", "long " * 1000, "w " * 10, "w " * 10]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string")
    rows = packing.pack(df, max_len=64, buckets=4, batch_tokens=256).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.start == r.piece * 64 and (r.bucket is None) == (r.length == 0)
    assert total == {i if i != 3 else None: len((t or "").split()) for i, t in enumerate(texts)}
    batches = {}
    for r in rows:
        if r.bucket is not None:
            assert r.length <= r.bucket_len and r.padding == r.bucket_len - r.length
            batches.setdefault((r.bucket, r.bucket_len, r.batch), []).append(r.slot)
    for (b, size, n), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * size <= max(256, size)
        if (b, size, n + 1) in batches:
            assert len(slots) == 256 // size
    assert packing.pack(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(5)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(9), i) for i in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


TRICKY = "x" * 1100 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/1.1\r\n"


@pytest.mark.parametrize("groups", [100_000, 0])
def test_archives_come_back(spark, monkeypatch, groups):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    rows = [(1, "http://b.org/x", TRICKY), (2, None, None), (3, "u v\n", TRICKY), (None, "u", "WARC/1.1\r\nWARC/1.1\r\n"), (5, "http://www.a.com/q?1", "é" * 600), (6, "http://a.com:80/q?1", "é" * 600), (6, "http://a.com", "é" * 600), (7, "z", "s" * 999), (8, "z", "s" * 999), (9, "z", "y" * 400_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()), key=repr)
    keeper = {TRICKY: 3, "é" * 600: 6}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = keeper[h] if h in keeper and keeper[h] != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", again))
    assert got == sorted(want, key=repr)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_captures_are_in_global_order(spark):
    rows = [(i, f"http://h{i % 7}.com/{i % 11}", f"p{i}") for i in range(400)] + [(1000 + i, "http://hot.com/", "q") for i in range(300)]
    merged = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("merge_part", "merge_pos").collect()
    keys = [(r.url_key, r.capture_time, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 700


def test_archives_are_plain_warc(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a/", "hé")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", F.timestamp_seconds(F.lit(0)))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    head, body = data.split(b"\r\n\r\n", 1)
    size = int(head.split(b"Content-Length: ")[1])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and body[size:] == b"\r\n\r\n" and body[:size].endswith("hé".encode())


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header>Site</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><article><header><h1>Head&eacute;</h1><p>By X</p></header><p>One <b>t</b>wo &amp; three<br>four
<p>five<script>var x="</p>"</script><div class="ad">Buy</div><form>Mail</form><section id="comments"><p>Nice!</p></section><ul><li>a<li>b</ul></article><footer>End</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Headé One two & three four five a b"
    assert html_text.main_text('<body><div id="menu">m</div><div class="post-content"><p>x<p>y</div><div class="comments">c</div>') == "x y"
    assert html_text.main_text("<main><p>in</p></main><p>out</p>") == "in"
    assert html_text.main_text("plain &lt;text&gt; <unclosed") == "plain <text> <unclosed"
    assert html_text.main_text("<article></article><p>fall back</p>") == "fall back"
    for odd in (None, "", "<", "<!-- x", "<script>x", "</p></p>", "<p " * 2000):
        html_text.main_text(odd)
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_captures_stand_where_the_index_says(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h{i % 3}.org/{i % 7}", "x" * (i * 37 % 400) + ("WARC/1.1\r\nin a payload" if i % 5 == 0 else ""), "d", "b", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string, b string, payload int").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/w", F.timestamp_seconds(F.col("page_id")))
    found = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(found) == 60
    for r in found:
        with gzip.open(tmp_path / "w" / r.run) as f:
            record = f.read()[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(rows[r.page_id][2].encode()) and f"<urn:page:{r.page_id}>".encode() in record


def test_merge_of_runs_in_pieces(spark, monkeypatch):
    """Runs handed over in disordered pieces, read few rows at a time, still give the global order."""
    monkeypatch.setattr(warc, "RUN_ROWS", 3)
    rng = random.Random(12)
    rows = [(i, 1, "d", "response", None, rng.choice([None, "a", "b", "c"]), f"2024-01-{rng.randrange(1, 28):02}", 0, 1, f"run{rng.randrange(4)}") for i in range(300)]
    df = spark.createDataFrame(rows, warc.CAPTURE + ", run string").repartition(5)
    got = [(r.url_key, r.capture_time, r.page_id) for r in warc.merge_runs(df.sortWithinPartitions("run", "url_key", "capture_time", "page_id")).orderBy("merge_part", "merge_pos").collect()]
    key = lambda x: (x[0] is not None, x[0] or "", x[1], x[2])
    assert got == sorted(((r[5], r[6], r[0]) for r in rows), key=key)
    shuffled = warc.merge_runs(df).orderBy("merge_part", "merge_pos").collect()
    assert [(r.url_key, r.capture_time, r.page_id) for r in shuffled] == got


def test_frequent_texts_are_spread(spark, tmp_path, monkeypatch):
    from lodestone.llm import shared

    df = spark.createDataFrame([(i, None if i % 3 else "same", "s", "en") for i in range(90)] + [(90, "other", "s", "en")], "doc_id long, text string, source string, lang string")
    plain = sorted(map(tuple, tr.corpus_rollup(df).collect()))
    monkeypatch.setattr(shared, "HEAVY_ROWS", 5)
    assert sorted(map(tuple, tr.corpus_rollup(df).collect())) == plain and plain[0][3] == 3


@pytest.mark.parametrize("tag", ["svg", "math", "object", "canvas", "select", "iframe"])
def test_embedded_elements_swallow_no_text(tag):
    one = lambda x: html_text.main_text(f"<article><p>one</p>{x}<p>two</p></article><p>out</p>")
    assert one(f'<{tag} viewBox="0 0 1 1"/>') == one(f"<{tag}>") == one(f"<{tag}><{tag} aria-hidden='true'>") == "one two"
    assert one(f"<{tag}><b>in</b><path d='1'/>in</{tag}>") == one(f"<{tag}/>a<{tag}>in</{tag}>").replace(" a ", " ") == "one two"
    assert html_text.main_text(f"<p>one <{tag} x='/'>in</{tag}> two") == html_text.main_text(f"<p>one <{tag}/> two") == "one two"
    assert html_text.main_text(f"<div><{tag}>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("hosts", [10_000, 0])
def test_site_template_goes(spark, monkeypatch, hosts):
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", hosts)
    page = lambda i: f"<body><div><p>Welcome to the site</p></div><div><p>Story {i} text</p></div><div>Terms apply</div></body>"
    rows = [(i, f"http://h.com/{i}", page(i), "clash") for i in range(12)] + [(100, "http://other.com/", page(100), ""), (101, None, None, ""), (102, "x", "", "")]
    rows += [(200 + i, f"http://c.com/{i}", "<article><p>Same article</p></article>", "") for i in range(8)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3] == ("Story 3 text", 12) and got[101] == ("", 0) == got[102]
    assert got[100][0] == "Welcome to the site Story 100 text Terms apply" and got[205][0] == "Same article"


def test_copied_articles_without_article_tags_stay(spark):
    article = "<div><h1>Long title</h1><p>A first paragraph of the copied article.</p><p>And a second one.</p></div>"
    bare = article.removeprefix("<div>").removesuffix("</div>")
    own = "".join(f"<p>Text of its own, number {{0}}, in {w} words.</p>" for w in ("some", "more"))
    pages = [("copy", f"<body>{article}</body>")] * 8 + [("foot", f"<body>{article}<footer>Day {i}</footer></body>") for i in range(8)]
    pages += [("rest", f"<body>{article}<div>Day {i}</div></body>") for i in range(8)] + [("bare", f"<body>{bare}<p>Day {i}</p></body>") for i in range(8)]
    pages += [(None, f"<p>{i}</p>{article}") for i in range(8)]
    pages += [("rest", f"<body><div>Welcome to us</div>{own.format(i)}<div>Terms apply</div></body>") for i in range(12)]
    rows = [(i, host and f"http://{host}.com/{i}", html) for i, (host, html) in enumerate(pages)]
    text = "Long title A first paragraph of the copied article. And a second one."
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        if r.page_id < 40:
            assert text in r.text, rows[r.page_id]
        else:
            assert r.text.startswith("Text of its own") and r.text.endswith("in more words.")


def test_template_counts_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"h{rng.randrange(3)}", "".join(f"<div>{rng.choice('abcdef')}</div>" for _ in range(4))) for _ in range(60)]
    got = {(r.host, h) for r in html_text.site_templates(spark.createDataFrame(rows, "host string, html string")).collect() for h in r.templates}
    counts, pages = {}, {}
    for host, html in rows:
        pages[host] = pages.get(host, 0) + 1
        root = html_text.tree_of(html)
        html_text.hashed(root)
        for h in html_text.candidates(root):
            counts[host, h] = counts.get((host, h), 0) + 1
    assert got == {k for k, n in counts.items() if n >= 4 and n >= 0.2 * pages[k[0]]}


def test_token_counts_and_rollup(spark, tmp_path):
    import base64

    vocabulary = tmp_path / "v"  # bytes and one merge
    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256")
    texts = ["ab", "abab c", "", None, "ab", "é", "ab " * 40_000]
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, tokens int")
    counted = {r.doc_id: r.n_tokens for r in tr.count_tokens(df, str(vocabulary)).collect()}
    assert counted == {0: 1, 1: 4, 2: 0, 3: 0, 4: 1, 5: 2, 6: 80_000}
    totals = {(r.source, r.lang): (r.docs, r.tokens) for r in tr.corpus_rollup(df, str(vocabulary)).collect()}
    assert totals == {(None, "en"): (3, 1 + 0 + 80_000 + 3), ("s", "en"): (3, 4 + 0 + 2 + 3)}
    assert tr.corpus_rollup(df.limit(0), str(vocabulary)).count() == 0


def test_packing_query_counts_tokens(spark, sf_dir):
    from lodestone.llm import catalog

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.n_tokens for r in tr.count_tokens(docs).collect()}
    got = {}
    for r in catalog.op10_packing(spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.length <= packing.MAX_LEN
    assert got == want


def test_long_runs_of_blanks(monkeypatch):
    import base64
    import re

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tr.VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=tr.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert tr.count_of(encoding, "a" + " " * 1_000_000 + "b") > 1000
    texts = [f(t) for t in (x for x in ["a" + " " * 40 + "b", "a" + "\n" * 33 + "b", " " * 50, "x" + "\t" * 30 + "y  z" + "\u3000" * 25 + "\n7"]) for f in (str, lambda t: t + "  ")]
    plain = [len(encoding.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(tr, "LONG_RUN", re.compile(tr.LONG_RUN.pattern.replace("4096", "20")))
    assert [tr.count_of(encoding, t) for t in texts] == plain


def test_commits_are_idempotent_and_additive(spark, tmp_path):
    counts = spark.createDataFrame([(i, "s", "en", "v1", 10 * i) for i in range(5)] + [(4, "s", "en", "v1", None)], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    rollup = tr.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", tr.inserts(counts)) and not rollup.commit("a", tr.inserts(counts))
    revised = counts.filter("doc_id > 1").withColumn("tokenizer", F.when(F.col("doc_id") == 2, "v2").otherwise("v1"))
    rollup.commit("b", tr.changes(counts, revised))
    want = {("v1", 3, 70), ("v2", 1, 20)}
    assert {(r.tokenizer, r.docs, r.tokens) for r in rollup.totals().collect()} == want
    (tmp_path / "r" / "c").mkdir()  # a batch that never finished doesn't count
    rollup.compact("base")
    assert {(r.tokenizer, r.docs, r.tokens) for r in rollup.totals().collect()} == want and rollup.committed() == ["base"]
    assert not rollup.commit("a", tr.inserts(counts)) and not rollup.compact("base")  # compacted ids stay known
    for bad in ("../x", "_x", ""):
        with pytest.raises(ValueError):
            rollup.commit(bad, tr.inserts(counts))


def test_compaction_that_breaks_off(spark, tmp_path):
    import shutil

    counts = spark.createDataFrame([("s", "en", "v1", 5), ("s", None, "v1", None)], "source string, lang string, tokenizer string, n_tokens long")
    rollup, root = tr.Rollup(spark, f"file://{tmp_path}/r"), tmp_path / "r"
    total = lambda: sorted((r.docs, r.tokens) for r in rollup.totals().collect())
    rollup.commit("a", tr.inserts(counts))
    rollup.commit("b", tr.inserts(counts))
    shutil.copytree(root / "a", tmp_path / "a")
    rollup.compact("base")
    shutil.copytree(tmp_path / "a", root / "a")  # as if it ended before removing this one
    assert total() == [(2, 0), (2, 10)] and not rollup.commit("a", tr.inserts(counts))
    assert not rollup.compact("base") and not (root / "a").exists() and total() == [(2, 0), (2, 10)]
    (root / "base2").mkdir()  # as if it ended while writing the totals
    (root / "_replaced" / "base2").write_text("base")
    assert total() == [(2, 0), (2, 10)]
    assert rollup.commit("base2", tr.deletes(counts)) and total() == [(1, 0), (1, 5)]
    assert rollup.compact("base3") and total() == [(1, 0), (1, 5)] and rollup.committed() == ["base3"]
    assert not any(rollup.commit(b, tr.inserts(counts)) for b in ("a", "b", "base", "base2"))


def test_rollup_of_the_tables(spark, sf_dir):
    import duckdb

    from lodestone.llm import catalog

    got = catalog.op1_token_rollup(spark, sf_dir).agg(F.sum("docs")).first()[0]
    assert got == duckdb.sql(f"SELECT count(DISTINCT text) FROM '{sf_dir}/documents.parquet'").fetchall()[0][0]


def test_stages_of_the_pipeline(spark, sf_dir):
    """Each stage against the operator's own decisions on the rows it got, and odd rows throughout."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(90001, None, None, None, None), (None, "", "en", "s", 0), (90002, "word " * 30_000, None, "s", 1), (90003, "dup dup", "xx", None, 7), (90003, "dup dup", "xx", None, 7)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            break
        assert out.columns == corpus_pipeline.COLUMNS
        rows = out.collect()
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir):
    """run() against the plain versions of its stages, one after the other, in Python."""
    from test_near_dedup import brute
    from test_text_operators import brute_contamination, brute_quality, brute_whole_copies

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(i, t) for (i, t, _), verdict in zip(docs, brute_quality(docs)) if verdict[3]]
    plain = brute_whole_copies(kept, 0.5)
    texts = {i: plain[i, t][0] for i, t in kept}
    groups = brute(sorted(texts.items()), 80, 100)
    left = {i: t for i, t in texts.items() if groups[i][1] == i}
    assert len(left) < len(texts) < len(docs) and all(t.split() for t in left.values())
    windows = {tuple(w[p : p + 10]) for _, t in items for w in [_words(t)] for p in range(max(1, len(w) - 9))}
    assert all(len(w) == 10 for w in windows)
    clean = {i: t for i, t in left.items() if not any(tuple(w[p : p + 10]) in windows for w in [_words(t)] for p in range(len(w) - 9))}
    assert brute_contamination("", [])[1] == 0
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=tr.PATTERN, mergeable_ranks=tr.ranks_of(open(tr.VOCABULARY, "rb").read()), special_tokens={})
    assert got == {i: len(encoding.encode_ordinary(t)) for i, t in clean.items()}


def test_copies_reach_the_near_duplicate_stage_whole(spark, sf_dir):
    """No text is emptied on the way, and no near copy of a kept document is left as a remnant."""
    from test_near_dedup import brute

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf_dir).cache()
    lines = stages["line dedup"](spark, kept, sf_dir).cache()
    left = {r.doc_id for r in stages["near-duplicates"](spark, lines, sf_dir).collect()}
    assert lines.count() == kept.count() and lines.filter("trim(text) = ''").isEmpty()
    groups = brute([(r.doc_id, r.text) for r in kept.collect()], 80, 100)
    copies = {i for i, (_, c) in groups.items() if i != c}
    assert len(copies) >= 10 and len(copies & left) <= 1 + 0.05 * len(copies)  # a copy may lose less than half of its words to passages and be like the first no more


def _words(t):
    from test_text_operators import WORD, lower

    return WORD.findall(lower(t))
