import struct

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import chunkers, extract, grammar
from lodestone.operators import relations
from lodestone.sources import discovery, sinks
from lodestone.streaming import incremental


def test_break_points_and_fences():
    assert chunkers.best_cut([(400, 90), (800, 20)], [], 800, 800) == 400
    assert chunkers.best_cut([(100, 20), (200, 90), (300, 20)], [(150, 250)], 400, 800) == 300


@pytest.mark.parametrize("cut", [chunkers.chunk_markdown, lambda t: chunkers.chunk_markdown(t, 1000, 100), chunkers.chunk_plain, chunkers.chunk_headers])
def test_chunkers_end_and_cover(cut):
    for text in ("a" * 10000, "word " * 3000, "\n".join(f"line {i}" for i in range(900)), "", " \n"):
        chunks = cut(text)
        assert bool(chunks) == bool(text.strip())
        if "line 899" in text:
            assert all(any(f"line {i}\n" in c.content or c.content.endswith(f"line {i}") for c in chunks) for i in range(0, 900, 7))


def test_headings():
    c = chunkers.chunk_markdown("# Main Title\nx\n## Sub Section\ny\n### Deep Section\nz\n")
    assert (c[0].heading, c[0].parent) == ("Deep Section", "Sub Section")


def test_json_yaml_markup():
    assert [c.key_path for c in chunkers.chunk_json('{"a": {"b": "%s", "c": "// no"}, // x\n "d": [1,],}' % ("x" * 3000))] == ["a.b", "a.c", "d"]
    assert [c.key_path for c in chunkers.chunk_yaml("a: 1\nb:\n  c: 2\n")] == ["a", "b"]
    assert len(chunkers.chunk_yaml("x: !odd 3")) == 1
    assert chunkers.visible_text("<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\nc"


def test_code_chunks_keep_definitions_whole():
    kinds = [(c.kind, c.start_line, c.end_line) for c in chunkers.chunk_code("import a\nimport b\n\ndef f():\n    return 1\n\nX = 2\n", "python")]
    assert kinds == [("merged", 1, 2), ("definition", 4, 5), ("merged", 7, 7)]
    assert chunkers.chunk_code("def (", "python")[0].kind == "module"


def test_event_extraction():
    ts = extract.extract("typescript", "bus.on('ready', f)\nbus.emit('ready')\n")
    assert [(r[1], r[2]) for r in ts.refs] == [("ready", "registers_on"), ("ready", "fires")]
    php = extract.extract("php", "<?php\nadd_action('init', 'f');\napply_filters('title', $x);\n")
    assert [(r[1], r[2], r[4]) for r in php.refs] == [("init", "registers_on", "action"), ("title", "fires", "filter")]
    py = extract.extract("python", "def f():\n    post_save.connect(h)\n    post_save.send(x)\n")
    assert [(r[1], r[2]) for r in py.refs] == [("post_save", "registers_on"), ("post_save", "fires")]
    assert grammar.doc_types("* @param {Foo|string} x") == ["Foo"]


@pytest.mark.parametrize("language,source,names", [
    ("go", "package m\ntype T struct {\n}\nfunc (t *T) Run() {\n  help()\n}\nfunc main() {\n}\n", {("T", "class"), ("Run", "method"), ("main", "function")}),
    ("swift", "protocol P {}\nclass C: Base, P {\n  func go() {\n    run()\n  }\n}\n", {("P", "interface"), ("C", "class"), ("go", "method")}),
    ("ruby", "class Dog < Animal\n  include Loud\n  def bark\n    speak()\n  end\nend\n", {("Dog", "class"), ("bark", "method")}),
])
def test_patterned_languages(language, source, names):
    found = extract.extract(language, source)
    assert {(s[0], s[1]) for s in found.symbols if s[1] != "module"} == names
    assert {r[2] for r in found.refs} >= {"calls"}


def test_discovery_and_ignore_rules(spark, tmp_path):
    for name in ("a.py", "src/b.ts", "node_modules/c.js", ".hidden/d.py", ".env.local", "doc.md", "keep/secret.txt", "x.d.ts", "logs/run.log"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    found = {r.path: r.route for r in discovery.discover(spark, f"file://{tmp_path}", ["!keep/secret.txt"]).collect()}
    assert found == {"a.py": "code", "src/b.ts": "code", "doc.md": "markdown"}


def test_image_dimensions(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 10
    gif = b"GIF89a" + struct.pack("<HH", 20, 10) + b"\0" * 20
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -15) + b"\0" * 8
    w, h = discovery.dimensions(F.col("c"))
    rows = spark.createDataFrame([(1, png), (2, gif), (3, bmp), (4, b"")], "i int, c binary").select("i", w.alias("w"), h.alias("h")).orderBy("i").collect()
    assert [(r.w, r.h) for r in rows] == [(640, 480), (20, 10), (30, 15), (None, None)]
    assert discovery.jpeg_dimensions(b"\xff\xd8\xff\xc4\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8) == (9, 7)


def test_formats_and_names(spark):
    df = spark.createDataFrame([(0, "b/x.py", 'q"1'), (1, "a/y.py", None), (2, "b/x.py", "z")], "rank int, path string, v string")
    assert [r.line for r in sinks.formatted(df, "files", "rank").orderBy("__order").collect()] == ["b/x.py", "a/y.py"]
    assert sinks.formatted(df, "nonsense", "rank", ["v"]).orderBy("__order").first().line == '{"v":"q\\"1"}'
    assert tx.name_variants("load user") == 'load user OR "load-user" OR "loadUser" OR "load_user"'
    m = spark.createDataFrame([("", "root"), ("b", "pkg")], "folder string, name string")
    assert {r.path: r.package for r in discovery.package_names(df.select("path").distinct(), m).collect()} == {"b/x.py": "pkg", "a/y.py": "root"}


def test_cascade_leaves_unresolved_references(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    symbols = spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long")
    refs = spark.createDataFrame([(1, 10, 20), (2, 20, 10)], "ref_id long, from_id long, to_id long")
    edges = spark.createDataFrame([(10, 20), (20, 20)], "src long, dst long")
    out = relations.delete_files(files, spark.createDataFrame([("a",)], "path string"), symbols, refs, edges, symbols)
    assert [tuple(r) for r in out["refs"].collect()] == [(2, 20, None)]
    assert [tuple(r) for r in out["edges"].collect()] == [(20, 20)]


def test_stream_merges_batches(spark, tmp_path):
    schema = "id long, v string, deleted boolean"
    src = tmp_path / "in"
    for i, rows in enumerate([[(1, "a", False), (2, "b", False)], [(1, None, True), (3, "c", False), (2, "B", False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{src}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{src}")
        incremental.merge_batches(spark, stream, f"file://{tmp_path}/out", ["id"], f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/v2").collect()) == [(2, "B"), (3, "c")]


@pytest.mark.parametrize("language,source,names,refs", [
    ("rust", "use std::io;\npub struct Dog {\n    age: u8,\n}\npub trait Loud: Base {\n    fn shout(&self);\n}\nimpl Loud for Dog {\n    pub fn shout(&self) {\n        help();\n    }\n}\nasync fn main() {\n}\n",
     {("", "import"), ("Dog", "class"), ("Loud", "interface"), ("shout", "method"), ("main", "function")}, {("Loud", "implements"), ("Base", "extends"), ("help", "calls")}),
    ("java", "import java.util.List;\npublic class Dog extends Animal implements Loud, Fast {\n    public List<String> bark(int n) throws Oops {\n        return help(n);\n    }\n}\ninterface Loud {\n}\n",
     {("", "import"), ("Dog", "class"), ("bark", "method"), ("Loud", "interface")}, {("Animal", "extends"), ("Loud", "implements"), ("Fast", "implements"), ("help", "calls")}),
    ("csharp", "using System;\npublic class Dog : Animal, ILoud\n{\n    public async Task<int> Bark(int n)\n    {\n        Help(n);\n    }\n}\n",
     {("", "import"), ("Dog", "class"), ("Bark", "method")}, {("Animal", "extends"), ("ILoud", "implements"), ("Help", "calls")}),
    ("kotlin", "import a.b\ndata class Dog(val age: Int) : Animal(age), Loud {\n    override fun bark() {\n        help()\n    }\n}\nfun main() {\n}\n",
     {("", "import"), ("Dog", "class"), ("bark", "method"), ("main", "function")}, {("Animal", "extends"), ("Loud", "implements"), ("help", "calls")}),
    ("c", "#include <stdio.h>\nstruct dog {\n    int age;\n};\nstatic int bark(struct dog *d) {\n    help(d);\n    return 0;\n}\n",
     {("", "import"), ("dog", "class"), ("bark", "function")}, {("help", "calls")}),
    ("cpp", "#include <x>\nnamespace zoo {\nclass Dog : public Animal {\n    void sit() {\n        help();\n    }\n};\n}\nvoid Dog::bark(int n) {\n    help();\n}\n",
     {("", "import"), ("Dog", "class"), ("sit", "method"), ("bark", "method")}, {("Animal", "extends"), ("help", "calls")}),
])
def test_fallback_languages(language, source, names, refs):
    found = extract.extract(language, source)
    assert {(s[0], s[1]) for s in found.symbols if s[1] != "module"} == names
    assert {(r[1], r[2]) for r in found.refs} >= refs


def test_default_rules_media_types_and_manifests(spark):
    from pyspark.sql import functions as F

    paths = ["a/package-lock.json", ".next/x.js", "x/.turbo/y.js", "b.png", "c.woff2", "d.py", "e.unknown", ".gitignore"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", discovery.ignored(F.col("path")).alias("out"), discovery.media_type(F.col("path")).alias("mime"))
    got = {r.path: (r.out, r.mime) for r in df.collect()}
    assert [got[p][0] for p in paths] == [True, True, True, False, False, False, False, True]
    assert [got[p][1] for p in paths[3:7]] == ["image/png", "font/woff2", "text/x-python", "application/octet-stream"]
    files = [("package.json", '{"name": "root"}'), ("lib/pyproject.toml", '[build]\nname = "no"\n[project]\nversion = "1"\nname = "lib"\n[x]\n'), ("lib/composer.json", '{"name": "v/lib"}'), ("bad/package.json", "{")]
    m = discovery.manifests(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files], "path string, content binary"))
    assert {(r.folder, r.name) for r in m.collect()} == {("", "root"), ("lib", "v/lib")}


def test_jpeg_dimensions_of_a_table(spark):
    from pyspark.sql import functions as F

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc0\x00\x11\x08\x00\x20\x00\x30\x03rest"
    df = spark.createDataFrame([(1, bytearray(jpeg)), (2, bytearray(b"\xff\xd8cut")), (3, bytearray(b"GIF89a\x07\x00\x05\x00xxxxxxxxxxxxxxxx")), (4, None)], "id int, content binary")
    w, h = discovery.dimensions(F.col("content"))
    assert {r.id: (r.w, r.h) for r in df.select("id", w.alias("w"), h.alias("h")).collect()} == {1: (48, 32), 2: (None, None), 3: (7, 5), 4: (None, None)}


def test_rendered_results(spark):
    from lodestone.sources import sinks

    r = spark.createDataFrame([(2, "b.py", None), (1, "a.py", "x,y")], "rank int, path string, note string")
    assert sinks.rendered(r, "csv", "rank") == 'rank,path,note\n1,a.py,"x,y"\n2,b.py,'
    assert sinks.rendered(r, "markdown", "rank", ["path"]) == "| path |\n| --- |\n| a.py |\n| b.py |"
    assert sinks.rendered(r, "files", "rank") == "a.py\nb.py"
    assert sinks.rendered(r.limit(0), "markdown", "rank") == "*No results found.*" and sinks.rendered(r.limit(0), "csv", "rank") == ""


def test_rotation_is_kept_and_checked(spark, tmp_path):
    import numpy as np

    from lodestone.operators.drift import Rotation

    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(4, 4)))
    old = np.random.default_rng(4).normal(size=(60, 4))
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(old, old @ q.T)], "old array<double>, new array<double>")
    fitted = Rotation.fit(pairs, "old", "new", 4)
    fitted.save(spark, f"file://{tmp_path}/r")
    again = Rotation.load(spark, f"file://{tmp_path}/r")
    assert np.allclose(again.adapt((old[0] @ q.T).tolist()), old[0], atol=1e-4)
    vectors = spark.createDataFrame([(1, (old[1] @ q.T).tolist()), (2, None)], "id int, v array<double>")
    got = {r.id: r.adapted for r in again.adapt_all(vectors, "v").collect()}
    assert np.allclose(got[1], old[1], atol=1e-4) and got[2] is None
    for bad in (np.zeros((2, 3)), np.zeros((2, 2), int)):
        with pytest.raises(ValueError):
            Rotation(bad)


def test_a_failing_reranker_fails_as_a_whole(spark):
    from lodestone.operators import models

    def make():
        def score(query, texts):
            if "bad" in texts:
                raise RuntimeError("no model")
            return [float(len(t)) for t in texts]

        return score

    good = spark.createDataFrame([(i, i, "x" * i) for i in range(1, 30)], "id int, rank int, text string").repartition(5)
    assert [r.id for r in models.model_rerank(good, "q", "text", make, 3).collect()] == [29, 28, 27]
    bad = good.unionByName(spark.createDataFrame([(99, 99, "bad")], "id int, rank int, text string"))
    assert [(r.id, r.rerank_score) for r in models.model_rerank(bad, "q", "text", make, 3).collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]


def test_chunks_are_handed_on_in_small_batches(spark):
    """A batch of 1,000 rows, each with 20 results: 64 results at once, not all 20,000."""
    import pyarrow as pa

    from lodestone.operators import tables

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_pydict({"id": list(range(1000))})])))

    made = tables.flat_map(Table(), ["id"], "id long, n int, text string", lambda i: [(i, n, None if n == 3 else f"{i}.{n}") for n in range(20)])
    assert max(b.num_rows for b in made) <= 64
    assert [r for b in made for r in b.to_pylist()] == [{"id": i, "n": n, "text": None if n == 3 else f"{i}.{n}"} for i in range(1000) for n in range(20)]
