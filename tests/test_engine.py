import json

import pytest

from lodestone.__main__ import answer
from lodestone.engine import AccessError, Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    a, b = root / "a", root / "b"
    for p in (a, b):
        p.mkdir()
    (a / "base.py").write_text("class Model:\n    def save(self):\n        signal.send(self)\n\ndef helper():\n    return 1\n")
    (a / "use.py").write_text("from base import helper\n\ndef run():\n    return helper()\n\ndef listen():\n    signal.connect(run)\n    other.connect(run)\n")
    (a / "guide.md").write_text("# Saving\nHow a model is saved with helper functions.\n")
    (b / "app.py").write_text("def main():\n    helper()\n    Model()\n")
    e = Engine(spark, f"file://{root}/store")
    e.create_collection("c1")
    e.register_project("a", f"file://{a}", "c1")
    e.register_project("b", f"file://{b}")
    e.reindex("a")
    e.reindex("b")
    return e, root


def test_index_and_lookup(engine):
    e, _ = engine
    assert {(r.name, r.kind) for r in e.symbols("helper").collect()} == {("helper", "function")}
    refs = e.references("helper")
    assert {(r.project, r.name) for r in refs["callers"].collect()} == {("a", "run"), ("b", "main")}
    assert {(r.name, r.depth) for r in e.impact("helper").collect()} >= {("run", 1), ("main", 1)}
    assert {r.name for r in e.file_context("use.py").collect() if r.what == "symbol"} == {"", "run", "listen", "<module>"}


def test_impact_of_a_dense_graph_is_ordered_by_pagerank(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    lines = ["def base():\n    return 1\n", "def zcentral():\n    return base()\n"]
    lines += [f"def f{i}():\n    base()\n    return zcentral()\n" for i in range(110)]
    for name, text in (("dense", "\n".join(lines)), ("tiny", "def base():\n    return 1\n\ndef user():\n    return base()\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(text)
        e.register_project(name, f"file://{tmp_path}/{name}")
        e.reindex(name)
    found = e.impact("base", 1).collect()
    rows = [r for r in found if r.project == "dense"]
    assert len(rows) == 111 and rows[0].name == "zcentral" and rows[0].ppr_relevance > rows[1].ppr_relevance > 0
    assert [(r.name, r.ppr_relevance) for r in found if r.project == "tiny"] == [("user", None)]


def test_search_finds_code_and_documents(engine):
    e, _ = engine
    top = e.search("helper", 5).collect()
    assert {r.path for r in top} >= {"base.py", "use.py"} and [r.rank for r in top] == list(range(1, len(top) + 1))
    docs = e.doc_search("model saved", 5, rerank=True).collect()
    assert [r.path for r in docs] == ["guide.md"] and not docs[0].trusted and len(docs[0].docid) == 6


def test_federation_events_and_map(engine):
    e, _ = engine
    assert {(r.def_project, r.use_project) for r in e.cross_refs("helper").collect()} == {("a", "b")}
    assert [(r.from_project, r.to_project, r.names) for r in e.collection_map().collect()] == [("b", "a", 2)]
    assert {(r.name, r.status) for r in e.events(mismatches=True).collect()} == {("other", "ORPHANED_LISTENER")}
    assert e.events("signal").count() == 2


def test_scopes(engine):
    e, _ = engine
    only_b = e.create_scope("agent", "project", projects=["b"])
    assert {r.project for r in e.symbols(session=only_b).collect()} == {"b"}
    shelf = e.create_scope("agent2", "collection", collections=["c1"])
    assert {r.project for r in e.symbols(session=shelf).collect()} == {"a"}
    assert e.symbols(session=e.create_scope("agent3", "project")).count() == 0
    e.revoke_scope("agent")
    with pytest.raises(AccessError):
        e.symbols(session=only_b)
    with pytest.raises(AccessError):
        e.symbols(session=e.create_scope("late", "global", minutes=-1))


def test_incremental_reindex_and_collections(engine):
    e, root = engine
    before = {r.path: r.hash for r in e.store.read("files").collect()}
    (root / "a" / "use.py").unlink()
    (root / "a" / "new.py").write_text("def fresh():\n    helper()\n")
    e.reindex("a")
    after = {r.path: r.hash for r in e.store.read("files").collect()}
    assert set(after) == set(before) - {"use.py"} | {"new.py"}
    assert {r.name for r in e.references("helper")["callers"].collect()} == {"fresh", "main"}
    assert e.unfinished_jobs().count() == 0 and e.store.read("jobs").count() == 3
    e.add_to_collection("c1", "b")
    assert [r.projects for r in e.list_collections().collect()] == [["a", "b"]]
    e.delete_collection("c1")
    assert e.list_collections().count() == 0
    assert {r["table"]: r["rows"] for r in e.status().collect()}["projects"] == 2
    e.store.vacuum()
    assert e.audit_log(5).count() == 5


def test_service_answers_json(engine):
    e, _ = engine
    assert answer(e, json.dumps({"tool": "symbols", "arguments": {"query": "main"}}))["rows"][0]["name"] == "main"
    assert "error" in answer(e, '{"tool": "_index"}') and "error" in answer(e, "not json")
    with pytest.raises(ValueError):
        e.reindex("nowhere")


def test_search_options(engine):
    e, _ = engine
    assert {r.path for r in e.search("vec:helper", 5, mode="lex", weights="keyword=2.0").collect()} >= {"base.py"}
    with pytest.raises(ValueError):
        e.search("helper", weights="keyword:2")
    with pytest.raises(ValueError):
        e.search("helper", mode="fuzzy")
    plain = {r.id: r.score for r in e.search("helper", 10).collect()}
    boosted = {r.id: (r.path, r.score) for r in e.search("helper", 10, symbol_boost=0.5).collect()}
    assert {p for i, (p, s) in boosted.items() if s > plain[i] + 0.4} == {"base.py"}
    assert [r.id for r in e.search("helper", 10, graph_signal=True).collect()] == [r.id for r in e.search("helper", 10).collect()]  # sparse: the gate is shut


def test_snippets_profiles_and_document_types(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.py").write_text("class Shop:\n    def open(self):\n        lamp = 1\n        return lamp\n\n    def close(self):\n        return 2\n")
    (tmp_path / "p" / "n.txt").write_text("a note about the lamp\n")
    seen = []

    def embedder():
        from lodestone.operators.models import hashed_embedder

        return hashed_embedder()

    e = Engine(spark, f"file://{tmp_path}/store", embedder, [lambda c: seen.append(1) or c], profile="BAAI/bge-base-en-v1.5")
    assert e.profile.name == "bge-base" and e.profile.scope_prefix
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/store", profile="none such")
    e.register_project("p", f"file://{tmp_path}/p")
    e.reindex("p")
    row = {r.path: r for r in e.search("lamp", 5, by_meaning=True).collect()}["m.py"]
    assert [a.name for a in row.ancestors] == ["Shop", "open"] and row.snippet.startswith("1 | class Shop:") and row.best_line in (2, 3, 4)
    row = {r.path: r for r in e.search("lamp", 5, max_depth=1, snippet="full").collect()}["m.py"]
    assert row.snippet == "2 |     def open(self):\n3 |         lamp = 1\n4 |         return lamp" and [a.name for a in row.ancestors] == ["open"]
    assert [r.path for r in e.doc_search("lamp", 5, formats=["txt"], snippet="none").collect()] == ["n.txt"]
    stored = {r.id: r.embedding for r in e.store.read("embeddings").collect()}
    for c in e.store.read("chunks").collect():
        prefix = "Shop class, open method in m.py: " if c.path == "m.py" else ""
        assert stored[c.id] == pytest.approx(embedder()([prefix + c.content])[0].tolist())


def test_settings_by_precedence(tmp_path, monkeypatch):
    from lodestone.sources import config

    file = tmp_path / "c.toml"
    file.write_text("nice = 3\nstore = 'x'\n")
    read = config.load(str(file))
    assert config.setting("store", None, read) == "x" and config.setting("store", "y", read) == "y"
    assert config.nice_value(None, read) == 3 and config.nice_value(0, read) is None and config.nice_value(None, {}) == 10
    monkeypatch.setenv("LODESTONE_NICE", "5")
    assert config.nice_value(None, read) == 5 and config.nice_value(7, read) == 7
    monkeypatch.setenv("LODESTONE_NICE", "many")
    assert config.nice_value(None, read) == 3
    file.write_text("= broken")
    assert config.load(str(file)) == {} and config.load(str(tmp_path / "none")) == {}


def test_graph_signal_behind_its_gates(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    lines = ["def base():\n    return 1\n", "def central():\n    return base()\n"] + [f"def f{i}():\n    base()\n    return central()\n" for i in range(110)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "m.py").write_text("\n".join(lines))
    (tmp_path / "p" / "note.md").write_text("# Central\nwords about central things\n")
    e.register_project("p", f"file://{tmp_path}/p")
    e.reindex("p")
    assert any("graph" in r.sources for r in e.search("central", 5, graph_signal=True).collect())
    assert not any("graph" in r.sources for r in e.search("words about", 5, graph_signal=True).collect())


def test_recovery_stale_parsers_and_counts(spark, tmp_path, monkeypatch):
    from lodestone import engine as module

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def one():\n    return 1\n")
    (tmp_path / "p" / "b.py").write_text("def two():\n    return one()\n")
    (tmp_path / "p" / "package.json").write_text('{"name": "pack"}')
    e = Engine(spark, f"file://{tmp_path}/store")
    e.register_project("p", f"file://{tmp_path}/p")
    e._job("broken", "p", "running")
    (job,) = e.recover()
    assert e.unfinished_jobs().isEmpty() and {r.job: r.status for r in e.store.read("jobs").collect()} == {"broken": "failed", job: "completed"}
    assert {r.package for r in e.store.read("files").collect()} == {"pack"}
    assert e.stale_projects().isEmpty()
    (tmp_path / "p" / "a.py").write_text("def one():\n    return 2\n")
    (tmp_path / "p" / "b.py").unlink()
    e.reindex("p")
    last = e.index_statistics("p").collect()[-1]
    assert (last.processed, last.skipped, last.deleted) == (1, 1, 1)
    monkeypatch.setattr(module, "parser_digest", lambda: "newer")
    assert [r.project for r in e.stale_projects().collect()] == ["p"]
    e.reindex("p")  # other parser code: everything is read again
    assert e.stale_projects().isEmpty() and e.index_statistics("p").collect()[-1].processed == 2


def test_indexing_one_project_leaves_anothers_tables(engine):
    e, root = engine
    before = e.store.paths("symbols", "b")
    e.reindex("a", full=True)
    assert e.store.paths("symbols", "b") == before and e.store.read("symbols", "b").count() > 0
    assert {r.project for r in e.store.read("symbols").select("project").distinct().collect()} >= {"a", "b"}
