import time

import pytest

from lodestone.operators import chunkers, extract
from lodestone.operators.grammar import doc_types, read


def types(language, source):
    return [(r[0], r[1]) for r in read(language, source).refs if r[2] == "type_reference"]


@pytest.mark.parametrize("source,found", [
    ("const a: Foo = {}", [("<module>", "Foo")]),
    ("function bar(x: Foo = g(1), y?: Baz): Qux { return {} as any }", [("bar", "Foo"), ("bar", "Baz"), ("bar", "Qux")]),
    ("const a: Array<Foo> = []", [("<module>", "Array"), ("<module>", "Foo")]),
    ("type X = Foo | Bar", [("<module>", "Foo"), ("<module>", "Bar")]),
    ("const x = {} satisfies Foo", [("<module>", "Foo")]),
    ("function isFoo(x: unknown): x is Foo { return true }", [("isFoo", "Foo")]),
    ("type Cond = Foo extends Bar ? Baz : never", [("<module>", "Foo"), ("<module>", "Bar"), ("<module>", "Baz")]),
    ("type Shape = { a: Foo; b?: Bar }", [("<module>", "Foo"), ("<module>", "Bar")]),
    ("function foo<T extends Foo>(x: T): void {}", [("foo", "Foo")]),
    ("type NS = Namespace.Foo", [("<module>", "Namespace.Foo")]),
    ("const a: string = ''; const b: number = 0", []),
    ("type Foo = Foo[]", []),
    ("const f = (q: Q1): Promise<R1> => q", [("f", "Q1"), ("f", "Promise"), ("f", "R1")]),
    ("/** @param {UserService} svc */\nfunction get(svc: UserService) {}", [("get", "UserService")] * 2),
    ("/** @type {Config} */\nconst config = {}", [("<module>", "Config")]),
])
def test_typescript_types(source, found):
    assert types("typescript", source) == found


def test_typescript_definitions_and_calls():
    source = (
        "import a from 'b';\nexport class Dog<T> extends Animal<T> implements Loud, Fast {\n  name: Name;\n  async bark(x: Opts) {\n    if (x) { this.go(x).then(y => done(y)); }\n  }\n"
        "  handler = (e) => { fire(e) }\n}\nconst o = { run() { h() }, stop: function () { k() } };\nexports.boo = () => { w() };\n"
        "bus.on('ready', cb);\naddFilter('title', 'ns', cb);\nconst r = /\"{/g; // call()\nconst s = `text( ${1}`;\nnew Cat();\n"
    )
    found = read("typescript", source)
    assert [(s[0], s[1], s[2], s[3], s[4]) for s in found.symbols] == [
        ("", "import", 1, 1, ""), ("Dog", "class", 2, 8, ""), ("bark", "method", 4, 6, "Dog"), ("handler", "method", 7, 7, "Dog"),
        ("run", "method", 9, 9, ""), ("stop", "function", 9, 9, ""), ("boo", "function", 10, 10, ""),
    ]
    refs = [(r[0], r[1], r[2], r[4]) for r in found.refs if r[2] != "type_reference"]
    assert refs == [
        ("Dog", "Animal", "extends", ""), ("Dog", "Loud", "implements", ""), ("Dog", "Fast", "implements", ""), ("bark", "go", "calls", ""), ("bark", "then", "calls", ""), ("bark", "done", "calls", ""),
        ("handler", "fire", "calls", ""), ("run", "h", "calls", ""), ("stop", "k", "calls", ""), ("boo", "w", "calls", ""),
        ("<module>", "ready", "registers_on", ""), ("<module>", "title", "registers_on", "filter"), ("<module>", "Cat", "calls", ""),
    ]


@pytest.mark.parametrize("source,found", [
    ("<?php function greet(UserService $svc): ?Response { return new Response(); }", [("greet", "UserService"), ("greet", "Response")]),
    ("<?php function process(Request|Response $input, int $n): void {}", [("process", "Request"), ("process", "Response")]),
    ("<?php class Foo { protected ?Config $config = null; private static int $n; }", [("Foo", "Config")]),
    ("<?php class C { public function get(int $id): ?User { return null; } }", [("get", "User")]),
    ("<?php function test(App\\Models\\User $user): \\App\\Response {}", [("test", "App\\Models\\User"), ("test", "\\App\\Response")]),
    ("<?php interface Repo { public function find(int $id): ?Model; }", [("find", "Model")]),
    ("<?php\n/** @param Request|Foo[] $x\n * @return ?User */\nfunction a($x) {}", [("a", "Request"), ("a", "Foo"), ("a", "User")]),
])
def test_php_types(source, found):
    assert types("php", source) == found


def test_php_namespaces_chains_and_text_outside():
    source = "<p>function fake() {}</p><?php\nnamespace App\\Model;\nuse A\\B;\nclass User extends Base implements X {\n  use T;\n  function name() {\n    return $this->db()->fetch();\n  }\n}\nfunction helper() {}\nadd_action('init', 'f');\n$s = <<<SQL\nfunction no() {\nSQL;\n"
    found = read("php", source)
    assert [(s[0], s[1], s[2], s[4]) for s in found.symbols] == [("", "import", 3, ""), ("App\\Model\\User", "class", 4, ""), ("name", "method", 6, "App\\Model\\User"), ("App\\Model\\helper", "function", 10, "")]
    assert [(r[0], r[1], r[2]) for r in found.refs] == [("App\\Model\\User", "Base", "extends"), ("App\\Model\\User", "X", "implements"), ("name", "db", "calls"), ("name", "fetch", "calls"), ("<module>", "init", "registers_on")]


def test_go():
    source = (
        'package m\nimport (\n"fmt"\n)\ntype Base struct{}\ntype Run struct {\n  *Base\n  name, other string `json:"a"`\n  handler Handler\n}\ntype Agent interface {\n  Spawn(ctx context.Context) error\n}\n'
        "var _ Agent = (*Run)(nil)\nfunc (r *Run) Spawn(cfg Config, a, b int) (Result, error) {\n  s := make([]int, 10)\n  fmt.Println(len(s))\n  helper()\n}\nfunc New() *Run {\n return nil\n}\nconst (\n A = 3\n B = 30\n)\ntype MyInt int\n"
    )
    found = read("go", source)
    assert [(s[0], s[1], s[2], s[3], s[4]) for s in found.symbols] == [
        ("", "import", 2, 4, ""), ("Base", "class", 5, 5, ""), ("Run", "class", 6, 10, ""), ("Agent", "interface", 11, 13, ""), ("Spawn", "method", 15, 19, "Run"),
        ("New", "function", 20, 22, ""), ("A", "variable", 24, 24, ""), ("B", "variable", 25, 25, ""), ("MyInt", "type_alias", 27, 27, ""),
    ]
    assert [(r[0], r[1], r[2]) for r in found.refs] == [
        ("Run", "Base", "extends"), ("Run", "Handler", "type_reference"), ("Agent", "Context", "type_reference"), ("Run", "Agent", "implements"), ("Spawn", "Run", "type_reference"),
        ("Spawn", "Config", "type_reference"), ("Spawn", "Result", "type_reference"), ("Spawn", "Println", "calls"), ("Spawn", "helper", "calls"), ("New", "Run", "type_reference"),
    ]


def test_swift():
    source = (
        "import Foundation\nlet limit: Int = 30\nprotocol Agent {\n func spawn() throws\n}\nextension Runtime: Agent {\n func spawn() { helper() }\n}\nclass Manager: Base, Agent {\n func add(cfg: Config, n: Int) -> Result {\n  items.append(cfg)\n }\n}\n"
        'func setup() {\n NotificationCenter.default.addObserver(forName: .custom, object: nil) { _ in }\n NotificationCenter.default.post(name: NSNotification.Name("Login"), object: nil)\n}\n'
    )
    found = read("swift", source)
    assert [(s[0], s[1], s[4]) for s in found.symbols] == [("", "import", ""), ("limit", "variable", ""), ("Agent", "interface", ""), ("spawn", "method", "Agent"), ("spawn", "method", "Runtime"), ("Manager", "class", ""), ("add", "method", "Manager"), ("setup", "function", "")]
    refs = [(r[0], r[1], r[2]) for r in found.refs]
    assert refs == [
        ("Runtime", "Agent", "implements"), ("spawn", "helper", "calls"), ("Manager", "Base", "extends"), ("Manager", "Agent", "implements"), ("add", "Config", "type_reference"), ("add", "Result", "type_reference"),
        ("add", "append", "calls"), ("setup", "custom", "registers_on"), ("setup", "Login", "fires"), ("setup", "Name", "calls"),
    ]


def test_ruby():
    source = (
        'require "json"\nmodule Pay\n  class Gate < Base\n    include Loud\n    LIMIT = 3\n    def charge(amount)\n      return 1 if amount\n      while amount do\n        go(amount)\n      end\n      response.body\n      helper\n      puts "end"\n    end\n    def sq(x) = x * 2\n  end\nend\n'
        'def top\n  Notes.subscribe("sql.record") do |*a|\n  end\nend\n'
    )
    found = read("ruby", source)
    assert [(s[0], s[1], s[2], s[3], s[4]) for s in found.symbols] == [
        ("", "import", 1, 1, ""), ("Pay", "class", 2, 17, ""), ("Gate", "class", 3, 16, "Pay"), ("LIMIT", "variable", 5, 5, "Gate"), ("charge", "method", 6, 14, "Gate"), ("sq", "method", 15, 15, "Gate"), ("top", "function", 18, 21, ""),
    ]
    assert [(r[0], r[1], r[2]) for r in found.refs] == [("Gate", "Base", "extends"), ("Gate", "Loud", "implements"), ("charge", "go", "calls"), ("charge", "body", "calls"), ("top", "sql.record", "registers_on")]


@pytest.mark.parametrize("language", ["typescript", "php", "go", "swift", "ruby", "cpp", "c", "java", "rust", "csharp", "kotlin", "python"])
def test_broken_sources_end_quickly(language):
    start = time.monotonic()
    for part in ("((((", "{", '"', "'", "`", "a < b ", "/* ", "* & ", "class A ", "def f\n", "<<~X\n", "x => ", "(a): b ? ", "\\", "#", "\x00", "****"):
        extract.extract(language, part * 3000)
    assert time.monotonic() - start < 20


def test_chunks_are_whole_definitions():
    source = "import x from 'y';\n\nfunction a() {\n  if (x) {\n  }\n}\nconst n = 1;\nclass B {\n  run() {\n  }\n}\n"
    assert [(c.kind, c.start_line, c.end_line) for c in chunkers.chunk_code(source, "typescript")] == [("merged", 1, 2), ("definition", 3, 6), ("merged", 7, 7), ("definition", 8, 11)]


def test_doc_types():
    assert doc_types("@param {Array<Item>} a @returns {?App.User} @throws {import('x').Y}") == ["Item", "App.User"]
