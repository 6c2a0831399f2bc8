"""Token-level readers of TypeScript, JavaScript, PHP, Go, Swift and Ruby files.

A file is cut into tokens, so that strings and comments hide nothing and look like
nothing; brackets are matched once, and definitions open frames that end where their
body ends. Every reader is one pass over the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple


@dataclass
class Found:
    """symbols: (name, kind, line, end_line, scope, signature); refs: (from_name, to_name, kind, line, subtype)."""

    symbols: list[tuple] = field(default_factory=list)
    refs: list[tuple] = field(default_factory=list)


# Calls that register or fire events, and names that are no calls or no types of interest.
REGISTERS = {
    "typescript": {"on", "once", "addListener", "addEventListener", "addAction", "addFilter"},
    "php": {"add_action", "add_filter"},
    "go": set(),
    "swift": {"addObserver"},
    "ruby": {"subscribe"},
}
FIRES = {
    "typescript": {"emit", "dispatchEvent", "trigger", "doAction", "applyFilters"},
    "php": {"do_action", "do_action_ref_array", "apply_filters", "apply_filters_ref_array"},
    "go": set(),
    "swift": {"post"},
    "ruby": {"instrument"},
}
BUILTIN_CALLS = {
    "go": set("append cap clear close complex copy delete imag len make max min new panic print println real recover".split()),
    "php": set("array list isset empty exit die echo print include include_once require require_once unset".split()),
    "ruby": set("attr_reader attr_writer attr_accessor private protected public puts print p pp raise".split()),
    "typescript": {"super", "import", "require"},
    "swift": set(),
}
BUILTIN_TYPES = {
    "go": set("string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 bool byte rune error any comparable".split()),
    "swift": set("String Int Double Float Bool Void Int8 Int16 Int32 Int64 UInt UInt8 UInt16 UInt32 UInt64 Character Any AnyObject Never Optional Error Codable Hashable Equatable Comparable Identifiable Sendable Self".split()),
    "typescript": set("string number boolean undefined null void never any unknown object symbol bigint true false this".split()),
    "php": set("string int integer float double bool boolean array callable iterable mixed self static parent true false null void never object resource".split()),
    "ruby": set(),
}
DOC_PRIMITIVES = {"string", "number", "boolean", "undefined", "null", "void", "never", "any", "unknown", "object", "symbol", "bigint", "int", "integer", "float", "double", "bool", "array", "callable", "iterable", "mixed", "self", "static", "parent", "true", "false", "resource"}

KEYWORDS = {
    "typescript": set("if for while switch catch return function class new typeof await async else do try throw case delete in of instanceof void yield const let var with default export extends implements interface enum type as satisfies is keyof infer readonly".split()),
    "php": set("if for foreach while switch catch return function fn class interface trait enum new clone echo print else elseif do try throw case match use namespace instanceof and or xor as static public private protected final abstract readonly var const global extends implements yield default".split()),
    "go": set("if for switch select return func go defer range case chan map struct interface type const var import package else break continue goto fallthrough".split()),
    "swift": set("if for while switch guard return func init deinit catch case let var in is as try await throw else do repeat where some any class struct enum actor protocol extension import default subscript".split()),
    "ruby": set("if unless while until for case when in return def class module begin do end then else elsif ensure rescue yield not and or super self nil true false alias undef redo retry next break defined?".split()),
}
MODIFIERS = set("public private protected static readonly abstract override async declare get set accessor final var const default export".split())


class Token(NamedTuple):
    kind: str  # id, str, num, op, nl or doc
    text: str
    line: int


_STRINGS = {
    "typescript": r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\[\s\S])*(?:\'|(?=\n)|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)',
    "php": r'<<<[ \t]*(?P<quote>["\']?)(?P<here>[A-Za-z_]\w*)(?P=quote)\n[\s\S]*?(?:\n[ \t]*(?P=here)\b|\Z)|"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|\'(?:[^\'\\]|\\[\s\S])*(?:\'|\Z)',
    "go": r'"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)|\'(?:[^\'\\\n]|\\[\s\S])*(?:\'|(?=\n)|\Z)|`[^`]*(?:`|\Z)',
    "swift": r'"""[\s\S]*?(?:"""|\Z)|"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|\Z)',
    "ruby": r'<<[~-](?P<quote>["\']?)(?P<here>[A-Za-z_]\w*)(?P=quote)[^\n]*\n[\s\S]*?(?:\n[ \t]*(?P=here)\b|\Z)|"(?:[^"\\]|\\[\s\S])*(?:"|\Z)|\'(?:[^\'\\]|\\[\s\S])*(?:\'|\Z)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|(?<![:\w]):[A-Za-z_]\w*[?!]?',
}
_COMMENTS = {
    "typescript": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
    "php": r"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
    "go": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
    "swift": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)",
    "ruby": r"#[^\n]*|(?m:^=begin\b)[\s\S]*?(?:\n=end\b|\Z)",
}
_NAMES = {
    "typescript": r"#?[A-Za-z_$\u0080-\U0010ffff][\w$]*",
    "php": r"\$?\\?[A-Za-z_\u0080-\U0010ffff]\w*(?:\\\w+)*",
    "go": r"[A-Za-z_\u0080-\U0010ffff]\w*",
    "swift": r"[@#]?[A-Za-z_\u0080-\U0010ffff]\w*",
    "ruby": r"(?:@{1,2}|\$)?[A-Za-z_\u0080-\U0010ffff]\w*[?!]?",
}
_SCANNERS = {
    lang: re.compile(
        rf"(?P<space>[ \t\r\f\v\ufeff]+)|(?P<nl>\n)|(?P<comment>{_COMMENTS[lang]})|(?P<str>{_STRINGS[lang]})|(?P<id>{_NAMES[lang]})|(?P<num>\d[\w.]*)|(?P<op>=>|\?->|->|::|\.\.\.|===?|!==?|<=|>=|&&|\|\||\?\?|\?\.|:=|[\s\S])"
    )
    for lang in _STRINGS
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def lex(source: str, language: str) -> list[Token]:
    """Tokens of a source; comments go, but /** comments are kept as doc tokens."""
    if language == "php" and "<?" in source:  # what stands outside the code is no code
        source = re.sub(r"(?:\A|\?>)[\s\S]*?(?:<\?(?:php|=)?|\Z)", lambda m: "\n" * m[0].count("\n") + " ", source)
    scan, out, at, line = _SCANNERS[language], [], 0, 1
    before = ""  # the last token that isn't a newline
    while at < len(source):
        if language in ("typescript", "ruby") and source[at] == "/" and (not before or before in "(,=:[!&|?{};=>&&||??" or before in ("return", "if", "when")) and (m := _REGEX.match(source, at)):
            kind = "str"
        else:
            m = scan.match(source, at)
            kind = m.lastgroup if m.lastgroup not in ("quote", "here") else "str"
        text = m[0]
        if kind == "comment":
            if text.startswith("/**"):
                out.append(Token("doc", text, line))
        elif kind != "space":
            out.append(Token(kind, text, line))
            before = text if kind != "nl" else before
        line += text.count("\n")
        at = m.end()
    return out


def bare(text: str) -> str:
    """A string literal without its quotes, a symbol without its colon."""
    return text[1:] if text.startswith(":") else text[1:-1] if len(text) > 1 and text[0] in "\"'`" else text


class Frame(NamedTuple):
    name: str
    kind: str  # container or function
    close: int  # the last token inside


class Reader:
    """What all brace languages share: tokens, matching brackets, frames and the results."""

    language = ""

    def __init__(self, source: str):
        self.lines = source.split("\n")
        self.all = lex(source, self.language)
        keeps_lines = self.language in ("go", "swift", "ruby", "typescript")
        self.docs = [(i, t) for i, t in enumerate(self.all) if t.kind == "doc"]
        self.toks = [t for t in self.all if t.kind != "doc" and (keeps_lines or t.kind != "nl")]
        self.match, self.angles = self._brackets()
        self.frames: list[Frame] = []
        self.out = Found()

    def _brackets(self) -> tuple[dict[int, int], dict[int, int]]:
        """The closing place of every bracket, and of every < that may open a list of types."""
        pairs, open_, found, angles = {"(": ")", "[": "]", "{": "}"}, [], {}, {}

        def drop() -> None:
            while open_ and self.toks[open_[-1]].text == "<":
                open_.pop()

        for i, t in enumerate(self.toks):
            if t.text in self.no_types and t.kind != "str":  # what stood before was a comparison
                drop()
            if t.kind != "op":
                continue
            if t.text in pairs or t.text == "<":
                open_.append(i)
            elif t.text == ">" and open_ and self.toks[open_[-1]].text == "<":
                angles[open_.pop()] = i
            elif t.text in ")]}":
                drop()
                if open_ and pairs[self.toks[open_[-1]].text] == t.text:
                    found[open_.pop()] = i
        for i in open_:  # what is never closed reaches to the end
            if self.toks[i].text != "<":
                found[i] = len(self.toks) - 1
        return found, angles

    # Looking at tokens

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def skip_lines(self, i: int) -> int:
        while self.kind(i) == "nl":
            i += 1
        return i

    def before(self, i: int) -> int:
        i -= 1
        while self.kind(i) == "nl":
            i -= 1
        return i

    def is_name(self, i: int) -> bool:
        return self.kind(i) == "id" and self.text(i) not in KEYWORDS[self.language]

    def generics(self, i: int) -> int:
        """The place after a list <...> that starts here, or this place if none does."""
        return self.angles.get(i, i - 1) + 1

    def until(self, i: int, stops: set[str], newline: bool = True) -> int:
        """The first place outside brackets with one of these texts, a closing bracket or (if asked for) a line's end."""
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "op" and t.text in self.match_open and i in self.match and t.text not in stops:
                i = self.match[i] + 1
                continue
            if t.text in stops and t.kind != "str" or t.kind == "op" and t.text in ")]}" or newline and t.kind == "nl":
                return i
            i += 1
        return i

    match_open = {"(", "[", "{"}
    no_types = {";", "&&", "||", "+", "*", "/", "==", "===", "const", "let", "var", "return", "if", "for", "function", "func"}

    def commas(self, open_: int) -> Iterator[tuple[int, int]]:
        """The parts between the commas of a bracket, as half-open ranges."""
        i, end = open_ + 1, self.match.get(open_, open_)
        depth, start = 0, i
        while i < end:
            if self.text(i) in self.match_open and i in self.match:
                i = self.match[i]
            elif self.text(i) == "<":
                depth += 1
            elif self.text(i) == ">":
                depth = max(0, depth - 1)
            elif self.text(i) == "," and not depth:
                yield start, i
                start = i + 1
            i += 1
        if start < end:
            yield start, end

    # Results

    @property
    def scope(self) -> str:
        return next((f.name for f in reversed(self.frames) if f.kind == "container"), "")

    @property
    def owner(self) -> str:
        return self.frames[-1].name if self.frames else "<module>"

    def symbol(self, name: str, kind: str, i: int, end: int | None = None, scope: str | None = None) -> None:
        line = self.toks[i].line
        last = self.toks[min(end if end is not None else i, len(self.toks) - 1)].line
        self.out.symbols.append((name, kind, line, max(last, line), self.scope if scope is None else scope, self.lines[line - 1].rstrip()))

    def ref(self, to: str, kind: str, i: int, source: str | None = None, subtype: str = "") -> None:
        self.out.refs.append((self.owner if source is None else source, to, kind, self.toks[i].line, subtype))

    def enter(self, name: str, kind: str, close: int) -> None:
        self.frames.append(Frame(name, kind, close))

    def call(self, i: int, open_: int) -> None:
        """A call by the name at ``i``: an event if it is one of the event calls and names its event."""
        name, lang = self.text(i), self.language
        if name in REGISTERS[lang] | FIRES[lang] and (event := self.event_of(open_)):
            lower = name.lower()
            self.ref(event, "registers_on" if name in REGISTERS[lang] else "fires", i, subtype="action" if "action" in lower else "filter" if "filter" in lower else "")
        elif name not in BUILTIN_CALLS[lang] and not (lang == "go" and name in BUILTIN_TYPES[lang]):
            self.ref(name, "calls", i)

    def event_of(self, open_: int) -> str:
        """The first argument's string, wherever it stands in that argument."""
        for a, b in self.commas(open_):
            return next((bare(self.text(j)) for j in range(a, b) if self.kind(j) == "str"), "")
        return ""

    def types(self, a: int, b: int, source: str | None = None, skip: set[str] = frozenset()) -> None:
        """A reference for every type named between two places."""
        i = a
        while i < b:
            if self.kind(i) != "id" or self.text(i) in KEYWORDS[self.language] or self.text(i).startswith(("$", "@")):
                i += 1
                continue
            at, name, prev = i, self.text(i), self.kind(i - 1) if self.kind(i - 1) == "nl" else self.text(i - 1)
            while self.text(i + 1) == "." and self.kind(i + 2) == "id" and i + 2 < b:
                name, i = f"{name}.{self.text(i + 2)}", i + 2
            i += 1
            colon = self.text(i) == ":" or self.text(i) == "?" and self.text(i + 1) == ":"
            label = i < b and (self.text(i) == "is" or self.language in ("typescript", "swift") and colon and prev in ("{", "(", "[", ",", ";", "nl", "readonly", "..."))
            if self.language == "go":
                name = name.rsplit(".", 1)[-1]
            known = name in BUILTIN_TYPES[self.language] or self.language == "php" and name.lower() in BUILTIN_TYPES["php"]
            if not label and not known and name not in skip and not (len(name) == 1 and name.isupper()):
                self.ref(name, "type_reference", at, source)

    def doc_refs(self) -> None:
        """Types in doc comments belong to the function that follows, if one does at once."""
        functions = {}
        for name, kind, line, *_ in self.out.symbols:
            if kind in ("function", "method"):
                functions.setdefault(line, name)
        for i, doc in self.docs:
            j = i + 1
            while j < len(self.all) and self.all[j].kind in ("nl", "doc"):
                j += 1
            owner = functions.get(self.all[j].line, "<module>") if j < len(self.all) else "<module>"
            for name in doc_types(doc.text):
                self.out.refs.append((owner, name, "type_reference", doc.line, ""))

    def read(self) -> Found:
        i = 0
        while i < len(self.toks):
            while self.frames and i > self.frames[-1].close:
                self.frames.pop()
            if self.kind(i) == "nl":
                i += 1
                continue
            i = max(self.step(i), i + 1)
        self.doc_refs()
        return self.out

    def step(self, i: int) -> int:
        raise NotImplementedError


def doc_types(text: str) -> list[str]:
    """Types named in the tags of a JSDoc or PHPDoc comment, in order; unions and generics are taken apart, primitives left out."""
    out: list[str] = []
    for m in re.finditer(r"@(?:param|returns?|type|typedef|var|throws|property(?:-read|-write)?)\s+(?:\{([^}]*)\}|(\??\\?[A-Za-z_][\w\\|<>\[\],?]*))", text):
        body = re.sub(r"import\([^)]*\)\.?\w*", "", m[1] or m[2])
        out += re.findall(r"\\?[A-Za-z_]\w*(?:[\\.]\w+)*", body)
    return [x for x in dict.fromkeys(out) if x.lower() not in DOC_PRIMITIVES]


class TypeScript(Reader):
    language = "typescript"

    def type_end(self, i: int) -> int:
        """Where a type that starts here ends."""
        depth, last, tests = 0, "", 0
        while i < len(self.toks):
            t = self.toks[i]
            if not depth and (t.text == "?" and not tests or t.text == ":" and tests <= 0):
                return i
            if not depth and t.text in ("extends", ":"):
                tests += 1 if t.text == "extends" else -1
            if t.kind == "nl":
                after = self.text(self.skip_lines(i))
                if not depth and last not in ("|", "&", "=>", ":", ",", "?", "extends", "") and after not in ("|", "&", "?", ":", "extends"):
                    return i
            elif t.text in ("(", "[") or t.text == "{" and (not last or last in ("|", "&", "<", ",", "=>", ":", "?", "is", "extends")):
                i, last = self.match.get(i, i), ")"
            elif not depth and (t.text in (",", ";", "=", "{", "}", ")", "]") or t.text == "=>" and last != ")"):
                return i
            else:
                depth += (t.text == "<") - (t.text == ">")
                if depth < 0:
                    return i
                last = t.text
            i += 1
        return i

    def typed(self, i: int, source: str | None = None, skip: set[str] = frozenset()) -> int:
        end = self.type_end(i)
        self.types(i, end, source, skip)
        return end

    def params(self, open_: int, source: str | None, skip: set[str]) -> None:
        for a, b in self.commas(open_):
            j = a
            while j < b and self.text(j) not in (":", "="):
                j = self.match.get(j, j) + 1
            if self.text(j) == ":" and j < b:
                self.types(j + 1, min(self.type_end(j + 1), b), source, skip)

    def signature(self, i: int, source: str | None) -> tuple[int, set[str]] | None:
        """Types of ``<T>(params): type`` from here: the place after it and the type parameters; None if no list of parameters follows."""
        names: set[str] = set()
        j = self.generics(i)
        if j > i:
            names = {self.text(k) for k in range(i + 1, j - 1) if self.text(k - 1) in ("<", ",") and self.kind(k) == "id"}
            self.types(i + 1, j - 1, source, names)
        if self.text(j) != "(":
            return None
        self.params(j, source, names)
        j = self.match.get(j, j) + 1
        if self.text(j) == ":":
            j = self.typed(j + 1, source, names)
        return j, names

    def value_function(self, i: int) -> int | None:
        """The place of the body's end if a function or an arrow function stands here."""
        if self.text(i) == "async":
            i += 1
        if self.text(i) == "function":
            j = self.until(i, {"{"})
            return self.match.get(j)
        j = self.generics(i)
        if self.text(j) == "(":
            j = self.match.get(j, j) + 1
            if self.text(j) == ":":
                j = self.type_end(j + 1)
        elif self.kind(j) == "id":
            j += 1
        else:
            return None
        if self.text(j) != "=>":
            return None
        body = self.skip_lines(j + 1)
        return self.match.get(body, body) if self.text(body) == "{" else self.until(body, {",", ";"}) - 1

    def step(self, i: int) -> int:
        text, prev = self.text(i), self.text(self.before(i))
        if self.kind(i) == "op":
            if text == "(" and self.kind(i - 1) != "id":  # parameters of an arrow function
                j = self.match.get(i, i) + 1
                if self.text(j) == "=>" or self.text(j) == ":" and self.text(self.type_end(j + 1)) == "=>":
                    self.signature(i, None)
            return i + 1
        if self.kind(i) != "id" or prev in (".", "?."):
            return self._called(i) if self.kind(i) == "id" else i + 1
        inside = bool(self.frames) and self.frames[-1].kind == "container" and self._direct(i)
        if text == "import" and self.text(i + 1) not in ("(", ".") and not self.frames:
            end = self.until(i + 1, {";"})
            self.symbol("", "import", i, end)
            return end
        if text == "function" and not inside:
            j = i + 1 + (self.text(i + 1) == "*")
            if self.is_name(j):
                return self._function(self.text(j), "function", i, j + 1)
            self.signature(j, None)
            return j
        if text in ("class", "interface", "enum") and self.kind(i + 1) == "id" and prev != ".":
            return self._container(text, i)
        if text == "type" and self.is_name(i + 1):
            j = self.generics(i + 2)
            if self.text(j) == "=":
                name = self.text(i + 1)
                skip = {name} | {self.text(k) for k in range(i + 2, j) if self.kind(k) == "id" and self.text(k - 1) in ("<", ",")}
                end = self.type_end(self.skip_lines(j + 1))
                self.symbol(name, "type", i, end - 1)
                self.types(j + 1, end, None, skip)
                return end
        if text in ("const", "let", "var") and not inside:
            return self._variable(i)
        if text in ("as", "satisfies") and prev not in ("", ";", "{", ",", "import", "*") and (self.kind(i + 1) == "id" or self.text(i + 1) in ("{", "(", "[")):
            return self.typed(i + 1)
        if inside:
            return self._member(i)
        if prev in ("{", ",") and not inside and self.text(i + 1) == ":" and (end := self.value_function(self.skip_lines(i + 2))):
            self.symbol(text, "function", i, end)  # a property that holds a function
            self.enter(text, "function", end)
            return i + 2
        return self._called(i)

    def _direct(self, i: int) -> bool:
        """Whether a place of a class body is one of its members' starts: after a brace, a semicolon, a line's end or modifiers."""
        j = i - 1
        while self.kind(j) == "id" and self.text(j) in MODIFIERS or self.text(j) in ("*", "#"):
            j -= 1
        return self.kind(j) == "nl" or self.text(j) in ("{", "}", ";", ")")

    def _function(self, name: str, kind: str, start: int, i: int) -> int:
        found = self.signature(i, name)
        if not found:
            return i
        j = self.skip_lines(found[0]) if self.text(self.skip_lines(found[0])) == "{" else found[0]
        if self.text(j) == "{":
            self.symbol(name, kind, start, self.match.get(j, j))
            self.enter(name, "function", self.match.get(j, j))
            return j + 1
        self.symbol(name, kind, start, found[0] - 1)
        return found[0]

    def _container(self, kind: str, i: int) -> int:
        name = self.text(i + 1)
        body = self.until(i + 2, {"{", ";", kind}, newline=False)
        if self.text(body) != "{":
            return i + 2
        close = self.match.get(body, body)
        self.symbol(name, kind, i, close)
        j, mode, params = i + 2, "", {name}
        after = self.generics(j)
        if after > j:
            params |= {self.text(k) for k in range(j, after) if self.text(k - 1) in ("<", ",")}
            self.types(j + 1, after - 1, name, params)
            j = after
        while j < body:
            if self.text(j) in ("extends", "implements"):
                mode = self.text(j)
            elif self.kind(j) == "id" and mode:
                at, base = j, self.text(j)
                while self.text(j + 1) == ".":
                    base, j = f"{base}.{self.text(j + 2)}", j + 2
                if kind == "class":
                    self.ref(base, mode, at, name)
                else:
                    self.ref(base, "extends", at, name)
                    self.types(at, j + 1, name)
                after = self.generics(j + 1)
                if after > j + 1:
                    self.types(j + 2, after - 1, name, params)
                    j = after - 1
            j += 1
        self.enter(name, "container", close)
        return body + 1

    def _member(self, i: int) -> int:
        name = self.text(i)
        if name in MODIFIERS and (self.kind(i + 1) == "id" or self.text(i + 1) in ("*", "[")):
            return i + 1
        j = i + 1 + (self.text(i + 1) in ("?", "!"))
        if self.text(j) == "(" or self.generics(j) > j and self.text(self.generics(j)) == "(":
            return self._function(name.removeprefix("#"), "method", i, j)
        if self.text(j) == ":":
            j = self.typed(j + 1)
        if self.text(j) == "=" and (end := self.value_function(self.skip_lines(j + 1))):
            self.symbol(name.removeprefix("#"), "method", i, end)
            self.enter(name.removeprefix("#"), "function", end)
        return j + 1 if self.text(j) == "=" else max(j, i + 1)

    def _variable(self, i: int) -> int:
        j = self.match.get(i + 1, i + 1) + 1
        name = self.text(i + 1) if self.kind(i + 1) == "id" else ""
        if self.text(j) == ":":
            j = self.typed(j + 1)
        if self.text(j) != "=":
            return max(j, i + 1)
        if name and (end := self.value_function(self.skip_lines(j + 1))):
            self.symbol(name, "function", i, end)
            self.enter(name, "function", end)
        return j + 1

    def _called(self, i: int) -> int:
        name, j = self.text(i), self.generics(i + 1)
        if self.text(i + 1) == "=" and (self.text(self.before(i)) == ".") and (end := self.value_function(self.skip_lines(i + 2))):
            self.symbol(name, "function", i, end)  # assigned to a property
            self.enter(name, "function", end)
            return i + 2
        if self.text(j) == "(" and (name not in KEYWORDS["typescript"] or self.text(self.before(i)) in (".", "?.")):
            if self.text(self.before(i)) == "function":
                return i + 1
            if self.text(self.before(i)) in ("{", ",", "async", "get", "set") and self.text(self.match.get(j, j) + 1) == "{":
                return self._function(name, "method", i, i + 1)  # a method of an object
            self.call(i, j)
        elif self.text(self.before(i)) == "new":
            self.ref(name, "calls", i)
        return i + 1


class Php(Reader):
    language = "php"

    def __init__(self, source: str):
        super().__init__(source)
        self.space = ""

    def step(self, i: int) -> int:
        text, prev = self.text(i), self.text(i - 1)
        lower = text.lower()
        if self.kind(i) != "id" or text.startswith("$"):
            return i + 1
        if prev in ("->", "?->", "::"):
            if self.text(i + 1) == "(":
                self.call(i, i + 1)
            return i + 1
        if lower == "namespace" and self.kind(i + 1) == "id":
            self.space = self.text(i + 1)
            return i + 2
        if lower == "use" and self.text(i + 1) != "(":
            end = self.until(i, {";"})
            if not self.frames:
                self.symbol("", "import", i, end)
            return end
        if lower in ("class", "interface", "trait", "enum") and prev != "::" and self.kind(i + 1) == "id" and self.text(i + 1).lower() not in ("extends", "implements"):
            return self._container(lower, i)
        if lower in ("function", "fn"):
            j = i + 1 + (self.text(i + 1) == "&")
            if lower == "function" and self.kind(j) == "id" and self.text(j + 1) == "(":
                return self._function(i, j)
            if self.text(j) == "(":
                self._signature(j, None)
            return j + 1
        if self.frames and self.frames[-1].kind == "container" and lower in MODIFIERS:
            j = i + 1
            while self.kind(j) == "id" and self.text(j).lower() in MODIFIERS:
                j += 1
            if self.text(j).lower() == "function" or lower == "const":
                return j
            end = self.until(j, {"=", ";"})
            self.types(j, next((k for k in range(j, end) if self.text(k).startswith("$")), j), None)
            return end
        if self.text(i + 1) == "(" and lower not in KEYWORDS["php"]:
            self.call(i, i + 1)
        elif prev.lower() == "new" and lower not in KEYWORDS["php"]:
            self.ref(text, "calls", i)
        return i + 1

    def _signature(self, open_: int, source: str | None) -> int:
        for a, b in self.commas(open_):
            stop = next((k for k in range(a, b) if self.text(k).startswith("$")), a)
            words = [k for k in range(a, stop) if self.text(k).lower() not in MODIFIERS]
            if words:
                self.types(words[0], stop, source)
        j = self.match.get(open_, open_) + 1
        if self.text(j).lower() == "use" and self.text(j + 1) == "(":
            j = self.match.get(j + 1, j + 1) + 1
        if self.text(j) == ":":
            end = self.until(j + 1, {"{", ";", "=>"})
            self.types(j + 1, end, source)
            j = end
        return j

    def _function(self, i: int, j: int) -> int:
        plain = self.text(j)
        method = bool(self.frames) and self.frames[-1].kind == "container"
        name = plain if method or self.frames or not self.space else f"{self.space}\\{plain}"
        body = self._signature(j + 1, name)
        close = self.match.get(body, body) if self.text(body) == "{" else body
        self.symbol(name, "method" if method else "function", i, close)
        if self.text(body) == "{":
            self.enter(name, "function", close)
        return body + 1

    def _container(self, kind: str, i: int) -> int:
        name = f"{self.space}\\{self.text(i + 1)}" if self.space else self.text(i + 1)
        body, mode = self.until(i + 2, {"{", ";"}), ""
        close = self.match.get(body, body)
        self.symbol(name, kind, i, close)
        for j in range(i + 2, body):
            word = self.text(j)
            if word.lower() in ("extends", "implements"):
                mode = word.lower()
            elif self.kind(j) == "id" and mode:
                self.ref(word, mode, j, name)
        self.enter(name, "container", close)
        return body + 1


class Go(Reader):
    language = "go"

    def step(self, i: int) -> int:
        text, prev = self.text(i), self.text(i - 1)
        if self.kind(i) != "id":
            return i + 1
        if text in ("import", "const", "var", "type") and not self.frames and (self.kind(i - 1) in ("nl", "") or prev == ";"):
            close = self.match.get(i + 1) if self.text(i + 1) == "(" else None
            if text == "import":
                end = close if close is not None else self.until(i + 1, {";"}) - 1
                self.symbol("", "import", i, end)
                return end + 1
            if close is None:
                return self._declared(text, i, i + 1)
            j = i + 2
            while (j := self.skip_lines(j)) < close:
                j = max(self._declared(text, j, j), j + 1)
            return close + 1
        if text == "func":
            return self._function(i)
        if self.text(i + 1) == "(" and text not in KEYWORDS["go"]:
            if prev == "." or text not in BUILTIN_CALLS["go"]:
                self.call(i, i + 1)
        return i + 1

    def _parts(self, open_: int, source: str) -> None:
        """Types of a list of parameters or results: names before a type aren't types."""
        parts = list(self.commas(open_))
        simple = lambda a, b: b - a == 1 or b - a == 3 and self.text(a + 1) == "."
        named = any(self.kind(a) == "id" and self.text(a) not in KEYWORDS["go"] and b - a > 1 and self.text(a + 1) not in (".", "[") or self.kind(a) == "id" and self.text(a + 1) == "[" and self.text(a + 2) == "]" for a, b in parts)
        for a, b in parts:
            if named and simple(a, b):
                continue  # a name that shares the type of the next one
            self.types(a + (1 if named else 0), b, source)

    def _function(self, i: int) -> int:
        j, scope = i + 1, None
        if self.text(j) == "(" and self.kind(self.match.get(j, j) + 1) == "id" and self.text(self.match.get(j, j) + 2) in ("(", "["):
            close = self.match[j]
            names = [k for k in range(j + 1, close) if self.kind(k) == "id" and self.text(k - 1) not in ("[", ",")]
            scope = self.text(names[-1]) if names else ""
            name_at = close + 1
            if scope:
                self.ref(scope, "type_reference", names[-1], self.text(name_at))
            j = name_at
        name = self.text(j) if self.kind(j) == "id" else None
        if name is None:  # a function value: only its types count
            if self.text(j) == "(":
                self._parts(j, self.owner)
            return j + 1
        j += 1
        if self.text(j) == "[":
            j = self.match.get(j, j) + 1
        if self.text(j) != "(":
            return j
        self._parts(j, name)
        j = self.match.get(j, j) + 1
        if self.text(j) == "(":
            self._parts(j, name)
            j = self.match.get(j, j) + 1
        else:
            start = j
            while j < len(self.toks) and self.kind(j) != "nl" and (self.text(j) != "{" or self.text(j - 1) in ("interface", "struct")):
                j = self.match.get(j, j) + 1 if self.text(j) in ("(", "[", "{") and self.text(j) != "[" else j + 1
            self.types(start, j, name)
        close = self.match.get(j, j) if self.text(j) == "{" else j - 1
        self.symbol(name, "function" if scope is None else "method", i, close, scope or "")
        if self.text(j) == "{":
            self.enter(name, "function", close)
        return j + 1

    def _declared(self, what: str, start: int, i: int) -> int:
        """One constant, variable or type of a declaration; the place after it, or where its value starts."""
        name = self.text(i)
        if self.kind(i) != "id":
            return self.until(i, {";"})
        if what == "type":
            j = i + 1
            if self.text(j) == "[" and self.kind(j + 1) == "id" and self.kind(j + 2) == "id":
                j = self.match.get(j, j) + 1
            j += self.text(j) == "="
            if self.text(j) in ("struct", "interface"):
                body = j + 1
                close = self.match.get(body, body)
                self.symbol(name, "class" if self.text(j) == "struct" else "interface", start, close, "")
                self._fields(name, body, close, self.text(j) == "struct")
                return close + 1
            end = self.until(j, {";"})
            self.symbol(name, "type_alias", start, end - 1, "")
            self.types(j, end, name)
            return end
        end = self.until(i, {";"})
        equal = next((k for k in range(i, end) if self.text(k) == "="), end)
        ids = [k for k in range(i, equal) if self.kind(k) == "id" and (k == i or self.text(k - 1) == ",")]
        for k in ids:
            if self.text(k) != "_":
                self.symbol(self.text(k), "variable", k, end - 1, "")
        after = ids[-1] + 1
        if name == "_" and self.text(equal + 1) == "(" and self.text(equal + 2) == "*" and self.text(self.match.get(equal + 1, equal) + 1) == "(":
            types = [self.text(k) for k in range(after, equal) if self.kind(k) == "id"]
            if types:
                self.ref(types[-1], "implements", i, self.text(self.match[equal + 1] - 1))
            return end
        self.types(after, equal)
        return equal + 1 if equal < end else end

    def _fields(self, name: str, body: int, close: int, struct: bool) -> None:
        j = body + 1
        while (j := self.skip_lines(j)) < close:
            end = min(self.until(j, {";"}), close)
            stop = next((k for k in range(j, end) if self.kind(k) == "str"), end)  # a tag ends the type
            first = j + (self.text(j) == "*")
            words = [self.text(k) for k in range(first, stop)]
            if len(words) == 1 or len(words) == 3 and words[1] == ".":
                self.ref(words[-1], "extends", j, name)
            elif struct:
                k = j + 1
                while self.text(k) == ",":
                    k += 2
                self.types(k, stop, name)
            elif self.text(j + 1) == "(":  # a method of an interface
                self._parts(j + 1, name)
                self.types(self.match.get(j + 1, j) + 1, stop, name)
            j = max(end, j + 1)


class Swift(Reader):
    language = "swift"

    def step(self, i: int) -> int:
        text, prev = self.text(i), self.text(i - 1)
        if self.kind(i) != "id" or text.startswith(("@", "#")):
            return i + 1
        if prev in (".", "?."):
            return self._called(i)
        if text == "import" and not self.frames:
            end = self.until(i, {";"})
            self.symbol("", "import", i, end - 1)
            return end
        if text in ("class", "struct", "enum", "actor", "protocol", "extension") and self.is_name(i + 1):
            return self._container(text, i)
        if text == "func" or text == "init" and self.frames and self.frames[-1].kind == "container" and self.text(i + 1) in ("(", "?", "<"):
            return self._function(i)
        if text in ("let", "var") and self.kind(i + 1) == "id" and not any(f.kind == "function" for f in self.frames) and prev not in ("if", "guard", "case", ",", "while", "("):
            j = i + 2
            self.symbol(self.text(i + 1), "variable", i)
            if self.text(j) == ":":
                end = self.until(j + 1, {"=", "{", ";", ","})
                self.types(j + 1, end)
                j = end
            return j
        return self._called(i)

    def _called(self, i: int) -> int:
        j = self.generics(i + 1)
        if self.text(j) == "(" and self.is_name(i):
            self.call(i, j)
        return i + 1

    def event_of(self, open_: int) -> str:
        """The name in the argument ``name`` or ``forName``: a string or a .member."""
        for a, b in self.commas(open_):
            if self.text(a) in ("name", "forName") and self.text(a + 1) == ":":
                if string := next((bare(self.text(j)) for j in range(a, b) if self.kind(j) == "str"), ""):
                    return string
                if self.text(b - 2) == ".":
                    return self.text(b - 1)
        return super().event_of(open_)

    def _container(self, kind: str, i: int) -> int:
        name = self.text(i + 1)
        j = i + 2
        while self.text(j) == ".":
            name, j = self.text(j + 1), j + 2
        j = self.generics(j)
        body = self.until(j, {"{", ";", kind}, newline=False)
        if self.text(body) != "{":
            return j
        close = self.match.get(body, body)
        if kind != "extension":
            self.symbol(name, "interface" if kind == "protocol" else "class", i, close)
        if self.text(self.skip_lines(j)) == ":":
            number, k = 0, self.skip_lines(j) + 1
            while k < body and self.text(k) != "where":
                if self.is_name(k):
                    base, at = self.text(k), k
                    while self.text(k + 1) == ".":
                        base, k = self.text(k + 2), k + 2
                    self.ref(base, "implements" if number or kind == "extension" else "extends", at, name)
                    number += 1
                    k = max(self.generics(k + 1), k + 1)
                else:
                    k += 1
        self.enter(name, "container", close)
        return body + 1

    def _function(self, i: int) -> int:
        is_init = self.text(i) == "init"
        name = "init" if is_init else self.text(i + 1)
        j = i + 1 if is_init else i + 2
        j += self.text(j) in ("?", "!")
        after = self.generics(j)
        generic = {self.text(k) for k in range(j, after) if self.kind(k) == "id" and self.text(k - 1) in ("<", ",")}
        self.types(j + 1, after - 1, name, generic)
        j = after
        if self.text(j) != "(":
            return max(j, i + 1)
        for a, b in self.commas(j):
            colon = next((k for k in range(a, b) if self.text(k) == ":"), b)
            stop = next((k for k in range(colon, b) if self.text(k) == "="), b)
            self.types(colon + 1, stop, name, generic)
        j = self.match.get(j, j) + 1
        while self.text(self.skip_lines(j)) in ("async", "throws", "rethrows"):
            j = self.skip_lines(j) + 1
        if self.text(self.skip_lines(j)) == "->":
            j = self.skip_lines(j) + 1
            end = self.until(j, {"{", "where", ";"})
            self.types(j, end, name, generic)
            j = end
        body = self.skip_lines(j)
        if self.text(body) == "where":
            body = self.until(body, {"{"}, newline=False)
        has = self.text(body) == "{"
        close = self.match.get(body, body) if has else j - 1
        method = bool(self.frames) and self.frames[-1].kind == "container"
        if not is_init:
            self.symbol(name, "method" if method else "function", i, close)
        if has:
            self.enter(name, "function", close)
            return body + 1
        return j


class Ruby(Reader):
    language = "ruby"
    OPENS = {"class", "module", "def", "begin", "case", "if", "unless", "while", "until", "for"}

    def __init__(self, source: str):
        super().__init__(source)
        self.ends = self._ends()

    def _starts(self, i: int) -> bool:
        """Whether a statement starts here, so that ``if`` opens a block and isn't a modifier."""
        return self.kind(i - 1) in ("nl", "") or self.text(i - 1) in (";", "=", "(", "{", "|", "then", "else", "do", "return", "begin", "ensure", "&&", "||")

    def _ends(self) -> dict[int, int]:
        """The ``end`` of every word that needs one; the do of a loop shares the loop's."""
        open_: list[int] = []
        out: dict[int, int] = {}
        loop = -1  # the line of a loop that may still have its do
        for i, t in enumerate(self.toks):
            if t.kind != "id" or self.text(i - 1) in (".", "?.", "::") or self.text(i + 1) == ":" and t.text != "else":
                continue
            if t.text == "end" and open_:
                out[open_.pop()] = i
            elif t.text == "do":
                if loop != t.line:
                    open_.append(i)
                loop = -1
            elif t.text in self.OPENS and (t.text in ("class", "module", "def", "begin", "case", "for") or self._starts(i)):
                if t.text == "def" and self._endless(i):
                    continue
                open_.append(i)
                if t.text in ("while", "until", "for"):
                    loop = t.line
        for i in open_:
            out[i] = len(self.toks) - 1
        return out

    def _endless(self, i: int) -> bool:
        j = i + 2
        while self.text(j) == ".":
            j += 2
        if self.text(j) == "(":
            j = self.match.get(j, j) + 1
        return self.text(j) == "="

    def step(self, i: int) -> int:
        text, prev = self.text(i), self.text(i - 1)
        if self.kind(i) != "id" or text.startswith(("@", "$")):
            return i + 1
        if prev in (".", "?."):
            if text == "class" or text not in KEYWORDS["ruby"]:
                self._call(i)
            return i + 1
        if text in ("class", "module") and self.kind(i + 1) == "id" and prev != "::":
            name, j = self.text(i + 1), i + 2
            while self.text(j) == "::":
                name, j = f"{name}::{self.text(j + 1)}", j + 2
            close = self.ends.get(i, i)
            self.symbol(name, "class", i, close)
            if self.text(j) == "<" and self.kind(j + 1) == "id":
                base, at = self.text(j + 1), j + 1
                j += 2
                while self.text(j) == "::":
                    base, j = f"{base}::{self.text(j + 1)}", j + 2
                self.ref(base, "extends", at, name)
            self.enter(name, "container", close)
            return j
        if text == "def":
            j = i + 1
            while self.text(j + 1) == ".":
                j += 2
            close = self.ends.get(i, self.until(i, {";"}) - 1)
            name = self.text(j)
            self.symbol(name, "method" if self.scope else "function", i, close)
            self.enter(name, "function", close)
            return j + 1
        if text in ("require", "require_relative") and self._starts(i):
            self.symbol("", "import", i, scope="")
            return self.until(i, {";"})
        if text in ("include", "extend", "prepend") and self._starts(i):
            end = self.until(i, {";"})
            for j in range(i + 1, end):
                if self.kind(j) == "id" and self.text(j)[:1].isupper() and self.text(j + 1) != "::":
                    self.ref(self.text(j), "implements", j)
            return end
        if text[:1].isupper() and self.text(i + 1) == "=" and self._starts(i):
            self.symbol(text, "variable", i)
            return i + 2
        follows = self.kind(i + 1) in ("str", "num", "id") and self.text(i + 1) not in KEYWORDS["ruby"] - {"self", "nil", "true", "false"}
        if text not in KEYWORDS["ruby"] and (self.text(i + 1) == "(" or follows and self._starts(i) and not text[:1].isupper()):
            self._call(i)
        return i + 1

    def _call(self, i: int) -> None:
        if self.text(i + 1) == "(":
            self.call(i, i + 1)
            return
        name = self.text(i)
        if name in REGISTERS["ruby"] | FIRES["ruby"] and self.kind(i + 1) == "str":
            self.ref(bare(self.text(i + 1)), "registers_on" if name in REGISTERS["ruby"] else "fires", i)
        elif name not in BUILTIN_CALLS["ruby"]:
            self.ref(name, "calls", i)


READERS = {"typescript": TypeScript, "javascript": TypeScript, "php": Php, "go": Go, "swift": Swift, "ruby": Ruby}


def read(language: str, source: str) -> Found:
    return READERS[language](source).read()
