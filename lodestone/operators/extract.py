"""Symbols and references of source files: a registry of extractors behind one table function.

Python is read with its own parser; TypeScript, JavaScript, PHP, Go, Swift and Ruby token by
token (``grammar``); other languages by line patterns, which find definitions, calls,
inheritance and imports but not every construct of a grammar.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from . import grammar
from .grammar import Found
from .tables import flat_map


EXTRACTORS: dict[str, Callable[[str], Found]] = {}


def extractor(*languages: str):
    def add(f):
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return add


@extractor("python")
def python_file(source: str) -> Found:
    """Functions, classes, methods, imports; calls (outer before inner), bases and signals."""
    out, lines = Found(), source.split("\n")
    sign = lambda node: lines[node.lineno - 1].rstrip()
    signals = {"connect": "registers_on", "send": "fires", "send_robust": "fires"}

    def name_of(node) -> str:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""

    def visit(node, scope: str, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.symbols.append((child.name, "method" if scope else "function", child.lineno, child.end_lineno, scope, sign(child)))
                visit(child, "", child.name)
            elif isinstance(child, ast.ClassDef):
                out.symbols.append((child.name, "class", child.lineno, child.end_lineno, scope, sign(child)))
                for base in child.bases:
                    if name_of(base):
                        out.refs.append((child.name, name_of(base), "extends", child.lineno, ""))
                visit(child, child.name, child.name)
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out.symbols.append(("", "import", child.lineno, child.end_lineno, scope, sign(child)))
            else:
                if isinstance(child, ast.Call) and (to := name_of(child.func)):
                    kind = signals.get(to) if isinstance(child.func, ast.Attribute) else None
                    target = name_of(child.func.value) if kind else ""
                    out.refs.append((owner or "<module>", target or to, kind if target else "calls", child.lineno, ""))
                visit(child, scope, owner)

    visit(ast.parse(source), "", "")
    return out


# Words that look like calls but are not.
NOT_CALLS = set("async await if for while switch catch return function func def class new elif unless until case do guard match foreach array list isset empty echo print include require range len cap make append panic typeof import super puts private public protected attr_accessor attr_reader".split())
RULES = {
    "rust": [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(\w+)", "class"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "interface"),
        (r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)", "scope"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe)\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "function"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type_alias"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\b()", "import"),
    ],
    "java": [
        (r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(\w+)", "class"),
        (r"^\s*(?:(?:public|private|protected|static|sealed)\s+)*@?interface\s+(\w+)", "interface"),
        (r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)", "enum"),
        (r"^\s*(?!return\b|new\b|else\b|throw\b)(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?(?:[\w.]+(?:<[^(]*>)?(?:\[\])*\s+)?(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w,. ]+)?\{", "function"),
        (r"^\s*import\b()", "import"),
    ],
    "csharp": [
        (r"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly)\s+)*(?:class|struct|record)\s+(\w+)", "class"),
        (r"^\s*(?:(?:public|private|protected|internal|partial)\s+)*interface\s+(\w+)", "interface"),
        (r"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+(\w+)", "enum"),
        (r"^\s*(?!return\b|new\b|else\b|throw\b|await\b)(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial|extern)\s+)*(?:[\w.]+(?:<[^(]*>)?[?\[\]]*\s+)(\w+)(?:<[^>]*>)?\s*\([^;]*\)\s*(?:\{|=>|$)", "function"),
        (r"^\s*(?:global\s+)?using\s+()[\w.]+\s*;", "import"),
    ],
    "kotlin": [
        (r"^\s*(?:(?:public|private|internal|protected|data|sealed|open|abstract|inner|value|annotation)\s+)*(?:class|object)\s+(\w+)", "class"),
        (r"^\s*(?:(?:public|private|internal|sealed|fun)\s+)*interface\s+(\w+)", "interface"),
        (r"^\s*(?:(?:public|private|internal)\s+)*enum\s+class\s+(\w+)", "enum"),
        (r"^\s*(?:(?:public|private|internal|protected|override|open|abstract|suspend|inline|operator|tailrec|infix)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(", "function"),
        (r"^\s*typealias\s+(\w+)", "type_alias"),
        (r"^\s*import\b()", "import"),
    ],
    "c": [
        (r"^\s*(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*\{", "class"),
        (r"^\s*(?:typedef\s+)?enum\s+(\w+)\s*\{", "enum"),
        (r"^(?!\s|return\b|else\b|typedef\b)(?:[\w]+[\s*]+)+(\w+)\s*\([^;]*$", "function"),
        (r"^\s*#\s*include\b()", "import"),
    ],
    "cpp": [
        (r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|union)\s+(\w+)[^;]*\{", "class"),
        (r"^\s*enum\s+(?:class\s+|struct\s+)?(\w+)", "enum"),
        (r"^\s*namespace\s+(\w+)\s*\{", "scope"),
        (r"^(?!\s|return\b|else\b|typedef\b)(?:[\w:<>,*&]+\s+)*[*&]*(?P<scope>\w+)::(~?\w+)\s*\([^;]*$", "method"),
        (r"^\s*(?!return\b|else\b|typedef\b|throw\b|new\b|delete\b)(?:[\w:<>,]+[\s*&]+)+(\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{", "function"),
        (r"^\s*#\s*include\b()", "import"),
    ],
}
BASES = {
    "rust": [(r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s", "implements"), (r"\btrait\s+\w+\s*:\s*([\w:, +]+?)\s*\{", "extends")],
    "java": [(r"\bextends\s+([\w.]+)", "extends"), (r"\bimplements\s+([\w.,\s]+?)\s*(?:\{|$)", "implements")],
    "csharp": [],
    "kotlin": [],
    "c": [],
    "cpp": [(r"\b(?:class|struct)\s+\w+[^:{]*:\s*(?:(?:public|private|protected|virtual)\s+)*([\w:]+)", "extends")],
}
CALL = re.compile(r"(?:new\s+)?([A-Za-z_]\w*[?!]?)\s*\(")
CONTAINERS = {"class", "interface", "trait", "enum", "scope"}
#: Languages whose first base after a colon is a class and whose others are interfaces, and what may stand before it.
COLON_BASES = {
    "csharp": r"(?:class|struct|record|interface)\s+\w+(?:<[^>]*>)?\s*:\s*([\w,.\s]+)",
    "kotlin": r"(?:class|object|interface)\s+\w+(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*:\s*([\w,.\s()]+)",
}


def _patterned(language: str):
    def run(source: str) -> Found:
        out = Found()
        lines = source.split("\n")
        rules = [(re.compile(p), k) for p, k in RULES[language]]
        indent_of = lambda s: len(s) - len(s.lstrip())
        scopes: list[tuple[int, str]] = []
        owner, owner_indent = "<module>", -1
        for n, raw in enumerate(lines, 1):
            line = re.sub(r"(?<!:)//.*", "", raw)
            if not line.strip():
                continue
            indent = indent_of(line)
            while scopes and indent <= scopes[-1][0] and line.strip() not in ("{", "}", "end"):
                scopes.pop()
            if indent <= owner_indent and line.strip() not in ("{", "}", "end"):
                owner, owner_indent = "<module>", -1
            defined = ""
            for rule, kind in rules:
                m = rule.search(line)
                if not m or (kind == "method" and m[1] in NOT_CALLS):
                    continue
                scope = m.groupdict().get("scope") or (scopes[-1][1] if scopes else "")
                defined = m[m.lastindex or 0] if kind != "import" else ""
                kind = "method" if kind == "function" and scope else kind
                if kind != "scope":
                    out.symbols.append((defined, kind, n, _end(lines, n, indent), scope, raw.rstrip()))
                if kind in CONTAINERS:
                    scopes.append((indent, defined))
                if kind in ("function", "method"):
                    owner, owner_indent = defined, indent
                break
            holder = defined or (scopes[-1][1] if scopes else owner)
            for rule, kind in BASES[language]:
                for m in re.finditer(rule, line):
                    for name in re.split(r"[,\s]+", m[1].strip()):
                        if name:
                            out.refs.append((holder, name, kind, n, ""))
            if language in COLON_BASES and defined and (m := re.search(COLON_BASES[language], line)):
                for i, name in enumerate(x for y in m[1].split(",") if (x := re.sub(r"\(.*", "", y).strip())):
                    out.refs.append((defined, name, "implements" if i else "extends", n, ""))
            for m in CALL.finditer(line):
                name = m[1]
                if name not in NOT_CALLS and name != defined:
                    out.refs.append((owner, name, "calls", n, ""))
        return out

    return run


def _end(lines: list[str], n: int, indent: int) -> int:
    """The last line that is indented deeper, or closes the block."""
    last = n
    for i in range(n, len(lines)):
        s = lines[i]
        if not s.strip():
            continue
        deeper = len(s) - len(s.lstrip()) > indent
        if not deeper:
            return i + 1 if s.strip()[0] in "}e" and s.strip()[:3] in ("}", "end", "});") else last
        last = i + 1
    return last


for _language in RULES:
    extractor(_language)(_patterned(_language))
for _language in grammar.READERS:
    EXTRACTORS[_language] = partial(grammar.read, _language)


def extract(language: str, source: str) -> Found:
    """What a file holds, with a ``<module>`` symbol for its top level; unknown languages hold only that."""
    try:
        found = EXTRACTORS[language](source) if language in EXTRACTORS else Found()
    except (SyntaxError, ValueError, RecursionError):
        found = Found()
    found.symbols.append(("<module>", "module", 1, None, "", ""))
    return found


def symbols_table(files: DataFrame) -> DataFrame:
    """Symbols of files (file, language, content)."""
    return flat_map(files, ["file", "language", "content"], "file string, name string, kind string, line int, end_line int, scope string, signature string", lambda f, lang, src: [(f, *s) for s in extract(lang or "", src or "").symbols])


def refs_table(files: DataFrame) -> DataFrame:
    """References of files (file, language, content)."""
    return flat_map(files, ["file", "language", "content"], "file string, from_name string, to_name string, kind string, line int, subtype string", lambda f, lang, src: [(f, *r) for r in extract(lang or "", src or "").refs])
