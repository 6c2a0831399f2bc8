"""Chunkers: text to (content, start_line, end_line, heading, parent, key_path, kind) rows.

Where the next cut depends on the last one the work is sequential within a document and
parallel across documents. Lines count from 1.
"""

from __future__ import annotations

import ast
import html.parser
import json
import re
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame

from . import grammar
from .tables import flat_map


@dataclass(frozen=True)
class Chunk:
    content: str
    start_line: int
    end_line: int
    heading: str = ""
    parent: str = ""
    key_path: str = ""
    kind: str = "text"


# Scores of the places at which markdown may be cut.
BREAKS = [
    (r"^# ", 100), (r"^## ", 90), (r"^### ", 80), (r"^#### ", 70), (r"^##### ", 60), (r"^###### ", 50),
    (r"^(?:```|~~~)", 80), (r"^(?:-{3,}|\*{3,}|_{3,})[ \t]*$", 60), (r"\n\n", 20), (r"^[ \t]*(?:[-*+]|\d+\.) ", 5), (r"\n", 1),
]
MAX_CHARS, OVERLAP_CHARS, WINDOW_CHARS, DECAY = 3600, 540, 800, 0.7
PLAIN_CHARS, PLAIN_OVERLAP_LINES, NESTED_CHARS, CODE_BUDGET = 1024, 3, 2048, 512
HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)


def break_points(text: str) -> list[tuple[int, int]]:
    """(place, score) in order; of several at one place the best score counts."""
    best: dict[int, int] = {}
    for pattern, score in BREAKS:
        for m in re.finditer(pattern, text, re.M):
            best[m.start()] = max(score, best.get(m.start(), 0))
    return sorted(best.items())


def fences(text: str) -> list[tuple[int, int]]:
    """Regions of fenced code; an open fence runs to the end."""
    out, start, mark = [], None, ""
    for m in re.finditer(r"^(```|~~~)[^\n]*$", text, re.M):
        if start is None:
            start, mark = m.start(), m[1]
        elif m[1] == mark:
            out.append((start, m.end()))
            start = None
    return out + ([(start, len(text))] if start is not None else [])


def best_cut(points: list[tuple[int, int]], code: list[tuple[int, int]], target: int, window: int = WINDOW_CHARS, decay: float = DECAY) -> int:
    """The place up to ``window`` before the target whose score, faded by distance, is best; else the target."""
    top, place = -1.0, target
    for at, score in points:
        if target - window <= at <= target and not any(a < at < b for a, b in code):
            faded = score * (1 - decay * ((target - at) / window) ** 2)
            if faded > top:
                top, place = faded, at
    return place


def headings_at(text: str, at: int) -> tuple[str, str]:
    """The heading in force at a place and that heading's parent."""
    open_: list[tuple[int, str]] = []
    for m in HEADING.finditer(text):
        if m.start() > at:
            break
        while open_ and open_[-1][0] >= len(m[1]):
            open_.pop()
        open_.append((len(m[1]), m[2]))
    return (open_[-1][1] if open_ else ""), (open_[-2][1] if len(open_) > 1 else "")


def chunk_markdown(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, window: int = WINDOW_CHARS, decay: float = DECAY) -> list[Chunk]:
    """Cut at the best break before each target; neighbours share ``overlap`` characters."""
    if not text.strip():
        return []
    points, code, out, start = break_points(text), fences(text), [], 0
    while start < len(text):
        end = len(text)
        if end - start > most:
            end = best_cut([p for p in points if start < p[0]], code, start + most, window, decay)
        body = text[start:end]
        if body.strip():
            first = text.count("\n", 0, start) + 1
            heading, parent = headings_at(text, max(start, end - 1))
            out.append(Chunk(body, first, first + body.rstrip("\n").count("\n"), heading, parent, kind="markdown"))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1) if end - overlap > start else end
    return out


def chunk_headers(text: str, most: int = 1024, overlap: int = 128) -> list[Chunk]:
    """One chunk a section of #, ## or ###; larger sections are cut with an overlap."""
    marks = [m.start() for m in re.finditer(r"^#{1,3} ", text, re.M)]
    edges = sorted({0, *marks, len(text)})
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        for s in range(a, b, max(1, most - overlap)):
            body = text[s : min(b, s + most)]
            if body.strip():
                first = text.count("\n", 0, s) + 1
                heading, parent = headings_at(text, s)
                out.append(Chunk(body, first, first + body.rstrip("\n").count("\n"), heading, parent, kind="markdown"))
            if s + most >= b:
                break
    return out


def chunk_plain(text: str, kind: str = "text", most: int = PLAIN_CHARS, overlap: int = PLAIN_OVERLAP_LINES) -> list[Chunk]:
    """Whole lines up to ``most`` characters (a first line always fits), ``overlap`` lines shared."""
    if not text.strip():
        return []
    lines, out, start = text.split("\n"), [], 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end]) + 1 <= most):
            size += len(lines[end]) + 1
            end += 1
        body = "\n".join(lines[start:end])
        if body.strip():
            out.append(Chunk(body, start + 1, end, kind=kind))
        if end >= len(lines):
            break
        start = max(end - overlap, start + 1)
    return out


def _by_key(value, dump, path: str, kind: str) -> list[Chunk]:
    text = dump(value)
    if isinstance(value, dict) and len(text) > NESTED_CHARS:
        return [c for k, v in value.items() for c in _by_key(v, dump, f"{path}.{k}" if path else str(k), kind)]
    return [Chunk(f"{path}: {text}" if path else text, 1, 1 + text.count("\n"), heading=path.split(".")[0], key_path=path, kind=kind)]


def _keyed(data, dump, kind: str, raw: str) -> list[Chunk]:
    if not isinstance(data, dict) or not data:
        return [Chunk(raw, 1, 1 + raw.count("\n"), kind=kind)] if raw.strip() else []
    return [c for k, v in data.items() for c in _by_key(v, dump, str(k), kind)]


def chunk_yaml(text: str) -> list[Chunk]:
    """A chunk for each top-level key, large ones by nested key; unknown tags or another root: one raw chunk."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        data = None
    return _keyed(data, lambda v: yaml.dump(v, allow_unicode=True).rstrip("\n"), "yaml", text)


def plain_json(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out, flags=re.S)


def chunk_json(text: str) -> list[Chunk]:
    """A chunk for each top-level key; JSON with comments is tried second, broken JSON is one raw chunk."""
    data = None
    for attempt in (text, plain_json(text)):
        try:
            data = json.loads(attempt)
            break
        except ValueError:
            continue
    return _keyed(data, lambda v: json.dumps(v, indent=2, ensure_ascii=False), "json", text)


class _Visible(html.parser.HTMLParser):
    SKIP = {"script", "style", "svg", "noscript"}
    BLOCKS = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.mute = [], False

    def handle_starttag(self, tag, attrs):
        self.mute = self.mute or tag in self.SKIP

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.mute = False
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)


def visible_text(markup: str) -> str:
    """Text without markup, a newline after each block, at most one empty line in a row."""
    p = _Visible()
    p.feed(markup)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.parts)).strip()


def chunk_markup(text: str, kind: str = "html") -> list[Chunk]:
    return chunk_plain(visible_text(text), kind)


#: Symbols that make a chunk of their own.
DEFINITIONS = {"function", "method", "class", "interface", "trait", "enum", "type"}


def _blocks(text: str, language: str) -> list[tuple[int, int, bool]] | None:
    """Top-level pieces (first line, last line, is a definition); None if the language has no splitter."""
    n = text.count("\n") + 1
    if language == "python":
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return None
        out = []
        for node in body:
            first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
            out.append((first, node.end_lineno, isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))))
        return out
    if language not in grammar.READERS:
        return None
    spans: list[tuple[int, int]] = []
    for first, last in sorted((s[2], s[3]) for s in grammar.read(language, text).symbols if s[1] in DEFINITIONS):
        if not spans or first > spans[-1][1]:  # what stands inside another definition belongs to it
            spans.append((first, last))
    edges = [0, *[last for _, last in spans]], [*[first for first, _ in spans], n + 1]
    gaps = [(a + 1, b - 1, False) for a, b in zip(*edges, strict=True) if a + 1 < b]
    return sorted([*gaps, *[(a, b, True) for a, b in spans]])


def chunk_code(text: str, language: str, budget: int = CODE_BUDGET) -> list[Chunk]:
    """A chunk for each top-level definition; other pieces merge while their solid characters fit the budget."""
    if not text.strip():
        return []
    lines = text.split("\n")
    blocks = _blocks(text, language)
    if not blocks:
        return [Chunk(text, 1, len(lines), kind="module")]
    solid = lambda a, b: len(re.sub(r"\s", "", "\n".join(lines[a - 1 : b])))
    out: list[Chunk] = []
    held: list[tuple[int, int]] = []

    def flush() -> None:
        if held and "\n".join(lines[held[0][0] - 1 : held[-1][1]]).strip():
            out.append(Chunk("\n".join(lines[held[0][0] - 1 : held[-1][1]]), held[0][0], held[-1][1], kind="merged"))
        held.clear()

    for a, b, definition in blocks:
        if definition:
            flush()
            out.append(Chunk("\n".join(lines[a - 1 : b]), a, b, kind="definition"))
            continue
        if held and sum(solid(*x) for x in held) + solid(a, b) > budget:
            flush()
        held.append((a, b))
    flush()
    return out


def chunk_file(path: str, text: str, language: str | None = None) -> list[Chunk]:
    """Choose the chunker by the file's extension."""
    ext = path.lower().rsplit(".", 1)[-1]
    if language:
        return chunk_code(text, language)
    if ext in ("md", "mdx", "pdf"):
        return chunk_markdown(text)
    if ext in ("yaml", "yml"):
        return chunk_yaml(text)
    if ext == "json":
        return chunk_json(text)
    if ext in ("html", "htm"):
        return chunk_markup(text)
    if ext in ("xml", "xsl", "xslt", "svg"):
        return chunk_markup(text, "xml")
    return chunk_plain(text)


SCHEMA = "id bigint, chunk int, content string, start_line int, end_line int, heading string, parent string, key_path string, kind string"


def chunk_table(docs: DataFrame, chunker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks of every document, numbered from 0; null texts have none."""

    def make(i, text):
        for n, c in enumerate(chunker(text) if text else []):
            yield (i, n, c.content, c.start_line, c.end_line, c.heading, c.parent, c.key_path, c.kind)

    return flat_map(docs, [id_col, text_col], SCHEMA, make)
