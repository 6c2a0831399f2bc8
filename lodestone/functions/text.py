"""Text, path and hash expressions, all JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, by Unicode decomposition."""
    pairs = [(c, b) for c in map(chr, range(0xC0, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics (Latin-1, Latin Extended-A and -B)."""
    return F.translate(F.lower(text), *_fold_table())


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the folded text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def words_only(text: Column) -> Column:
    """Lower-case runs of a-z, as used to compare queries with names."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), "\\.([A-Za-z0-9]+)$", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def docid(content: Column) -> Column:
    """First six hex digits of the SHA-256; zeros for empty content."""
    return F.when(F.length(F.coalesce(content, F.lit(""))) == 0, F.lit("000000")).otherwise(F.substring(F.sha2(content, 256), 1, 6))


def normalize_bm25(raw: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), -raw / (F.lit(1.0) + F.abs(raw))))


def solid_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\s", ""))


def last_segment(name: Column) -> Column:
    """What follows the last backslash or dot of a qualified name."""
    return F.regexp_extract(name, "([^\\\\.]*)$", 1)


def common_segments(a: Column, b: Column) -> Column:
    """Number of equal leading path segments, file names left out."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.element_at(x, i) == F.element_at(y, i)))
    first_off = F.array_position(same, F.lit(False))
    return F.when(n <= 0, 0).when(first_off == 0, n).otherwise(first_off - 1).cast("long")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(F.round(n / 1024, 1).cast("string"), F.lit("KB"))).otherwise(F.concat(F.round(n / (1 << 20), 1).cast("string"), F.lit("MB")))


def name_variants(query: str) -> str:
    """A query and its hyphen, camel and snake spellings, joined by OR; one word stays alone."""
    words = [w for w in query.split() if w.isalpha()]
    if len(words) < 2:
        return query
    low = [w.lower() for w in words]
    return f'{query} OR "{"-".join(low)}" OR "{low[0] + "".join(w.capitalize() for w in low[1:])}" OR "{"_".join(low)}"'


def visible_text(html: Column) -> Column:
    """Tags, scripts, styles and comments out, white space collapsed (a native approximation)."""
    bare = F.regexp_replace(html, "(?is)<(script|style|svg|noscript)[^>]*>.*?</(script|style|svg|noscript)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def strip_jsonc(text: Column) -> Column:
    """JSON with comments and trailing commas made plain."""
    no_block = F.regexp_replace(text, "(?s)/\\*.*?\\*/", "")
    no_line = F.regexp_replace(no_block, "(?m)(^|[\\s,{\\[])//[^\\n]*", "$1")
    return F.regexp_replace(no_line, ",(\\s*[}\\]])", "$1")


def glob_to_like(pattern: str) -> str:
    return pattern.replace("*", "%")
