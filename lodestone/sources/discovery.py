"""Finding files: walk, ignore rules, languages, routing, assets and package names."""

from __future__ import annotations

import mimetypes
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx

# Folders never entered, files never read, extensions by language and asset class.
PRUNED = ["node_modules", "vendor", "dist", "build", "scripts"]
SECRET = [".env*", "*.pem", "*.key", "*.p12", "*.pfx", "*credentials*", "*secret*", "id_rsa", "id_ed25519", "*.token", "service-account.json"]
IGNORED = [
    ".git/", "__pycache__/", "*.pyc", "*.pyo", ".venv/", "venv/", ".egg-info/", "dist/", "build/", "node_modules/", "npm-debug.log", ".npm/", "vendor/",
    "composer.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", ".next/", "out/", ".turbo/", ".vscode/", ".idea/", "*.swp", "*.swo", ".DS_Store",
    ".tsc/", "coverage/", ".nyc_output/", ".pytest_cache/", ".ruff_cache/", ".webpack-cache/", ".webpack-cache-legacy/", ".nx/", ".cursor/", ".husky/",
    ".serena/", ".phpstan-cache/", "*.log", ".gitignore",
]
LANGUAGES = {
    "python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs"], "php": ["php"], "go": ["go"], "swift": ["swift"], "ruby": ["rb"],
    "rust": ["rs"], "java": ["java"], "csharp": ["cs"], "kotlin": ["kt"], "c": ["c", "h"], "cpp": ["cpp", "cc", "hpp"],
}
ROUTES = {"markdown": ["pdf", "md", "mdx"], "yaml": ["yaml", "yml"], "json": ["json"], "html": ["html", "htm"], "xml": ["xml", "xsl", "xslt", "svg"], "text": ["txt", "rst", "csv", "tsv", "log", "ini", "cfg", "toml", "conf"]}
ASSETS = {
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "webp", "ico", "tiff", "heif", "heic", "avif", "svg"],
    "video": ["mp4", "mkv", "webm", "avi", "mov", "flv"],
    "audio": ["mp3", "wav", "aac", "flac", "m4a", "opus"],
    "font": ["woff", "woff2", "ttf", "otf"],
    "archive": ["zip", "tar", "gz", "rar", "7z"],
}


# Media types that the standard table misses or differs on.
MEDIA = {"woff": "font/woff", "woff2": "font/woff2", "opus": "audio/opus", "heif": "image/heif", "heic": "image/heic", "avif": "image/avif"}


def media_type(path: Column) -> Column:
    """The MIME type of a file's extension, of all extensions that are routed."""
    known = {x for exts in [*LANGUAGES.values(), *ROUTES.values(), *ASSETS.values()] for x in exts}
    types = {x: MEDIA.get(x) or mimetypes.types_map.get(f".{x}") for x in sorted(known)}
    table = F.create_map(*[F.lit(v) for x, t in types.items() if t for v in (x, t)])
    return F.coalesce(table[tx.extension(path)], F.lit("application/octet-stream"))


def glob_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over relative paths."""
    folder, body = pattern.endswith("/"), pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    out = re.escape(body).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, user: list[str] | None = None) -> Column:
    """Whether a path is left out: secrets always, then the last rule that matches; ``!`` takes a path back in."""
    groups: list[tuple[bool, list[str]]] = []  # runs of rules of one sign, each one expression
    for rule in [*IGNORED, *(user or [])]:
        if not rule.strip() or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        if not groups or groups[-1][0] != keep:
            groups.append((keep, []))
        groups[-1][1].append(glob_regex(rule.removeprefix("!")))
    out = F.lit(False)
    for keep, rules in groups:
        out = F.when(path.rlike("|".join(rules)), F.lit(not keep)).otherwise(out)
    return path.rlike("(?i)" + "|".join(glob_regex(r) for r in SECRET)) | out


def _by_extension(ext: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, exts in table.items():
        out = F.when(ext.isin(exts), F.lit(name)).otherwise(out)
    return out


def language(path: Column) -> Column:
    return _by_extension(tx.extension(path), LANGUAGES)


def route(path: Column) -> Column:
    """code, a document format or asset; null for files that aren't indexed."""
    ext = tx.extension(path)
    return F.coalesce(F.when(language(path).isNotNull(), F.lit("code")), _by_extension(ext, ROUTES), F.when(_by_extension(ext, ASSETS).isNotNull(), F.lit("asset")))


def source_type(path: Column) -> Column:
    """What a search may be restricted to: the route, but the extension of plain text files, and pdf."""
    ext = tx.extension(path)
    return F.when((route(path) == "text") | (ext == "pdf"), ext).otherwise(route(path))


def asset_class(path: Column) -> Column:
    return _by_extension(tx.extension(path), ASSETS)


def asset_text(path: Column, size: Column, width: Column, height: Column) -> Column:
    """The searchable line of a binary file: words of its name, class, dimensions and size."""
    words = F.regexp_replace(F.regexp_replace(tx.basename(path), "\\.[^.]*$", ""), "[-_.]+", " ")
    dims = F.when(width.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))
    return F.concat_ws(" ", words, asset_class(path), dims, tx.human_size(size))


def discover(spark: SparkSession, root: str, user: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """path (relative), language, route, mime, size, hash and content of the files under a folder, or of ``only`` these.

    Files are listed first, by Spark on the driver as always, and only those that pass the
    rules are opened: no content of pruned folders is read.
    """
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^\\w+:/*", "/"), "^" + re.escape(base), "")
    if only is None:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(rel.alias("path"))
        hidden = F.col("path").rlike("(?:^|/)\\.[^/]+/") | F.col("path").rlike("(?:^|/)(?:" + "|".join(PRUNED) + ")/") | F.col("path").endswith(".d.ts")
        only = [r.path for r in listed.filter(~hidden & ~ignored(F.col("path"), user) & route(F.col("path")).isNotNull()).collect()]
    if only:
        literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in only]  # names are no globs
        rows = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in literal]).select(rel.alias("path"), F.col("length").alias("size"), "content")
    else:
        rows = spark.createDataFrame([], "path string, size bigint, content binary")
    path = F.col("path")
    return rows.withColumn("language", language(path)).withColumn("route", route(path)).withColumn("mime", media_type(path)).withColumn("hash", F.sha2("content", 256))


def dimensions(content: Column) -> tuple[Column, Column]:
    """Width and height of PNG, GIF and BMP images from their first bytes, JVM-side, and of JPEG images from their frame header."""
    head = F.hex(F.substring(content, 1, 26))

    def number(at: int, size: int, little: bool) -> Column:
        digits = [F.substring(head, 2 * i + 1, 2) for i in range(at, at + size)]
        return F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("long")

    def signed(c: Column) -> Column:
        return F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))

    png, gif, bmp = head.startswith("89504E470D0A1A0A"), head.startswith("474946"), head.startswith("424D")
    width = F.when(png, number(16, 4, False)).when(gif, number(6, 2, True)).when(bmp, signed(number(18, 4, True)))
    height = F.when(png, number(20, 4, False)).when(gif, number(8, 2, True)).when(bmp, signed(number(22, 4, True)))
    jpeg = _jpeg(F.when(head.startswith("FFD8"), F.substring(content, 1, JPEG_HEAD)))
    return F.coalesce(width, jpeg["width"]), F.coalesce(height, jpeg["height"])


def jpeg_dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


#: Bytes of a JPEG that are searched for its first frame header.
JPEG_HEAD = 1 << 18


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _jpeg(heads: pd.Series) -> pd.DataFrame:
    found = [(jpeg_dimensions(bytes(h)) if h is not None else None) or (None, None) for h in heads]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int64")


def manifests(files: DataFrame) -> DataFrame:
    """folder and name of the package manifests among files (path, content); the best kind of a folder counts."""
    text, base = F.col("content").cast("string"), tx.basename(F.col("path"))
    in_json = F.get_json_object(text, "$.name")
    section = F.regexp_extract(text, r"(?s)(?:^|\n)\[project\][ \t]*\r?\n(.*?)(?:\n\[|\z)", 1)
    in_toml = F.regexp_extract(section, r"""(?:^|\n)[ \t]*name[ \t]*=[ \t]*["']([^"'\n]+)["']""", 1)
    name = F.when(base.isin("package.json", "composer.json"), in_json).when(base == "pyproject.toml", F.nullif(in_toml, F.lit("")))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    order = F.when(base == "package.json", 0).when(base == "composer.json", 1).otherwise(2)
    return files.select(folder.alias("folder"), name.alias("name"), order.alias("o")).filter("name is not null").groupBy("folder").agg(F.min_by("name", "o").alias("name"))


def package_names(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path and the package name of its nearest manifest folder (manifests: folder, name; '' is the root)."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = files.select("path", F.explode(folders).alias("folder"))
    return up.join(manifests, "folder").groupBy("path").agg(F.max_by("name", F.length("folder")).alias("package"))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return ~(path.startswith("/") | path.rlike("(?:^|/)\\.\\.(?:/|$)") | path.contains("\x00"))
