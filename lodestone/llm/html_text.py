"""Main text of web pages: declared regions, boilerplate marks and site-template removal.

A page becomes a light tree. Element subtrees are hashed bottom-up and counted per host in
Spark; those that recur across many pages of their host are the site's template and go,
with menus, forms, adverts and the like known by tag, role or class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import add_columns, prepare, scratch, sliced, unused, written

#: A subtree on at least so many pages, and this share of its host's pages, is template; pages of equal text count once.
#: So a host has at most 1 / TEMPLATE_SHARE times as many templates as a page has elements.
TEMPLATE_PAGES = 4
TEMPLATE_SHARE = 0.2
#: Inside a declared article prose must recur on this share: copies of one article are fewer.
INSIDE_SHARE = 0.6
#: Hosts with templates that are broadcast; beyond it the join shuffles.
BROADCAST_HOSTS = 10_000
FLUSH_KEYS = 100_000
#: Neighbouring recurring subtrees with this share of a page's text are its main text, copied on other pages ...
HELD_SHARE = 0.5
#: ... and so is all of it where the templates would leave less than this share.
LEFT_SHARE = 0.25
#: Characters of prose under a heading that make a block's ambiguous name a topic; a section needs only one.
TOPIC_CHARS = 200

# Element names and the words of class, id and role that mark boilerplate.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Raw text up to the end tag: without one the rest of the page is script or style; a title or text area is then empty.
RAW = set("script style".split())
RAW_LINE = set("title textarea".split())
#: Left out once their end tag is met; without one (or with '/>') they are empty and what follows is text.
EMBEDDED = set("iframe svg math canvas object select noscript template".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Inside a line of text like inline elements, though their content is none of it.
IN_LINE = INLINE | EMBEDDED | set("area audio base button col embed img input link map meta meter output picture progress source track video".split())
DROPPED = set("head nav header footer aside form button dialog menu fieldset datalist audio video map".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr privacy notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social sidebar sidebars widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer comment comments disqus reply replies respond discussion form search searchbox pagination pager skiplink toolbar hidden".split()
)
#: Words that may stand beside a mark in one name; any other word ('related-work') makes the name a topic's.
BESIDE = set(
    "site page main top bottom left right primary secondary global mobile desktop area box bar block container wrapper wrap inner outer list item items link links button buttons icon icons "
    "post posts article articles content title section slot unit zone row col column group panel region sticky fixed small large big mini nested thread form the our js skip to policy".split()
)
#: Marks that also name topics: a block of prose under a heading stays.
TOPICS = set("privacy discussion search form alert menu share header policy consent".split())
ARTICLE_WORDS = set("post article content title section".split())
#: Elements whose start ends an open element of the same family.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table article section div main body td th blockquote aside nav form header footer html".split())
CELLS = {"td", "th"}
REGION = {"article", "main"}

# Possessive throughout: a tag is read once from left to right, and one that never ends fails at once.
TAG = re.compile(r"""<(/?)([a-z][^\s/<>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""", re.I)
TAG_START = re.compile("</?[a-z]", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW | RAW_LINE}
ATTR = re.compile(r"([a-z][a-z0-9_-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("closed", "drop", "hash", "heads", "kept", "kids", "link", "mark", "prose", "region", "regions", "size", "tag")

    def __init__(self, tag: str, mark: str = "", region: bool = False):
        #: mark: '' or why it is boilerplate: 'sure', 'topic' (unless it holds prose) or 'head' (headings may stay)
        self.tag, self.mark, self.region = tag, mark, region
        self.drop = mark != ""
        self.closed = False
        self.kids: list[Node | str] = []
        self.hash = self.size = self.kept = self.link = self.prose = self.heads = self.regions = 0


@lru_cache(maxsize=65536)
def name_mark(name: str) -> str:
    """What one class or id says: '' (nothing), 'sure', 'topic' or 'head'.

    All its words must be marks or stand beside marks: 'cookie-notice' is a notice, but
    'related-work' and 'search-algorithms' are topics of an article.
    """
    words = {w.lower() for w in WORD.findall(name)}
    marks = words & MARKS
    if not marks or not words <= MARKS | BESIDE:
        return ""
    if marks == {"header"}:
        return "" if words & ARTICLE_WORDS else "head"
    return "topic" if marks <= TOPICS else "sure"


def marked(tag: str, attrs: str) -> tuple[str, bool]:
    """How an element's attributes mark it as boilerplate ('' if not), and whether as the main region."""
    if not attrs or attrs.isspace():
        return "", False
    got: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = got.get("role", "").lower()
    region = role in ("main", "article") or got.get("itemprop", "") == "articleBody"
    names = (got.get("class", "") + " " + got.get("id", "")).split()
    if tag in ("html", "body", "main"):
        return "", region
    if tag == "article":
        words = {w.lower() for name in names for w in WORD.findall(name)}
        return "sure" if words & {"comment", "comments", "reply", "ad", "advert", "related", "promo"} else "", region
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower() or role in ROLES:
        return "sure", region
    if tag in IN_LINE:
        return "sure" if tag == "a" and any("skip" in name.lower() for name in names) else "", region
    marks = {name_mark(name) for name in names}
    return next((m for m in ("sure", "topic", "head") if m in marks), ""), region


def tree_of(html: str) -> Node:
    """A tree that forgives unclosed and stray tags; raw-text elements and comments are left out.

    Time is linear in the page's length: tags are scanned once, and the places of open
    elements are kept by name. What follows a tag that never ends is text if it holds no
    attribute, and else the rest of a page cut off within a tag.
    """
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}
    blocks: list[int] = [0]  # places of open elements that aren't inline, of those that hold blocks, and of the latter without cells
    holds: list[int] = [0]
    frames: list[int] = [0]

    def push(node: Node) -> None:
        at = len(stack)
        places.setdefault(node.tag, []).append(at)
        if node.tag not in INLINE:
            blocks.append(at)
        if node.tag in HOLDS or node.tag in EMBEDDED:
            holds.append(at)
            if node.tag not in CELLS:
                frames.append(at)
        stack.append(node)

    def close(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()
        for known in (blocks, holds, frames):
            while known[-1] >= at:
                known.pop()

    def last(tag: str) -> int:
        got = places.get(tag)
        return got[-1] if got else 0

    at = look = 0
    endless: set[str] = set()
    while (lt := html.find("<", look)) >= 0:
        m = TAG.match(html, lt)
        if not m:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                end += 3 if end > 0 else 0
            elif html[lt + 1 : lt + 2] in ("!", "?") or html.startswith("</", lt) and not TAG_START.match(html, lt):
                end = html.find(">", lt) + 1
            elif TAG_START.match(html, lt):
                if "=" not in html[lt:]:
                    break
                end = 0
            else:
                look = lt + 1
                continue
            if lt > at:
                stack[-1].kids.append(html[at:lt])
            at = look = end if end > lt else len(html)
            continue
        if lt > at:
            stack[-1].kids.append(html[at:lt])
        at = look = m.end()
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            i = last(name)
            if i and not (name in INLINE and blocks[-1] > i):
                stack[i].closed = True
                stack[i].drop = stack[i].drop or name in EMBEDDED
                close(i)
            continue
        if name in RAW or name in RAW_LINE and name not in endless:
            found = RAW_END[name].search(html, at)
            if found:
                at = look = found.end()
            elif name in RAW:
                at = look = len(html)
            else:
                endless.add(name)
            continue
        if name in RAW_LINE:
            continue
        if name in CLOSES:
            i = max(last(t) for t in CLOSES[name])
            if i > frames[-1]:
                close(i)
        elif name not in INLINE and name not in VOID and name not in EMBEDDED:  # a block ends an open paragraph
            i = last("p")
            if i > holds[-1]:
                close(i)
        mark, region = marked(name, attrs)
        if name in EMBEDDED:
            mark = ""
        elif name in DROPPED:
            mark = "head" if name == "header" else "sure"
        node = Node(name, mark, region or name in REGION)
        stack[-1].kids.append(node)
        if name not in VOID and not (attrs.endswith("/") and name not in HOLDS and name != "p"):
            push(node)
    if at < len(html):
        stack[-1].kids.append(html[at:])
    return root


def hashed(root: Node) -> None:
    """Set what each subtree holds, bottom-up: its hash (of tag and content), the sizes of its text, of what isn't
    dropped, of link text and of prose, and its headings and regions; then settle what is dropped.

    Not dropped are a block of an ambiguous name that holds prose under a heading, and an
    element without an end tag that holds a declared region.
    """
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    while stack:
        n, linked, prose, done = stack.pop()
        linked = linked or n.tag == "a"
        prose = prose or n.tag == "p"
        if not done:
            stack.append((n, linked, prose, True))
            stack.extend((k, linked, prose, False) for k in n.kids if isinstance(k, Node))
            continue
        parts = [n.tag]
        for k in n.kids:
            if isinstance(k, str):
                text = " ".join((unescape(k) if "&" in k else k).split())
                size = len(text)
                n.size += size
                n.kept += size
                n.link += size if linked else 0
                n.prose += size if prose and not linked else 0
                parts.append(text)
            else:
                n.size += k.size
                n.link += k.link
                n.regions += k.regions
                if not k.drop:
                    n.kept += k.kept
                    n.prose += k.prose
                    n.heads += k.heads
                parts.append(str(k.hash))
        n.heads += n.tag in HEADINGS
        if n.mark == "topic" and n.heads and n.prose >= (1 if n.tag == "section" else TOPIC_CHARS) or n.drop and not n.closed and n.regions:
            n.drop = False
        n.regions += n.region and not n.drop
        n.hash = xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def candidates(root: Node) -> set[int]:
    """Hashes of all subtrees with text, in an article or out of it; what is dropped anyhow counts as a whole."""
    out: set[int] = set()
    stack = [root]
    while stack:
        n = stack.pop()
        if n.size and n.tag != "#root":
            out.add(n.hash)
        if not n.drop:
            stack.extend(k for k in n.kids if isinstance(k, Node))
    return out


NONE: frozenset[int] = frozenset()


def main_text(html: str | None, templates: set[int] | frozenset[int] = NONE, everywhere: set[int] | frozenset[int] = NONE) -> str:
    """The text of the declared article or, without one, of all that isn't boilerplate.

    ``templates`` recur on the host; those of them in ``everywhere`` on most of its pages.
    """
    if not html:
        return ""
    root = tree_of(html)
    hashed(root)
    return _main(root, templates, everywhere)


def _main(root: Node, templates: set[int] | frozenset[int] = NONE, everywhere: set[int] | frozenset[int] = NONE) -> str:
    for parts in (r for name in ("article", "main", "") if (r := _regions(root, name))):
        text = " ".join(t for p in parts if (t := _text(p, templates, True, _inside(p, everywhere))))
        if text:
            return text
    text = _text(root, templates, False)
    if templates and len(text) < LEFT_SHARE * len(_text(root, NONE, False)):
        return _text(root, templates, False, whole=True)
    return text


def _regions(root: Node, tag: str) -> list[Node]:
    """The outermost declared regions of a kind that no boilerplate holds."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.region and (n.tag == tag or not tag) and not n.drop:
            out.append(n)
        elif not n.drop:
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out


def _inside(region: Node, everywhere: set[int] | frozenset[int]) -> set[int] | frozenset[int]:
    """The subtrees that recur on most pages, unless they make up half of the region: then it is an article's copy."""
    if not everywhere:
        return NONE
    size, stack = 0, [k for k in region.kids if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        if n.drop or not n.kept:
            continue
        if n.hash in everywhere and n.tag not in HEADINGS:
            size += n.kept
        else:
            stack.extend(k for k in n.kids if isinstance(k, Node))
    return everywhere if size < HELD_SHARE * region.kept else NONE


def _text(top: Node, templates: set[int] | frozenset[int], declared: bool, inside: set[int] | frozenset[int] = NONE, whole: bool = False) -> str:
    """Text of a region, or of a page. Of a region, or with ``whole``, link-heavy templates go and those in ``inside``."""
    parts: list[str] = []
    stack: list[tuple[Node | str, bool, bool]] = [(top, False, declared or whole)]
    while stack:
        n, title_only, held = stack.pop()
        if isinstance(n, str):
            if not title_only:
                parts.append(unescape(n) if "&" in n else n)
            continue
        if n is not top:
            if n.mark == "head" and n.drop and declared:
                title_only = True  # of an article's own header, the headings stay
            elif n.drop:
                continue
            if n.tag in HEADINGS:
                title_only = False
            elif declared and n.hash in inside and n.size:
                continue
            if n.hash in templates and n.size and (not held or 2 * n.link >= n.size):
                continue
        if n.tag not in IN_LINE:
            parts.append(" ")
            stack.append((" ", False, held))
        runs = set() if held or not templates else _held(n, templates, top.kept)
        stack.extend((k, title_only, held or i in runs) for i, k in reversed(list(enumerate(n.kids))))
    return " ".join("".join(parts).split())


def _held(n: Node, templates: set[int] | frozenset[int], total: int) -> set[int]:
    """Places of the children in runs of recurring, not link-heavy ones that hold much of a page's text."""
    held: set[int] = set()
    run, size = [], 0
    for i, k in enumerate([*n.kids, "end"]):
        if isinstance(k, str):
            if not k.strip():
                continue
        elif k.drop or not k.size:
            continue
        elif k.hash in templates and 2 * k.link < k.size:
            run.append(i)
            size += k.kept
            continue
        if size and size >= HELD_SHARE * total:
            held.update(run)
        run, size = [], 0
    return held


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def site_templates(pages: DataFrame) -> DataFrame:
    """host, templates (hashes of the subtrees that recur across its pages) and everywhere (those on most of them).

    Input: host and html. Every subtree counts, in an article or out of it. Pages of a host
    with equal text outside boilerplate are copies and count as one page.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, int, int | None], None] = {}

        def flush() -> pa.RecordBatch:
            rows = [pa.array([k[i] for k in met], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            met.clear()
            return pa.RecordBatch.from_arrays(rows, names=["host", "content", "h"])

        for batch in sliced(batches):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = tree_of(html or "")
                hashed(root)
                content = xxhash.xxh64_intdigest(_main(root)) - (1 << 63)
                met[host, content, None] = None  # the page itself
                met.update(((host, content, h), None) for h in candidates(root))
                if len(met) > FLUSH_KEYS:
                    yield flush()
        yield flush()

    with scratch(pages.sparkSession) as keep:
        met = pages.select("host", "html").mapInArrow(run, "host string, content bigint, h bigint").distinct()
        counts = written(met.groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("h").isNull() | (F.col("n") >= TEMPLATE_PAGES)), "html-counts")
        sizes = counts.filter("h is null").select("host", F.col("n").alias("pages"))
        often = counts.filter("h is not null").join(sizes, "host").filter(F.col("n") >= F.col("pages") * TEMPLATE_SHARE)
        most = F.when(F.col("n") >= F.col("pages") * INSIDE_SHARE, F.col("h"))
        lists = often.groupBy("host").agg(F.collect_list("h").alias("templates"), F.collect_list(most).alias("everywhere"))  # bounded by the shares
        return keep(written(lists, "html-templates"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add text (main text) and n_chars (its code points) to every page.

    The article is the text of article elements, else of main elements or elements declared
    as such by role or itemprop, else of the whole body; never of menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and reader comments, known by tag,
    role, class or id. A class or id counts if all its words do, inline elements are not
    judged by theirs, and a section whose name may be a topic (privacy, discussion, search)
    stays if it holds prose under a heading. References are decoded, white space is one
    space, blocks are joined by one space. Of a header inside an article the headings stay.

    Recurring subtrees of the host go too. Since copies of an article also recur, pages of
    equal text count once; inside a declared region prose goes only if it recurs on
    ``INSIDE_SHARE`` of the host's pages and all such prose is less than half of the region;
    elsewhere neighbouring recurring subtrees with half of a page's text stay, and so does
    all of it where less than a quarter would be left.

    Null and empty html give an empty text; a null url, or one without host, counts under
    the host ''. Broken markup and very long pages are read whole, in linear time; a page
    cut off inside a tag ends before it. Repeated rows get equal answers, an empty table an
    empty result; other columns pass and those named text and n_chars are replaced.
    """
    host_name, html_name, lists = (unused(pages, n) for n in ("__host", "__html", "__lists"))
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), HOST, 1), F.lit("")))
    found = site_templates(pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html")))
    few = found.count() <= BROADCAST_HOSTS
    found = found.select(F.col("host").alias(unused(pages, "__of")), F.struct("templates", "everywhere").alias(lists))
    work = pages.withColumn(host_name, host).withColumn(html_name, F.col(f"`{html_col}`"))
    work = work.join(F.broadcast(found) if few else found, F.col(host_name) == F.col(found.columns[0]), "left").drop(host_name, found.columns[0])

    def make():
        def work_on(htmls, given):
            texts = [main_text(h, frozenset(g["templates"]) if g else NONE, frozenset(g["everywhere"]) if g else NONE) for h, g in zip(htmls, given, strict=True)]
            return [texts, [len(t) for t in texts]]

        return work_on

    fields = [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())]
    return add_columns(work, [html_name, lists], fields, make).drop(html_name, lists)
