"""Main text of web pages, with site templates removed.

A page is parsed leniently into elements. Elements that are never main text go at once: scripts, styles, navigation,
footers, forms and the like, and elements whose class, id or role names such a part. What is left gives the subtrees; a
subtree's hash covers its tags and text. Hashes are counted per host, each different page once; a subtree that recurs on
many pages of its host (at least MANY, and a share SHARE of them) is template and goes too. For boxes (elements such as
div and section, by tag) BOX_SHARE is enough, as adverts rotate and a menu may be a section's own; a page counts towards
it only where the box has at most half of the page's text, so versions of one article do not make it template. Outside the article container all
subtrees are counted; inside it only boxes and marked-up elements, never plain paragraphs, headings or quotes: articles
may share passages.

Counts are pre-aggregated and keyed by host and hash, so a host with a third of all pages is spread over tasks. Its page
count decides, before anything is collected, which subtrees are template; these are few (each is on a share of the
host's pages, so there are at most an average page's subtrees / BOX_SHARE). They reach its pages by a join on the host,
of which Spark splits a hot host's pages.

A class, id or role names a part only as a whole: each of its words must be a part's name or a word for a box, as in
``site-footer`` or ``ad-slot``; ``legal-history`` and ``share-price`` are content. Parsing and all that follows go by
stacks of their own, so nesting has no limit, and an attribute's value without quotes ends at white space or ``>``.

Text: the article (or main, or the body where neither is there) cut into blocks at block-level tags; character
references decoded, white space inside a block one space, trimmed, blocks joined by two line ends.

Defined results: a null or empty html has an empty text; rows that repeat a page are judged one by one; a null URL's
host is empty; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, table

MANY = 5
SHARE = 0.5
BOX_SHARE = 0.01
OUT = "page_id long, url string, text string, n_chars long"

# HTML element names and usual names of page parts.
DROPPED = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "head", "title", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "button", "select", "textarea", "input", "dialog", "menu", "map"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "b", "i", "em", "strong", "a", "span", "code", "sub", "sup", "br", "u", "small", "mark", "q", "cite", "abbr", "time", "s", "del", "ins", "kbd", "font"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
KEPT = HEADINGS | {"header"}  # an article's headings are no template
APART = {"nav", "aside", "footer", "form", "fieldset", "menu", "dialog"}  # these end a paragraph too, and hold their own
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | APART
PARTS = {
    "nav", "navbar", "navigation", "menu", "menubar", "header", "masthead", "banner", "topbar", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
    "gdpr", "notice", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "popup", "modal",
    "overlay", "toolbar", "widget", "search", "copyright", "legal", "disclaimer", "skip", "toc", "tags", "contentinfo", "complementary", "paywall",
}
BOXES = {
    "a", "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "div", "element", "entry", "fixed", "form", "frame", "global", "group", "head", "heading", "holder", "horizontal", "icon", "icons", "inner", "item", "items",
    "js", "large", "layer", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "side", "site", "slot", "small", "sticky", "story", "stories", "tab", "tabs", "text", "title", "top",
    "unit", "vertical", "view", "wrap", "wrapper", "article", "articles", "media", "desktop", "the",
}
CARDS = {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related", "teaser"}
HEADERS = {"header", "masthead", "banner"}
STATES = {"has", "with", "no", "not", "is", "without", "wp"}
# An attribute: a name, and perhaps a value in quotes, or without them up to white space or the tag's end.
_PAIR = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+))?"""
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|![^>]*>|\?[^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_PAIR}|=)*+)(>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_NAMES = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "marked", "part", "children", "digest", "inside", "size")

    def __init__(self, tag: str, marked: bool = False, part: str = ""):
        self.tag, self.marked, self.part, self.inside = tag, marked, part, False
        self.children: list[Element | str] = []
        self.digest = self.size = 0


def _names_part(word: str, tag: str) -> bool:
    names = _NAMES.findall(word)
    if not names or names[0] in STATES:
        return False
    if tag == "article":  # an article is a part only where it is a comment or an advert
        return names[0] in CARDS
    names = [n for n in names if not n.isdigit()]
    return bool(PARTS & set(names)) and all(n in PARTS or n in BOXES for n in names)


def _part(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element has attributes, and the part of a page that they name: "", "header" or "other"."""
    named = ""
    found = _ATTRIBUTE.findall(attributes)
    if tag in ("html", "body", "main"):
        return False, ""
    for key, *values in found:
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            for word in value.split():
                if _names_part(word, tag):
                    named = "header" if named != "other" and HEADERS & set(_NAMES.findall(word)) else "other"
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            named = "other"
    return bool(found), named


_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", *sorted(APART))
_WALLS = ("article", "main", "body", "td", "th", "section", "div", *sorted(APART))


class _Open:
    """The stack of open elements, with how many there are of each tag, so that a tag that is not open costs no search."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.count: dict[str, int] = {}

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.count[e.tag] = self.count.get(e.tag, 0) + 1

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        for e in self.stack[k:]:
            self.count[e.tag] -= 1
        del self.stack[k:]

    def has(self, *tags: str) -> bool:
        return any(self.count.get(t) for t in tags)

    def close(self, tags, walls=()) -> bool:
        """Close the innermost of these elements and all in it, unless a wall stands before it."""
        if self.has(*tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    self.cut(k)
                    return True
                if self.stack[k].tag in walls:
                    break
        return False


def parse(source: str) -> Element:
    """A lenient tree: unclosed elements end with their parent, stray end tags are ignored."""
    root = Element("#root")
    opened = _Open(root)
    stack = opened.stack
    at = 0
    while True:
        m = _TAG.search(source, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        close, tag, attributes, _ = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if close:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            else:
                opened.close((tag,), _WALLS if tag in PLAIN and tag not in ("td", "th", "tr", "table") else ())
            continue
        # A head ends where the page's content begins, and a menu that was not closed where an article does.
        if tag in BLOCKS and tag != "html":
            opened.close(("head",))
        if tag in ("article", "main"):
            opened.close(("nav",))
        if tag in CLOSES_P:
            opened.close(("p",), (BLOCKS | APART) - {"p"})
        if tag in _CLOSED_BY:
            while opened.close(_CLOSED_BY[tag], _LISTS) and tag == "tr" and stack[-1].tag == "tr":
                pass
        element = Element(tag, *_part(tag, attributes))
        stack[-1].children.append(element)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            element.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            continue
        opened.push(element)
    if at < len(source):
        rest = source[at:]
        stack[-1].children.append(rest.split("<")[0] if re.match(r"<[a-zA-Z/!?]", rest) else rest)
    return root


def _elements(top: Element, into=lambda e: True) -> Iterator[Element]:
    """The elements below top in page order, each before those in it; in those that into() is false for, no further."""
    todo = [c for c in reversed(top.children) if not isinstance(c, str)]
    while todo:
        e = todo.pop()
        yield e
        if into(e):
            todo.extend(c for c in reversed(e.children) if not isinstance(c, str))


def _main(root: Element) -> list[Element]:
    """The outermost articles; else the outermost main elements; else none."""
    content = lambda e: e.tag not in DROPPED and e.part != "other"
    for tag in ("article", "main"):
        found = [e for e in _elements(root, lambda e, tag=tag: content(e) and e.tag != tag) if e.tag == tag and content(e)]
        if found:
            return found
    return []


def _prune(top: Element, inside: bool) -> None:
    """Take away what is never main text. A header inside an article keeps its headings, wherever they are in it."""
    goes = lambda e: e.tag in DROPPED or e.part == "other"
    todo = [top]
    while todo:
        e = todo.pop()
        e.children = [c for c in e.children if isinstance(c, str) or not (goes(c) or (not inside and (c.tag == "header" or c.part == "header")))]
        for c in e.children:
            if not isinstance(c, str):
                c.inside = inside
                if c.tag == "header" or c.part == "header":
                    c.children = [x for x in _elements(c, lambda x: not goes(x) and x.tag not in HEADINGS) if x.tag in HEADINGS and not goes(x)]
                todo.append(c)


def pruned(source: str | None) -> Element:
    """The parsed page's content: only what may be main text, all below one root."""
    root = parse(source or "")
    main = _main(root)
    top = Element("#main")
    top.children = list(main) if main else root.children
    _prune(top, bool(main))
    for m in main:
        m.inside = False
    return top


def _candidate(e: Element) -> bool:
    """Whether a subtree may be template: outside an article any, inside it boxes and marked elements."""
    return not e.inside or (e.tag not in KEPT and (e.marked or e.tag not in PLAIN))


def _digest(top: Element) -> dict[int, int | None]:
    """Hash every subtree and count its characters. Returns those that may be template, with the characters of boxes."""
    out: dict[int, int | None] = {}
    for e in reversed([top, *_elements(top)]):  # what is in an element comes after it, so here before
        h = blake2b(e.tag.encode(), digest_size=8)
        for c in e.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", c).strip()
                if text:
                    h.update(b"\0" + text.encode("utf-8", "surrogatepass"))
                    e.size += len(text)
            else:
                h.update(b"\1" + c.digest.to_bytes(8, "little", signed=True))
                e.size += c.size
        e.digest = int.from_bytes(h.digest(), "little", signed=True)
        if e.tag not in ("#main", "article", "main", "body", "html", "br", "hr", "img") and e.children and _candidate(e):
            out[e.digest] = None if e.tag in PLAIN or e.tag in KEPT else e.size
    return out


def blocks(top: Element, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of text in page order, without template subtrees."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Element | str | None] = list(reversed(top.children))
    while todo:  # not by recursion: pages may nest deeply
        e = todo.pop()
        if e is None:
            end()
        elif isinstance(e, str):
            run.append(e)
        elif e.digest in template and _candidate(e):
            continue
        elif e.tag == "br":
            run.append(" ")
        elif e.tag in BLOCKS:
            end()
            todo.append(None)
            todo.extend(reversed(e.children))
        else:
            todo.extend(reversed(e.children))
    end()
    return out


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _pack(top: Element) -> list:
    """A tree as a flat list: an element's fields, then what is in it, then None; texts as they are."""
    out: list = []
    todo: list[Element | str | None] = list(reversed(top.children))
    while todo:
        e = todo.pop()
        if e is None or isinstance(e, str):
            out.append(e)
        else:
            out.append([e.tag, int(e.inside), int(e.marked), e.digest])
            todo.append(None)
            todo.extend(reversed(e.children))
    return out


def _unpack(flat: list) -> Element:
    stack = [Element("#main")]
    for x in flat:
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            stack[-1].children.append(x)
        else:
            e = Element(x[0], bool(x[2]))
            e.inside, e.digest = bool(x[1]), x[3]
            stack[-1].children.append(e)
            stack.append(e)
    return stack[0]


def extract(pages: DataFrame) -> DataFrame:
    """Each page's main text: page_id, url, text, n_chars."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found, whole, small = [], [], [], []
            for url, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                top = pruned(source)
                own = _digest(top)
                hosts += [host(url)] * (len(own) + 1)
                found += [None, *own]  # None counts the page
                whole += [top.digest] * (len(own) + 1)
                small += [False, *(n is not None and 2 * n <= top.size for n in own.values())]
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(whole, pa.int64()), pa.array(small, pa.bool_())], names=["host", "subtree", "page", "small"])

    # Copies of a page count once, so a subtree that only copies of one page have is not template.
    once = source.mapInArrow(hashes, "host string, subtree long, page long, small boolean").distinct()
    counted = table(once.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.count_if("small").alias("small")).filter(F.col("n") >= MANY), "subtrees")
    # A host's page count is the row with no subtree; it decides before a host's subtrees are collected.
    sizes = counted.filter(F.col("subtree").isNull()).select("host", F.col("n").alias("pages"))
    many = counted.filter(F.col("subtree").isNotNull()).join(apart(sizes), "host")
    often = (F.col("n") >= SHARE * F.col("pages")) | ((F.col("small") >= MANY) & (F.col("small") >= BOX_SHARE * F.col("pages")))
    template = many.filter(often).groupBy("host").agg(F.collect_list("subtree").alias("template"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts = [host(u) for u in b.column(1).to_pylist()]
            packed = []
            for s in b.column(2).to_pylist():
                top = pruned(s)
                own = _digest(top)
                # Without candidates the text is final already; else the tree goes along.
                packed.append(zlib.compress(json.dumps(_pack(top) if own else "\n\n".join(blocks(top)), ensure_ascii=False).encode("utf-8", "surrogatepass"), 3))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for packed, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                tree = json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
                texts.append(tree if isinstance(tree, str) else "\n\n".join(blocks(_unpack(tree), set(gone or ()))))
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    prepared = source.mapInArrow(prepare, "page_id long, url string, host string, packed binary")
    joined = prepared.join(apart(template), "host", "left").select("page_id", "url", "packed", "template")
    return joined.mapInArrow(finish, OUT)
