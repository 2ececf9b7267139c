"""Main text of web pages: site templates go by recurring element subtrees.

Each page is read into a tree of elements.  Every container element (menus,
lists, sections, boxes, tables, forms, footers) is hashed with all it holds, and
Spark counts, for each host, on how many pages with different main text a
subtree occurs.  Subtrees that recur on ``min_pages`` such pages are the host's
template and are deleted; pages that copy one another count once, so that a
copied article is no template.  Elements whose tag, role or class says that
they are no article text are deleted as well, which also serves hosts with few
pages.  What is left in the page's article (or main) elements, or in its body
where it has none, is the main text.

Text blocks of an article (paragraphs, headings, quotations) are never deleted
by themselves for recurring: shared sentences are text, not template.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import staged

#: Templates up to so many rows travel to the tasks whole; beyond it they are joined.
BROADCAST_TEMPLATES = 100_000

# Names of HTML (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var br wbr img".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINER = frozenset(
    "aside center details dialog dir div dl fieldset footer form header main menu nav ol search section table ul".split()
)
_DROPPED = frozenset("head nav footer aside form menu dialog button select object canvas audio video map search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices newsletter subscribe subscription signup sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus share sharing social related "
    "recommended widget popup modal overlay toolbar pagination pager login search skip".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.DOTALL
)
_ENDS_P = _CONTAINER | {"article", "td", "th", "li"}
_ENDS_ITEMS = frozenset(("ul", "ol", "dl", "table", "select", "article"))
_ITEMS = frozenset().union(*_SELF_CLOSING.values())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")


@dataclass
class Element:
    tag: str
    dropped: bool
    article: bool
    parent: Element | None
    #: Whether an open paragraph, and which open list or table items, a new tag may end.
    in_p: bool = False
    items: frozenset[str] = frozenset()
    digest: xxhash.xxh64 = field(default_factory=xxhash.xxh64)
    code: int = 0
    #: Characters of text in the subtree.
    size: int = 0


@dataclass
class Block:
    owner: Element
    text: str


def _says_no(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if not _WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
        elif name == "role" and value in _ROLES:
            return True
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, and its container elements with hashes
    of their subtrees.  Unclosed elements end with their parent; stray end tags
    are ignored; raw elements (scripts, styles) hold no text.  A quote in a tag
    that nothing closes is a plain character; what follows the last ``>`` is text.

    Each open element knows what may be ended inside it, so a tag takes the same
    time at any depth, and the page is scanned once."""
    root = Element("", False, False, None)
    open_at, blocks, containers, words = root, [], [], []
    n_open: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        words.clear()
        if text:
            blocks.append(Block(open_at, text))
            open_at.digest.update(b"t" + text.encode("utf-8", "replace"))
            open_at.size += len(text)

    def close() -> None:
        nonlocal open_at
        flush()
        ended, open_at = open_at, open_at.parent
        n_open[ended.tag] -= 1
        open_at.size += ended.size
        ended.code = ended.digest.intdigest()
        if ended.tag in _CONTAINER:
            containers.append(ended)
        open_at.digest.update(b"e" + ended.tag.encode() + ended.digest.digest())

    at, last = 0, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):
            words.append(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            words.append(page[at : lt + 1])
            at = lt + 1
            continue
        words.append(page[at:lt])
        at = m.end()
        ending, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "br":
                words.append(" ")
            continue
        if ending:
            if tag in _RAW:
                continue
            if n_open[tag]:
                while open_at.tag != tag:
                    close()
                close()
            else:
                flush()
            continue
        if tag in _RAW:
            flush()
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        if tag in _CLOSES_P and open_at.in_p:
            while open_at.tag != "p":
                close()
            close()
        if tag in _SELF_CLOSING:
            while not _SELF_CLOSING[tag].isdisjoint(open_at.items):
                close()
        if tag in _VOID:
            continue
        in_article = open_at.article or tag in ("article", "main")
        in_p = tag == "p" or (open_at.in_p and tag not in _ENDS_P)
        items = frozenset() if tag in _ENDS_ITEMS else open_at.items | {tag} if tag in _ITEMS else open_at.items
        open_at = Element(tag, _says_no(tag, attributes, open_at.article), in_article, open_at, in_p, items)
        n_open[tag] += 1
    while open_at.parent is not None:
        close()
    flush()
    return blocks, containers


def chosen_blocks(blocks: list[Block], templates: frozenset[int] | set[int]) -> list[str]:
    """Texts of the blocks that are main text, without the template's subtrees.
    A form that holds over half of the page's text wraps it and is no reason to cut."""
    verdict: dict[int, bool] = {}
    total = sum(len(b.text) for b in blocks)

    def own(e: Element) -> bool:
        wraps = e.tag == "form" and 2 * e.size > total
        return (e.dropped and not wraps) or (e.tag in _CONTAINER and e.code in templates)

    def cut(e: Element) -> bool:
        path = []
        while e is not None and id(e) not in verdict:
            path.append(e)
            e = e.parent
        known = e is not None and verdict[id(e)]
        for e in reversed(path):
            known = verdict[id(e)] = known or own(e)
        return known

    left = [b for b in blocks if not cut(b.owner)]
    inside = [b.text for b in left if b.owner.article]
    return inside or [b.text for b in left]


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m.group(1).lower() if m else ""


def _signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, code, body): the distinct container subtrees of each page, with a
    hash of the page's main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, codes, bodies = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, containers = parse(page or "")
                body = _signed(xxhash.xxh64_intdigest(" ".join(chosen_blocks(blocks, frozenset()))))
                held = {_signed(e.code) for e in containers}
                hosts += [host_of(url)] * len(held)
                codes += held
                bodies += [body] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(codes, pa.int64()), pa.array(bodies, pa.int64())],
                names=["host", "code", "body"],
            )

    return pages.select("url", "html").mapInArrow(run, "host string, code long, body long")


def extract_main_text(pages: DataFrame, min_pages: int = 5) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null and empty pages have an empty text; pages without a host in their url
    count as one site; null ids and urls are kept; repeated rows get equal
    texts; an empty table gives no rows; other columns are ignored."""
    spark = pages.sparkSession
    found = subtrees(pages)
    templates = staged(
        found.distinct().groupBy("host", "code").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages).select("host", "code"),
        "templates",
    )
    schema = "page_id long, url string, text string, n_chars long"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("codes").to_pylist() if "codes" in batch.schema.names else None
            out = []
            for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                cut = of_host.value.get(host_of(url), frozenset()) if held is None else set(held[i] or ())
                blocks, _ = parse(page or "")
                out.append(" ".join(chosen_blocks(blocks, {c % (1 << 64) for c in cut} if held is not None else cut)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    if templates.count() <= BROADCAST_TEMPLATES:
        sets: dict[str, set[int]] = {}
        for r in templates.collect():
            sets.setdefault(r["host"], set()).add(r["code"] % (1 << 64))
        of_host = spark.sparkContext.broadcast(sets)
        return pages.select("page_id", "url", "html").mapInArrow(texts, schema)
    # More templates than may travel whole: each page gets its own by a join.
    keyed = pages.select("page_id", "url", "html").withColumn("page_key", F.xxhash64("url", "html"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hosts, codes = [], [], []
            for key, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_key", "url", "html")), strict=True):
                held = {_signed(e.code) for e in parse(page or "")[1]}
                keys += [key] * len(held)
                hosts += [host_of(url)] * len(held)
                codes += held
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(codes, pa.int64())],
                names=["page_key", "host", "code"],
            )

    held = keyed.select("page_key", "url", "html").mapInArrow(own, "page_key long, host string, code long")
    per_page = staged(
        held.join(templates, ["host", "code"]).groupBy("page_key").agg(F.collect_set("code").alias("codes")), "page-templates"
    )
    of_host = None
    return keyed.join(per_page, "page_key", "left").select("page_id", "url", "html", "codes").mapInArrow(texts, schema)
