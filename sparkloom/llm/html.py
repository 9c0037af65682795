"""Main text of web pages: block parsing, and a host suffix array against boilerplate.

A page is parsed once, to blocks of text. Blocks in an article or main element are content;
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, known by
element, role, class or id, are boilerplate; what is in neither is open, beside an article
as on pages without one.

The token streams of all that is no content are put together by host, and the suffixes of
the whole are named by prefix doubling: equal names at depth 8 are an interval of the
suffix array whose common prefix has 8 tokens or more. Spark deals the suffixes by host and
name, so a host of any size spreads, and an interval that touches enough distinct pages is
repeated. Every longer repeat is the union of such windows, so they cover exactly the long
repeated substrings, at their full length. Open blocks lose what is covered and keep their
unique runs. A host none of whose pages has an open block has nothing to decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_parts, lean, ship, small_or_not, written

#: Doublings, so windows of 2 ** DOUBLINGS tokens; distinct pages of a host that a repeat touches at least.
DOUBLINGS, MIN_PAGES = 3, 3
WINDOW = 1 << DOUBLINGS
#: Hosts with open blocks are broadcast up to this many.
BROADCAST_ROWS = 50_000

# Elements and names of the parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "optgroup"}
DROPPED = frozenset(
    "head title nav footer aside form fieldset button select option optgroup datalist textarea label input dialog menu noscript template "
    "iframe object embed svg canvas audio video map script style".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}
CONTENT = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead topbar footer sidebar sidebars aside rail cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup paywall social share sharing sharebar related recommended recommendations comment comments "
    "commentlist disqus reply replies respond search searchform login widget widgets pagination pager copyright disclaimer skip".split()
)
OUTSIDE_NAMES = frozenset("header banner".split())
LAYOUT = frozenset(
    "area article bar block body bottom box buttons card column container content entry form global group holder inner item items left links list main "
    "page panel post primary right row secondary section site slot table text title top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Za-z]+")
ARTICLE, OPEN, BOILER = 0, 1, 2


def _named(value: str, inside: bool) -> bool:
    """Whether a class or id names boilerplate: one of its names is made of names of such parts and of words of layout, and of one of the former at least."""
    for name in value.split():
        # adBox and ad-box are the parts ad and box; related-work is no such name
        parts = {x.lower() for w in PART.findall(name) for x in (re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", w) if w.lower() not in NAMES else [w])}
        some = parts & (NAMES if inside else NAMES | OUTSIDE_NAMES)
        if some and parts <= some | LAYOUT:
            return True
    return False


def _boiler(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element opens a part that is no content."""
    if tag in DROPPED or tag == "header":
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if _named(value, inside):
                return tag not in CONTENT or bool({x.lower() for x in PART.findall(value)} & {"comment", "comments", "reply", "ad", "ads", "advert", "related", "sponsored", "promo"})
        elif name == "role" and value.strip().lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks in page order: ARTICLE, OPEN or BOILER; text decoded, white space as single spaces. Of an article's header only the headings are content."""
    if not html:
        return []
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, boilerplate, in an article, in an article's header
    held: list[str] = []
    boiler = inside = head = False
    at, end = 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((BOILER if boiler else ARTICLE if inside else OPEN, text))

    def pop_to(k: int) -> None:
        nonlocal boiler, inside, head
        if any(x[0] in BLOCK for x in stack[k:]) or (stack[-1][1] != (stack[k - 1][1] if k else False)):
            flush()
        del stack[k:]
        boiler, inside, head = stack[-1][1:] if stack else (False, False, False)

    def close_open(tags: tuple[str, ...] | str, stops: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return pop_to(k)
            if stack[k][0] in stops:
                return None

    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "p" and not any(x[0] == "p" for x in stack):
                flush()
            else:
                close_open((tag,), ("article", "main", "nav", "footer", "aside", "table") if tag not in CONTENT and tag not in ("nav", "footer", "aside", "table", "body", "html") else ())
            continue
        if tag in VOID:
            if tag == "hr":
                close_open(("p",), ("table", "div", "article", "section"))
                flush()
            elif tag in ("br", "img", "input", "wbr"):
                held.append(" " if tag != "wbr" else "")
            continue
        if tag in CLOSES_P:
            close_open(("p",), ("table", "td", "th", "button", "object", "caption"))
        if tag in SELF_CLOSING:
            close_open(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), SELF_CLOSING[tag])
        own = _boiler(tag, attributes, inside)
        within_head = head or (tag == "header" and inside and not boiler)
        drop = (boiler and not (head and tag in HEADINGS)) or own
        within = inside or (not drop and (tag in CONTENT or 'role="main"' in attributes or "articleBody" in attributes))
        if tag in BLOCK or drop != boiler or within != inside:
            flush()
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            # its text is no markup
            close = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(html, at)
            if not drop:
                held.append(html[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        head = within_head and tag not in HEADINGS
        stack.append((tag, drop, within, head))
        boiler, inside = drop, within
    flush()
    return out


def names(tokens: list[str], doublings: int = DOUBLINGS) -> np.ndarray:
    """Names of all suffixes' first 2 ** doublings tokens: equal names, equal tokens."""
    level = np.fromiter((xxhash.xxh64_intdigest(t, 1) for t in tokens), dtype=np.uint64, count=len(tokens))
    for d in range(doublings):
        step = 1 << d
        if len(level) <= step:
            return np.empty(0, np.int64)
        left, right = level[:-step], level[step:]
        level = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(d + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        level ^= level >> np.uint64(29)
    return level.view(np.int64)


def stream(found: list[tuple[int, str]]) -> list[str]:
    """The page's tokens outside of content, in page order."""
    return [w for k, t in found if k != ARTICLE for w in t.lower().split()]


def main_text(found: list[tuple[int, str]], covered: set[int]) -> str:
    """Content, and of open blocks what is not covered: whole blocks, and runs of a window or more go.

    A shorter run beside a block's own words is only where a repeat of the block before ran on.
    """
    place, out = 0, []
    for kind, text in found:
        if kind == ARTICLE:
            out.append(text)
            continue
        words = text.split()
        if kind == OPEN:
            left: list[str] = []
            run: list[str] = []
            for i, w in enumerate(words, place):
                if i in covered:
                    run.append(w)
                    continue
                left += run if len(run) < WINDOW else []
                run = []
                left.append(w)
            if left and len(run) < WINDOW:
                left += run
            if left:
                out.append(" ".join(left))
        place += len(words)
    return "\n".join(out)


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(key, url, text, n_chars) of every page.

    A null html counts as empty and gives the empty text; a null url is its own host.
    Rows repeat as given; equal pages of a host count as one page. Very long pages are
    parsed whole. An empty table gives an empty one. Extra columns are not kept.
    """
    ship(pages.sparkSession)
    h = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.struct(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url")).alias("row"), host.alias("host"), F.xxhash64(h).alias("ph"), h.alias("html"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in in_parts(b.column(3)):
                found = [blocks(x) for x in texts]
                cuts = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array([y[i] for x in found for y in x], t)) for i, t in enumerate((pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(i)[part] for i in range(3)] + lists, ["row", "host", "ph", "kinds", "texts"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, ph, kinds, texts in zip(*(b.column(i).to_pylist() for i in range(4))):
                level = names(stream(list(zip(kinds, texts))))
                n = len(level)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * n, pa.string()), pa.array([ph] * n, pa.int64()), pa.array(level), pa.array(np.arange(n, dtype=np.int32)), pa.array([OPEN in kinds] * n, pa.bool_())],
                    ["host", "ph", "name", "at", "open"],
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kinds, texts, hit in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                covered = {i + j for i in (hit or []) for j in range(WINDOW)}
                out.append(main_text(list(zip(kinds, texts)), covered))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "text"])

    like = rows.select("row", "host", "ph", F.array(F.lit(0)).alias("kinds"), F.array(F.lit("").cast("string")).alias("texts"))
    cut = written(rows.mapInArrow(lean(parsed), like.schema), "html-blocks")
    is_open = F.array_contains("kinds", OPEN)
    content = F.filter("texts", lambda x, i: F.get("kinds", i) == ARTICLE)
    plain = cut.filter(~is_open).select("row", F.array_join(content, "\n").alias("text"))
    hosts = small_or_not(written(cut.filter(is_open).select("host").distinct(), "html-hosts"), BROADCAST_ROWS)
    streams = cut.join(hosts, "host", "left_semi").select("host", "ph", "kinds", "texts")
    seen = streams.mapInArrow(lean(windows), "host string, ph long, name long, at int, open boolean")
    each = seen.groupBy("host", "name", "ph").agg(F.max("open").alias("open"))
    repeated = each.groupBy("host", "name").agg(F.count("*").alias("n"), F.max("open").alias("open")).filter((F.col("n") >= min_pages) & F.col("open"))
    hits = seen.filter("open").join(repeated.select("host", "name"), ["host", "name"]).groupBy("host", "ph").agg(F.collect_set("at").alias("hits"))
    judged = cut.filter(is_open).join(hits, ["host", "ph"], "left").select("row", "kinds", "texts", "hits")
    open_ = judged.mapInArrow(lean(judge), rows.select("row", F.lit(None).cast("string").alias("text")).schema)
    both = plain.unionAll(open_)
    return both.select(F.col("row.key").alias(key), F.col("row.url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
