"""Main text of web pages with a site style tree.

Pages of one host are merged: a node of the tree is a path of elements with their classes. For
every node the tree knows on how many pages it occurs, how its presentations (sequences of
child elements) vary, and on how many pages each text below it occurs; copies of a page count
once. With m pages, the presentation's importance is the entropy of its variants to the base
m, and the content's importance the mean over its texts of 1 - log_m(pages with the text).
A node with l kinds of children has (1 - g ** l) * presentation + g ** l * content. Branches of
low importance leave each page, after elements that their tags and classes name as menus,
notices and the like. A host with few pages has no tree to speak of; names alone decide there.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, fold_ascii, table
from tideline.llm.words import slices

#: Pages a node must be on, importance below which it goes (inside an article, the stricter one),
#: the weight of children, and the share of an article that may go by importance alone.
MIN_PAGES, LOW, LOW_INSIDE, GAMMA, MOST = 6, 0.3, 0.1, 0.9, 0.5

# fixed values: kinds of elements by name
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas audio video annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub "
    "msubsup munder mover munderover mfenced mstyle mpadded mtable mtr mtd".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav footer aside form button select option fieldset dialog menu head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSED_BY_BLOCK = frozenset(["p"])
#: Parts of class names and ids, whole; a part after has-, with-, no- or without- says something of the page.
NOISE_NAMES = re.compile(
    r"(?:^|[-_\s])(?<!has[-_])(?<!with[-_])(?<!no[-_])(?<!without[-_])"
    r"(?:ads?|adverts?|advertis\w*|adsense|sponsor(?:s|ed|ship)?|promos?|promot(?:ion|ions|ed)|banners?|cookies?(?:bar|notice|banner|consent)?|consent|gdpr|"
    r"notices?|alerts?|nav|navs|navbar|navigation|navlinks?|navmenu|menus?|breadcrumbs?|footer(?:s|bar|links|nav)?|masthead|sidebars?|side-?bar|widgets?|"
    r"related(?=$|\s|[-_]?(?:posts?|articles?|links?|stor(?:y|ies)|contents?|items?|reads?|reading|news|topics?|videos?|products?|box|list))|"
    r"related(?:posts?|articles?|links?|stories)|recommend(?:s|ed|ations?)?|shar(?:e|es|ing)(?:bar|box|buttons?|links?|this)?|social(?:s|bar|links|media)?|"
    r"subscrib\w*|subscriptions?|newsletter\w*|sign-?up|log-?in|search(?:bar|box|form)?|comments?|comment-?list|disqus\w*|"
    r"respond|repl(?:y|ies)|popups?|modals?|overlay|skip|skiplinks?|skipnav|toolbar|pagination|pager|tag-?cloud|hidden|visually-hidden|sr-only)(?:$|[-_\s])",
    re.I,
)
#: Headers are noise outside an article only, and never as names of headings and paragraphs.
HEADER_NAMES = re.compile(r"(?:^|[-_\s])(?:header|head-?bar)(?:$|[-_\s])", re.I)
#: Words from which on a paragraph that is one link counts as prose on a page without an article.
LINK_WORDS = 6
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")


class _Element:
    __slots__ = ("tag", "node", "noise", "main", "children", "inline")

    def __init__(self, tag: str, node: int, noise: bool, main: bool, inline: bool = False):
        self.tag, self.node, self.noise, self.main, self.inline = tag, node, noise, main, inline
        self.children: list[int] = []


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /\n\t\r"):
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_noise(tag: str, own: dict[str, str], inside: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not own or tag in ("html", "body", "main"):
        return False
    if "hidden" in own or own.get("role", "").lower() in NOISE_ROLES or own.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if not inside and tag != "p" and tag not in HEADINGS and HEADER_NAMES.search(names):
        return True
    return bool(NOISE_NAMES.search(names)) and not (tag == "article" and not re.search("comment|repl|ad|related", names, re.I))


def parse(page: str | None, spare: bool = False):
    """``blocks, presentations`` of a page: (text, path of nodes, noise, inside article, link letters, tag) in
    page order, and (node, sequence of children) for every element. With ``spare`` the names of ``div`` and
    ``section`` elements outside an article do not count."""
    blocks: list[tuple[str, tuple[int, ...], bool, bool, int, str]] = []
    presentations: list[tuple[int, int]] = []
    stack = [_Element("", 0, False, False)]
    buffer: list[str] = []
    links = [0, 0]  # letters inside links of the block; depth of open links

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                top = stack[-1]
                blocks.append((text, tuple(e.node for e in stack[1:] if not e.inline), top.noise, top.main, links[0], top.tag))
        links[0] = 0

    def pop() -> None:
        gone = stack.pop()
        if not gone.inline:
            presentations.append((gone.node, zlib.crc32(repr(gone.children).encode())))

    def judge(tag: str, own: dict[str, str]) -> bool:
        top = stack[-1]
        if spare and not top.main and tag in ("div", "section"):
            own = {k: v for k, v in own.items() if k not in ("class", "id")}
        return top.noise or _is_noise(tag, own, top.main)

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            buffer.append(page[at:mark])
            if links[1]:
                links[0] += mark - at
        if mark >= n:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, mark)
        if not m:
            buffer.append("<")
            at = mark + 1
            continue
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            if tag == "a":
                links[1] = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag not in INLINE or depth:
                flush()
            if depth:
                while len(stack) > depth:
                    pop()
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                # an element that is never closed holds nothing, but for code
                at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        own = _attributes(rest)
        top = stack[-1]
        noise = judge(tag, own)
        if tag in INLINE:
            if tag == "a":
                links[1] = 1
            if noise and not top.noise and not rest.endswith("/"):
                flush()
                stack.append(_Element(tag, top.node, True, top.main, inline=True))
            continue
        flush()
        closed = CLOSES.get(tag, CLOSED_BY_BLOCK)
        while len(stack) > 1 and (stack[-1].tag in closed or stack[-1].inline):
            pop()
        if rest.endswith("/") and tag not in ("p", "div", "li"):
            continue
        top = stack[-1]
        noise = judge(tag, own)
        main = top.main or tag in ("article", "main") or own.get("role") == "main" or own.get("itemprop") == "articleBody"
        sign = f"{tag}.{_DIGITS.sub('0', own.get('class', ''))}#{_DIGITS.sub('0', own.get('id', ''))}"
        node = zlib.crc32(sign.encode(), top.node)
        if not top.children or top.children[-1] != node:
            top.children.append(node)
        stack.append(_Element(tag, node, noise, main))
    flush()
    while len(stack) > 1:
        pop()
    return blocks, presentations


def _signed(x: int) -> int:
    return x - (1 << 32) if x >= 1 << 31 else x


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page and different (node, kind, value): kind 0 presentations, 1 texts below the node."""
    for batch in batches:
        for part in slices(batch, "html"):
            hosts, copies, nodes, kinds, values = [], [], [], [], []
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                if not page:
                    continue
                blocks, presentations = parse(page)
                found = {(_signed(node), 0, _signed(value)) for node, value in presentations}
                for text, path, noise, *_ in blocks:
                    if not noise:
                        value = _signed(zlib.crc32(text.encode()))
                        found.update((_signed(node), 1, value) for node in path)
                copy = _signed(zlib.crc32(page.encode()))
                hosts += [host] * len(found)
                copies += [copy] * len(found)
                for node, kind, value in found:
                    nodes.append(node)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.int64()), pa.array(copies, pa.int32()), pa.array(nodes, pa.int32()), pa.array(kinds, pa.int8()), pa.array(values, pa.int32())],
                names=["host", "copy", "node", "kind", "value"],
            )


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, node, pages, importance`` of every node, from ``host, html``.

    All groups are counted by (host, node, value) and pre-aggregated, so a hot host is spread.
    """
    rows = pages.mapInArrow(_tree_rows, "host long, copy int, node int, kind byte, value int").distinct()
    values = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    sums = values.groupBy("host", "node", "kind").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") * F.log("c")).alias("clog"), F.count("*").alias("variants")
    )
    shown = sums.where("kind = 0").select("host", "node", F.col("s").alias("shows"), F.col("clog").alias("shown_log"), "variants")
    held = sums.where("kind = 1").select("host", "node", F.col("s").alias("texts"), F.col("clog").alias("text_log"))
    both = shown.join(held, ["host", "node"], "left")
    base = F.log(F.greatest(F.col("shows"), F.lit(2)))
    presentation = F.when(F.col("shows") > 1, (F.log("shows") - F.col("shown_log") / F.col("shows")) / base).otherwise(1.0)
    content = F.when(F.col("texts").isNull(), 0.0).otherwise(F.greatest(1 - F.col("text_log") / F.col("texts") / base, F.lit(0.0)))
    weight = F.pow(F.lit(GAMMA), F.least("variants", F.lit(8)))
    return both.select("host", "node", F.col("shows").alias("pages"), ((1 - weight) * presentation + weight * content).alias("importance"), content.alias("content"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = []
            for page, low, lower in zip(*(part.column(c).to_pylist() for c in ("html", "low", "lowest")), strict=True):
                texts.append(main_text(page, frozenset(low or ()), frozenset(lower or ())))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def main_text(page: str | None, low: frozenset[int] = frozenset(), lowest: frozenset[int] = frozenset()) -> str:
    """The blocks of the article, or of the page if it marks none, without noise and unimportant branches.

    ``low`` are nodes to remove anywhere but in an article, ``lowest`` nodes to remove there too.
    """
    blocks, _ = parse(page)
    named = [b for b in blocks if not b[2]]
    if not named and any(b[3] or b[5] in HEADINGS for b in blocks):
        # a wrapper with the name of something else holds the whole page
        named = [b for b in parse(page, spare=True)[0] if not b[2]]
    inside = [b for b in named if b[3]]
    if inside:
        kept = [b for b in inside if not any(_signed(x) in lowest for x in b[1])]
        if sum(len(b[0]) for b in kept) < MOST * sum(len(b[0]) for b in inside):
            kept = inside  # pages that share their article say nothing against it
    else:
        prose = [b for b in named if b[4] < 0.6 * len(b[0]) or (b[5] == "p" and b[0].count(" ") >= LINK_WORDS - 1)]
        kept = [b for b in prose if not any(_signed(x) in low for x in b[1])] or prose
    return "\n\n".join(b[0] for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html, ...)``.

    A null or empty page has an empty text. A null URL, or one without ``://``, belongs to the
    empty host. Repeated rows are extracted each and count once in the tree; extra columns are
    ignored.
    """
    at = F.instr("url", "://")
    name = F.regexp_extract(F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise(""), r"(?s)^([^/?#]*)", 1)
    keyed = pages.select("page_id", "url", "html", F.xxhash64(fold_ascii(F.coalesce(name, F.lit("")))).alias("host"))
    tree = style_tree(keyed.select("host", "html"))
    poor = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW)).select("host", "node", "importance")
    # a bounded number of nodes per host; Spark broadcasts the table if its written size allows
    lists = durable(
        poor.groupBy("host").agg(
            F.collect_list("node").alias("low"),
            F.collect_list(F.when(F.col("importance") < LOW_INSIDE, F.col("node"))).alias("lowest"),
        )
    )
    rows = keyed.join(lists, "host", "left").select("page_id", "url", "html", "low", "lowest")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
SQL: dict[str, str] = {}
