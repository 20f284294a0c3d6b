"""HTML extraction: site templates found by recurring subtrees, then the main text."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted
from sqlweave.llm.urlrules import url_host
from sqlweave.session import materialise

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre table thead tbody tr td th dl dt dd ul ol figure figcaption".split())

# What is never main text: by element, by role, and by a class or id all of whose parts are named here.
DROPPED_TAGS = set(
    "nav footer aside form script style noscript iframe template head title textarea select button svg canvas object "
    "dialog menu input option datalist xmp".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertisements adsense banner banners sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside rail "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments disqus reply replies discussion share sharing social related recommended widget widgets form search".split()
)
HEADER_NAMES = set("header masthead topbar banner".split())
# These go even where they hold an article: teasers in a sidebar are no main text.
MARGINS = {"nav", "footer", "aside"}
# Where a page has no main element, a name drops no element with most of its text, but for readers' comments.
DISCUSSION = set("comment comments disqus reply replies discussion".split())
# Inside a main element only these names drop a span, which else is part of a sentence.
ADVERTS = set("ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion".split())
# Blocks of a main element with this many characters may be templates too: notices and calls to subscribe.
LONG_BLOCKS, LONG_BLOCK = set("p ul ol dl table blockquote".split()), 24
MAIN_TAGS = {"article", "main"}
CONTEXT_TEXTS = 3
CLOSED_BY_BLOCK = {"p"}
CLOSES_SAME = set("li dt dd tr td th option p".split())


class Element:
    """An element with its children (elements and texts) and the hash of its subtree."""

    __slots__ = ("tag", "names", "marks", "role", "hidden", "children", "digest", "has_text", "has_main", "mass")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.children, self.digest, self.has_text, self.has_main, self.mass = tag, [], 0, False, tag in MAIN_TAGS, 0
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip(" /\n") else {}
        self.names = set(_NAME_PARTS.split(found.get("class", "") + " " + found.get("id", ""))) - {""} if found else set()
        tokens = (found.get("class", "") + " " + found.get("id", "")).split() if self.names & DROPPED_NAMES else []
        parts = [{x for x in _NAME_PARTS.split(t) if x and not x.isdigit()} for t in tokens]
        self.marks = [x for x in parts if x and x <= DROPPED_NAMES]
        self.role = found.get("role", "")
        self.hidden = "hidden" in found or found.get("style", "").replace(" ", "").find("display:none") >= 0

    def close(self) -> None:
        """Fix the subtree's hash: tag, names of class and id, and the hashes or words of all children."""
        state = xxhash.xxh64(f"{self.tag} {' '.join(sorted(self.names))}".encode("utf-8", "surrogatepass"))
        for child in self.children:
            if isinstance(child, Element):
                state.update(child.digest.to_bytes(8, "little"))
                self.has_text |= child.has_text
                self.has_main |= child.has_main
                self.mass += child.mass if child.tag not in RAW else 0
            elif words := " ".join(child.split()):
                state.update(b"\1" + words.encode("utf-8", "surrogatepass"))
                self.has_text = True
                self.mass += len(words)
        self.digest = state.intdigest()

    def is_boilerplate(self, in_main: str, whole: int = 0) -> bool:
        """Whether this is no main text by its kind; `whole` is the number of characters of the page."""
        if self.tag in ("html", "body") or self.tag in INLINE and self.tag != "span" or self.tag in MAIN_TAGS:
            return False
        if self.tag in MARGINS:
            return True
        # What wraps an article, a form around the page as well, goes only inside another article, as comments do.
        if self.has_main and in_main != "article":
            return False
        if self.tag in DROPPED_TAGS or self.hidden or self.role in DROPPED_ROLES:
            return True
        if self.tag == "header":
            return not in_main
        if in_main and self.tag == "span":
            return any(mark & ADVERTS for mark in self.marks)
        if not in_main and 2 * self.mass > whole > 0:
            return any(mark & DISCUSSION for mark in self.marks)
        return any(not (in_main and mark & HEADER_NAMES) for mark in self.marks)


def parse(text: str) -> Element:
    """Tree of a page. End tags that fit nothing are ignored, missing ones are supplied."""
    root = Element("#page")
    stack, at, size = [root], 0, len(text)

    def shut(depth: int) -> None:
        while len(stack) > depth:
            stack.pop().close()

    while at < size:
        mark = text.find("<", at)
        m = None
        while mark >= 0 and not (m := _TAG.match(text, mark)):
            mark = text.find("<", mark + 1)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if mark > at:
            stack[-1].children.append(text[at:mark])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    shut(depth)
                    break
            continue
        if tag in CLOSES_SAME or tag not in INLINE:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth].tag
                if open_tag in CLOSED_BY_BLOCK and tag not in INLINE or open_tag == tag and tag in CLOSES_SAME:
                    shut(depth)
                    break
                if open_tag not in INLINE:
                    break
        element = Element(tag, m[3])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(text, at)
            if end is None and tag == "noscript":
                # Never closed: what follows is the page, not the text of this element.
                stack.append(element)
                continue
            element.children.append(text[at : end.start() if end else size])
            element.close()
            at = end.end() if end else size
        elif tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in TEXT_BLOCKS and tag not in ("div", "section", "article", "main", "body"):
            element.close()
        else:
            stack.append(element)
    shut(0)
    return root


def _walk(root: Element, skip) -> Iterator[tuple[Element | str | None, str, Element]]:
    """Elements and texts in page order, each with the main element's tag it is in ("" outside); (None, _, e) closes e."""
    stack: list[tuple] = [(root, "", root, False)]
    while stack:
        node, in_main, parent, closing = stack.pop()
        if closing:
            yield None, in_main, node
            continue
        if isinstance(node, Element):
            if skip(node, in_main):
                continue
            yield node, in_main, node
            inside = node.tag if node.tag == "article" or node.tag in MAIN_TAGS and not in_main else in_main
            stack.append((node, in_main, parent, True))
            stack.extend((c, inside, node, False) for c in reversed(node.children))
        else:
            yield node, in_main, parent


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def _regions(nodes: list[tuple[Element | str | None, str, Element]]) -> set[int] | None:
    """Places in `nodes` of the texts that are main text; None for all of them.

    Main elements hold it, and outermost articles where these have more text outside main elements. Of a main
    element one article of which has most of its text, what follows that article is left out; what
    leads up to it stays.
    """
    open_ones: list[tuple[Element, int]] = []
    inside = {"main": set(), "article": set()}
    closed: list[tuple[Element, int, int, bool]] = []
    for at, (node, _, element) in enumerate(nodes):
        if isinstance(node, str):
            tags = {e.tag for e, _ in open_ones}
            if "main" in tags:
                inside["main"].add(at)
            elif "article" in tags:
                inside["article"].add(at)
        elif element.tag in MAIN_TAGS:
            if node is not None:
                open_ones.append((element, at))
            else:
                _, start = open_ones.pop()
                closed.append((element, start, at, any(e.tag == "main" for e, _ in open_ones)))
    size = lambda places: sum(len("".join(nodes[i][0].split())) for i in places)
    if not closed:
        return None
    if size(inside["article"]) > size(inside["main"]) or not any(e.tag == "main" for e, *_ in closed):
        return inside["article"]
    kept = inside["main"]
    for element, start, end, within in closed:
        if element.tag == "article" and within:
            own = [i for i in kept if start < i < end]
            around = next((s, e) for m, s, e, _ in closed if m.tag == "main" and s < start and end < e)
            if 2 * size(own) > size([i for i in inside["main"] if around[0] < i < around[1]]):
                kept = {i for i in kept if not end < i < around[1]}
    return kept


def _main_blocks(root: Element, skip) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """Texts of the main text in page order, and the range of them that each element (by id) holds."""
    nodes = list(_walk(root, skip))
    places = _regions(nodes)
    blocks: list[str] = []
    spans: dict[int, tuple[int, int]] = {}
    for at, (node, _, element) in enumerate(nodes):
        if isinstance(node, str):
            if (places is None or at in places) and (words := " ".join(node.split())):
                blocks.append(words)
            continue
        spans[id(element)] = (len(blocks), 0) if node is not None else (spans[id(element)][0], len(blocks))
    return blocks, spans


def _mostly_main(span: tuple[int, int], ends: list[int]) -> bool:
    """Whether a range of texts holds more than half of all; `ends` are their lengths summed up, from 0."""
    return 2 * (ends[span[1]] - ends[span[0]]) > ends[-1]


def _ends(blocks: list[str]) -> list[int]:
    return list(accumulate(map(len, blocks), initial=0))


def subtree_contexts(page: str | None) -> dict[int, set[int]]:
    """Signed hashes of all subtrees with text that a site template may consist of, each with what stands around it.

    The context of a subtree is a hash of the CONTEXT_TEXTS longest texts of the page's main text outside it,
    so pages that differ only in what is no main text have one context. A subtree
    in a main element that holds most of the main text is none.
    """
    root = parse(page or "")
    blocks, spans = _main_blocks(root, lambda e, in_main: e.is_boilerplate(in_main, root.mass))
    ends = _ends(blocks)
    longest = sorted(range(len(blocks)), key=lambda i: (-len(blocks[i]), blocks[i]))
    found: dict[int, set[int]] = {}
    for node, in_main, _ in _walk(root, lambda e, _: e.tag in RAW):
        if isinstance(node, Element) and _may_recur(node, in_main):
            start, end = span = spans.get(id(node), (0, 0))
            if in_main and _mostly_main(span, ends):
                continue
            outside = list(islice((blocks[i] for i in longest if not start <= i < end), CONTEXT_TEXTS))
            context = xxhash.xxh64("\0".join(outside).encode("utf-8", "surrogatepass")).intdigest()
            found.setdefault(_signed(node.digest), set()).add(_signed(context))
    return found


def _may_recur(element: Element, in_main: str) -> bool:
    """Short blocks of text in a main element, and cells and items, are its content however often they recur."""
    plain = element.tag in INLINE or element.tag in MAIN_TAGS or element.tag in ("#page", "html", "head", "body")
    return element.has_text and not plain and not (in_main and element.tag in TEXT_BLOCKS and (element.tag not in LONG_BLOCKS or element.mass < LONG_BLOCK))


def main_text(page: str | None, templates: set[int] = frozenset()) -> str:
    """Blocks of the main text, one to a line, white space inside a block made one space.

    Boilerplate elements and subtrees whose hash is in `templates` go first, but for those that hold
    most of an article's text. Of what then stands in main elements or articles, `_regions` tells the text;
    without those it is the whole page.
    """

    def skip(element: Element, in_main: str) -> bool:
        if element.is_boilerplate(in_main, root.mass):
            return True
        if not templates or not _may_recur(element, in_main) or _signed(element.digest) not in templates:
            return False
        return not (in_main and _mostly_main(spans.get(id(element), (0, 0)), ends))

    root = parse(page or "")
    blocks, spans = _main_blocks(root, lambda e, in_main: e.is_boilerplate(in_main, root.mass)) if templates else ([], {})
    ends = _ends(blocks)
    nodes = list(_walk(root, skip))
    places = _regions(nodes)
    blocks = []
    words: list[str] = []

    def flush() -> None:
        block = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if block:
            blocks.append(block)

    for at, (node, _, element) in enumerate(nodes):
        if isinstance(node, str):
            if places is None or at in places:
                words.append(node)
            continue
        if element.tag == "br":
            words.append(" ")
        elif element.tag not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def site_templates(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """(host, templates): hashes of subtrees on `min_pages` or more pages of a host, whatever its size.

    Pages are told apart by the main text around the subtree, so copies of one page make no template,
    also where their adverts or menus differ. A host has at most
    1 / min_pages times as many templates as all its pages have subtrees.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                made = [(h, d, c) for h, page in zip(part["host"], part["html"]) for d, cs in subtree_contexts(page).items() for c in cs]
                yield pd.DataFrame(made, columns=["host", "digest", "context"]).astype({"digest": "int64", "context": "int64"})

    counted = pages.filter("html is not null").groupBy("host", F.md5("html").alias("key")).agg(F.min("html").alias("html"))
    around = counted.select("host", "html").mapInPandas(run, "host string, digest long, context long").distinct()
    seen = around.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))
    recurring = seen.filter(F.col("n") >= min_pages)
    return recurring.groupBy("host").agg(F.collect_list("digest").alias("templates"))


def extract_pages(pages: DataFrame, min_pages: int = 10, url: str = "url", html: str = "html") -> DataFrame:
    """Add text and n_chars, the main text of each page and its code points; html itself goes.

    Element subtrees are hashed, counted per host over distinct pages, and deleted where they
    recur on many pages of that host; elements that are no main text by kind, role or name go too.

    A null html gives the empty text. A null url, or one without a host, belongs to the host ''. Repeated
    rows are extracted alike and count as one page; of articles with equal text all stay. Columns named text
    or n_chars are replaced, others stay whatever they are called; an empty table gives an empty result.
    """
    inward, outward = carried(pages, ("text", "n_chars", html.lower()))
    hosted = pages.select(*inward, F.coalesce(url_host(F.col(quoted(url))), F.lit("")).alias("host"), F.col(quoted(html)).cast("string").alias("html"))
    templates = materialise(site_templates(hosted.select("host", "html"), min_pages))

    @F.pandas_udf("string")
    def extracted(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, frozenset() if k is None else {int(x) for x in k}) for t, k in zip(texts, known)], dtype=object)

    made = hosted.join(templates, "host", "left").select(*[f"kept_{i}" for i in range(len(inward))], extracted("html", "templates").alias("text"))
    return made.select(*outward, "text", F.length("text").cast("long").alias("n_chars"))
