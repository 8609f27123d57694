"""Main text of web pages: a site style tree over the pages of each host.

A node of the style tree is a chain of container elements with their classes. Over the distinct pages of a host that have a node, its
importance combines presentation (entropy of its children's styles) and content (one less the entropy with which its texts repeat from
page to page), drawn towards 1 by a prior of ``PRIOR`` pages, or ``ARTICLE_PRIOR`` inside an article. Branches of low importance are
removed from each page, inside articles too; only an article itself and what encloses it stay. Paragraphs, headings and the like are no branches:
they go with their container.

What HTML says of an element is a prior decision: menus, headers, footers, dialogs and the like go. Words of class, id and role make an element
suspect. One named by such a word goes unless it encloses an article; one with such a word in a longer name, and a form, goes unless it
encloses an article or holds most of the text around it. Where the articles of a page hold at least half of the text left, the text is theirs.

Edge cases: null and empty pages and pages without text give the empty text; unclosed and stray tags are closed as browsers do for
paragraphs and list items, otherwise with their parent; a page without a usable url belongs to the nameless host; pages of the same text
count once as evidence; containers nested deeper than ``DEPTH`` are judged with the one at that depth; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches
from codeloom.session import cut_lineage

LEAST_IMPORTANCE = 0.3
DECAY = 0.9
PRIOR, ARTICLE_PRIOR = 2.0, 8.0
DEPTH = 64
#: Removed branches are broadcast up to this many (8 bytes each), beyond that joined by shuffle.
BROADCAST_NODES = 1_000_000

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp".split())
NOISE_TAGS = frozenset("nav header footer aside button select dialog menu head".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption legend figcaption summary pre address br hr option optgroup title".split())
ENDS_PARAGRAPH = BLOCK - frozenset("br option optgroup".split())
SAME_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
# Words of class, id and role that name what is no article text.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget widgets skip complementary contentinfo".split()
)
MAIN_WORDS = frozenset("main article articlebody".split())

MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z))", re.DOTALL
)
NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for tag in RAW}
DIGITS = re.compile(r"[0-9]+")

PLAIN, NOISE, ARTICLE = "", "noise", "article"
NAMED, HINTED = "named", "hinted"  # how an element is suspect


class Block(NamedTuple):
    """A block of text: the container nodes around it, how many of them enclose its article or are it (0: it is in none), the suspect
    elements around it, its text."""

    nodes: tuple[int, ...]
    article: int
    suspects: tuple[int, ...]
    text: str


class Suspect:
    """An element that may be noise: how it is suspect, whether it lies in an article, whether it encloses one."""

    def __init__(self, kind: str, inside: bool):
        self.kind, self.inside, self.encloses = kind, inside, False


def _short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def node(parent: int, style: str) -> int:
    """The name of a container in its parent (0: none)."""
    return _short(f"{parent}/{style}")


def _style(tag: str, attributes: str) -> tuple[str, str]:
    """``(style, role)`` of an element: its name with its classes, and what it is known or suspected to be."""
    if tag in NOISE_TAGS:
        return tag, NOISE
    classes, suspect, main = "", HINTED if tag in ("form", "fieldset") else PLAIN, tag in ("article", "main")
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "class":
                classes = "." + DIGITS.sub("0", ".".join(value.split()))
            if name in ("role", "itemprop") and value.lower() in MAIN_WORDS:
                main = True
            if NOISE_WORDS.intersection(value.lower().split()):
                suspect = NAMED
            elif not suspect and NOISE_WORDS.intersection(w.lower() for w in PARTS.findall(value)):
                suspect = HINTED
    return tag + classes, ARTICLE if main else PLAIN if tag in ("html", "body") else suspect


def parse(html: str) -> tuple[list[Block], list[Suspect]]:
    """The text blocks in page order, without those inside elements that are noise by their name, and the suspect elements."""
    out: list[Block] = []
    found: list[Suspect] = []
    stack: list[tuple] = []  # element, and what holds inside it: nodes, article, suspects, noise
    open_tags: dict[str, int] = {}
    named: dict[tuple[int, str], int] = {}
    pieces: list[str] = []
    at, size = 0, len(html)
    outside: tuple = ((), 0, (), False)
    state = outside

    def flush() -> None:
        if pieces:
            if not state[3] and (text := " ".join("".join(pieces).split())):
                out.append(Block(state[0], state[1], state[2], text))
            pieces.clear()

    def pop_to(tags: str, stop: tuple[str, ...] = ()) -> None:
        nonlocal state
        wanted = tags.split()
        if not any(open_tags.get(t) for t in wanted):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in wanted:
                for tag, _ in stack[k:]:
                    open_tags[tag] -= 1
                del stack[k:]
                state = stack[-1][1] if stack else outside
                return
            if stack[k][0] in stop:
                return

    while at < size:
        m = MARKUP.search(html, at)
        stop = m.start() if m else size
        if stop > at:
            text = html[at:stop]
            pieces.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            pop_to(tag)
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_PARAGRAPH:
                pop_to("p")
            if tag in SAME_ENDS:
                pop_to(*SAME_ENDS[tag])
        if tag in RAW and not (tag == "svg" and m[3].endswith("/")):  # of these, only svg can close itself
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        style, role = _style(tag, m[3])
        nodes, article, suspects, noise = state
        if tag in BLOCK and tag not in TEXT_ELEMENTS and len(nodes) < DEPTH:
            key = (nodes[-1] if nodes else 0, style)
            if key not in named:
                named[key] = node(*key)
            nodes = (*nodes, named[key])
        if role is ARTICLE and not noise:
            article = article or max(1, len(nodes))
            for k in suspects:
                found[k].encloses = True
        elif role in (NAMED, HINTED) and len(suspects) < DEPTH:
            suspects = (*suspects, len(found))
            found.append(Suspect(role, article > 0))
        state = (nodes, article, suspects, noise or role is NOISE)
        stack.append((tag, state))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out, found


def clean_blocks(html: str | None) -> list[Block]:
    """The blocks outside elements that are noise by their name or turn out to be."""
    blocks, suspects = parse(html or "")
    if not suspects:
        return blocks
    gone = {k for k, s in enumerate(suspects) if s.kind is NAMED and not s.encloses}
    blocks = [b for b in blocks if not gone.intersection(b.suspects)]
    # What is only hinted at goes unless it holds most of the text around it: of the articles, or of a page that has none.
    held = [0] * len(suspects)
    whole, articles = 0, 0
    for b in blocks:
        whole += len(b.text)
        articles += len(b.text) if b.article else 0
        for k in b.suspects:
            held[k] += len(b.text)
    hinted = {
        k for k, s in enumerate(suspects)
        if s.kind is HINTED and not s.encloses and (2 * held[k] <= articles if s.inside else articles or 2 * held[k] <= whole)
    }
    return [b for b in blocks if not hinted.intersection(b.suspects)]


def main_text(html: str | None, removed: frozenset[int] = frozenset()) -> str:
    """The text outside removed branches; that of the articles where they hold at least half of it."""
    left = clean_blocks(html)
    if removed:
        left = [b for b in left if removed.isdisjoint(b.nodes[b.article :])]
    articles = [b.text for b in left if b.article]
    if 2 * sum(map(len, articles)) < sum(len(b.text) for b in left):
        articles = [b.text for b in left]
    return " ".join(articles)


def with_host(pages: DataFrame, url_col: str, name: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn(name, host)


def style_tree(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, node, pages, inside, importance`` of all containers, over the distinct pages of each host; ``inside``: within an article."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows, marks, names, inside, styles, texts = [], [], [], [], [], []
            for row, html in enumerate(b.column(1).to_pylist()):
                below: dict[int, tuple[dict[int, None], set[int], bool]] = {}
                page = []
                for block in clean_blocks(html):
                    text = _short(block.text)
                    page.append(text)
                    for k, name in enumerate(block.nodes):
                        children, own, _ = below.setdefault(name, ({}, set(), 0 < block.article <= k))
                        children[block.nodes[k + 1] if k + 1 < len(block.nodes) else 0] = None
                        own.add(text)
                mark = _short(",".join(map(str, sorted(set(page)))))
                for name, (children, own, within) in below.items():
                    rows.append(row), marks.append(mark), names.append(name), inside.append(within), texts.append(sorted(own))
                    styles.append(_short(",".join(map(str, children))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in ((marks, pa.int64()), (names, pa.int64()), (inside, pa.bool_()), (styles, pa.int64()), (texts, pa.list_(pa.int64()))))],
                names=["host", "page", "node", "inside", "style", "texts"],
            )

    hosted = with_host(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")), "url", "host").select("host", "html")
    found = hosted.mapInArrow(nodes, "host string, page bigint, node bigint, inside boolean, style bigint, texts array<bigint>").dropDuplicates(["host", "page", "node"])
    found = cut_lineage(found)
    # Counts per style and per text first: they are combined before the shuffle, so a large host is no large group.
    on_pages = F.count(F.lit(1)).alias("n")
    styles = found.groupBy("host", "node", "style").agg(on_pages, F.max("inside").alias("inside"))
    texts = found.select("host", "node", F.explode("texts").alias("text")).groupBy("host", "node", "text").agg(on_pages)
    shown = styles.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.max("inside").alias("inside"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    told = texts.groupBy("host", "node").agg(F.avg(F.log("n")).alias("mean_log"))
    base = F.log("pages")
    presentation = F.when(F.col("pages") > 1, (base - F.col("nlogn") / F.col("pages")) / base).otherwise(1.0)
    content = F.when(F.col("pages") > 1, 1 - F.col("mean_log") / base).otherwise(1.0)
    return shown.join(told, ["host", "node"]).select("host", "node", "pages", "inside", ((1 - DECAY) * presentation + DECAY * content).alias("importance"))


def low_branches(tree: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, node`` of the branches whose importance, drawn towards 1 by the prior, is low."""
    prior = F.when(F.col("inside"), ARTICLE_PRIOR).otherwise(PRIOR)
    drawn = (F.col("pages") * F.col("importance") + prior) / (F.col("pages") + prior)
    return tree.where(drawn < least_importance).select("host", "node")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``<id_col>, <url_col>, text`` of every page."""
    low = cut_lineage(low_branches(style_tree(pages, id_col, url_col, html_col), least_importance))
    removed = low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("_removed")).withColumnRenamed("host", "_noisy")
    if low.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        removed = F.broadcast(removed)
    rows = with_host(pages.select(id_col, url_col, html_col), url_col, "_host").join(removed, F.col("_host") == F.col("_noisy"), "left")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [main_text(html, frozenset(gone or ())) for html, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return rows.select(id_col, url_col, html_col, "_removed").mapInArrow(read, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string")
