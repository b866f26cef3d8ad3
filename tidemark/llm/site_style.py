"""Main text of web pages by site style trees.

Pages of one host are merged: the nodes of its tree are chains of block elements (tag, id, class) from the
root. For every node the host's pages are counted with each presentation (the sequence of its child
elements) and with each content (the text of its own blocks; each of them is a leaf of the node). A node's
presentation importance is the entropy of its presentations, to the base of the number of pages; its content
importance is 1 less the mean entropy of its distinct contents over the pages; a leaf's importance is 1 less
the entropy of its one content. So what recurs in all pages weighs nothing, in articles as elsewhere. Nodes
below ``threshold`` and leaves below ``leaf_threshold`` lose their text in each page. A leaf's bound is strict
(with 2000 pages it goes from 1 370 of them on), as near copies of an article share most leaves.

Copies of a page (equal in text outside noise) have one vote. ``prior`` pages that share nothing are added to
the base of every entropy, so a few pages that agree are weak evidence: with 2 of them a text of all pages
goes from five pages on, at a threshold of 0.2. There is no other rule for small hosts.

Kinds of elements that never are main text go by what the page says, as their texts may differ from
page to page: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and readers' comments.
What is left of articles, else of the main part, replaces the rest where it holds most of the text.

Two narrow passes parse the pages. Between them only hashes are shuffled: (host, page content, node, feature), made
distinct and then counted with partial sums, so a host with many pages is dealt out. A host of m pages with b
blocks each has at most b * (m + prior) ** 0.05 low leaves at the default bound, so its list is short; the lists meet the pages in
a join by host (hot hosts dealt by their counts), which Spark makes a broadcast where the written table is small.

Cases: null or empty html gives an empty text; null urls form one host; repeated rows each give their text;
other columns are not read, whatever their names; an empty table gives an empty result; codes are 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dealt_join
from .common import materialize, remove

TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTES = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")

# Element names by their role in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "search", "input"} | RAW
ENDS_P = BLOCKS - {"option", "optgroup", "legend", "summary", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "status", "toolbar"}
# Class names and ids that say an element is of a kind that holds no main text.
MENUS = {"menu", "nav", "navbar", "sidenav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social"}
HEADERS_AND_FOOTERS = {"masthead", "footer"}
SIDEBARS = {"sidebar"}
NOTICES = {"cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal"}
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner"}
FORMS = {"newsletter", "subscribe", "subscription", "signup"}
COMMENTS = {"comment", "comments", "commentlist", "respond", "replies", "reply", "disqus"}
NOISE_WORDS = MENUS | HEADERS_AND_FOOTERS | SIDEBARS | NOTICES | ADVERTS | FORMS | COMMENTS
#: Attributes by which an inline element may say that it holds no main text.
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
#: Elements that a new one of the same kind closes, unless one of the named lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
P_SCOPE = {"td", "th", "table", "button", "caption", "article", "section", "div", "body", "main", "li", "blockquote"}


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


@dataclass
class Node:
    """One block element of a page: its chain's code, whether its kind holds no main text, its parent,
    whether it lies in an article or main part, and whether (only) its name says that it is noise: 1, and 2 for
    comments."""

    tag: str
    label: str
    chain: int
    noise: bool
    parent: int
    inside: bool = False
    named: int = 0
    children: list[str] = field(default_factory=list)


@functools.lru_cache(1 << 16)
def _child(chain: int, label: str) -> int:
    return code(f"{chain}>{label}")


@functools.lru_cache(1 << 16)
def _label(tag: str, attributes: str, inside_article: bool) -> tuple[str, bool, int]:
    """The element's name in the tree, whether its kind holds no main text, and whether a class or id says so."""
    if not attributes.strip():
        return tag, tag in NOT_TEXT or (tag == "header" and not inside_article), 0
    found = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTES.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(names.split())
    named = 0
    role = found.get("role", "").lower()
    hidden = bool(re.search(r"\bhidden\b(?!\s*=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes))) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    noise = tag in NOT_TEXT or (tag == "header" and not inside_article) or role in ROLES or hidden
    if not noise and tag not in ("html", "body", "main", "article"):
        named = 2 if words & COMMENTS else 1 if words & NOISE_WORDS else 0
    elif tag == "article":
        noise = bool(words & (COMMENTS | ADVERTS))
    name = tag + "".join(f".{w}" for w in sorted(set(re.sub(r"\d+", "", found.get("class", "")).lower().split()))) + (f"#{re.sub(r'[0-9]+', '', found['id']).lower()}" if "id" in found else "")
    return name, noise, named


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page (the first is the root) and its text blocks in order: (node, text)."""
    nodes = [Node("", "", 0, False, -1)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements; inline ones share the node of their block
    text: list[str] = []
    open_tags: dict[str, int] = {}
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((stack[-1][1], joined))

    def open_(tag: str, attributes: str) -> None:
        parent = stack[-1][1]
        above = nodes[parent]
        inline = tag not in BLOCKS
        label, noise, named = _label(tag, attributes, True if inline else above.tag in ("article", "main") or above.inside)
        if inline and not (noise or named):
            return  # its text is its block's
        above.children.append(label)
        nodes.append(Node(tag, label, _child(above.chain, label), noise or above.noise, parent, above.inside or above.tag in ("article", "main"), named))
        stack.append((tag, len(nodes) - 1))
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def close(names: tuple[str, ...], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                for t, _ in stack[k:]:
                    open_tags[t] -= 1
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    while m := TOKENS.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        elif m[1]:
            if open_tags.get(tag):
                flush()
                close((tag,), set() if tag in BLOCKS else {"article", "td", "table", "body"})
            elif tag in BLOCKS:
                flush()
        elif tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag in BLOCKS:
                flush()
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag in BLOCKS:
                flush()
                if tag in ENDS_P and open_tags.get("p"):
                    close(("p",), P_SCOPE)
                if tag in CLOSES and tag != "p":
                    close(CLOSES[tag], SCOPES[tag])
                if tag == "body" and open_tags.get("head"):
                    close(("head",), set())
                open_(tag, m[3])
            elif (tag in NOT_TEXT or TELLING.search(m[3])) and not m[3].endswith("/"):
                before = len(nodes)
                open_(tag, m[3])
                if len(nodes) > before:  # text so far belongs to the block around it
                    own = stack.pop()
                    flush()
                    stack.append(own)
    if at < len(page):
        text.append(page[at:])
    flush()
    _judge_names(nodes, blocks)
    return nodes, blocks


def _judge_names(nodes: list[Node], blocks: list[tuple[int, str]]) -> None:
    """Elements whose name says so are noise with all below, unless they hold most of the page's text.

    Where the page marks articles or a main part, an element around them is judged by their text, and one within
    them too, but not comments: these may be longer than their article.
    """
    if not any(n.named for n in nodes):
        return
    marked = any(not nodes[k].noise and (nodes[k].inside or nodes[k].tag in ("article", "main")) for k, _ in blocks)
    mass = [0] * len(nodes)
    for k, t in blocks:
        if not nodes[k].noise and (not marked or nodes[k].inside or nodes[k].tag in ("article", "main")):
            mass[k] += len(t)
    for k in range(len(nodes) - 1, 0, -1):
        mass[nodes[k].parent] += mass[k]
    for n, m in zip(nodes[1:], mass[1:], strict=True):
        n.noise = n.noise or nodes[n.parent].noise or bool(n.named and (2 * m <= mass[0] or (n.named == 2 and (n.inside or not marked))))


def leaf(chain: int, text: str) -> int:
    """The code of a text as content of a node."""
    return code(f"{chain}={text}")


def main_text(page: str, removed: set[int] | frozenset[int] = frozenset()) -> str:
    """The text blocks of a page that lie in no removed branch, one to a line; ``removed``: codes of nodes and leaves.

    Where articles, or else a main part, hold at least half of the characters left, the blocks of those; else all.
    """
    nodes, blocks = parse(page)
    kept = [(n, t) for n, t in blocks if not nodes[n].noise and not (removed and (nodes[n].chain in removed or leaf(nodes[n].chain, t) in removed))]
    for wanted in ("article", "main"):
        within = [False] * len(nodes)
        for k, n in enumerate(nodes):
            within[k] = n.tag == wanted or (k > 0 and within[n.parent])
        some = [(n, t) for n, t in kept if within[n]]
        if some and 2 * sum(len(t) for _, t in some) >= sum(len(t) for _, t in kept):
            return "\n".join(t for _, t in some)
    return "\n".join(t for _, t in kept)


def page_features(page: str) -> tuple[int, set[tuple[int, int, int]]]:
    """A code of a page's content (its text outside noise) and its distinct (chain, kind, feature):
    0 presentations, 1 contents (the codes of leaves)."""
    nodes, blocks = parse(page)
    styles: dict[int, set[str]] = {}
    for n in nodes:
        if not n.noise:
            styles.setdefault(n.chain, set()).add("".join(f"{c}," for k, c in enumerate(n.children) if not k or n.children[k - 1] != c))
    # a chain may stand for several elements of a page, which present it together
    out = {(c, 0, code(";".join(sorted(s)))) for c, s in styles.items()}
    texts = [(nodes[k].chain, t) for k, t in blocks if not nodes[k].noise]
    out.update((c, 1, leaf(c, t)) for c, t in texts)
    return code("\n".join(f"{c} {t}" for c, t in texts)), out


def _host(url_col: str) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "://([^/?#]*)", 1), upper, lower)


def feature_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, chain, kind, feature, k``: in how many of the host's distinct pages each feature of a node occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per: dict[tuple[str, int], set] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                content, found = page_features(page.as_py())
                per.setdefault((h, content), set()).update(found)
            rows = [(h, content, *f) for (h, content), found in per.items() for f in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = {"host": pa.string(), "content": pa.int64(), "chain": pa.int64(), "kind": pa.int32(), "feature": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=[*kinds])

    html = F.coalesce(F.col(html_col), F.lit("")).alias("html")
    found = pages.select(_host(url_col).alias("host"), html).mapInArrow(run, "host string, content long, chain long, kind int, feature long")
    return found.distinct().groupBy("host", "chain", "kind", "feature").agg(F.count("*").alias("k"))


def importance(counts: DataFrame, decay: float = 0.9, prior: float = 2.0) -> DataFrame:
    """``host, chain, pages, presentation, content, importance`` of every node with text of its own.

    The importance is (1 - decay) * presentation + decay * content, each from 0 to 1.
    """
    node = counts.groupBy("host", "chain").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k")).otherwise(0)).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log("k")).otherwise(0.0)).alias("__style"),
        F.avg(F.when(F.col("kind") == 1, F.log("k"))).alias("__text"),
    )
    base, m = F.log(F.col("pages") + prior), F.col("pages")
    shown = F.greatest(F.lit(0.0), F.log(m) - F.col("__style") / m) / base
    node = node.where("__text IS NOT NULL").select("host", "chain", "pages", F.when(m > 1, shown).otherwise(1.0).alias("presentation"), (1 - F.col("__text") / base).alias("content"))
    return node.withColumn("importance", (1 - decay) * F.col("presentation") + decay * F.col("content"))


def low_branches(counts: DataFrame, nodes: DataFrame, threshold: float = 0.2, leaf_threshold: float = 0.05, prior: float = 2.0) -> DataFrame:
    """``host, code``: nodes of low importance, and low leaves of the other nodes."""
    low = F.col("importance") < threshold
    node = F.struct("host", "chain").alias("node")
    leaves = counts.where("kind = 1 AND k > 1").select(node, "feature", "k")
    per = leaves.groupBy("node").agg(F.count("*").alias("n"))
    rest = nodes.where(~low).select(node, "pages").join(per, "node")
    recurs = 1 - F.log("k") / F.log(F.col("pages") + prior) < leaf_threshold
    met = dealt_join(leaves, rest, "node", ["feature"], "n", leaves.count()).where(recurs)
    return nodes.where(low).select("host", F.col("chain").alias("code")).union(met.select("node.host", F.col("feature").alias("code")))


def extract(pages: DataFrame, threshold: float = 0.2, leaf_threshold: float = 0.05, decay: float = 0.9, prior: float = 2.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` of every page."""
    counts, counts_path = materialize(feature_counts(pages, url_col, html_col), "style-features")
    nodes, nodes_path = materialize(importance(counts, decay, prior), "style-nodes")
    low, _ = materialize(low_branches(counts, nodes, threshold, leaf_threshold, prior), "style-tree")
    for path in (counts_path, nodes_path):
        remove(pages.sparkSession, path)
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias("__html"), _host(url_col).alias("__host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), frozenset(codes.as_py() or ())) for page, codes in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    trees = low.groupBy(F.col("host").alias("__host")).agg(F.collect_set("code").alias("__codes"))
    sizes = source.groupBy("__host").agg(F.count("*").alias("__n"))
    trees, _ = materialize(trees.join(sizes, "__host"), "style-trees")
    met = dealt_join(source, trees, "__host", [id_col, url_col], "__n", pages.count(), "left").select(id_col, url_col, "__html", "__codes")
    return met.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")
