"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths (tag and
class).  A node's presentation importance is the entropy of the child sequences it
shows over the host's pages; a leaf's content importance is one minus the mean
entropy of its texts over the pages (a text that comes back on many pages carries
little); the composite importance of a node joins its own with that of its children,
bottom up.  Branches of low composite importance are cut from every page, beside those
whose element, role or class says that they are not the article.  html, body and what
holds an article element are never cut with it; inside an article a branch is cut if it is
there on ``MIN_PAGES`` pages, but never all of the article.  Pages with the same
text in their article (or, without one, on the whole page) count as one page
together, so copies are no boilerplate.  A host needs ``MIN_PAGES`` such pages for its
tree to count.

Only counts are gathered: pages by (host, path, text) and (host, path, child sequence),
summed before the shuffle, so a host with a third of all pages is no larger a group
than its distinct texts.  What goes back to the pages is one row per host, its cut paths.

Defined results: null or empty html and pages without text give an empty text;
a null or broken url is a host of its own; repeated rows give the same text; an empty
table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, join_small, staged

MIN_PAGES = 10
GAMMA = 0.9
IMPORTANT = 0.35

# Fixed lists of HTML elements and of names in use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
SILENT = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "button", "title")
OUTSIDE = frozenset("nav footer aside form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu modal nav navbar navigation newsletter notice popup promo promotion related replies reply share "
    "sharing sidebar signup social sponsor sponsored subscribe".split()
)
# An open element on the left ends where one on the right begins.
ENDS = {
    "p": BLOCKS - {"body", "html", "head"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
    "head": frozenset({"body"}),
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(?P<silent>{'|'.join(SILENT)})\b[^>]*>.*?(?:</(?P=silent)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
# For Spark: the article of a page, and what is not its text.
_ARTICLE = r"(?is)<(article|main)\b.*</\1\s*>"
_BARE = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+"
_NAME = re.compile(r"[a-z]+")


class Node:
    """An open element: its path, whether its names or the tree cut it, whether it is inside an article."""

    __slots__ = ("tag", "path", "named", "low", "cut", "article", "children")

    def __init__(self, tag: str, path: str, named: bool, low: bool, article: bool):
        self.tag, self.path, self.named, self.low, self.article, self.children = tag, path, named, low, article, []
        self.cut = named or low


def _named(attrs: str, tag: str, article: bool) -> tuple[str, bool, bool]:
    """Class of an element for its path; whether its names say it is not the article, or that it is the main part."""
    if not attrs.strip():
        return "", False, False
    given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)}
    names = (given.get("class", "") + " " + given.get("id", "")).lower()
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    words = set(_NAME.findall(names))
    out = hidden or role in ROLES or bool(words & NAMES) or (not article and "header" in words)
    return ".".join(sorted(given.get("class", "").replace("/", "|").split())), out, role == "main"


def blocks(page: str | None, cut_paths: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, bool, bool]]:
    """(path, text, cut, in article) of every block of text in page order."""
    yield from _walk(page or "", cut_paths, None)


def _walk(page: str, cut_paths: frozenset[str], closed: list[Node] | None) -> Iterator[tuple[str, str, bool, bool]]:
    root = Node("", "", False, False, False)
    stack, parts, place = [root], [], 0

    def text() -> str:
        out = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        return out

    def leave(n: int) -> None:
        if closed is not None:
            closed.extend(stack[n:])
        del stack[n:]

    for m in _MARKUP.finditer(page):
        parts.append(page[place : m.start()])
        place = m.end()
        tag = m["tag"]
        if not tag:
            if m["silent"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        top = stack[-1]
        if tag in BLOCKS:
            said = text()
            if said:
                yield top.path, said, top.cut, top.article
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in VOID:
            continue
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS or tag in ENDS:
            # an inline element that was left open ends with its block
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS and tag in ENDS[stack[i].tag]:
                    leave(i)
                    break
                if stack[i].tag in BLOCKS and stack[i].tag != "p":
                    break
            top = stack[-1]
        if tag not in BLOCKS and tag not in ENDS and tag not in OUTSIDE:
            # inline: part of its block, unless its names cut it
            _, out, _ = _named(m["attrs"] or "", tag, top.article)
            if not out:
                continue
        name, out, main = _named(m["attrs"] or "", tag, top.article)
        path = f"{top.path}/{tag}{'.' + name if name else ''}"
        article = top.article or tag in ("article", "main") or main
        begins = article and not top.article
        said_cut = out and tag not in ("body", "html") and not (begins and tag in ("article", "main"))
        named = top.named or said_cut or tag in OUTSIDE or (tag == "header" and not top.article)
        # an article begins anew where the tree cuts what it lies in
        low = (top.low or (path in cut_paths and tag not in ("body", "html"))) and not begins
        new = Node(tag, path, named, low, article)
        top.children.append(tag)
        if new.cut != top.cut and parts:
            said = text()
            if said:
                yield top.path, said, top.cut, top.article
        stack.append(new)
    parts.append(page[place:])
    said = text()
    if said:
        yield stack[-1].path, said, stack[-1].cut, stack[-1].article
    leave(1)


def main_text(page: str | None, cut_paths: frozenset[str] = frozenset()) -> str:
    """The article's blocks, joined by line feeds; without an article element, the
    blocks of the page that are not cut."""
    every = [(t, article) for _, t, cut, article in blocks(page, cut_paths) if not cut]
    inside = [t for t, article in every if article]
    if not inside and cut_paths:
        inside = [t for _, t, cut, article in blocks(page) if article and not cut]
    return "\n".join(inside or [t for t, _ in every])


def _facts(page: str) -> Iterator[tuple[str, str, str]]:
    """(path, kind, value) of a page, each once: its texts by path and child sequences by element."""
    closed: list[Node] = []
    facts = {(path, "text", said) for path, said, _, _ in _walk(page, frozenset(), closed)}
    for node in closed:
        runs = [t for i, t in enumerate(node.children) if i == 0 or node.children[i - 1] != t]
        facts.add((node.path, "style", " ".join(runs)))
        facts.add((node.path, "page", ""))
        if node.article:
            facts.add((node.path, "inside", ""))
    return iter(facts)


def importance(counts: pd.DataFrame) -> dict[str, tuple[float, float]]:
    """Composite importance of the paths of one host, and the highest importance in the
    branch, from (path, kind, k, h, n): distinct values, sum of entropies by value, pages."""
    pages = {r.path: r.n for r in counts.itertuples() if r.kind == "page"}
    style = {r.path: r.h for r in counts.itertuples() if r.kind == "style"}
    content = {r.path: 1 - r.h / r.k for r in counts.itertuples() if r.kind == "text" and r.k}
    children: dict[str, list[str]] = {}
    for path in pages:
        children.setdefault(path.rpartition("/")[0], []).append(path)
    out: dict[str, tuple[float, float]] = {}
    for path in sorted(pages, key=lambda p: -p.count("/")):
        below = children.get(path, [])
        own = content.get(path)
        if below:
            weight = sum(pages[c] for c in below)
            under = sum(out[c][0] * pages[c] for c in below) / weight
            fade = GAMMA ** len(below)
            value = (1 - fade) * min(1.0, style.get(path, 0.0)) + fade * under
            value = max(value, own) if own is not None else value
        else:
            value = own if own is not None else 0.0
        out[path] = value, max([value, *(out[c][1] for c in below)])
    return out


def cut_branches(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, least: float = IMPORTANT) -> DataFrame:
    """(host, paths): the branches of low importance of every host with enough pages."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = 1 / batch["copies"].fillna(1)
            rows = [(h, *fact, w) for h, page, w in zip(batch["host"], batch["html"], share, strict=True) for fact in _facts(page)]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "value", "share"])

    source = pages.select(F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")).alias("host"), col(html).alias("html"))
    article = F.regexp_extract("html", _ARTICLE, 0)
    same = F.xxhash64(F.regexp_replace(F.when(article != "", article).otherwise(F.col("html")), _BARE, ""))
    source = source.filter("html <> ''").withColumn("same", same)
    copies = staged(source.groupBy("host", "same").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "page-copies")
    facts = join_small(source, copies, ["host", "same"]).drop("same")
    facts = facts.mapInPandas(gather, "host string, path string, kind string, value string, share double")
    # the hash stands for the text: only on how many distinct pages it comes back counts
    seen = facts.groupBy("host", "path", "kind", F.xxhash64("value").alias("v")).agg(F.round(F.sum("share"), 6).alias("n"))
    seen = staged(seen, "site-counts")
    of_node = seen.filter("kind = 'page'").select("host", "path", F.col("n").alias("m"))
    with_m = seen.join(of_node, ["host", "path"]).filter(F.col("m") > 1)
    share = F.col("n") / F.col("m")
    log_m = F.log(F.col("m"))
    entropy = F.when(F.col("kind") == "style", -share * F.log(share) / log_m).otherwise(F.log(F.greatest(F.col("n"), F.lit(1.0))) / log_m)
    nodes = with_m.groupBy("host", "path", "kind").agg(F.count(F.lit(1)).alias("k"), F.sum(entropy).alias("h"), F.max("m").alias("n"))
    large = of_node.groupBy("host").agg(F.max("m").alias("pages")).filter(F.col("pages") >= min_pages).select("host")

    def judge(tree: pd.DataFrame) -> pd.DataFrame:
        # a branch goes where neither it nor any part of it matters
        inside = {r.path for r in tree.itertuples() if r.kind == "inside" and r.n < min_pages}
        low = sorted(p for p, (_, highest) in importance(tree).items() if highest < least and p not in inside)
        return pd.DataFrame({"host": [tree["host"].iloc[0]], "paths": [low]})

    return nodes.join(large, "host").groupBy("host").applyInPandas(judge, "host string, paths array<string>")


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) of every page with ``text`` and ``n_chars``."""
    cols = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars")]
    cuts = staged(cut_branches(pages, html, url), "site-cuts")
    rows = pages.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(cols)],
        F.coalesce(F.try_parse_url(col(url), F.lit("HOST")), F.lit("")).alias("host"),
        col(html).alias("page"),
    )
    joined = join_small(rows, cuts, ["host"]).drop("host")
    schema = joined.drop("page", "paths").schema.add("text", "string")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [frozenset(p) if p is not None else frozenset() for p in batch["paths"]]
            out = batch.drop(columns=["page", "paths"])
            out["text"] = [main_text(page, c) for page, c in zip(batch["page"], cut, strict=True)]
            yield out

    texts = joined.mapInPandas(read, schema)
    return texts.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "text", F.length("text").cast("bigint").alias("n_chars")
    )
