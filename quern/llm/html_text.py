"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element is known by the chain of tags and classes above it. Two
entropies over the distinct pages that have an element say how much it matters: content (is its text different from
page to page) and, for elements with children, presentation (do they look different from page to page). That importance is
mixed with what the page says itself, the more the more pages speak: text of article or main is expected to stay, text
beside it to go, and where a page has no such part all text is expected to stay. Branches whose elements all have a low
importance go. What tags, roles or names call a menu, header, footer, sidebar, notice, advert, form or comments has
importance 0, as new texts in it from page to page make it no article; inside article and main a name counts if all of its
words say so.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.url_filter import host_of

# Fixed values of HTML and of common naming.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select datalist dialog menu head header".split())
MAIN = frozenset(("article", "main"))
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl select table div article section main body td th".split())
CONTAINERS = frozenset("div section ul ol dl table fieldset details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus respond replies share sharing social "
    "related recommended newsletter subscribe subscription signup login widget pagination pager toolbar search skip".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo".split())
COMMENTS = frozenset("comment comments disqus respond replies reply".split())
# Words that say of a name which part of a page it is for, and nothing of what it holds.
PLACES = frozenset(
    "list thread section box container wrapper wrap area block item items bar inner outer user users unit slot link links button buttons group panel row holder site page top bottom left right main form posts articles stories content".split()
)
HEADING = re.compile(r"h[1-6]$")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")


@dataclass(frozen=True)
class Tree:
    """lowest: elements under this importance go. share: of presentation in an element's importance. pages: distinct
    pages that an element needs before the tree says anything of it; at so many it is believed half, the rest being an importance
    of 1. most, most_inside: how far the tree is believed at most, on pages without article and main and inside these, so
    that importances under 0.625 and 0.25 do it there. names: whether class names and ids count. low: the tree keeps elements under it."""

    lowest: float = 0.7
    share: float = 0.2
    pages: int = 8
    most: float = 0.8
    most_inside: float = 0.4
    names: bool = True
    low: float = 0.7


class Page:
    """A page as nodes (parent, path id, in the main part) and blocks (node, text). Dropped parts leave nothing."""

    __slots__ = ("parents", "paths", "mains", "styles", "blocks", "names")

    def __init__(self, text: str, path_of, names: bool = True) -> None:
        self.parents, self.paths, self.mains, self.styles, self.blocks, self.names = [-1], [0], [False], [[]], [], names
        self._read(text, path_of)

    def _read(self, text: str, path_of) -> None:
        stack = [("", 0, False)]  # tag, node, dropped
        opened: dict[str, int] = {}
        buffer: list[str] = []
        last_quote = {q: text.rfind(q) for q in "\"'"}
        at, size = 0, len(text)

        def flush() -> None:
            if buffer:
                if block := " ".join("".join(buffer).split()):
                    self.blocks.append((stack[-1][1], block))
                buffer.clear()

        def pop() -> None:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
            stack.pop()
            opened[tag] -= 1

        while at < size:
            lt = text.find("<", at)
            if lt < 0:
                lt = size
            if lt > at and not stack[-1][2]:
                piece = text[at:lt]
                buffer.append(entities.unescape(piece) if "&" in piece else piece)
            if lt == size:
                break
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            found = _TAG.match(text, lt)
            if not found:
                if text[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = text.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    if not stack[-1][2]:
                        buffer.append("<")
                    at = lt + 1
                continue
            end = self._end(text, found.end(), last_quote)
            tag, attributes = found[2].lower(), text[found.end() : end]
            at = end + 1
            if found[1]:
                if opened.get(tag):
                    if tag in BLOCK:
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                    else:
                        k = len(stack) - 1
                        while stack[k][0] != tag and stack[k][0] not in BLOCK:
                            k -= 1
                        if stack[k][0] == tag:
                            while len(stack) > k:
                                pop()
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>?", re.I).search(text, at)
                at = size if close is None else close.end()
                continue
            if tag in VOID:
                if not stack[-1][2]:
                    if tag in BLOCK:
                        flush()
                    elif tag in ("br", "wbr"):
                        buffer.append(" " if tag == "br" else "")
                continue
            if tag in BLOCK:
                if opened.get("p"):
                    k = len(stack) - 1
                    while stack[k][0] != "p" and stack[k][0] not in SCOPE:
                        k -= 1
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                if ends := ENDED_BY.get(tag):
                    k = len(stack) - 1
                    while k and stack[k][0] not in ends and stack[k][0] not in SCOPE - ends:
                        k -= 1
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                flush()
            _, node, dropped = stack[-1]
            if not dropped:
                named, dropped = self._look(tag, attributes, self.mains[node])
                if dropped and tag not in BLOCK:
                    buffer.append(" ")
                if not dropped and tag in BLOCK:
                    self.styles[node].append(named)
                    self.parents.append(node)
                    self.paths.append(path_of(self.paths[node], named))
                    self.mains.append(self.mains[node] or tag in MAIN)
                    self.styles.append([])
                    node = len(self.parents) - 1
            stack.append((tag, node, dropped))
            opened[tag] = opened.get(tag, 0) + 1
        while len(stack) > 1:
            pop()
        flush()

    @staticmethod
    def _end(text: str, at: int, last_quote: dict[str, int]) -> int:
        """Where the tag's > stands, not counting any in quotes; a quote that never closes is no quote."""
        while True:
            gt = text.find(">", at)
            if gt < 0:
                return len(text)
            opens = [(p, q) for q in "\"'" if 0 <= (p := text.find(q, at, gt)) and last_quote[q] > p]
            if not opens:
                return gt
            p, q = min(opens)
            close = text.find(q, p + 1)
            if text[p - 1] != "=" and text[p - 1] not in " \t\n":
                at = p + 1  # a quote inside a name
            else:
                at = close + 1

    def _look(self, tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
        """(the element's name in the tree, whether it says itself that it is no main text)."""
        names, dropped = [], tag in DROPPED and not (tag == "header" and in_main)
        if attributes and (tag not in ("html", "body", "main", "article") or in_main and tag == "article"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key == "class" or key == "id":
                    if key == "class":
                        names = sorted(value.split())
                    if self.names and not in_main and not HEADING.match(tag):
                        dropped = dropped or bool({x.lower() for x in _NAME_PARTS.findall(value)} & NAMES)
                    elif self.names and in_main:
                        dropped = dropped or any(self._beside(tag, key, name) for name in value.split())
                elif key == "role":
                    dropped = dropped or value.lower() in ROLES
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    dropped = True
        return ".".join([tag, *names]), dropped

    @staticmethod
    def _beside(tag: str, key: str, name: str) -> bool:
        """Whether a class or id inside article or main names a part that is no main text: of a container, if all its words do, or
        say where it stands; of a paragraph, if its class is that of adverts; of an article in it, if it is one of comments."""
        words = {x.lower() for x in _NAME_PARTS.findall(name) if not x.isdigit()}
        if tag == "article":
            return bool(words & COMMENTS)
        telling = NAMES - {"header"} if tag in CONTAINERS else ADVERTS if tag == "p" and key == "class" else frozenset()
        return bool(words & telling) and words <= telling | PLACES

    def main_blocks(self) -> list[tuple[int, str]]:
        """Those of article or main where the page has one, also an empty one, else all."""
        return [b for b in self.blocks if self.mains[b[0]]] if any(self.mains) else self.blocks


class Paths:
    """64-bit ids of chains of names, the same on all machines."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}

    def __call__(self, parent: int, name: str) -> int:
        key = (parent, name)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = _id(f"{parent}>{name}")
        return self.known[key]


def _id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def features(text: str, path_of: Paths, names: bool = True) -> tuple[int, int, list[dict]]:
    """(two keys of the main text, distinct (content or not, path, feature) of the page). Near copies of an article mostly have
    a key in common, the least of two hashes of its longer blocks. An element without children has presentation 0."""
    page = Page(text, path_of, names)
    out = {(True, page.paths[n], _id(t)) for n, t in page.blocks}
    looks: dict[int, set] = {}
    for k, path in enumerate(page.paths):
        looks.setdefault(path, set()).add(tuple(dict.fromkeys(page.styles[k])))
    out |= {(False, path, _id(repr(sorted(s))) if any(s) else 0) for path, s in looks.items()}
    main = [t for _, t in page.main_blocks()]
    longer = [_id(t) for t in main if len(t) >= 80] or [_id("\n".join(main))]
    return min(longer), min(longer, key=lambda x: x * 0x9E3779B97F4A7C15 & (1 << 64) - 1), [{"content": c, "path": p, "feature": f} for c, p, f in out]


def main_text(text: str, tree: dict[int, tuple[float, int]], p: Tree, path_of: Paths) -> str:
    """The blocks of the main part without those of elements of low importance, and so without branches that have no other;
    tree: (importance, pages) by path. Where no block would be left all stay."""
    page = Page(text, path_of, p.names)
    blocks = page.main_blocks()
    if tree and blocks:
        low: dict[int, bool] = {}
        for n in {n for n, _ in blocks}:
            importance, pages = tree.get(page.paths[n], (1.0, 0))
            trust = min(pages / (pages + p.pages), p.most_inside if page.mains[n] else p.most)
            low[n] = trust * importance + (1 - trust) < p.lowest
        blocks = [b for b in blocks if not low[b[0]]] or blocks
    return "\n".join(t for _, t in blocks)


#: A tree of so many elements is small enough to be sent to every executor.
BROADCAST_ROWS = 100_000


def style_tree(pages: DataFrame, params: Tree, html: str = "html", host: str = "host") -> DataFrame:
    """host, path, importance, pages of the elements of importance under params.low that enough distinct pages have.

    Pages of a host with a key in common count once, so copies don't make an article look like boilerplate; of those the
    one with the least hash is taken. All counts are summed before rows of a host meet, whatever its share of the pages."""

    @F.pandas_udf("key long, key2 long, found array<struct<content boolean, path long, feature long>>")
    def seen(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        path_of = Paths()
        for batch in batches:
            rows = [features(t if isinstance(t, str) else "", path_of, params.names) for t in batch.tolist()]
            yield pd.DataFrame({"key": [r[0] for r in rows], "key2": [r[1] for r in rows], "found": [r[2] for r in rows]})

    read = pages.select(F.col(host).alias("host"), F.xxhash64(html).alias("page"), seen(F.col(html)).alias("x")).select("host", "page", "x.*")
    first = F.min_by(F.struct("page", "key2", "found"), "page").alias("x")
    each = read.groupBy("host", "key").agg(first).select("host", "x.*").groupBy("host", "key2").agg(F.min_by("found", "page").alias("found")).select("host", F.explode("found").alias("x")).select("host", "x.*")
    counted = each.groupBy("host", "path", "content", "feature").agg(F.count("*").alias("c"))
    c, content, shape = F.col("c"), F.col("content"), ~F.col("content") & (F.col("feature") != 0)
    node = counted.groupBy("host", "path").agg(
        F.sum(F.when(content, c)).alias("w"), F.sum(F.when(content, c * F.log(c))).alias("wl"), F.sum(F.when(~content, c)).alias("m"), F.sum(F.when(shape, c)).alias("s"), F.sum(F.when(shape, c * F.log(c))).alias("sl"),
    )
    text = 1 - F.col("wl") / (F.col("w") * F.log("m"))
    look = 1 - F.col("sl") / (F.col("s") * F.log("m"))
    importance = F.when(F.col("s").isNull(), text).otherwise((1 - params.share) * text + params.share * look)
    return node.filter((F.col("m") >= params.pages) & F.col("w").isNotNull()).select("host", "path", importance.alias("importance"), F.col("m").alias("pages")).filter(F.col("importance") < params.low)


def html_text(pages: DataFrame, html: str = "html", url: str = "url", params: Tree | None = None) -> DataFrame:
    """pages with text (blocks joined by a line feed, white space in a block made one space) and n_chars (code points).

    Null and empty html give an empty text. A null url or one without a host is a host of its own, the empty one.
    A very long page is parsed whole in one task, in time that grows with its length. Repeated rows give the same text each,
    and count once in the tree; an empty table gives an empty one. Columns of pages with these names are replaced.
    """
    params = params or Tree()
    made = ("text", "n_chars")
    own = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    told = pages.select(*own, F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    tree = written(style_tree(told, params, "__html", "__host"))
    element = F.struct("path", "importance", "pages")
    shared = None
    if tree.count() <= BROADCAST_ROWS:  # known to every executor, once a worker
        by_host: dict[str, dict[int, tuple[float, int]]] = {}
        for r in tree.collect():
            by_host.setdefault(r["host"], {})[r["path"]] = (r["importance"], r["pages"])
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        joined = told.withColumn("__tree", F.lit(None).cast("array<struct<path: long, importance: double, pages: long>>"))
    else:
        joined = told.join(tree.groupBy(F.col("host").alias("__host")).agg(F.collect_list(element).alias("__tree")), "__host", "left")

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        path_of = Paths()
        for texts, hosts, trees in batches:
            out, known = [], {}
            for t, host, elements in zip(texts.tolist(), hosts.tolist(), trees.tolist(), strict=True):
                if host not in known:
                    known[host] = shared.value.get(host, {}) if shared else {x["path"]: (x["importance"], x["pages"]) for x in elements} if elements is not None else {}
                out.append(main_text(t, known[host], params, path_of) if isinstance(t, str) else "")
            yield pd.Series(out, dtype="object")

    return joined.withColumn("__text", extracted("__html", "__host", "__tree")).select(*own, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
