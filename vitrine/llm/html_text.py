"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree: a node is the path of its elements (tag
and first class or id), its presentations are the sequences of child elements seen under it,
and its content are the text blocks at it.  With m pages holding a node, its importance is

* presentation: the entropy of its presentations to base m (1 for a node on one page);
* content: the share of its blocks' entropy in the entropy that all-different blocks would have;

and the greater of the two stands for a node, so a node that shows every reader the same
thing, page after page, has low importance.  A branch has the greatest importance in it, that of
a node or of any node below.  Branches under ``threshold`` all of whose nodes are on
``min_pages`` pages or more are removed from every page, whole, inside an ``article`` or
``main`` element as well.  Pages of a host with the same content count as one.  Statistics are
grouped per host and node with partial sums, so a host with a third of all pages is no hot task.

The tree cannot tell a fresh menu or advert from an article, as both differ from page to page;
elements whose tag, role, class or id names such a part are therefore removed first.  Where a
page has an ``article`` or ``main`` element, text outside it is dropped.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space.  Null and empty pages have empty text.  Unclosed elements end
with their parent.  The input's columns are kept; one named ``text``, ``n_chars`` or as a helper
is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from vitrine.llm.common import slices
from vitrine.session import materialise

THRESHOLD = 0.3
MIN_PAGES = 5
SALTS = 64

# Kinds of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
NOISE_TAGS = frozenset(
    "script style noscript template head title nav header footer aside form menu dialog button input select textarea "
    "iframe object embed applet svg canvas audio video map noframes noembed datalist option".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split()
)
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adbox adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist disqus reply replies respond cookie cookies consent gdpr disclaimer footer footnotes header masthead menu "
    "menus nav navbar navigation newsletter notice notices pager pagination popup modal overlay promo promotion promoted related "
    "recommended recommendations share sharing sidebar sidebars sitemap skip social sponsor sponsored sponsors subscribe "
    "subscription signup login toc toolbar topbar widget widgets copyright legal".split()
)
# a name that begins so tells of a layout (has-sidebar), not of a part
LAYOUT_WORDS = frozenset("has have is no not with without js".split())
#: Elements that a new block of the key's kind closes, up to the nearest ancestor of the second set.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|\"|')*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Za-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, value in _ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), entities.unescape(value))
    return found


def _is_noise(tag: str, attributes: dict[str, str]) -> bool:
    if tag in NOISE_TAGS:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if _INVISIBLE.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        parts = [p.lower() for p in _NAME_PART.findall(_CAMEL.sub(" ", name))]
        if parts and parts[0] not in LAYOUT_WORDS and not NOISE_NAMES.isdisjoint(parts):
            return True
    return False


class Page:
    """The text blocks of one page with their nodes, and the child sequence of every node."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool]] = []  # node, text, inside article or main
        self.children: dict[str, list[str]] = {}
        self.has_main = False
        self._read(source)

    def _read(self, source: str) -> None:
        # an open element: tag, path of its node, whether it is noise, whether it is in the main part
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
        pending: list[str] = []
        at, end = 0, len(source)

        def flush() -> None:
            if pending:
                text = " ".join("".join(pending).split())
                if text:
                    self.blocks.append((stack[-1][1], text, stack[-1][3]))
                pending.clear()

        def close_to(depth: int) -> None:
            if any(x[0] in BLOCKS for x in stack[depth:]):
                flush()
            del stack[depth:]

        while at < end:
            tag_at = source.find("<", at)
            if tag_at < 0:
                tag_at = end
            if tag_at > at and not stack[-1][2]:
                pending.append(entities.unescape(source[at:tag_at]) if "&" in source[at:tag_at] else source[at:tag_at])
            if tag_at == end:
                break
            found = _TAG.match(source, tag_at)
            if not found:
                rest = source[tag_at + 1 : tag_at + 3]
                if rest[:1].isascii() and rest[:1].isalpha() or rest[:1] == "/" and rest[1:].isalpha():
                    break  # a tag that the page's end cuts off
                if not stack[-1][2]:
                    pending.append("<")
                at = tag_at + 1
                continue
            at = found.end()
            if not found[2]:
                continue  # comments, declarations
            tag = found[2].lower()
            if found[1]:
                self._close(tag, stack, close_to, flush)
                continue
            attributes = _attributes(found[3]) if found[3] else {}
            if tag in BLOCKS:
                self._make_room(tag, stack, close_to)
                flush()
            noise = stack[-1][2] or _is_noise(tag, attributes)
            if tag in RAW and (noise or tag in _RAW_END):
                closing = _RAW_END[tag].search(source, at)
                at = closing.end() if closing else end
                continue
            if tag in VOID:
                continue
            main = stack[-1][3] or tag in ("article", "main") or attributes.get("role", "").lower() == "main"
            path = stack[-1][1]
            if tag in BLOCKS:
                names = attributes.get("class") or attributes.get("id") or ""
                step = f"{tag}.{names.split()[0]}" if names.split() else tag
                if not noise:
                    self.children.setdefault(path, []).append(step)
                path = f"{path}/{step}"
            if main and not noise:
                self.has_main = True
            stack.append((tag, path, noise, main))
        flush()

    @staticmethod
    def _close(tag, stack, close_to, flush) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == tag:
                close_to(depth)
                return
            if tag not in BLOCKS and stack[depth][0] in BLOCKS:
                return  # an inline end tag does not close blocks
        if tag in ("p", "br") and not stack[-1][2]:
            flush()

    @staticmethod
    def _make_room(tag, stack, close_to) -> None:
        """Elements that a new element ends although their end tags are missing."""
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in BLOCKS:
                    break
        if tag in IMPLIED:
            ended, limit = IMPLIED[tag]
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in limit:
                    break
                if stack[depth][0] in ended:
                    lowest = depth
            if lowest:
                close_to(lowest)

    def text(self, removed: frozenset[str] = frozenset()) -> str:
        """The main text; blocks at or under a removed node are left out, and those outside a main part, where there is one."""
        blocks = [(node, t) for node, t, main in self.blocks if main or not self.has_main]
        return " ".join(t for node, t in blocks if not removed or not _under(node, removed))


def _under(node: str, removed: frozenset[str]) -> bool:
    while node:
        if node in removed:
            return True
        node = node.rpartition("/")[0]
    return False


def host_of(url: str):
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, page, node, look, content) of the nodes of all pages, one row per node and page of its own content.

    ``page`` digests the blocks of the page's main part with their nodes, ``look`` the node's child elements, ``content`` the
    blocks at the node.
    """
    import hashlib

    def digest(parts: list[str]) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for host, source in zip(batch.column("_host").to_pylist(), batch.column(html).to_pylist()):
                page = Page(source or "")
                own = digest([part for node, text, main in page.blocks if main or not page.has_main for part in (node, text)])
                texts: dict[str, list[str]] = {}
                for node, text, _ in page.blocks:
                    texts.setdefault(node, []).append(text)
                for node in {*page.children, *texts}:
                    rows.append((host, own, node, digest(page.children.get(node, [])), digest(texts.get(node, [])), node in texts))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["host", "page", "node", "look", "content", "has_text"]
                )

    rows = pages.select("_host", html).mapInArrow(
        run, "host string, page long, node string, look long, content long, has_text boolean"
    )
    # pages of the same text that differ in empty elements are one page, that of the least look
    return rows.groupBy("host", "page", "node", "content", "has_text").agg(F.min("look").alias("look"))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, importance): entropies of presentation and content, to base of the page count."""
    log = F.log2(F.col("n").cast("double"))

    def entropy(column: str, name: str) -> DataFrame:
        counts = nodes.groupBy("host", "node", column).agg(F.count("*").alias("n"), F.max("has_text").alias("has_text"))
        sums = counts.groupBy("host", "node").agg(
            F.sum("n").alias("pages"), F.sum(F.col("n") * log).alias("s"), F.max("has_text").alias("has_text")
        )
        m = F.col("pages").cast("double")
        bits = F.when(m > 1, (F.log2(m) - F.col("s") / m) / F.log2(m)).otherwise(1.0)
        return sums.select("host", "node", "pages", "has_text", bits.alias(name))

    looks = entropy("look", "presentation")
    contents = entropy("content", "content").select("host", "node", F.when(F.col("has_text"), F.col("content")).alias("content"))
    return looks.join(contents, ["host", "node"]).select(
        "host", "node", "pages", F.greatest("presentation", F.coalesce("content", F.lit(0.0))).alias("importance"), "has_text"
    )


def removable(nodes: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, nodes): the nodes of branches that hold text and are of low importance throughout."""
    judged = importance(nodes).withColumn("low", (F.col("importance") < threshold) & (F.col("pages") >= min_pages))
    judged = materialise(judged, "judged")
    # a node above one that is not low stays, whatever its own importance
    steps = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    kept = judged.where(~F.col("low")).select("host", F.explode(above).alias("node")).distinct()
    low = judged.where(F.col("low") & F.col("has_text")).join(kept, ["host", "node"], "left_anti")
    return low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("_removed"))


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Every page with ``text`` and ``n_chars`` in place of its html."""
    pages = pages.drop("text", "n_chars", "_host", "_salt", "_removed")
    hosted = pages.withColumn("_host", host_of(url)).withColumn("_salt", F.pmod(F.xxhash64(url, html), F.lit(SALTS)))
    removed = removable(materialise(style_nodes(hosted, html), "style-nodes"), threshold, min_pages).withColumnRenamed("host", "_host")
    # a host's pages are dealt over SALTS keys, its few nodes are copied to each
    copies = removed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = hosted.join(copies, ["_host", "_salt"], "left")
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                Page(source or "").text(frozenset(gone or ()))
                for source, gone in zip(batch.column(html).to_pylist(), batch.column("_removed").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=schema.names,
            )

    return joined.select(*pages.columns, "_removed").mapInArrow(run, schema)
