"""HTML extraction with site style trees (Yi, Liu and Li, "Eliminating Noisy Information in Web Pages", 2003).

A page is parsed to a tree of elements. The trees of a host's pages are merged by path (tag and first class or id of
each block element from the body down); a node of the merged tree counts, over the host's distinct pages, which child
sequences (presentation) and which contents stand there. A content is that of the whole branch, everything below
included, so a branch whose children vary is never unimportant. Each of the two distributions has an entropy, as a share
of the largest possible one; the greater one, drawn towards 1 where few pages hold the node, is the node's importance.
Branches of low importance - the same menu, footer or notice on page after page - are removed from every page of the
host, inside articles too.

Markup that states a role (nav, footer, aside, forms, ``role=``, and classes or ids made of nothing but words for
adverts, comment lists, cookie notices and the like) is the tree's prior: the importance of such a branch is zero however
varied its text. An article or main element is never removed itself, and is freed of a form or an overlay that wraps the
page; text that stands outside of it goes for its role or its importance, not for where it stands.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import materialise

#: Branches of less importance go. A node's entropy counts once for each page that holds it, and 1 counts so many times.
LEAST_IMPORTANCE, PRIOR_PAGES = 0.3, 3

# Names of HTML, and words that classes and ids use for what is not the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|xmp|noembed|noframes"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav footer aside form button select option svg canvas object audio video map dialog menu fieldset".split())
#: Elements that state where the text is; they are never removed.
STATED = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion "
    "banner cookie cookies consent gdpr notice notices notification notifications newsletter subscribe subscription signup "
    "sidebar sidebars nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer comment comments commentlist "
    "respond reply replies disqus share sharing social related recommended recommendations popup modal overlay "
    "toolbar pagination pager login copyright disclaimer masthead topbar".split()
)
#: Those of them that may name what stands around a whole page.
WRAPPING = frozenset("overlay modal popup".split())
#: Words that say nothing more beside one of the above.
GENERIC = frozenset("site page top bottom left right main global primary secondary box bar area block list links link section wrapper wrap container inner item items widget button buttons row panel posts articles js".split())
HEADERS = frozenset("header header-top page-header site-header top-header".split())
#: Opening one of the first closes an open one of the second, if none of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/][^>]*>"
    r"|<[a-z/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class _Element:
    __slots__ = ("tag", "path", "owner", "noise", "wrapped", "main", "gone", "children", "parts")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, gone: bool, owner: _Element | None = None):
        self.tag, self.path, self.noise, self.main, self.gone = tag, path, noise, main, gone
        self.wrapped = False  # noise only because of what may wrap a page
        self.owner = owner or self  # the node of the tree whose text this is
        self.children: list[str] = []
        self.parts: list[bytes] = []


def _names_noise(word: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", word) if x]
    return not NOISE.isdisjoint(parts) and all(x in NOISE or x in GENERIC for x in parts)


def _is_noise(tag: str, names: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if names and tag not in STATED:
        if names.get("role", "").lower() in ROLES:
            return True
        words = (names.get("class", "") + " " + names.get("id", "")).lower().split()
        return any(w in HEADERS and not inside or _names_noise(w) for w in words)
    return False


def _may_wrap(tag: str, names: dict[str, str]) -> bool:
    """Whether noise is of a kind that can stand around all of a page."""
    words = set(re.split(r"[-_\s]+", (names.get("class", "") + " " + names.get("id", "")).lower())) - {""}
    return tag == "form" and not (words & NOISE - WRAPPING) or tag not in DROPPED and bool(words) and not (words & NOISE - WRAPPING) and names.get("role", "") == ""


def _digest(parts: list[bytes]) -> bytes:
    return xxhash.xxh64_digest(b"".join(parts))


class Page:
    """A parsed page: ``blocks`` of text in page order, each with whether a role or the host's tree (``removed`` paths)
    takes it away and whether it stands in an element below the body; ``nodes``: what it adds to its host's tree."""

    def __init__(self, source: str | None, removed: frozenset[int] | set[int] = frozenset()):
        self.blocks: list[tuple[bool, bool, bool, str]] = []
        self.stated = False
        #: path -> (noise, contents, child sequences), one of each for every element there
        self.nodes: dict[int, tuple[bool, list[bytes], list[bytes]]] = {}
        self.removed = removed
        self.stack = [_Element("", 0, False, False, False)]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        source = source or ""
        at = 0
        for m in _MARKUP.finditer(source):
            if m.start() > at:
                self.text.append(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
            else:
                self._open(tag, m["rest"] or "")
        if at < len(source):
            self.text.append(source[at:])
        self._pop(0)
        self._flush()

    def _flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text.clear()
            if text:
                top = self.stack[-1]
                self.blocks.append((top.noise, top.gone, top.owner.tag not in ("", "html", "body"), text))
                top.owner.parts.append(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")))

    def _pop(self, size: int) -> None:
        """Close elements until ``size`` of them, the root not counted, stay open."""
        while len(self.stack) - 1 > size:
            gone = self.stack[-1]
            if gone.owner is gone:
                self._flush()
            self.stack.pop()
            self.open[gone.tag] -= 1
            if gone.owner is gone and gone.parts:
                content, up = _digest(gone.parts), self.stack[-1].owner
                up.parts.append(content)
                if gone.tag not in STATED and not up.noise:
                    node = self.nodes.setdefault(gone.path, (gone.noise, [], []))
                    if not gone.noise:
                        node[1].append(content)
                        node[2].append(" ".join(gone.children).encode("utf-8", "surrogatepass") + b"\n")

    def _find(self, tags: set[str], until: set[str]) -> int | None:
        if not any(self.open[t] for t in tags):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in until:
                return None
        return None

    def _open(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            else:
                self.text.append(" " if tag in ("br", "wbr") else "")
            return
        inline = tag in INLINE
        if not inline:
            open_p = self._find({"p"}, {"table", "td", "th", "button", "object"})
            if open_p:
                self._pop(open_p - 1)
            if tag in IMPLIED and (i := self._find(*IMPLIED[tag])):
                if tag == "tr" and (row := self._find({"tr"}, {"table"})):
                    i = row
                self._pop(i - 1)
        names = {}
        if "=" in rest:
            for m in _NAMES.finditer(rest):
                names.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        up = self.stack[-1]
        role = names.get("role", "").lower()
        stated = tag if tag in ("article", "main") else role if role in ("article", "main") else ""
        # a form or an overlay may wrap a whole page: what states the text inside it is not part of it
        freed = stated == "main" or stated == "article" and up.wrapped
        own = _is_noise(tag, names, up.main)
        noise = up.noise and not freed or own
        wrapped = (up.wrapped or not up.noise) and noise and (not own or _may_wrap(tag, names))
        self.open[tag] += 1
        if inline and noise == up.noise:
            self.stack.append(_Element(tag, up.path, noise, up.main, up.gone, up.owner))
            self.stack[-1].wrapped = up.wrapped
            return
        main = up.main or bool(stated)
        self.stated |= bool(stated) and not noise
        self._flush()
        first = (names.get("class", "") + " " + names.get("id", "")).split()
        label = tag + ("." + first[0] if first else "") + "!" * noise
        up.owner.children.append(label)
        path = xxhash.xxh64_intdigest(label.encode("utf-8", "surrogatepass"), up.path) >> 1
        self.stack.append(_Element(tag, path, noise, main, up.gone or path in self.removed and tag not in STATED))
        self.stack[-1].wrapped = wrapped

    def _close(self, tag: str) -> None:
        if tag == "p" and not self._find({"p"}, {"table"}):
            self._flush()
            return
        until = set() if tag in ("body", "html", "table", "article", "main") else {"table", "article", "main"} - {tag}
        if i := self._find({tag}, until):
            self._pop(i - 1)

    def rows(self) -> Iterator[tuple[int, bool, int, int]]:
        """(path, noise, content, presentation) of every node that holds text; what stands in noise is part of it."""
        as_int = lambda x: int.from_bytes(_digest(x), "big") >> 1
        for path, (noise, contents, styles) in self.nodes.items():
            yield path, noise, as_int(contents), as_int(styles)

    def extract(self) -> str:
        """The kept blocks, a line each. Bare text of the body counts only where no element states the text. A page whose
        host's tree would leave nothing of it keeps what roles leave."""
        kept = [b for b in self.blocks if not b[0] and (b[2] or not self.stated)]
        return "\n".join(b[3] for b in [b for b in kept if not b[1]] or kept)


def _host(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """``(host, path, pages, importance)`` of every text-holding node of every host's tree.

    Pages of a host with equal html count once: copies say nothing of what is common to different pages. Equal
    contents of a node are counted before anything is gathered, so a host with a third of all pages is a number of
    counts, not a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "page", "path", "noise", "content", "style"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = source.as_py() or ""
                page = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")) >> 1
                for path, noise, content, style in Page(source).rows():
                    rows.append((host, 0, path, True, 0, 0) if noise else (host, page, path, False, content, style))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    sources = pages.select(_host().alias("host"), F.col("html").cast("string"))
    nodes = sources.mapInArrow(run, "host string, page long, path long, noise boolean, content long, style long").distinct()
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("content").alias("what")), F.struct(F.lit(1).alias("kind"), F.col("style").alias("what")))
    flat = nodes.select("host", "path", "noise", F.explode(both).alias("x")).select("host", "path", "noise", "x.*")
    counts = flat.groupBy("host", "path", "noise", "kind", "what").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "path", "noise", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    drawn = F.when(F.col("noise"), 0.0).otherwise((F.col("m") * entropy + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES))
    return sums.withColumn("drawn", drawn).groupBy("host", "path").agg(F.max("m").alias("pages"), F.max("drawn").alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row per input row; a null html counts as empty, a null url or one without
    a host as the host of no name. Very large and broken pages are read whole; what is never closed ends with the page.
    Repeated rows and ids each give their row. An empty table gives no rows; further columns, whatever their names, are
    not read. The text of a page depends on its host's other pages: what one page alone holds is never common.
    """
    low = style_tree(pages).where(F.col("importance") < LEAST_IMPORTANCE)
    # written first: its size is then known, and Spark broadcasts it only where it is small
    low = materialise(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("removed")), "branches")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string"), _host().alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py(), set(gone or ())).extract() for source, gone in zip(batch.column(2), batch.column(3).to_pylist())]
            chars = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(low, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "removed")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_pages(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
