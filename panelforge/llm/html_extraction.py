"""Main text of web pages by the site style tree of their hosts.

Each page is parsed to a tree whose nodes are labelled by tag, id and class. The trees of a host are merged: nodes
with the same path of labels are one node of the style tree, whose presentations are the sequences of labels
of its children (runs folded). For each node Spark adds up how often each presentation and each text block under
it occurs, and in how many pages. From these come entropies. Presentation that varies says importance; so does a
block that occurs on one page only, while one spread evenly over the host's pages says none. With l presentations
a node's importance is (1 - 0.9**l) * presentation + 0.9**l * content; a leaf has content only. What tags, classes and roles
declare counts first: declared chrome (menus, footers, forms, adverts, comments and the like) has no importance, and
what lies outside a page's declared article has none; the article itself and its headline are never noise. An undeclared
branch goes where its importance is under 0.2 on 3 or more pages, if it is on half of those that have its parent, holds at
most half of the parent's blocks, and the parent is important itself: a host of copies gives no evidence against its articles.

A page's blocks are hashed in its task and summed there first, so shuffles carry hashes and counts, not texts, and a hot
host is spread over its hashes. The branches to remove are sent to tasks while they are few; else pages meet them by
host, in salted groups, streamed behind the host's branches. Both ways give the same rows.

Edge cases: null and empty html give an empty text; pages without a host are judged by themselves; each row is judged on
its own, repeated or not; an empty table gives no rows. Unclosed and stray tags, cut pages, quotes and comments are read
as browsers do, roughly; a tag that never ends is dropped with what follows it. Elements nested deeper than 512 are read as
part of the 512th, as in browsers. White space is what Unicode says it is. A line break is white space of its block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import BROADCAST_BYTES, materialize, table

LEAST_PAGES, LEAST_IMPORTANCE, DAMPING = 3, 0.2, 0.9
DEPTH = 512
SALTS = 64
FLUSH = 100_000

# The names of elements, roles and classes that declare what a branch is.
BLOCKS = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style noscript iframe noembed noframes xmp textarea title".split())
CHROME = set("nav footer aside form dialog menu select button fieldset datalist template svg object video audio canvas applet".split())
IGNORED = set("html head body".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle adslot adbox sponsor sponsors sponsored sponsorship promo promos promoted promotion promotions banner banners"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toolbar topbar skip sidebar sidebars aside rail footer footers colophon masthead"
    " cookie cookies consent gdpr notice notices popup popover modal overlay lightbox paywall newsletter subscribe subscription signup login signin register"
    " share sharing social related recommended recommendations trending popular widget widgets search searchbox searchform form"
    " comment comments commentlist respond reply replies disqus discussion responses".split()
)
PAGE_TOP = {"header", "headers"}
CONTENT_WORDS = set("content article post entry story".split())
NOT_ARTICLE = set("comment comments reply ad ads advert sponsored promo related recommended teaser".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}}
#: What a paragraph isn't closed across.
BOUNDS = {"td", "th", "table", "caption", "button", "object", "template"}

QUOTED = r""""(?:[^"<]*+"|[^"]{0,8192}+")|'(?:[^'<]*+'|[^']{0,8192}+')"""
TOKEN = re.compile(rf"""<!--|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]++|{QUOTED})*+)>|<(/?)([a-zA-Z][^\s/><]*)([^><]*)>|<[!?/]""")
UNENDED = re.compile(r"<[a-zA-Z/!?]")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id\s*=|role|hidden|style|itemprop", re.IGNORECASE)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)"
RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.IGNORECASE) for t in RAW}

MAIN, DEAD, NOISE, TOP, HOLD = 1, 2, 4, 8, 16
WHOLE, PRESENTATION, CONTENT = 0, 1, 2


@lru_cache(50_000)
def declared(tag: str, attributes: str) -> tuple[str, int]:
    """A node's label, and what its tag and attributes say: MAIN; DEAD by tag or role; NOISE by its words, which holds unless a main
    part is inside; TOP for what is noise outside the main part only; HOLD for words that speak of content.
    """
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g), "") for m in ATTRIBUTE.finditer(attributes)}
    names = [html.unescape(found.get(k, "")) for k in ("id", "class")]
    words = {w.lower() for n in names for w in WORD.findall(n)}
    role = found.get("role", "").strip().lower()
    is_main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSEEN.search(found.get("style", "")) is not None
    says = HOLD if words & CONTENT_WORDS else 0
    if tag in CHROME or hidden or role in ROLES:
        says = DEAD
    elif words & (NOT_ARTICLE if is_main else WORDS):
        says |= NOISE
    elif is_main:
        says |= MAIN
    elif tag == "header" or words & PAGE_TOP:
        says |= TOP
    label = " ".join([tag, *(re.sub(r"\d+", "0", n) for n in names)]) if any(names) else tag
    return label, says


class Tree:
    """A page's elements and its runs of text, each with its element and its block."""

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.says = [-1], ["body"], ["body"], [0]
        self.runs: list[tuple[int, int, str]] = []
        self.block = 0
        self.stack: list[tuple[str, int]] = [("body", 0)]
        self.open: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while m := TOKEN.search(source, at):
            self._text(source, at, m.start())
            name = m[2] or m[5]
            if not name:
                end = COMMENT_END.search(source, m.start() + 2) if m[0] == "<!--" else None
                at = (end.end() if end else len(source)) if m[0] == "<!--" else source.find(">", m.end()) + 1 or len(source)
                continue
            at, tag = m.end(), name.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = (m[3] if m[2] else m[6]) or ""
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = (source.find(">", end.start()) + 1 or len(source)) if end else at if tag == "title" else len(source)
                continue
            self._open(tag, attributes)
        tail = UNENDED.search(source, at)
        self._text(source, at, tail.start() if tail else len(source))

    def _text(self, source: str, start: int, end: int) -> None:
        if end > start:
            self.runs.append((self.block, self.stack[-1][1], source[start:end]))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in IGNORED:
            return
        if tag in VOID:
            if tag == "hr":
                self._close_paragraph()
                self.block += 1
            elif tag == "br":
                self._text(" ", 0, 1)
            return
        inline = tag not in BLOCKS
        if not inline:
            self._close_paragraph()
            self.block += 1
            if tag in CLOSED_BY:
                self._close_siblings(tag)
        if len(self.stack) >= DEPTH:
            return
        label, says = declared(tag, attributes if TELLING.search(attributes) else "")
        node = self.stack[-1][1]
        if not inline or says:
            self.parent.append(node)
            self.tag.append(tag)
            self.label.append(label)
            self.says.append(says)
            node = len(self.parent) - 1
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop()[0]] -= 1

    def _close_paragraph(self) -> None:
        if self.open.get("p"):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    return self._pop_to(k)
                if self.stack[k][0] in BOUNDS:
                    return None
        return None

    def _close_siblings(self, tag: str) -> None:
        """Ends what a new item, cell or row ends by itself."""
        size = len(self.stack)
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in CLOSED_BY[tag]:
                size = k
            elif self.stack[k][0] in HOLDERS.get(tag, {"table"}):
                break
        self._pop_to(size)

    def _close(self, tag: str) -> None:
        if tag in IGNORED:
            return
        if tag == "br":
            return self._text(" ", 0, 1)
        inline = tag not in BLOCKS
        if not inline:
            self.block += 1
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                return self._pop_to(k)
            if inline and self.stack[k][0] in BLOCKS:
                return

    def judged(self) -> tuple[list[bool], list[int]]:
        """Which nodes are left once declared noise and what is outside the main parts are gone; and each one's main part or -1."""
        n = len(self.parent)
        dead, noisy, holds = [False] * n, [False] * n, [False] * n
        for k in range(1, n):
            dead[k] = dead[self.parent[k]] or bool(self.says[k] & DEAD)
            noisy[k] = noisy[self.parent[k]] or bool(self.says[k] & NOISE)
        found = [k for k in range(1, n) if self.says[k] & MAIN and not dead[k]]
        found = [k for k in found if not noisy[k]] or found
        mains = set(next((own for name in ("article", "main") if (own := [k for k in found if self.tag[k] == name])), found))
        for k in [*mains, *(k for k in range(1, n) if self.says[k] & HOLD and not self.says[k] & NOISE)]:
            at = self.parent[k]
            while at > 0 and not holds[at]:
                holds[at] = True
                at = self.parent[at]
        root, left = [-1] * n, [True] * n
        root[0] = -1 if mains else 0
        for k in range(1, n):
            up = self.parent[k]
            root[k] = root[up] if root[up] >= 0 else k if k in mains else -1
            noise = self.says[k] & NOISE or (self.says[k] & TOP and not (mains and root[k] >= 0))
            left[k] = left[up] and not dead[k] and not (noise and not holds[k])
        return left, root

    def keys(self, host: str, root: list[int]) -> list[int]:
        """Each node's place in the host's style tree, from its main part down."""
        out = [0] * len(self.parent)
        for k in range(len(out)):
            up = self.parent[k]
            if root[k] >= 0:
                above = out[up] if up >= 0 and root[up] >= 0 else None
                out[k] = key_of(host, above, self.label[k] if root[k] != k else "main")
        return out

    def blocks(self, left: list[bool], root: list[int]) -> list[tuple[int, str]]:
        """Node (of the first run) and text of each block of the nodes left, in order."""
        out, block, node, parts = [], -1, 0, []
        for b, k, text in [*self.runs, (-2, 0, "")]:
            if b != block:
                words = " ".join(html.unescape("".join(parts)).split())
                if words:
                    out.append((node, words))
                block, node, parts = b, k, []
            if b >= 0 and left[k] and root[k] >= 0:
                node = k if not parts else node
                parts.append(text)
        return out


def key_of(host: str, above: int | None, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{above}\n{label}".encode("utf-8", "replace")) - (1 << 63)


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class Counts(dict):
    """(key, kind, what) -> how often, and the sum of n ln n over pages."""

    def add(self, key: int, kind: int, what: int, n: int) -> None:
        old = self.get((key, kind, what))
        extra = n * math.log(n)
        self[key, kind, what] = (n, extra) if old is None else (old[0] + n, old[1] + extra)

    def page(self, source: str, host: str) -> None:
        tree = Tree(source)
        left, root = tree.judged()
        keys = tree.keys(host, root)
        children: dict[int, list[str]] = {}
        for k in range(len(left)):
            if left[k] and root[k] >= 0:
                children.setdefault(k, [])
                if root[k] != k:
                    own = children.setdefault(tree.parent[k], [])
                    if not own or own[-1] != tree.label[k]:
                        own.append(tree.label[k])
        own: dict[tuple[int, int, int], int] = {}
        for k, labels in children.items():
            above = keys[tree.parent[k]] if root[k] != k else 0
            own[keys[k], WHOLE, above] = 1
            style = keys[k], PRESENTATION, text_key("\n".join(labels)) if labels else 0
            own[style] = own.get(style, 0) + 1
        for k, text in tree.blocks(left, root):
            what, seen = text_key(text), set()
            while k >= 0 and root[k] >= 0:
                if keys[k] not in seen:
                    seen.add(keys[k])
                    own[keys[k], CONTENT, what] = own.get((keys[k], CONTENT, what), 0) + 1
                k = tree.parent[k]
        for (key, kind, what), n in own.items():
            self.add(key, kind, what, n)

    def batch(self) -> pa.RecordBatch:
        keys = np.array(list(self), np.int64).reshape(-1, 3)
        sums = np.array(list(self.values()), np.float64).reshape(-1, 2)
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int32)), pa.array(keys[:, 2]), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1])], ["key", "kind", "what", "n", "nlogn"])


def style_tree(pages: DataFrame) -> DataFrame:
    """Nodes of the hosts' style trees: key, above (the parent's key), pages, blocks, importance; pages are (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for b in batches:
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                counts.page(source, host)
                if len(counts) >= FLUSH:
                    yield counts.batch()
        yield counts.batch()

    told = pages.filter("host <> '' AND html <> ''").select("host", "html")
    counted = told.mapInArrow(run, "key long, kind int, what long, n long, nlogn double").groupBy("key", "kind", "what").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    log = F.log(F.col("n").cast("double"))
    nodes = counted.groupBy("key").agg(
        of(WHOLE, F.col("n")).alias("pages"),
        F.max(F.when(F.col("kind") == WHOLE, F.col("what"))).alias("above"),
        F.coalesce(of(PRESENTATION, F.when(F.col("what") != 0, 1)), F.lit(0)).alias("styles"),
        of(PRESENTATION, F.col("n")).alias("shown"),
        of(PRESENTATION, F.col("n") * log).alias("shown_log"),
        F.coalesce(of(CONTENT, F.lit(1)), F.lit(0)).alias("texts"),
        F.coalesce(of(CONTENT, F.col("n")), F.lit(0)).alias("blocks"),
        of(CONTENT, log - F.col("nlogn") / F.col("n")).alias("spread"),
    )
    presentation = F.when(F.col("shown") > 1, F.try_divide(F.log("shown") - F.col("shown_log") / F.col("shown"), F.log("shown"))).otherwise(1.0)
    content = F.when(F.col("texts") > 0, 1 - F.try_divide(F.col("spread") / F.col("texts"), F.log("pages"))).otherwise(1.0)
    weight = F.pow(F.lit(DAMPING), F.col("styles"))
    importance = F.when(F.col("pages") > 1, (1 - weight) * presentation + weight * content).otherwise(1.0)
    return nodes.select("key", "above", "pages", "blocks", importance.alias("importance"))


def unimportant(pages: DataFrame) -> DataFrame:
    """Keys of the branches to remove."""
    nodes = materialize(style_tree(pages), "style-tree")
    low = nodes.filter((F.col("above") != 0) & (F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    parent = nodes.select(F.col("key").alias("above"), F.col("pages").alias("of_pages"), F.col("blocks").alias("of_blocks"), F.col("importance").alias("of_importance"))
    minor = (2 * F.col("pages") >= F.col("of_pages")) & (2 * F.col("blocks") <= F.col("of_blocks")) & (F.col("of_importance") >= LEAST_IMPORTANCE)
    return materialize(low.join(parent, "above").filter(minor).select("key"), "unimportant")


def main_text(source: str | None, host: str, removed: set[int] | frozenset[int]) -> str:
    """The text left of a page once declared and unimportant branches are gone."""
    tree = Tree(source or "")
    left, root = tree.judged()
    if removed and host:
        keys = tree.keys(host, root)
        for k in range(1, len(left)):
            left[k] = left[k] and left[tree.parent[k]] and (keys[k] not in removed or tree.tag[k] in HEADINGS)
    return "\n".join(text for _, text in tree.blocks(left, root))


def _extracted(b: pa.RecordBatch, removed: set[int] | frozenset[int]) -> pa.RecordBatch:
    texts = [main_text(source, host, removed) for source, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist())]
    return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, sent_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    removed = unimportant(pages)
    result = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if removed.count() * 64 <= sent_bytes:
        few = pages.sparkSession.sparkContext.broadcast(frozenset(r.key for r in removed.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _extracted(b, few.value)

        return pages.mapInArrow(run, result)

    return _streamed(pages, removed, result)


def _streamed(pages: DataFrame, removed: DataFrame, result: str) -> DataFrame:
    """As extract, for any number of branches: a host's branches come before its pages in each of its salted groups."""

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                tree = Tree(source or "")
                found |= {(host, k) for k in tree.keys(host, tree.judged()[1]) if k}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], ["host", "key"])

    at_host = pages.filter("host <> ''").mapInArrow(own_keys, "host string, key long").distinct().join(removed, "key")
    nothing = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page_id", "url", "html")]
    heads = at_host.select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "key", *nothing)
    tails = pages.select("host", F.pmod(F.xxhash64("url", "page_id", "html"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(None).cast("long").alias("key"), "page_id", "url", "html")
    stream = heads.unionByName(tails).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("key").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys = None, set()
        for b in batches:
            hosts, salts, own = (b.column(c).to_pylist() for c in ("host", "salt", "key"))
            start = 0
            for i, at in enumerate([*zip(hosts, salts), None]):
                if at == group and at is not None:
                    if own[i] is not None:
                        keys.add(own[i])
                        start = i + 1
                    continue
                if i > start:
                    yield _extracted(b.slice(start, i - start), keys)
                if at is not None:
                    group, keys, start = at, {own[i]} - {None}, i + (own[i] is not None)

    return stream.mapInArrow(run, result)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
