"""Main-text extraction by wrapper induction.

1. Each page becomes a tree of its blocks (inline markup is transparent; runs of
   equal siblings, such as paragraphs, are one repeated node) and a skeleton, the
   tree's shape with tags and classes. What the markup itself declares to be
   something else (``nav``, ``aside``, ``form``, class ``comments``, ...) is left out,
   but never ``html``, ``body`` or what holds the page's only marked article. A class
   that only has such a word in it (``has-sidebar``) is left to the slots.
2. The skeletons of a host are aligned by simple tree matching into one template:
   equal positions of all pages become one slot.
3. A slot that hardly varies over pages that do vary is template; slots that vary
   are content. The variety comes from mergeable distinct-count sketches over all
   pages of the host, so a large host is no large task, and copies of one page
   count once.
4. A page's text is its content blocks in page order. Where the page marks its
   article (``article``, ``main``, ...), only blocks inside it count. The slots
   decide in there too; as repeated siblings share a slot, each text of theirs is
   tested as well, and one that stands on ``REPEATED_SHARE`` of the host's pages is
   template. On hosts of fewer than ``LEAST_PAGES`` pages the markup alone decides.

Nulls and ties: a NULL or empty html has the text "". A NULL url, or one without a
host, belongs to the host "". Repeated rows are extracted once each. Markup that
nothing closes ends with its parent; an open script, style or comment swallows the
rest of the page. Unknown character references stay as they are. Pages are read
whole, however long. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledger_spark.llm.common import may_contain, slices, written

#: Distinct pages from which a slot can be called constant, and the share of
#: distinct texts up to which it is.
LEAST_PAGES = 5
CONSTANT_SHARE = 0.05
#: Share of a host's distinct pages from which a text inside the article is template.
REPEATED_SHARE = 0.5
#: Children of a node that are kept apart although tag and class repeat;
#: paragraphs, items and the like always are one repeated node.
SEPARATE = 24
#: Nodes below this depth belong to their ancestor at it; elements open beyond the
#: second number are transparent (browsers end at 512 as well).
TREE_DEPTH, OPEN_ELEMENTS = 48, 512
#: Where no article is marked, blocks with more of their text in links are menus.
LINK_SHARE = 0.8

#: HTML elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul caption head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog fieldset footer form head header iframe input label legend map math menu nav "
    "noscript object option output progress script select style svg template textarea title video audio".split())
PLAIN = frozenset("blockquote dd dl dt h1 h2 h3 h4 h5 h6 li ol p pre table tbody td th thead tr ul".split())
CLOSES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
          "th": ("table",)}
#: Words of class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "sidebar side aside widget widgets related recommended footer foot masthead header topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay dialog newsletter subscribe subscription "
    "paywall signup login search share sharing social comment comments commentlist reply replies respond disqus discussion "
    "contentinfo complementary".split())
#: Words for the box that such a part stands in; a class, id or role
#: is one of these parts if it has such words only, and at least one of the above.
BOX_WORDS = frozenset("area bar block box button buttons container content form inner item items link links list outer "
                      "panel primary secondary section site wrap wrapper".split())
#: Of these, a heading block inside an article is not one.
HEADING_WORDS = frozenset("header masthead".split())
#: Class, id, role and itemprop words that mark the article.
ARTICLE_MARKS = frozenset("articlebody article-body article-content article-text entry-content post-content post-body "
                          "story-body main-content main".split())

#: A quoted value may hold "<" only if it is short: what nothing closes ends at the
#: next "<", so that reading a page takes time in proportion to its length.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"(?:[^\"<]*|[^\"]{0,300})\"|"
                  r"'(?:[^'<]*|[^']{0,300})')*+)>|<[!?][^<>]*>", re.S)
_ATTR = re.compile(r"([^\s=\"'/<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/<>]+)")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, _html.unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")))
    return out


class _Kinds:
    """What a start tag means; remembered, since sites repeat their tags."""

    def __init__(self):
        self.known: dict[tuple[str, str], tuple] = {}

    def of(self, tag: str, attributes: str) -> tuple[bool, bool, bool, str]:
        """(left out, heading only, marks the article, label)."""
        key = (tag, attributes)
        if key in self.known:
            return self.known[key]
        a = _attributes(attributes) if attributes.strip(" /") else {}
        marks = " ".join(a.get(k, "") for k in ("class", "id", "role"))
        tokens = {t.lower() for t in f"{marks} {a.get('itemprop', '')}".split()}
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
        article = tag in ("article", "main") or bool(tokens & ARTICLE_MARKS)
        aside: set[str] = set()
        for token in [] if article else marks.split():
            words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
            if words <= ASIDE_WORDS | BOX_WORDS:
                aside |= words & ASIDE_WORDS
        out = tag in LEFT_OUT or bool(hidden) or bool(aside)
        heading = out and not hidden and (tag == "header" or tag not in LEFT_OUT) and not (aside - HEADING_WORDS)
        names = ".".join(re.sub(r"\d+", "", t) for t in a.get("class", "").lower().split())
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[key] = (out, heading, article, f"{tag}.{names}" if names else tag)
        return self.known[key]


class Page:
    """Block tree of a page. Nodes are numbered in page order; node 0 is the root."""

    def __init__(self, source: str | None, kinds: _Kinds):
        self.labels, self.parents, self.children = ["page"], [-1], [[]]
        self.inside, self.hashes, self.depths = [False], [0], [0]
        self.blocks: list[tuple[int, str, float]] = []  # (node, text, share in links)
        if source and self._read(source, kinds) and not self.marked():
            self.__init__(None, kinds)
            self._read(source, kinds, rescue=True)

    def _child(self, parent: int, label: str, tag: str, inside: bool) -> int:
        if self.depths[parent] >= TREE_DEPTH:
            return parent
        last = self.children[parent][-1] if self.children[parent] else -1
        if last >= 0 and self.labels[last] == label and self.inside[last] == inside and (
                tag in PLAIN or len(self.children[parent]) >= SEPARATE):
            return last
        node = len(self.labels)
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(node)
        self.inside.append(inside)
        self.hashes.append(0)
        self.depths.append(self.depths[parent] + 1)
        return node

    def _read(self, source: str, kinds: _Kinds, rescue: bool = False) -> bool:
        """Fill the tree. Returns whether an article stands inside something left
        out; ``rescue`` takes it all the same."""
        lost = False
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # (tag, node, left out)
        text: list[str] = []
        linked = size = links = at = 0

        def flush() -> None:
            nonlocal text, linked, size
            if text:
                block = " ".join(_html.unescape("".join(text)).split())
                if block:
                    node = stack[-1][1]
                    self.blocks.append((node, block, linked / max(1, size)))
                    h = xxhash.xxh64_intdigest(block)
                    while node >= 0:
                        self.hashes[node] = (self.hashes[node] * 1099511628211 + h) & 0xFFFFFFFFFFFFFFFF
                        node = self.parents[node]
                text, linked, size = [], 0, 0

        def take(piece: str) -> None:
            nonlocal linked, size
            if piece and not stack[-1][2]:
                text.append(piece)
                size += len(piece.strip())
                if links:
                    linked += len(piece.strip())

        while True:
            m = _TAG.search(source, at)
            if m is None:
                take(source[at:])
                break
            take(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:  # an end tag closes the nearest element of its name
                if tag == "a":
                    links = max(0, links - 1)
                depth = len(stack) - 1
                while depth and stack[depth][0] != tag:
                    depth -= 1
                if depth:
                    flush()
                    del stack[depth:]
                elif tag in BLOCKS:
                    flush()
                continue
            if tag == "br":
                take(" ")
                continue
            attributes = m[3] or ""
            out, heading, article, label = kinds.of(tag, attributes)
            node, left_out = stack[-1][1], stack[-1][2]
            out = out and not (heading and self.inside[node]) and tag not in ("html", "body")
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                if tag in BLOCKS:
                    flush()
                continue
            if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS):
                if tag == "hr":
                    flush()
                continue
            if tag not in BLOCKS and not out and not article:
                if tag == "a":
                    links += 1
                continue
            flush()
            if tag in BLOCKS:
                self._close_implied(stack, tag)
                node, left_out = stack[-1][1], stack[-1][2]
                links = 0
            if article and left_out and not out:
                lost, left_out = True, not rescue
            if not (out or left_out) and tag not in ("html", "body"):
                node = self._child(node, label, tag, self.inside[node] or article)
            if len(stack) < OPEN_ELEMENTS:
                stack.append((tag, node, out or left_out))
        flush()
        return lost

    @staticmethod
    def _close_implied(stack: list, tag: str) -> None:
        """A block ends an open paragraph; an item ends the item before it."""
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth][0]
            if name == "p":
                del stack[depth:]
                break
            if name in ("table", "td", "th", "div", "section", "article", "body", "li", "blockquote", "button"):
                break
        if tag in CLOSES:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else \
                ("tr", "td", "th") if tag == "tr" else (tag,)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in CLOSES[tag]:
                    break
                if stack[depth][0] in same:
                    del stack[depth:]
                    if tag != "tr":
                        break

    def skeleton(self) -> str:
        def write(node: int) -> str:
            inner = "".join(write(c) for c in self.children[node])
            return f"{self.labels[node]}({inner})"

        return write(0)

    def marked(self) -> bool:
        """Does the page mark its article?"""
        return any(self.inside[n] for n, _, _ in self.blocks)

    def content(self) -> list[dict]:
        """Blocks that may be the article: (node, text)."""
        marked = self.marked()
        return [{"node": n, "text": t} for n, t, share in self.blocks
                if (self.inside[n] if marked else share <= LINK_SHARE)]


class Template:
    """Union of the aligned skeletons of a host."""

    def __init__(self):
        self.labels: list[str] = []
        self.children: list[list[int]] = []

    def merge(self, tree: tuple[str, list]) -> list[int]:
        """Align ``tree`` with the template, grow the template by what is new, and
        return the slot of each node in page order."""
        if not self.labels:
            self.labels.append(tree[0])
            self.children.append([])
        self._scores: dict = {}
        out: list[int] = []
        self._place(0, tree, out)
        return out

    def _score(self, slot: int, tree: tuple[str, list]) -> int:
        """Simple tree matching: the most node pairs that keep labels, ancestry and order."""
        if self.labels[slot] != tree[0]:
            return 0
        key = (slot, id(tree))
        if key not in self._scores:
            self._scores[key] = 1 + self._table(slot, tree)[-1][-1]
        return self._scores[key]

    def _table(self, slot: int, tree: tuple[str, list]) -> list[list[int]]:
        mine, theirs = self.children[slot], tree[1]
        best = [[0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
        for i, a in enumerate(mine, 1):
            for j, b in enumerate(theirs, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + self._score(a, b))
        return best

    def _place(self, slot: int, tree: tuple[str, list], out: list[int]) -> None:
        out.append(slot)
        best, mine, theirs = self._table(slot, tree), list(self.children[slot]), tree[1]
        i, j, pairs = len(mine), len(theirs), {}
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs[j] = mine[i]
        at = 0
        for j, child in enumerate(theirs):
            if j in pairs:
                at = self.children[slot].index(pairs[j]) + 1
                self._place(pairs[j], child, out)
            else:
                new = len(self.labels)
                self.labels.append(child[0])
                self.children.append([])
                self.children[slot].insert(at, new)
                at += 1
                self._place(new, child, out)


def read_skeleton(text: str) -> tuple[str, list]:
    """The (label, children) tree that a skeleton writes down."""
    root: tuple[str, list] = ("", [])
    stack = [root]
    for m in re.finditer(r"([^()]*)\(|\)", text):
        if m[0] == ")":
            stack.pop()
        else:
            node: tuple[str, list] = (m[1], [])
            stack[-1][1].append(node)
            stack.append(node)
    return root[1][0]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, skeleton, hashes, marked, blocks) per row of ``pages``."""
    block = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds()
        for part in slices(batches, 128):
            found = [Page(h, kinds) for h in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([p.skeleton() for p in found], pa.string()),
                 pa.array([[h - (1 << 64) if h >> 63 else h for h in p.hashes] for p in found], pa.list_(pa.int64())),
                 pa.array([p.marked() for p in found], pa.bool_()), pa.array([p.content() for p in found], block)],
                ["page_id", "url", "host", "skeleton", "hashes", "marked", "blocks"])

    rows = pages.select("page_id", "url", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"),
                        "html")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, host string, skeleton string, "
                                "hashes array<long>, marked boolean, blocks array<struct<node:int,text:string>>")


def constant_nodes(pages: DataFrame) -> DataFrame:
    """(host, skeleton, constant): the nodes of a skeleton that are template, from
    the ``parsed`` pages."""
    shapes = pages.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("pages"))

    def induce(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["pages"], r["skeleton"]))
        template, out = Template(), []
        for r in rows:
            out += [(r["host"], r["skeleton"], n, s) for n, s in enumerate(template.merge(read_skeleton(r["skeleton"])))]
        cols = list(zip(*out))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))],
                        ["host", "skeleton", "node", "slot"])

    slots = written(shapes.groupBy("host").applyInArrow(induce, "host string, skeleton string, node int, slot int"),
                    "html-slots")
    nodes = (pages.select("host", "skeleton", F.get("hashes", F.lit(0)).alias("page"), F.posexplode("hashes").alias("node", "hash"))
             .filter("node > 0 AND hash <> 0"))
    variety = written(nodes.groupBy("host", "skeleton", "node").agg(
        F.hll_sketch_agg("hash").alias("texts"), F.hll_sketch_agg("page").alias("pages")), "html-variety")
    by_slot = (variety.join(slots, ["host", "skeleton", "node"]).groupBy("host", "slot").agg(
        F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("texts"),
        F.hll_sketch_estimate(F.hll_union_agg("pages")).alias("pages")))
    constant = by_slot.filter((F.col("pages") >= LEAST_PAGES)
                              & (F.col("texts") <= F.greatest(F.lit(1), F.col("pages") * CONSTANT_SHARE)))
    return written(slots.join(constant.select("host", "slot"), ["host", "slot"])
                   .groupBy("host", "skeleton").agg(F.collect_list("node").alias("constant")), "html-constant")


def repeated_texts(pages: DataFrame) -> DataFrame:
    """(host, repeated): hashes of the texts that stand inside the articles of
    ``REPEATED_SHARE`` of the host's distinct pages, from the ``parsed`` pages. A
    host has no more of them than its articles have blocks, over that share."""
    marked = pages.filter("marked").select("host", F.get("hashes", F.lit(0)).alias("page"), "blocks")
    texts = marked.select("host", "page", F.explode(F.array_distinct(
        F.transform("blocks", lambda b: F.xxhash64(b["text"])))).alias("hash")).withColumn("key", F.xxhash64("host", "hash"))
    # most texts stand on few pages, whether these are copies or not
    often = written(texts.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= LEAST_PAGES).select("key"),
                    "html-often")
    on = (texts.filter(may_contain(often, "key", F.col("key"))).select("host", "hash", "page").distinct()
          .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("on")))
    sizes = marked.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return (on.join(sizes, "host").filter((F.col("on") >= LEAST_PAGES) & (F.col("on") >= F.col("of") * REPEATED_SHARE))
            .groupBy("host").agg(F.collect_list("hash").alias("repeated")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (needs page_id, url, html)."""
    rows = written(parsed(pages), "html-parsed")
    shapes = rows.select("host", "skeleton").distinct()
    template = written(shapes.join(constant_nodes(rows), ["host", "skeleton"], "left").join(repeated_texts(rows), "host", "left")
                       .filter("constant IS NOT NULL OR repeated IS NOT NULL")
                       .withColumnsRenamed({"host": "__host", "skeleton": "__skeleton"}), "html-template")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("constant", b["node"]), F.lit(False))
                    & ~F.coalesce(F.col("marked") & F.array_contains("repeated", F.xxhash64(b["text"])), F.lit(False)))
    return (rows.join(template, (F.col("host") == F.col("__host")) & (F.col("skeleton") == F.col("__skeleton")), "left")
            .select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text")))
