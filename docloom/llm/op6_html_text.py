"""HTML extraction: consensus host paths.

Each page is parsed leniently into elements; menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are recognised by tag, role and class words. Words that
article markup uses as well (header, form, share and the like) count only as whole classes; class names that
tell a layout (`has-sidebar`, `no-comments`, `subscribe-page`) say nothing about the element that has them.

A page votes for the generalised path (tags with classes, digits removed) of its container, the deepest element that
holds SHARE of its remaining text outside links. If class words leave next to nothing of a page, its vote is for the container of what they
hide. It also reports the text of each part beside the way to its container, of each class inside it, and of each
element with a doubtful class. Votes and reports are counted per host in Spark, and decide both ways when every page is parsed again:

* The winning path of AGREE pages or more is article text, whatever its class words say.
* A part that has the same text on all of the host's pages that have it, AGREE or more and not all copies of one, is none, whatever its words don't say.
* Parts beside the winning path that are mostly links go; other text stays there unless it is such a part: an article may lie in several containers.

Blocks are what block elements delimit; character references are decoded, white space inside a
block becomes one space, and blocks are joined by a newline in page order.

Null and empty html give the empty text; pages without a host neither vote nor follow votes;
repeated rows are extracted each; of paths with equal votes the one with more text, then the
smaller, wins; markup cut off anywhere is read as far as it goes, and html of any length in time in
proportion to it: elements deeper than DEPTH count as their ancestor there, and once a tag isn't
closed to the end of the page, quoted `>` end tags as well; an empty table gives no rows; extra
columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.runs import trimmed
from docloom.llm.scratch import Scratch, broadcast_if_small

SHARE = 0.85
DEPTH = 512
#: Pages of a host that must agree.
AGREE = 3
#: Share of a page's text that class words must leave; below it they are in doubt.
LEFT = 0.1
_REST = r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|"
_TAG = re.compile(_REST + r"""(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(\Z))|(/?)([a-zA-Z][^\s/>]*)([^<>]*)>)""", re.S)
_SIMPLE_TAG = re.compile(_REST + r"(/?)([a-zA-Z][^\s/>]*)([^<>]*)>)", re.S)
_CUT = re.compile(r"<(?:[/!?]?[a-zA-Z]|[!/?]?\Z)")
_CLASS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_LETTER = re.compile(r"[^\W_]")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("html body div article section main td center".split())
_SKIPPED = frozenset("head nav header footer aside form menu dialog button select datalist audio video canvas".split())
_SKIPPED_WORDS = frozenset("nav navbar navigation menu footer sidebar ad ads advert adverts advertisement sponsor sponsored cookie cookies consent popup modal breadcrumb breadcrumbs comment comments disqus newsletter subscribe signup login pagination pager copyright masthead".split())
#: Words that count as whole classes only; elsewhere the host's pages decide.
_DOUBTFUL_WORDS = frozenset("header aside banner promo notice notices alert overlay related recommended share sharing social respond reply replies search form widget toolbar skip".split())
#: Parts that leave the meaning of a doubtful word as it is.
_PLACE_WORDS = frozenset("site page top bottom left right bar box block area main global wrap wrapper container inner outer post posts list links buttons button contact search email widget notice social share form system".split())
#: Parts that make a class name a statement on the layout, and kinds of pages as its last part.
_STATE_WORDS = frozenset("has have no not with without is enable enabled enables disable disabled show shows hide hides open closed allow allows support supports".split())
_PAGE_WORDS = frozenset("page template layout theme".split())
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_KEPT_TAGS = frozenset(("html", "body", "article", "main"))
#: A start tag ends open elements of these kinds, up to the nearest of the stops.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
_STOPS_P = frozenset("html body div article section main td th li table form aside nav header footer blockquote figure details dialog".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _worded(value: str) -> tuple[bool, bool]:
    """Whether class words make an element no article text, and whether they leave it to the host."""
    doubt = False
    for name in value.split():
        parts = _WORD.findall(name)
        words = set(parts)
        if len(parts) > 1 and (words & _STATE_WORDS or parts[-1] in _PAGE_WORDS):
            continue
        if words & _SKIPPED_WORDS or words & _DOUBTFUL_WORDS and words <= _DOUBTFUL_WORDS | _PLACE_WORDS:
            return True, False
        doubt = doubt or bool(words & _DOUBTFUL_WORDS)
    return False, doubt


#: How an element is left out: not at all, by its class words or those of one around it, by tag, role or attribute.
_STAYS, _BY_WORDS, _GOES = 0, 1, 2


class Page:
    """Elements in page order: parent, tag, generalised label, how they are left out by themselves (own) and with what is around them (state), and whether in a link; those that
    the host's pages decide on; and text chunks: element, block, raw text."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.label, self.link = [-1], ["#"], [""], [False]
        self.own, self.state, self.within = [_STAYS], [_STAYS], [False]
        self.doubtful: list[int] = []
        self.chunks: list[tuple[int, int, str]] = []
        self._parse(html)
        self.skip = [x > 0 for x in self.state]

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        within = self.within[parent]
        heading = tag == "header" and within  # of the article, not of the page
        own, label, doubt = _GOES if tag in _SKIPPED and not heading else _STAYS, tag, heading
        above = self.state[parent]
        if attributes and not attributes.isspace():
            classes: list[str] = []
            for m in _CLASS.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    own = _GOES
                elif name == "role":
                    own = _GOES if value in _SKIPPED_ROLES else own
                elif name != "aria-hidden":
                    if tag not in _KEPT_TAGS and max(own, above) < _GOES:
                        gone, unsure = _worded(value)
                        if gone and heading and "header" in _WORD.findall(value) and _SKIPPED_WORDS.isdisjoint(_WORD.findall(value)):
                            gone, unsure = False, True
                        own, doubt = max(own, _BY_WORDS if gone else _STAYS), doubt or unsure
                    if name == "class":
                        classes += value.split()
            if classes:
                label = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes})])
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(label)
        self.own.append(own)
        self.state.append(max(own, above))
        self.within.append(within or tag in ("article", "main"))
        self.link.append(self.link[parent] or tag == "a")
        if doubt and not self.state[-1]:
            self.doubtful.append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        at, block, stack, tags = 0, 0, [0], self.tag
        opened: Counter[str] = Counter()

        def close(i: int) -> None:
            for k in stack[i:]:
                opened[tags[k]] -= 1
            del stack[i:]

        for_tag, simple = _TAG.search, False
        while m := for_tag(html, at):
            if not simple and m[4] is not None:  # a tag that nothing closes to the end
                for_tag, simple = _SIMPLE_TAG.search, True
                continue
            if m.start() > at:
                self.chunks.append((stack[-1], block, html[at : m.start()]))
            at = m.end()
            ends, tag, attributes = (m[1], m[2], m[3]) if simple or m[2] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if ends:
                if opened[tag] > 0:
                    for i in range(len(stack) - 1, 0, -1):
                        if tags[stack[i]] == tag:
                            close(i)
                            break
                if tag in _BLOCK:
                    block += 1
                continue
            if tag == "br":
                self.chunks.append((stack[-1], block, " "))
                continue
            if tag in _BLOCK:
                block += 1
                if tag in _ENDS:
                    kinds, stops = _ENDS[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if tags[stack[i]] in stops:
                            break
                        if tags[stack[i]] in kinds:
                            close(i)
                            break
                else:
                    for i in range(len(stack) - 1, 0, -1):
                        t = tags[stack[i]]
                        if t == "p" or t in _HEADINGS and tag in _HEADINGS:
                            close(i)
                            break
                        if t in _STOPS_P:
                            break
            attributes = attributes or ""
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = _RAW[tag].search(html, at)
                at = end.end() if end else len(html)
                continue
            node = self._open(stack[-1], tag, attributes)
            if (not attributes.endswith("/") or tag in _BLOCK) and len(stack) < DEPTH:
                stack.append(node)
                opened[tag] += 1
        if at < len(html):
            rest = html[at:]
            cut = _CUT.search(rest, rest.rfind(">") + 1)  # a tag that the end cuts off
            rest = rest[: cut.start()] if cut else rest
            if rest:
                self.chunks.append((stack[-1], block, rest))

    def sizes(self, most: int = _STAYS, links: bool = False) -> list[int]:
        """Characters of counted text in each element that isn't left out by more than `most`; text in links and marks between them don't count, or with `links` text in links alone."""
        size = [0] * len(self.tag)
        for node, _, text in self.chunks:
            if self.state[node] <= most and self.link[node] == links and _LETTER.search(unescape(text) if "&" in text else text):
                size[node] += len(text.strip())
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    def container(self, size: list[int], share: float = SHARE) -> int:
        """The deepest container with this share of the text; 0, the whole page, if there is none."""
        least, best = share * size[0], 0
        if size[0]:
            for i, n in enumerate(size):
                if n >= least and self.tag[i] in _CONTAINERS:
                    best = i
        return best

    def vote(self) -> tuple[int, int]:
        """The element that the page votes for, and its counted text."""
        size, all_ = self.sizes(), self.sizes(_BY_WORDS)
        if size[0] < LEFT * all_[0]:
            size = all_
        node = self.container(size)
        return node, size[node]

    def parts(self, container: int) -> dict[str, list[int]]:
        """Elements that the host's pages judge, by path: beside the way to the container, children of it that have a class, and doubtful ones."""
        way, node = set(), container
        while node >= 0:
            way.add(node)
            node = self.parent[node]
        found: dict[str, list[int]] = {}
        doubtful = set(self.doubtful)
        for i in range(1, len(self.tag)):
            if i in way or self.skip[i]:
                continue
            if i in doubtful or self.parent[i] in way and (self.parent[i] != container or "." in self.label[i]):
                found.setdefault(self.path(i), []).append(i)
        return found

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(labels))

    def drop(self, paths: Sequence[int]) -> None:
        """Leave out the elements whose path has one of these hashes."""
        if paths:
            hashes, gone = [0] * len(self.tag), set(paths)
            for i in range(1, len(self.tag)):
                hashes[i] = step(hashes[self.parent[i]], self.label[i])
                self.skip[i] = self.skip[i] or hashes[i] in gone or self.skip[self.parent[i]]

    def keep(self, path: str) -> None:
        """The elements on this path and around it aren't left out by their class words; those inside are by theirs."""
        hashes, on, h = [0] * len(self.tag), set(), 0
        for label in path.split("/"):
            h = step(h, label)
            on.add(h)
        for i in range(1, len(self.tag)):
            hashes[i] = step(hashes[self.parent[i]], self.label[i])
            own = _STAYS if self.own[i] == _BY_WORDS and hashes[i] in on else self.own[i]
            self.state[i] = max(own, self.state[self.parent[i]])
            self.skip[i] = self.state[i] > 0

    def links_beside(self, nodes: Sequence[int]) -> None:
        """Leave out the largest elements outside of these, and not around them, that are mostly links."""
        near = set(nodes)
        for n in nodes:
            while n >= 0:
                near.add(n)
                n = self.parent[n]
        inside, text, links = set(nodes), self.sizes(), self.sizes(links=True)
        for i in range(1, len(self.tag)):
            if self.parent[i] in inside:
                inside.add(i)
            elif i not in near:
                self.skip[i] = self.skip[i] or self.skip[self.parent[i]] or links[i] > text[i]

    def on_path(self, path: int) -> list[int]:
        """Elements whose path has this hash, outermost first."""
        hashes = [0] * len(self.tag)
        found = []
        for i in range(1, len(self.tag)):
            hashes[i] = step(hashes[self.parent[i]], self.label[i])
            if hashes[i] == path:
                found.append(i)
        return found

    def text(self, nodes: list[int]) -> str:
        """Blocks of the text inside any of the elements."""
        inside = [False] * len(self.tag)
        for n in nodes:
            inside[n] = True
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        blocks: list[list[str]] = []
        last = None
        for node, block, text in self.chunks:
            if inside[node] and not self.skip[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def step(above: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, above) or 1


def path_hash(path: str) -> int:
    h = 0
    for label in path.split("/"):
        h = step(h, label)
    return h


def extract(html: str, winning: str | None = None, dropped: Sequence[int] = ()) -> str:
    """The main text of one page, given its host's winning path and the hashes of its paths that hold no article text."""
    page = Page(html)
    if winning:
        page.keep(winning)
    page.drop(dropped)
    nodes = page.on_path(path_hash(winning)) if winning else []
    if nodes:
        page.links_beside(nodes)
    for i, gone in enumerate(page.skip):
        page.state[i] = max(page.state[i], _GOES) if gone else page.state[i]
    size = page.sizes()
    if nodes and sum(size[n] for n in nodes) == size[0]:
        return page.text(nodes)
    return page.text([page.container(size, 1)])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> a row for the page's container (no text) and one for each path of its parts (with their text's hash)."""
    for b in batches:
        rows: list[tuple] = []
        for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if html:
                page = Page(html)
                node, chars = page.vote()
                if node:
                    rows.append((host, page.path(node), chars, None, None, None))
                parts = page.parts(node)
                whole = xxhash.xxh64_intdigest(page.text([0])) >> 1 if parts else 0
                for path, nodes in parts.items():
                    if text := page.text(nodes):
                        rows.append((host, path, 0, path_hash(path) - (1 << 63), xxhash.xxh64_intdigest(text) >> 1, whole))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "chars", "part", "text", "whole"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(html, path, {x + (1 << 63) for x in dropped or ()}) if html else "" for html, path, dropped in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.lower(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path, pages that voted for it, and dropped: hashes of the paths of parts with one text on AGREE pages or more. Votes are summed before they move, so a host of any size is a few rows a task."""
    named = pages.select(_host(F.col("url")).alias("host"), "html").where("host <> ''")
    votes = Scratch(pages.sparkSession).keep(named.mapInArrow(trimmed(_votes), "host string, path string, chars long, part long, text long, whole long").groupBy("host", "path", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("text").alias("low"), F.max("text").alias("high"), (F.min("whole") != F.max("whole")).alias("differ")))
    by = votes.where("part IS NULL").groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path")).alias("w"))
    same = votes.where(F.col("part").isNotNull() & (F.col("n") >= AGREE) & (F.col("low") == F.col("high")) & F.col("differ")).groupBy("host").agg(F.sort_array(F.collect_set("part")).alias("dropped"))
    return by.join(same, "host", "full").select("host", F.col("w.path").alias("path"), (-F.col("w.n")).alias("votes"), "dropped")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; pages: page_id, url, html."""
    winners = Scratch(pages.sparkSession).keep(winning_paths(pages))
    held = broadcast_if_small(winners.select(F.col("host").alias("_host"), F.when(F.col("votes") >= AGREE, F.col("path")).alias("path"), "dropped"), 100_000)
    rows = pages.select("page_id", "url", "html").join(held, _host(F.col("url")) == F.col("_host"), "left").select("page_id", "url", "html", "path", "dropped")
    return rows.mapInArrow(trimmed(_texts), "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = None
