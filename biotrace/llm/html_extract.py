"""Main text of web pages by consensus of the pages of a host.

First pass: every page scores its containers (block text not in links, per generalised path
of tags and classes from the root) and proposes its best one. Spark counts the proposals of
each host and keeps the paths that win at least SHARE of the leader's votes. Second pass: a
page's text is taken from its outermost containers on a winning path; a page without one
uses its own best container, and a page without containers its body.

Parts that hold no article text are left out in both passes: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. Elements say so by
their name, or by a whole word of their class, id or role (``sidebar``, ``site-header``, but
not ``has-sidebar`` or ``related-work``). A word of the layout alone does not settle it: a
part with an article or main element inside stays, and so does one that holds most of the
text on nearly all pages of its host, by the votes of the first pass.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotrace.llm.common import materialize

# Paths of a host that take part have at least this share of the votes of the first, and at
# most so many are kept; a page on none of them falls back to its own best container.
SHARE = 0.2
PATHS = 20
# A part marked by its layout stays where it holds most of the text on this share of pages.
MOSTLY = 0.8
# Hosts whose paths may be sent to every task (about 200 bytes each).
BROADCAST_HOSTS = 100_000

# Elements of the HTML standard by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SKIPPED = frozenset(
    "nav header footer aside form button select dialog menu template svg canvas object audio video "
    "script style textarea title noscript iframe xmp noembed noframes head".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 "
    "h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Words of a class, id or role that mark a part outside the article, whatever it holds ...
STRICT = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent notice alert popup modal ad ads "
    "advert adverts advertisement sponsor sponsored promo promotion newsletter subscribe subscription signup "
    "login search form comment comments respond reply replies discussion disqus pagination pager toolbar "
    "share sharing social dialog contentinfo".split()
)
# ... and those that mark a place in the layout.
LAYOUT = frozenset(
    "header masthead banner footer sidebar side aside widget widgets related recommended overlay "
    "complementary".split()
)
# Words that stand beside them in a name such as ``site-header`` or ``comment-list``.
BESIDE = frozenset(
    "site page main top bottom left right post posts article articles list item items links link box block area "
    "wrapper wrap container inner outer section bar row col column group unit slot button buttons icons text title "
    "primary secondary global mobile desktop sticky fixed js the my x".split()
)

_NAME_AT = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_FREE, _SKIP, _CONTAINER, _PART = range(4)


@dataclass
class Span:
    """A container, or a part outside the article: the blocks [first, end) of a page."""

    path: int
    parent: int
    first: int
    end: int = 0
    strict: bool = False
    article: bool = False


@dataclass
class Page:
    """Blocks of text in page order, with their worth and innermost container."""

    blocks: list[str] = field(default_factory=list)
    worth: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    containers: list[Span] = field(default_factory=list)
    parts: list[Span] = field(default_factory=list)


def _marks(attributes: str) -> tuple[str, int]:
    """Generalised class of an element; 2 if it is strictly outside the article, 1 by layout."""
    name, outside = "", 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        tokens = "".join(values).lower().split()
        words = [_WORDS.findall(token) for token in tokens]
        for parts in words:
            if not all(w in STRICT or w in LAYOUT or w in BESIDE for w in parts):
                continue
            if any(w in STRICT for w in parts):
                outside = 2
            elif any(w in LAYOUT for w in parts):
                outside = max(outside, 1)
        if kind.lower() == "class" and any(words):
            name = "." + "-".join(w for parts in words for w in parts)
    return name, outside


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends that goes on at `at`; -1 if it never does.

    A quote opens a value only after an equals sign. An open quote takes the rest of the
    page, as in a browser, so that no part of the page is searched twice.
    """
    while True:
        found = _QUOTE_OR_END.search(page, at)
        if not found:
            return -1
        place = found.start()
        if page[place] == ">":
            return place
        if page[at:place].rstrip().endswith("="):
            close = page.find(page[place], place + 1)
            if close < 0:
                return -1
            at = close + 1
        else:
            at = place + 1


class _Parser:
    """One pass over a page; every step is constant or paid for by what it takes off the stack."""

    def __init__(self, page: str):
        self.page, self.out = page, Page()
        self.stack: list[tuple[str, int, int, int]] = []
        self.open: dict[str, list[int]] = {}
        self.inside: list[int] = []
        self.around: list[int] = []
        self.text: list[str] = []
        self.linked = self.skipped = 0

    def flush(self) -> None:
        joined = " ".join(html.unescape("".join(self.text)).split())
        self.text.clear()
        if joined:
            out = self.out
            out.blocks.append(joined)
            out.worth.append(len(joined) - 2 * self.linked)
            out.owner.append(self.inside[-1] if self.inside else -1)
        self.linked = 0

    def add(self, piece: str) -> None:
        if piece and not self.skipped:
            self.text.append(piece)
            if self.open.get("a"):
                self.linked += len(piece)

    def close(self, to: int) -> None:
        end = len(self.out.blocks)
        while len(self.stack) > to:
            tag, _, kind, index = self.stack.pop()
            self.open[tag].pop()
            if kind == _SKIP:
                self.skipped -= 1
            elif kind == _CONTAINER:
                self.out.containers[index].end = end
                self.inside.pop()
            elif kind == _PART:
                self.out.parts[index].end = end
                self.around.pop()

    def last(self, tag: str) -> int:
        places = self.open.get(tag)
        return places[-1] if places else -1

    def end_tag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        place = self.last(tag)
        if place >= 0:
            self.close(place)

    def start_tag(self, tag: str, attributes: str) -> None:
        out = self.out
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P and self.last("p") > max(self.last("td"), self.last("th"), self.last("caption")):
                self.close(self.last("p"))
            if tag in ITEMS:
                alike = ("dd", "dt") if tag in ("dd", "dt") else (tag,)
                place = max(self.last(t) for t in alike)
                if place > max(self.last(t) for t in ITEMS[tag]):
                    self.close(place)
        elif tag == "br":
            self.text.append("\n")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        name, outside = _marks(attributes) if attributes else ("", 0)
        above = self.stack[-1][1] if self.stack else 0
        path = _below(above, f"{tag}{name}")
        kind = index = 0
        if tag in SKIPPED:
            self.flush()
            kind = _SKIP
            self.skipped += 1
        elif not self.skipped:
            if tag in ("article", "main"):
                if outside == 1:
                    outside = 0
                if not outside and self.around:
                    out.parts[self.around[-1]].article = True
            if outside and tag not in ("html", "body"):
                self.flush()
                kind, index = _PART, len(out.parts)
                around = self.around[-1] if self.around else -1
                out.parts.append(Span(path, around, len(out.blocks), strict=outside == 2))
                self.around.append(index)
            elif tag in CONTAINERS:
                kind, index = _CONTAINER, len(out.containers)
                out.containers.append(Span(path, self.inside[-1] if self.inside else -1, len(out.blocks)))
                self.inside.append(index)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path, kind, index))

    def parse(self) -> Page:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            found = page.find("<", at)
            if found < 0:
                self.add(page[at:])
                break
            self.add(page[at:found])
            if page.startswith("<!--", found):
                end = page.find("-->", found + 2)
                if end < 0:
                    break
                at = end + 3
                continue
            if page[found + 1 : found + 2] in ("!", "?"):
                end = page.find(">", found)
                if end < 0:
                    break
                at = end + 1
                continue
            ends = page.startswith("/", found + 1)
            name = _NAME_AT.match(page, found + 1 + ends)
            if not name:
                self.add("<")
                at = found + 1
                continue
            end = _tag_end(page, name.end())
            if end < 0:
                break
            tag, at = name[0].lower(), end + 1
            if ends:
                self.end_tag(tag)
                continue
            self.start_tag(tag, page[name.end() : end])
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = close.start() if close else n
        self.flush()
        self.close(0)
        # An article makes every part around it one that holds an article.
        for part in reversed(self.out.parts):
            if part.article and part.parent >= 0:
                self.out.parts[part.parent].article = True
        return self.out


def _below(path: int, name: str) -> int:
    """The path of a child: 63 bits, from both halves of which the next one follows."""
    data = f"{path}/{name}".encode()
    return (zlib.crc32(data) << 31) ^ zlib.crc32(data[::-1], 0x9E3779B9)


def parse(page: str) -> Page:
    """Blocks, containers and outer parts of a page.

    A page that is cut off keeps what it has; unclosed elements end with their parent, an
    end tag without a start is passed over, and a tag that never ends takes the rest. Work
    is linear in the page.
    """
    return _Parser(page).parse()


def _outside(page: Page, spans: Iterable[Span]) -> np.ndarray:
    """Whether each block is in none of the spans."""
    edges = np.zeros(len(page.blocks) + 1, np.int64)
    for span in spans:
        edges[span.first] += 1
        edges[span.end] -= 1
    return np.cumsum(edges)[:-1] == 0


def mostly(page: Page) -> dict[int, bool]:
    """Paths of parts marked by layout, and whether such a part holds most of the text.

    Text of parts that go in any case does not count.
    """
    free = _outside(page, (p for p in page.parts if p.strict))
    lengths = np.array([len(b) for b in page.blocks], np.int64) * free
    sizes, found = np.concatenate([[0], np.cumsum(lengths)]), {}
    for part in page.parts:
        if not part.strict and not part.article:
            most = bool(2 * (sizes[part.end] - sizes[part.first]) > sizes[-1])
            found[part.path] = found.get(part.path, False) or most
    return found


def kept_blocks(page: Page, staying: set[int]) -> np.ndarray:
    """Whether each block is outside all parts that go; `staying` are paths that do not."""
    gone = (p for p in page.parts if p.strict or not (p.article or p.path in staying))
    return _outside(page, gone)


def best_of(page: Page, kept: np.ndarray) -> int:
    """The container with the highest score, the first of equals; -1 where none has a block.

    A block counts for its innermost container, and for a falling share for two around it.
    """
    scores: dict[int, float] = {}
    for block in np.flatnonzero(kept).tolist():
        at = page.owner[block]
        for share in (1, 2, 6):
            if at < 0:
                break
            scores[at] = scores.get(at, 0.0) + page.worth[block] / share
            at = page.containers[at].parent
    return max(sorted(scores), key=scores.__getitem__) if scores else -1


def extract(page: str, winners: list[int], staying: list[int] = ()) -> str:
    """Text of a page from its outermost containers on a winning path."""
    parsed = parse(page)
    kept = kept_blocks(parsed, set(staying))
    wanted, inside = set(winners), []
    edges = np.zeros(len(parsed.blocks) + 1, np.int64)
    for container in parsed.containers:
        outer = container.parent >= 0 and inside[container.parent]
        mine = container.path in wanted and bool(kept[container.first : container.end].any())
        inside.append(outer or mine)
        if mine and not outer:
            edges[container.first] += 1
            edges[container.end] -= 1
    chosen = np.cumsum(edges)[:-1] > 0
    if not any(inside):
        best = best_of(parsed, kept)
        chosen[:] = best < 0
        if best >= 0:
            chosen[parsed.containers[best].first : parsed.containers[best].end] = True
    return "\n".join(parsed.blocks[b] for b in np.flatnonzero(chosen & kept).tolist())


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of a page: its best container (vote 0), and layout parts (1, or 2 with most of the text)."""
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse(text or "")
            most = mostly(page)
            best = best_of(page, kept_blocks(page, {path for path, yes in most.items() if yes}))
            found = [(path, 1 + yes) for path, yes in most.items()]
            if best >= 0:
                found.append((page.containers[best].path, 0))
            hosts += [host] * len(found)
            paths += [path for path, _ in found]
            votes += [vote for _, vote in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(votes, pa.int32())],
            ["host", "path", "vote"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [batch.column(c).to_pylist() for c in ("html", "paths", "staying")]
        texts = [extract(page or "", win or [], stay or []) for page, win, stay in zip(*each, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            ["page_id", "url", "text"],
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, staying) from rows (host, html)."""
    votes = (
        pages.mapInArrow(_propose, "host string, path long, vote int")
        .groupBy("host", "path")
        .agg(*[F.count(F.when(F.col("vote") == v, 1)).alias(f"v{v}") for v in range(3)])
    )
    by_host = Window.partitionBy("host")
    ranked = (
        votes.withColumn("most", F.max("v0").over(by_host))
        .withColumn("rank", F.row_number().over(by_host.orderBy(F.desc("v0"), "path")))
        .withColumn("staying_rank", F.row_number().over(by_host.orderBy(F.desc("v2"), "path")))
    )
    wins = (F.col("rank") <= PATHS) & (F.col("v0") > 0) & (F.col("v0") >= SHARE * F.col("most"))
    stays = (F.col("staying_rank") <= PATHS) & (F.col("v2") > 0)
    stays &= F.col("v2") >= MOSTLY * (F.col("v1") + F.col("v2"))
    return ranked.groupBy("host").agg(
        F.collect_list(F.when(wins, F.col("path"))).alias("paths"),
        F.collect_list(F.when(stays, F.col("path"))).alias("staying"),
    )


def hot_hosts(pages: DataFrame) -> DataFrame:
    """(host, parts) of hosts with more pages than a shuffle partition should hold.

    There are fewer of them than partitions, so that they may be broadcast.
    """
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.ceil(F.col("count") * partitions / max(1, pages.count()))
    counts = pages.groupBy("host").count().select("host", share.cast("int").alias("parts"))
    return F.broadcast(counts.where("parts > 1"))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text) of every page; text is empty where a page has none.

    Null html counts as empty; pages without a host vote together. Every row stands for
    itself, so rows repeated under one id all appear. Ties between paths go to the first in
    order. An empty table gives an empty result. Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), _HOST, 1))
    rows = pages.select(
        host.alias("host"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    paths = materialize(winning_paths(rows.select("host", "html")), "host-paths")
    if paths.count() <= BROADCAST_HOSTS:
        placed = rows.join(F.broadcast(paths), "host", "left")
    else:
        parts = hot_hosts(rows)
        count = F.coalesce("parts", F.lit(1))
        spread = rows.join(parts, "host", "left").withColumn(
            "part", F.pmod(F.xxhash64("page_id", "url"), count).cast("int")
        )
        copies = paths.join(parts, "host", "left").select(
            "host", "paths", "staying", F.explode(F.sequence(F.lit(0), count - 1)).alias("part")
        )
        placed = spread.join(copies, ["host", "part"], "left")
    return placed.select("page_id", "url", "html", "paths", "staying").mapInArrow(
        _extract, "page_id long, url string, text string"
    )
