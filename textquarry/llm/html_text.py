"""HTML extraction by wrapper induction.

Pages of one host are aligned by simple tree matching: for two trees with equal root labels (tag and class words), the node
pairs that keep the children's order and are as many as possible, found by dynamic programming over the children. The page
of a host with the smallest hash is its reference, and every other page of the host is aligned with it. For each node of the
reference the alignments give how many partners it has, how many of them hold the same text, and how much text, in links
and outside, stands in it on average (an unmatched element's text counts for the nearest matched element around it). Sums
of these go over all pages of the host; no page is left out or sampled. A page whose text is that of the reference to
``COPY`` or more is a copy of it and gives no evidence.

A subtree that most partners repeat is template, whatever its names are. What varies is a slot. The content is the innermost
element that holds ``SHARE`` of the varying text outside links, or the element around it as long as that has varying
headings or paragraphs beside it; where an ``article`` or ``main`` encloses it, that one. The wrapper of a host keeps the
content's path and the template subtrees by path.

A page's text is that of its elements at the wrapper's path; template subtrees in them are left out. Where a page has no such
element, or its host fewer than ``VOTES`` pages to learn from, its ``article`` or ``main`` elements are taken, else its body.
In either case elements go that HTML itself sets apart (``DROP_TAGS``; a ``header`` stays if it holds a heading), and
containers whose class, id or role says that they are advertising, a notice, a form or reader comments (``DROP_WORDS``;
such elements vary from page to page, so no alignment can tell them from content).

Defined results: null or empty html gives the empty text; markup that isn't closed is closed where HTML closes it, at the
end at the latest, and nesting may be of any depth; a page without url belongs to the host ''; repeated rows count as often
as they are and equal rows get equal texts; of pages equal in hash the one that sorts first is the reference; a column of the
result's name is replaced; an empty table gives none. Parsing and extraction take a time in proportion to the page's length,
an alignment one in proportion to it besides the product of the children in which two elements differ, in bounded memory.
"""
from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, fresh, stored, table

#: Pages beside the reference that a wrapper needs; share of the varying text in the content; equal text of a copy.
VOTES, SHARE, COPY = 2, 0.75, 0.8
#: References and wrappers are broadcast up to so many bytes in all; beyond it they are joined by host, in SALT parts.
BROADCAST_BYTES, SALT = 16 << 20, 16
# HTML's void, raw-text and block elements, and the elements that an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "summary"}
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
DROP_TAGS = frozenset("head title script style noscript template iframe svg canvas object nav header footer aside form button select input textarea dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre figure hgroup header dl".split())
# Names of containers that are no part of an article, and words that may stand beside them in a name.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login menu nav navbar navigation "
    "newsletter notice notices pagination popup promo promoted recommended related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget complementary contentinfo search".split()
)
NEUTRAL_WORDS = frozenset("area bar block box button buttons container content form inner item items links list outer panel section site wrap wrapper user reader top bottom left right".split())
NAMED = frozenset("div section aside ul ol table span dl fieldset details figure center".split())
_TAG_END = re.compile(r"""((?:[\s/]+|[^\s/>=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?|=)*+)>""")
_OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)(>)?|!--|!\[CDATA\[|[!?])")
_NAMING = re.compile("class|id|role|hidden", re.IGNORECASE)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "label", "drop", "children", "path", "up", "place", "kids", "shape", "mark", "size", "text", "hashed", "chars", "links")

    def __init__(self, tag: str, label: str, drop: bool, up: Node | None, place: int):
        self.tag, self.label, self.drop, self.up, self.place = tag, label, drop, up, place
        self.children: list[Node | str] = []
        self.path = xxh64_intdigest(label, up.path if up else 0)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]

    @property
    def own(self) -> int:
        """Characters in no element below."""
        return self.chars - sum([c.chars for c in self.kids]) if self.kids else self.chars


def parse(source: str | None) -> list[Node]:
    """The elements in page order, the first one a root around all; unclosed elements end where HTML ends them, an unclosed
    quote at the next white space or ``>``."""
    source = source or ""
    root = Node("#root", "#root", False, None, 0)
    nodes, stack, opened = [root], [root], {}
    at = 0  # text up to here is taken
    look = 0

    def text(end: int) -> None:
        if end > at:
            piece = source[at:end]
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    while m := _OPEN.search(source, look):
        start = m.start()
        if not m[2]:
            mark = m[0]
            close_with, skip = ("-->", 4) if mark == "<!--" else ("]]>", 9) if mark.startswith("<![") else (">", 2)
            end = source.find(close_with, start + skip)
            text(start)
            if mark.startswith("<!["):
                stack[-1].children.append(source[start + 9 : end if end >= 0 else len(source)])
            at = look = len(source) if end < 0 else end + len(close_with)
            continue
        attributes, end = "", m.end()
        if not m[3]:
            rest = _TAG_END.match(source, end)
            if rest is None:  # a tag that nothing ends is text
                look = end
                continue
            attributes, end = rest[1], rest.end()
        text(start)
        at = look = end
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break  # an inline end tag doesn't close blocks
            continue
        if tag in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSED_BY_SELF:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or {stack[k].tag, tag} in ({"dd", "dt"}, {"td", "th"}):
                    close(k)
                    break
                if stack[k].tag in CLOSED_BY_SELF[tag] or stack[k].tag in BLOCK:
                    break
        label, drop = _named(tag, attributes) if attributes and _NAMING.search(attributes) else (tag, tag in DROP_TAGS)
        node = Node(tag, label, drop, stack[-1], len(nodes))
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
            stop = end.start() if end else len(source)
            node.children.append(html.unescape(source[at:stop]) if tag in ("title", "textarea") else source[at:stop])
            at = look = end.end() if end else len(source)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    text(len(source))
    for node in nodes:
        if node.tag == "header" and node.drop:
            node.drop = not any(c.tag in HEADINGS for c in node.elements)
    return nodes


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's label, and whether it is set apart by its tag or its names."""
    names: list[str] = []
    drop = tag in DROP_TAGS
    for a in _ATTR.finditer(attributes):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name == "hidden":
            drop = True
        elif name in ("class", "id", "role"):
            if tag in NAMED:
                for token in value.lower().split():
                    words = set(_PARTS.findall(token))
                    drop = drop or bool(words & DROP_WORDS) and words <= DROP_WORDS | NEUTRAL_WORDS
            if name == "class":
                names = sorted({w.lower() for w in _PARTS.findall(value)})
    return tag + "".join("." + n for n in names), drop


def clean(text: str) -> str:
    return " ".join(text.split())


_SKIP = frozenset("script style noscript template".split())


@lru_cache(4096)
def _leaf(label: str) -> int:
    return xxh64_intdigest(label, 1)


def weigh(nodes: list[Node]) -> list[Node]:
    """Adds to each node, from its subtree: its elements, shape, size, a hash of the text (0: none), its characters, those in links."""
    for n in reversed(nodes):
        size, chars, links = 1, 0, 0
        text, kids = [], []
        for c in n.children:
            if c.__class__ is Node:
                kids.append(c)
                size += c.size
                chars += c.chars
                links += c.links
                if c.text:
                    text.append(c.hashed)
            elif n.tag not in _SKIP and (own := " ".join(c.split())):
                text.append("=" + own)
                chars += len(own)
        n.kids, n.size = kids, size
        n.shape = xxh64_intdigest(n.label + "".join([c.mark for c in kids])) if kids else _leaf(n.label)
        n.mark = f" {n.shape:x}"
        n.text = xxh64_intdigest("\0".join(text).encode("utf-8", "surrogatepass")) if text else 0
        n.hashed = str(n.text)
        n.chars, n.links = chars, chars if n.tag == "a" else links
    return nodes


class Matching:
    """Simple tree matching of two weighed trees; sizes are kept by the shapes of the subtrees."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def size(self, a: Node, b: Node) -> int:
        """Pairs in the best matching of two subtrees; 0 for other labels."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            xs, ys = self._middle(x, y)[1:3]
            open_ = [(c, d) for c in {c.shape: c for c in xs}.values() for d in {d.shape: d for d in ys}.values() if self._known(c, d) is None]
            if open_:
                todo += open_
                continue
            self.known[x.shape, y.shape] = 1 + self._children(x, y)[0]
        return self._known(a, b)

    def _known(self, x: Node, y: Node) -> int | None:
        if x.label != y.label:
            return 0
        if x.shape == y.shape:
            return x.size
        if x.size == 1 or y.size == 1:
            return 1
        return self.known.get((x.shape, y.shape))

    @staticmethod
    def _middle(x: Node, y: Node) -> tuple[int, list[Node], list[Node], int]:
        """Children between those of equal shape at both ends; matching equal ends is never worse."""
        xs, ys = x.kids, y.kids
        m = min(len(xs), len(ys))
        a = 0
        while a < m and xs[a].shape == ys[a].shape:
            a += 1
        b = 0
        while b < m - a and xs[-1 - b].shape == ys[-1 - b].shape:
            b += 1
        return a, xs[a : len(xs) - b], ys[a : len(ys) - b], b

    def _children(self, x: Node, y: Node, pairs: bool = False) -> tuple[int, list[tuple[Node, Node]]]:
        """Size of the best matching of the children and, if asked for, its pairs; their sizes must be known."""
        all_x, all_y = x.kids, y.kids
        a, xs, ys, b = self._middle(x, y)
        total = sum(c.size for c in all_x[:a]) + sum(c.size for c in all_x[len(all_x) - b :])
        out = list(zip(all_x[:a], all_y[:a], strict=True))
        if xs and ys:
            kinds: dict[int, int] = {}
            of = np.fromiter((kinds.setdefault(d.shape, len(kinds)) for d in ys), np.int64, len(ys))
            sample = list({d.shape: d for d in ys}.values())
            rows: dict[int, np.ndarray] = {}
            best = np.zeros(len(ys) + 1, np.int64)
            steps = []
            for c in xs:
                if c.shape not in rows:
                    rows[c.shape] = np.array([self._known(c, d) or 0 for d in sample], np.int64)[of]
                w = rows[c.shape]
                diagonal = best[:-1] + w
                new = np.concatenate(([0], np.maximum.accumulate(np.maximum(best[1:], diagonal))))
                if pairs:  # packed: where a cell comes from its diagonal, and where from above
                    steps.append((np.packbits((new[1:] == diagonal) & (w > 0)), np.packbits(new[1:] == best[1:])))
                best = new
            total += int(best[-1])
            if pairs:
                i, j, found = len(xs), len(ys), []
                while i and j:
                    byte, bit = divmod(j - 1, 8)
                    if steps[i - 1][0][byte] >> (7 - bit) & 1:
                        found.append((xs[i - 1], ys[j - 1]))
                        i, j = i - 1, j - 1
                    elif steps[i - 1][1][byte] >> (7 - bit) & 1:
                        i -= 1
                    else:
                        j -= 1
                out += found[::-1]
        if b:
            out += list(zip(all_x[-b:], all_y[-b:], strict=True))
        return total, out

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """All pairs of the best matching, parents first."""
        self.size(a, b)
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            yield x, y
            if x.size > 1 and y.size > 1:
                todo += self._children(x, y, True)[1]


def align(reference: list[Node], page: list[Node]) -> np.ndarray | None:
    """For each node of the reference: partners (0, 1), those of the same text, characters in its slot, in links, and its own.

    None for a copy of the reference. The slot of a node is the partner's text that is in no matched element below it; its
    own characters are in no element below it at all.
    """
    matched = list(Matching().pairs(reference[0], page[0]))
    out = [[0, 0, 0, 0, 0] for _ in reference]
    partner: dict[int, int] = {y.place: x.place for x, y in matched}
    same = 0
    for x, y in matched:
        own = y.own
        equal = x.text == y.text
        out[x.place] = [1, equal, 0, 0, own]
        same += own * equal
    if reference[0].chars and same >= COPY * max(reference[0].chars, page[0].chars):
        return None
    for y in page:
        own = y.own
        if not own or y.tag in DROP_TAGS:
            continue
        link, n = False, y
        while n is not None and n.place not in partner:
            link, n = link or n.tag == "a", n.up
        at = partner[n.place]
        out[at][2] += own
        out[at][3] += own if link or y.links == y.chars or n.tag == "a" else 0
    return np.array(out, np.int64)


def induce(reference: list[Node], stats: np.ndarray, votes: int) -> str | None:
    """The wrapper, as JSON: the content's path and the template subtrees (path and text's hash); None for too few votes."""
    if votes < VOTES:
        return None
    seen, same, chars, links, own = stats.T
    template = [False] * len(reference)  # constant, or within what is
    prose = [False] * len(reference)  # varying text outside links is in it
    mass = np.zeros(len(reference))
    top = []
    for n in reference:
        up = n.up is not None and template[n.up.place]
        whole = n.tag in BLOCK and n.up is not None and n.up.tag in SECTIONS  # no cell of a table, item of a list or part of a block
        template[n.place] = up or whole and bool(n.text) and seen[n.place] >= 2 and 2 * same[n.place] > seen[n.place]
        if template[n.place] and not up:
            top.append([n.path, n.text])
    apart = [False] * len(reference)
    for n in reference:
        apart[n.place] = n.drop and n.tag in DROP_TAGS or n.up is not None and apart[n.up.place]
        if not template[n.place] and not apart[n.place]:
            mass[n.place] = max(0, chars[n.place] - links[n.place])
    by_path: dict[int, float] = {}
    for n in reversed(reference):
        by_path[n.path] = by_path.get(n.path, 0) + mass[n.place]
        prose[n.place] = mass[n.place] > 0
        if n.up is not None:
            mass[n.up.place] += mass[n.place]
    content = None
    if mass[0] > 0:
        holders = [n for n in reference if by_path[n.path] >= SHARE * mass[0] and n.tag in CONTAINERS]
        depth = lambda n: 0 if n.up is None else 1 + depth_of[n.up.place]
        depth_of: list[int] = []
        for n in reference:
            depth_of.append(depth(n))
        best = max(holders, key=lambda n: (depth_of[n.place], -n.place), default=None)
        while best is not None and best.up is not None and best.tag != "body":
            beside = [c for c in best.up.elements if c.path != best.path and c.tag in PROSE and prose[c.place]]
            if not (beside or own[best.up.place] > 0 and not template[best.up.place]):
                break
            best = best.up
        n = best
        while n is not None:
            if n.tag in ("article", "main"):
                best = n
                break
            n = n.up
        content = best.path if best is not None and best.up is not None else None
    return json.dumps({"content": content, "template": top})


CONTAINERS = frozenset("body article main section div td blockquote".split())
SECTIONS = frozenset("#root html body article main section div header footer aside nav td center form".split())


def blocks(top: Node, fixed: frozenset, out: list[str]) -> None:
    """The texts of the blocks in a node in page order; inline elements belong to the block around them."""
    pending: list[str] = []

    def flush() -> None:
        if text := clean("".join(pending)):
            out.append(text)
        pending.clear()

    todo: list[tuple] = [(top, iter(top.children))]
    while todo:
        n, rest = todo[-1]
        for c in rest:
            if c.__class__ is str:
                pending.append(c)
            elif c.drop or fixed and (c.path, getattr(c, "text", 0)) in fixed:
                if c.tag in BLOCK:
                    flush()
            elif c.tag == "br":
                pending.append(" ")
            else:
                if c.tag in BLOCK:
                    flush()
                todo.append((c, iter(c.children)))
                break
        else:
            todo.pop()
            if n.tag in BLOCK:
                flush()
    flush()


def extract(source: str | None, wrapper: str | None = None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    nodes = parse(source)
    known = _wrapper(wrapper) if wrapper else (None, frozenset(), frozenset())
    if known[1]:
        weigh(_below(nodes, known[2]))
    out: list[str] = []
    for named in ((lambda n: n.path == known[0]), (lambda n: n.tag in ("article", "main"))):
        taken = [False] * len(nodes)  # in an element that is set apart or taken
        for n in nodes[1:]:
            taken[n.place] = taken[n.up.place] or n.drop
            if not taken[n.place] and named(n):
                taken[n.place] = True
                blocks(n, known[1], out)
        if out:
            return "\n\n".join(out)
    blocks(nodes[0], known[1], out)
    return "\n\n".join(out)


@lru_cache(256)
def _wrapper(of: str) -> tuple[int | None, frozenset, frozenset]:
    known = json.loads(of)
    return known["content"], frozenset(map(tuple, known["template"])), frozenset(path for path, _ in known["template"])


def _below(nodes: list[Node], paths: frozenset) -> list[Node]:
    """The nodes at some paths and below them."""
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.place] = n.path in paths or n.up is not None and inside[n.up.place]
    return [n for n in nodes if inside[n.place]]


@lru_cache(64)
def _reference(source: str) -> list[Node]:
    return weigh(parse(source))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _with_host_value(pages: DataFrame, values: DataFrame, bytes_: int, salt_by: str) -> DataFrame:
    """``pages`` (host, ...) with the columns of ``values``, a stored table with one row a host."""
    if bytes_ <= BROADCAST_BYTES:
        return pages.join(F.broadcast(values), "host", "left")
    many = values.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return pages.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALT)).cast("int")).join(many, ["host", "salt"], "left").drop("salt")


def _bytes(values: DataFrame) -> int:
    return values.agg(F.sum(sum((F.octet_length(c) for c in values.columns), F.lit(0)))).first()[0] or 0


STATS = "host string, node int, votes long, seen long, same long, chars long, links long, own long"


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper), stored, from all pages (host, html, h) of each host; h orders them."""
    pages = pages.where("html is not null")
    first = F.struct("h", "html")
    references = stored(pages.groupBy("host").agg(F.min(first).alias("r")).select("host", F.col("r.html").alias("reference")))
    met = _with_host_value(pages.select("host", "html"), references, _bytes(references), "html")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list] = {}
            for host, page, reference in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("reference"), strict=True):
                source = reference.as_py()
                tree = _reference(source) if len(source) < 1 << 20 else weigh(parse(source))
                if (got := align(tree, weigh(parse(page.as_py())))) is not None:
                    if host in sums:
                        sums[host][0] += 1
                        sums[host][1] += got
                    else:
                        sums[host] = [1, got]
            hosts = [h for h, (_, s) in sums.items() for _ in range(len(s))]
            flat = np.concatenate([np.column_stack((np.arange(len(s)), np.full(len(s), v), s)) for v, s in sums.values()]) if sums else np.zeros((0, 7), np.int64)
            columns = [pa.array(hosts, pa.string()), pa.array(flat[:, 0].astype(np.int32)), *(pa.array(flat[:, k]) for k in range(1, 7))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STATS.split(", ")])

    sums = met.mapInArrow(each, STATS).groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("votes", "seen", "same", "chars", "links", "own")))
    rows = sums.join(references.withColumnRenamed("host", "of"), (F.col("host") == F.col("of")) & (F.col("node") == 0), "left").drop("of")

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        tree = weigh(parse(rows["reference"].iloc[0]))
        return pd.DataFrame({"host": [key[0]], "wrapper": [induce(tree, rows[["seen", "same", "chars", "links", "own"]].to_numpy(np.int64), int(rows["votes"].iloc[0]))]})

    # A group has as many rows as the host's reference has elements.
    return stored(rows.groupBy("host").applyInPandas(learn, "host string, wrapper string"))


def extract_pages(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the main text of each page, instead of the html."""
    bounded_batches(pages.sparkSession)
    source, host, found = (F.col(html_col), host_of(F.col(url_col)), fresh(pages, "__wrapper"))
    known = wrappers(pages.select(host.alias("host"), source.alias("html"), F.xxhash64(id_col, url_col).alias("h")))
    hosted = pages.select(host.alias("host"), F.struct(*pages.columns).alias("page"), source.alias("html"))
    joined = _with_host_value(hosted, known, _bytes(known), "html").select("page.*", F.col("wrapper").alias(found))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, of in batches:
            yield pd.Series([extract(s, w) for s, w in zip(sources, of, strict=True)], dtype=object)

    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    return joined.select(*kept, text(F.col(html_col), F.col(found)).alias(out_col))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
