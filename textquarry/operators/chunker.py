"""Hierarchy-aware chunks: a tree of blocks, units that fit, packing, and structural overlap.

The steps depend on order and state, so they are plain functions over one document's blocks; ``chunk_documents`` runs them in
an Arrow function where the document is read, nothing is shuffled. Sizes count characters without white space, so those of
joined texts add up.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from textquarry.functions.numbers import han_value
from textquarry.functions.text import clean, stable_id
from textquarry.session import bounded_batches

from .structure import RANKS, classified, split_sentences

MAX_CHARS, TARGET_CHARS, SHORT_CHARS = 1200, 600, 200
OVERLAP_UNITS, OVERLAP_SHARE, OVERLAP_LEAST = 2, 0.2, 120
PARENT_CHARS, PARENT_REST, PREFIX_CHARS = 220, 180, 240
LEVELS = ("part", "attachment", "chapter", "section", "article")
LEAVES = ("text", "table", "heading_text")
# Openings that depend on what stands before, titles of declarations, and words that oblige.
DEPENDENT = ("前条", "前款", "上述", "其中", "但", "此外", "该等", "同时")
DECLARATIONS = ("声明", "承诺", "说明", "前言")
NORMATIVE = ("应当", "不得", "必须", "可以", "禁止")
_ITEM = re.compile(r"^\s*[（(]\s*([\d一二三四五六七八九十百]+)\s*[)）]|^\s*([\d一二三四五六七八九十百]+)[、.．]")
_INTRO = re.compile(r"[:：]\s*$")
_SENTENCE_END = re.compile(r"[。.!?！？；;:：]\s*$")


def size(text: str) -> int:
    return len("".join(text.split()))


def characters(text: str) -> int:
    """The length without Unicode's white space, as ``body_chars`` counts it: Python's also has four separators of files and records."""
    return size(text) + sum(map(text.count, "\x1c\x1d\x1e\x1f"))


@dataclass
class Node:
    kind: str
    marker: str
    text: str
    seqs: list[int] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    up: Node | None = None

    @property
    def rank(self) -> int:
        return RANKS.get(self.kind, 8)

    def add(self, node: Node) -> Node:
        node.up = self
        self.children.append(node)
        return node


def ordinal(marker: str) -> int | None:
    """The number in a marker such as 第十二条."""
    found = re.search(r"[\d零〇一二两三四五六七八九十百千万]+", marker or "")
    value = han_value(found[0]) if found else None
    return None if value is None else int(value)


def build_tree(blocks: list[tuple[int, str, str, str]]) -> Node:
    """blocks (seq, text, kind, marker) in order. A numbered block closes all of its rank or below and opens a level.

    Text and tables hang on what is open. An article numbered below the open one is a reference, so text of that article,
    unless a heading began a new count; that holds where two headings or more stand before a first article. An article after
    a declaration belongs to no declaration.
    """
    root = Node("document", "", "")
    open_ = [root]
    begins = [k for k, (_, _, kind, _) in enumerate(blocks[:-1]) if kind == "heading" and blocks[k + 1][2] == "article" and ordinal(blocks[k + 1][3]) == 1]
    restarts = {blocks[k][0] for k in begins} if len(begins) > 1 else set()
    last: int | None = None
    for seq, text, kind, marker in blocks:
        node = Node(kind, marker, text, [seq])
        if kind in ("text", "table"):
            open_[-1].add(node)
            continue
        declared = any(n.kind == "heading" and n.text.strip() in DECLARATIONS for n in open_)
        if kind == "article":
            n = ordinal(marker)
            current = next((x for x in open_ if x.kind == "article"), None)
            if current is not None and last is not None and n is not None and n < last and not declared:
                node.kind = "text"
                current.add(node)
                continue
            if declared:
                open_ = [root]
            last = n if n is not None else last
        elif kind in ("part", "attachment") or seq in restarts:
            last = None
            if seq in restarts:
                open_ = [root]
        while len(open_) > 1 and open_[-1].rank >= node.rank:
            open_.pop()
        open_.append(open_[-1].add(node))
    return root


def hierarchy(node: Node) -> dict[str, str]:
    """The nearest marker of each level from a node to the root."""
    out: dict[str, str] = {}
    at: Node | None = node
    while at is not None:
        level = "section" if at.kind == "heading" else at.kind
        if level in LEVELS and at.marker:
            out.setdefault(level, at.marker)
        at = at.up
    return out


def render(node: Node) -> str:
    """The text of a subtree, a line for each block."""
    if not node.children:
        return node.text.strip()
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.text.strip():
            out.append(n.text.strip())
        todo += reversed(n.children)
    return "\n".join(out)


def seqs_of(node: Node) -> list[int]:
    if not node.children:
        return sorted(node.seqs)
    return sorted({*node.seqs, *(s for c in node.children for s in seqs_of(c))})


@dataclass
class Unit:
    path: dict[str, str]
    text: str
    kind: str
    seqs: list[int]

    @cached_property
    def size(self) -> int:
        return size(self.text)

    @property
    def introduces(self) -> bool:
        return bool(_INTRO.search(self.text))


def split_table(text: str, most: int) -> list[str]:
    """A Markdown table in pieces of whole rows; each repeats the two header lines."""
    lines = text.split("\n")
    head, rows = lines[:2], lines[2:]
    out: list[list[str]] = []
    for row in rows:
        if out and size("\n".join([*head, *out[-1], row])) <= most:
            out[-1].append(row)
        else:
            out.append([row])
    return ["\n".join([*head, *o]) for o in out] or [text]


def sentence_pieces(text: str, most: int) -> list[str]:
    """Whole sentences in pieces of at most ``most``; one that introduces a list starts a piece if the list wouldn't fit."""
    out: list[str] = []
    for piece in split_sentences(text, most):
        cut = [m.end() for m in re.finditer(r"[。.!?！？；;]", piece[:-1])]
        if out and _INTRO.search(piece) and cut:  # the introduction goes on with what it introduces
            out += [piece[: cut[-1]], piece[cut[-1] :]]
        else:
            out.append(piece)
    return [p.strip() for p in out if p.strip()]


def units_of(node: Node, most: int = MAX_CHARS) -> list[Unit]:
    """A subtree as one unit if it fits; else its own text, in pieces where it must be, then its children."""
    path = hierarchy(node)
    if node.up is not None:
        whole = Unit(path, render(node), node.kind, [])
        if whole.size <= most:
            whole.seqs = seqs_of(node)
            return [whole]
    out: list[Unit] = []
    if node.text.strip():
        pieces = split_table(node.text, most) if node.kind == "table" and size(node.text) > most else sentence_pieces(node.text, most)
        out += [Unit(path, p, node.kind, list(node.seqs)) for p in pieces]
    for c in node.children:
        out += units_of(c, most)
    return out


def compatible(a: dict[str, str], b: dict[str, str]) -> bool:
    """Part and attachment must be equal; a chapter or section may be missing on one side."""
    same = all(a.get(k, "") == b.get(k, "") for k in ("part", "attachment"))
    return same and all(not a.get(k) or not b.get(k) or a[k] == b[k] for k in ("chapter", "section"))


def topic(text: str, topics: dict[str, tuple[str, ...]]) -> str:
    """The topic whose words occur most, the first one on a tie; '' for none."""
    scores = {name: sum(text.count(w) for w in words) for name, words in topics.items()}
    best = max(scores, key=lambda n: scores[n], default="")
    return best if best and scores[best] else ""


def heading_only(units: list[Unit]) -> bool:
    return all(u.kind in ("part", "chapter", "section", "heading", "attachment") and "\n" not in u.text for u in units)


def valuable(text: str) -> bool:
    """Short text that stands for itself: it obliges someone, or it is an article."""
    return any(w in text for w in NORMATIVE) or bool(re.match(r"^第\S{1,9}条", text))


def pack(units: list[Unit], most: int = MAX_CHARS, target: int = TARGET_CHARS, short: int = SHORT_CHARS, topics: dict[str, tuple[str, ...]] | None = None, forced: frozenset[int] = frozenset()) -> list[list[Unit]]:
    """Units into chunks: an incompatible path, a forced break, the limit, or a new topic once the target is reached ends one.

    A last unit that introduces a list goes with the list, if both fit. Chunks of headings go on to the next, short ends that
    say nothing by themselves back to the one before, where the result fits.
    """
    text = lambda us: "\n".join(u.text for u in us)
    chars = lambda us: sum(u.size for u in us)
    chunks: list[list[Unit]] = []
    for k, u in enumerate(units):
        current = chunks[-1] if chunks else []
        fits = bool(current) and chars(current) + u.size <= most
        same = bool(current) and compatible(current[-1].path, u.path)
        turned = bool(topics) and bool(current) and chars(current) >= target and topic(u.text, topics) not in ("", topic(text(current), topics))
        if current and fits and same and not turned and k not in forced:
            current.append(u)
        elif current and not fits and same and k not in forced and len(current) > 1 and current[-1].introduces and current[-1].size + u.size <= most:
            chunks.append([current.pop(), u])
        else:
            chunks.append([u])
    forward: list[list[Unit]] = []
    held: list[Unit] = []
    for c in chunks:
        if held and compatible(held[-1].path, c[0].path) and chars(held) + chars(c) <= most:
            c = [*held, *c]
        elif held:
            forward.append(held)
        held = []
        if heading_only(c) and chars(c) < short:
            held = c
        else:
            forward.append(c)
    forward += [held] if held else []
    out: list[list[Unit]] = []
    for c in forward:
        if out and chars(c) < short and not valuable(text(c)) and compatible(out[-1][-1].path, c[0].path) and chars(out[-1]) + chars(c) <= most:
            out[-1] = [*out[-1], *c]
        else:
            out.append(c)
    return out


def parent_context(before: str, after: str) -> str:
    """What a continued list belongs to: the last sentence before it that introduces one, else the end of the text before."""
    if not _ITEM.match(after):
        return ""
    intro = [line for line in re.split(r"(?<=[。！？!?；;])|\n", before) if _INTRO.search(line or "")]
    return intro[-1].strip()[-PARENT_CHARS:] if intro else before.strip()[-PARENT_REST:]


def refers_back(before: list[Unit], after: list[Unit]) -> str:
    """Why a chunk needs the one before it: dependency, enumeration, numbering, sentence; '' if it doesn't."""
    last, first = before[-1], after[0]
    if first.kind in ("part", "attachment", "chapter", "section", "heading") or not compatible(last.path, first.path):
        return ""
    if first.text.startswith(DEPENDENT):
        return "dependency"
    item, held = _ITEM.match(first.text), _ITEM.findall("\n".join(u.text for u in before[-OVERLAP_UNITS:]))
    if item and (last.introduces or any(_INTRO.search(line) for line in last.text.split("\n"))):
        return "enumeration"
    if item:
        numbers = [ordinal(next(filter(None, _ITEM.match(line).groups()))) for u in before for line in u.text.split("\n") if _ITEM.match(line)]
        if held or (numbers and ordinal(next(filter(None, item.groups()))) == (numbers[-1] or 0) + 1):
            return "numbering"
    if last.kind == first.kind == "text" and not _SENTENCE_END.search(last.text):
        return "sentence"
    return ""


def overlaps(chunks: list[list[Unit]]) -> list[tuple[str, str, str]]:
    """(reason, overlap, parent) of each chunk: whole units from the end of the one before, nearest first, within the budget;
    where none fits, what introduces a list. The chunk's own body stays as it is."""
    out = [("", "", "")]
    for before, after in zip(chunks, chunks[1:], strict=False):
        body = "\n".join(u.text for u in after)
        reason = refers_back(before, after)
        budget, taken = max(OVERLAP_SHARE * sum(u.size for u in after), OVERLAP_LEAST), []
        for u in reversed(before[-OVERLAP_UNITS:]) if reason else ():
            if u.size + sum(size(t) for t in taken) > budget:
                break
            taken.insert(0, u.text)
        parent = parent_context("\n".join(u.text for u in before), body) if reason and not taken else ""
        out.append((reason, "\n".join(taken), parent))
    return out[: len(chunks)]


def context_prefix(title: str, path: dict[str, str], body: str) -> str:
    """Title and levels that the body's beginning doesn't name."""
    return " / ".join(x for x in (title, *(path.get(k, "") for k in LEVELS)) if x and x not in body[:PREFIX_CHARS])


CHUNKS = "doc_id long, chunk_index int, section_path string, body_text string, block_ids array<int>, is_oversized boolean, overlap_reason string, overlap_from int, overlap_text string, parent_context string, context_prefix string, character_count long"


def chunk_blocks(blocks: list[tuple[int, str, str, str]], title: str = "", most: int = MAX_CHARS, topics: dict[str, tuple[str, ...]] | None = None, forced: Callable[[list[Unit]], frozenset[int]] | None = None) -> list[tuple]:
    """The rows of ``CHUNKS`` without doc_id and character_count. ``forced`` may name units that start a chunk, as a reviewer of borders would."""
    units = units_of(build_tree(blocks), most)
    chunks = pack(units, most, min(TARGET_CHARS, most), min(SHORT_CHARS, most), topics, forced(units) if forced else frozenset())
    out = []
    for n, (own, (reason, overlap, parent)) in enumerate(zip(chunks, overlaps(chunks), strict=True), 1):
        body = "\n".join(u.text for u in own)
        path = own[0].path
        section = " / ".join(path[k] for k in LEVELS if path.get(k))
        seqs = sorted({s for u in own for s in u.seqs})
        out.append((n, section, body, seqs, sum(u.size for u in own) > most, reason, n - 1 if overlap or parent else 0, overlap, parent, context_prefix(title, path, body)))
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, most: int = MAX_CHARS, topics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Chunks of at most ``most`` characters unless marked oversized; every block that isn't blank is in one or more. A row of
    ``docs`` is a document."""
    bounded_batches(docs.sparkSession)
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    arrow = to_arrow_schema(DataType.fromDDL(CHUNKS))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = [(k, line, *classified(line)) for k, line in enumerate(text.split("\n")) if line.strip(" ")] if text else []
                rows += [(doc, *r, characters(r[2])) for r in chunk_blocks(blocks, name, most, topics)] if blocks else []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    found = docs.select(F.col(id_col).cast("long"), text_col, title).mapInArrow(chunk, CHUNKS)
    return found.withColumn("chunk_id", stable_id("doc_id", "section_path", "chunk_index", "body_text")).withColumn("body_text", clean("body_text"))
