"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds the word sequences of the normalised test items. The words of a training text stream through it; the
state and the length of the longest suffix that occurs in some item are kept. Wherever that length reaches the window,
the last ``window`` words are a hit, and the items that hold them are those of the state at that length. An item of
fewer words is hit as a whole. Words of no item put the automaton back to its start, so only runs of known words at
least as long as the shortest window are streamed.

The automaton is built and broadcast for blocks of items of at most ``BLOCK_CHARS`` characters, made on the executors and
stored; an item longer than that is cut into parts that share ``window`` - 1 words, which keeps every window whole. (A part has a
window's words at least, however long they are.) One pass over the texts runs up to ``PASS_BLOCKS`` automata; more items mean
more passes, not a larger broadcast.

Defined results: null text or null item has no words; an item without words matches nothing; null item_ids are left out
of the lists but their words still hit; repeated items count each id once; rows with the same doc_id are judged each on
its own; a text of any length is streamed whole; an empty table on either side gives no hits. Other columns pass through,
whatever their names, but one of the result's own name is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, stored, table

WINDOW = 13
BLOCK_CHARS, PASS_BLOCKS = 1 << 19, 4
#: 1 / COVERAGE of a document's words is the share of hit words from which it counts as contaminated.
COVERAGE = 20

# Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased; in UTF-8 all bytes from 0x80 belong to words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton of the items' words, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.holds: list[set[str]] = [set()]  # items in which a state's strings occur
        self.least = window
        short: dict[int, dict[int, set[str]]] = {}
        for item, text in items:
            found = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            last = 0
            for w in found:
                last = self._extend(last, w)
                state = last
                while state > 0 and (item not in self.holds[state]):
                    self.holds[state].add(item)
                    state = self.link[state]
            if 0 < len(found) < window:
                self.least = min(self.least, len(found))
                short.setdefault(last, {}).setdefault(len(found), set()).add(item)
        # From each state: whole short items that end there, through the suffix links; and the state of the window's length.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short: list[tuple] = [()] * len(order)
        self.at_window = [0] * len(order)
        for v in order[1:]:
            own = tuple((n, frozenset(x)) for n, x in short.get(v, {}).items())
            self.short[v] = self.short[self.link[v]] + own
            up = self.link[v]
            self.at_window[v] = v if self.length[up] < window <= self.length[v] else self.at_window[up]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, nxt: dict[int, int], holds: set[str] | None = None) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        self.holds.append(set(holds or ()))
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, dict(nxt[q]), self.holds[q])
        link[clone] = link[q]
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def match(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items with occurring windows."""
        if len(found) < self.least:
            return [], set()
        known = np.fromiter((self.ids.get(w, -1) for w in found), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        spans: list[list[int]] = []
        items: set[str] = set()
        nxt, link, length, at_window, window = self.next, self.link, self.length, self.at_window, self.window
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a < self.least:
                continue
            state, n = 0, 0
            for at, w in enumerate(known[a:b].tolist(), int(a)):
                while state and w not in nxt[state]:
                    state = link[state]
                    n = length[state]
                if w in nxt[state]:
                    state, n = nxt[state][w], n + 1
                hit = 0
                if n >= window:
                    hit = window
                    items |= self.holds[at_window[state]]
                for size, of in self.short[state]:
                    if size <= n:
                        hit = max(hit, size)
                        items |= of
                if hit:
                    start = at + 1 - hit
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([start, at + 1])
        return [tuple(x) for x in spans], items


def parts_of(text: str, window: int = WINDOW, chars: int = BLOCK_CHARS) -> Iterator[str]:
    """A text, or the normalised words of a long one in parts that share ``window`` - 1 words."""
    if len(text) <= chars:
        yield text
        return
    found = words(text)
    a = 0
    while a == 0 or a + window <= len(found):
        b, size = a, 0
        while b < len(found) and (b - a < window or size + len(found[b]) < chars):
            size += len(found[b]) + 1
            b += 1
        yield b" ".join(found[a:b]).decode("utf-8", "surrogatepass")
        if b == len(found):
            return
        a = b - window + 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for item, text in zip(batch["id"], batch["text"], strict=True):
                for part in parts_of(text, window, block_chars):
                    if held and size + len(part) > block_chars:
                        yield pd.DataFrame({"items": [held]})
                        held, size = [], 0
                    held.append({"id": item, "text": part})
                    size += len(part)
        if held:
            yield pd.DataFrame({"items": [held]})

    # Few partitions, so that blocks are filled; each is streamed.
    made = items.coalesce(max(1, -(-total // (64 * block_chars)))).mapInPandas(blocks, "items array<struct<id:string,text:string>>")
    for row in stored(made).toLocalIterator():
        yield [(r["id"], r["text"]) for r in row["items"]]


MATCH = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _matcher(shared: list, kind):
    """A UDF over texts and what earlier passes have found in them."""

    @F.pandas_udf(kind)
    def matched(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automata = [b.value for b in shared]
        for texts, before in batches:
            n_words, spans, items = [], [], []
            for text, old_spans, old_items in zip(texts, before["spans"], before["items"], strict=True):
                found = words(text)
                s, i = automata[0].match(found) if automata else ([], set())
                for automaton in automata[1:]:
                    more, others = automaton.match(found)
                    s, i = merged(s + more), i | others
                if old_spans is not None:
                    s, i = merged([(x["start"], x["end"]) for x in old_spans] + s), {*i, *old_items}
                n_words.append(len(found))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(x for x in i if x is not None))
            yield pd.DataFrame({"n_words": n_words, "spans": spans, "items": items})

    return matched.asNondeterministic()  # so that a filter on the result doesn't make Spark evaluate it twice


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, out_col: str = "contamination",
) -> DataFrame:
    """``docs`` with the struct ``out_col``: n_words, merged spans of hit words, and the sorted ids of the items found."""
    context = docs.sparkSession.sparkContext
    bounded_batches(docs.sparkSession)
    out = docs.withColumn(out_col, F.lit(None).cast(f"struct<{MATCH.replace(' long', ':long').replace(' array', ':array')}>"))
    kind = out.schema[out_col].dataType
    shared: list = []
    passes = 0
    for block in item_blocks(benchmark, item_id, item_text, window, BLOCK_CHARS):
        shared.append(context.broadcast(Automaton(block, window)))
        if len(shared) == PASS_BLOCKS:
            out, shared, passes = out.withColumn(out_col, _matcher(shared, kind)(F.col(text_col), F.col(out_col))), [], passes + 1
    if shared or not passes:
        out = out.withColumn(out_col, _matcher(shared, kind)(F.col(text_col), F.col(out_col)))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def hit_words(found: str = "contamination"):
    return F.aggregate(f"{found}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: str = "contamination", coverage: int = COVERAGE):
    return (hit_words(found) > 0) & (coverage * hit_words(found) >= F.col(f"{found}.n_words"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span of words."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents at the coverage limit, and without the hit spans in the others.

    Rows that lose a span get a new ``n_chars`` where that column exists.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        # Evaluated for rows without a hit as well, null texts among them.
        return pd.Series([cut_words(t, [(x["start"], x["end"]) for x in s]) if t and len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    mark, text = fresh(docs, "__found"), fresh(docs, "__cut")
    found = find_contamination(docs, benchmark, window=window, out_col=mark)
    hit = F.size(f"{mark}.spans") > 0
    out = found.where(~contaminated(mark, coverage)).withColumn(text, F.when(hit, cut("text", f"{mark}.spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(text)).select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
