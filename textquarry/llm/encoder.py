"""Token ids of whole texts, by the tokenizers library behind a bounded cache of chunks.

Neither vocabulary file forms a token across the border from a character to an ASCII white-space character, so a text may
be cut there, and at some safe places within words, and each distinct chunk encoded once. A chunk that is a run of Latin letters
is one piece to the model, which is then called without the steps before it; those take most of the time of short chunks. Texts with other Unicode white
space or the string of a special token are encoded whole, because those may reach across such a place. ``tests/llm/test_tokens.py`` compares the result with the library's own.
"""
from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain, repeat

import numpy as np

from .common import holds_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Unicode white space outside ASCII, and the separators that some engines count as such.
_ODD = re.compile("[\\x1c-\\x1f" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]")
# A run of Latin letters (U+0130 aside: its lower case is two characters) ends before any other ASCII character; a run of ASCII punctuation (without the apostrophe, which may
# start a contraction) ends before a space, letter or digit; one line break between other characters stands alone. What
# these don't cover goes up to the next white space, with all the white space before it.
_LATIN = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x12F), (0x131, 0x24F)))
_LETTERS = rf"[{_LATIN}]+(?=[\x00-@\[-`{{-\x7f]|$)"
_MARKS = rf"[!-&(-/:-@\[-`{{-~]+(?=[ \t\n\r\v\f{_LATIN}0-9]|$)"
_WITH_SPACE = re.compile(rf"[\t\n\r\v\f](?=[^ \t\n\r\v\f])| ?{_LETTERS}| ?{_MARKS}|[ \t\n\r\v\f]*[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+")
_NO_SPACE = re.compile(rf"{_LETTERS}|{_MARKS}|[^ \t\n\r\v\f]+")
_WORD = re.compile(rf" ?[{_LATIN}]+").fullmatch
#: Normaliser and pre-tokenizer by which a run of Latin letters, a space before it or not, is one piece: whether in lower case.
_ONE_PIECE = {
    ("None", "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"): False,
    (
        r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])',
        r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""",
    ): True,
}
# The characters by which byte-level models write bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512), strict=False))
#: Chunks of more characters are encoded but not kept.
KEPT_CHARS = 64
#: The cache starts anew at so many chunks; some 200 bytes each.
KEPT_CHUNKS = 700_000
#: It does so at so many ids too, long chunks' ones among them.
KEPT_IDS = 1 << 24
#: Characters handled at once.
BATCH_CHARS = 1_000_000


def tokenizer_path(name: str) -> str:
    """A path as given, or the place of a public vocabulary file of that name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        # A vocabulary that drops white space gives no ids for it, so chunks need not carry theirs.
        drops = not self.tokenizer.encode(" \n a \t", add_special_tokens=False).ids[1:]
        self.cut = (_NO_SPACE if drops else _WITH_SPACE).findall
        self.model = self.tokenizer.model
        plain = getattr(self.model, "dropout", 0) is None
        self.lower = _ONE_PIECE.get((str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer))) if plain else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.count = np.zeros(1 << 14, np.uint32), np.zeros(1 << 14, np.uint32)
        self.n = 0

    def _ids(self, chunks: list[str]) -> tuple[list[str], list[int], list[int]]:
        """The chunks in another order, the number of ids of each, and the ids one after the other."""
        counts: list[int] = []
        flat: list[int] = []
        rest = chunks
        if self.lower is not None:
            rest = [c for c in chunks if not _WORD(c)]
            plain = [c for c in chunks if _WORD(c)] if rest else chunks
            chunks = plain + rest
            tokenize, lower, before = self.model.tokenize, self.lower, 0
            for piece in plain:
                if lower:
                    piece = piece.lower()
                if not piece.isascii():
                    piece = piece.encode().decode("latin-1").translate(_BYTES)
                elif piece[0] == " ":
                    piece = "\u0120" + piece[1:]
                flat += [t.id for t in tokenize(piece)]
                counts.append(len(flat) - before)
                before = len(flat)
        for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            counts.append(len(e.ids))
            flat += e.ids
        return chunks, counts, flat

    def _add(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 20_000):
            part, counts, ids = self._ids(chunks[at : at + 20_000])
            count = np.array(counts, np.int64)
            ends = np.cumsum(count)
            while self.used + ends[-1] > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while self.n + len(part) > len(self.offset):
                self.offset, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.offset, self.count))
            self.flat[self.used : self.used + ends[-1]] = ids
            self.offset[self.n : self.n + len(part)], self.count[self.n : self.n + len(part)] = self.used + ends - count, count
            self.place.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.used += int(ends[-1])
            self.n += len(part)

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The chunks' places, -1 where they are new."""
        return np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        cut = [[t] if _ODD.search(t) or any(x in t for x in self.special) else self.cut(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        at = self._places(flat)
        new = dict.fromkeys(flat[k] for k in np.flatnonzero(at < 0).tolist())
        if new:
            if len(self.place) and (len(self.place) + len(new) > KEPT_CHUNKS or self.used > KEPT_IDS):
                self.forget()
                new = dict.fromkeys(flat)
            self._add(list(new))
            missing = np.flatnonzero(at < 0) if len(new) < self.n else np.arange(len(flat))
            at[missing] = self._places([flat[k] for k in missing.tolist()])
        counts = self.count[at].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.offset[at].astype(np.int64) - (ends - counts), counts) + np.arange(total)]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        borders = np.concatenate(([0], ends))[np.cumsum(sizes)[:-1]]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del self.place[chunk]
        return np.split(ids, borders)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as an array of uint32; null counts as empty."""
        out: list[np.ndarray] = []
        part: list[str] = []
        chars = 0
        for t in texts:
            part.append(t or "")
            chars += len(part[-1])
            if chars >= BATCH_CHARS:
                out += self._some(part)
                part, chars = [], 0
        return out + (self._some(part) if part else [])


@cache
def _encoder(name: str) -> Encoder:
    return Encoder(name)


def encoder(name: str) -> Encoder:
    """One encoder a worker process and vocabulary, until another operator's cache takes its place."""
    holds_cache(f"encoder {name}", _encoder.cache_clear)
    return _encoder(name)
