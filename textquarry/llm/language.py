"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are the hashed character 1- to 3-grams of a text's words (with a border sign), relative to their number and scaled
by their spread in the training rows. All classifiers are linear in the counts, so a text's score is the sum of its words'
scores; each distinct word is scored once and kept in a bounded cache, and whole texts are read.

Training takes labelled rows only, at most about ``SAMPLE`` a language and ``SAMPLE_ALL`` in all: a hash of doc_id below a threshold that follows from
the language's count. Executors turn them into feature vectors of ``DIMENSIONS`` numbers; only these reach the driver.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text of any length is read whole; equal margins go
to the first family and language by name; rows with null lang are not learned from; no
labelled row at all makes every text ``und``; equal texts get equal results. Other columns pass through, whatever
their names; one of the result's name is replaced.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, holds_cache, release, table

DIMENSIONS = 4096
#: Labelled rows a language that the classifiers are fitted on, about.
SAMPLE = 500
#: And about so many in all: what bounds the driver's memory (16 KiB a row) where languages are many.
SAMPLE_ALL = 8_000
#: The cache starts anew at so many words; some 200 bytes each.
KEPT_WORDS = 300_000
UNKNOWN = "und"
# Families of ISO 639-1 codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % DIMENSIONS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def vector(text: str | None) -> np.ndarray:
    """Relative frequency of each hashed gram."""
    counts: dict[str, int] = {}
    for w in words_of(text):
        counts[w] = counts.get(w, 0) + 1
    out = np.zeros(DIMENSIONS, np.float32)
    for w, n in counts.items():
        np.add.at(out, grams(w), n)
    return out / max(1.0, float(out.sum()))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss) by dual coordinate descent; y is -1 or 1. The bias is a constant feature."""
    # The bias is kept beside w, and sums are taken row by row, so that the rows aren't copied.
    w, bias, alpha, norm = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    rng = np.random.default_rng(0)
    weight = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (x[i] @ w + bias) - 1) / norm[i], 0.0), weight[i])
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * x[i]
                bias += (alpha[i] - old) * y[i]
                moved = max(moved, abs(alpha[i] - old))
        if moved < 1e-3:
            break
    return w, float(bias)


@dataclass
class Model:
    """weights: a column for each family (one against the rest), then one for each pair of languages within a family."""

    families: list[str]
    languages: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        known = sorted(set(langs))
        families = sorted({FAMILY_OF.get(k, k) for k in known})
        languages = [[k for k in known if FAMILY_OF.get(k, k) == f] for f in families]
        pairs = [(f, a, b) for f, of in enumerate(languages) for a, b in combinations(range(len(of)), 2)]
        if not known:
            return cls([], [], [], np.zeros((DIMENSIONS, 0)), np.zeros(0))
        mean = x.mean(0, dtype=np.float64)
        scale = 1 / np.maximum(np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - mean**2, 0)), 1e-4)
        scale = (scale / np.sqrt(DIMENSIONS)).astype(np.float32)
        z, lang = (x * scale).astype(np.float32, copy=False), np.array(langs)
        fam = np.array([families.index(FAMILY_OF.get(k, k)) for k in langs])
        fits = []
        for f in range(len(families)):
            fits.append(svm(z, np.where(fam == f, 1, -1)) if len(families) > 1 else (np.zeros(z.shape[1]), 1.0))
        for f, a, b in pairs:
            rows = (lang == languages[f][a]) | (lang == languages[f][b])
            fits.append(svm(z[rows], np.where(lang[rows] == languages[f][a], 1, -1)))
        return cls(families, languages, pairs, np.array([w * scale for w, _ in fits]).T, np.array([b for _, b in fits]))

    def forget(self) -> None:
        self.cache, self.rows = {}, None

    def _score_words(self, words: list[str]) -> np.ndarray:
        """Places of the words' rows (sums of weights, number of grams) in self.rows."""
        new = set(words).difference(self.cache)
        if self.rows is None or len(self.cache) + len(new) > KEPT_WORDS:
            self.cache, new = {}, set(words)
            self.rows = np.zeros((1024, self.weights.shape[1] + 1))
        at = len(self.cache)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        names = list(new)
        for k in range(0, len(names), 4096):
            part = [grams(w) for w in names[k : k + 4096]]
            sizes = np.array([len(g) for g in part])
            flat = self.weights[np.concatenate(part)]
            self.rows[at : at + len(part), :-1] = np.add.reduceat(flat, np.cumsum(sizes) - sizes, axis=0)
            self.rows[at : at + len(part), -1] = sizes
            for n, w in enumerate(names[k : k + 4096], at):
                self.cache[w] = n
            at += len(part)
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def decisions(self, text: str | None) -> np.ndarray | None:
        """The classifiers' margins; None if there is no letter."""
        words = words_of(text)
        if not self.families or not any(c.isalpha() for w in words for c in w):
            return None
        total = np.zeros(self.weights.shape[1] + 1)
        for at in range(0, len(words), 50_000):
            total += self.rows_of(words[at : at + 50_000]).sum(0)
        return total[:-1] / total[-1] + self.bias

    def rows_of(self, words: list[str]) -> np.ndarray:
        places = self._score_words(words)
        return self.rows[places]

    def predict(self, text: str | None) -> tuple[str, float]:
        d = self.decisions(text)
        if d is None:
            return UNKNOWN, 0.0
        n = len(self.families)
        f = int(d[:n].argmax())
        of = self.languages[f]
        votes, margin = np.zeros(len(of)), np.zeros(len(of))
        for (g, a, b), m in zip(self.pairs, d[n:], strict=True):
            if g == f:
                votes[a if m > 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        best = max(range(len(of)), key=lambda k: (votes[k], margin[k]))
        rest = np.delete(d[:n], f)
        sure = [d[f] - rest.max() if n > 1 else 9.0]
        sure += [m if a == best else -m for (g, a, b), m in zip(self.pairs, d[n:], strict=True) if g == f and best in (a, b)]
        return of[best], float(1 / (1 + np.exp(-2 * min(max(min(sure), -20), 20))))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows where ``learn`` holds and the language is not null."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model.fit(np.zeros((0, DIMENSIONS)), [])
    sample = min(sample, max(1, SAMPLE_ALL // len(counts)))
    share = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n))))), F.col("lang"))
    taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "x": [vector(t).tobytes() for t in batch["text"]]})

    got = sorted((r["lang"], bytes(r["x"])) for r in taken.mapInPandas(vectors, "lang string, x binary").collect())
    langs = [k for k, _ in got]
    x = np.empty((len(got), DIMENSIONS), np.float32)
    for k in range(len(got) - 1, -1, -1):  # a row leaves the list as it enters the matrix
        x[k] = np.frombuffer(got.pop()[1], np.float32)
    return Model.fit(x, langs)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with the struct ``out_col`` of lang and score; only the text is read."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        holds_cache("language", own.forget)
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang", "score"])
        release(own.forget)

    # Told apart from plain functions, so that a filter on the result doesn't make Spark evaluate it twice.
    return docs.withColumn(out_col, predicted.asNondeterministic()(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents with a language: rows that are ``und`` or below ``least`` go, the others' lang is the one found."""
    found = identify(docs, model, out_col="__found").where((F.col("__found.lang") != UNKNOWN) & (F.col("__found.score") >= least))
    return found.withColumn("lang", F.col("__found.lang")).select(docs.columns)


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
