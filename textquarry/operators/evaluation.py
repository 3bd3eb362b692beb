"""Answer grading: quantities, polarity, expected facts, verdicts and reports."""
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import bounded_batches

# Unit classes, boundary words and modal words by polarity.
UNITS = {"%": "percent", "％": "percent", "万元": "wan", "亿元": "yi", "元": "yuan", "日": "day", "天": "day", "个月": "month", "月": "month", "年": "year", "人": "person", "家": "entity", "eur": "eur", "days": "day", "day": "day", "years": "year"}
BOUNDS = (("不低于", ">="), ("不少于", ">="), ("以上", ">="), ("不超过", "<="), ("不高于", "<="), ("超过", ">"), ("低于", "<"), ("少于", "<"), ("at least", ">="), ("at most", "<="), ("more than", ">"), ("less than", "<"))
POLARITY = (("不得", "no"), ("不应", "no"), ("不可以", "no"), ("禁止", "no"), ("不能", "no"), ("应当", "yes"), ("必须", "yes"), ("可以", "yes"), ("must not", "no"), ("may not", "no"), ("cannot", "no"), ("must", "yes"), ("shall", "yes"), ("may", "yes"), ("can", "yes"))
_QUANTITY = re.compile(r"(\d+(?:[.,]\d+)?)\s*(%|％|万元|亿元|元|个月|日|天|月|年|人|家|eur\b|days?\b|years?\b)?", re.IGNORECASE)
SHARE, HALF, FULL = 0.65, 0.5, 0.8


def quantities(text: str | None) -> list[tuple[float, str, str]]:
    """(value, unit class, operator) of the numbers; the eight characters before one decide its operator."""
    out = []
    for m in _QUANTITY.finditer(text or ""):
        before, after = text[max(0, m.start() - 10) : m.start()].lower(), text[m.end() : m.end() + 2]
        op = next((o for w, o in BOUNDS if w in before or w in after), "=")
        out.append((float(m[1].replace(",", ".")), UNITS.get((m[2] or "").lower(), ""), op))
    return out


def compatible(a: tuple[float, str, str], b: tuple[float, str, str]) -> bool:
    return abs(a[0] - b[0]) < 1e-9 and a[1] == b[1] and (a[2] == b[2] or "=" in (a[2], b[2]))


def polarity(text: str | None, first: int = 140) -> str:
    """That of the earliest modal word; the longer one of two at the same place."""
    head = _QUANTITY.sub(lambda m: " " * len(m[0]), (text or "")[:first].lower())
    for w, _ in BOUNDS:
        head = head.replace(w, " " * len(w))
    found = [(head.find(w), -len(w), p) for w, p in POLARITY if w in head]
    return min(found)[2] if found else ""


def plain(text: str) -> str:
    return re.sub(r"[^\w%]", "", text.lower())


def phrase_matches(phrase: str, answer: str) -> bool:
    a, b = plain(phrase), plain(answer)
    if not a or a in b:
        return True
    pairs = [a[k : k + 2] for k in range(len(a) - 1)]
    return bool(pairs) and sum(p in b for p in pairs) / len(pairs) >= SHARE


def facts(truth: str) -> list[str]:
    return list(dict.fromkeys(p.strip() for p in re.split(r"[。；;.\n，,、]", truth) if len(plain(p)) >= 2))


def question_type(question: str | None, truth: str | None) -> str:
    q, numeric = (question or "").lower(), bool(quantities(truth))
    if len(re.findall(r"[?？]", q)) > 1 or re.search(r"(?:以及|并且|同时|\band (?:what|which|how|who|when|is|can|may|must)\b)", q):
        return "compound"
    binary = bool(re.search(r"是否|能否|可否|吗[？?]|^(?:is|are|can|may|does|do|must)\b", q))
    if binary:
        return "binary_numeric" if numeric else "binary"
    if re.search(r"哪些|包括|which|list", q):
        return "enumeration"
    return "numeric" if numeric else "open"


def judge(answer: str | None, truth: str | None, question: str | None) -> tuple[str, float, bool, str]:
    """(verdict, coverage, polarity agrees, type)."""
    kind = question_type(question, truth)
    if not (answer or "").strip():
        return "no_answer", 0.0, False, kind
    want = facts(truth or "")
    coverage = sum(phrase_matches(f, answer) for f in want) / len(want) if want else 0.0
    expected, given = quantities(truth), quantities(answer)
    met = sum(any(compatible(e, g) for g in given) for e in expected)
    if expected and met < len(expected):
        coverage = min(coverage, met / len(expected))
    elif expected and len(want) <= 3:
        coverage = max(coverage, HALF)
    p, q = polarity(truth), polarity(answer)
    agrees = not p or not q or p == q
    if not agrees and kind.startswith(("binary", "compound")):
        return ("partial" if coverage >= HALF else "incorrect"), coverage, False, kind
    if coverage >= FULL or (kind == "binary" and p and p == q and coverage >= HALF):
        return "correct", coverage, agrees, kind
    return ("partial" if coverage >= HALF else "incorrect"), coverage, agrees, kind


JUDGED = "question_id long, verdict string, coverage double, polarity_match boolean, question_type string"


def judge_answers(answers: DataFrame) -> DataFrame:
    """answers: question_id, question, truth, answer."""

    def each(batches):
        for b in batches:
            rows = [(i, *judge(a, t, q)) for i, a, t, q in zip(b["question_id"], b["answer"], b["truth"], b["question"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in JUDGED.split(", ")])

    bounded_batches(answers.sparkSession)
    return answers.select("question_id", "question", "truth", "answer").mapInPandas(each, JUDGED)


def lifecycle(answers: DataFrame) -> DataFrame:
    """error, timeout, insufficient and empty answers are told apart before they are graded."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("answer", F.lit("")) == "", "no_answer").when(F.lower("answer").rlike("insufficient|依据不足|未检索到"), "insufficient").otherwise("answered")
    return answers.withColumn("status", status)


def verdict_report(judged: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts by section and verdict with all totals."""
    return judged.join(sections, "question_id").rollup("section", "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("section", F.lit("(all)")).alias("section"), F.coalesce("verdict", F.lit("(all)")).alias("verdict"), "n")


def canonical(text: str | None) -> str:
    """NFKC, lower case, no white space, and one word for modal words of equal force; longer words are replaced first."""
    t = "".join(unicodedata.normalize("NFKC", text or "").lower().split())
    for word, _ in sorted(MODAL_FORMS.items(), key=lambda x: -len(x[0])):
        t = t.replace(word, MODAL_FORMS[word])
    return t


#: Modal words that oblige, allow or forbid alike, by the word that stands for them.
MODAL_FORMS = {"必须": "应当", "须": "应当", "禁止": "不得", "不可以": "不得", "不应": "不得", "不能": "不得", "能够": "可以"}
STRUCTURE = (("conclusion", str), ("reasoning", str), ("basis", list))


def structure_issues(answer: object) -> list[str]:
    """What is wrong with an answer's form: fields that are missing, empty or of another kind, and basis entries without id or quote."""
    if not isinstance(answer, dict):
        return ["answer is no object"]
    out = [f"{name} is missing" for name, kind in STRUCTURE if name not in answer]
    out += [f"{name} is no {kind.__name__}" for name, kind in STRUCTURE if name in answer and not isinstance(answer[name], kind)]
    out += [f"{name} is empty" for name, kind in STRUCTURE if kind is str and isinstance(answer.get(name), str) and not answer[name].strip()]
    for k, entry in enumerate(answer["basis"] if isinstance(answer.get("basis"), list) else []):
        if not isinstance(entry, dict) or not entry.get("evidence_id") or not entry.get("quote"):
            out.append(f"basis {k} has no id or quote")
    return out
