"""Line dedup against a brute force that keeps the lines no kept line is near to."""
import random
import re

import pytest

from textquarry.llm.lines import MIN_WORDS, dedup_lines, op8_line_dedup

UNSPACED = re.compile("([฀-໿぀-ヿ一-鿿])")


def distance(a, b):
    """Levenshtein over words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(rows, edits=1):
    """Kept (row, line) by place; rows equal in doc_id and text count once."""
    from collections import OrderedDict

    exact, near, kept = set(), [], OrderedDict()
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((key[1] or "").split("\n")):
            w = UNSPACED.sub(r" \1 ", line).lower().split()
            if not w:
                kept[key, i] = True
                continue
            if tuple(w) in exact:
                continue
            exact.add(tuple(w))
            if len(w) - len(UNSPACED.findall(line)) / 2 >= MIN_WORDS:
                if edits and any(abs(len(o) - len(w)) <= 1 and distance(w, o) <= 1 for o in near):
                    continue
                near.append(w)
            kept[key, i] = True
    return kept


def expected(rows, edits=1):
    kept = brute(rows, edits)
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if ((i, t), k) in kept)) for i, t in rows), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))] for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(4):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                at = rng.randrange(len(w))
                rng.choice((lambda: len(w) > 1 and w.pop(at), lambda: w.insert(at, rng.choice("xyz")), lambda: w.__setitem__(at, rng.choice("xyz"))))()
            lines.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (1, 0):
        assert sorted(((r.doc_id, r.text) for r in dedup_lines(docs, edits=edits).collect()), key=str) == expected(rows, edits)


def test_chain_keeps_what_only_a_dropped_line_is_near_to(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e X"), (3, "a b c d Y X"), (4, "a b c Z Y X"), (5, "a b W Z Y X")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: "", 5: rows[4][1]}


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    changed = long.replace("w1500 ", "other ")
    rows = [(None, "one two three four five"), (1, None), (2, ""), (3, "One two  three four FIVE\nshort\n\t"), (4, long), (5, changed + "\n" + long), (5, changed + "\n" + long), (6, "short\n\nshort\r"), (7, "一二三四五六七八九十\n一二三四五六七八九百\nhello hello hello hello hello\nhello hello hello hello")]
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, __mask string, n_chars long, __kept string")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(docs).collect()), key=str)
    assert got == expected(rows)
    assert {r.n_chars for r in dedup_lines(docs).where("doc_id = 4 or doc_id = 5").collect()} == {7, 0}
    assert dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs, edits=2)


def test_query(spark, tmp_path):
    rows = [(1, "a b c d e\n\nx"), (2, "a b c d Z\nx\nnew line"), (3, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1, "2"), 2: (3, 2, "0,1"), 3: (0, 0, ""), None: (1, 0, "")}
