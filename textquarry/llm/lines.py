"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is compared by its words: lower case, split at ASCII white space, and each character of a script that writes no spaces
between words (``UNSPACED``) is a word of its own. The edit distance counts words replaced, inserted or deleted; the bound
``edits`` is 0 (equal lines only) or 1. Beyond 1 the lines of a variant are no longer near to each other, and a group
couldn't be settled without pairing its members, so a larger bound is refused.

Lines are taken in the order of (doc_id, hash of the text, number of the line). A line goes if an equal line stands earlier,
or if a line that itself stays is near it and stands earlier; a blank line always stays. Lines below ``min_words`` words (a
character of ``UNSPACED`` counts as half a word) say too little to be called near: of them, only equal ones go.

Equal lines are one first, by 128 bits of hash. Near lines are found through the variants with one word deleted, whose keys
come from an exclusive or of position-keyed word hashes, so that all variants of a line cost a time in proportion to its
words. Lines that share the variant and the place of the deleted word are all near each other; a line that is itself the
variant of another one is near it. Each member of such a group is verified on the words, against one witness of the group.

Variants are emitted only where they can meet: two near lines share the first or the last q words, q being half the shorter
one's length, so these parts are counted first (a pigeonhole filter that loses nothing), and only words outside a shared
part are deleted. Bit tables of 2**BITS bits keep other rows off the shuffles; they let some rows too many through, never
too few, and are left out where so many keys are wanted that they would let nearly all through.

Which near lines stay is settled in rounds: a line that no undecided earlier line is near to stays, and those near it go.
A round is a few aggregations by group; most lines are settled in the first, and a chain of near lines takes as many as it
has links that depend on each other.

Defined results: null text stays null and has no lines; a null doc_id sorts before all others; rows equal in doc_id and
text keep the same lines; a text whose lines all go becomes empty, its row stays; an empty table gives an empty one; other
columns pass through, whatever their names, and ``n_chars`` follows the text where that column exists.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, table

MIN_WORDS, EDITS = 5, 1
BITS = 25
_SPACE = " \t\r\x0b\f"
# Han, kana, Thai, Lao, Khmer and Burmese as ranges, behind one that most characters fail.
UNSPACED = r"[\x{0E00}-\x{3FFFF}&&[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}\x{20000}-\x{3FFFF}]]"


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE)) == ""


def _normal(rows: DataFrame, *others: str) -> DataFrame:
    """low: ``text`` in lower case, with one space for each run of white space but line breaks and around each character of
    ``UNSPACED``; unspaced: whether it has such. Steps of their own, so that no expression is computed twice."""
    unspaced = F.when(F.octet_length("text") == F.length("text"), False).otherwise(F.col("text").rlike(UNSPACED))
    rows = rows.select(*others, F.lower("text").alias("low"), unspaced.alias("unspaced"))
    rows = rows.withColumn("low", F.when(F.col("unspaced"), F.regexp_replace("low", f"({UNSPACED})", " $1 ")).otherwise(F.col("low")))
    odd = F.col("low").contains("  ")
    for c in _SPACE[1:]:
        odd = odd | F.col("low").contains(c)
    return rows.withColumn("low", F.when(odd, F.regexp_replace("low", r"[ \t\r\x0B\f]+", " ")).otherwise(F.col("low")))


def _hashes(x: str) -> list[Column]:
    return [F.xxhash64(x).alias("lh"), F.xxhash64(x, F.lit(1)).alias("lh2")]


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each distinct line: lh, lh2, at (its first place), n, and the hashes of its first and last words.

    first, last: of half the words; first_less, last_less: of one word less, where that is half of a line shorter by one.
    All four are null below ``min_words``.
    """
    rows = _normal(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")), "doc_id", "th")
    rows = rows.select("doc_id", "th", "unspaced", F.posexplode(F.split("low", "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "th", "line_no", "unspaced", F.btrim("line").alias("x")).where("x != ''")
    rows = rows.select("*", *_hashes("x"), (F.octet_length("x") - F.octet_length(F.replace("x", F.lit(" "), F.lit(""))) + 1).alias("n"))
    halves = F.when(F.col("unspaced"), (F.length("x") - F.length(F.regexp_replace("x", UNSPACED, ""))) / 2).otherwise(0)
    enough = F.col("n") - halves >= min_words
    q = F.floor(F.col("n") / 2).cast("int")

    def part(words: Column, where: Column) -> Column:
        return F.when(enough & where, F.xxhash64(F.call_function("substring_index", F.col("x"), F.lit(" "), words)))

    always, even = F.lit(True), F.col("n") % 2 == 0
    rows = rows.select(
        "lh", "lh2", F.struct("doc_id", "th", "line_no").alias("at"), "n",
        part(q, always).alias("first"), part(-q, always).alias("last"), part(q - 1, even).alias("first_less"), part(1 - q, even).alias("last_less"),
    )
    return rows.groupBy("lh", "lh2").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in rows.columns[3:]))


def _slot_and_bit(name: str) -> tuple[Column, Column]:
    bit = F.pmod(F.col(name), F.lit(1 << BITS))
    return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def _maybe_in(rows: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """``rows`` whose hash may occur in the stored table ``of``; none that does is lost."""
    if of.count() > 1 << (BITS - 1):
        return rows  # the table would be half full and more
    slot, one = _slot_and_bit(name)
    bits = of.select(slot.alias("slot"), one.alias("one")).groupBy("slot").agg(F.bit_or("one").alias("bits"))  # at most 2**(BITS - 6) rows
    return rows.join(F.broadcast(bits), (slot == F.col("slot")) & (F.col("bits").bitwiseAND(one) != 0), "left_semi")


def _parts(lines: DataFrame) -> DataFrame:
    """(lh, lh2, at, n, key, last, q): a row for each shared-part key of a line."""
    q = F.floor(F.col("n") / 2).cast("int")
    kinds = F.array(*(F.struct(F.xxhash64(c, F.lit(c.startswith("last"))).alias("key"), F.col(c).alias("h"), F.lit(c.startswith("last")).alias("last"), (q - less).alias("q")) for c, less in (("first", 0), ("last", 0), ("first_less", 1), ("last_less", 1))))
    return lines.where("first is not null").select("lh", "lh2", "at", "n", F.explode(kinds).alias("k")).where("k.h is not null").select("lh", "lh2", "at", "n", "k.key", "k.last", "k.q")


def _candidates(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that share a part with another: id, lh, lh2, at, n, first_q, last_q (words of the shared parts) and the words."""
    keys = _parts(lines)
    met = stored(keys.groupBy("key").count().where("count > 1").select("key"))
    of = _maybe_in(keys, met, "key").join(met, "key", "left_semi")
    flags = of.groupBy("lh", "lh2").agg(F.first("at").alias("at"), F.first("n").alias("n"), F.min(F.when(~F.col("last"), F.col("q"))).alias("first_q"), F.min(F.when(F.col("last"), F.col("q"))).alias("last_q"))
    flags = stored(flags.withColumn("place", F.xxhash64("at.doc_id", "at.th", "at.line_no")))
    # The words of their first occurrences; other lines are left out by their place, before they are cut into words.
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    text = _maybe_in(text.select(F.xxhash64("doc_id", "th", "line_no").alias("place"), "text"), flags, "place")
    text = _normal(text, "place").select("place", F.btrim("low").alias("x")).select("place", *_hashes("x"), F.split("x", " ").alias("words"))
    met = text.join(flags, ["place", "lh", "lh2"]).dropDuplicates(["lh", "lh2"]).drop("place")
    return stored(met.withColumn("id", F.monotonically_increasing_id()))


def variants(lines: DataFrame) -> DataFrame:
    """(key, i, id): a line's words without the word at i, for i = -1 all of them, as a hash with their number."""
    each = lines.select("id", "n", "first_q", "last_q", F.posexplode("words").alias("i", "w"))
    each = each.select("id", "n", "first_q", "last_q", "i", F.xxhash64("w", "i").alias("own"), F.xxhash64("w", F.col("i") - 1).alias("moved"))
    line = Window.partitionBy("id").orderBy("i")
    own = F.coalesce(F.bit_xor("own").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.coalesce(F.bit_xor("moved").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    each = each.withColumns({"before": own, "upto": moved})
    whole = lines.select(F.col("id").alias("of"), F.aggregate("words", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("moved")),
        lambda s, w: F.struct((s["i"] + 1).alias("i"), s["own"].bitwiseXOR(F.xxhash64(w, s["i"])).alias("own"), s["moved"].bitwiseXOR(F.xxhash64(w, s["i"] - 1)).alias("moved"))).alias("all"), "n")
    n, i = F.col("n"), F.col("i")
    # The same first words leave edits behind them, the same last words edits before them.
    free = F.coalesce(i >= F.col("first_q"), F.lit(False)) | F.coalesce(i < n - F.col("last_q"), F.lit(False))
    cut = each.where(free).join(whole.select("of", "all"), F.col("id") == F.col("of"))
    cut = cut.select(F.xxhash64(F.col("before").bitwiseXOR(F.col("upto")).bitwiseXOR(F.col("all.moved")), n - 1).alias("key"), "i", "id")
    return cut.unionByName(whole.select(F.xxhash64("all.own", n).alias("key"), F.lit(-1).alias("i"), F.col("of").alias("id")))


def without(words: Column, i: Column) -> Column:
    """The words but the one at i, from 0; for -1 all."""
    return F.when(i < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))))


def near_groups(candidates: DataFrame) -> DataFrame:
    """(g, i, id, at): verified groups of lines; of a group, those with one i >= 0 are near each other, and all to that with -1."""
    group = Window.partitionBy("key")
    met = variants(candidates).select("*", F.min("id").over(group).alias("low"), F.max("id").over(group).alias("high")).where("low < high")
    # One member of the group is the witness whose variant all others must have.
    met = stored(met.select("key", "i", "id", F.min(F.struct("id", "i")).over(group).alias("witness")))
    words = candidates.select("id", "at", "words")
    sides = met.join(words, "id").join(words.select(F.col("id").alias("wid"), F.col("words").alias("witness_words")), F.col("witness.id") == F.col("wid"))
    same = without(F.col("words"), F.col("i")) == without(F.col("witness_words"), F.col("witness.i"))
    return sides.where(same).select(F.col("key").alias("g"), "i", "id", "at")


def near_dropped(groups: DataFrame) -> DataFrame | None:
    """The ids of the lines that go, by rounds over the groups; None if there are none."""
    dropped = None
    left = stored(groups)
    while not left.isEmpty():
        key, place = Window.partitionBy("g"), Window.partitionBy("g", "i")
        who = F.struct("at", "id")
        whole, cut = F.min(F.when(F.col("i") < 0, who)).over(key), F.min(F.when(F.col("i") >= 0, who)).over(key)
        near = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("whole", "lead"))
        rows = left.select("*", whole.alias("whole"), cut.alias("cut"), F.min(who).over(place).alias("lead")).select("g", "i", "id", "at", near.alias("by"))
        rows = stored(rows.select("g", "i", "id", "at", F.when(F.col("by.at") < F.col("at"), F.col("by.id")).alias("by")))
        stays = stored(rows.groupBy("id").agg(F.max("by").alias("by")).where("by is null").select("id"))
        gone = stored(rows.where("by is not null").join(stays.withColumnRenamed("id", "by"), "by", "left_semi").select("id").distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        left = stored(left.join(stays.unionByName(gone), "id", "left_anti"))
    return dropped


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, edits: int = EDITS) -> DataFrame:
    """(doc_id, th, kept): for each text with lines that aren't blank, the numbers of those that stay, sorted."""
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    lines = stored(distinct_lines(docs, id_col, text_col, min_words))
    places = lines.select("at.*", F.lit(True).alias("stays"))
    if edits:
        candidates = _candidates(docs, lines, id_col, text_col)
        gone = near_dropped(near_groups(candidates))
        if gone is not None:
            places = places.unionByName(candidates.join(gone, "id", "left_semi").select("at.*", F.lit(False).alias("stays")))
    numbers = lambda p: F.collect_list(F.when(p, F.col("line_no")))
    kept = places.groupBy("doc_id", "th").agg(numbers(F.col("stays")).alias("first"), numbers(~F.col("stays")).alias("gone"))
    return kept.select("doc_id", "th", F.sort_array(F.array_except("first", "gone")).alias("kept"))


def _goes(kept: str) -> Column:
    """A binary string with 1 at the numbers of ``kept``; a line that isn't blank goes where it has none."""
    step = F.transform(kept, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get(kept, i - 1), F.lit(-1)) - 1), F.lit("1")))
    return F.coalesce(F.array_join(step, ""), F.lit("")).cast("binary")


def _with_kept(docs: DataFrame, th: Column, kept: DataFrame, id_col: str, mask: str) -> DataFrame:
    """``docs`` with the mask of the lines that stay."""
    names = [fresh(docs, f"__{c}") for c in ("doc_id", "th", "kept", "own")]
    kept = kept.toDF(*names[:3])
    met = docs.withColumn(names[3], th).join(kept, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.col(names[3]) == F.col(names[1])), "left")
    return met.withColumn(mask, _goes(names[2])).drop(*names)


def _stays(mask: str, i: Column) -> Column:
    return F.substring(mask, i + 1, F.lit(1)) == F.lit("1").cast("binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, edits: int = EDITS) -> DataFrame:
    """``docs`` without the lines that an equal line, or a near one that stays, precedes."""
    mask, text = fresh(docs, "__mask"), fresh(docs, "__text")
    marked = _with_kept(docs, F.xxhash64(text_col), kept_lines(docs, id_col, text_col, min_words, edits), id_col, mask)
    out = marked.withColumn(text, F.array_join(F.filter(F.split(text_col, "\n"), lambda line, i: _blank(line) | _stays(mask, i)), "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.octet_length(text) < F.octet_length(text_col), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn(text_col, F.col(text)).select(docs.columns)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the dropped lines' numbers from 0, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    full = F.filter(F.transform(F.split("text", "\n"), lambda line, i: F.when(~_blank(line), i)), lambda i: i.isNotNull())
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), n_lines.alias("n_lines"), F.coalesce(full, F.array().cast("array<int>")).alias("full"))
    met = _with_kept(own, F.col("h"), kept_lines(docs), "doc_id", "mask")
    found = F.filter("full", lambda i: ~_stays("mask", i))
    return met.select("doc_id", "n_lines", F.size(found).cast("long").alias("n_dropped"), F.array_join(found.cast("array<string>"), ",").alias("dropped_lines"))
