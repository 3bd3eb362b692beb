"""The corpus as tables: projections, audits, keyed joins with gates, order-dependent columns, and sets.

All are DataFrame in, DataFrame out. A gate either returns the offending rows or, with ``required``, raises for them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import compact, nz, trimmed

from .retrieval import ranked


def _before(by: Sequence[str], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def required(bad: DataFrame, message: str) -> None:
    """Raises if there is a row, and names some of them."""
    if rows := bad.limit(5).collect():
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


# Projections and filters
def search_text(parts: Sequence[str | Column]) -> Column:
    """The text that is indexed: the parts that aren't empty, a line each; a part given twice counts twice."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), "\n")


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of ``defaults``: what they hold, else the default; missing columns are made."""
    return rows.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")).cast(rows.schema[k].dataType), v) if k in rows.columns else v for k, v in defaults.items()})


def refreshed(rows: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that ``fields`` (one row a key) has anew, numbered anew by chunk_index within the key."""
    new = [c for c in fields.columns if c != key]
    met = rows.drop(*new).join(fields, key)
    return met.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("chunk_index"))).select(rows.columns)


def named_like(rows: DataFrame, name: str, part: str, limit: int | None = None) -> DataFrame:
    """Rows whose name holds ``part``, in the order of the names, as many as asked for."""
    met = rows.where(F.contains(F.col(name), F.lit(part))) if part else rows
    return met.orderBy(name).limit(limit) if limit is not None else met


def without_excluded(rows: DataFrame, status: str, prefix: str = "excluded_") -> DataFrame:
    return rows.where(~F.coalesce(F.col(status), F.lit("")).startswith(prefix))


def selected(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted keys; an unknown one is an error."""
    required(wanted.select(key).join(rows, key, "left_anti"), f"unknown {key}")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, status: str, wanted: str | None, order: str, key: str) -> DataFrame:
    """Rows of a status (all for None) with their place from the newest on."""
    met = rows.where(F.col(status) == wanted) if wanted is not None else rows
    return met.withColumn("position", F.row_number().over(Window.partitionBy(status).orderBy(F.col(order).desc(), key)))


def only_cited(hits: Column, cited: Column, key: str) -> Column:
    """An array of hits without those that aren't cited."""
    return F.filter(hits, lambda h: F.array_contains(cited, h[key]))


# Aggregations
def rollup(chunks: DataFrame, by: str, chars: str, text: str, first: str) -> DataFrame:
    """Chunks, characters (the text's where none are stated) and the first id of each document."""
    n = F.when(F.coalesce(chars, F.lit(0)) == 0, F.length(text)).otherwise(F.col(chars))
    return chunks.groupBy(F.col(by).alias("document_id")).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(n).cast("long").alias("character_count"), F.min(first).alias("first_id"))


def document_frequency(terms: DataFrame, id_col: str, least: int = 1) -> DataFrame:
    """terms (id, term), repeats allowed."""
    return terms.select(id_col, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def duplicate_groups(rows: DataFrame, key: Column, owner: str) -> DataFrame:
    """(key, n, status) of keys held by several rows: review if more than one owner has it, else overlap.

    A group's members stay rows, see ``duplicate_members``; none is gathered into one.
    """
    groups = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(owner).alias("low"), F.max(owner).alias("high")).where("n > 1")
    return groups.select("key", "n", F.when(F.col("low") != F.col("high"), "review").otherwise("overlap").alias("status"))


def duplicate_members(rows: DataFrame, key: Column, owner: str, id_col: str) -> DataFrame:
    keyed = rows.select(id_col, key.alias("key"))
    return keyed.join(duplicate_groups(rows, key, owner), "key").select("key", "n", "status", id_col)


def audit_summary(groups: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return groups.agg(F.count(F.lit(1)).alias("groups"), n("review").alias("review_groups"), n("overlap").alias("overlap_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_in_groups"))


def body_hash(chunks: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """SHA-256 over the hashes of a document's chunks in order; what is gathered is one hash a chunk of one document."""
    each = chunks.select(by, order, F.sha2(compact(text), 256).alias("h"))
    return each.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), ""), 256).alias("body_hash"))


def length_stats(rows: DataFrame, by: str, chars: str, most: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(chars), 4).alias("mean"), F.median(chars).alias("median"), F.max(chars).alias("largest"), F.count(F.when(F.col(chars) > most, 1)).alias("oversized"))


def topic_scores(text: Column, topics: dict[str, Sequence[str]]) -> tuple[dict[str, Column], Column]:
    """How often the words of each topic occur, and the first topic that has the most; '' for none."""
    count = lambda w: ((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long")
    scores = {name: sum((count(w) for w in words[1:]), count(words[0])) for name, words in topics.items()}
    most = F.greatest(*scores.values(), F.lit(0).cast("long"))
    best = F.when(most == 0, "")
    for name, n in scores.items():
        best = best.when(n == most, name)
    return scores, best


def margin_lines(pages: DataFrame, by: str, page: str, text: str, edge: int = 2) -> DataFrame:
    """(by, line, n): lines among the first or last ``edge`` of so many pages that they are running heads.

    Two pages up to five pages, then a third of the pages, rounded up, and three at least.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    ends = F.array_distinct(F.concat(F.slice(lines, 1, edge), F.reverse(F.slice(F.reverse(lines), 1, edge))))
    count = pages.groupBy(by).agg(F.countDistinct(page).alias("pages"))
    seen = pages.select(by, page, F.explode(ends).alias("line")).groupBy(by, "line").agg(F.countDistinct(page).alias("n"))
    least = F.when(F.col("pages") <= 5, 2).otherwise(F.greatest(F.lit(3), F.floor((F.col("pages") + 2) / 3)))
    return seen.join(count, by).where(F.col("n") >= least).select(by, "line", "n")


def verdict_pivot(judged: DataFrame, by: str, verdicts: Sequence[str]) -> DataFrame:
    counts = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in verdicts]
    return judged.groupBy(by).agg(*counts, F.round(100 * F.count(F.when(F.col("verdict") == verdicts[0], 1)) / F.count(F.lit(1)), 2).alias(f"pct_{verdicts[0]}"))


def tag_counts(rows: DataFrame, id_col: str, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, tag, documents, evidence) over the tags of several dimensions in one pass."""
    tags = F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), c.alias("tag")) for d, c in dimensions.items())))
    return rows.select(id_col, tags).groupBy("dimension", "tag").agg(F.countDistinct(id_col).alias("documents"), F.count(F.lit(1)).alias("evidence"))


def shared_texts(rows: DataFrame, text: str, owner: str) -> DataFrame:
    """Texts that several owners have, each once."""
    g = rows.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(owner).alias("owners"))
    return g.where("n > 1 and n = owners").select("text_hash", "n")


def outcome_counts(rows: DataFrame, passed: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(passed, 1)).alias("passed"), F.count(F.when(~passed, 1)).alias("failed"))


def distinct_tags(rows: DataFrame, by: str, tag: str) -> DataFrame:
    return rows.select(by, tag).distinct().groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(tag)), ",").alias("tags"))


def level_counts(rows: DataFrame, level: Column) -> DataFrame:
    return rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


# Joins
def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """What a unique key's guard reports."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def referenced(rows: DataFrame, to: DataFrame, key: str) -> DataFrame:
    """Inner join in which every row must find its partner."""
    required(rows.select(key).join(to, key, "left_anti"), f"no partner by {key}")
    return rows.join(to, key)


def merged_lists(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both lists side by side; a key of one only has nulls for the other."""
    return left.join(right, key, "full")


def composite_match(rows: DataFrame, candidates: DataFrame, key: str, second: Column, second_of: str, id_col: str) -> DataFrame:
    """``rows`` with match_id and how: by key and second key if that is unique, by key alone if it is and no pair exists."""
    group = lambda *by: candidates.groupBy(*by).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    both = group(key, second_of).toDF(key, "__second", "__id2", "__n2")
    one = group(key).toDF(key, "__id1", "__n1")
    met = rows.withColumn("__own", second).join(both, (rows[key] == both[key]) & (F.col("__own") == F.col("__second")), "left").drop(both[key]).join(one, key, "left")
    n2, n1 = F.col("__n2"), F.col("__n1")
    how = F.when(n2 == 1, "both").when(n2.isNull() & (n1 == 1), "title").when(F.coalesce(n2, n1) > 1, "conflict").otherwise("none")
    return met.withColumn("how", how).withColumn("match_id", F.when(F.col("how") == "both", F.col("__id2")).when(F.col("how") == "title", F.col("__id1"))).drop("__own", "__second", "__id2", "__n2", "__id1", "__n1")


def known_basis(basis: DataFrame, active: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The basis entries that are active, each once, and those that aren't."""
    once = basis.dropDuplicates([c for c in basis.columns if c in ("answer_id", key)])
    return once.join(active, key, "left_semi"), once.join(active, key, "left_anti")


def carried_over(baseline: DataFrame, current: DataFrame, key: Column) -> DataFrame:
    """Baseline rows beside the current one of the same key; ``current_id`` is null where there is none, which a caller
    that demands a partner passes to ``required``. Both have id; of several current rows the smallest id counts."""
    now = current.select(key.alias("__k"), "id").groupBy("__k").agg(F.min("id").alias("current_id"))
    return baseline.withColumn("__k", key).join(now, "__k", "left").drop("__k")


def reuse(now: DataFrame, before: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """``now`` with status: reused, changed_reembedded or new_embedded."""
    old = before.select(key, F.col(hash_col).alias("__old"))
    status = F.when(F.col("__old").isNull(), "new_embedded").when(F.col("__old") == F.col(hash_col), "reused").otherwise("changed_reembedded")
    return now.join(old, key, "left").withColumn("status", status).drop("__old")


def embedded(now: DataFrame, before: DataFrame, key: str, embed) -> DataFrame:
    """(key, hash, vector): kept where key and hash are as before, else ``embed`` (a function of a DataFrame that adds vector)."""
    kept = now.select(key, "hash").join(before.select(key, "hash", "vector"), [key, "hash"])
    missing = now.join(before.select(key, "hash"), [key, "hash"], "left_anti")
    return kept.select(key, "hash", "vector").unionByName(embed(missing).select(key, "hash", "vector"))


# Order-dependent columns
def suffixed(rows: DataFrame, by: str, base: Column, order: str) -> DataFrame:
    """Ids of equal base within a document get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(by, "__base").orderBy(order))
    out = rows.withColumn("__base", base).withColumn("__n", n)
    return out.withColumn("id", F.concat("__base", F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise(""))).drop("__base", "__n")


def never_falling(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is that of no row before them exceeded."""
    return rows.withColumn("__most", F.max(value).over(_before([by], order))).where(F.col("__most").isNull() | (F.col(value) >= F.col("__most"))).drop("__most")


def carried_forward(by: str, order: str, value: Column) -> Column:
    """The last value that isn't null up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def out_of_sequence(rows: DataFrame, by: str, index: str) -> DataFrame:
    """Rows whose index isn't their place, counted from 1."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(index)).cast("long")).where(F.col("rn") != F.col(index))


def following(by: str, order: str, value: Column) -> Column:
    return F.lead(value).over(Window.partitionBy(by).orderBy(order))


def regressions(rows: DataFrame, by: str, order: str, value: str, scope: str) -> DataFrame:
    """Rows below the one before them in the same scope; a scope ends where its column changes."""
    w = Window.partitionBy(by).orderBy(order)
    changed = F.coalesce(F.lag(scope).over(w) != F.col(scope), F.lit(False)).cast("int")
    scoped = rows.withColumn("__changed", changed).withColumn("__scope", F.sum("__changed").over(w))
    return scoped.withColumn("__p", F.lag(value).over(Window.partitionBy(by, "__scope").orderBy(order))).where(F.col(value) < F.col("__p")).select(rows.columns)


def runs(rows: DataFrame, by: str, order: Sequence[str], key: str, jump: int) -> DataFrame:
    """Rising runs of a key: how many rows, from where to where, and how many steps beyond ``jump``."""
    w = Window.partitionBy(by).orderBy(*order)
    each = rows.withColumn("__p", F.lag(key).over(w)).withColumn("__down", F.when(F.col(key) < F.col("__p"), 1).otherwise(0)).withColumn("run", F.sum("__down").over(w))
    return each.groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.when(F.col(key) > F.col("__p") + jump, 1)).alias("gaps"))


def since(by: str, order: str, p: Column) -> Column:
    """Whether the predicate has held at the row or before."""
    return F.max(p).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def last_before(by: str, order: str, value: Column) -> Column:
    """The last value that isn't null before the row."""
    return F.last(value, ignorenulls=True).over(_before([by], order))


def caption(by: str, order: str, text: Column, most: int) -> Column:
    """The line above, if it is short enough to be a caption; '' if not."""
    above = F.lag(text).over(Window.partitionBy(by).orderBy(order))
    return F.when(F.length(above) <= most, above).when(above.isNotNull(), "")


# Sorts and sets
def prioritised(rows: DataFrame, by: str, first: Sequence[tuple[Column, Column]], id_col: str) -> DataFrame:
    """position: the groups of ``first`` (predicate, order within) in their order, then the rest, each by id at last."""
    group, within = F.lit(len(first)), F.lit("")
    for k, (p, order) in reversed(list(enumerate(first))):
        group, within = F.when(p, k).otherwise(group), F.when(p, order).otherwise(within)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(group, within, id_col)).cast("long"))


def missing_last(rows: DataFrame, by: str, value: Column, id_col: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(value.asc_nulls_last(), id_col)).cast("long"))


def ordered_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Each key once, with the number (src) of the first part that has it."""
    numbered = [p.select(key, F.lit(k).alias("src")) for k, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min("src").alias("src"))


def union_unique(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows of parts of one schema; a key that comes twice is an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    required(repeated_keys(out, key), f"{key} more than once")
    return out


def set_difference(rows: DataFrame, by: str, other: DataFrame, key: str) -> DataFrame:
    """(by, missing, shared): how many keys of each group ``other`` lacks and has."""
    held = other.select(key).distinct().withColumn("__held", F.lit(1))
    each = rows.select(by, key).distinct().join(held, key, "left")
    return each.groupBy(by).agg(F.count(F.when(F.col("__held").isNull(), 1)).alias("missing"), F.count("__held").alias("shared"))


def exact_set(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only left, keys only right, and the rows right; equal sets of unique keys give 0, 0 and their size."""
    a, b = left.select(key).distinct(), right.select(key)
    counts = [a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("only_left")), b.distinct().join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("only_right")), b.agg(F.count(F.lit(1)).alias("right_rows"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def reindexed(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("long"))


def upserted(rows: DataFrame, changes: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``value`` of ``changes`` where it has the key, else the default; status says which."""
    new = changes.select(key, F.col(value).alias("__new"), F.lit(True).alias("__in"))
    met = rows.join(new, key, "left")
    return met.withColumn(value, F.coalesce("__new", default)).withColumn("status", F.when(F.col("__in"), "updated").otherwise("kept")).drop("__new", "__in")


def top(rows: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    return ranked(rows, [by], list(order), n, "rn")


# Index bundle and its gates
def row_digests(corpus: DataFrame, id_col: str, text: Column, *keep: str) -> DataFrame:
    """SHA-256 of each (id, text) row, beside the columns to keep."""
    return corpus.select(id_col, *keep, F.sha2(F.concat_ws("\x01", F.col(id_col).cast("string"), text), 256).alias("digest"))


def fingerprint(digests: DataFrame) -> DataFrame:
    """One row: rows, and a hash that neither the order of the digests nor their partitions change.

    60 of every 64 bits of a digest are summed modulo 2**60, in four lanes.
    """
    lanes = [F.conv(F.substring("digest", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.pmod(F.sum(x), F.lit(1 << 60).cast("decimal(38,0)")).cast("string").alias(f"l{k}") for k, x in enumerate(lanes)]
    one = digests.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return one.select("rows", F.sha2(F.concat_ws("|", *(F.coalesce(f"l{k}", F.lit("0")) for k in range(4))), 256).alias("fingerprint"))


def input_fingerprint(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``fingerprint`` of what is embedded."""
    return fingerprint(row_digests(corpus, id_col, text))


def check_bundle(corpus: DataFrame, vectors: DataFrame, manifest: dict, id_col: str, text: Column, dimension: int) -> None:
    """Raises unless counts, fingerprint, ids and dimensions of a stored index are those of the corpus."""
    now = input_fingerprint(corpus, id_col, text).first()
    for name in ("rows", "fingerprint"):
        if manifest.get(name) != now[name]:
            raise ValueError(f"the index is stale: {name} was {manifest.get(name)}, is {now[name]}")
    required(corpus.select(id_col).join(vectors, id_col, "left_anti"), "no vector for")
    required(vectors.select(id_col).join(corpus, id_col, "left_anti"), "no chunk for")
    required(repeated_keys(vectors, id_col), "more than one vector for")
    required(vectors.where(F.size("vector") != dimension).select(id_col), "wrong dimension of")


def expanded_terms(terms: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Terms and, for each rule (pattern, additions) that some term matches, its additions, each once."""
    some = lambda pattern: F.exists(terms, lambda t: t.rlike(pattern))
    out = terms
    for pattern, more in rules:
        out = F.array_union(out, F.when(some(pattern), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def channel_queries(queries: Column, scope: Column) -> Column:
    """struct(keyword, semantic): the queries and the scoped one; for meaning, each query together with its sub-query."""
    scoped = F.when(F.size(scope) > 0, F.array(F.concat_ws(" ", F.get(queries, F.lit(0)), F.array_join(scope, " ")))).otherwise(F.array().cast("array<string>"))
    keyword = F.array_distinct(F.concat(queries, scoped))
    semantic = F.array_distinct(F.concat(F.transform(queries, lambda q: F.concat(q, F.lit(" "), q)), scoped))
    return F.struct(keyword.alias("keyword"), semantic.alias("semantic"))


def locator(page: Column, section: Column, block: Column) -> Column:
    """Where a block stands: what is known of page, section and block."""
    known = [F.when(page > 0, F.format_string("p. %d", page)), F.nullif(section, F.lit("")), F.when(block.isNotNull(), F.format_string("block %d", block))]
    return F.concat_ws(" / ", *known)


def latest_versions(rows: DataFrame, by: Sequence[str], order: str, keep: Column) -> DataFrame:
    """Rows with superseded: an older one of the same group, unless ``keep`` holds."""
    last = F.max(order).over(Window.partitionBy(*by))
    return rows.withColumn("superseded", (F.col(order) < last) & ~F.coalesce(keep, F.lit(False)))


def retry_delay(attempt: Column, status: Column, retry_after: Column) -> Column:
    """Seconds to wait before the next try, null for none: three tries on 429, 529 and 5xx; a stated wait counts up to ten."""
    again = ((status == 429) | status.between(500, 599)) & (attempt < 3)
    return F.when(again, F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(10.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(5.0))))


def pending(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return questions.join(done.select(key).distinct(), key, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) wherever two tables disagree; null equals null and ''."""
    other = right.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    found = F.array(*(F.when(nz(F.col(f).cast("string")) != nz(F.col(f"__{f}").cast("string")), F.lit(f)) for f in fields))
    return left.join(other, key).select(key, F.explode(F.array_compact(found)).alias("field"))
