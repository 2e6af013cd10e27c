"""Scores of recognised tables against truth, and summaries of a corpus."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import normalize_text
from ..sources.folders import stored
from .grid import CELL, DOC, MAX_SLOTS, let, rectangularize, unicode_trim

MAX_ROW_SHIFT, MAX_COL_SHIFT = 3, 2


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def four_digits(part: str, whole: str) -> Column:
    """The ratio of two whole numbers, at four digits; a tie goes to the even digit. Null over 0."""
    scaled = f"(10000 * cast({part} as bigint))"
    q, r = f"({scaled} div nullif({whole}, 0))", f"({scaled} % nullif({whole}, 0))"
    return F.expr(f"({q} + if(2 * {r} > {whole} or 2 * {r} = {whole} and {q} % 2 = 1, 1, 0)) / 10000D")


def _covered(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_id, n_rows, n_cols, got_rows, got_cols of each document of ``truth``, and of the rectangle that both grids
    cover: cells, equal, filled (in truth), filled_equal. Texts are trimmed.

    Only cells that are stored are looked at, dealt once by document; how many more are blank on both sides follows
    from the shapes."""
    text = lambda c: unicode_trim(F.coalesce(c, F.lit("")))
    none = F.lit(None).cast("string")
    sides = truth.select(*CELL, text(F.col("text")).alias("want"), none.alias("got"))
    sides = sides.unionByName(actual.select(*CELL, none.alias("want"), text(F.col("text")).alias("got")))
    # the window deals by document where cells don't lie so already, and the groups follow its order
    whole = W.partitionBy(DOC).orderBy("row_idx", "col_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    extent = lambda at, side: F.max(F.when(F.col(side).isNotNull(), F.col(at))).over(whole) + 1
    found = lambda at: F.coalesce(extent(at, "got"), F.lit(0))
    extents = {"n_rows": extent("row_idx", "want"), "n_cols": extent("col_idx", "want"), "got_rows": found("row_idx"), "got_cols": found("col_idx")}
    shaped = sides.withColumns(extents).groupBy(*CELL).agg(F.max("want").alias("want"), F.max("got").alias("got"), *(F.max(c).alias(c) for c in extents))
    want, got = (F.coalesce(F.col(c), F.lit("")) for c in ("want", "got"))
    both = (F.col("row_idx") < F.least("n_rows", "got_rows")) & (F.col("col_idx") < F.least("n_cols", "got_cols"))
    counted = shaped.where("n_rows is not null").groupBy(DOC, "n_rows", "n_cols", "got_rows", "got_cols").agg(
        _count(both & (want != "")).alias("filled"),
        _count(both & (want != "") & (want == got)).alias("filled_equal"),
        _count(both & ((want != "") | (got != ""))).alias("any_filled"),
    )
    size = (F.least("n_rows", "got_rows") * F.least("n_cols", "got_cols")).cast("long")
    equal = F.col("filled_equal") + size - F.col("any_filled")
    return counted.select(DOC, "n_rows", "n_cols", "got_rows", "got_cols", size.alias("cells"), equal.alias("equal"), "filled", "filled_equal")


def compare_cells(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Per document of ``truth`` the equal cells in the rectangle that both grids cover.

    Texts are trimmed. Rates have four digits and are null where no (non-empty) truth cell is covered."""
    same = (F.col("n_rows") == F.col("got_rows")) & (F.col("n_cols") == F.col("got_cols"))
    rates = {"rate": four_digits("equal", "cells"), "filled_rate": four_digits("filled_equal", "filled")}
    return _covered(truth, actual).withColumns({"shape_match": same} | rates)


def strict_exact_rate(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Equal cells over all truth cells; a cell outside the recognised grid is wrong."""
    cells = (F.col("n_rows") * F.col("n_cols")).cast("long")
    return _covered(truth, actual).select(DOC, cells.alias("cells"), "equal").withColumn("rate", F.col("equal") / F.col("cells"))


def _dense(cells: Column, side: str, n_rows: Column, n_cols: Column) -> Column:
    """All texts of one side of a document's grid, row by row, "" where it has no such cell."""
    own = F.transform(F.filter(cells, lambda x: x[side].isNotNull()), lambda x: F.struct((x["row_idx"] * n_cols + x["col_idx"]).alias("p"), x[side].alias("t")))
    blank = F.transform(F.array_except(F.sequence(F.lit(0), n_rows * n_cols - 1), F.transform(own, lambda x: x["p"])), lambda p: F.struct(p.alias("p"), F.lit("").alias("t")))
    return F.transform(F.sort_array(F.concat(own, blank)), lambda x: x["t"])


def best_alignment(truth: DataFrame, actual: DataFrame, max_row: int = MAX_ROW_SHIFT, max_col: int = MAX_COL_SHIFT) -> DataFrame:
    """The shift of the recognised grid with the best rate on the overlap; of equals the first by row, then column.

    Both grids of a document meet in one row, dealt once, and every shift looks its cells up there. So a
    document costs as many comparisons as shifts times cells, whatever its texts are, and makes no rows of them. A document
    whose grid claims more than ``MAX_SLOTS`` places has nulls for a shift."""
    text = lambda c: unicode_trim(F.coalesce(c, F.lit("")))
    none = F.lit(None).cast("string")
    sides = truth.select(*CELL, text(F.col("text")).alias("want"), none.alias("got"))
    sides = sides.unionByName(actual.select(*CELL, none.alias("want"), text(F.col("text")).alias("got")))
    whole = W.partitionBy(DOC).orderBy("row_idx", "col_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    extent = lambda at, side: F.max(F.when(F.col(side).isNotNull(), F.col(at))).over(whole) + 1
    shapes = {"n_rows": ("row_idx", "want"), "n_cols": ("col_idx", "want"), "got_rows": ("row_idx", "got"), "got_cols": ("col_idx", "got")}
    sides = sides.withColumns({k: extent(*v) for k, v in shapes.items()})
    cells = sides.groupBy(*CELL).agg(F.max("want").alias("want"), F.max("got").alias("got"), *(F.max(k).alias(k) for k in shapes))
    docs = cells.groupBy(DOC).agg(F.collect_list(F.struct("row_idx", "col_idx", "want", "got")).alias("cells"), *(F.max(k).alias(k) for k in shapes))
    docs = docs.where("n_rows is not null and got_rows is not null")
    n_rows, n_cols, got_rows, got_cols = (F.col(c) for c in shapes)
    small = (n_rows.cast("long") * n_cols <= MAX_SLOTS) & (got_rows.cast("long") * got_cols <= MAX_SLOTS)

    # the recognised grid gets margins left and right in which nothing is equal; a shift then moves every place by one number
    wide = got_cols + 2 * max_col
    place = lambda q, cols: ((q / cols).cast("int") * wide + q % cols + max_col).cast("int")
    wanted = F.transform(_dense(F.col("cells"), "want", n_rows, n_cols), lambda t, q: F.when(q % n_cols < got_cols + max_col, F.struct(place(q, n_cols).alias("p"), t.alias("t"))))
    inside = lambda q: (q % wide).between(max_col, max_col + got_cols - 1)
    margins = F.transform(F.filter(F.sequence(F.lit(0), got_rows * wide - 1), lambda q: ~inside(q)), lambda q: F.struct(q.alias("p"), F.lit(None).cast("string").alias("t")))
    found = F.transform(_dense(F.col("cells"), "got", got_rows, got_cols), lambda t, q: F.struct(place(q, got_cols).alias("p"), t.alias("t")))
    framed = F.transform(F.sort_array(F.concat(found, margins)), lambda x: x["t"])

    def rated(t: Column, a: Column, r: int, c: int) -> Column:
        """(rate, up, left, cells, equal) of one shift, null where nothing overlaps."""
        high, across = F.least(n_rows, got_rows - r) - max(-r, 0), F.least(n_cols, got_cols - c) - max(-c, 0)
        equal = let(wide * r + c, lambda by: F.size(F.filter(t, lambda x: F.get(a, x["p"] + by) == x["t"])))
        one = lambda e: F.struct((e / (high * across)).alias("rate"), F.lit(-r).alias("up"), F.lit(-c).alias("left"), (high * across).cast("long").alias("cells"), e.cast("long").alias("equal"))
        return F.when((high > 0) & (across > 0), let(equal, one))

    shifts = [(r, c) for r in range(-max_row, max_row + 1) for c in range(-max_col, max_col + 1)]
    best = let(F.struct(F.array_compact(wanted).alias("t"), framed.alias("a")), lambda g: let(g["t"], lambda t: let(g["a"], lambda a: F.array_max(F.array(*(rated(t, a, r, c) for r, c in shifts))))))
    best = docs.select(DOC, F.when(small, best).alias("best"))
    return best.select(DOC, (-F.col("best.up")).alias("row_shift"), (-F.col("best.left")).alias("col_shift"), "best.cells", "best.equal", "best.rate")


def mismatch_kind(expected: Column, actual: Column) -> Column:
    """How two texts differ, white space at their ends aside; the first that holds of these kinds."""
    as_they_are = expected == actual
    expected, actual = unicode_trim(expected), unicode_trim(actual)
    plain = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    digits = lambda c: F.regexp_replace(c, r"(?U)\D", "")
    e, a = digits(expected), digits(actual)
    both = (e != "") & (a != "")
    return (
        F.when(as_they_are, "same")
        .when(expected == actual, "same")
        .when(expected == "", "extra_text")
        .when(actual == "", "missing_text")
        .when(F.lower(expected) == F.lower(actual), "case_flip")
        .when(plain(expected) == plain(actual), "space_only")
        .when(e == a, "punct_swap")
        .when(both & a.contains(e) & (F.length(a) > F.length(e)), "digit_padded")
        .when(both & e.contains(a) & (F.length(a) < F.length(e)), "digit_missing")
        .otherwise("replaced_text")
    )


def mismatches(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """Places of the common rectangle with their kind of difference. Both sides of a place meet where their document lies."""
    none = F.lit(None).cast("string")
    sides = rectangularize(truth).select(*CELL, "text", none.alias("got"))
    sides = sides.unionByName(rectangularize(actual).select(*CELL, none.alias("text"), F.col("text").alias("got")))
    pairs = sides.groupBy(*CELL).agg(F.max("text").alias("text"), F.max("got").alias("got")).where("text is not null and got is not null")
    return pairs.withColumn("kind", mismatch_kind(F.col("text"), F.col("got")))


def mismatch_histogram(kinds: DataFrame) -> DataFrame:
    """Count per kind."""
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


def mismatch_samples(kinds: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` differing cells of each document."""
    order = F.row_number().over(W.partitionBy(DOC).orderBy("row_idx", "col_idx"))
    return kinds.where("kind <> 'same'").withColumn("sample", order).where(F.col("sample") <= k)


def classify_case(scored: DataFrame) -> DataFrame:
    """empty_result where nothing was recognised (its rate counts as 0), unscored without truth cells, else ok."""
    empty = F.col("got_rows") == 0
    status = F.when(empty, "empty_result").when(F.col("rate").isNull(), "unscored").otherwise("ok")
    return scored.withColumns({"status": status, "score": F.when(empty, 0.0).otherwise(F.col("rate"))})


def summarize_records(records: DataFrame) -> DataFrame:
    """Counts by status, shape matches and mean score of one corpus, in one row."""
    scored = F.col("status").isin("ok", "empty_result")
    return records.agg(
        F.count("*").alias("cases"),
        *(_count(F.col("status") == s).alias(s) for s in ("ok", "empty_result", "unscored")),
        _count(F.col("shape_match")).alias("shape_matches"),
        F.avg(F.when(scored, F.col("score"))).alias("mean_score"),
        F.sum("cells").alias("cells"),
        F.sum("equal").alias("equal"),
    )


def nearest_ranks(frame: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Per group the sorted value at rank round-half-even((n - 1) * share), in a column for each of ``shares``.

    Repeats are counted first. The distinct values are dealt by ranges of (group, value) and stored so; the ranges' counts
    tell in which one a rank lies, and only that range is ordered, so that no task orders a group. Nulls don't count."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, "part").agg(F.sum("n").alias("n"))
    listed = sizes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.sum("n").alias("total"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.rint((F.col("total") - 1) * share).cast("long").alias("rank")) for name, share in shares.items()))
    step = lambda seen, p: F.when(seen["part"].isNotNull(), seen).when(seen["rest"] < p["n"], F.struct(seen["rest"].alias("rest"), p["part"].alias("part"))).otherwise(F.struct((seen["rest"] - p["n"]).alias("rest"), seen["part"].alias("part")))
    place = lambda rank: F.aggregate("parts", F.struct(rank.alias("rest"), F.lit(None).cast("int").alias("part")), step)
    chosen = listed.select(*by, "parts", F.explode(asked).alias("a")).select(*by, "a.name", "a.rank", "parts").select(*by, "name", place(F.col("rank")).alias("at"))
    chosen = chosen.select(*by, "name", "at.rest", "at.part")
    plain = chosen.select(*(F.col(c).alias(f"__{c}") for c in by), "name", "rest", F.col("part").alias("__part"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("part") == F.col("__part")]
    within = ranged.join(plain, same).drop(*(f"__{c}" for c in by), "__part")
    upto = F.sum("n").over(W.partitionBy(*by, "name", "part").orderBy(value))
    hit = within.withColumn("upto", upto).where("upto > rest and upto - n <= rest")
    return hit.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in shares))


def nearest_rank(frame: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """``nearest_ranks`` of one share, as ``value``."""
    return nearest_ranks(frame, value, {"value": share}, by)


def bench_summary(records: DataFrame, latency: str = "seconds", memory: str = "mb", order: str = "case_no") -> DataFrame:
    """Mean scores, latency percentiles and tops, memory first, last and most, in one row."""
    whole = records.agg(
        F.avg("rate").alias("mean_rate"),
        F.avg("best_rate").alias("mean_best_rate"),
        F.max(latency).alias("latency_max"),
        _count(F.col(latency) > 60).alias("over_60"),
        F.min_by(memory, order).alias("memory_first"),
        F.max_by(memory, order).alias("memory_last"),
        F.max(memory).alias("memory_max"),
    )
    # both sides have one row
    return whole.crossJoin(nearest_ranks(records, latency, {"latency_p50": 0.5, "latency_p95": 0.95}, []))


def text_item_coverage(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Per document the share of truth items (doc_id, item) that the recognised text (doc_id, text) contains."""
    norm = normalize_text
    joined = items.where(norm(F.col("item")) != "").join(texts.select(DOC, "text"), DOC, "left")
    return joined.groupBy(DOC).agg(F.count("*").alias("items"), _count(F.coalesce(norm(F.col("text")).contains(norm(F.col("item"))), F.lit(False))).alias("found")).withColumn("coverage", F.col("found") / F.col("items"))


def number_set_metrics(pairs: DataFrame, truth: str = "truth_numbers", actual: str = "numbers") -> DataFrame:
    """Recall, precision and equality of two array columns of numbers; null where a denominator is 0."""
    t, a = F.array_distinct(truth), F.array_distinct(actual)
    both = F.size(F.array_intersect(t, a))
    return pairs.withColumns({"n_truth": F.size(t), "n_found": F.size(a), "recall": both / F.nullif(F.size(t), F.lit(0)), "precision": both / F.nullif(F.size(a), F.lit(0)), "equal_sets": (F.size(t) == F.size(a)) & (both == F.size(t))})


def sequence_similarity(one: str, other: str):
    """2 M / T of longest matching blocks of two text columns, truth first; null where either is null or the
    truth is empty. Texts are as long as they are: one pair at a time is compared."""
    # from so many characters on, difflib leaves frequent ones out of what it looks up
    autojunk = 200

    def matching(a: str, b: str) -> int:
        """Characters in the longest matching blocks of ``difflib`` for a ``b`` of under ``autojunk`` characters: of the longest
        blocks the first in a and then in b, and so on before and behind it. The search for a block is left to ``str.find``."""
        total, open_ = 0, [(0, len(a), 0, len(b))]
        while open_:
            alo, ahi, blo, bhi = open_.pop()
            i = at = alo
            size, place = 0, blo
            while i + size < ahi and size < bhi - blo:
                j = b.find(a[i : i + size + 1], blo, bhi)
                if j < 0:
                    i += 1
                else:
                    at, place, size = i, j, size + 1
            if size:
                total += size
                if alo < at and blo < place:
                    open_.append((alo, at, blo, place))
                if at + size < ahi and place + size < bhi:
                    open_.append((at + size, ahi, place + size, bhi))
        return total

    def alike(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if len(y) >= autojunk:
            return SequenceMatcher(None, x, y).ratio()
        return 2.0 * matching(x, y) / (len(x) + len(y))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) if x and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(F.col(one), F.col(other))


def edits(one: str, other: str, near: int = 16) -> Column:
    """The edit distance of two text columns, null where either is null. Most are at most ``near`` apart, which a band of
    the table of prefixes tells; only others take the whole table."""
    few = F.levenshtein(one, other, near)
    return F.when(few >= 0, few).otherwise(F.levenshtein(one, other))


def scope_metrics(scores: DataFrame) -> DataFrame:
    """A presence-only scope has no text metrics; the semantic scope is scored on its nested truth."""
    blank = F.col("scope") == "presence"
    pick = F.when(blank, None).when(F.col("scope") == "semantic", F.col("semantic_score")).otherwise(F.col("text_score"))
    return scores.withColumn("score", pick)


def photo_gate(truth: DataFrame, ambiguous: DataFrame, actual: DataFrame, rate: float = 0.97, wrong: int = 4, silent: int = 0) -> DataFrame:
    """Per document wrong and silently wrong (wrong and not flagged) cells, and whether the gate passes.

    Ambiguous cells don't count, texts aren't trimmed, a missing cell is "" and not flagged."""
    judged = truth.select(*CELL, "text").join(ambiguous.select(*CELL), list(CELL), "left_anti")
    pairs = judged.join(actual.select(*CELL, F.col("text").alias("got"), "needs_review"), list(CELL), "left")
    bad = F.col("text") != F.coalesce("got", F.lit(""))
    quiet = bad & ~F.coalesce("needs_review", F.lit(False))
    found = pairs.groupBy(DOC).agg(F.count("*").alias("cells"), _count(bad).alias("wrong"), _count(quiet).alias("silent_wrong")).withColumn("rate", (F.col("cells") - F.col("wrong")) / F.col("cells"))
    return found.withColumn("passes", (F.col("rate") >= rate) & (F.col("wrong") <= wrong) & (F.col("silent_wrong") <= silent))


def head_to_head(base: DataFrame, candidate: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Regression where a case was ok and isn't, or its rate fell by more than ``tolerance``; else same, or unmatched."""
    side = lambda f, p: f.select(DOC, F.col("status").alias(f"{p}_status"), F.col("rate").alias(f"{p}_rate"))
    both = side(base, "base").join(side(candidate, "new"), DOC, "full_outer")
    lost = F.col("base_status").isNull() | F.col("new_status").isNull()
    worse = ((F.col("base_status") == "ok") & (F.col("new_status") != "ok")) | F.coalesce(F.col("base_rate") - F.col("new_rate") > tolerance, F.lit(False))
    return both.withColumn("verdict", F.when(lost, "unmatched").when(worse, "regression").otherwise("same"))


def per_source_counts(records: DataFrame, source: str = "source") -> DataFrame:
    """J16."""
    return records.groupBy(source).agg(F.count("*").alias("n"))


def environment_fingerprint(records: DataFrame, mode: str, order: str) -> DataFrame:
    """Modes in first-seen order, whether mixed, and the one mode, "mixed" or "unknown"."""
    seen = records.where(F.col(mode).isNotNull()).groupBy(mode).agg(F.min(order).alias("first"))
    listed = seen.agg(F.transform(F.sort_array(F.collect_list(F.struct("first", mode))), lambda x: x[mode]).alias("modes"))
    n = F.size("modes")
    return listed.withColumns({"mixed": n > 1, "mode": F.when(n == 0, "unknown").when(n > 1, "mixed").otherwise(F.get("modes", 0))})


def selected_vs_recorded(selected: DataFrame, recorded: DataFrame) -> DataFrame:
    """How many selected documents have a record, and how many were lost."""
    lost = selected.select(DOC).distinct().join(recorded.select(DOC).distinct().withColumn("has", F.lit(True)), DOC, "left")
    return lost.agg(F.count("*").alias("selected"), F.count("has").alias("recorded"), _count(F.col("has").isNull()).alias("lost"))


def review_cells_per_case(cells: DataFrame) -> DataFrame:
    """J19."""
    return cells.groupBy(DOC).agg(_count(F.col("needs_review")).alias("review_cells"))
