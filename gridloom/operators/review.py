"""Cell confidence and review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .grid import CELL, DOC, unicode_trim

#: The two marker confidences, how near counts as one, and the review threshold.
SENTINELS = (0.77, 0.86)
NEARNESS = 1e-9
THRESHOLD = 0.78
#: Characters that stand for an unreadable glyph.
UNKNOWN_GLYPHS = "[\\x{FFFD}\\x{25A1}]"


def has_type_suffix(number: Column) -> Column:
    """Whether a text that casts to a number ends like a literal of a programming language (0.77f, 5d): no number here. What
    is no text doesn't; that follows from the type, and no number is written out for it."""
    return (F.typeof(number) == "string") & number.cast("string").rlike(r"[0-9.][dDfF]\s*$")


def is_sentinel(confidence: Column) -> Column:
    """A number, or a text that is one, at a marker value."""
    c = confidence.try_cast("double")
    near = (F.abs(c - SENTINELS[0]) < NEARNESS) | (F.abs(c - SENTINELS[1]) < NEARNESS)
    return F.coalesce(near & ~has_type_suffix(confidence), F.lit(False))


def sentinel_flag(flag: Column, confidence: Column) -> Column:
    """The cell's own flag, or else its confidence, tells."""
    return F.coalesce(flag, is_sentinel(confidence))


def read_confidence(raw: Column) -> Column:
    """Struct of confidence and error, of a JSON value's raw text: missing, true, false and non-finite read as 1;
    other than a number or a numeric string is an error."""
    inner = F.regexp_replace(raw, r'^"|"$', "")
    c = F.when(~has_type_suffix(inner), inner.try_cast("double"))
    plain = raw.isNull() | raw.isin("null", "true", "false") | c.isNaN() | (F.abs(c) == float("inf"))
    return F.struct(F.when(plain, 1.0).otherwise(c).alias("confidence"), (~F.coalesce(plain, F.lit(False)) & c.isNull()).alias("error"))


def needs_review(text: Column, confidence: Column) -> Column:
    """The rule of E4."""
    blank = unicode_trim(text) == ""
    return (confidence < 0) | ((confidence != 0) & (confidence < THRESHOLD) & (blank | ~is_sentinel(confidence)))


def build_result(cells: DataFrame) -> DataFrame:
    """Cells with clamped confidence, review and marker flags; the marker is judged on the clamped value."""
    c = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    return cells.withColumns({"needs_review": needs_review(F.col("text"), F.col("confidence")), "confidence_sentinel": is_sentinel(c), "confidence": c})


def requires_attention(review: Column, sentinel: Column, confidence: Column, text: Column) -> Column:
    """E5, and E6 at export: flagged, or low without being a marker, with text."""
    return review | (~sentinel & (confidence < THRESHOLD) & (unicode_trim(text) != ""))


def requires_human_confirmation(text: Column, confidence: Column) -> Column:
    """Negative confidence, an unknown glyph, or text without confidence."""
    return (confidence < 0) | text.rlike(UNKNOWN_GLYPHS) | ((unicode_trim(text) != "") & (confidence <= 0))


def cell_label(row: Column, col: Column) -> Column:
    """``R1C1`` for the first cell."""
    part = lambda at: F.coalesce((at.cast("long") + 1).cast("string"), F.lit("null"))
    return F.concat(F.lit("R"), part(row), F.lit("C"), part(col))


def pending_labels(cells: DataFrame) -> DataFrame:
    """Per document the labels of flagged cells in reading order, and how many."""
    flagged = cells.where("needs_review").select(DOC, F.struct("row_idx", "col_idx", cell_label(F.col("row_idx"), F.col("col_idx")).alias("label")).alias("at"))
    return flagged.groupBy(DOC).agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["label"]).alias("labels"), F.count("*").alias("n_pending"))


def labels_of_documents(cells: DataFrame) -> DataFrame:
    """doc_id, labels: E8's labels of every document, none where no cell is flagged."""
    flagged = F.when(F.col("needs_review"), F.struct("row_idx", "col_idx"))
    found = cells.groupBy(DOC).agg(F.sort_array(F.collect_list(flagged)).alias("at"))
    return found.select(DOC, F.transform("at", lambda x: cell_label(x["row_idx"], x["col_idx"])).alias("labels"))


def refresh_sentinels(cells: DataFrame) -> DataFrame:
    """Marker flags by the final confidence."""
    return cells.withColumn("confidence_sentinel", is_sentinel(F.col("confidence")))


def confidence_at(places: DataFrame, grid: DataFrame, default: float = 1.0) -> DataFrame:
    """Confidence of each asked place (doc_id, row_idx, col_idx), ``default`` where the grid has none."""
    return places.join(grid.select(*CELL, "confidence"), list(CELL), "left").withColumn("confidence", F.coalesce("confidence", F.lit(default)))


def review_counts(cells: DataFrame) -> DataFrame:
    """Per document flagged cells and their share."""
    return cells.groupBy(DOC).agg(F.count_if("needs_review").alias("review_cells"), (F.count_if("needs_review") / F.count("*")).alias("review_share"))


def unconfirmed(cells: DataFrame) -> DataFrame:
    """Cells with some confidence under the threshold; a notice, which blocks nothing."""
    return cells.where((F.col("confidence") > 0) & (F.col("confidence") < THRESHOLD))


def ambiguity_guard(cells: DataFrame) -> DataFrame:
    """A number with a leading zero gets no more than the lower marker; ``ambiguous`` lists it."""
    odd = F.col("text").rlike(r"^0\d+$")
    return cells.withColumns({"ambiguous": odd, "confidence": F.when(odd, F.least("confidence", F.lit(SENTINELS[0]))).otherwise(F.col("confidence"))})


def mark_unreviewed(cells: DataFrame, selected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Selected cells that missed their review and hold text get confidence -1."""
    missed = selected.select(*CELL).join(reviewed.select(*CELL), list(CELL), "left_anti").distinct().withColumn("missed", F.lit(True))
    low = F.col("missed") & (F.col("text") != "")
    return cells.join(missed, list(CELL), "left").withColumn("confidence", F.when(low, -1.0).otherwise(F.col("confidence"))).drop("missed")


def blank_unverified_numbers(cells: DataFrame, verified: DataFrame) -> DataFrame:
    """A number that wasn't verified is blanked with confidence -1; ``blanked`` counts it per document."""
    ok = verified.select(*CELL).distinct().withColumn("verified", F.lit(True))
    joined = cells.join(ok, list(CELL), "left")
    bad = F.col("verified").isNull() & F.col("text").rlike(r"^[+-]?\d+(\.\d+)?%?$")
    out = joined.withColumn("bad", bad).withColumns({"text": F.when(F.col("bad"), "").otherwise(F.col("text")), "confidence": F.when(F.col("bad"), -1.0).otherwise(F.col("confidence"))})
    return out.withColumn("blanked", F.count_if("bad").over(W.partitionBy(DOC))).drop("bad", "verified")
