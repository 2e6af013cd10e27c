"""Row and column structure of grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .grid import CELL, DOC, rectangularize, shape, unicode_trim

#: Strings that are units alone, for H6.
UNIT = r"^(?:[kMGmµnc]?(?:m|g|s|A|V|W|Hz|Pa|L)|%|°C|kg|pcs|mm|cm|km)$"


def _filled(cells: DataFrame) -> DataFrame:
    """doc_id, row_idx, filled, n_cols, n_rows of each row."""
    rows = cells.groupBy(DOC, "row_idx").agg(F.count_if(unicode_trim(F.col("text")) != "").alias("filled"))
    return rows.join(shape(cells), DOC)


def caption_band(cells: DataFrame) -> DataFrame:
    """H1: doc_id, band: leading rows with at most max(3, columns / 3) filled cells, up to the first full one; 0 for
    fewer than three columns, or where fewer than two rows would follow."""
    w = W.partitionBy(DOC).orderBy("row_idx")
    sparse = F.col("filled") <= F.greatest(F.lit(3), F.floor(F.col("n_cols") / 3))
    lead = _filled(cells).withColumn("lead", F.min((sparse & (F.col("filled") < F.col("n_cols"))).cast("int")).over(w))
    band = lead.groupBy(DOC, "n_rows", "n_cols").agg(F.sum("lead").alias("band"))
    return band.select(DOC, F.when((F.col("n_cols") >= 3) & (F.col("n_rows") - F.col("band") >= 2), F.col("band")).otherwise(0).cast("int").alias("band"))


def drop_rows(cells: DataFrame, dropped: DataFrame) -> DataFrame:
    """Cells without the rows (doc_id, row_idx), later ones moved up."""
    gone = dropped.groupBy(DOC).agg(F.collect_set("row_idx").alias("gone"))
    joined = cells.join(gone, DOC, "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    up = F.size(F.filter("gone", lambda g: g < F.col("row_idx")))
    return joined.where(~F.array_contains("gone", F.col("row_idx"))).withColumn("row_idx", (F.col("row_idx") - up).cast("int")).drop("gone")


def caption_rows(cells: DataFrame, spans: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """H2: the rows of H1's band, but for documents where a group header covers row 0 or the shape is locked."""
    keep = spans.where("role = 'group_header' and row_idx = 0").select(DOC)
    keep = keep if locked is None else keep.union(locked.select(DOC))
    band = caption_band(cells).where("band > 0").join(keep, DOC, "left_anti")
    return band.select(DOC, F.explode(F.sequence(F.lit(0), F.col("band") - 1)).alias("row_idx"))


def column_letter_rows(cells: DataFrame, spans: DataFrame, share: float = 0.8) -> DataFrame:
    """H3: row 0 where most of two or more filled cells are letters A to ZZ alone and no span stands."""
    first = cells.where("row_idx = 0").groupBy(DOC).agg(F.count_if(F.col("text") != "").alias("filled"), F.count_if(F.col("text").rlike("^[A-Z]{1,2}$")).alias("letters"))
    hit = first.where((F.col("filled") >= 2) & (F.col("letters") >= F.col("filled") * share)).join(spans.select(DOC).distinct(), DOC, "left_anti")
    return hit.select(DOC, F.lit(0).alias("row_idx"))


def blank_header_rows(cells: DataFrame, scan: int = 4) -> DataFrame:
    """H4: blank rows among the first ``scan`` that stand between rows with text."""
    w = W.partitionBy(DOC).orderBy("row_idx")
    rows = _filled(cells).withColumns({"above": F.lag("filled").over(w), "below": F.lead("filled").over(w)})
    return rows.where((F.col("filled") == 0) & (F.col("above") > 0) & (F.col("below") > 0) & (F.col("row_idx") < scan)).select(DOC, "row_idx")


def trim_extent(cells: DataFrame) -> DataFrame:
    """H5: cells up to the last row and column with text; documents without text keep nothing."""
    full = unicode_trim(F.col("text")) != ""
    w = W.partitionBy(DOC)
    sized = cells.withColumns({"__r": F.max(F.when(full, F.col("row_idx"))).over(w), "__c": F.max(F.when(full, F.col("col_idx"))).over(w)})
    return sized.where("row_idx <= __r and col_idx <= __c").drop("__r", "__c")


def merge_unit_columns(cells: DataFrame) -> DataFrame:
    """H6: columns that hold unit strings alone are joined to the kept column on their left, by a blank."""
    columns = cells.groupBy(DOC, "col_idx").agg(F.count_if(F.col("text") != "").alias("filled"), F.count_if(F.col("text").rlike(UNIT)).alias("units"))
    w = W.partitionBy(DOC).orderBy("col_idx")
    kept = columns.withColumn("keep", ((F.col("filled") == 0) | (F.col("units") < F.col("filled")) | (F.col("col_idx") == 0)).cast("int"))
    target = kept.withColumn("to", (F.sum("keep").over(w) - 1).cast("int")).select(DOC, "col_idx", "to")
    parts = cells.join(target, [DOC, "col_idx"]).groupBy(DOC, "row_idx", "to").agg(F.sort_array(F.collect_list(F.struct("col_idx", "text"))).alias("p"))
    return parts.select(DOC, "row_idx", F.col("to").alias("col_idx"), F.array_join(F.filter(F.col("p.text"), lambda x: x != ""), " ").alias("text"))


def remap(places: DataFrame, row_map: DataFrame, col_map: DataFrame) -> DataFrame:
    """H7: places (doc_id, row_idx, col_idx) with new_row, new_col by maps (doc_id, old, new); null where dropped."""
    rows = row_map.select(DOC, F.col("old").alias("row_idx"), F.col("new").alias("new_row"))
    cols = col_map.select(DOC, F.col("old").alias("col_idx"), F.col("new").alias("new_col"))
    return places.join(rows, [DOC, "row_idx"], "left").join(cols, [DOC, "col_idx"], "left")


def insert_line(cells: DataFrame, edits: DataFrame, axis: str) -> DataFrame:
    """H8: one blank row (axis ``row``) or column at ``at`` of (doc_id, at), clamped to the grid."""
    key, n = f"{axis}_idx", f"n_{axis}s"
    other, m = ("col_idx", "n_cols") if axis == "row" else ("row_idx", "n_rows")
    at = edits.join(shape(cells), DOC).withColumn("at", F.greatest(F.lit(0), F.least(F.col("at"), F.col(n))).cast("int"))
    moved = cells.select(*CELL, "text").join(at.select(DOC, "at"), DOC, "left").withColumn(key, F.when(F.col(key) >= F.col("at"), F.col(key) + 1).otherwise(F.col(key)).cast("int")).select(*CELL, "text")
    blank = at.select(DOC, F.col("at").alias(key), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other), F.lit("").alias("text"))
    return moved.unionByName(blank)


def remove_line(cells: DataFrame, edits: DataFrame, axis: str) -> DataFrame:
    """H8: without the row or column ``at``; an index outside the grid changes nothing."""
    key = f"{axis}_idx"
    joined = cells.join(edits.select(DOC, "at"), DOC, "left")
    kept = joined.where(F.col("at").isNull() | (F.col(key) != F.col("at")))
    return kept.withColumn(key, F.when((F.col("at") >= 0) & (F.col(key) > F.col("at")), F.col(key) - 1).otherwise(F.col(key)).cast("int")).drop("at")


def set_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """H9: edits (doc_id, row_idx, col_idx, text, seq), the last of a place counts: confidence 1, no review, no marker;
    an edit outside makes the grid grow."""
    last = edits.groupBy(*CELL).agg(F.max_by("text", "seq").alias("edit"))
    grown = rectangularize(cells.select(*CELL, "text").unionByName(last.select(*CELL, F.col("edit").alias("text"))).groupBy(*CELL).agg(F.max("text").alias("text")))
    old = cells.select(*CELL, F.col("text").alias("was"), "confidence", "needs_review", "confidence_sentinel")
    both = grown.drop("text").join(old, list(CELL), "left").join(last, list(CELL), "left")
    edited = F.col("edit").isNotNull()
    no = F.lit(False)
    return both.select(*CELL, F.coalesce("edit", "was", F.lit("")).alias("text"), F.when(edited, 1.0).otherwise(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.when(edited, no).otherwise(F.coalesce("needs_review", no)).alias("needs_review"), F.when(edited, no).otherwise(F.coalesce("confidence_sentinel", no)).alias("confidence_sentinel"))


def append_rows(cells: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with the rows (doc_id, texts array) of exact width added, rows rejected)."""
    sized = rows.join(shape(cells), DOC, "left")
    ok = F.coalesce(F.size("texts") == F.col("n_cols"), F.lit(False))
    new = sized.where(ok).select(DOC, F.col("n_rows").cast("int").alias("row_idx"), F.posexplode("texts").alias("col_idx", "text"))
    return cells.select(*CELL, "text").unionByName(new), sized.where(~ok).select(*rows.columns)


def demote_implausible(docs: DataFrame, least_rows: int = 7) -> DataFrame:
    """Certified documents (doc_id, n_rows, n_cols, structure_verified) with at most two columns and many rows
    become unverified and blocked, with a reason."""
    odd = F.col("structure_verified") & (F.col("n_cols") <= 2) & (F.col("n_rows") >= least_rows)
    return docs.withColumns({"publication_blocked": odd, "reasons": F.when(odd, F.array(F.lit("implausible structure"))).otherwise(F.array().cast("array<string>")), "structure_verified": F.col("structure_verified") & ~odd})


def empty_columns(cells: DataFrame) -> DataFrame:
    """doc_id, leading, trailing blank columns; at least one column counts as kept."""
    full = F.col("text") != ""
    found = cells.groupBy(DOC).agg(F.min(F.when(full, F.col("col_idx"))).alias("a"), F.max(F.when(full, F.col("col_idx"))).alias("b"), (F.max("col_idx") + 1).alias("n"))
    return found.select(DOC, F.coalesce("a", F.col("n") - 1).cast("int").alias("leading"), F.when(F.col("a").isNull(), 0).otherwise(F.col("n") - 1 - F.col("b")).cast("int").alias("trailing"))


def duplicate_texts(cells: DataFrame) -> DataFrame:
    """doc_id, duplicates: filled cells beyond the first of each text."""
    return cells.where(F.col("text") != "").groupBy(DOC, "text").agg(F.count("*").alias("n")).groupBy(DOC).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def select_region(tokens: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxed tokens (doc_id, token_id, left, right, top, bottom) whose centre lies in their document's region
    (doc_id, x, y, w, h in shares of a page of width, height), padded by 2 % at the sides, 8 % above, 4 % below, 4
    pixels at least; regions outside the page or under 2 % are no regions."""
    ok = regions.where("x >= 0 and y >= 0 and x + w <= 1 and y + h <= 1 and w >= 0.02 and h >= 0.02")
    c = F.col
    a, b = F.floor(c("x") * c("width")), F.ceil((c("x") + c("w")) * c("width"))
    t, e = F.floor(c("y") * c("height")), F.ceil((c("y") + c("h")) * c("height"))
    pad = lambda size, share: F.greatest(F.lit(4), F.ceil(size * share))
    box = ok.select(DOC, F.greatest(F.lit(0), a - pad(b - a, 0.02)).alias("x0"), F.least(c("width"), b + pad(b - a, 0.02)).alias("x1"), F.greatest(F.lit(0), t - pad(e - t, 0.08)).alias("y0"), F.least(c("height"), e + pad(e - t, 0.04)).alias("y1"))
    cx, cy = (c("left") + c("right")) / 2, (c("top") + c("bottom")) / 2
    return tokens.join(box, DOC).where((cx >= c("x0")) & (cx < c("x1")) & (cy >= c("y0")) & (cy < c("y1"))).drop("x0", "x1", "y0", "y1")


def collapse_wrapped(cells: DataFrame, wrapped: DataFrame) -> DataFrame:
    """Rows (doc_id, row_idx) that continue the one above join it, cell by cell with a blank; later rows move up."""
    rows = cells.select(DOC, "row_idx").distinct().join(wrapped.select(DOC, "row_idx").distinct().withColumn("goes_on", F.lit(1)), [DOC, "row_idx"], "left")
    starts = F.when((F.col("row_idx") > 0) & F.col("goes_on").isNotNull(), 0).otherwise(1)
    target = rows.withColumn("to", (F.sum(starts).over(W.partitionBy(DOC).orderBy("row_idx")) - 1).cast("int")).select(DOC, "row_idx", "to")
    parts = cells.join(target, [DOC, "row_idx"]).groupBy(DOC, "to", "col_idx").agg(F.sort_array(F.collect_list(F.struct("row_idx", "text"))).alias("p"))
    return parts.select(DOC, F.col("to").alias("row_idx"), "col_idx", F.array_join(F.filter(F.col("p.text"), lambda x: x != ""), " ").alias("text"))
