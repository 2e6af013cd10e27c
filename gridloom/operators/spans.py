"""Merged regions: doc_id, span_id, row_idx, col_idx, row_span, col_span, role."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .grid import CELL, DOC, MAX_SLOTS, unicode_trim

SPAN = ("doc_id", "span_id")
#: Fixed thresholds of missing separators: absent, the rest of its line, the whole grid, and the strict form.
ABSENT, LINE, GRID, STRICT = 0.10, 0.70, 0.65, 0.85
#: Cells are numbered by row * STRIDE + column.
STRIDE = 1 << 20


def _size(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("long")


def _covers() -> Column:
    return (F.col("row_idx") >= 0) & (F.col("col_idx") >= 0) & (_size("row_span") * _size("col_span") <= MAX_SLOTS)


def coverage(spans: DataFrame) -> DataFrame:
    """doc_id, span_id, row_idx, col_idx, anchor of every slot that a span covers. A missing or zero size counts as 1. A
    span that claims more than ``MAX_SLOTS`` places, or starts before 0, is in no grid and covers nothing."""
    real = spans.where(_covers()).select(*SPAN, F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), _size("row_span").alias("h"), _size("col_span").alias("w"))
    rows = real.select(*SPAN, "r0", "c0", "w", F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))).alias("i"))
    slots = rows.select(*SPAN, "r0", "c0", "i", F.explode(F.sequence(F.lit(0), (F.col("w") - 1).cast("int"))).alias("j"))
    return slots.select(*SPAN, (F.col("r0") + F.col("i")).alias("row_idx"), (F.col("c0") + F.col("j")).alias("col_idx"), ((F.col("i") == 0) & (F.col("j") == 0)).alias("anchor"))


def _over(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, row_idx, col_idx (of a cell), span_id and ``anchor``: the cells that spans lie over. Cells are compared with
    their document's spans, so what a span claims beyond them costs nothing."""
    size = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("long")
    regions = spans.select(*SPAN, F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), size("row_span").alias("h"), size("col_span").alias("w"))
    met = cells.select(*CELL).join(regions, DOC).where("row_idx >= r0 and row_idx < r0 + h and col_idx >= c0 and col_idx < c0 + w")
    return met.select(*CELL, "span_id", ((F.col("row_idx") == F.col("r0")) & (F.col("col_idx") == F.col("c0"))).alias("anchor"))


def covered_slots(spans: DataFrame) -> DataFrame:
    """Positions that spans cover other than their anchors."""
    return coverage(spans).where("not anchor").select(*CELL).distinct()


def span_roles(spans: DataFrame, shape: DataFrame) -> DataFrame:
    """Role by position and extent: title spans the whole first row, row_header is tall in the first column,
    group_header is wide in row 0 or right under a title, anything else is merged; a full-width span of row 1
    under a title is merged."""
    sized = spans.drop("role").join(shape, DOC)
    titled = F.coalesce(F.max(((F.col("row_idx") == 0) & (F.col("col_idx") == 0) & (F.col("col_span") >= F.col("n_cols"))).cast("int")).over(W.partitionBy(DOC)), F.lit(0)) == 1
    full = (F.col("col_idx") == 0) & (F.col("col_span") >= F.col("n_cols"))
    role = (
        F.when(full & (F.col("row_idx") == 0), "title")
        .when(full & (F.col("row_idx") == 1) & F.col("titled"), "merged")
        .when((F.col("col_idx") == 0) & (F.col("row_span") > 1) & (F.col("col_span") == 1), "row_header")
        .when((F.col("col_span") > 1) & (F.col("row_span") == 1) & (F.col("row_idx") <= F.when(F.col("titled"), 1).otherwise(0)), "group_header")
        .otherwise("merged")
    )
    return sized.withColumn("titled", titled).withColumn("role", role).drop("titled", "n_rows", "n_cols")


def span_findings(spans: DataFrame, shape: DataFrame) -> DataFrame:
    """D3: the spans with in_bounds and overlapping (some place of theirs is another's too, inside the grid or not). A span
    that ``coverage`` holds to cover nothing overlaps none. Spans are compared as rectangles with the others of their
    document, so what they claim costs nothing."""
    end = lambda at, size: F.col(at).cast("long") + F.col(size)
    starts = (F.col("row_idx") >= 0) & (F.col("col_idx") >= 0) & (F.col("row_span") >= 1) & (F.col("col_span") >= 1)
    inside = starts & (end("row_idx", "row_span") <= F.col("n_rows")) & (end("col_idx", "col_span") <= F.col("n_cols"))
    judged = spans.join(shape, DOC, "left").withColumn("in_bounds", F.coalesce(inside, F.lit(False))).drop("n_rows", "n_cols")
    box = F.struct("span_id", F.col("row_idx").cast("long").alias("r"), F.col("col_idx").cast("long").alias("c"), _size("row_span").alias("h"), _size("col_span").alias("w"))
    meet = lambda a, b: (a["r"] < b["r"] + b["h"]) & (b["r"] < a["r"] + a["h"]) & (a["c"] < b["c"] + b["w"]) & (b["c"] < a["c"] + a["w"])
    met = lambda a, i: F.exists(F.transform("boxes", lambda b, j: (i != j) & meet(a, b)), lambda x: x)
    boxes = spans.where(_covers()).groupBy(DOC).agg(F.collect_list(box).alias("boxes"))
    each = boxes.select(DOC, F.explode(F.transform("boxes", lambda a, i: F.struct(a["span_id"].alias("span_id"), met(a, i).alias("met")))).alias("x"))
    shared = each.groupBy(DOC, F.col("x.span_id").alias("span_id")).agg(F.bool_or("x.met").alias("overlapping"))
    return judged.join(shared, list(SPAN), "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(False)))


def resolve_text_hiding(spans: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans that hide no text, places to review: hidden text and the anchors of what hid it). A text of blanks alone is
    none."""
    hidden = _over(spans, cells.where(unicode_trim(F.col("text")) != "")).where("not anchor")
    guilty = hidden.select(*SPAN).distinct()
    anchors = spans.join(guilty, list(SPAN), "left_semi").select(*CELL)
    return spans.join(guilty, list(SPAN), "left_anti"), hidden.select(*CELL).union(anchors).distinct()


def lift_review(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells whose needs_review is also set where they anchor a span over a flagged cell."""
    flagged = _over(spans, cells.where("needs_review")).select(*SPAN).distinct()
    anchors = spans.join(flagged, list(SPAN), "left_semi").select(*CELL).distinct().withColumn("lifted", F.lit(True))
    lifted = cells.join(anchors, list(CELL), "left")
    return lifted.withColumn("needs_review", F.col("needs_review") | F.coalesce("lifted", F.lit(False))).drop("lifted")


def clamp_spans(spans: DataFrame, limits: DataFrame) -> DataFrame:
    """Spans within the last kept indexes (doc_id, last_row, last_col): an anchor beyond drops the span, a
    crossing one is shortened; a missing or zero size counts as 1 and is left as it is."""
    one = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    cut = lambda at, size, last: F.when(F.col(at) + one(size) - 1 > F.col(last), F.col(last) - F.col(at) + 1).otherwise(F.col(size)).cast("int")
    inside = spans.join(limits, DOC).where("row_idx <= last_row and col_idx <= last_col")
    return inside.withColumns({"row_span": cut("row_idx", "row_span", "last_row"), "col_span": cut("col_idx", "col_span", "last_col")}).drop("last_row", "last_col")


def shift_spans(spans: DataFrame, dropped: DataFrame) -> DataFrame:
    """Spans after rows (doc_id, row_idx) were dropped: one anchored on such a row goes, later ones move up."""
    before = spans.join(dropped.select(DOC, F.col("row_idx").alias("gone")), DOC, "left").groupBy(*SPAN).agg(F.count_if(F.col("gone") < F.col("row_idx")).alias("up"), F.coalesce(F.bool_or(F.col("gone") == F.col("row_idx")), F.lit(False)).alias("lost"))
    return spans.join(before, list(SPAN)).where("not lost").withColumn("row_idx", (F.col("row_idx") - F.col("up")).cast("int")).drop("up", "lost")


def clear_after_edit(spans: DataFrame, edited: DataFrame) -> DataFrame:
    """No spans in documents whose rows or columns were edited."""
    return spans.join(edited.select(DOC), DOC, "left_anti")


def boundaries_ok(boundaries: Column, n: Column) -> Column:
    """N + 1 finite, strictly increasing positions."""
    size = F.size(boundaries)
    finite = F.forall(boundaries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rising = F.forall(F.sequence(F.lit(0), F.greatest(size - 2, F.lit(0))), lambda i: (size < 2) | (F.get(boundaries, i) < F.get(boundaries, i + 1)))
    return F.coalesce((size == n + 1) & finite & rising, F.lit(False))


def align_boundaries(boundaries: Column, offset: Column) -> Column:
    """The boundaries from ``offset`` on."""
    return F.slice(boundaries, offset + 1, F.greatest(F.size(boundaries) - offset, F.lit(0)))


def geometry_fingerprint(*parts: Column) -> Column:
    """Digest of the parts, in the order given, as JSON that tells nulls, texts and separators apart."""
    fields = F.struct(*(p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}).cast("binary"), 256)


def spans_from_separators(separators: DataFrame) -> DataFrame:
    """doc_id, row_idx, col_idx, row_span, col_span from separators between cells.

    ``separators`` (doc_id, orientation, row_idx, col_idx, support): ``v`` stands right of its cell, ``h`` below
    it. Cells join where the separator is absent while the rest of its line is there, and groups of any size are
    closed. A group that is no rectangle leaves its document without spans. A document needs
    three rows, two columns and a grid that is there as a whole.
    """
    line = ["doc_id", "orientation", F.when(F.col("orientation") == "v", F.col("col_idx")).otherwise(F.col("row_idx")).alias("line")]
    numbered = separators.select(*line, "row_idx", "col_idx", "support")
    grid = separators.groupBy(DOC).agg(F.percentile(F.when(F.col("orientation") == "v", F.col("support")), F.lit(0.5)).alias("mv"), F.percentile(F.when(F.col("orientation") == "h", F.col("support")), F.lit(0.5)).alias("mh"), (F.max(F.when(F.col("orientation") == "v", F.col("row_idx"))) + 1).alias("n_rows"), (F.max(F.when(F.col("orientation") == "h", F.col("col_idx"))) + 1).alias("n_cols"))
    good = grid.where((F.col("mv") >= GRID) & (F.col("mh") >= GRID) & (F.col("n_rows") >= 3) & (F.col("n_cols") >= 2))
    lines = numbered.groupBy(DOC, "orientation", "line").agg(F.sort_array(F.collect_list(F.when(F.col("support") > ABSENT, F.col("support")))).alias("rest"), F.count_if(F.col("support") >= STRICT).alias("strong"))
    middle = F.when(F.size("rest") > 0, (F.get("rest", F.floor((F.size("rest") - 1) / 2).cast("int")) + F.get("rest", F.floor(F.size("rest") / 2).cast("int"))) / 2)
    missing = numbered.where(F.col("support") <= ABSENT).join(lines.withColumn("middle", middle), [DOC, "orientation", "line"]).join(good, DOC)
    wide = (F.col("orientation") == "h") & (F.col("n_cols") >= 8) & (F.col("strong") >= 2)
    place = F.col("row_idx").cast("long") * STRIDE + F.col("col_idx")
    beside = place + F.when(F.col("orientation") == "v", 1).otherwise(STRIDE)
    labels = _least_labels(missing.where((F.col("middle") >= LINE) | wide).select(DOC, place.alias("a"), beside.alias("b")))
    box = labels.groupBy(DOC, "label").agg(F.min("row").alias("row_idx"), F.min("col").alias("col_idx"), (F.max("row") - F.min("row") + 1).alias("row_span"), (F.max("col") - F.min("col") + 1).alias("col_span"), F.count("*").alias("n"))
    whole = F.bool_and(F.col("n") == F.col("row_span") * F.col("col_span")).over(W.partitionBy(DOC))
    return box.withColumn("whole", whole).where("whole").select(DOC, *(F.col(c).cast("int").alias(c) for c in ("row_idx", "col_idx", "row_span", "col_span")))


def least_joined(pairs: list) -> list[dict]:
    """Every cell of ``pairs`` (a, b) of joined cells, with the least one that it is joined to over any way."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for pair in pairs:
        a, b = sorted((top(pair["a"]), top(pair["b"])))
        up[b] = a
    return [{"cell": x, "label": top(x)} for x in list(up)]


def _least_labels(edges: DataFrame) -> DataFrame:
    """doc_id, row, col, label: least cell reachable. A document's cells are few (SURVEY: at most 4,096), so that its
    groups are closed within one row."""

    @F.pandas_udf("array<struct<cell:long,label:long>>")
    def closed(edges: pd.Series) -> pd.Series:
        return pd.Series([least_joined(pairs) for pairs in edges], dtype=object)

    docs = edges.groupBy(DOC).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    found = docs.select(DOC, F.explode(closed("edges")).alias("f")).select(DOC, "f.cell", "f.label")
    return found.select(DOC, F.floor(F.col("cell") / STRIDE).alias("row"), (F.col("cell") % STRIDE).alias("col"), "label")
