"""Grids from positioned texts: tokens (doc_id, token_id, points array<struct<x,y>>, text, score) and axes
(doc_id, axis ``row`` or ``col``, idx, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .grid import CELL, DOC
from .review import has_type_suffix


def normalize_axis(axis: DataFrame) -> DataFrame:
    """B2: rounded positions that rise above all before them; none of an axis with a value that is no number."""
    n = F.when(~has_type_suffix(F.col("pos")), F.col("pos").try_cast("double"))
    w = W.partitionBy(DOC, "axis").orderBy("idx")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    valued = axis.withColumn("value", F.rint(n))
    bad, top = F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).over(whole), F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1))
    kept = valued.select(DOC, "axis", "idx", "value", bad.alias("bad"), top.alias("top"))
    kept = kept.where("bad = 0 and (top is null or value > top)")
    return kept.select(DOC, "axis", (F.row_number().over(w) - 1).alias("idx"), F.col("value").cast("long").alias("pos"))


def axis_arrays(axis: DataFrame) -> DataFrame:
    """doc_id, rows, cols: the boundaries of each document as arrays."""
    listed = lambda a: F.transform(F.sort_array(F.collect_list(F.when(F.col("axis") == a, F.struct("idx", "pos")))), lambda x: x["pos"])
    return axis.groupBy(DOC).agg(listed("row").alias("rows"), listed("col").alias("cols"))


def well_formed(tokens: DataFrame) -> DataFrame:
    """Tokens of which every point has two finite numbers."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return tokens.where((F.size("points") > 0) & F.forall("points", lambda p: finite(p["x"]) & finite(p["y"])))


def with_box(tokens: DataFrame) -> DataFrame:
    """Tokens with left, right, top, bottom, cx, cy."""
    t = tokens.withColumns({"__px": F.col("points.x"), "__py": F.col("points.y")})
    t = t.withColumns({"left": F.array_min("__px"), "right": F.array_max("__px"), "top": F.array_min("__py"), "bottom": F.array_max("__py"), "cx": _mean("__px"), "cy": _mean("__py")})
    return t.drop("__px", "__py")


def in_frame(left: Column, right: Column, top: Column, bottom: Column, rows: Column, cols: Column, share: float = 0.70) -> Column:
    """70 % of width and of height lie between the outer boundaries; sizes count as 1 at least."""
    part = lambda a, b, axis: F.greatest(F.lit(0.0), F.least(b, F.element_at(axis, -1)) - F.greatest(a, F.element_at(axis, 1))) / F.greatest(F.lit(1.0), b - a)
    return (part(left, right, cols) >= share) & (part(top, bottom, rows) >= share)


def _mean(values: str) -> Column:
    """Mean of an array, null where one is null or there is none. Boxes of four points take no loop, which Spark interprets."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    four = F.lit(0.0) + F.get(values, 0) + F.get(values, 1) + F.get(values, 2) + F.get(values, 3)
    return F.when(F.size(values) == 4, four / 4).when(F.size(values) > 0, total / F.size(values))


def _beside(boundaries: Column, slot: Column, a: Column, b: Column) -> Column:
    """Whether a boundary, of rising ones, may lie between ``a`` and ``b``, whose middle lies in ``slot``."""
    return (F.get(boundaries, slot) > a) | (F.get(boundaries, slot + 1) < b)


def slot_of(boundaries: Column, at: Column) -> Column:
    """Index of the interval, closed on its left, that ``at`` lies in; -1 before the first."""
    return F.size(F.filter(boundaries, lambda b: b <= at)) - 1


def crossed(boundaries: Column, a: Column, b: Column) -> Column:
    """B6 and for rows: indexes of inner boundaries with 12 to 88 % of the box before them."""
    size = F.greatest(F.lit(1.0), b - a)
    inner = F.sequence(F.lit(1), F.greatest(F.size(boundaries) - 2, F.lit(1)))
    hit = lambda i: (i < F.size(boundaries) - 1) & (F.get(boundaries, i) > a) & (F.get(boundaries, i) < b) & ((F.get(boundaries, i) - a) / size).between(0.12, 0.88)
    return F.filter(inner, hit)


def crossed_columns(cols: Column, left: Column, right: Column) -> Column:
    """``crossed``; a single crossing with less than 22 % on one side doesn't count."""
    found = crossed(cols, left, right)
    share = (F.get(cols, F.get(found, 0)) - left) / F.greatest(F.lit(1.0), right - left)
    return F.when((F.size(found) == 1) & (F.least(share, 1 - share) < 0.22), F.array().cast("array<int>")).otherwise(found)


def split_place(text: Column, ratio: Column) -> Column:
    """The index of the white space nearest to ``ratio`` of the text, if within max(2, 20 % of it); else null."""
    target = ratio * F.length(text)
    spaces = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: text.substr(i + 1, F.lit(1)).rlike(r"(?U)^\s$"))
    best = F.array_min(F.transform(spaces, lambda i: F.struct(F.abs(i - target).alias("off"), i.alias("at"))))
    return F.when((ratio.between(0.2, 0.8)) & (best["off"] <= F.greatest(F.lit(2.0), F.length(text) * 0.2)), best["at"])


def _piece(row: Column, col: Column, x: Column, y: Column, text: Column, score: Column, whole: bool = False) -> Column:
    """A piece of a token; ``whole`` where the token lies in one cell."""
    place = row.cast("int").alias("row_idx"), col.cast("int").alias("col_idx"), x.cast("double").alias("x"), y.cast("double").alias("y")
    return F.struct(*place, text.alias("text"), score.cast("double").alias("score"), F.lit(whole).alias("whole"))


def place_tokens(tokens: DataFrame, axes: DataFrame) -> DataFrame:
    """doc_id, token_id, part, row_idx, col_idx, x, y, text, score of every token piece in the grid.

    ``axes`` has rows and cols (see ``axis_arrays``). A token outside the frame goes; one across a column line is
    split at a blank near it; one across row lines is split over the rows it covers, or, if tall, put in the top
    one; one across column lines that can't be split stays on their left with score -1, but for titles in row 0.
    A number fused with a rate, in a token that lies in one cell, moves to the cell on its left where up to this token
    nothing stands there: no token, and no number of an earlier one. Tokens come by token_id; rows that repeat one are
    treated alike."""
    c = F.col
    # Nothing is filtered before the pieces: a filter would be pushed down, and compute what it asks of once more. The
    # hint keeps axes of many documents from being broadcast, as their size is guessed from the few bytes read for them.
    t = tokens.join(axes.where("size(rows) > 1 and size(cols) > 1").hint("shuffle_hash"), DOC)
    t = t.select(DOC, "token_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"), "score", "rows", "cols", c("points.x").alias("px"), c("points.y").alias("py"))
    t = t.withColumns({"left": F.array_min("px"), "right": F.array_max("px"), "top": F.array_min("py"), "bottom": F.array_max("py"), "cx": _mean("px"), "cy": _mean("py")})
    # a null point makes the mean null, and NaN is above all numbers
    inf = float("inf")
    finite = c("cx").isNotNull() & c("cy").isNotNull() & (c("left") > -inf) & (c("top") > -inf) & (c("right") < inf) & (c("bottom") < inf)
    here = F.coalesce(F.when(finite, in_frame(c("left"), c("right"), c("top"), c("bottom"), c("rows"), c("cols"))), F.lit(False))
    t = t.withColumn("here", here).drop("px", "py")
    t = t.withColumns({"row": F.when(c("here"), slot_of(c("rows"), c("cy"))), "col": F.when(c("here"), slot_of(c("cols"), c("cx")))})
    none = F.array().cast("array<int>")
    t = t.withColumns({"n_rows": F.size("rows") - 1, "n_cols": F.size("cols") - 1, "xs": F.when(_beside(c("cols"), c("col"), c("left"), c("right")), crossed_columns(c("cols"), c("left"), c("right"))).otherwise(none), "ys": F.when(_beside(c("rows"), c("row"), c("top"), c("bottom")), crossed(c("rows"), c("top"), c("bottom"))).otherwise(none)})
    t = t.withColumn("crossing", (F.size("xs") > 0) | (F.size("ys") > 0))
    line = F.get("cols", F.get("xs", 0))
    ratio = (line - c("left")) / F.nullif(c("right") - c("left"), F.lit(0.0))
    one_line = (F.size("xs") == 1) & (c("text") != "") & (c("right") - c("left") > 1)
    t = t.withColumns({"line": line, "cut": F.when(one_line, split_place(c("text"), ratio))})

    # As many words as rows, or as many equal parts of a few Han characters whose cuts are near the lines.
    covered = F.sequence(F.get("ys", 0) - 1, F.element_at("ys", -1))
    k = F.size("ys") + 1
    height = F.greatest(F.lit(1.0), c("bottom") - c("top"))
    words = F.split("text", r"(?U)\s+")
    even = F.forall(F.sequence(F.lit(0), F.size("ys") - 1), lambda i: F.abs((F.get("rows", F.get("ys", i)) - c("top")) / height - (i + 1) / k) <= 0.25)
    step = (F.length("text") / k).cast("int")
    han = c("text").rlike("^[\\x{3400}-\\x{9FFF}]{2,8}$") & (F.length("text") % k == 0) & even
    parts = F.when(F.size(words) == k, words).when(han, F.transform(F.sequence(F.lit(0), k - 1), lambda i: c("text").substr(i * step + 1, step)))
    in_a_row = F.element_at("ys", -1) - F.get("ys", 0) + 1 == F.size("ys")
    low = F.array_min(F.transform(covered, lambda r: F.get("rows", r + 1) - F.get("rows", r)))
    tall = (F.size("ys") > 0) & (c("text") != "") & c("cut").isNull()
    down = F.when(tall & in_a_row & (height >= low * (k - 0.75)) & c("col").between(0, c("n_cols") - 1), parts)
    # The top row for boxes of 1.25 typical rows and more.
    pitches = F.sort_array(F.transform(F.sequence(F.lit(0), c("n_rows") - 1), lambda i: F.get("rows", i + 1) - F.get("rows", i)))
    pitch = (F.get(pitches, ((c("n_rows") - 1) / 2).cast("int")) + F.get(pitches, (c("n_rows") / 2).cast("int"))) / 2
    t = t.withColumns({"down": F.when(F.size("ys") > 0, down), "row": F.when(F.size("ys") > 0, F.when(height >= pitch * 1.25, F.get("ys", 0) - 1).otherwise(c("row"))).otherwise(c("row"))})
    in_row = c("row").between(0, c("n_rows") - 1)

    rows_down = F.transform(F.sequence(F.lit(0), F.size("down") - 1), lambda i: _piece(F.get("ys", 0) - 1 + i, c("col"), c("cx"), (F.get("rows", F.get("ys", 0) - 1 + i) + F.get("rows", F.get("ys", 0) + i)) * 0.5, F.get("down", i), c("score")))
    trimmed = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    left, right = trimmed(c("text").substr(F.lit(1), c("cut"))), trimmed(c("text").substr(c("cut") + 1, F.length("text")))
    at = F.get("xs", 0)
    across = F.array(_piece(c("row"), at - 1, (c("left") + c("line")) / 2, c("cy"), left, c("score")), _piece(c("row"), at, (c("line") + c("right")) / 2, c("cy"), right, c("score")))
    first = F.array_min(F.filter(F.sequence(F.lit(0), c("n_cols") - 1), lambda i: (c("right") > F.get("cols", i)) & (c("left") < F.get("cols", i + 1))))
    kept = _piece(c("row"), first, c("left"), c("cy"), c("text"), F.when((c("row") == 0) & (F.size("xs") >= 2), c("score")).otherwise(F.lit(-1.0)))
    plain = _piece(c("row"), c("col"), c("cx"), c("cy"), c("text"), c("score"), True)
    alone = F.when(in_row & c("col").between(0, c("n_cols") - 1), F.array(plain))
    # most tokens cross no line, and nothing else is computed of them
    pieces = F.when(
        c("crossing"),
        F.when(c("down").isNotNull(), rows_down)
        .when(c("cut").isNotNull() & in_row & (left != "") & (right != ""), across)
        .when((F.size("xs") > 0) & (c("text") != "") & in_row & first.isNotNull(), F.array(kept))
        .otherwise(alone),
    ).otherwise(alone)
    placed = t.select(DOC, "token_id", "cols", pieces.alias("pieces")).select(DOC, "token_id", "cols", F.posexplode_outer("pieces").alias("part", "p"))
    placed = placed.where("p is not null").select(DOC, "token_id", "part", "cols", "p.*")

    # Only the first fused token of a cell can find the cell on its left empty, as its number stands there then.
    pair = r"(?i)^([+-]?\d+\.\d{2})(\d+(?:\.\d+)?\s*[kMGT]?S/s)$"
    row = W.partitionBy(DOC).orderBy(F.shiftleft(c("row_idx").cast("long"), 32) + c("col_idx"))
    fused = c("whole") & c("text").rlike(pair) & (c("col_idx") > 0)
    before = F.min("token_id").over(row.rangeBetween(-1, -1))
    first_here = F.min(F.when(c("fused"), c("token_id"))).over(row.rangeBetween(0, 0))
    free = c("fused") & (first_here == c("token_id")) & F.coalesce(before >= c("token_id"), F.lit(True))
    split = placed.withColumn("fused", fused).withColumn("free", free)
    number = _piece(c("row_idx"), c("col_idx") - 1, F.get("cols", c("col_idx")) - 1.0, c("y"), F.regexp_extract("text", pair, 1), c("score"))
    here = lambda text: _piece(c("row_idx"), c("col_idx"), c("x"), c("y"), text, c("score"))
    pieces = F.when(c("free"), F.array(number, here(F.regexp_extract("text", pair, 2)))).otherwise(F.array(here(c("text"))))
    out = split.select(DOC, "token_id", "part", F.explode(pieces).alias("p"))
    return out.select(DOC, "token_id", "part", "p.*").drop("whole")


def read_cells(placed: DataFrame, axes: DataFrame) -> DataFrame:
    """Cells (doc_id, row_idx, col_idx, text, confidence) from placed pieces, in reading order.

    Pieces sorted by y start a new line where they are further than clamp(18 % of the row's height, 2, 8) from the
    line's median so far; within a line they go by x. As a line's pieces come by rising y, its median is its middle
    one, or the mean of its middle two."""
    height = F.get("rows", F.col("row_idx") + 1) - F.get("rows", F.col("row_idx"))
    limit = F.greatest(F.lit(2.0), F.least(F.lit(8.0), height * 0.18))
    ready = placed.join(axes.select(DOC, "rows"), DOC).withColumn("limit", limit)
    cells = ready.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("y", "x", "text", "score"))).alias("pieces"), F.first("limit").alias("limit"))
    start = F.expr("named_struct('line', 0, 'ys', cast(array() as array<double>), 'out', cast(array() as array<struct<line:int,x:double,k:int,text:string,score:double>>))")

    def add(acc: Column, p: Column) -> Column:
        ys, n = acc["ys"], F.size(acc["ys"])
        middle = (F.get(ys, ((n - 1) / 2).cast("int")) + F.get(ys, (n / 2).cast("int"))) / 2
        new = (n > 0) & (F.abs(p["y"] - middle) > F.col("limit"))
        line = acc["line"] + F.when(new, 1).otherwise(0)
        said = F.struct(line.alias("line"), p["x"].alias("x"), F.size(acc["out"]).alias("k"), p["text"].alias("text"), p["score"].alias("score"))
        return F.struct(line.alias("line"), F.when(new, F.array(p["y"])).otherwise(F.concat(ys, F.array(p["y"]))).alias("ys"), F.concat(acc["out"], F.array(said)).alias("out"))

    ordered = F.sort_array(F.filter(F.aggregate("pieces", start, add)["out"], lambda o: o["text"] != ""))
    total = F.aggregate(F.col("o.score"), F.lit(0.0), lambda t, x: t + x)
    return cells.withColumn("o", ordered).select(*CELL, F.array_join("o.text", " ").alias("text"), F.when(F.size("o") > 0, total / F.size("o")).otherwise(0.0).alias("confidence"))


def split_fused_headers(cells: DataFrame, scan: int = 3) -> DataFrame:
    """A row among the first three, of which max(3, 60 % of the filled cells) read "label number", becomes a
    header row and a data row; two of the data parts at least look like numbers. The scan counts rows after
    insertion."""
    pattern = r"^([^\d\s][^\d]{0,23}?)\s+(\S.*)$"
    text = F.col("text")
    fused = text.rlike(pattern)
    number = F.regexp_extract(text, pattern, 2).rlike(r"^[+-]?\d[\d.,]*\s*[%A-Za-z]{0,4}$")
    rows = cells.where(F.col("row_idx") < scan).groupBy(DOC, "row_idx").agg(F.count_if(text != "").alias("filled"), F.count_if(fused).alias("fused"), F.count_if(fused & number).alias("numeric"))
    hit = rows.where((F.col("fused") >= F.greatest(F.lit(3), F.ceil(F.col("filled") * 0.6))) & (F.col("numeric") >= 2))
    # each split row before pushes later ones down, out of the scan
    before = F.count("*").over(W.partitionBy(DOC).orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1))
    hit = hit.withColumn("before", before).where(F.col("row_idx") + F.col("before") < scan).select(DOC, F.col("row_idx").alias("at"))
    joined = cells.join(hit.groupBy(DOC).agg(F.collect_set("at").alias("at")), DOC, "left")
    up = F.size(F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda a: a < F.col("row_idx")))
    here = F.coalesce(F.array_contains("at", F.col("row_idx")), F.lit(False))
    conf = F.col("confidence")
    label, data = F.when(fused, F.regexp_extract(text, pattern, 1)).otherwise(text), F.when(fused, F.regexp_extract(text, pattern, 2)).otherwise("")
    two = F.array(F.struct(F.lit(0).alias("k"), label.alias("text"), conf.alias("confidence")), F.struct(F.lit(1).alias("k"), data.alias("text"), F.when(fused, conf).otherwise(0.0).alias("confidence")))
    one = F.array(F.struct(F.lit(0).alias("k"), text.alias("text"), conf.alias("confidence")))
    out = joined.select(DOC, "row_idx", "col_idx", up.alias("up"), F.explode(F.when(here, two).otherwise(one)).alias("p"))
    return out.select(DOC, (F.col("row_idx") + F.col("up") + F.col("p.k")).cast("int").alias("row_idx"), "col_idx", "p.text", "p.confidence")


def group_without_rules(tokens: DataFrame, row_gap: float = 12.0, col_gap: float = 30.0) -> DataFrame:
    """Rows by gaps in y and columns by gaps in x over a document's tokens; rows at the end that have fewer than
    two columns after rows with more are notes and go."""
    t = with_box(well_formed(tokens)).where(F.col(DOC).isNotNull()).select(DOC, "token_id", "text", "score", "left", "cx", "cy")
    far = lambda at, gap, w: F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    across, down = (W.partitionBy(DOC).orderBy(at, "token_id") for at in ("left", "cy"))
    t = t.withColumn("__n", far("left", col_gap, across)).withColumn("col_idx", F.sum("__n").over(across).cast("int"))
    # a row has two columns where some token of it stands in another one than the token before
    t = t.withColumns({"__n": far("cy", row_gap, down), "__before": F.lag("col_idx").over(down)})
    t = t.withColumn("row_idx", F.sum("__n").over(down).cast("int"))
    wide = (F.col("__n") == 0) & (F.col("__before") != F.col("col_idx"))
    t = t.withColumn("last", F.max(F.when(wide, F.col("row_idx"))).over(W.partitionBy(DOC)))
    return t.where("row_idx <= last").select(DOC, "token_id", "row_idx", "col_idx", "text", "score", "cx")


def regular_grid(placed: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """doc_id, certified: every token of ``group_without_rules`` stands on its column's median centre."""
    anchors = placed.groupBy(DOC, "col_idx").agg(F.percentile("cx", F.lit(0.5)).alias("anchor"))
    return placed.join(anchors, [DOC, "col_idx"]).groupBy(DOC).agg(F.bool_and(F.abs(F.col("cx") - F.col("anchor")) <= tolerance).alias("certified"))
