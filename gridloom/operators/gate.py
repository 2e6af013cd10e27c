"""States, requests, error classes and messages around the publication gate, which ``responses`` has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import DOC, let

#: The error codes of the protocol, the field that each names, and whether a retry may help.
#: INSUFFICIENT_MEMORY may be tried again only where the language's own allocation failed, which the raw line doesn't tell.
ERROR_CODES = (
    ("UNSUPPORTED_PROTOCOL", "protocol", False),
    ("UNSUPPORTED_ACTION", "action", False),
    ("INVALID_REQUEST", "request_id", False),
    ("INVALID_OPTION", "options", False),
    ("IMAGE_PATH_REQUIRED", "image_path", False),
    ("IMAGE_NOT_FOUND", "image_path", False),
    ("IMAGE_READ_FAILED", "image_path", False),
    ("OUTPUT_DIRECTORY_INVALID", "output_directory", False),
    ("OUTPUT_WRITE_FAILED", "output_directory", True),
    ("MODEL_MISSING", None, False),
    ("MODEL_HASH_MISMATCH", None, False),
    ("EXPORT_PATH_REQUIRED", "output_path", False),
    ("EXPORT_GRID_INVALID", "cells", False),
    ("EXPORT_SPAN_INVALID", "spans", False),
    ("EXPORT_WRITE_FAILED", "output_path", True),
    ("NETWORK_ACCESS_DENIED", None, False),
    ("RECOGNITION_BUDGET_EXCEEDED", None, True),
    ("INSUFFICIENT_MEMORY", None, False),
    ("INTERNAL_ERROR", None, True),
)
#: Actions of the protocol, and the values of its options.
ACTIONS = ("recognize", "export_xlsx", "health", "warmup")
CROP_MODES = ("auto", "grid", "full")
ACCURACY_MODES = ("adaptive", "adaptive_high", "maximum")
BOOLEAN_OPTIONS = ("input_rectified", "selected_table_region")
LARGEST_ID = 2147483647


def state_consistent(state: Column, blocked: Column) -> Column:
    """I7."""
    return (state == "blocked") == blocked


class _Request:
    """The parts of a raw request line, with their JSON types: STRING, BIGINT, BOOLEAN, VOID, ARRAY ... or null if absent."""

    def __init__(self, raw: Column):
        self.raw, self.whole = raw, F.try_parse_json(raw)

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.whole, f"$.{path}", "variant"))

    def get(self, path: str, as_type: str) -> Column:
        return F.try_variant_get(self.whole, f"$.{path}", as_type)

    def is_text(self, path: str) -> Column:
        """A text that isn't blank."""
        return F.coalesce((self.kind(path) == "STRING") & self.get(path, "string").rlike(r"(?U)\S"), F.lit(False))

    def is_number(self, path: str) -> Column:
        return F.coalesce(self.kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    def is_one_of(self, path: str, values: tuple[str, ...]) -> Column:
        return F.coalesce((self.kind(path) == "STRING") & self.get(path, "string").isin(*values), F.lit(False))

    def is_object(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))


def _shown(cell: Column) -> Column:
    """The text that a cell of an export shows, "" for none."""
    own = F.when(F.schema_of_variant(cell).startswith("OBJECT"), F.try_variant_get(cell, "$.text", "string")).otherwise(F.try_variant_get(cell, "$", "string"))
    return F.coalesce(own, F.lit(""))


def _filled(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _is_exportable(grid: Column) -> Column:
    """Rows of one width of a cell or more, some text among them."""
    width = F.size(F.get(grid, F.lit(0)))
    return (width > 0) & F.forall(grid, lambda row: F.coalesce(F.size(row) == width, F.lit(False))) & F.exists(grid, lambda row: F.exists(row, _filled))


def _spans_hold(r: _Request, grid: Column) -> Column:
    """Whether the spans of an export can be made; absent or null ones can."""
    n_rows, n_cols = F.size(grid), F.size(F.get(grid, F.lit(0)))
    names = ("row", "column", "row_span", "column_span")

    def read(span: Column) -> Column:
        x = F.try_variant_get(span, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")
        whole = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long"))
        size = lambda v: F.when(v.isNull(), 1).otherwise(whole(v))
        return F.struct(whole(x["row"]).alias("row"), whole(x["column"]).alias("col"), size(x["row_span"]).alias("rows"), size(x["column_span"]).alias("cols"), x.isNotNull().alias("object"))

    def inside(s: Column) -> Column:
        starts = (s["row"] >= 0) & (s["col"] >= 0) & (s["rows"] >= 1) & (s["cols"] >= 1)
        return F.coalesce(s["object"] & starts & (s["rows"] <= n_rows - s["row"]) & (s["cols"] <= n_cols - s["col"]), F.lit(False))

    def hides(s: Column) -> Column:
        part = lambda xs, at, n: F.slice(xs, (at + 1).cast("int"), n.cast("int"))
        filled = F.size(F.filter(F.flatten(F.transform(part(grid, s["row"], s["rows"]), lambda row: part(row, s["col"], s["cols"]))), _filled))
        anchor = _filled(F.get(F.get(grid, s["row"].cast("int")), s["col"].cast("int")))
        return filled > F.when(anchor, 1).otherwise(0)

    meets = lambda a, b: (a["row"] < b["row"] + b["rows"]) & (b["row"] < a["row"] + a["rows"]) & (a["col"] < b["col"] + b["cols"]) & (b["col"] < a["col"] + a["cols"])
    apart = lambda made: F.forall(F.transform(made, lambda s, i: F.forall(F.slice(made, 1, i), lambda t: ~meets(s, t))), lambda ok: ok)
    spans = F.transform(r.get("spans", "array<variant>"), read)
    hold = let(spans, lambda all_: F.forall(all_, inside) & apart(F.filter(all_, lambda s: inside(s) & ~hides(s))))
    absent = F.coalesce(r.kind("spans") == "VOID", F.lit(True))
    return absent | F.coalesce(hold, F.lit(False))


def request_error(raw: Column) -> Column:
    """Struct of code and field of the first rule that a raw request line breaks; null for a good one.

    A line is a JSON object with protocol 1 and a known action; request_id, if it is there, is a whole number from 1.
    To recognize, it has an image_path, perhaps an output_directory, and options as an object: known modes, a finite
    deadline_seconds of 0 or more, and true booleans. To export, it has an output_path, cells, rows of one width with some
    text, and perhaps spans: objects of whole numbers inside the grid, of which none lies over an earlier one. A span
    that hides text isn't made at export, so that it takes no place.
    What isn't JSON, NaN among it, is an INVALID_REQUEST without field, and so are options that are no object and odd
    booleans, for which the protocol has no code of their own.
    """
    r = _Request(raw)
    err = lambda code, at=None: F.struct(F.lit(code).alias("code"), F.lit(at).cast("string").alias("field"))
    recognizes, exports = (r.get("action", "string") == a for a in ("recognize", "export_xlsx"))
    there = lambda path: r.kind(path).isNotNull()
    number = r.get("request_id", "long")
    good_id = F.coalesce((r.kind("request_id") == "BIGINT") & number.between(1, LARGEST_ID), F.lit(False))
    protocol = r.kind("protocol").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)") & (r.get("protocol", "double") == 1)
    modes = (("crop_mode", CROP_MODES), ("accuracy_mode", ACCURACY_MODES))
    bad_mode = F.lit(False)
    for name, values in modes:
        bad_mode = bad_mode | (there(f"options.{name}") & ~r.is_one_of(f"options.{name}", values))
    seconds = r.get("options.deadline_seconds", "double")
    finite = F.coalesce((seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf")), F.lit(False))
    bad_deadline = there("options.deadline_seconds") & ~(r.is_number("options.deadline_seconds") & finite)
    bad_boolean = F.lit(False)
    for name in BOOLEAN_OPTIONS:
        bad_boolean = bad_boolean | (there(f"options.{name}") & (r.kind(f"options.{name}") != "BOOLEAN"))
    no_folder = there("output_directory") & (r.kind("output_directory") != "VOID") & ~r.is_text("output_directory")
    grid = F.transform(r.get("cells", "array<variant>"), lambda row: F.transform(F.try_variant_get(row, "$", "array<variant>"), _shown))
    good_cells, good_spans = F.coalesce(let(grid, _is_exportable), F.lit(False)), let(grid, lambda g: _spans_hold(r, g))
    return (
        F.when(~F.coalesce(F.schema_of_variant(r.whole).startswith("OBJECT"), F.lit(False)), err("INVALID_REQUEST"))
        .when(~F.coalesce(protocol, F.lit(False)), err("UNSUPPORTED_PROTOCOL", "protocol"))
        .when(~r.is_one_of("action", ACTIONS), err("UNSUPPORTED_ACTION", "action"))
        .when(there("request_id") & ~good_id, err("INVALID_REQUEST", "request_id"))
        .when(recognizes & ~r.is_text("image_path"), err("IMAGE_PATH_REQUIRED", "image_path"))
        .when(recognizes & no_folder, err("OUTPUT_DIRECTORY_INVALID", "output_directory"))
        .when(recognizes & there("options") & ~r.is_object("options"), err("INVALID_REQUEST"))
        .when(recognizes & (bad_mode | bad_deadline), err("INVALID_OPTION", "options"))
        .when(recognizes & bad_boolean, err("INVALID_REQUEST"))
        .when(exports & ~r.is_text("output_path"), err("EXPORT_PATH_REQUIRED", "output_path"))
        .when(exports & ~good_cells, err("EXPORT_GRID_INVALID", "cells"))
        .when(exports & ~good_spans, err("EXPORT_SPAN_INVALID", "spans"))
    )


def with_retry(spark, errors: DataFrame) -> DataFrame:
    """Rows with a column ``code`` and whether a retry may help."""
    codes = spark.createDataFrame([(code, retry) for code, _, retry in ERROR_CODES], "code string, retryable boolean")
    return errors.join(F.broadcast(codes), "code", "left")


def blocking_reasons(warnings: DataFrame, advisory: list[str]) -> DataFrame:
    """Warnings (doc_id, warning) that hold none of the advisory fragments."""
    hit = F.lit(False)
    for fragment in advisory:
        hit = hit | F.col("warning").contains(fragment)
    return warnings.where(~hit)


def advisory_precision(history: DataFrame) -> DataFrame:
    """Warning, hits, correct, may_be_advisory, from (warning, shape_match)."""
    found = history.groupBy("warning").agg(F.count("*").alias("hits"), F.count_if("shape_match").alias("correct"))
    return found.withColumn("may_be_advisory", F.col("correct") / F.col("hits") > 0.5)


def render_messages(docs: DataFrame, pending: DataFrame, prefix: str = "review: ") -> DataFrame:
    """Reasons (doc_id, reasons, publication_blocked) with the review reason made anew from the pending labels; a
    block of which no reason is left is lifted."""
    return with_messages(docs.join(pending.select(DOC, "labels"), DOC, "left"), prefix)


def with_messages(docs: DataFrame, prefix: str = "review: ") -> DataFrame:
    """I12 where documents carry their labels."""
    others = F.filter("reasons", lambda r: ~r.startswith(prefix))
    fresh = F.when(F.size("labels") > 0, F.array(F.concat(F.lit(prefix), F.array_join("labels", ", ")))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("reasons", F.concat(others, fresh))
    return out.withColumn("publication_blocked", F.col("publication_blocked") & (F.size("reasons") > 0)).drop("labels")


#: The failure of a recognition, not of its input, for which a degraded table is given: of its time; null tells that
#: nothing was found.
SOFT_FAILURE = "RECOGNITION_BUDGET_EXCEEDED"


def degraded(failures: DataFrame) -> DataFrame:
    """Failed documents (doc_id, code of the contract, null where no text or no table was found). A recognition that ran
    out of time or found nothing becomes a blank 1 x 1 table to review, blocked; errors of input or installation stay."""
    soft = F.coalesce(F.col("code") == SOFT_FAILURE, F.lit(True))
    table = {"n_rows": F.lit(1), "n_cols": F.lit(1), "text": F.lit(""), "confidence": F.lit(0.0), "needs_review": F.lit(True), "recognition_state": F.lit("blocked")}
    status = F.when(soft, "ok").otherwise("error").alias("status")
    return failures.select(DOC, "code", status, soft.alias("degraded"), *(F.when(soft, v).alias(k) for k, v in table.items()), soft.alias("publication_blocked"))


def table_warning(cells: DataFrame) -> DataFrame:
    """doc_id, uncertain, warn: eight or more uncertain cells that are more than a quarter."""
    n = cells.groupBy(DOC).agg(F.count_if((F.col("confidence") > 0) & (F.col("confidence") < 0.78)).alias("uncertain"), F.count("*").alias("cells"))
    return n.select(DOC, "uncertain", ((F.col("uncertain") >= 8) & (F.col("uncertain") * 4 > F.col("cells"))).alias("warn"))
