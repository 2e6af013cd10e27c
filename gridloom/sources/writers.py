"""Sinks: CSV of tables, sheet layouts, manifests, summaries, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_guard, csv_quote, display_width
from ..operators.grid import DOC, MAX_SLOTS, let, rectangularize, unicode_trim
from ..operators.review import cell_label
from .folders import stored
from .readers import csv_fields

BOM, CRLF = "\ufeff", "\r\n"


def exportable(cells: DataFrame) -> DataFrame:
    """L3: doc_id of documents with some text."""
    return cells.groupBy(DOC).agg(F.bool_or(unicode_trim(F.col("text")) != "").alias("some")).where("some").select(DOC)


def _documents(cells: DataFrame) -> DataFrame:
    """doc_id, rows: (row_idx, fields: (col_idx, f)) of the padded grid with its guards, of documents with some text. All is
    gathered where the document lies."""
    guarded = F.struct("col_idx", csv_guard(F.col("text")).alias("f"))
    filled = F.bool_or(unicode_trim(F.col("text")) != "").alias("some")
    lines = rectangularize(cells).groupBy(DOC, "row_idx").agg(F.sort_array(F.collect_list(guarded)).alias("fields"), filled)
    docs = lines.groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("row_idx", "fields"))).alias("rows"), F.bool_or("some").alias("some"))
    return docs.where("some").drop("some")


def csv_texts(cells: DataFrame) -> DataFrame:
    """L1: doc_id, csv: guarded, quoted fields, CRLF lines after a byte order mark; documents without text have none.

    Where cells have needs_review, a last record ``# review: R1C1 ...`` names the flagged ones. A document's cells are gathered
    once, with their fields made before; only where its grid has gaps are blank places put between them."""
    kind = {f.name: f.dataType for f in cells.schema.fields}
    review = F.coalesce("needs_review", F.lit(False)) if "needs_review" in kind else F.lit(False)
    ready = cells.select(DOC, "row_idx", "col_idx", F.col("text").rlike(r"(?U)\S").alias("some"), csv_guard(F.coalesce("text", F.lit(""))).alias("f"), review.alias("review"))
    ready = ready.withColumn("quoted", csv_quote(F.col("f")))
    # by the field as it is guarded, as in ``_documents``, not as it is quoted
    field = F.struct("row_idx", "col_idx", "f", F.when(F.col("quoted") != F.col("f"), F.col("quoted")).alias("quoted"), "review")
    own = ready.groupBy(DOC).agg(
        F.sort_array(F.collect_list(field)).alias("cells"),
        (F.max("row_idx").cast("long") + 1).alias("h"),
        (F.max("col_idx").cast("long") + 1).alias("w"),
        F.least(F.min("row_idx"), F.min("col_idx")).alias("least"),
        F.bool_or("some").alias("some"),
    ).where("some")
    w, size = F.col("w"), F.col("h") * F.col("w")
    place = lambda x: x["row_idx"] * w + x["col_idx"]
    full = (F.size("cells") == size) & F.forall(F.transform("cells", lambda x, i: place(x) == i), lambda same: same)
    pads = (F.col("least") >= 0) & (size <= MAX_SLOTS) & ~F.coalesce(full, F.lit(False))
    blank = lambda p: F.struct((p / w).cast(kind["row_idx"]).alias("row_idx"), (p % w).cast(kind["col_idx"]).alias("col_idx"), F.lit("").alias("f"), F.lit(None).cast("string").alias("quoted"), F.lit(False).alias("review"))
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), size - 1), F.transform("cells", place))
    grid = F.when(pads, F.sort_array(F.concat("cells", F.transform(missing, blank)))).otherwise(F.col("cells"))

    def written(cells: Column) -> Column:
        lead = lambda x, i: F.when(i == 0, BOM).when(F.get(cells, i - 1)["row_idx"].eqNullSafe(x["row_idx"]), ",").otherwise(CRLF)
        return F.array_join(F.transform(cells, lambda x, i: F.concat(lead(x, i), F.coalesce(x["quoted"], x["f"]))), "")

    labels = F.transform(F.filter("cells", lambda x: x["review"]), lambda x: cell_label(x["row_idx"], x["col_idx"]))
    note = F.when(F.size("labels") > 0, F.concat(F.lit("# review: "), F.array_join("labels", " "), F.lit(CRLF))).otherwise("")
    return own.select(DOC, let(grid, written).alias("csv"), labels.alias("labels")).select(DOC, F.concat("csv", F.lit(CRLF), note).alias("csv"))


def csv_texts_plain(cells: DataFrame) -> DataFrame:
    """L2: as L1 without a note; documents with a missing cell or a null text are left out."""
    full = cells.groupBy(DOC).agg(F.count("text").alias("n"), ((F.max("row_idx") + 1) * (F.max("col_idx") + 1)).alias("size")).where("n = size").select(DOC)
    return csv_texts(cells.select(DOC, "row_idx", "col_idx", "text").join(full, DOC, "left_semi"))


def sheet_columns(cells: DataFrame) -> DataFrame:
    """L4: doc_id, col_idx, width: widest text and 2, within 10 to 48."""
    return cells.groupBy(DOC, "col_idx").agg(F.greatest(F.lit(10), F.least(F.lit(48), F.max(display_width(F.col("text"))) + 2)).alias("width"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """L4: doc_id, row_idx, height: 18 a line, where texts wrap at their column's width less 2, within 22 to 396."""
    width = sheet_columns(cells)
    lines = lambda: F.aggregate(F.transform(F.split("text", "\n"), lambda x: F.greatest(F.lit(1), F.ceil(display_width(x) / (F.col("width") - 2)).cast("int"))), F.lit(0), lambda a, b: a + b)
    return cells.join(width, [DOC, "col_idx"]).groupBy(DOC, "row_idx").agg(F.greatest(F.lit(22), F.least(F.lit(396), F.max(lines()) * 18)).alias("height"))


def sheet_frame(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """L4: doc_id, header_row (after the last title row), freeze_row, filtered (two or more header texts)."""
    titles = spans.where("role = 'title'").groupBy(DOC).agg(F.max(F.col("row_idx") + F.col("row_span")).alias("after"))
    head = cells.join(titles, DOC, "left").withColumn("header_row", F.coalesce("after", F.lit(0)))
    found = head.groupBy(DOC, "header_row").agg(F.count_if((F.col("row_idx") == F.col("header_row")) & (unicode_trim(F.col("text")) != "")).alias("n"))
    return found.select(DOC, "header_row", (F.col("header_row") + 1).alias("freeze_row"), (F.col("n") >= 2).alias("filtered"))


def _read_back(cells: DataFrame, path: str) -> DataFrame:
    """doc_id, rows (wanted, as of ``_documents``) and got (rows of fields) of L1's CSV texts, written as a table at ``path``,
    and csv_ok: as wanted, in the places wanted. Both sides of a document meet in one row."""
    plain = cells.select(DOC, "row_idx", "col_idx", "text")
    csv_texts(plain).write.mode("errorifexists").parquet(path)
    read = cells.sparkSession.read.parquet(path).select(DOC, csv_fields(F.col("csv")).alias("got"))
    met = _documents(plain).join(read, DOC, "full_outer")
    in_place = ~F.exists(F.transform("rows", lambda r, i: (r["row_idx"] != i) | F.exists(F.transform(r["fields"], lambda x, j: x["col_idx"] != j), lambda x: x)), lambda x: x)
    same = F.transform("rows", lambda r: r["fields"]["f"]) == F.col("got")
    return met.withColumn("csv_ok", F.coalesce(in_place & same, F.lit(False)))


def roundtrip_differences(cells: DataFrame, path: str) -> DataFrame:
    """doc_id, row_idx, col_idx, want, got where the CSV that was delivered doesn't read as the padded grid with
    its guards. The CSV texts of L1 are written to ``path`` as a table of one text a document, and read from there."""
    wrong = _read_back(cells, path).where(~F.col("csv_ok"))
    want = wrong.select(DOC, F.inline("rows")).select(DOC, "row_idx", F.inline("fields")).withColumnRenamed("f", "want")
    got = wrong.select(DOC, F.posexplode("got").alias("row_idx", "g")).select(DOC, "row_idx", F.posexplode("g").alias("col_idx", "got"))
    return want.join(got, [DOC, "row_idx", "col_idx"], "full_outer").where(~F.col("want").eqNullSafe(F.col("got")))


def roundtrip_check(cells: DataFrame, path: str) -> DataFrame:
    """doc_id, n_cells, csv_ok (no differences) of each document that has a CSV."""
    n_cells = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + F.size(r["fields"]))
    return _read_back(cells, path).select(DOC, F.coalesce(n_cells, F.lit(0)).alias("n_cells"), "csv_ok")


def write_summary(records: DataFrame, path: str) -> None:
    """Scalar columns, sorted by name, as CSV; whole records as JSON."""
    scalar = sorted(c for c, t in records.dtypes if not t.startswith(("array", "map", "struct")))
    records.select(*scalar).write.csv(f"{path}/csv", header=True)
    records.write.json(f"{path}/json")


def write_manifest(rows: DataFrame, path: str) -> int:
    """CSV with a byte order mark, and JSON lines; both are read back and must have all rows. Fields may have line breaks,
    commas and quotes. ``rows`` is computed once."""
    spark, kept = rows.sparkSession, stored(rows, "manifest-rows")
    header = ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *(quoted(c) for c in rows.columns))
    # every file is a CSV of its own, with mark and header before its first record
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    kept.select(F.concat(F.when(first, BOM + header + CRLF).otherwise(""), line).alias("value")).write.text(f"{path}/csv", lineSep=CRLF)
    kept.write.json(f"{path}/jsonl")
    counts = [kept.count(), read_manifest_csv(spark, f"{path}/csv").count(), spark.read.text(f"{path}/jsonl").count()]
    if len(set(counts)) > 1:
        raise RuntimeError(f"manifest of {counts[0]} rows has {counts[1]} CSV records and {counts[2]} JSON lines")
    return counts[0]


def read_manifest_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of L7's CSV files. Spark's reader gives a CRLF within a field as a line feed."""
    reader = spark.read.option("multiLine", True).option("escape", '"').option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def publish(rows: DataFrame, path: str) -> None:
    """Written under a committer, and never over earlier output."""
    rows.write.mode("errorifexists").parquet(path)


