"""Sources: manifests, truth, result documents, table markup, protocol lines, inventories, annotations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest span of a markup cell that is believed.
MAX_SPAN = 1024
#: Annotation keys that hold text, and those that are walked into.
TEXT_KEYS = ("text", "transcription")
WALKED_KEYS = ("form", "document", "words", "cells", "gt_parse", "valid_line", "ground_truth", "value")
#: Folders that no delivery counts, and endings of files that it doesn't either, in any case.
LEFT_OUT_FOLDERS = ("pyinstaller-work", "__pycache__", ".git", ".vs", ".idea", ".vscode")
LEFT_OUT_ENDINGS = ("pyc", "pyo", "bak", "tmp", "orig", "rej")
LEFT_OUT = f"(^|/)({'|'.join(map(re.escape, LEFT_OUT_FOLDERS))})/|(?i)\\.({'|'.join(LEFT_OUT_ENDINGS)})$"
#: A record of a CSV text, up to its line break, and a field after its comma. Neither gives back what it has read.
RECORD = r'((?:[^"\r\n]++|"[^"]*+(?:""[^"]*+)*+")*+)\r\n'
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'

#: A page of plain tags and texts, in which markup has no other meaning: no references, comments, scripts or odd spelling.
_TAG = "(?:table|thead|tbody|tfoot|caption|tr|td|th|br|p|div|span|b|i|em|strong)"
PLAIN_PAGE = re.compile(rf'(?:[^<&]++|<{_TAG}(?: [a-z]+="[^"<>&]*+")*+>|</{_TAG}>)*+')
#: Its rows and cells: a row's start, its end, a cell's start, attributes, content and end, and the end of a cell that isn't begun there.
_PLAIN_PIECE = re.compile(r"(<tr[ >])|(</tr>)|<(t[dh])(?=[ >])([^>]*)>([^<]*+(?:<(?!/?t[dhr][ >])[^>]*>[^<]*+)*+)(</t[dh]>)?|(</t[dh]>)")
_PLAIN_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')


def read_manifest(spark: SparkSession, path: str, ids: list[str] | None = None, source: str | None = None, split: str | None = None, limit: int | None = None) -> DataFrame:
    """A1: manifest rows; a missing source is ``local``, a missing split ``development``; the first ``limit`` by id."""
    rows = spark.read.csv(path, header=True)
    for name, default in (("source", "local"), ("split", "development")):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(default)) if name in rows.columns else F.lit(default))
    if ids is not None:
        rows = rows.where(F.col("case_id").isin(*ids))
    rows = rows.where(F.col("source") == source) if source else rows
    rows = rows.where(F.col("split") == split) if split else rows
    return rows.orderBy("case_id").limit(limit) if limit else rows


def truth_cells(docs: DataFrame) -> DataFrame:
    """A2: doc_id, row_idx, col_idx, text, ambiguous of truth documents (doc_id, json)."""
    parsed = docs.select("doc_id", F.from_json("json", "cells array<array<string>>, ambiguous_cells array<struct<row:int,column:int>>").alias("t"))
    rows = parsed.select("doc_id", F.posexplode("t.cells").alias("row_idx", "r"), F.col("t.ambiguous_cells").alias("amb"))
    cells = rows.select("doc_id", "row_idx", F.posexplode("r").alias("col_idx", "text"), "amb")
    odd = F.exists("amb", lambda a: (a["row"] == F.col("row_idx")) & (a["column"] == F.col("col_idx")))
    return cells.select("doc_id", "row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(odd, F.lit(False)).alias("ambiguous"))


def cells_from_documents(docs: DataFrame, column: str = "json") -> DataFrame:
    """A3: doc_id, row_idx, col_idx, text of result documents, whose cells are objects with a text, or texts."""
    grid = F.try_variant_get(F.try_parse_json(column), "$.cells", "array<variant>")
    rows = docs.select("doc_id", F.posexplode(grid).alias("row_idx", "r"))
    cells = rows.select("doc_id", "row_idx", F.posexplode(F.try_variant_get("r", "$", "array<variant>")).alias("col_idx", "cell"))
    own = F.when(F.schema_of_variant("cell").startswith("OBJECT"), F.try_variant_get("cell", "$.text", "string")).otherwise(F.try_variant_get("cell", "$", "string"))
    return cells.select("doc_id", "row_idx", "col_idx", F.coalesce(own, F.lit("")).alias("text"))


class _Events(HTMLParser):
    """The tags and texts of a page as (kind, value) pairs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, object]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((f"<{tag}", dict(attrs)))

    def handle_endtag(self, tag):
        self.found.append((f"/{tag}", None))

    def handle_data(self, data):
        self.found.append(("text", data))


def _plain_rows(html: str) -> list[list[tuple[str, int, int]]] | None:
    """``markup_rows`` of a plain page, taken apart by one expression, many times as fast as by the parser; null where a cell
    ends outside of any, which may still close an earlier one."""
    rows: list = []
    row: list | None = None
    for begins, ends, cell, attrs, content, closed, stray in _PLAIN_PIECE.findall(html):
        if stray:
            return None
        if cell:
            if row is not None and closed:
                if "<" in content:
                    content = re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", content))
                size = dict(_PLAIN_ATTRIBUTE.findall(attrs)) if attrs else {}
                row.append((" ".join(content.split()), span_size(size.get("rowspan")) if size else 1, span_size(size.get("colspan")) if size else 1))
        elif begins:
            row = []
        elif row is not None:
            rows.append(row)
            row = None
    return rows


def markup_rows(html: str | None) -> Iterator[list[tuple[str, int, int]]]:
    """Rows of (text, row span, column span) of all tables of a page, one after the other. Rows and cells count when
    their end tag comes; white space, line breaks among it, is one blank."""
    html = html or ""
    plain = _plain_rows(html) if PLAIN_PAGE.fullmatch(html) else None
    return _parsed_rows(html) if plain is None else iter(plain)


def _parsed_rows(html: str) -> Iterator[list[tuple[str, int, int]]]:
    parser = _Events()
    parser.feed(html)
    row: list | None = None
    open_cell: tuple | None = None
    words: list[str] = []
    for kind, value in parser.found:
        match kind:
            case "<tr":
                row = []
            case "<td" | "<th" if row is not None:
                open_cell, words = (span_size(value.get("rowspan")), span_size(value.get("colspan"))), []
            case "<br":
                words.append(" ")
            case "text":
                words.append(value)
            case "/td" | "/th" if row is not None and open_cell:
                row.append((" ".join("".join(words).split()), *open_cell))
                open_cell = None
            case "/tr" if row is not None:
                yield row
                row = None


def span_size(raw: str | None) -> int:
    """1 to MAX_SPAN; 1 for anything else than a positive whole number."""
    try:
        return max(1, min(int((raw or "").strip()), MAX_SPAN))
    except ValueError:
        return 1


def markup_cells(html: str | None) -> list[tuple[int, int, str, int, int]]:
    """(row, column, text, row span, column span) of a page's cells within a grid of MAX_SPAN x MAX_SPAN; only an anchor's
    own slot must be free. Of each column it is enough to know down to which row it is taken."""
    until, out = [0] * (MAX_SPAN + 1), []
    for r, row in enumerate(markup_rows(html)):
        if r >= MAX_SPAN:
            break
        c = 0
        for text, down, across in row:
            while c < MAX_SPAN and until[c] > r:
                c += 1
            if c >= MAX_SPAN:
                break
            if down > 1 or across > 1:
                down, across = min(down, MAX_SPAN - r), min(across, MAX_SPAN - c)
            out.append((r, c, text, down, across))
            if down > 1:
                for k in range(c, c + across):
                    until[k] = max(until[k], r + down)
            c += across
    return out


def html_tables_to_cells(pages: DataFrame, column: str = "html") -> DataFrame:
    """A4: doc_id, row_idx, col_idx, text, row_span, col_span: the anchors of each page's tables; spans over 1 are its
    merged regions, cut where the largest grid ends; cells beyond it are none."""

    kinds = {"doc_id": "int64", "row_idx": "int32", "col_idx": "int32", "text": "string", "row_span": "int32", "col_span": "int32"}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, cells = [], []
            for doc, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = markup_cells(html)
                docs.extend([doc] * len(found))
                cells.extend(found)
            columns = (docs, *(zip(*cells, strict=True) if cells else [()] * (len(kinds) - 1)))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    return pages.select(F.col("doc_id").cast("long"), F.col(column).cast("string")).mapInArrow(walk, "doc_id long, row_idx int, col_idx int, text string, row_span int, col_span int")


def split_protocol_lines(lines: DataFrame) -> DataFrame:
    """A5, M4: lines (value, ...) that aren't blank, with ``json`` null and ``bad`` true where a line is no JSON object."""
    parsed = F.try_parse_json("value")
    good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return lines.where(F.trim("value") != "").withColumns({"bad": ~good, "json": F.when(good, F.col("value"))})


def read_protocol_stream(spark: SparkSession, path: str) -> DataFrame:
    """A5: a stream of the lines of text files."""
    return split_protocol_lines(spark.readStream.text(path))


def pick_evenly(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows at even positions by ``order``: round-half-even(i (N - 1) / (n - 1))."""
    from ..operators.sampling import numbered

    total = rows.agg(F.count("*").alias("total"))
    picks = total.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("total") - 1) / max(n - 1, 1)).cast("long"))).alias("pos"))
    return numbered(rows, "pos", order).join(F.broadcast(picks), "pos").drop("pos")


def csv_fields(csv: Column) -> Column:
    """The rows of fields of a CSV text as L1 writes it, without its review note."""
    inner = lambda f: F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    field = lambda f: F.when(F.startswith(f, F.lit('"')), inner(f)).otherwise(f)
    fields = lambda record: F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1)), field)
    return F.transform(F.regexp_extract_all(F.regexp_replace(csv, "^\ufeff", ""), F.lit(RECORD), F.lit(1)), fields)


def parse_csv_texts(texts: DataFrame) -> DataFrame:
    """doc_id, row_idx, col_idx, text of CSV texts (doc_id, csv) as L1 writes them, without its review note. Line
    breaks, commas and quotes within quotes belong to the text."""
    records = texts.select("doc_id", F.posexplode(csv_fields(F.col("csv"))).alias("row_idx", "fields"))
    return records.select("doc_id", "row_idx", F.posexplode("fields").alias("col_idx", "text"))


def _below(root: str) -> Column:
    """The rest of ``path`` under ``root``; null elsewhere. Local paths may be given with or without ``file:``."""
    plain = re.sub("^file:/+", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/+", "/")
    return F.when(F.startswith(path, F.lit(plain)), path.substr(F.lit(len(plain) + 1), F.length(path)))


def file_inventory(spark: SparkSession, path: str, excluded: str = LEFT_OUT) -> DataFrame:
    """Path, bytes, modified, sha256 of the files under ``path``, but for those whose path below it is excluded.
    Contents are read only where sha256 is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    counted = files.where(~F.coalesce(_below(path), F.col("path")).rlike(excluded))
    return counted.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def subtree_sizes(inventory: DataFrame, root: str) -> DataFrame:
    """Files, bytes and newest time by first folder under ``root``; files right below it have none, ''."""
    top = F.regexp_extract(F.coalesce(_below(root), F.lit("")), "^([^/]+)/", 1)
    return inventory.groupBy(top.alias("subtree")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest"))


def delivery_facts(inventory: DataFrame, root: str, body: str, licenses: str = "licenses") -> DataFrame:
    """One row on a delivery of the inventory's files under ``root``, against its main part, the folder ``body``.

    package_files, package_bytes, body_files, body_bytes, body_newest; extra_files and delta_kb (to the nearest of
    1024 bytes, halves to even) are the differences; root_files lie right below ``root``, license_files in
    ``licenses``. Sums over no files are 0, their newest time null."""
    files = inventory.withColumn("rest", _below(root)).where("rest is not null")
    within = lambda folder: F.startswith(F.col("rest"), F.lit(folder.strip("/") + "/"))
    facts = files.agg(
        F.count("*").alias("package_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("package_bytes"),
        F.count_if(within(body)).alias("body_files"),
        F.coalesce(F.sum(F.when(within(body), F.col("bytes"))), F.lit(0)).alias("body_bytes"),
        F.max(F.when(within(body), F.col("modified"))).alias("body_newest"),
        F.count_if(~F.contains(F.col("rest"), F.lit("/"))).alias("root_files"),
        F.count_if(within(licenses)).alias("license_files"),
    )
    delta = F.rint((F.col("package_bytes") - F.col("body_bytes")) / 1024).cast("long")
    return facts.withColumns({"extra_files": F.col("package_files") - F.col("body_files"), "delta_kb": delta})


def _strings(value, keyed: bool) -> list[str]:
    """Leaf strings in the document's order: what is still to be visited lies on a stack, the next on top."""
    found, waiting = [], [value]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            found += [node] if node.strip() else []
        elif isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            texts = (node.get(k) for k in TEXT_KEYS) if keyed else ()
            own = next((t for t in texts if isinstance(t, str) and t.strip()), None)
            inner = [v for k, v in node.items() if not keyed or k in WALKED_KEYS]
            waiting += reversed(inner) if own is None else [own]
    return found


def collect_strings(keyed: bool = True):
    """A column function: leaf strings of an annotation JSON, of text keys alone or (``keyed`` false) of all."""

    @F.pandas_udf("array<string>")
    def walk(raw: pd.Series) -> pd.Series:
        def one(text):
            try:
                return _strings(json.loads(text), keyed)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t) for t in raw], dtype=object)

    return walk


