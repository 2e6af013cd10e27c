"""Registered queries of text functions and merged regions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import spans as sp
from ..operators.grid import shape
from .fixtures import ACTUAL, SPANS, STRINGS, TRUTH, cells_truth, spans, strings, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _each(**columns):
    """A query that applies column functions to the texts of ``strings``."""

    def run(spark, d):
        return strings(spark, d).select("id", *(f(F.col("text")).alias(k) for k, f in columns.items()))

    return run


def _text_query(name: str, sql: str, **columns) -> None:
    QUERIES[name] = _each(**columns)
    ORACLE[name] = f"with {STRINGS} select id, {sql} from strings"


MANTISSA = "regexp_replace(regexp_replace(text, '^[+-]|%$', '', 'g'), '[eE].*$', '')"
DIGITS = "length(regexp_replace(replace({}, '.', ''), '^0+|0+$', '', 'g'))"
GUARD = f"""(case when length(text) <= 1 then false when regexp_matches(text, '^[=@\\t\\r\\n]') then true
  when regexp_matches(text, '^[+-]') then not (regexp_matches(text, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?%?$') and {DIGITS.format(MANTISSA)} <= 15)
  else regexp_matches(text, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') and ({DIGITS.format("text")} > 15 or (starts_with(text, '0') and not contains(text, '.'))) end)"""

_text_query("g1_normalize_text", "lower(regexp_replace(text, '\\s+', '', 'g')) as norm", norm=tx.normalize_text)
_text_query("g3_g4_xml_and_display", "text as safe, text as shown", safe=tx.xml_safe, shown=tx.display_text)
_text_query("g5_g6_widths", "list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::int as width, list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(length(x) / 5.0)::int)))::int as lines", width=tx.display_width, lines=lambda t: tx.wrapped_lines(t, 5))
_text_query("g7_csv_guard", f"case when {GUARD} then '''' || text else text end as guarded", guarded=tx.csv_guard)
_text_query("g8_csv_quote", "case when regexp_matches(text, '[,\"\\x00-\\x1F]') then '\"' || replace(text, '\"', '\"\"') || '\"' else text end as quoted", quoted=tx.csv_quote)
_text_query("g9_compact_number", "case when id % 24 = 15 then '1 ' || (id % 90 + 10) || '.5' else text end as compact", compact=tx.compact_number)
_text_query("g10_restore_diameter", "case when id % 24 = 10 then 'Φ' || substr(text, 2) else text end as restored", restored=lambda t: tx.restore_diameter(t, F.lit(False)))
_text_query("g11_restore_dash", "case when id % 24 = 11 then replace(text, '~', '-') else text end as restored", restored=tx.restore_dash)
_text_query("g14_g15_units_and_glyphs", "text as units, false as unknown", units=tx.normalize_units, unknown=tx.has_unknown_glyph)
_text_query("g16_balance", "length(text) - length(replace(text, '(', '')) = length(text) - length(replace(text, ')', '')) and length(text) - length(replace(text, '[', '')) = length(text) - length(replace(text, ']', '')) as ok, case when id % 24 = 16 then 0.77::double else 0.9::double end as confidence", ok=tx.balanced, confidence=lambda t: tx.formula_confidence(t, F.lit(0.9)))
_text_query("g17_locations", "regexp_extract_all(text, 'R[0-9]+C[0-9]+') as labels", labels=tx.locations)
_text_query("g19_output_name", "case when regexp_replace(regexp_replace(text, '^.*[/\\\\]', ''), '\\.[^.]*$', '') = '' then 'table' else regexp_replace(regexp_replace(text, '^.*[/\\\\]', ''), '\\.[^.]*$', '') end || '.xlsx' as file", file=tx.output_name)


@query(f"with {STRINGS} select id, list_sort(list_distinct(regexp_extract_all(' ' || text, '([^0-9A-Za-z_.+-]|^)([+-]?[0-9]+([.,][0-9]+)*(%|[A-Za-z]+)?)', 2))) as numbers from strings where id % 24 in (8, 19, 22)")
def g2_numeric_tokens(spark, d):
    return strings(spark, d).where("id % 24 in (8, 19, 22)").select("id", F.sort_array(tx.numeric_tokens(F.col("text"))).alias("numbers"))


@query(f"""with {ACTUAL}, odd as (select doc_id, row_idx, col_idx, case when col_idx = 3 and doc_id % 3 = 0 and row_idx % 2 = 1 then '%' || replace(text, '%', '') else text end as text from truth),
peers as (select doc_id, col_idx, list(distinct text) as p from odd group by all), same as (select doc_id, col_idx, text, count(*) as n from odd group by all)
select doc_id, row_idx, col_idx, case when not regexp_matches(text, '^%[0-9]+$') then text when list_contains(p, substr(text, 2) || '%') then substr(text, 2) || '%'
  when n >= 3 and (regexp_matches(substr(text, 2), '^[01689]+$') or regexp_matches(substr(text, 2), '^[569]+$')) then reverse(translate(substr(text, 2), '69', '96')) || '%' else text end as text
from odd join peers using (doc_id, col_idx) join same using (doc_id, col_idx, text)""")
def g12_fix_reversed_percent(spark, d):
    odd = (F.col("col_idx") == 3) & (F.col("doc_id") % 3 == 0) & (F.col("row_idx") % 2 == 1)
    cells = cells_truth(spark, d).withColumn("text", F.when(odd, F.concat(F.lit("%"), F.replace("text", F.lit("%"), F.lit("")))).otherwise(F.col("text")))
    return tx.fix_reversed_percent(cells.drop("h"))


@query(f"""with {TRUTH}, letters as (select doc_id, row_idx, col_idx, case when h % 9 = 0 then upper(chr(97 + (h % 26)::int)) else chr(97 + (h % 26)::int) end as text from truth where col_idx = 5)
select doc_id, row_idx, col_idx, case when (count(*) filter (regexp_matches(text, '^[a-z]$')) over (partition by doc_id, col_idx)) >= 0.8 * (count(*) over (partition by doc_id, col_idx)) then lower(text) else text end as text from letters""")
def g13_repair_case(spark, d):
    letter = F.chr((F.col("h") % 26 + 97).cast("long"))
    cells = cells_truth(spark, d).where("col_idx = 5").withColumn("text", F.when(F.col("h") % 9 == 0, F.upper(letter)).otherwise(letter)).drop("h")
    return tx.repair_case(cells)


@query("select o_orderkey::bigint as id, list_transform(list_concat(range(o_orderkey % 50 + 1, o_orderkey % 50 + 4), [o_orderkey % 7 + 90]), lambda x: 'FC-' || lpad(x::varchar, 5, '0')) as ids from orders")
def g18_id_ranges(spark, d):
    k = F.col("o_orderkey")
    text = F.concat((k % 50 + 1).cast("string"), F.lit("-"), (k % 50 + 3).cast("string"), F.lit(", FC-000"), (k % 7 + 90).cast("string"))
    return table(spark, d, "orders").select(k.cast("bigint").alias("id"), tx.id_ranges(text).alias("ids"))


@query("select o_orderkey::bigint as id, case o_orderkey % 3 when 0 then ['a'] when 1 then []::varchar[] else null end as repeated from orders")
def g20_duplicate_json_keys(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"x": {"a": '), k.cast("string"), F.lit(', "\\u0061": 2}}'))).when(k % 3 == 1, F.concat(F.lit('[{"a": 1}, {"a": '), k.cast("string"), F.lit("}]"))).otherwise(F.lit('{"a": '))
    return table(spark, d, "orders").select(k.cast("bigint").alias("id"), tx.duplicate_json_keys()(raw).alias("repeated"))


# Merged regions ---------------------------------------------------------------------------------------------

COVER = """
cover as (
  select doc_id, span_id, r.row_idx::int as row_idx, c.col_idx::int as col_idx, r.row_idx = s.row_idx and c.col_idx = s.col_idx as anchor
  from spans s, lateral (select unnest(range(s.row_idx, s.row_idx + s.row_span)) as row_idx) r, lateral (select unnest(range(s.col_idx, s.col_idx + s.col_span)) as col_idx) c),
shape as (select doc_id, max(row_idx) + 1 as n_rows, max(col_idx) + 1 as n_cols from truth group by doc_id)"""
CELLS = "seen as (select doc_id, row_idx, col_idx, case when h % 3 = 0 then '' else text end as text, h % 4 = 0 as needs_review from truth)"


def _seen(spark, d):
    return cells_truth(spark, d).select("doc_id", "row_idx", "col_idx", F.when(F.col("h") % 3 == 0, "").otherwise(F.col("text")).alias("text"), (F.col("h") % 4 == 0).alias("needs_review"))


@query(f"""with {TRUTH}, n as (select doc_id from truth where doc_id % 2 = 0 group by doc_id having max(row_idx) + 1 >= 4)
select doc_id, 1 as row_idx, 1 as col_idx, case when doc_id % 6 = 0 then 2 else 1 end as row_span, 2 as col_span from n where doc_id % 10 <> 0""")
def d1_spans_from_separators(spark, d):
    truth = cells_truth(spark, d)
    big = shape(truth).where("n_rows >= 4").select("doc_id", "n_rows")
    cells = truth.join(big, "doc_id")
    right = cells.where("col_idx < 5").select("doc_id", F.lit("v").alias("orientation"), "row_idx", "col_idx", F.when((F.col("col_idx") == 1) & (F.col("row_idx") == 1) & (F.col("doc_id") % 2 == 0), 0.05).otherwise(0.9).alias("support"))
    gap = ((F.col("row_idx") == 1) & F.col("col_idx").isin(1, 2) & (F.col("doc_id") % 6 == 0)) | ((F.col("row_idx") == 0) & (F.col("col_idx") == 1) & (F.col("doc_id") % 10 == 0))
    below = cells.where("row_idx < n_rows - 1").select("doc_id", F.lit("h").alias("orientation"), "row_idx", "col_idx", F.when(gap, 0.05).otherwise(0.9).alias("support"))
    return sp.spans_from_separators(right.union(below))


@query(f"""with {TRUTH}, {SPANS}, {COVER}, t as (select *, max(case when row_idx = 0 and col_idx = 0 and col_span >= n_cols then 1 else 0 end) over (partition by doc_id) = 1 as titled from spans join shape using (doc_id))
select doc_id, span_id, row_idx, col_idx, row_span, col_span, case when col_idx = 0 and col_span >= n_cols and row_idx = 0 then 'title' when col_idx = 0 and col_span >= n_cols and row_idx = 1 and titled then 'merged'
  when col_idx = 0 and row_span > 1 and col_span = 1 then 'row_header' when col_span > 1 and row_span = 1 and row_idx <= case when titled then 1 else 0 end then 'group_header' else 'merged' end as role from t""")
def d2_span_roles(spark, d):
    return sp.span_roles(spans(spark, d), shape(cells_truth(spark, d)))


@query(f"""with {TRUTH}, {SPANS}, {COVER}, o as (select doc_id, span_id, bool_or(n > 1) as overlapping from (select *, count(*) over (partition by doc_id, row_idx, col_idx) as n from cover) group by all)
select doc_id, span_id, row_idx, col_idx, row_span, col_span, role, row_idx + row_span <= n_rows and col_idx + col_span <= n_cols as in_bounds, overlapping from spans join shape using (doc_id) join o using (doc_id, span_id)""")
def d3_span_findings(spark, d):
    return sp.span_findings(spans(spark, d), shape(cells_truth(spark, d)))


HIDDEN = "hidden as (select c.* from cover c join seen using (doc_id, row_idx, col_idx) where not anchor and text <> '')"


@query(f"with {TRUTH}, {SPANS}, {COVER}, {CELLS}, {HIDDEN} select s.* from spans s where not exists (select 1 from hidden h where h.doc_id = s.doc_id and h.span_id = s.span_id)")
def d4_spans_hiding_no_text(spark, d):
    return sp.resolve_text_hiding(spans(spark, d), _seen(spark, d))[0]


@query(f"with {TRUTH}, {SPANS}, {COVER}, {CELLS}, {HIDDEN} select doc_id, row_idx, col_idx from hidden union select s.doc_id, s.row_idx, s.col_idx from spans s join hidden h on h.doc_id = s.doc_id and h.span_id = s.span_id")
def d4_places_to_review(spark, d):
    return sp.resolve_text_hiding(spans(spark, d), _seen(spark, d))[1]


@query(f"""with {TRUTH}, {SPANS}, {COVER}, {CELLS}, f as (select distinct c.doc_id, c.span_id from cover c join seen using (doc_id, row_idx, col_idx) where needs_review),
lifted as (select distinct s.doc_id, s.row_idx, s.col_idx, true as up from spans s join f using (doc_id, span_id))
select doc_id, row_idx, col_idx, text, needs_review or coalesce(up, false) as needs_review from seen left join lifted using (doc_id, row_idx, col_idx)""")
def d5_lift_review(spark, d):
    return sp.lift_review(spans(spark, d), _seen(spark, d))


@query(f"""with {TRUTH}, {SPANS}, {COVER}, l as (select doc_id, n_rows - 1 as last_row, (n_cols - 2)::int as last_col from shape)
select doc_id, span_id, row_idx, col_idx, least(row_span, last_row - row_idx + 1)::int as row_span, least(col_span, last_col - col_idx + 1)::int as col_span, role from spans join l using (doc_id) where row_idx <= last_row and col_idx <= last_col""")
def d6_clamp_spans(spark, d):
    limits = shape(cells_truth(spark, d)).select("doc_id", (F.col("n_rows") - 1).alias("last_row"), (F.col("n_cols") - 2).alias("last_col"))
    return sp.clamp_spans(spans(spark, d), limits)


@query(f"""with {SPANS} select doc_id, span_id, (row_idx - case when row_idx > 0 and doc_id % 2 = 0 then 1 else 0 end)::int as row_idx, col_idx, row_span, col_span, role from spans where not (doc_id % 2 = 0 and row_idx = 0)""")
def d7_shift_spans(spark, d):
    s = spans(spark, d)
    return sp.shift_spans(s, s.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("row_idx")).distinct())


@query(f"with {SPANS} select * from spans where doc_id % 4 <> 1")
def d8_clear_after_edit(spark, d):
    return sp.clear_after_edit(spans(spark, d), cells_truth(spark, d).where("doc_id % 4 = 1").select("doc_id").distinct())


@query(f"with {TRUTH}, {SPANS}, {COVER} select distinct doc_id, row_idx, col_idx from cover where not anchor")
def d9_covered_slots(spark, d):
    return sp.covered_slots(spans(spark, d))


@query(f"with {TRUTH}, s as (select doc_id, max(row_idx) + 1 as n from truth group by doc_id) select doc_id, doc_id % 31 <> 0 and doc_id % 37 <> 0 as ok, list_transform(range(1, n + 1 + (doc_id % 31 = 0)::int), lambda k: (20.0 * k)::double) as aligned from s")
def d10_d11_boundaries(spark, d):
    n = shape(cells_truth(spark, d)).select("doc_id", "n_rows")
    more = F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0)
    made = F.transform(F.sequence(F.lit(0), F.col("n_rows") + more), lambda k: (k * 20.0).cast("double"))
    odd = F.when(F.col("doc_id") % 37 == 0, F.transform(made, lambda x: F.when(x == 20.0, 0.0).otherwise(x))).otherwise(made)
    return n.withColumns({"b": odd, "plain": made}).select("doc_id", sp.boundaries_ok(F.col("b"), F.col("n_rows")).alias("ok"), sp.align_boundaries(F.col("plain"), F.lit(1)).alias("aligned"))


@query(f"""with {TRUTH} select doc_id, sha256('{{"p0":"grid","p1":"' || (max(row_idx) + 1) || '","p2":"' || (max(col_idx) + 1) || '"}}') as fingerprint
from truth group by doc_id""")
def d12_geometry_fingerprint(spark, d):
    return shape(cells_truth(spark, d)).select("doc_id", sp.geometry_fingerprint(F.lit("grid"), F.col("n_rows"), F.col("n_cols")).alias("fingerprint"))

