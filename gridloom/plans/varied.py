"""Registered queries over grids of 1 to 30 columns and any number of rows: the words of a document, row by row. The last
row is ragged, and some words become blanks, units, column letters, or texts that need quoting or wrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WIDE
from ..operators import structure as st
from ..operators.grid import rectangularize
from ..operators.structure import UNIT
from ..sources import writers as wr
from .fixtures import SPANS, spans, table
from .texts import GUARD

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def words(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, row_idx, col_idx, text."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 30 + 1).alias("n_cols"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("i", "text"))
    return docs.select("doc_id", F.floor(F.col("i") / F.col("n_cols")).cast("int").alias("row_idx"), (F.col("i") % F.col("n_cols")).cast("int").alias("col_idx"), "text")


WORDS = """
words as (
  select doc_id, (i // n_cols)::int as row_idx, (i % n_cols)::int as col_idx, text from (
    select doc_id, doc_id % 30 + 1 as n_cols, unnest(string_split(coalesce(text, ''), ' ')) as text, unnest(range(len(string_split(coalesce(text, ''), ' ')))) as i from documents))"""


def _turned(cells: DataFrame, *changes: tuple[str, Column]) -> DataFrame:
    """Texts replaced where the first condition of ``changes`` holds."""
    text = F.col("text")
    for condition, new in reversed(changes):
        text = F.when(F.expr(condition), new).otherwise(text)
    return cells.withColumn("text", text)


@query(f"""with {WORDS}, kept as (select * from words where (row_idx * 31 + col_idx * 7) % 11 <> 5), shape as (select doc_id, max(row_idx) as r, max(col_idx) as c from kept group by doc_id),
places as (select doc_id, row_idx, unnest(range(c + 1))::int as col_idx from (select doc_id, c, unnest(range(r + 1))::int as row_idx from shape))
select doc_id, row_idx, col_idx, coalesce(text, '') as text from places left join kept using (doc_id, row_idx, col_idx)""")
def b1_rectangularize_any_shape(spark, d):
    return rectangularize(words(spark, d).where("(row_idx * 31 + col_idx * 7) % 11 <> 5"))


@query(f"""with {WORDS}, {SPANS}, cells as (select doc_id, row_idx, col_idx, case when doc_id % 4 <> 0 and (doc_id + col_idx) % (3 + doc_id % 5) <> 0 then chr((65 + col_idx % 26)::int) else text end as text from words where row_idx = 0),
n as (select doc_id, count(*) filter (text <> '') as filled, count(*) filter (regexp_matches(text, '^[A-Z]{{1,2}}$')) as letters from cells group by doc_id)
select doc_id, 0 as row_idx from n where filled >= 2 and letters >= filled * 0.8 and doc_id not in (select doc_id from spans)""")
def h3_column_letters_any_shape(spark, d):
    letters = "row_idx = 0 and doc_id % 4 <> 0 and (doc_id + col_idx) % (3 + doc_id % 5) <> 0"
    return st.column_letter_rows(_turned(words(spark, d), (letters, F.chr((65 + F.col("col_idx") % 26).cast("long")))), spans(spark, d))


@query(f"""with {WORDS}, cells as (select doc_id, row_idx, col_idx, case when doc_id % 2 = 0 and col_idx % 7 in (3, 4) then case when row_idx % 3 = 1 then '' else 'kg' end when col_idx % 9 = 5 then '' else text end as text from words),
n as (select doc_id, col_idx, count(*) filter (text <> '') as filled, count(*) filter (regexp_matches(text, '{UNIT}')) as units from cells group by all),
target as (select doc_id, col_idx, (sum((filled = 0 or units < filled or col_idx = 0)::int) over (partition by doc_id order by col_idx) - 1)::int as "to" from n)
select doc_id, row_idx, "to" as col_idx, coalesce(string_agg(text, ' ' order by col_idx) filter (text <> ''), '') as text from cells join target using (doc_id, col_idx) group by doc_id, row_idx, "to\"""")
def h6_merge_units_any_shape(spark, d):
    unit = "doc_id % 2 = 0 and col_idx % 7 in (3, 4)"
    changes = (f"{unit} and row_idx % 3 = 1", F.lit("")), (unit, F.lit("kg")), ("col_idx % 9 = 5", F.lit(""))
    return st.merge_unit_columns(_turned(words(spark, d), *changes))


QUOTED = """
cells as (
  select doc_id, row_idx, col_idx, case k % 9 when 0 then text || ', "' || text || '"' when 1 then text || chr(10) || text when 2 then '=' || text when 3 then '' when 4 then '-' || k when 5 then '00' || k else text end as text
  from (select *, row_idx * 31 + col_idx * 7 + doc_id as k from words where col_idx < 6 or row_idx % 2 = 0))"""


def _quoted(spark, d):
    text, k = F.col("text"), F.expr("row_idx * 31 + col_idx * 7 + doc_id")
    odd = (
        F.when(k % 9 == 0, F.concat(text, F.lit(', "'), text, F.lit('"'))).when(k % 9 == 1, F.concat(text, F.lit("\n"), text)).when(k % 9 == 2, F.concat(F.lit("="), text))
        .when(k % 9 == 3, "").when(k % 9 == 4, F.concat(F.lit("-"), k.cast("string"))).when(k % 9 == 5, F.concat(F.lit("00"), k.cast("string"))).otherwise(text)
    )
    return words(spark, d).where("col_idx < 6 or row_idx % 2 = 0").withColumn("text", odd)


@query(f"""with {WORDS}, {QUOTED}, shape as (select doc_id, max(row_idx) as r, max(col_idx) as c from cells group by doc_id having count(*) filter (trim(text, ' ' || chr(10)) <> '') > 0),
places as (select doc_id, row_idx, unnest(range(c + 1))::int as col_idx from (select doc_id, c, unnest(range(r + 1))::int as row_idx from shape)),
padded as (select doc_id, row_idx, col_idx, coalesce(text, '') as text from places left join cells using (doc_id, row_idx, col_idx)),
guarded as (select doc_id, row_idx, col_idx, case when {GUARD} then '''' || text else text end as text from padded),
lines as (select doc_id, row_idx, string_agg(case when regexp_matches(text, '[,"\\x00-\\x1F]') then '"' || replace(text, '"', '""') || '"' else text end, ',' order by col_idx) as line from guarded group by all)
select doc_id, chr(65279) || string_agg(line, chr(13) || chr(10) order by row_idx) || chr(13) || chr(10) as csv from lines group by doc_id""")
def l1_csv_any_shape(spark, d):
    return wr.csv_texts(_quoted(spark, d))


LINE_WIDTH = f"length(x) * 2 - length(regexp_replace(x, '{WIDE}', '', 'g'))"
SHEET = f"""
cells as (select doc_id, row_idx, col_idx, case (row_idx + col_idx) % 6 when 0 then repeat(text || ' ', (1 + doc_id % 12)::int) when 1 then text || chr(10) || chr(10) || repeat('表' || text, 5) when 2 then '' else text end as text from words),
columns_ as (select doc_id, col_idx, greatest(10, least(48, max(list_max(list_transform(string_split(text, chr(10)), lambda x: {LINE_WIDTH}))) + 2))::int as width from cells group by all)"""


def _sheet(spark, d):
    text, k = F.col("text"), F.expr("(row_idx + col_idx) % 6")
    long = F.repeat(F.concat(text, F.lit(" ")), (F.col("doc_id") % 12 + 1).cast("int"))
    lines = F.concat(text, F.lit("\n\n"), F.repeat(F.concat(F.lit("表"), text), F.lit(5)))
    return words(spark, d).withColumn("text", F.when(k == 0, long).when(k == 1, lines).when(k == 2, "").otherwise(text))


@query(f"with {WORDS}, {SHEET} select * from columns_")
def l4_sheet_columns_any_shape(spark, d):
    return wr.sheet_columns(_sheet(spark, d))


@query(f"""with {WORDS}, {SHEET}, lines as (select doc_id, row_idx, list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(({LINE_WIDTH}) / (width - 2))))) as n from cells join columns_ using (doc_id, col_idx))
select doc_id, row_idx, greatest(22, least(396, max(n) * 18))::int as height from lines group by all""")
def l4_sheet_rows_any_shape(spark, d):
    return wr.sheet_rows(_sheet(spark, d))
