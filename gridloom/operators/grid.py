"""Grids as long tables of cells: doc_id, row_idx, col_idx, text, and what else a cell carries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DOC = "doc_id"
CELL = ("doc_id", "row_idx", "col_idx")
#: What is white space of any script: ``(?U)\\s`` of a regular expression.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places of the largest grid that is laid out in full, 1024 x 1024. A place is data: one far cell may claim any number.
MAX_SLOTS = 1 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, in which ``value`` is computed once however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_document(df: DataFrame) -> DataFrame:
    """``df`` dealt by document over as many partitions as shuffles have, which aren't merged where rows are few: their
    work is in what is done with a document, not in its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), DOC)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with costly ``columns``, each computed once a row. They come out of a generator, through which the optimizer
    pushes no filter and merges no expression; else a filter on one of them would compute it, and all behind it, again."""
    new = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode_outer(F.array(new)).alias("__new")).select(*(F.col(f"`{c}`") for c in df.columns), "__new.*")


def unicode_trim(text: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def shape(cells: DataFrame) -> DataFrame:
    """doc_id, n_rows, n_cols."""
    return cells.groupBy(DOC).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))


def rectangularize(cells: DataFrame) -> DataFrame:
    """B1: every place of each document's rectangle, with "" where a row had no such cell. A document whose rectangle would
    have more than ``MAX_SLOTS`` places, or that has a negative one, keeps its cells as they are.

    Cells are dealt by document and pass in order; each brings the places missing right before it, the last one those
    behind it too. So places are never joined with cells, and cells that lie by document aren't shuffled."""
    own = W.partitionBy(DOC)
    order = own.orderBy("row_idx", "col_idx")
    passing = cells.select(*CELL, "text", F.lag("row_idx").over(order).alias("__r"), F.lag("col_idx").over(order).alias("__c"), F.lead(F.lit(1)).over(order).isNull().alias("__last"))
    size = {"__h": F.max("row_idx").over(own).cast("long") + 1, "__w": F.max("col_idx").over(own).cast("long") + 1, "__least": F.least(F.min("row_idx").over(own), F.min("col_idx").over(own))}
    shaped, w = passing.withColumns(size), F.col("__w")
    sane = (F.col("__least") >= 0) & (F.col("__h") * w <= MAX_SLOTS)
    at = {"__n": F.col("__h") * w, "__p": F.col("row_idx") * w + F.col("col_idx"), "__from": F.coalesce(F.col("__r") * w + F.col("__c"), F.lit(-1)) + 1}
    found = shaped.select(*CELL, "text", "__w", "__last", *(F.when(sane, v).alias(k) for k, v in at.items()))
    p, n = F.col("__p"), F.col("__n")
    stored = F.struct("row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text"))
    blank = lambda x: F.struct((x / w).cast("int").alias("row_idx"), (x % w).cast("int").alias("col_idx"), F.lit("").alias("text"))
    before = F.when(F.col("__from") < p, F.transform(F.sequence(F.col("__from"), p - 1), blank))
    after = F.when(F.col("__last") & (p < n - 1), F.transform(F.sequence(p + 1, n - 1), blank))
    none = F.filter(F.array(stored), lambda x: F.lit(False))
    gap = (F.col("__from") < p) | (F.col("__last") & (p < n - 1))
    every = F.when(F.coalesce(gap, F.lit(False)), F.concat(F.coalesce(before, none), F.array(stored), F.coalesce(after, none))).otherwise(F.array(stored))
    return found.select(DOC, F.inline(every))
