"""A training corpus from ``documents``: language, copies, benchmark leaks, mixture, token files.

STAGES lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import forget, fresh, stored, table, work_dir
from gridloom.llm.decontaminate import with_leaks
from gridloom.llm.language_id import UNDECIDED, fit, predictor
from gridloom.llm.mixing import draw, mixing_rates
from gridloom.llm.near_dedup import near_duplicates
from gridloom.llm.token_ids import read_token_ids, write_token_ids

#: Near copies in the pipeline: 100 * intersection >= NEAR_PERCENT * union of word shingles. (op7's own contract is 85.)
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Those without letters, and those whose best language hardly leads the
    second, go."""
    said = fresh(docs, "said")
    told = docs.withColumn(said, predictor(spark, fit(docs))(F.col("text")))
    return told.where((F.col(said)["lang_pred"] != UNDECIDED) & ~F.col(said)["ambiguous"]).drop(said)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Rows of one doc_id are one document: it stays with all its different texts, each in the row whose other columns, as
    JSON, come first; only rows whose doc_id is repeated are dealt by it for that. Rows without doc_id stay as they are."""
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names of any letters
    doc, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    found = near_duplicates(docs, NEAR_PERCENT).where("kept and doc_id is not null")
    kept = found.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n"))
    met = rows.join(kept, rows[doc] == kept["kept_id"])
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(c).alias(name) for c, name in zip(rows.columns, names, strict=True) if c not in (doc, text))))
    several = met.where("n > 1").groupBy(doc, F.sha2(F.col(text).cast("binary"), 256)).agg(F.min_by(F.struct(*rows.columns), others).alias("row"))
    alone = met.where("n = 1").select(*rows.columns)
    return alone.unionByName(several.select("row.*")).unionByName(rows.where(f"{doc} is null")).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaks = fresh(docs, "leaks")
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"), leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens have the target shares of sources, languages and topics."""
    drawn = fresh(docs, "drawn")
    return draw(docs, mixing_rates(docs), name=drawn).where(F.col(drawn)["kept"]).drop(drawn)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written as directly addressable codes and read back: doc_id, start, n_tokens
    and ids_crc32 of each."""
    return read_token_ids(write_token_ids(docs, work_dir(spark, "token-ids")))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_files),
]

#: Learned models, set similarities and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
