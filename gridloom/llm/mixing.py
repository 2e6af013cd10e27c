"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens by cell (source, language, topic). The cells' weights are raked: scaled to each
margin's targets in turn until all three agree. They are raked for an expected size of the sample, the largest for
which the tokens of no margin fall short of its targets by more than SHORT: a cell that would need more than all its
tokens is kept whole, and the others are raked again to fill up its margins. A document's probability is its cell's
raked tokens over its tokens, and a hash of its id decides.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, stored, table

MARGINS = ("source", "lang", "topic")
#: Without given targets a margin's are its observed shares to this power, in proportion: rarer values gain.
POWER = 0.85
#: Raking ends when every margin is within this of its targets, or with a warning after ROUNDS rounds.
TOLERANCE = 1e-6
ROUNDS = 200
#: Rounds that change the largest deviation by less than this change nothing.
STILL = 1e-10
#: So many cells, which are counts and not documents, may be held on the driver and broadcast: some 10 MB.
LOCAL_CELLS = 100_000
#: Share of a margin's targets that may lack tokens, so that a few rare documents don't set the size of the sample.
SHORT = 0.01
SEED = 17
#: The value of a margin where the column is null.
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """table, legal, contact or prose: the first whose marks the text has."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("License") | text.contains("Copyright") | text.contains("(c)"), "legal")
        .when(text.rlike(r"[\w.+-]@[\w-]+\."), "contact")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    """Words of a text, the tokens that weights are counted in."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on ``key`` alone, so that a lost task draws the same again."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cell_of() -> dict[str, Column]:
    """The margins of a row of documents, nulls named."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in ("source", "lang")}
    return plain | {"topic": F.coalesce(topic_of(F.col("text")), F.lit("prose"))}


def margin_targets(cells: DataFrame, margin: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """``margin`` and its target, which sum to 1 over the values that have tokens."""
    seen = cells.groupBy(margin).agg(F.sum("n").alias("n"))
    if given is None:
        raw = seen.select(margin, F.pow("n", F.lit(power)).alias("t"))
    else:
        rows = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{margin} string, t double")
        raw = seen.join(rows, margin, "left").select(margin, F.coalesce("t", F.lit(0.0)).alias("t"))
    total = raw.agg(F.sum("t").alias("total"))
    share = F.when(F.col("total") > 0, F.col("t") / F.col("total")).otherwise(0.0)
    return raw.crossJoin(F.broadcast(total)).select(margin, share.alias("target"))


def _told(gap: float, rounds: int, most: int, size: float | None) -> None:
    if gap >= TOLERANCE and (size is None or rounds == most):
        warnings.warn(f"raking ended after {rounds} rounds with a margin {gap:.2g} from its target", stacklevel=3)


def rake_spark(cells: DataFrame, targets=None, power: float = POWER, rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """What ``rake`` does, for any number of cells: they stay a Spark table, written after each round, and only the
    largest deviation is fetched."""
    wanted = {m: stored(margin_targets(cells, m, (targets or {}).get(m), power), "targets") for m in MARGINS}
    now = cells.where("n > 0").withColumn("weight", F.col("n").cast("double"))
    last, written = None, None
    for k in range(rounds):
        for m in MARGINS:
            share = now.groupBy(m).agg(F.sum("weight").alias("w")).join(wanted[m], m)
            factor = F.when(F.col("w") > 0, F.col("target") / F.col("w")).otherwise(0.0).alias("factor")
            now = now.join(share.select(m, factor), m).select(*MARGINS, "n", (F.col("weight") * F.col("factor")).alias("weight"))
        if size is not None:
            now = now.withColumn("weight", F.least("weight", F.col("n") / F.lit(float(size))))
        now = stored(now, "cells")
        if written is not None:
            forget(written)
        written = now
        apart = F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.col("target"))).alias("gap")
        gaps = [wanted[m].join(now.groupBy(m).agg(F.sum("weight").alias("w")), m, "left").agg(apart) for m in MARGINS]
        gap = gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).first()[0] or 0
        if gap < TOLERANCE or (last is not None and abs(last - gap) < STILL):
            break
        last = gap
    forget(*wanted.values())
    _told(gap, k + 1, rounds, size)
    return now


class Cells:
    """The cells that have tokens, as arrays, and the targets of their margins."""

    def __init__(self, rows: pd.DataFrame, targets: dict[str, dict[str, float]] | None, power: float):
        self.rows = rows[rows["n"] > 0].sort_values(list(MARGINS), ignore_index=True)
        self.n = self.rows["n"].to_numpy(float)
        self.codes, self.want = [], []
        for m in MARGINS:
            code, names = pd.factorize(self.rows[m], sort=True)
            given = (targets or {}).get(m)
            raw = np.bincount(code, self.n, len(names)) ** power if given is None else np.array([float(given.get(x, 0)) for x in names])
            self.codes.append(code)
            self.want.append(raw / raw.sum() if raw.sum() > 0 else raw)

    def sums(self, weight: np.ndarray, axis: int) -> np.ndarray:
        return np.bincount(self.codes[axis], weight, len(self.want[axis]))

    def sample_size(self) -> float:
        """See ``mixing_rates``."""
        total = self.n.sum()
        for percent in range(100, 0, -1):
            size = percent / 100 * total
            short = [np.maximum(want - self.sums(self.n, k) / size, 0).sum() for k, want in enumerate(self.want)] if total else [0]
            if max(short) <= SHORT or percent == 1:
                return size
        return 0.0

    def raked(self, rounds: int, size: float | None) -> np.ndarray:
        weight, last, gap, k = self.n.copy(), None, 0.0, 0
        for k in range(rounds):
            for axis, want in enumerate(self.want):
                w = self.sums(weight, axis)
                weight = weight * np.divide(want, w, out=np.zeros_like(want), where=w > 0)[self.codes[axis]]
            if size is not None:
                weight = np.minimum(weight, self.n / size)
            gap = max((np.abs(self.sums(weight, axis) - want).max(initial=0) for axis, want in enumerate(self.want)), default=0)
            if gap < TOLERANCE or (last is not None and abs(last - gap) < STILL):
                break
            last = gap
        _told(gap, k + 1, rounds, size)
        return weight


def few_cells(cells: DataFrame) -> pd.DataFrame | None:
    """The cells themselves, if they are at most LOCAL_CELLS."""
    rows = cells.limit(LOCAL_CELLS + 1).collect()
    return pd.DataFrame([tuple(r) for r in rows], columns=cells.columns) if len(rows) <= LOCAL_CELLS else None


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """source, lang, topic, n, weight: raked shares of the cells (source, lang, topic, n), which sum to 1.

    Margins are raked in the order given; cells without tokens have no weight, values without target get none.
    Where targets contradict each other the last margin holds exactly and the others as nearly as can be.
    With ``size``, tokens of the sample, no weight is over its cell's n / size, and where that leaves targets out of
    reach weights sum to less than 1. Raking ends when all margins hold, when rounds no longer change the largest
    deviation, or after ``rounds``. A warning says how far a margin is off its target then (with ``size`` only after
    ``rounds``, as targets out of reach are no surprise).
    Up to LOCAL_CELLS cells are raked as arrays on the driver; of more, each round is a few Spark jobs with the same steps.
    """
    columns = cells.select(*MARGINS, "n")
    rows = few_cells(columns)
    if rows is None:
        return rake_spark(columns, targets, power, rounds, size)
    known = Cells(rows, targets, power)
    return _table_of(cells.sparkSession, known.rows.assign(weight=known.raked(rounds, size)))


def _table_of(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    types = {"n": "long"} | dict.fromkeys(("weight", "probability"), "double")
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in rows.columns)
    return spark.createDataFrame(list(rows.itertuples(index=False, name=None)), schema)


def sample_size(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER) -> float:
    """``Cells.sample_size`` for any number of cells."""
    shares = [F.lit(k / 100) for k in range(1, 101)]
    lacking = None
    for m in MARGINS:
        seen = cells.groupBy(m).agg(F.sum("n").alias("n")).join(margin_targets(cells, m, (targets or {}).get(m), power), m)
        total = cells.agg(F.sum("n").alias("total"))
        each = seen.crossJoin(F.broadcast(total)).where("total > 0").withColumn("share", F.explode(F.array(*shares)))
        short = F.greatest(F.col("target") - F.col("n") / (F.col("share") * F.col("total")), F.lit(0.0))
        one = each.groupBy("share", "total").agg(F.sum(short).alias("short"))
        lacking = one if lacking is None else lacking.union(one)
    worst = lacking.groupBy("share", "total").agg(F.max("short").alias("short"))
    tokens = F.col("share") * F.col("total")
    found = worst.agg(F.max(F.when(F.col("short") <= SHORT, tokens)), F.min(tokens)).first()
    return float(found[0] or found[1] or 0)


def mixing_rates(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER) -> DataFrame:
    """source, lang, topic, weight, probability of each cell of ``docs`` that has tokens.

    The sample's size is, in percents of all tokens, the largest for which no margin lacks more than SHORT of its
    targets' tokens; one percent where even that lacks more. ``weight`` is the cell's raked share of such a sample;
    ``probability`` is its tokens there over those it has, at most 1, so that the kept tokens have the targets as
    expected margins but for what SHORT allows and for cells out of reach of all three margins. If no cell is whole,
    all are scaled until the likeliest is.
    """
    rows = docs.select(*(c.alias(k) for k, c in cell_of().items()), word_count(F.col("text")).alias("n"))
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum("n").alias("n")), "cells")
    few = few_cells(cells)
    if few is not None:
        forget(cells)
        known = Cells(few, targets, power)
        size = known.sample_size()
        weight = known.raked(ROUNDS, size or None)
        rate = weight * size / known.n
        top = rate.max(initial=0)
        found = known.rows[list(MARGINS)].assign(weight=weight, probability=np.minimum(rate / top, 1.0) if top > 0 else 0.0 * rate)
        return F.broadcast(_table_of(docs.sparkSession, found))  # LOCAL_CELLS rows at most
    size = sample_size(cells, targets, power)
    raked = rake_spark(cells, targets, power, size=size or None).withColumn("rate", F.col("weight") * F.lit(size) / F.col("n"))
    top = raked.agg(F.max("rate").alias("top"))
    probability = F.when(F.col("top") > 0, F.least(F.col("rate") / F.col("top"), F.lit(1.0))).otherwise(0.0)
    return raked.crossJoin(F.broadcast(top)).select(*MARGINS, "weight", probability.alias("probability"))


def draw(docs: DataFrame, rates: DataFrame, seed: int = SEED, name: str = "drawn") -> DataFrame:
    """``docs`` with a struct ``name``: source, lang, topic, weight, probability, kept. A column of that name is replaced."""
    cell = fresh(docs, "cell")
    keyed = docs.withColumn(cell, F.struct(*(c.alias(k) for k, c in cell_of().items()))).alias("d")
    same = [F.col(f"d.{cell}.{m}") == F.col(f"r.{m}") for m in MARGINS]
    joined = keyed.join(rates.alias("r"), same, "left")
    p = F.coalesce(F.col("r.probability"), F.lit(0.0))
    weight = F.coalesce(F.col("r.weight"), F.lit(0.0)).alias("weight")
    kept = (uniform(F.col("d.doc_id"), seed) < p).alias("kept")
    full = F.struct(f"d.{cell}.*", weight, p.alias("probability"), kept)
    quoted = lambda c: F.col(f"d.`{c.replace('`', '``')}`")
    return joined.select(*(quoted(c) for c in docs.columns if c.lower() != name.lower()), full.alias(name))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept of each row.

    Null source or lang is a value of its own; null and empty texts have no tokens and the probability of
    their cell, or 0 if it has no tokens. Rows with one doc_id are kept or dropped alike; a null doc_id is
    drawn like any other. Other columns aren't read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", "lang", "text")
    found = draw(rows, mixing_rates(rows, targets, power), seed).withColumn("n_tokens", word_count(F.col("text")))
    return found.select("doc_id", *(f"drawn.{m}" for m in MARGINS), "n_tokens", "drawn.weight", "drawn.probability", "drawn.kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
