"""Language identification by error-correcting output codes.

Every language gets a codeword, and any two codewords differ in about half of their bits. For each bit a binary
classifier over hashed byte n-grams, naive Bayes of the languages with a 1 against those with a -1, tells how the text
leans. The language whose codeword has the least weighted logistic loss against the leanings wins; weights are what the
classifiers achieve on labelled texts that they haven't learned from, and a close second flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, pieces, stored, table

#: n-gram lengths in bytes, and the number of buckets they are hashed to.
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: The learning sample: about so many documents of each language, chosen by a hash of doc_id.
SAMPLE = 1000
#: One in so many of them is not learned from at first, to weigh the bits by.
FOLDS = 5
#: n-grams that one text counts for at most.
TEXT_GRAMS = 2000
UNDECIDED = "und"
#: The least share of the best language against the second for a text that isn't ambiguous.
CLEAR = 0.6
#: A byte that UTF-8 doesn't have, between texts.
_END = b"\xff"
_COUNTS = "lang string, fold int, buckets binary, counts binary"
_RIGHT = "lang string, n long, right_bits array<double>"


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages. Up to 5 languages have every way to part them in two as a
    bit; more have the rows of a Hadamard matrix, any two of which differ in half of their bits."""
    if n <= 5:
        parts = np.arange(1, 2 ** max(n - 1, 0))[None, :] >> np.arange(max(n - 1, 0))[:, None] & 1
        return np.vstack((np.ones((min(n, 1), parts.shape[1])), 1 - 2 * parts[: n - 1] if n > 1 else parts[:0])) * 1.0
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of lower-cased texts, and where each text's n-grams start. Every text is put between
    blanks; runs of white space, digits and ASCII signs are one blank. An n-gram that would reach beyond its text is
    filled up with ends, never with the next text, so that a text's n-grams are the same wherever it stands."""
    table_ = np.full(256, 32, np.uint8)
    table_[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table_[128:] = np.arange(128, 256)
    table_[255] = 0
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " + _END * (max(GRAMS) - 1) for t in texts]
    data = table_[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
    keep = np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))
    data, owner = data[keep].astype(np.uint32), owner[keep]
    key, out = np.zeros(len(data), np.uint32), np.zeros((len(data), len(GRAMS)), np.uint16)
    for n in range(1, max(GRAMS) + 1):
        key[: len(data) - n + 1] = key[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in GRAMS:
            h = key * np.uint32(0x9E3779B1)
            out[:, GRAMS.index(n)] = (h ^ (h >> np.uint32(15))) >> np.uint32(16)
    real = data > 0
    size = np.bincount(owner[real], minlength=len(raw))
    return out[real], np.cumsum(size) - size


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram counts of each language and fold in a task's rows, of those that occur; see TEXT_GRAMS."""
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for lang, fold, text in zip(batch["lang"], batch["fold"], batch["text"], strict=True):
            found = np.bincount(grams([text])[0].ravel(), minlength=BUCKETS)
            sums[lang, fold] = sums.get((lang, fold), 0) + found * min(1.0, TEXT_GRAMS / max(found.sum(), 1))
    yield pd.DataFrame([(*k, *_sparse(v)) for k, v in sums.items()], columns=["lang", "fold", "buckets", "counts"])


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes(), counts[at].astype("<f8").tobytes()


def _dense(buckets: bytes, counts: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS)
    out[np.frombuffer(buckets, "<u2")] = np.frombuffer(counts, "<f8")
    return out


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of one language and fold, of all tasks."""
    total = np.zeros(BUCKETS)
    for buckets, counts in sorted(zip(rows["buckets"], rows["counts"], strict=True)):
        total += _dense(buckets, counts)
    return pd.DataFrame([(rows["lang"].iat[0], rows["fold"].iat[0], *_sparse(total))], columns=rows.columns)


class Model:
    """Weights of the bits' classifiers (buckets x bits), the codewords and the languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        floor = 0.5 / max(counts.sum() / max(len(langs), 1), 1)
        weights = []
        for bit in self.code.T:
            one, two = (np.log((share[bit == s].mean(axis=0) if (bit == s).any() else 0) + floor) for s in (1, -1))
            weights.append(one - two)
        self.weights = np.array(weights, np.float32).reshape(-1, BUCKETS).T.copy()
        self.bit_weights = np.array([float(len(set(b)) > 1) for b in self.code.T])

    def leanings(self, texts: list[str]) -> np.ndarray:
        """Mean weight of a text's n-grams, for each bit."""
        buckets, starts = grams(texts)
        total = self.weights[buckets[:, 0]]
        for k in range(1, len(GRAMS)):
            total += self.weights[buckets[:, k]]
        sizes = np.diff(np.append(starts, len(buckets)))
        return np.add.reduceat(total, starts, axis=0).astype(float) / (len(GRAMS) * sizes)[:, None]

    def losses(self, texts: list[str]) -> np.ndarray:
        """Weighted logistic loss of each language's codeword, texts x languages."""
        lean = self.leanings(texts) * 10
        loss = np.logaddexp(0, -lean[:, None, :] * self.code[None, :, :])
        return (loss * self.bit_weights).sum(axis=2) / max(self.bit_weights.sum(), 1)

    def right(self, texts: list[str], langs: list[str]) -> np.ndarray:
        """Whether each bit's classifier is right on labelled texts, texts x bits."""
        return np.sign(self.leanings(texts)) == self.code[[self.langs.index(x) for x in langs]]

    def weigh(self, right: np.ndarray) -> None:
        """Set the bits' weights: log odds of how often each is right."""
        right = np.clip(right, 0.5, 0.999)
        self.bit_weights = self.bit_weights * np.maximum(np.log(right / (1 - right)), 0.01)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, ambiguous."""
        out = pd.DataFrame({"lang_pred": [UNDECIDED] * len(texts), "score": 0.0, "ambiguous": True})
        real = [k for k, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        if real and self.langs:
            loss = self.losses([texts[k] for k in real])
            chance = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            top = chance[np.arange(len(real)), best]
            second = np.where(np.arange(len(self.langs)) == best[:, None], 0, chance).max(axis=1)
            out.loc[real, "lang_pred"] = [self.langs[k] for k in best]
            out.loc[real, "score"] = top
            out.loc[real, "ambiguous"] = top < CLEAR * (top + second)
        return out


def _crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """lang, fold, text of about ``most`` labelled documents of each language (all where there are fewer); none whose
    crc32(doc_id) mod 3 is 1. A hash of doc_id picks them: only the languages' numbers of rows are gathered, and a
    document that is repeated counts once."""
    labelled = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null and doc_id is not null")
    rows = labelled.where(_crc() % 3 != 1)
    rates = rows.groupBy("lang").agg((F.lit(float(most)) / F.count("*")).alias("rate"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # one row per language, as in the model: as few as the driver has to hold anyway
    chosen = rows.join(F.broadcast(rates), "lang").where(place < F.col("rate")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return chosen.select("lang", fold.alias("fold"), "text")


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from ``labelled_sample``: bits' weights by how often the classifiers of all folds but the first are right on
    the first, a language counting as much as another; then the classifiers anew from all. What reaches the driver are,
    for each language, sums over n-gram buckets and over bits; texts don't."""
    sample = stored(labelled_sample(docs, most), "sample")
    sums = sample.mapInPandas(_counts, _COUNTS).groupBy("lang", "fold").applyInPandas(_summed, _COUNTS).orderBy("lang", "fold").collect()
    langs = sorted({r.lang for r in sums})
    both = np.zeros((2, len(langs), BUCKETS))
    for r in sums:
        both[int(r.fold == 0), langs.index(r.lang)] += _dense(bytes(r.buckets), bytes(r.counts))
    model = Model(langs, both.sum(axis=0))
    if langs and both[0].any(axis=1).all() and both[1].any():
        first = Model(langs, both[0])
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def rights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts, names = batch["text"].tolist(), batch["lang"].tolist()
                for a, b in pieces(texts):
                    ok = pd.DataFrame(shared.value.right(texts[a:b], names[a:b])).groupby(names[a:b])
                    told = [(k, len(x), x.sum().to_numpy(float)) for k, x in ok]
                    yield pd.DataFrame(told, columns=["lang", "n", "right_bits"])

        told = sample.where("fold = 0 and length(text) > 0").mapInPandas(rights, _RIGHT)
        each = told.select("lang", "n", F.posexplode("right_bits").alias("bit", "good")).groupBy("lang", "bit")
        means = each.agg((F.sum("good") / F.sum("n")).alias("share")).groupBy("bit").agg(F.avg("share").alias("share"))
        found = {r.bit: r.share for r in means.collect()}
        shared.destroy()
        if found:
            model.weigh(np.array([found[k] for k in range(model.code.shape[1])]))
    forget(sample)
    return model


def predictor(spark: SparkSession, model: Model):
    """A column function: struct of lang_pred, score, ambiguous for a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            parts = [shared.value.predict(texts[a:b]) for a, b in pieces([t or "" for t in texts], 500_000)]
            yield pd.concat(parts, ignore_index=True) if parts else shared.value.predict([])

    return predict


def identify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` and a struct ``language``: lang_pred, score, ambiguous.

    Learns from the labelled documents of ``docs`` (see ``labelled_sample``) and predicts from text alone. A
    null text, or one without any letter, is ``und`` with score 0; so is every text if no document is
    labelled. Rows without doc_id are predicted, not learned from. A column named ``language`` is replaced.
    """
    return docs.withColumn("language", predictor(docs.sparkSession, fit(docs, most))(F.col("text")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_crc() % 3 == 1, F.lit(False))
    return identify(docs.select("doc_id", "text", "lang")).select("doc_id", held.alias("held_out"), "language.*")
