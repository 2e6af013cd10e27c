"""Removal of repeated word windows, found by difference-cover anchors.

The cover {1, 5, 11, 24, 25, 27} modulo 31 holds, for any two places, a common shift below 31 that brings
both to cover positions. So two equal windows of 50 words share a stretch of 20 words that starts at a cover
position in both documents, and only these stretches, the anchors, are hashed and compared: 6 of 31 places.
Anchors that two documents share are then extended: just the 50-word windows around them are hashed, and the
smallest doc_id of each such window decides what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table
from .words import WordHashes, mixed, window_hashes, words

WINDOW = 50
#: A perfect difference set: every remainder but 0 is a difference of two of its members, once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


@cache
def _hashes() -> WordHashes:
    return WordHashes()


def anchor_starts(n_words: int, window: int = WINDOW) -> np.ndarray:
    """Where anchors start in a document: the cover positions from which a whole anchor is left."""
    last = n_words - (window - PERIOD + 1)
    at = (np.arange(0, max(last + 1, 0), PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at <= last]


def candidate_windows(n_words: int, anchors: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows in which one of the shared ``anchors`` can be the aligned one."""
    n = n_words - window + 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.clip(anchors - PERIOD + 1, 0, n), 1)
    np.add.at(edges, np.clip(anchors + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(edges)[:n] > 0)


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, version and a digest of the whole word sequence, for documents of a window or more."""
    for batch in batches:
        rows = batch[["doc_id", "version", "text"]].itertuples(index=False)
        found = [(d, v, xxhash.xxh3_128_digest(b" ".join(w))) for d, v, t in rows if len(w := words(t)) >= WINDOW]
        yield pd.DataFrame(found, columns=["doc_id", "version", "digest"])


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = WINDOW - PERIOD + 1
    for batch in batches:
        parts: list[tuple] = []
        for doc, version, text in batch[["doc_id", "version", "text"]].itertuples(index=False):
            found = words(text)
            if len(found) >= WINDOW:
                at = anchor_starts(len(found))
                parts.append((window_hashes(_hashes().of(found), width)[at].view(np.int64), at, doc, version))
        if parts:
            sizes = [len(p[1]) for p in parts]
            doc, version = (np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (2, 3))
            place = (version << 32) + np.concatenate([p[1] for p in parts])
            yield pd.DataFrame({"h": np.concatenate([p[0] for p in parts]), "doc_id": doc, "place": place})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc, version, text, anchors in batch[["doc_id", "version", "text", "anchors"]].itertuples(index=False):
            found = words(text)
            at = candidate_windows(len(found), np.asarray(anchors))
            hashes = _hashes().of(found)
            h1 = window_hashes(hashes, WINDOW)[at]
            h2 = window_hashes(mixed(hashes), WINDOW)[at]  # of other numbers for the same words: 96 bits in all
            second = (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
            keys = {"doc_id": np.int64(doc), "version": np.int32(version), "pos": at.astype(np.int32)}
            yield pd.DataFrame({"h1": h1.view(np.int64), "h2": second} | keys)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, starts, whole in batch[["doc_id", "text", "starts", "whole"]].itertuples(index=False):
            found = words(text)
            n = len(found)
            if whole:
                kept: list[bytes] = []
            elif starts is None:
                kept = found
            else:
                edges = np.zeros(n + 1, np.int64)
                np.add.at(edges, np.asarray(starts), 1)
                np.add.at(edges, np.asarray(starts) + WINDOW, -1)
                kept = [found[k] for k in np.flatnonzero(np.cumsum(edges)[:n] == 0)]
            rows.append((doc, n, n - len(kept), b" ".join(kept).decode()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text"]).astype({"doc_id": "Int64"})


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, version, text: the version tells the different texts of one doc_id apart."""
    version = F.shiftright(F.xxhash64("text"), 32).cast("int").alias("version")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), version, "text")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version, starts, whole: window starts to remove in each document that has any.

    ``whole`` marks documents whose word sequence a smaller doc_id has from start to end; these leave the
    search at once, so that a large group of exact copies counts as one document in it.
    """
    rows = versions(docs).where("doc_id is not null")
    sequences = stored(rows.mapInPandas(_sequences, "doc_id long, version int, digest binary"), "sequences")
    first = sequences.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    late = sequences.join(first, "digest").where("doc_id > first_id")
    copies = stored(late.select("doc_id", "version").distinct(), "copies")
    forget(sequences)

    # Equal anchors are pre-aggregated by every map task; the join back meets a hot one in one task, as its
    # other side is an aggregate.
    anchors = rows.mapInPandas(_anchors, "h long, doc_id long, place long")
    shared = anchors.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    found = anchors.join(shared, "h", "left_semi")
    # equal rows with one doc_id have the same anchors: each counts once
    version = F.shiftright("place", 32).cast("int").alias("version")
    pos = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    near = found.groupBy("doc_id", version).agg(F.collect_set(pos).alias("anchors"))
    near = stored(near.join(copies, ["doc_id", "version"], "left_anti"), "anchors")

    windows = rows.join(near, ["doc_id", "version"])
    windows = stored(windows.mapInPandas(_windows, "h1 long, h2 int, doc_id long, version int, pos int"), "windows")
    forget(near)
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    place = (F.shiftleft(F.col("version").cast("long"), 32) + F.col("pos")).alias("place")
    late = windows.select("h1", "h2", "doc_id", place).join(first.where("first_id < last_id").drop("last_id"), ["h1", "h2"])
    starts = late.where("doc_id > first_id").groupBy("doc_id", version).agg(F.collect_set(pos).alias("starts"))
    starts = stored(starts.withColumn("whole", F.lit(False)), "starts")
    forget(windows)
    none = F.lit(None).cast("array<int>").alias("starts")
    return starts.unionByName(copies.select("doc_id", "version", none, F.lit(True).alias("whole")))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row.

    Words are runs of other characters than ASCII white space. A word goes if some window of 50 words over
    it starts in a document with a smaller doc_id too. Null and empty texts have no words; shorter texts than
    a window stay whole; repetition within one document stays. Rows with the same doc_id don't cut each other,
    and each, with a text of its own or the same, is cut by its own windows alone; rows without doc_id stay whole
    and cut nothing. Columns other than doc_id and text aren't read.
    """
    rows = versions(docs).join(repeated_windows(docs), ["doc_id", "version"], "left")
    return rows.mapInPandas(_cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
